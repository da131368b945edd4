"""Exact and near deduplication against brute force."""

import hashlib
import random

import pytest
import xxhash

from handbill.llm import exact_dedup, overlap, simhash

DDL = "doc_id long, text string, source string, fp string, _row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash", "clash") for i, t in rows], DDL).repartition(3)


ROWS = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, None), (5, ""), (6, "other"), (6, "other"), (None, "lone"), (None, "other"), (7, "Ä b"), (8, "ä b"), (9, "x " * 30000), (10, "X " * 30000)]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in (t or "")), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("budget", [exact_dedup.BUCKET_BYTES, 300])
def test_exact_groups(spark, budget):
    found = exact_dedup.exact_groups(docs(spark, ROWS), bucket_bytes=budget).collect()
    want, groups = expected(ROWS)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == want
    assert sum(r.kept for r in found) == groups
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


@pytest.mark.parametrize("crowd", [0, 2])
def test_crowded_content_meets_in_groups(spark, crowd, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CROWD", crowd)
    rows = [(k, f"text {k % 5}") for k in range(200)] + [(500 + k, "TEXT 1") for k in range(20)]
    found = exact_dedup.exact_groups(docs(spark, rows).repartition(12)).collect()
    want, groups = expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == want
    assert sum(r.kept for r in found) == groups


def test_grace_joins_members_and_settles_equal_hashes_by_content():
    records = [(h, c, [k]) for k, (h, c) in enumerate([(7, b"a"), (7, b"b"), (7, b"a"), (1 << 63, b"a")] * 50)]
    found = {(h, c): sorted(m) for h, c, m in exact_dedup.grace(iter(records), budget=500)}
    assert found.keys() == {(7, b"a"), (7, b"b"), (1 << 63, b"a")}
    assert found[7, b"a"] == sorted(k for k in range(200) if k % 4 in (0, 2))


def test_drop_copies_keeps_columns_and_one_row(spark):
    left = exact_dedup.drop_copies(docs(spark, ROWS))
    assert left.columns == ["doc_id", "text", "source", "fp", "_row"]
    assert left.count() == expected(ROWS)[1]


def test_empty_tables(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    assert simhash.near_groups(docs(spark, [])).count() == 0
    assert simhash.drop_near(docs(spark, [])).count() == 0


def brute_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_groups_equal_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "two words"), (1004, "Two words x")]
    prints = {i: brute_print(t) for i, t in rows}
    want = brute_components(prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs(spark, rows)).collect()}
    assert found == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_links_lose_none_in_crowded_buckets(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for _ in range(rng.randrange(4)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    chain = rng.getrandbits(64)
    for k in range(30):
        prints.add(chain)
        chain ^= 3 << (2 * k)
    want = brute_components({p: p for p in prints})
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    for limit in (64, 3, 1):
        frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
        roots = {r.node: r.root for r in simhash.components(simhash.links(frame, pair_limit=limit)).collect()}
        groups, brute = {}, {}
        for p in prints:
            groups.setdefault(roots.get(signed(p), signed(p)), set()).add(p)
            brute.setdefault(want[p], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_drop_near_keeps_the_smallest(spark):
    base = " ".join(f"word{k}" for k in range(400))
    rows = [(5, base), (3, base.upper()), (9, "something else entirely here"), (9, "something else entirely here"), (None, None), (4, "")]
    left = simhash.drop_near(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(3, base.upper()), (4, ""), (9, "something else entirely here")]


def shapes():
    rng = random.Random(9)
    path = list(range(3000))
    grid = [(k, k + d) for k in range(900) for d in (1, 30) if k + d < 900 and (d == 30 or k % 30 < 29)]
    yield "path", list(zip(path, path[1:]))
    yield "path backwards", list(zip(path[1:], path))
    yield "star", [(77, k) for k in range(2000)]
    yield "grid", grid
    yield "random", [(rng.randrange(2000), rng.randrange(2000)) for _ in range(1200)]
    yield "nothing", []


@pytest.mark.parametrize(("name", "edges"), shapes())
@pytest.mark.parametrize("few", [simhash.FEW_EDGES, 40])
def test_components_of_any_shape(spark, name, edges, few):
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), few_edges=few).collect()}
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    assert found == {x: top(x) for e in edges if e[0] != e[1] for x in e}


def test_a_long_run_of_neighbouring_fingerprints(spark):
    chain = [0]
    for k in range(300):
        chain.append(chain[-1] ^ (3 << (k % 60)))
    prints = spark.createDataFrame([(x,) for x in set(chain)], "fp long")
    assert {r.root for r in simhash.rooted(prints).collect()} == {min(chain)}


def test_common_shingles_are_counted_in_all_documents(spark, monkeypatch):
    """The near stage's counts are those of every document, however few share a block."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 40))) for _ in range(300)]
    want = {}
    for t in texts:
        for key in overlap.shingle_set(t, 2).tolist():
            want[key] = want.get(key, 0) + 1
    monkeypatch.setattr(overlap, "OF", 20)
    table = docs(spark, list(enumerate(texts))).repartition(5)
    keys, met = overlap._common(table, 2, block=100_000)
    assert dict(zip(keys.tolist(), met.tolist(), strict=True)) == {k: n for k, n in want.items() if n >= 30}
