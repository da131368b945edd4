"""The pipeline's stages against plain Python, with planted copies."""

import hashlib
import random

import corpus_pipeline
import pytest

from handbill.llm import mixing, overlap, simhash

DDL = "doc_id long, text string, lang string, source string"


def planted():
    """Rows with near copies of several sizes, copies around one text, edges, nulls and repeats; no two shared ids."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for n in (3, 5, 8, 30, 60, 200, 400):
        base = [rng.choice(words) for _ in range(n)]
        texts.append(base)
        for edits in (1, 2, 3, 5, 8, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(n)] = rng.choice(words)
            texts.append(copy)
        texts += [base + ["tail"], ["head", *base], base[: n * 9 // 10]]
    crowd = [rng.choice(words) for _ in range(90)]
    for _ in range(40):
        copy = list(crowd)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(90)] = rng.choice(words)
        texts.append(copy)
    rows = [(k, " ".join(t), "en", "s") for k, t in enumerate(texts)]
    rows += [(1000, rows[0][1].upper(), "en", "s"), (1001, None, "en", "s"), (1002, " \n", "en", "s"), (1003, "one", "en", "s"), (1003, "one", "en", "s"), (None, rows[30][1] + " x", "en", "s")]
    rng.shuffle(rows)
    return rows


def brute_kept(rows):
    def shingles(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [overlap.set_fingerprint(overlap.shingle_set(r[1])) for r in rows]
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(rows)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                assert ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= simhash.ALIKE_BITS
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((rows[k] for k in range(len(rows)) if find(k) == k), key=str)


@pytest.mark.parametrize("limit", [64, 2])
def test_near_stage_equals_brute_force(spark, limit):
    rows = planted()
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    want = brute_kept(rows)
    left = corpus_pipeline.near(spark, docs, "") if limit == 64 else simhash.drop_similar(docs, pair_limit=limit)
    assert sorted(map(tuple, left.collect()), key=str) == want
    assert left.columns == docs.columns and len(want) < len(rows) - 40


def test_hot_shingles_lose_no_link(spark):
    """A line in thousands of rows; some rows are alike only to a row of the largest component that is no hub at first."""
    line = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(k, " ".join([*line, f"t{k}"]), "en", "s") for k in range(80)]
    rows += [(80 + k, " ".join([*line, f"u{k}", f"v{k}"]), "en", "s") for k in range(3)]
    rows += [(1000 + 90 * k + j, " ".join([*line[8:], f"t{k}", f"q{k}-{j}", f"r{j}"]), "en", "s") for k in range(10) for j in range(20)]
    left = simhash.drop_similar(spark.createDataFrame(rows, DDL).repartition(3))
    assert sorted(map(tuple, left.collect()), key=str) == brute_kept(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_small_families_and_small_limits(spark, seed):
    """Many short texts of few words with few hubs and few pairs at once equal brute force."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)]
    rows = []
    for k in range(400):
        base = rows[rng.randrange(len(rows))][1].split() if rows and rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randrange(5, 16))]
        base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((k, " ".join([*base, rng.choice(words)][: rng.randrange(5, 20)]), "en", "s"))
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    left = simhash.drop_similar(docs, pair_limit=2, pivots=1)
    assert sorted(map(tuple, left.collect()), key=str) == brute_kept(rows)


def test_sets_of_one_id_are_told_apart(spark):
    rows = [(1, 10, 7, 3, 0), (2, 11, 7, 3, 0), (3, 12, 7, 4, 1), (4, 13, 8, 2, 2)]
    found = {r.doc_id: r.id for r in overlap.told_apart(spark.createDataFrame(rows, "doc_id long, text_hash long, id long, n long, fp long")).collect()}
    assert found[1] == found[2] != found[3] and found[4] == 8


def test_ring_loses_no_close_fingerprints(spark):
    rng = random.Random(11)
    rows = []
    for bits in range(40):
        for _ in range(20):
            a, flips = rng.getrandbits(64), 0
            for k in rng.sample(range(64), bits):
                flips |= 1 << k
            rows.append((a - (1 << 63), (a ^ flips) - (1 << 63), bits))
    table = spark.createDataFrame(rows, "a long, b long, bits int")
    for most, segments in ((26, 8), (2, 5), (3, 7)):
        found = table.select("bits", simhash.on_ring(table["a"], table["b"], most, segments).alias("close")).collect()
        assert all(r.close == (r.bits <= most) for r in found)


def test_sketches_of_long_texts(spark):
    """A text of many shingles sends few of them, and still meets its copies."""
    rng = random.Random(3)
    words = [f"v{k}" for k in range(5000)]
    rows = []
    for k in range(12):
        base = [rng.choice(words) for _ in range(2000)]
        copy = list(base)
        for _ in range(30):
            copy[rng.randrange(2000)] = rng.choice(words)
        rows += [(2 * k, " ".join(base), "en", "s"), (2 * k + 1, " ".join(copy), "en", "s")]
    left = simhash.drop_similar(spark.createDataFrame(rows, DDL).repartition(3))
    assert sorted(map(tuple, left.collect()), key=str) == brute_kept(rows) and left.count() == 12


def test_near_stage_of_nothing(spark):
    assert corpus_pipeline.near(spark, spark.createDataFrame([], DDL), "").count() == 0


def test_mixture_stage_meets_its_targets_under_the_bound(spark):
    rng = random.Random(7)
    signs = ["", "", "", "", "", "@", " | ", "icense", "%"]
    rows = [(k, rng.choice(signs) + "x" * rng.randrange(40, 400), rng.choice(["a", "a", "b"]), rng.choice(["s", "s", "s", "t"])) for k in range(600)]
    docs = spark.createDataFrame(rows, DDL)
    mixed = mixing.mix(docs, corpus_pipeline.MIX)
    held = mixed.collect()
    assert all(0 <= r._mix_rate <= 1 for r in held)
    for r in mixing.report(mixed, corpus_pipeline.MIX).collect():
        assert abs(r.expected - r.target) < 0.001
    assert 0.4 < held[0]._mix_budget <= 0.8
    drawn = sum(r._mix_rate * r._mix_tokens for r in held) / sum(r._mix_tokens for r in held)
    assert abs(drawn - held[0]._mix_budget) < 0.001
    stayed = corpus_pipeline.mixture(spark, docs, "")
    assert sorted(map(tuple, stayed.collect())) == sorted(tuple(r)[:4] for r in held if r._mix_copies) and stayed.columns == docs.columns


def test_bounded_raking_both_ways(spark):
    rows = [("s", "en", "prose", 60), ("s", "en", "contact", 9), ("s", "de", "prose", 30), ("s", "de", "contact", 12), ("t", "en", "prose", 25), ("t", "de", "contact", 6)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").coalesce(1)
    plan = mixing.Plan(shares={"topic": {"prose": 0.8, "contact": 0.2}}, powers={"source": 1.0, "lang": 1.0}, budget=0.6, most_copies=1)
    for local in (20_000, 0):
        raked, budget = mixing.rake(cells, plan, local_cells=local)
        found = raked.collect()
        assert budget == 0.6 and all(r.weight * budget * 142 <= r.tokens * (1 + 1e-9) for r in found)
        assert abs(sum(r.weight for r in found if r.topic == "prose") - 0.8) < 0.001
        assert abs(sum(r.weight for r in found if r.source == "t") - 31 / 142) < 0.001


NAMES = ["row_key", "row_key_", "_mix_source", "_mix_tokens", "_mix_rate", "row", "key", "fp", "id", "n", "salt", "content", "hash", "rep", "text_hash", "held", "shard", "place", "Kind.with.dots"]


def test_columns_of_any_name(spark):
    """Every stage keeps docs' own columns, whatever they are called."""
    rows = [(1, "the house and the street", "en", "s"), (2, "The house and the street", "en", "s"), (2, "The house and the street", "en", "s"), (None, "das Haus und die Strasse", "de", "s"), (4, None, None, None), (5, "", "en", None), (6, "the end " * 40_000, "en", "t")]
    docs = spark.createDataFrame([(*r, *NAMES) for r in rows], f"{DDL}, " + ", ".join(f"`{n}` string" for n in NAMES))
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            left = stage(spark, table, "")
            found = left.collect()
            assert name == "tokens" or left.columns == docs.columns
            assert len(found) == 0 if table is not docs else len(found) > 0 or name == "mixture"
            assert name == "tokens" or all(tuple(r)[4:] == tuple(NAMES) for r in found)


def test_run_equals_its_stages_in_plain_python(spark, tmp_path):
    """run() over planted exact and near copies: each stage's rows follow from the rows of the one before."""
    rng = random.Random(4)
    english, german = ("the of and house street to in is was for water people".split(), "der die das und haus ist nicht mit auf wasser leute ein".split())
    rows = []
    for k in range(120):
        lang, words = (("en", english), ("de", german))[k % 2]
        base = [rng.choice(words) + (str(rng.randrange(50)) if rng.random() < 0.5 else "") for _ in range(80)]
        rows.append((k, " ".join(base), lang, f"s{k % 3}"))
        if k % 10 == 0:
            rows.append((1000 + k, " ".join(base).upper(), lang, "s0"))
        if k % 7 == 0:
            rows.append((2000 + k, " ".join([*base[:-1], "changed"]), lang, "s1"))
    rows += [(3000, None, None, None), (3001, "12 !", None, "s0"), (7, rows[7][1], rows[7][2], rows[7][3])]
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    worded = [r for r in set(rows) if r[1] and any(c.isalpha() for c in r[1])]
    last = {}
    for r in worded:
        last[r[1].lower()] = max(last.get(r[1].lower(), r), r)
    kept = {r[0]: r for r in brute_kept(list(last.values()))}
    mixed = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(list(kept.values()), DDL), corpus_pipeline.MIX).collect()}
    want = {i for i, r in mixed.items() if r._mix_copies}
    assert set(found) == want and len(want) > 20
    for i in want:
        assert found[i].decoded_sha256 == hashlib.sha256(kept[i][1].encode()).hexdigest()
