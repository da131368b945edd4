"""Vector codes, exact top k and runs of words against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from handbill.llm import term_topk, vector_codes, word_runs

DDL = "vec_id long, embedding array<float>, label int, v string, id string, place string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, label, "clash", "clash", "clash") for i, e, label in rows], DDL).repartition(3)


def grid(rng, n, width, copies=0):
    """Coarse vectors, so that many distances and scores are equal; the first copies share one vector."""
    rows = [(k, [rng.randrange(-3, 4) / 256 for _ in range(width)], rng.choice([1, 2, None])) for k in range(n)]
    return [(k, rows[0][1] if k < copies else e, label) for k, e, label in rows]


ODD = [(900, None, 1), (901, [0.5, None, 0.0, 0.0], 1), (902, [float("nan")] * 4, 1), (903, [float("inf")] * 4, 2), (None, [0.25] * 4, 1), (904, [], 1), (7, [0.25] * 4, 2), (7, [0.25] * 4, 2), (905, [3e38] * 4, 1)]


def whole(rows):
    kept = [(i, e, label) for i, e, label in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    bound = lambda x: int(np.floor(min(max(256.0 * float(np.float32(x)), -(2.0**24)), 2.0**24)))
    return [(i, [bound(x) for x in e], label) for i, e, label in kept]


def brute_codes(rows, parts, entries, rounds):
    rows = sorted(whole(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max((len(v) for _, v, _ in rows), default=0) // parts)) * parts
    held = np.array([v + [0] * (width - len(v)) for _, v, _ in rows], np.int64).reshape(len(rows), parts, -1)
    books = held[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        apart = np.array([((held[:, p, None] - books[p]) ** 2).sum(2) for p in range(parts)])
        code = apart.argmin(2)
        if step < rounds:
            for p in range(parts):
                for e in set(code[p].tolist()):
                    books[p, e] = held[code[p] == e, p].sum(0) // (code[p] == e).sum()
    errors = apart.min(2).sum(0).tolist()
    by_label = Counter()
    for (_, _, label), error in zip(rows, errors, strict=True):
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()
    return sorted([(i, "".join(f"{c:02x}" for c in code[:, k].tolist()), errors[k], by_label[label], digest) for k, (i, _, label) in enumerate(rows)], key=str)


@pytest.mark.parametrize(("n", "width", "more"), [(700, 8, []), (300, 6, ODD), (5, 4, ODD)])
def test_codes_equal_brute_force(spark, monkeypatch, n, width, more):
    monkeypatch.setattr(vector_codes, "BLOCK", 100)
    rows = grid(random.Random(n), n, width, copies=n // 3) + more
    found = vector_codes.with_label_errors(vector_codes.coded(vectors(spark, rows), parts=4, entries=9))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_codes(rows, 4, 9, 2)


def test_cover_tree_keeps_its_rules_and_assigns_most_points_with_their_subtree():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(-4, 4, (3000, 3)) + c for c in ((0, 0, 0), (400, 0, 0), (0, 900, 90))])
    tree = vector_codes.Tree.from_bytes(vector_codes.cover_tree(rows).to_bytes())
    assert (tree.points[tree.places] == rows).all()
    assert tree.counts.sum() == len(rows)
    for centre, begin, end, child, children, radius in tree.nodes.tolist():
        below = tree.points[begin:end]
        assert ((below - tree.points[centre]) ** 2).sum(1).max() == radius
        own = tree.nodes[child : child + children]
        if children:
            assert own[0, 1] == begin
            assert own[-1, 2] == end
            assert (own[1:, 1] == own[:-1, 2]).all()
            assert (4 * own[:, 5] <= radius).all()
            middles = tree.points[own[:, 0]]
            apart = ((middles[:, None] - middles) ** 2).sum(2)[~np.eye(children, dtype=bool)]
            assert (4 * apart > radius).all()
    seen = []
    compared = vector_codes.assign(tree, np.array([[0, 0, 0], [400, 0, 0], [0, 900, 90]]), lambda a, b, _: seen.extend(np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)] or [[]])))
    assert sorted(seen) == list(range(len(tree.points)))
    assert compared < len(tree.points) / 10


def brute_top(rows, k, every):
    rows, found = whole(rows), []
    for q, (i, v, _) in enumerate(rows):
        if i is not None and i % every == 0:
            others = [(-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, j) for c, (j, w, _) in enumerate(rows) if c != q]
            found += [(i, rank, j, -score) for rank, (score, _, _, j) in enumerate(sorted(others)[:k], 1)]
    return sorted(found, key=str)


@pytest.mark.parametrize(("n", "more", "values", "merged"), [(260, [], 1 << 18, 256), (260, ODD, 120, 2), (3, ODD, 8, 2), (1, [], 64, 2)])
def test_top_equals_brute_force(spark, n, more, values, merged):
    rows = grid(random.Random(n), n, 4, copies=n // 3) + more
    found = term_topk.top(vectors(spark, rows), F.col("id") % 7 == 0, group_values=values, merged=merged)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_top(rows, 5, 7)


def test_sparse_postings_hold_places_and_dense_ones_all_weights():
    held = term_topk.postings(np.array([0, 5, 1, 0, 0, 2, 7, 0, 3]), np.array([3, 3, 3]))
    assert held[0][0].tolist() == [2]
    assert held[1][1].tolist() == [5]
    assert held[2][0] is None
    assert held[2][1].tolist() == [1, 2, 3]
    assert term_topk.postings(np.zeros(0, np.int64), np.zeros(2, np.int64)) == {}


def test_empty_vector_tables(spark):
    none = vectors(spark, [])
    assert vector_codes.with_label_errors(vector_codes.coded(none)).count() == 0
    assert term_topk.top(none, F.col("id") % 50 == 0).count() == 0


def brute_runs(words):
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length, held = j - i + q, words[i : j + q]
            if j > i and length >= max(6, 4 * q) and all(held[p:] != held[: length - p] for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found)


def repeating(rng, kinds, most):
    words = [b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(most))]
    for _ in range(rng.randrange(3)):
        at, unit = rng.randrange(len(words) + 1), [b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(1, 24))]
        words[at:at] = (unit * 9)[: rng.randrange(1, 9 * len(unit))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for kinds in (1, 2, 3, 50):
        texts = [repeating(rng, kinds, 80) for _ in range(150)]
        found = word_runs.runs_of_texts(texts)
        assert found == [brute_runs(t) for t in texts]
        assert found == [word_runs.runs_of([int(w) for w in t]) for t in texts]  # the candidates lose nothing


def test_runs_of_fibonacci_words_and_nested_runs():
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    assert word_runs.runs_of(b) == brute_runs(b) == []
    nested = ([1] * 7 + [2, 3]) * 5
    assert word_runs.runs_of(nested) == brute_runs(nested)
    assert (0, 45, 9) in word_runs.runs_of(nested)


def brute_digest(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        a, n = h // 10 % len(words), len(words)
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(kept))


def test_digest_of_runs(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(w.decode() for w in repeating(rng, rng.choice([2, 40, 999]), 120))) for k in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n "), (None, "a " * 9), (1003, "ä b  c " * 7), (1004, "x " * 30_000), (1005, "\x1f \x1f " * 5), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, runs string, start string").repartition(3)
    found = word_runs.digest(docs)
    quick = [(i, t) for i, t in rows if i != 1004]
    assert sorted((tuple(r) for r in found.filter("doc_id is null or doc_id <> 1004").collect()), key=str) == sorted((brute_digest(i, t) for i, t in quick), key=str)
    long = found.filter("doc_id = 1004").first()
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 30_000, 1, 30_000_000)
    assert word_runs.digest(docs.limit(0)).count() == 0


def test_find_returns_runs_and_short_texts(spark):
    docs = spark.createDataFrame([(1, "a b c a b c a b c a b c d"), (2, None)], "doc_id long, text string")
    one, none = word_runs.find(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in one.runs] == [(0, 12, 3)]
    assert one.collapsed == "a b c d"
    assert (none.runs, none.collapsed) == ([], "")
