"""The phrase index against every ratio."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from handbill.functions import text as t
from handbill.operators import ocr, phrases

ALPHABET = "абвеокрaeopcxy015 "


def form(key):
    return "".join(t.LOOKALIKES.get(c, c) for c in key)


def brute(text, dictionary, threshold):
    text = (text or "").strip()
    key, best = "".join(text.lower().split()), (0.0, text)
    if not key:
        return text, None
    for phrase in sorted(dictionary):
        other = "".join(phrase.lower().split())
        ratio = max(difflib.SequenceMatcher(None, *pair, autojunk=False).ratio() for pair in ((key, other), (form(key), form(other)))) if other else 0.0
        if ratio > max(best[0], threshold):
            best = ratio, phrase
    return best[1], round(best[0], 6) or None


def changed(rng, word):
    letters = list(word)
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(letters) + 1)
        if rng.random() < 0.5:
            letters.insert(at, rng.choice(ALPHABET))
        elif letters and at < len(letters):
            letters[at] = rng.choice(ALPHABET)
    return "".join(letters)


@pytest.mark.parametrize("threshold", [0.7, 0.72, 0.9])
def test_phrases_equal_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    dictionary = [" ".join("".join(rng.choice(ALPHABET[:-1]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    dictionary += ["Концерт года", "концерт  ГОДА", "концерт", "", " "]
    texts = [changed(rng, rng.choice(dictionary)) for _ in range(250)] + [None, "", "  ", "кон церт года", "КOHЦEPT ГОДА", "a", "zzzzzz" * 30]
    found = phrases.matched(spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"), spark.createDataFrame([(p,) for p in dictionary], "phrase string"), threshold)
    got = {r.text_id: (r.phrase, r.score) for r in found.collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        want = brute(text, dictionary, threshold)
        assert got[k][1] == want[1], (text, got[k], want)
        assert got[k][0] == want[0] or want[1] is not None


def test_what_similar_texts_share_at_least():
    """The bounds hold for every pair of short texts over few letters."""
    rng = random.Random(4)
    for _ in range(20_000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 16))) for _ in range(2))
        ratio, s = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), len(a) + len(b)
        if ratio <= 0.72:
            continue
        bag = lambda parts: {(p, k) for p in set(parts) for k in range(parts.count(p))}
        assert len(bag(list(a)) & bag(list(b))) >= phrases.shared_letters(s, 0.72)
        pairs = lambda x: [x[k : k + 2] for k in range(len(x) - 1)]
        assert s < phrases.LONG or len(bag(pairs(a)) & bag(pairs(b))) >= phrases.shared_pairs(s, 0.72)


def test_no_texts_and_no_phrases(spark):
    texts = spark.createDataFrame([(1, "one")], "text_id int, text string")
    empty = spark.createDataFrame([], "phrase string")
    assert [tuple(r) for r in phrases.matched(texts, empty).collect()] == [(1, "one", "one", None)]
    assert phrases.matched(texts.limit(0), empty).count() == 0


def test_nearest_equals_every_ratio_and_pairs_equal_names_only(spark):
    """Steps lose nothing, for repetitive texts too; numbered names, all alike, meet only themselves."""
    rng = random.Random(11)
    keys, others = ({"".join(rng.choice("ab0о") for _ in range(rng.randint(1, 9))) for _ in range(n)} for n in (60, 90))
    found = phrases.nearest(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(o,) for o in others], "other string"), 0.72).collect()
    form = lambda x: x.translate(str.maketrans(t.LOOKALIKES))
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    for key in keys:
        scores = {o: max(ratio(key, o), ratio(form(key), form(o))) for o in others}
        top = max(scores.values())
        got = {r["other"]: r["score"] for r in found if r["key"] == key}
        assert all(got[o] == scores[o] for o in got)
        assert {o for o, s in got.items() if s == top} == {o for o, s in scores.items() if s == top and top >= 0.72}
    names = spark.range(300).selectExpr("concat('supplier#', lpad(id, 9, '0')) AS key")
    assert phrases.nearest(names, names.withColumnRenamed("key", "other"), 0.72).count() == 300


def test_names_are_not_broadcast_and_ratios_computed_once(spark, monkeypatch):
    """However small a plan takes the names for; counts of elements are broadcast only if they are few."""
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    keys, others = spark.createDataFrame([("konzert",), ("abende",)], "key string"), spark.createDataFrame([("konzerte",), ("abendx",)], "other string")
    entities = spark.createDataFrame([(1, "artist", "Konzert", ["Abende"]), (2, "artist", "Abend", None)], "entity_id int, entity_type string, name string, aliases array<string>")
    plans, real = [], phrases.checkpointed
    monkeypatch.setattr(phrases, "checkpointed", lambda df: plans.append(plan(df)) or real(df))
    assert {tuple(r) for r in phrases.nearest(keys, others, 0.7).collect()} >= {("konzert", "konzerte", 14 / 15), ("abende", "abendx", 10 / 12)}
    compared = [p for p in plans if "ArrowEvalPython" in p]
    assert compared
    for p in compared:
        assert 0 < p.index("ArrowEvalPython") < p.index("Aggregate") and p.count("ArrowEvalPython") == 1  # plans read from the end
    assert "BroadcastHashJoin" not in next(p for p in plans if "Join" in p)
    assert "Join" in plan(phrases._one_more(keys, others)) and "BroadcastHashJoin" not in plan(phrases._one_more(keys, others))
    exact = ocr.exact_names(keys.select(F.col("key").alias("text_id"), F.col("key").alias("text")), entities)
    assert "Join" in plan(exact) and "BroadcastHashJoin" not in plan(exact)
    assert "BroadcastHashJoin" in plan(phrases._alike(keys, others, 0.7))
    monkeypatch.setattr(phrases, "FEW", 0)
    assert "BroadcastHashJoin" not in plan(phrases._alike(keys, others, 0.7))
    assert {tuple(r) for r in phrases._alike(keys, others, 0.7).collect()} >= {("konzert", "konzerte"), ("abende", "abendx")}
