"""Lines against a dictionary of phrases: the most similar phrase by gestalt ratio, found through an index.

The ratio of two texts of together S letters is 2 * M / S, where M letters match in blocks
that stand in the same order. A ratio over the threshold t needs M = ceil(t * S / 2), so that
the texts share M letters, counting repeats. Between two blocks lies at least one of the
S - 2 * M letters that do not match, so that there are at most S - 2 * M + 1 blocks and the
texts share at least 3 * M - S - 1 pairs of neighbouring letters.

Each text is therefore a set of numbered letters (for pairs of texts of together less than
LONG letters) and of numbered pairs of letters (for longer ones), in an order that begins
with the rarest of the dictionary. Two sets of which o elements are shared have one in common
among all but the last o - 1 of each: only these prefixes are joined, which leaves out what is
in nearly every phrase. What meets is counted whole before any ratio is computed.

The higher the threshold, the shorter the prefixes. As only the most similar phrase is asked
for, texts are first looked for by equal form, then by one letter more or less, then by the
index of a high threshold; only those without a phrase that nothing unseen can equal go on.
"""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import text as t
from ..plans.shared import checkpointed, shuffled, spread

#: Letters of two texts together from which on they share a pair of letters at any threshold of LEAST or more.
LONG, LEAST = 12, 0.7
#: Phrases in one row of the index.
POSTING = 256
#: Elements up to which their counts are broadcast.
FEW = 100_000
#: Pairs of a text and a phrase, alike or not, for each part that they are compared in.
PAIRS = 50_000
#: Letters of a text up to which it is also spelt with each letter left out.
SPELT = 64
#: Thresholds whose index is tried before that of the threshold asked for.
STEPS = (0.9,)
#: Scores that differ by less may be equal when rounded.
CLOSE = 1e-6


@pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt similarity of two texts, 0 to 1, which SQL has no function for."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def _numbered(parts: Column, mark: str) -> Column:
    """Each element with how many of its like stood before it, so that repeats are elements of their own."""
    return F.transform(parts, lambda p, k: F.concat(F.lit(mark), p, F.lit("#"), F.size(F.filter(F.slice(parts, 1, k), lambda q: q == p)).cast("string")))


def _letters(key: Column) -> Column:
    return F.filter(F.split(key, ""), lambda c: c != "")


def _pairs(key: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda k: F.substring(key, k, F.lit(2)))


def shared_letters(s: int, threshold: float) -> int:
    """Letters that texts of together s letters share at least, if their ratio is over the threshold."""
    return max(1, math.ceil(threshold * s / 2 - 1e-9))


def shared_pairs(s: int, threshold: float) -> int:
    return max(1, 3 * shared_letters(s, threshold) - s - 1)


def _least(n: Column, threshold: float, long: bool) -> Column:
    """The elements that a text of n letters shares at least with any text that can be similar to it."""
    sizes = F.sequence(F.greatest(F.ceil(n * threshold / (2 - threshold)).cast("int"), F.lit(1)), F.greatest(F.floor(n * (2 - threshold) / threshold).cast("int"), F.lit(1)))
    whole = lambda m: F.ceil((n + m) * threshold / 2 - 1e-9)
    of = (lambda m: 3 * whole(m) - (n + m) - 1) if long else whole
    return F.greatest(F.array_min(F.transform(sizes, of)), F.lit(1)).cast("int")


def _sets(df: DataFrame, threshold: float) -> DataFrame:
    """key, n and its elements by kind (letters, pairs) with how many of them a similar text shares at least."""
    form = t.lookalike_key(F.col("key"))  # equal blocks stay equal when lookalikes become one
    sized = df.select("key", F.length("key").alias("n"), form.alias("form"))
    none = F.array().cast("array<string>")
    letters = F.when(F.col("n") < LONG, _numbered(_letters(F.col("form")), "")).otherwise(none)
    pairs = F.when(F.col("n") > 1, _numbered(_pairs(F.col("form")), "")).otherwise(none)
    return sized.select("key", "n", F.explode(F.array(F.struct(F.lit("l").alias("kind"), letters.alias("set"), _least(F.col("n"), threshold, False).alias("least")), F.struct(F.lit("p").alias("kind"), pairs.alias("set"), _least(F.col("n"), threshold, True).alias("least")))).alias("s")).select("key", "n", "s.*").filter(F.size("set") > 0)


def _prefixes(sets: DataFrame, often: DataFrame) -> DataFrame:
    """key, n, kind, set and one element of its prefix a row."""
    each = sets.select("key", "n", "kind", "least", F.explode("set").alias("element")).join(often, ["kind", "element"], "left")
    ordered = each.groupBy("key", "n", "kind", "least").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "element"))).alias("ordered"))
    first = ordered.select("key", "n", "kind", F.transform("ordered", lambda o: o["element"]).alias("set"), F.greatest(F.size("ordered") - F.col("least") + 1, F.lit(0)).alias("most"))
    return first.select("key", "n", "kind", "set", F.explode(F.slice("set", F.lit(1), F.col("most"))).alias("element"))


def _alike(keys: DataFrame, others: DataFrame, threshold: float, parts: int | None = None) -> DataFrame:
    """key, other: pairs that may have a ratio of the threshold or more, none of those that have left out; met in that many parts at most."""
    known = _sets(others.select(F.col("other").alias("key")), threshold)
    often = checkpointed(known.select("kind", F.explode("set").alias("element")).groupBy("kind", "element").agg(F.count(F.lit(1)).alias("often")))
    joined = F.broadcast if often.count() <= FEW else shuffled
    number = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    asked = _prefixes(_sets(keys, threshold), joined(often))
    wanted = often.join(shuffled(asked.select("kind", "element").distinct()), ["kind", "element"], "left_semi")
    index = _prefixes(known, joined(often)).join(joined(wanted), ["kind", "element"]).withColumn("part", F.pmod(number, F.ceil(F.col("often") / POSTING)))
    index = index.groupBy("kind", "element", "part").agg(F.collect_list(F.struct(F.col("key").alias("other"), F.col("n").alias("m"), F.col("set").alias("with"))).alias("postings")).drop("part")
    met = spread(asked, "kind", "element", most=parts).join(shuffled(index), ["kind", "element"]).select("key", "n", "kind", "set", F.explode("postings").alias("p")).select("key", "n", "kind", "set", "p.*")
    s = F.col("n") + F.col("m")
    m_least = F.ceil(s * threshold / 2 - 1e-9)
    fits = (2 * F.least("n", "m") >= F.lit(threshold) * s) & F.when(F.col("kind") == "l", s < LONG).otherwise(s >= LONG)
    enough = F.size(F.array_intersect("set", "with")) >= F.greatest(F.when(F.col("kind") == "l", m_least).otherwise(3 * m_least - s - 1), F.lit(1))
    return met.filter(fits & enough).select("key", "other").distinct()


def _one_more(keys: DataFrame, others: DataFrame) -> DataFrame:
    """key, other: pairs of up to SPELT letters of which one is the other, in lookalike form, with a letter left out."""

    def spelt(df: DataFrame, name: str, whole: int) -> DataFrame:
        form, n = t.lookalike_key(F.col(name)), F.length(F.col(name))
        cut = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.substring(form, F.lit(1), k - 1), F.substring(form, k + 1, n)))
        every = F.concat(F.array(F.struct(F.lit(whole).alias("cut"), form.alias("form"))), F.transform(F.array_distinct(cut), lambda c: F.struct(F.lit(1 - whole).alias("cut"), c.alias("form"))))
        return df.filter(n.between(1, SPELT)).select(name, F.explode(every).alias("s")).select(name, "s.*")

    return spelt(keys, "key", 0).join(shuffled(spelt(others, "other", 1)), ["cut", "form"]).select("key", "other").distinct()


def nearest(keys: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """key, other, score: others (other) of each key (key) with a score of the threshold or more, among them all with its highest score.

    Keys and others are distinct texts in lower case without white space; the score is the ratio of the texts or of their lookalike
    forms, the greater. A key leaves once its best score is higher than that of any pair not yet seen: beyond one letter more or
    less, the unmatched letters of a key of n letters are 2 or more, and its score n / (n + 1) at most.
    """
    if threshold < LEAST:
        raise ValueError(f"the index needs a threshold of {LEAST} or more")
    alike = ratio.asNondeterministic()  # else the filter is put before the pairs are made distinct, and each ratio computed again after it
    score = F.greatest(alike(F.col("key"), F.col("other")), alike(t.lookalike_key(F.col("key")), t.lookalike_key(F.col("other"))))
    left, others = checkpointed(keys.select("key").filter("key <> ''")), checkpointed(others.select("other").filter("other <> ''"))
    form = lambda df, name: df.select(name, t.lookalike_key(F.col(name)).alias("form"))
    found = [checkpointed(form(left, "key").join(shuffled(form(others, "other")), "form").select("key", "other", F.lit(1.0).alias("score")))]
    n, many = F.length("key"), others.count()
    for level in (None, *(x for x in STEPS if x > threshold), threshold):
        left = checkpointed(left.join(found[-1].select("key").distinct(), "key", "left_anti"))
        parts = math.ceil(left.count() * many / PAIRS)
        if not parts:
            break
        pairs = _one_more(left.filter(n < SPELT), others) if level is None else _alike(left, others, level, parts)
        unseen = n / (n + 1) + CLOSE if level is None else F.lit(level + CLOSE)
        sure = F.col("score") >= threshold
        if level != threshold:
            sure &= F.col("score") > unseen
        found.append(checkpointed(spread(pairs, "key", "other", most=parts).withColumn("score", score).filter(sure)))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def matched(texts: DataFrame, dictionary: DataFrame, threshold: float = 0.72) -> DataFrame:
    """text_id, text, phrase, score: the most similar phrase (dictionary: phrase) of each text (text_id, text), if its ratio is over the threshold; else the text itself and a null score.

    Texts are compared in lower case without white space, directly and with lookalike letters made one; ties go to the
    smaller phrase. Equal texts are compared once. An empty or null text has itself (empty) as phrase.
    """
    if threshold < LEAST:
        raise ValueError(f"the index needs a threshold of {LEAST} or more")
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    held = texts.select("text_id", F.trim(t.text_or_empty(F.col("text"))).alias("text")).withColumn("key", plain(F.col("text")))
    phrases = dictionary.select("phrase", plain(F.col("phrase")).alias("other")).filter("other <> ''").groupBy("other").agg(F.min("phrase").alias("phrase"))
    keys = held.select("key").filter("key <> ''").distinct()

    same = keys.join(phrases, F.col("key") == F.col("other")).select("key", "phrase", F.lit(1.0).alias("score"))
    rest = keys.join(same.select("key"), "key", "left_anti")
    near = nearest(rest, phrases.select("other"), threshold).filter(F.col("score") > threshold).join(phrases, "other")
    best = near.groupBy("key").agg(F.max("score").alias("top"), F.min_by("phrase", F.struct(-F.col("score"), F.col("phrase"))).alias("phrase")).select("key", "phrase", F.col("top").alias("score"))
    return held.join(same.unionByName(best), "key", "left").select("text_id", "text", F.coalesce("phrase", "text").alias("phrase"), F.round("score", 6).alias("score"))
