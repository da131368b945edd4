"""Language identification in two steps: the family first, then the language within it.

Features are hashed counts of one to three letters, as square roots of shares. A linear
support vector machine for each family against the rest picks the family; within a family a
machine for each pair of languages votes. All labelled texts are learned from: in shards of
about a thousand texts, each with texts of every language, whose machines are averaged.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, per_texts, slices

UNDETERMINED = "und"
#: Families by ISO 639-1 code. A language not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no nb nn sv".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "finnic": "et fi".split(),
    "turkic": "az kk ky tr uz".split(),
    "indic": "bn gu hi mr ne pa ur".split(),
    "semitic": "am ar he mt".split(),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
BUCKETS = 4096
#: About so many labelled texts are learned from together; of more languages than that the commonest are learned.
SHARD, MOST_LANGUAGES = 1000, 256

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def features(text: str | None) -> np.ndarray | None:
    """The feature vector of a whole text; None if it has no letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _letters()[codes]
    if not letters.any():
        return None
    codes = np.where(letters, codes, 32).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = letters[1:] | letters[:-1]  # one blank between words
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint64)
    counts = np.zeros(BUCKETS)
    gram = np.zeros(len(codes), np.uint64)
    for n in range(3):
        gram = gram[: len(codes) - n] * np.uint64(0x9E3779B1) + codes[n:] + np.uint64(n)
        mixed = gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)
        counts += np.bincount(mixed.astype(np.int64), minlength=BUCKETS)
    shares = np.sqrt(counts)
    return (shares / np.linalg.norm(shares)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, passes: int = 15) -> np.ndarray:
    """Weights, the bias last, of a linear SVM with squared hinge loss; y is 1 or -1. Dual coordinate descent."""
    x, plain = np.ones((len(x), x.shape[1] + 1)), x
    x[:, :-1] = plain
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    slack = 1 / (2 * cost * share)
    norms, alpha, w = (x * x).sum(1) + slack, np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(passes):
        for k in order.permutation(len(x)):
            step = y[k] * (x[k] @ w) - 1 + slack[k] * alpha[k]
            new = max(0.0, alpha[k] - step / norms[k])
            if new != alpha[k]:
                w += (new - alpha[k]) * y[k] * x[k]
                alpha[k] = new
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    #: How steeply a margin turns into a probability.
    steep: float = 4.0

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of features."""
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        if len(self.families) > 1:
            margin = self.steep * (x @ self.family_weights.T)
            share = np.exp(margin - margin.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
        else:
            share = np.ones((len(x), 1))
        picked, score = share.argmax(1), share.max(1)
        names = np.empty(len(x), object)
        for k, family in enumerate(self.families):
            rows, codes = np.flatnonzero(picked == k), self.languages[family]
            if not len(rows):
                continue
            if len(codes) == 1:
                names[rows] = codes[0]
                continue
            votes = np.zeros((len(rows), len(codes)))
            for i, a in enumerate(codes):
                for j in range(i + 1, len(codes)):
                    sure = 1 / (1 + np.exp(-2 * self.steep * (x[rows] @ self.pair_weights[a, codes[j]])))
                    votes[:, i] += sure + (sure >= 0.5)
                    votes[:, j] += 1 - sure + (sure < 0.5)
            votes /= 2 * (len(codes) - 1)
            names[rows] = [codes[i] for i in votes.argmax(1)]
            score[rows] *= votes.max(1)
        return list(names), np.clip(score, 0.0, 1.0)


def grouped(langs: Iterable[str]) -> dict[str, list[str]]:
    """The languages of each family."""
    groups: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        groups.setdefault(FAMILY.get(code, code), []).append(code)
    return groups


def machines(x: np.ndarray, langs: list[str]) -> dict[tuple[str, str], np.ndarray]:
    """Weights of each family (with an empty second name) against the others, and of each pair of a family's languages."""
    groups, of, found = grouped(langs), np.array(langs, object), {}
    if len(groups) > 1:
        family = np.array([FAMILY.get(c, c) for c in langs], object)
        found |= {(name, ""): machine(x, np.where(family == name, 1.0, -1.0)) for name in groups}
    for codes in groups.values():
        for i, a in enumerate(codes):
            for b in codes[i + 1 :]:
                rows = (of == a) | (of == b)
                found[a, b] = machine(x[rows], np.where(of[rows] == a, 1.0, -1.0))
    return found


def model_of(langs: Iterable[str], weights: dict[tuple[str, str], np.ndarray]) -> Model:
    groups = grouped(langs)
    model, none = Model(sorted(groups), groups), np.zeros(BUCKETS + 1)
    if len(groups) > 1:
        model.family_weights = np.stack([weights.get((name, ""), none) for name in model.families])
    for codes in groups.values():
        model.pair_weights |= {(a, b): weights.get((a, b), none) for i, a in enumerate(codes) for b in codes[i + 1 :]}
    return model


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SHARD) -> Model:
    """A model from all labelled documents that are not held out, copies aside.

    Texts fall into shards of about `sample` by their hash, those of rarer languages into several,
    so that every shard knows every language. A task learns the machines of one shard after the
    other; their mean is the model. What is learned depends neither on the order of the rows nor on
    their partitions, and the driver sees the mean alone. Of more than MOST_LANGUAGES labels the
    commonest are learned.
    """
    labelled = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("text").alias("place"))
    found = labelled.select("lang", "place").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    common = {r["lang"]: r["n"] for r in found.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not common:
        return Model()
    shards = -(-sum(common.values()) // sample)
    least = max(8, sample // (4 * len(common)))  # texts of a language in a shard
    times = docs.sparkSession.createDataFrame([(lang, min(shards, -(-shards * least // n))) for lang, n in common.items()], "lang string, times int")

    def first_copies(batches):
        seen = set()
        for batch in slices(batches):
            new = [key not in seen and not seen.add(key) for key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch.filter(pa.array(new, pa.bool_()))

    placed = labelled.mapInArrow(first_copies, labelled.schema).join(F.broadcast(times), "lang")  # fewer copies reach a task
    spread = placed.select("lang", "text", "place", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("turn"))
    sharded = spread.select(F.pmod(F.col("place") + F.col("turn"), F.lit(shards)).cast("int").alias("shard"), "lang", "place", "text")
    ordered = sharded.repartition(min(shards, 1000), "shard").sortWithinPartitions("shard", "lang", "place")

    def sums(batches):
        """The sum of the machines of a task's shards, and its languages: first, a, b, n, weights."""
        total, langs, first, held, last = {}, set(), None, [], None

        def add():
            for names, w in machines(np.stack([v for _, v in held]), [lang for lang, _ in held]).items() if held else ():
                n, sum_ = total.get(names, (0, 0.0))
                total[names] = n + 1, sum_ + w
            held.clear()

        for batch in slices(batches):
            for shard, lang, place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is not None and shard != last[0]:
                    add()
                if (shard, lang, place) != last and (v := features(text)) is not None:
                    held.append((lang, v))
                    langs.add(lang)
                first, last = shard if first is None else first, (shard, lang, place)
        add()
        for (a, b), (n, w) in [*total.items(), *(((lang, None), (0, np.zeros(0))) for lang in sorted(langs))]:
            yield pa.RecordBatch.from_pylist([{"first": first, "a": a, "b": b, "n": n, "weights": w.tobytes()}], schema=_SUMS)

    def totals(batches):
        """The rows of each pair of names, which come in order, as one; of a language, its first."""
        names, n, total = None, 0, 0.0
        row = lambda: pa.RecordBatch.from_pylist([{"first": 0, "a": names[0], "b": names[1], "n": n, "weights": (total / max(n, 1)).tobytes()}], schema=_SUMS)
        for batch in batches:
            for r in batch.to_pylist():
                if names is not None and names != (r["a"], r["b"]):
                    yield row()
                    n, total = 0, 0.0
                names, n, total = (r["a"], r["b"]), n + r["n"], total + np.frombuffer(r["weights"])
        if names is not None:
            yield row()

    ddl = "first int, a string, b string, n int, weights binary"
    rows = ordered.mapInArrow(sums, ddl).repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(totals, ddl).collect()
    return model_of((r["a"] for r in rows if r["b"] is None), {(r["a"], r["b"]): np.frombuffer(r["weights"]) for r in rows if r["b"] is not None})


_SUMS = pa.schema([("first", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int32()), ("weights", pa.binary())])


def held_out(doc_id):
    """True for documents that are never learned from: crc32 of doc_id as text divides by 5, or no doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def classify(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text; `und` and 0 where it has no letter or nothing was learned."""
    out: list[tuple[str, float]] = []
    for start in range(0, len(texts), 1024):
        some = [features(t) for t in texts[start : start + 1024]]
        rows = [k for k, v in enumerate(some) if v is not None and model.families]
        found = [(UNDETERMINED, 0.0)] * len(some)
        if rows:
            for k, name, score in zip(rows, *model.predict(np.stack([some[k] for k in rows])), strict=True):
                found[k] = (name, float(score))
        out += found
    return out


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, from the whole text alone.

    `und` with score 0 where the text is null or has no letter, or nothing was learned.
    Repeated rows each get a row; an empty table gives none; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return per_texts(id_text(docs, id_col, text_col), lambda: lambda texts: classify(model, texts), schema, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from docs and predicts every row of docs."""
    found = predict(docs, learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col=id_col, text_col=text_col)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.2) -> DataFrame:
    """The rows of docs whose language is determined with a score of at least `least`; a null language becomes the predicted one.

    Null and empty texts and those without letters go; all other columns are as they are. Columns may have
    any names; repeated rows are kept or go alike; an empty table stays empty.
    """
    model, at, label = learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        for part in slices(batches):
            found = classify(model, part.column(at).to_pylist())
            good = pa.array([name != UNDETERMINED and score >= least for name, score in found], pa.bool_())
            if pa.types.is_string(part.schema.field(label).type):
                part = part.set_column(label, part.schema.field(label), pc.coalesce(part.column(label), pa.array([name for name, _ in found], pa.string())))
            yield part.filter(good)

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
