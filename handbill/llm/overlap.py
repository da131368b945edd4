"""Word-shingle sets of texts: their sketches for finding near copies, and their exact Jaccard similarity.

The shingles of a text are put in one order for all texts: those that are not common among
all texts first, by hash, then the common ones by their counts. Two sets of a similarity of at least
s = num/den share one of each one's first n - ceil(s * n) + 1 shingles, its prefix; at the
first that they share both must have enough left to reach the overlap that s asks for. A set
at least half of whose shingles are uncommon sends only the first SKETCH of its prefix: in
the uncommon halves two such sets are alike by half or more, so that in random order they
share none of SKETCH with a chance of 2**-SKETCH at most. The counts settle only the order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, row_key, slices

SEED = 42
WORDS, ALIKE, SKETCH = 5, Fraction(4, 5), 32
#: Of so many documents two or more share a common shingle; common shingles remembered; shingles that are counted together.
OF, COMMON, BLOCK = 4_000, 1 << 17, 1 << 21


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes (int64) of a text's word shingles; none without words.

    A-Z is lower-cased; words are divided by ASCII white space. A text of fewer words is one shingle.
    """
    held = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not held:
        return np.zeros(0, np.int64)
    digest, many = xxhash.xxh64_intdigest, max(1, len(held) - words + 1)
    hashes = np.fromiter((digest(w, SEED) for w in held), np.uint64, len(held))
    mixed = np.full(many, min(len(held), words), np.uint64)
    for k in range(min(len(held), words)):
        mixed = (mixed ^ hashes[k : k + many]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((mixed ^ mixed >> np.uint64(32)).view(np.int64))


def set_fingerprint(held: np.ndarray) -> int:
    """SimHash of a set of hashes: a bit is 1 if it is set in more than half of them; signed 64 bits."""
    if not len(held):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(held), 1 << 14):
        part = np.ascontiguousarray(held[start : start + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(held), bitorder="little").view(np.int64)[0])


def _common(docs: DataFrame, words: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and counts, over all documents, of those that two of OF documents share, or more; at most COMMON, the most frequent.

    A shingle of more documents than there are blocks is twice in one of them, so that those that
    are twice in some block are all that can be common; they are then counted in all documents.
    """
    texts = docs.select("text")

    def found(keys: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(met, pa.int64())], names=["key", "met"])

    def twice(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows() -> Iterator[pa.RecordBatch]:
            keys, met = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield found(keys[met > 1], met[met > 1])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([1], pa.int64())], names=["key", "met"])  # a block

        for part in slices(batches, 1 << 20):
            held += (shingle_set(t, words) for t in part.column(0).to_pylist())
            if sum(map(len, held)) >= block:
                yield from rows()
        if held:
            yield from rows()

    ddl = "key long, met long"
    sums = texts.mapInArrow(twice, ddl).groupBy("key").agg(F.sum("met").alias("met"), F.count(F.lit(1)).alias("blocks"))
    sums = checkpointed(sums)
    blocks = sums.filter("key is null").agg(F.sum("met")).first()[0] or 0
    least = max(2, 2 * (docs.count() // OF), blocks + 1 if blocks > 1 else 0)
    # In a block that does not name it a shingle is once at most.
    able = sums.filter(F.col("key").isNotNull() & (F.col("met") + blocks - F.col("blocks") >= least))
    some = np.array(sorted(r.key for r in able.orderBy(F.desc("met"), "key").limit(4 * COMMON).collect()), np.int64)
    if not len(some):
        return some, some
    wanted = docs.sparkSession.sparkContext.broadcast(some)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = wanted.value, np.zeros(len(wanted.value), np.int64)
        for part in slices(batches, 1 << 20):
            for text in part.column(0).to_pylist():
                held = shingle_set(text, words)
                at = np.minimum(np.searchsorted(known, held), len(known) - 1)
                total[at[known[at] == held]] += 1
        yield found(known[total > 0], total[total > 0])

    met = texts.mapInArrow(counted, ddl).groupBy("key").agg(F.sum("met").alias("met")).filter(F.col("met") >= least)
    rows = met.orderBy(F.desc("met"), "key").limit(COMMON).collect()
    rows.sort()
    return np.array([r.key for r in rows], np.int64), np.array([r.met for r in rows], np.int64)


_SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])


def described(docs: DataFrame, words: int, alike: Fraction) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, text_hash, id (a hash of the shingle set), n (its size), fp and keys (its sketch, in order)."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, words))

    def of(text: str | None) -> tuple:
        held = shingle_set(text, words)
        known, counts = common.value
        met = np.zeros(len(held), np.int64)
        if len(known) and len(held):
            at = np.minimum(np.searchsorted(known, held), len(known) - 1)
            met = np.where(known[at] == held, counts[at], 0)
        n = len(held)
        prefix = n + (-alike.numerator * n) // alike.denominator + 1 if n else 0
        if 2 * np.count_nonzero(met == 0) >= n:
            prefix = min(prefix, SKETCH)
        first = held[np.lexsort((held, met))[:prefix]]
        text_hash = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), SEED)
        return text_hash, xxhash.xxh64_intdigest(held.tobytes(), SEED), n, set_fingerprint(held), first

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, ids, sizes, prints, firsts = zip(*map(of, part.column(1).to_pylist()), strict=True) if part.num_rows else ((), (), (), (), ())
            signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), signed(hashes), signed(ids), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(list(firsts), pa.list_(pa.int64()))], schema=_SETS)

    return docs.mapInArrow(run, "doc_id long, text_hash long, id long, n long, fp long, keys array<long>")


def told_apart(described: DataFrame) -> DataFrame:
    """described, with other ids where sets of one id differ in size or fingerprint: two sets are then one only if 160 bits agree."""
    kinds = F.struct("n", "fp")
    met = described.groupBy("id").agg(F.min(kinds).alias("low"), F.max(kinds).alias("high")).filter("low <> high").select(F.col("id").alias("met"))
    if met.isEmpty():
        return described
    other = F.when(F.col("met").isNull(), F.col("id")).otherwise(F.xxhash64("id", "n", "fp")).alias("id")
    return described.join(met, F.col("id") == F.col("met"), "left").select(*(other if c == "id" else F.col(c) for c in described.columns))


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id and held, the shingles, of the documents named by wanted (id, doc_id and text_hash; an id once)."""
    key = fresh(docs, "row")
    named = wanted.select("id", row_key(F.col("doc_id"), F.col("text_hash")).alias(key))
    keyed = docs.select(row_key(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))).alias(key), "text").join(named, key).dropDuplicates([key]).select("id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "held"])

    return keyed.mapInArrow(run, "id long, held array<long>")


def alike_pairs(pairs: DataFrame, sets: DataFrame, alike: Fraction) -> DataFrame:
    """The pairs a, b whose sets are alike, by the whole sets."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("held").alias("of_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("held").alias("of_a")), "a").select("a", "b", "of_a", "of_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = np.zeros(part.num_rows, bool)
            ends, values = zip(*((c.offsets.to_numpy(), c.values.to_numpy()) for c in (part.column(2), part.column(3))), strict=True)
            for k in range(part.num_rows):
                x, y = (v[e[k] : e[k + 1]] for e, v in zip(ends, values, strict=True))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = shared * alike.denominator >= alike.numerator * (len(x) + len(y) - shared)
            yield part.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def reach(r_a: Column, n_a: Column, r_b: Column, n_b: Column, alike: Fraction) -> Column:
    """Whether sets of n shingles, r of them from a shared one onwards, can be alike."""
    num, den = alike.numerator, alike.denominator
    return (F.least(r_a, r_b) * (num + den) >= (n_a + n_b) * num) & (F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num)
