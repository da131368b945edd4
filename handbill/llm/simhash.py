"""SimHash fingerprints and near-duplicate components by the pigeonring principle.

A 64-bit fingerprint is cut into a ring of segments. If two fingerprints differ in at most
T bits in all, then from some segment of the ring onwards every chain of l consecutive
segments differs in at most l * T / segments bits.

At 2 bits and five segments the first two segments of such a chain allow no difference and
the next two allow one between them, so one of those is equal too: three equal segments, 38
bits, are the key of the candidate join. The longer chains are checked on each candidate
before the full Hamming distance. Equal fingerprints are joined first, so copies cost nothing
further. A key shared by more fingerprints than `pair_limit` is not paired; there each
fingerprint is sent to the points within half the threshold, and those that meet at a point
are linked to the point's smallest one: the same links' components, with rows in proportion
to the fingerprints.

Documents alike by .8 in their word shingles differ in about 10 of 64 bits and in up to 26,
where no equal segments are left to join on. drop_similar() therefore takes its candidates
from shared shingles (`overlap`), and the ring of eight segments and the Hamming distance
prune them before whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import overlap
from .common import checkpointed, id_text, one_row_each, row_key, slices, written

BITS, SEED = 64, 42


def text_fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """SimHash over word shingles, repeats included; 0 without words.

    A-Z is lower-cased; words are divided by ASCII white space. A bit is 1 if it is set in
    more than half of the shingles' XXH64 values. Texts of fewer words are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, joined, form = xxhash.xxh64_intdigest, b" ".join, zip(*(words[k:] for k in range(words_per_shingle)), strict=False)
    hashes = np.fromiter((digest(joined(s), SEED) for s in form), np.uint64, len(words) - words_per_shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


_PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_hash", pa.int64())])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash (xxhash64 of the text) for every row.

    A null text counts as empty.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            found = np.array([text_fingerprint(t, words_per_shingle) for t in texts], np.uint64)
            hashes = np.array([xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), SEED) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64)), pa.array(hashes.view(np.int64))], schema=_PRINT)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long, text_hash long")


def ring(segments: int) -> list[int]:
    """Bit masks of the ring's segments, as even as 64 bits allow."""
    cuts = [BITS * k // segments for k in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _long(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")


def _keys(segments: int, most_bits: int) -> list[tuple[int, int]]:
    """First segment and bit mask of each key: the segments from it on that allow no bit, and one of those that allow one bit among them."""
    masks = ring(segments)
    allowed = lambda n: n * most_bits // segments
    free = max(n for n in range(segments) if allowed(n) == 0)
    one = max(n for n in range(free, segments) if allowed(n) <= 1)
    found = []
    for start in range(segments):
        base = sum(masks[(start + j) % segments] for j in range(free))
        found += [(start, base | masks[(start + j) % segments]) for j in range(free, one)] if one > free + 1 else [(start, base)]
    return found


def _chain(a: Column, b: Column, start: int, segments: int, most_bits: int) -> Column:
    """Whether every chain from a segment on stays within its share of the bits."""
    masks, differ, held = ring(segments), a.bitwiseXOR(b), F.lit(True)
    for n in range(1, segments + 1):
        mask = sum(masks[(start + j) % segments] for j in range(n))
        held &= F.bit_count(differ.bitwiseAND(_long(mask))) <= n * most_bits // segments
    return held


def on_ring(a: Column, b: Column, most_bits: int, segments: int) -> Column:
    """Whether fingerprints differ in at most most_bits: first whether some start has its chains within their budgets, then the distance."""
    some = _chain(a, b, 0, segments, most_bits)
    for start in range(1, segments):
        some |= _chain(a, b, start, segments, most_bits)
    return some & (F.bit_count(a.bitwiseXOR(b)) <= most_bits)


def links(prints: DataFrame, *, most_bits: int = 2, segments: int = 5, pair_limit: int = 64) -> DataFrame:
    """Edges a < b over distinct fingerprints whose components are those of all pairs within most_bits.

    prints has one row for each distinct fp. No link is lost: see the module's text.
    """
    if most_bits != 2:
        raise ValueError("keys shared by many are resolved by midpoints, which fit a threshold of 2 bits")
    runs = _keys(segments, most_bits)
    keyed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(_long(m)) for _, m in runs))).alias("run", "key"))
    met = keyed.groupBy("run", "key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    shared = checkpointed(keyed.join(met, ["run", "key"]))

    few = shared.filter(F.col("met") <= pair_limit).select("run", "key", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["run", "key"]).filter("a < b")
    passes = F.coalesce(*(F.when(F.col("run") == k, _chain(F.col("a"), F.col("b"), start, segments, most_bits)) for k, (start, _) in enumerate(runs)))
    linked = pairs.filter(passes).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits).select("a", "b")

    flips = F.array(F.lit(0).cast("long"), *(_long(1 << k) for k in range(BITS)))
    outside = F.element_at(F.array(*(_long(((1 << BITS) - 1) ^ m) for _, m in runs)), F.col("run") + 1)
    near = (
        shared.filter(F.col("met") > pair_limit)
        .withColumn("outside", outside)
        .select("run", "key", "fp", F.explode(F.filter(flips, lambda f: f.bitwiseAND(F.col("outside")) == f)).alias("flip"))
        .select("run", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    )
    least = near.groupBy("run", "point").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a < top").drop("top")
    met_at = near.join(least, ["run", "point"]).filter("a < fp").select("a", F.col("fp").alias("b"))
    return linked.unionByName(met_at)


def _joined(edges: DataFrame) -> DataFrame:
    """u, to: the smallest node reachable, for every node of a bounded number of edges, which one task takes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while (y := up[x]) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((top(up.setdefault(a, a)), top(up.setdefault(b, b))))
                up[high] = low
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in up], pa.int64())], names=["u", "to"])

    return edges.coalesce(1).mapInArrow(run, "u long, to long")


#: Edges that one task may hold.
FEW_EDGES = 1 << 17


def components(edges: DataFrame, *, few_edges: int = FEW_EDGES) -> DataFrame:
    """node, root: the smallest node reachable, for every node of an edge (columns a, b, long).

    Each round gives the nodes new random ranks, points every node at the lowest rank among
    itself and its neighbours, follows the pointers once more and replaces the ends of the edges by
    what they point at; edges within one node go. Whatever the graph's shape, a round leaves a
    third of the nodes or fewer on average, so that rounds grow with the logarithm of the edges. Up to few_edges, a number
    that is counted, one task joins the rest. The rounds' pointers, each table a fraction of the
    one before, are put together last. Groups are reduced to minima before a shuffle, never
    gathered, and the tables of a round are written to the shared folder.
    """
    held = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while held.count() > few_edges:
        rank = lambda end: F.struct(F.xxhash64(end, F.lit(len(rounds))).alias("rank"), F.col(end).alias("node"))  # noqa: E731, B023
        lowest = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("u"), F.least("m", rank("a"))["node"].alias("m"))
        far = written(lowest.join(lowest.select(F.col("u").alias("m"), F.col("m").alias("to")), "m").select("u", "to"), "pointers")
        of = lambda end: far.select(F.col("u").alias(end), F.col("to").alias(f"to_{end}"))  # noqa: E731, B023
        moved = held.join(of("a"), "a").join(of("b"), "b").filter("to_a <> to_b")
        held = written(moved.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct(), "edges")
        rounds.append(far)
    found = _joined(held)
    for far in reversed(rounds):
        last = found.select(F.col("u").alias("to"), F.col("to").alias("last"))
        found = far.join(last, "to", "left").select("u", F.coalesce("last", "to").alias("to"))
    found = written(found, "roots")
    if rounds:  # the lowest rank stood for a component; its smallest node does now
        least = found.groupBy("to").agg(F.min("u").alias("root"))
        return written(found.join(least, "to").select(F.col("u").alias("node"), "root"), "roots")
    return found.select(F.col("u").alias("node"), F.col("to").alias("root"))


def rooted(prints: DataFrame, *, most_bits: int = 2, segments: int = 5, pair_limit: int = 64) -> DataFrame:
    """fp and root for every distinct fp of prints: the smallest fingerprint of its component."""
    distinct = checkpointed(prints.select("fp").distinct())
    roots = components(links(distinct, most_bits=most_bits, segments=segments, pair_limit=pair_limit))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, most_bits: int = 2, segments: int = 5, pair_limit: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Documents link when their fingerprints differ in at most most_bits; component_id is the
    smallest doc_id reachable (null only where no member has one). Null and wordless texts
    have fingerprint zero and link like any other. Repeated rows each get a row; an empty
    table gives none.
    """
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, words_per_shingle=words_per_shingle), "simhash").select("doc_id", "fp")
    placed = checkpointed(rooted(prints, most_bits=most_bits, segments=segments, pair_limit=pair_limit))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(placed, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group, the one with the smallest doc_id.

    All of docs' columns stay. A null doc_id is larger than any other; of documents with the
    same doc_id in a group, one stays.
    """
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = prints.groupBy("fp").agg(first).join(rooted(prints), "fp").groupBy("root").agg(F.min("first").alias("first"))
    content = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return one_row_each(docs, kept.select(row_key(F.col("first.doc_id"), F.col("first.text_hash"))), row_key(F.col(id_col).cast("long"), content))


#: Most bits by which fingerprints of alike documents may differ, of 64, and the ring's segments there.
ALIKE_BITS, ALIKE_SEGMENTS = 26, 8
#: Sets of a crowded shingle that meet its hubs in one task.
SALTED = 4096


def similar_roots(docs: DataFrame, described: DataFrame, *, words: int = overlap.WORDS, alike: Fraction = overlap.ALIKE, pair_limit: int = 64, pivots: int = 4) -> DataFrame:
    """node, root: the smallest id reachable by links, for each id of `described` that has a link.

    Candidates are pairs of one shared shingle of their sketches whose sizes and places allow
    a link and whose fingerprints pass the ring. A shingle in more than pair_limit sketches
    is not paired at once: `pivots` of its sets that it stands first in, which have the least of
    their own and so the most links, meet all of them; in the next round eight times as many of
    those not in its largest component, whatever their place. A set that has met all others is done; a
    shingle is done when all sets that are left lie in one component, as of any two in
    different ones at least one is outside the largest, or when none of them stands early enough to be a pair's smaller.
    Candidates are verified by whole sets in the same rounds: first each one's four nearest
    and smallest, then 64 times as many of those not connected yet, until none is left.
    """
    side = ["id", "n", "r", "fp"]
    keyed = described.select("id", "n", "fp", F.posexplode("keys").alias("at", "key")).select("key", "id", "n", (F.col("n") - F.col("at")).alias("r"), "fp")
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    shared = written(keyed.join(often, "key").dropDuplicates(["key", "id"]), "overlap-shared")
    met = shared.groupBy("key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    shared = written(shared.drop("met").join(met, "key"), "overlap-shared")
    lead = F.col("r") * (alike.numerator + alike.denominator) >= F.col("n") * 2 * alike.numerator  # places where a set can be its pair's smaller

    fits = overlap.reach(F.col("r_x"), F.col("n_x"), F.col("r_y"), F.col("n_y"), alike) & on_ring(F.col("fp_x"), F.col("fp_y"), ALIKE_BITS, ALIKE_SEGMENTS)
    ordered = F.col("id_x").alias("a"), F.col("id_y").alias("b"), F.bit_count(F.col("fp_x").bitwiseXOR(F.col("fp_y"))).alias("bits")
    named = lambda df, which, more=(): df.select("key", *(F.col(c).alias(f"{c}_{which}") for c in (*side, *more)))
    few = shared.filter(F.col("met") <= pair_limit)
    left = written(named(few.filter(lead), "x").join(named(few, "y"), "key").filter((F.struct("n_x", "id_x") < F.struct("n_y", "id_y")) & fits).select(*ordered).distinct(), "overlap-pairs")
    hot = shared.filter(F.col("met") > pair_limit).select("key", *side, "met")

    ids = left.select(F.explode(F.array("a", "b")).alias("id")).unionByName(hot.select("id")).distinct()
    wanted = described.select("id", "doc_id", "text_hash").join(ids, "id").groupBy("id").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    sets = written(overlap.sets_of(docs, wanted.select("id", "one.*"), words), "overlap-sets")

    roots, most, first = left.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0), 4, True
    salts = (1 + F.floor(F.col("met") / SALTED)).cast("int")  # a key's hubs once for each share of its sets
    crowded = not hot.isEmpty()
    while True:
        if crowded:
            placed = hot.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
            rest = placed
            if not first:  # left are keys whose sets lie in several components, one of them a pair's smaller, and sets that have not met all others
                sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.max(lead).alias("leads"))
                apart = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.max("leads").alias("leads")).filter("roots > 1 and leads").select("key", "top")
                placed = written(placed.join(apart, "key"), "overlap-hot")
                rest = placed.filter("root <> top")
            hubs = Window.partitionBy("key").orderBy(~lead, F.col("n") - F.col("r"), "id")
            chosen = written(rest.withColumn("place", F.row_number().over(hubs)).filter(F.col("place") <= pivots).select("key", *side, "met", "root"), "overlap-hubs")
            crowded, first = not chosen.isEmpty(), False
        if crowded:
            row = ["key", *side, "met", "root"]  # a row and its mark are drawn together by all their columns: no join, and a group of two rows at most
            marked = placed.select(*row, F.lit(False).alias("hub")).unionByName(chosen.select(*row, F.lit(True).alias("hub"))).groupBy(*row).agg(F.max("hub").alias("hub"))
            x = named(chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), "x", ("root", "salt")).withColumnRenamed("salt_x", "salt")
            y = named(marked.withColumn("salt", F.pmod(F.hash("id"), salts)), "y", ("root", "salt", "hub")).withColumnRenamed("salt_y", "salt")
            once = ~F.col("hub_y") | (F.col("id_x") < F.col("id_y"))  # two hubs meet once
            left = left.unionByName(x.join(y, ["key", "salt"]).filter((F.col("root_x") != F.col("root_y")) & once & fits).select(*ordered)).distinct()
            hot = marked.filter("not hub").select("key", *side, "met")
        elif left.isEmpty():
            return roots
        near, low = (F.row_number().over(Window.partitionBy("b").orderBy(*by)) for by in (("bits", "a"), ("a",)))
        ranked = written(left.withColumn("turn", F.least(near, low)), "overlap-ranked")
        alike_now = overlap.alike_pairs(ranked.filter(F.col("turn") <= most).select("a", "b"), sets, alike)
        roots = components(alike_now.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        left, most, pivots = written(_apart(ranked.filter(F.col("turn") > most).drop("turn"), roots), "overlap-pairs"), most * 64, pivots * 8


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not connected yet."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(~F.col("root_a").eqNullSafe(F.col("root_b")) | F.col("root_a").isNull()).select(*pairs.columns)


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = overlap.WORDS, alike: Fraction = overlap.ALIKE, pair_limit: int = 64, pivots: int = 4) -> DataFrame:
    """docs with one document of each group of near copies, the one with the smallest doc_id.

    Documents link when the Jaccard similarity of their word shingles is at least alike and
    the fingerprints of those sets differ in at most ALIKE_BITS of 64; null and wordless
    texts link with each other. All of docs' columns stay. A null doc_id is larger than any
    other; of documents with the same doc_id in a group, one stays. An empty table stays empty.
    """
    plain = id_text(docs, id_col, text_col)
    described = overlap.told_apart(written(overlap.described(plain, words, alike), "overlap"))
    roots = similar_roots(plain, described, words=words, alike=alike, pair_limit=pair_limit, pivots=pivots)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    least = described.groupBy("id").agg(first)
    kept = least.join(roots, least["id"] == roots["node"], "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    content = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return one_row_each(docs, kept.select(row_key(F.col("first.doc_id"), F.col("first.text_hash"))), row_key(F.col(id_col).cast("long"), content))
