"""Product codes of vectors: Lloyd's rounds over cover trees.

Each task cuts its vectors into blocks and builds for each block and part position a cover
tree of the distinct parts: a node's children lie within half its reach of their own centre
and further than that from each other, and the first shares the node's centre. The points
below a node stand next to each other, so that a cumulative sum over them gives any node's
sum and count. The trees are written once and read in every round.

A round takes each tree from its root down. With the distances from a node's centre to the
entries still in question and the node's radius, the triangle inequality tells which entries
can be nearest to a point below it: those at most twice the radius farther than the nearest.
If one is left, all that is below goes to it at once, by its sum; otherwise the children are
asked, and the points of a leaf are compared exactly. All values are integers, and the inequality
has some slack, so ties still go to the smaller index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Vectors of a block, distinct points of a leaf at most, and the largest size of an integer component.
BLOCK, LEAF, LARGEST = 4096, 16, 1 << 24
#: Fields of a node: point at its centre, range of its points, its children, squared radius.
CENTRE, BEGIN, END, CHILD, CHILDREN, RADIUS = range(6)


def integers(vectors: DataFrame, *, id_col: str, vector_col: str, scale: int, more: tuple[str, ...] = ()) -> DataFrame:
    """id (long) and v (floor(scale * x) of each component, array of long) of the rows whose vector is whole, with the columns of `more`.

    Rows whose vector is null or holds null, NaN or infinity go. Integers beyond LARGEST in size count as that.
    """
    whole = vectors.filter(F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    bound = lambda x: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * scale))
    return whole.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(bound(x))).alias("v"), *more)


@dataclass
class Tree:
    """points in the tree's order with their counts, nodes, and the place of each row among the points."""

    points: np.ndarray
    counts: np.ndarray
    nodes: np.ndarray
    places: np.ndarray

    def to_bytes(self) -> bytes:
        shape = np.array([*self.points.shape, len(self.nodes), len(self.places)], np.int64)
        return b"".join(a.tobytes() for a in (shape, self.nodes, self.points.astype(np.int32), self.counts.astype(np.int32), self.places.astype(np.int32)))

    @classmethod
    def from_bytes(cls, stored: bytes) -> Tree:
        n, width, nodes, rows = np.frombuffer(stored, np.int64, 4).tolist()
        at = 32 + 48 * nodes
        ints = np.frombuffer(stored, np.int32, offset=at).astype(np.int64)
        points, counts, places = np.split(ints, [n * width, n * width + n])
        assert len(places) == rows
        return cls(points.reshape(n, width), counts, np.frombuffer(stored, np.int64, 6 * nodes, offset=32).reshape(nodes, 6), places)


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x centres."""
    found = np.zeros((len(points), len(centres)), np.int64)
    for x, c in zip(points.T, centres.T, strict=True):
        apart = x[:, None] - c
        found += apart * apart
    return found


def cover_tree(rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of the rows of an integer matrix."""
    points, places, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    order, nodes = np.arange(len(points)), []
    waiting = [(0, 0, len(points))]  # the point at the centre, and the range of places in `order`
    for centre, begin, end in waiting:
        held = order[begin:end]
        apart = ((points[held] - points[centre]) ** 2).sum(1)
        radius = int(apart.max())
        node = [centre, begin, end, 0, 0, radius]
        if end - begin > leaf:
            node[CHILD], at, next_centre = len(waiting), begin, centre
            while len(held):
                near = 4 * apart <= radius
                mine, held = held[near], held[~near]
                order[at : at + len(mine)] = mine
                waiting.append((next_centre, at, at + len(mine)))
                at += len(mine)
                if len(held):
                    next_centre = int(held[0])
                    apart = ((points[held] - points[next_centre]) ** 2).sum(1)
            node[CHILDREN] = len(waiting) - node[CHILD]
        nodes.append(node)
    found, place_of = np.array(nodes, np.int64), np.empty_like(order)
    place_of[order] = np.arange(len(order))
    found[:, CENTRE] = place_of[found[:, CENTRE]]
    return Tree(points[order], counts[order], found, place_of[places.reshape(-1)])


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def assign(tree: Tree, entries: np.ndarray, give: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> int:
    """Calls give(begins, ends, nearest entries) with ranges of points until each point had its turn; returns how many points it compared one by one."""
    asked, open_to, compared = np.zeros(1, np.int64), np.ones((1, len(entries)), bool), 0
    while len(asked):
        node = tree.nodes[asked]
        far = np.where(open_to, _squared(tree.points[node[:, CENTRE]], entries), np.iinfo(np.int64).max)
        nearest, apart = far.argmin(1), np.sqrt(far.astype(float))
        reach = apart.min(1) + 2 * np.sqrt(node[:, RADIUS].astype(float))
        open_to = open_to & (apart <= (reach * (1 + 1e-9) + 1e-6)[:, None])
        sure = open_to.sum(1) == 1
        give(node[sure, BEGIN], node[sure, END], nearest[sure])
        leaf = ~sure & (node[:, CHILDREN] == 0)
        sizes = node[leaf, END] - node[leaf, BEGIN]
        single = _spread(node[leaf, BEGIN], sizes)
        if len(single):
            compared += len(single)
            exact = np.where(np.repeat(open_to[leaf], sizes, 0), _squared(tree.points[single], entries), np.iinfo(np.int64).max)
            give(single, single + 1, exact.argmin(1))
        inner = ~sure & ~leaf
        asked = _spread(node[inner, CHILD], node[inner, CHILDREN])
        open_to = np.repeat(open_to[inner], node[inner, CHILDREN], 0)
    return compared


def sums(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """For each entry the sums of its points' components and, last, their count."""
    weighed = np.column_stack([tree.points * tree.counts[:, None], tree.counts])
    upto = np.concatenate([np.zeros((1, weighed.shape[1]), np.int64), np.cumsum(weighed, 0)])
    found = np.zeros((len(entries), weighed.shape[1]), np.int64)
    assign(tree, entries, lambda begins, ends, nearest: np.add.at(found, nearest, upto[ends] - upto[begins]))
    return found


def codes(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, and its squared distance."""
    of = np.zeros(len(tree.points), np.int64)

    def give(begins: np.ndarray, ends: np.ndarray, nearest: np.ndarray) -> None:
        of[_spread(begins, ends - begins)] = np.repeat(nearest, ends - begins)

    assign(tree, entries, give)
    return of[tree.places], ((tree.points - entries[of]) ** 2).sum(1)[tree.places]


def planted(vectors: DataFrame, width: int, parts: int) -> DataFrame:
    """A row for each block of vectors (columns id, v and label): ids, labels and the trees of its parts, written to the shared folder.

    Vectors shorter than width, a multiple of parts, count as filled up with zeros.
    """
    label = vectors.schema["label"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            listed = rows.column(1).combine_chunks()
            sizes = np.diff(listed.offsets.to_numpy())
            matrix = np.zeros((len(rows), width), np.int64)
            matrix[np.repeat(np.arange(len(rows)), sizes), _spread(np.zeros(len(rows), np.int64), sizes)] = listed.flatten().to_numpy()
            trees = [cover_tree(part).to_bytes() for part in np.split(matrix, parts, axis=1)]
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(c).combine_chunks())
            return pa.RecordBatch.from_arrays([one(0), one(2), pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK))
                held = table.slice(BLOCK).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return written(vectors.select("id", "v", "label").mapInArrow(run, f"ids array<long>, labels array<{label.simpleString()}>, trees array<binary>"), "cover-trees")


def improved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts x entries x components) after one round: floors of the means; unused entries stay.

    Each task sends the sums of all its blocks once; the driver sees one number for each component of an entry, and one for its count.
    """
    parts, entries, width = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for stored in batch.column(0).to_pylist():
                for p, tree in enumerate(stored):
                    total[p] += sums(Tree.from_bytes(tree), books[p])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.reshape(-1)[used])], names=["place", "value"])

    met = trees.select("trees").mapInArrow(run, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(parts * entries * (width + 1), np.int64)
    total[[r.place for r in met]] = [r.value for r in met]
    total = total.reshape(parts, entries, width + 1)
    count = total[..., -1:]
    return np.where(count > 0, total[..., :-1] // np.maximum(count, 1), books)


@dataclass
class Coded:
    """rows: id, label, code (parts x two hex digits) and error of every whole vector; books: the codebooks."""

    rows: DataFrame
    books: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Coded:
    """Codes of all whole vectors by codebooks that Lloyd's rounds improve.

    Each codebook starts as its part of the vectors with the smallest ids (null ids last, ties by
    components). Vectors of unequal lengths, or of one that parts do not divide, count as filled
    up with zeros. Fewer vectors than entries give as many entries. Repeated rows each get a row; an empty
    table gives none and empty codebooks. Other columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    whole = integers(vectors.withColumn("label", F.col(label_col)), id_col=id_col, vector_col=vector_col, scale=scale, more=("label",))
    longest = whole.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    first = whole.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.zeros((len(first), width), np.int64)
    for row, values in zip(start, first, strict=True):
        row[: len(values.v)] = values.v
    books = start.reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    trees = planted(whole, width, parts)
    if len(first):
        for _ in range(rounds):
            books = improved(trees, books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                named, errors = zip(*(codes(Tree.from_bytes(t), b) for t, b in zip(batch.column(2)[k].as_py(), books, strict=True)), strict=True)
                texts = [row.tobytes().hex() for row in np.column_stack(named).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, batch.column(1)[k].values, pa.array(texts), pa.array(np.sum(errors, 0))], names=["id", "label", "code", "error"])

    label = whole.schema["label"].dataType.simpleString()
    return Coded(trees.mapInArrow(run, f"id long, label {label}, code string, error long"), books)


def with_label_errors(found: Coded) -> DataFrame:
    """vec_id, code, error, label_error (the error of all rows of an equal label; nulls are one) and codebooks_sha256.

    The sums are made before they meet the rows, and the join is one that Spark can split at a frequent label.
    """
    by_label = found.rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    of = by_label.select(F.col("label").alias("of_label"), "label_error")
    return found.rows.join(of, F.col("label").eqNullSafe(F.col("of_label"))).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))


#: The same in SQL, for vectors of one length that 16 divides.
CODES_SQL = """
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS place, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, place, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS q FROM kept, range(16) AS r(p)),
book0 AS (SELECT p, place AS entry, q AS c FROM parts WHERE place < 64),
{rounds}
chosen AS (SELECT vec_id, label, parts.p, min(struct_pack(d := {distance}, e := entry)) AS best FROM parts JOIN book2 USING (p) GROUP BY vec_id, label, parts.p),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM chosen GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""
_DISTANCE = "list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::BIGINT"
_ROUND = """near{k} AS (SELECT vec_id, parts.p, any_value(q) AS q, min(struct_pack(d := {distance}, e := entry)).e AS entry FROM parts JOIN book{j} USING (p) GROUP BY vec_id, parts.p),
mean{k} AS (SELECT p, entry, list(m ORDER BY i) AS c FROM (SELECT p, entry, i, floor(sum(q[i])::DOUBLE / count(*))::BIGINT AS m FROM near{k}, range(1, 5) AS r(i) GROUP BY p, entry, i) GROUP BY p, entry),
book{k} AS (SELECT book{j}.p, book{j}.entry, coalesce(mean{k}.c, book{j}.c) AS c FROM book{j} LEFT JOIN mean{k} USING (p, entry)),"""


def codes_sql() -> str:
    """For tables of 64 components, whose vec_ids differ."""
    return CODES_SQL.format(distance=_DISTANCE, rounds="\n".join(_ROUND.format(k=k, j=k - 1, distance=_DISTANCE) for k in (1, 2)))
