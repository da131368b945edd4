"""Packing token ids into rows of fixed length by best-fit decreasing.

Documents are dealt to shards by a hash; a shard holds a bounded number of tokens, so one
task packs it in memory. A document longer than a row is split into full rows and a rest,
losing nothing. Within a shard the segments go, longest first, each to the row with the
least room that still fits it. A segment tree over the possible rooms finds that row: its
leaves count the rows with each room, and a descent finds the first leaf from the needed
room on that has any.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Tokens that a shard has on average.
SHARD_TOKENS = 2 << 20


class Rooms:
    """Open rows by the room they have left, 0 to capacity."""

    def __init__(self, capacity: int) -> None:
        self._leaves = 1 << capacity.bit_length()
        self._counts = [0] * (2 * self._leaves)
        self._rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self._rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        at = room + self._leaves
        while at:
            self._counts[at] += n
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and number of the row with the least room of at least need, the latest put of those."""
        at = need + self._leaves
        if not self._counts[at]:
            while at > 1 and (at & 1 or not self._counts[at + 1]):  # up to the first subtree on the right with rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self._leaves:
                at = 2 * at if self._counts[2 * at] else 2 * at + 1
        room = at - self._leaves
        self._add(room, -1)
        return room, self._rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of segment numbers; equal lengths go in the order given. No length may exceed capacity."""
    rooms, rows = Rooms(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if (found := rooms.take(lengths[k])) is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(k)
        rooms.put(room - lengths[k], row)
    return rows


PACKED_DDL = "shard long, row long, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, resets array<int>, ids binary, position_ids binary, n_tokens int, pad int"
_PACKED = pa.schema(
    [("shard", pa.int64()), ("row", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32()))]
    + [("ids", pa.binary()), ("position_ids", pa.binary()), ("n_tokens", pa.int32()), ("pad", pa.int32())]
)


def pack_shard(shard: int, docs: Iterable[tuple[int | None, np.ndarray]], capacity: int, pad_id: int, positioned: bool = True) -> list[tuple]:
    """Packed rows of one shard's documents, which are put in order first."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, len(d[1])))
    if len({(d, len(ids)) for d, ids in docs}) < len(docs):  # repeated documents go by their ids
        docs.sort(key=lambda d: (d[0] is None, d[0] or 0, len(d[1]), d[1].tobytes()))
    segments = [(n, part, ids[start : start + capacity]) for n, (_, ids) in enumerate(docs) for part, start in enumerate(range(0, len(ids), capacity))]
    out = []
    for row, members in enumerate(best_fit_decreasing([len(s[2]) for s in segments], capacity)):
        cuts = np.concatenate(([0], np.cumsum([len(segments[k][2]) for k in members])))
        used = int(cuts[-1])
        ids = np.full(capacity, pad_id, np.uint32)
        ids[:used] = np.concatenate([segments[k][2] for k in members])
        positions = None
        if positioned:
            positions = np.zeros(capacity, np.uint32)
            positions[:used] = np.arange(used) - np.repeat(cuts[:-1], np.diff(cuts))
            positions = positions.astype("<u4").tobytes()
        of = [docs[segments[k][0]][0] for k in members]
        out.append((shard, row, of, [segments[k][1] for k in members], cuts.tolist(), cuts[:-1].tolist(), ids.astype("<u4").tobytes(), positions, used, capacity - used))
    return out


def pack(encoded: DataFrame, *, capacity: int = 2048, pad_id: int = 0, end_id: int | None = None, shard_tokens: int = SHARD_TOKENS, about_tokens: int | None = None, positioned: bool = True, replayed: bool = False) -> DataFrame:
    """Packed rows of a table of doc_id and ids (binary, little-endian unsigned 32-bit).

    A row has its ids padded to capacity, cu_seqlens (where its segments begin and the last
    ends), resets (where positions start again at 0), position_ids that do so (null unless
    positioned, as the resets say the same in less room), and for each segment the doc_id and the number of its part. end_id, if given, is put after every document.
    Documents without ids (null or empty) are in no row unless end_id is given. Repeated rows
    and rows with a null doc_id pack like any other; a document longer than a shard's share
    makes its shard larger, never incomplete.
    about_tokens spares a pass over the ids that would count them for the number of shards.
    An empty table gives no rows; other columns are ignored whatever their names.

    Shards are dealt by a hash of doc_id, ids and the row's place in its partition, so that
    rows repeated any number of times spread. A repeated task must see its rows in the order
    in which it saw them before, or some would be packed twice and others never: encoded is
    therefore written to the shared folder first, unless replayed says that its tasks read
    files row by row, without a shuffle. One task holds one shard.
    """
    encoded = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    if not replayed:
        encoded = written(encoded, "encoded")
    if about_tokens is None:
        about_tokens = encoded.agg(F.sum(F.octet_length("ids") / 4)).first()[0] or 0
    shards = max(1, math.ceil(about_tokens / shard_tokens))
    place = F.monotonically_increasing_id()
    placed = encoded.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.octet_length("ids"), place), F.lit(shards)).cast("int")).repartitionById(shards, "shard")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for doc_id, ids, shard in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "shard")), strict=True):
                ids = np.frombuffer(ids, "<u4")
                held.setdefault(shard, []).append((doc_id, ids if end_id is None else np.append(ids, np.uint32(end_id))))
        for shard in sorted(held):
            rows = pack_shard(shard, held.pop(shard), capacity, pad_id, positioned)
            for start in range(0, len(rows), 256):
                columns = zip(*rows[start : start + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)

    return placed.mapInArrow(run, PACKED_DDL)
