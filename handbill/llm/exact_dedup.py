"""Exact deduplication by Grace hashing.

Records are hashed by content; a task reads its share into an open-addressing table that
compares complete content. When the table would outgrow its budget, the task deals table
and remaining input out to spill files by the next bits of the hash and treats each file
the same way, as deep as it takes.

Rounds keep hot content harmless. The first deduplicates within each input partition, so
that afterwards a text stands at most once per partition. Digests of those survivors are
counted, and only content whose digest stands in several partitions goes on to be compared;
content in very many partitions meets in salted groups first, and those groups' survivors
after that. Copies rejoin by the key of their partition's survivor, never by content, so no
group gathers in one task.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import string
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_text, one_row_each, row_key, slices, written

#: Bytes of content and members that a task's table may hold before it spills.
BUCKET_BYTES = 32 << 20
#: Bits of the hash that one level of spill files uses up, and the levels that 64 bits allow.
LEVEL_BITS, LEVELS = 4, 14
#: Content that stands in more partitions than CROWD meets in SALTS groups first.
CROWD, SALTS = 64, 32


class ContentTable:
    """Open addressing with linear probing; equal hashes are settled by complete content."""

    def __init__(self) -> None:
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.members: list[list] = []
        self.nbytes = 0
        self._slots = array("q", [-1]) * 1024

    def _slot(self, hashed: int, content: bytes) -> int:
        slots, mask = self._slots, len(self._slots) - 1
        at = hashed & mask
        while (entry := slots[at]) >= 0 and not (self.hashes[entry] == hashed and self.contents[entry] == content):
            at = (at + 1) & mask
        return at

    def find(self, hashed: int, content: bytes) -> int:
        """The entry's number, -1 if absent."""
        return self._slots[self._slot(hashed, content)]

    def add(self, hashed: int, content: bytes, members: list) -> None:
        if (entry := self.find(hashed, content)) >= 0:
            self.members[entry] += members
            self.nbytes += 24 * len(members)
            return
        if 5 * len(self.hashes) >= 3 * len(self._slots):
            self._grow()
        self._slots[self._slot(hashed, content)] = len(self.hashes)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.members.append(members)
        self.nbytes += len(content) + 200 + 24 * len(members)

    def _grow(self) -> None:
        self._slots = array("q", [-1]) * (2 * len(self._slots))
        mask = len(self._slots) - 1
        for entry, hashed in enumerate(self.hashes):
            at = hashed & mask
            while self._slots[at] >= 0:
                at = (at + 1) & mask
            self._slots[at] = entry

    def __iter__(self) -> Iterator[tuple[int, bytes, list]]:
        return zip(self.hashes, self.contents, self.members, strict=True)


def grace(records: Iterable[tuple[int, bytes, list]], budget: int = BUCKET_BYTES, level: int = 0) -> Iterator[tuple[int, bytes, list]]:
    """(hash, content, members) once for each content, members of equal content joined."""
    table, records = ContentTable(), iter(records)
    for record in records:
        table.add(*record)
        if table.nbytes > budget and len(table.hashes) > 1 and level < LEVELS:
            break
    else:
        yield from table
        return
    shift, fan = 64 - LEVEL_BITS * (level + 1), 1 << LEVEL_BITS
    with tempfile.TemporaryDirectory(prefix="grace-", dir=_scratch()) as folder:
        files = [open(f"{folder}/{k}", "w+b") for k in range(fan)]  # noqa: SIM115
        try:
            for source in (table, records):
                for record in source:
                    pickle.dump(record, files[(record[0] >> shift) & (fan - 1)], protocol=5)
                del source
            table = None
            for file in files:
                file.seek(0)
                yield from grace(_loaded(file), budget, level + 1)
                file.close()
        finally:
            for file in files:
                file.close()


def _scratch() -> str | None:
    """Spark's own scratch folder on this executor, where spill files live as long as their task."""
    folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
    return next((f for f in folders if f and os.path.isdir(f)), None)


def _loaded(file) -> Iterator[tuple[int, bytes, list]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def normal_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


_LOCAL = pa.schema([("hash", pa.int64()), ("rep", pa.int64()), ("top_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("sha256", pa.string()), ("content", pa.binary())])
_LOCAL_DDL = "hash long, rep long, top_id long, n long, ids array<long>, sha256 string, content binary"
_MERGED = pa.schema([("hash", pa.int64()), ("crowded", pa.bool_()), ("rep", pa.int64()), ("top_id", pa.int64()), ("n", pa.int64()), ("reps", pa.list_(pa.int64())), ("content", pa.binary())])
_MERGED_DDL = "hash long, crowded boolean, rep long, top_id long, n long, reps array<long>, content binary"


def _signed(hashed: int) -> int:
    return hashed - (1 << 64) if hashed >> 63 else hashed


def _batched(rows: Iterable[tuple], schema: pa.Schema, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, nbytes = [], 0
    for row in rows:
        held.append(row)
        nbytes += 64 + sum(len(x) for x in row if isinstance(x, bytes)) + sum(8 * len(x) for x in row if isinstance(x, list))
        if nbytes > most_bytes:
            yield _batch(held, schema)
            held, nbytes = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of
    equal texts the row with the largest doc_id stays; a null doc_id is smaller than any
    other. Of repeated rows with that doc_id exactly one stays. keep_id is null where every
    member's doc_id is null. An empty table gives an empty result; other columns are ignored.
    """

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for part in slices(batches):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    content = normal_bytes(text)
                    yield int.from_bytes(hashlib.sha256(content).digest()[:8], "big"), content, [doc_id]

        base = TaskContext.get().partitionId() << 33

        def rows():
            for k, (hashed, content, ids) in enumerate(grace(records(), bucket_bytes)):
                ids = sorted((i for i in ids if i is not None), reverse=True) + [i for i in ids if i is None]
                yield _signed(hashed), base + k, ids[0], len(ids), ids, hashlib.sha256(content).hexdigest(), content

        yield from _batched(rows(), _LOCAL)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of equal content as one, with the survivor's rep and all reps; the content stays with the crowded ones."""

        def records():
            for part in slices(batches):
                for hashed, content, *member in zip(*(part.column(c).to_pylist() for c in ("hash", "content", "crowded", "rep", "top_id", "n", "reps")), strict=True):
                    yield hashed & ((1 << 64) - 1), content, [tuple(member)]

        def rows():
            for hashed, content, members in grace(records(), bucket_bytes):
                crowded, rep, top_id, _, _ = max(members, key=lambda m: (m[2] is not None, m[2] or 0, -m[1]))
                yield _signed(hashed), crowded, rep, top_id, sum(m[3] for m in members), [r for m in members for r in m[4]], content if crowded else b""

        yield from _batched(rows(), _MERGED)

    classes = written(id_text(docs, id_col, text_col).mapInArrow(local, _LOCAL_DDL), "exact-dedup")
    spread = classes.groupBy("sha256").agg(F.count(F.lit(1)).alias("met"))
    alone = classes.select("sha256", "rep", "top_id", "n").join(spread.filter("met = 1"), "sha256")
    salt = F.when(F.col("crowded"), F.pmod(F.hash("rep"), F.lit(SALTS))).otherwise(0).alias("salt")
    shared = classes.drop("ids").join(spread.filter("met > 1"), "sha256").withColumn("crowded", F.col("met") > CROWD)
    shared = shared.select("hash", "crowded", "rep", "top_id", "n", F.array("rep").alias("reps"), "content", salt)
    met = checkpointed(shared.repartition("hash", "salt").drop("salt").mapInArrow(merge, _MERGED_DDL))
    crowds = met.filter("crowded").repartition("hash").mapInArrow(merge, _MERGED_DDL)
    joined = met.filter("not crowded").unionByName(crowds)
    ended = joined.select("top_id", "n", F.col("rep").alias("first"), F.explode("reps").alias("rep")).select("rep", F.col("top_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("first") == F.col("rep")).alias("wins"))
    ended = ended.unionByName(alone.select("rep", F.col("top_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("wins")))
    members = classes.select("rep", "ids", "sha256").join(ended, "rep")
    return members.select("*", F.posexplode("ids").alias("at", "doc_id")).select(
        "doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("at") == 0)).alias("kept"), F.col("sha256").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without exact copies: one row of each group of equal texts, with all of docs' columns.

    The row with the largest doc_id stays. Rows that repeat both doc_id and text are one
    document, of which any row may stay. Columns of docs may have any names; an empty table
    stays empty.
    """
    kept = exact_groups(docs, id_col=id_col, text_col=text_col).filter("kept")
    folded = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return one_row_each(docs, kept.select(row_key(F.col("doc_id"), F.col("text_sha256"))), row_key(F.col(id_col).cast("long"), F.sha2(folded, 256)))
