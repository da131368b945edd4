"""What the corpus operators share: the shared folder, and Arrow helpers for tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session names none, a folder of its own is made and also set as the checkpoint
    folder, but only where driver and tasks are one process: no other machine would see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if (own := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, doc_id long and text string, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, whatever its columns are called."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def row_key(doc_id: Column, content: Column) -> Column:
    """A non-null key of a document: its doc_id and a hash of its content."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("/"), content.cast("string"))


def one_row_each(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """One row of docs for each of the keys (a table of one column, row_key(), distinct), with docs' own columns.

    Rows that repeat a key are joined before the shuffle, so that none is hot.
    """
    name = fresh(docs, "row_key")
    once = docs.select("*", key.alias(name)).dropDuplicates([name])
    return once.join(keys.toDF(name), name, "left_semi").select(*own_columns(docs))


_HELD: dict = {}


def held_by_worker(key: tuple, make: Callable):
    """make()'s value, kept by this Python worker for its next tasks of the same key; tasks of other operators drop it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int = 4 << 20, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that one slice holds few bytes whatever the length of its texts.

    Workers outlive their tasks: what they hold for another operator goes first unless keep says that
    it is this one's, and memory that the batches took goes back to the system after them.
    """
    if not keep:
        _HELD.clear()
    for batch in batches:
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, most_bytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    pa.default_memory_pool().release_unused()


def per_texts(docs: DataFrame, make: Callable[[], Callable[[list], list[tuple]]], schema: pa.Schema, ddl: str, most_bytes: int = 4 << 20, keep: bool = False) -> DataFrame:
    """A row for each document: make() is called once a task and gives the function of a list of texts, which hold most_bytes together.

    keep says that make() uses held_by_worker().

    The function returns a tuple for each text: the columns after doc_id, which comes first.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for part in slices(batches, most_bytes, keep):
            rows = of(part.column(1).to_pylist())
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.names[1:]]
            arrays = [part.column(0), *(pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.mapInArrow(run, ddl)


def per_text(docs: DataFrame, make: Callable[[], Callable[[str | None], tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """per_texts() with a function of one text."""

    def many():
        of = make()
        return lambda texts: [of(t) for t in texts]

    return per_texts(docs, many, schema, ddl)
