"""Writers, and readers of nested results.

All writing goes through Spark's file writers, whose commit makes a table's files visible only when all tasks are
done: a failed or repeated task leaves no half-written report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "array<struct<url:string,final_url:string,ok:boolean,blocked_by_antibot:boolean,status_code:int,title:string,text_preview:string>>"


def write_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """JSON lines; dates as ISO text, nulls left out."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def flat_rows(*tables: DataFrame) -> DataFrame:
    """The union of tables by the union of their columns, nested values as JSON text."""
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    nested = [f.name for f in every.schema if f.dataType.typeName() in ("array", "map", "struct")]
    return every.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested})


def write_csv(path: str, *tables: DataFrame) -> None:
    """CSV with the union of the tables' columns as header; line breaks and quotes in values are quoted."""
    flat_rows(*tables).write.mode("errorifexists").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What write_csv() wrote, as text columns; an empty value is null."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("errorifexists").text(path)


def append_results(results: DataFrame, path: str) -> None:
    """Adds analysis results to the table at path, which keeps every one that was ever added."""
    results.write.mode("append").parquet(path)


def tool_pages(results: DataFrame) -> DataFrame:
    """run_id, step, pos and the page's columns for each page of `url_read` results (run_id, step, tool, data); malformed rows go."""
    read = results.filter("tool = 'url_read'").select("run_id", "step", F.posexplode(F.from_json(F.get_json_object("data", "$.pages"), PAGES)).alias("pos", "page"))
    return read.select("run_id", "step", "pos", "page.*").filter("url is not null")


def failures(drafts: DataFrame, warning: str) -> DataFrame:
    """The drafts with exactly this warning among theirs, with what is needed to look into them."""
    return drafts.filter(F.array_contains(F.split("warnings", ","), warning)).select("post_id", "source", "kind", "title", "date_line", "warnings")


def fingerprints(images: DataFrame) -> DataFrame:
    """Path, size and sha256 of files read with format("binaryFile")."""
    return images.select("path", "length", F.sha2("content", 256).alias("sha256"))
