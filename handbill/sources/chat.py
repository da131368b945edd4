"""Chat exports as posts: one JSON file for each chat, {id, messages: [...]}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "id bigint, type string, date string, text string, photo string, width string, height string, photo_file_size string"
EXPORT = f"id bigint, messages array<struct<{MESSAGE.replace(' bigint', ':bigint').replace(' string', ':string')}>>, _corrupt string"
#: `text` is a string or an array of strings and entities, so it is kept as JSON text.
PARTS = "array<struct<type:string,text:string,href:string>>"


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file under path: file, id, messages, _corrupt."""
    reader = spark.read.schema(EXPORT).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path).withColumn("file", F.input_file_name())


def read_export_stream(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.readStream.schema(EXPORT).option("multiLine", True).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path).withColumn("file", F.input_file_name())


def good_and_bad(exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with messages, and the others with a reason and the first 500 characters of what was read."""
    reason = F.when(F.col("_corrupt").isNotNull(), "unreadable").when(F.col("messages").isNull(), "no_messages")
    bad = exports.withColumn("reason", reason).filter("reason is not null")
    return exports.filter(F.col("_corrupt").isNull() & F.col("messages").isNotNull()), bad.select("file", "reason", F.left("_corrupt", F.lit(500)).alias("preview"))


def messages(exports: DataFrame) -> DataFrame:
    """A row for each message that is one and has any text."""
    rows = exports.select(F.col("id").alias("channel_id"), "file", F.posexplode("messages").alias("pos", "m")).select("channel_id", "file", "pos", "m.*")
    return rows.filter((F.col("type") == "message") & (F.trim(plain_text(F.col("text"))) != ""))


def entities(text: Column) -> Column:
    """The parts of a rich text as array<struct<type,text,href>>; a plain text is one part."""
    quoted = F.regexp_replace(text, r"^\s+", "")
    listed = F.from_json(F.when(quoted.startswith("["), quoted), "array<string>")
    part = lambda v: F.when(v.startswith("{"), F.from_json(v, "struct<type:string,text:string,href:string>")).otherwise(F.struct(F.lit("plain").alias("type"), v.alias("text"), F.lit(None).cast("string").alias("href")))
    return F.coalesce(F.transform(listed, part), F.array(F.struct(F.lit("plain").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("href"))))


def plain_text(text: Column) -> Column:
    """Text of a string or of parts, with addresses that the text does not show."""
    show = lambda p: F.when(p["href"].isNotNull() & ~F.contains(F.coalesce(p["text"], F.lit("")), p["href"]), F.concat_ws(" ", p["text"], p["href"])).otherwise(F.coalesce(p["text"], F.lit("")))
    return F.array_join(F.transform(entities(text), show), "")


def html_text(text: Column) -> Column:
    """The parts as HTML: bold, italic, spoiler and links."""

    def tag(p: Column) -> Column:
        body = F.replace(F.replace(F.replace(F.coalesce(p["text"], F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        wrap = lambda name: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))
        return F.when(p["type"] == "bold", wrap("b")).when(p["type"] == "italic", wrap("i")).when(p["type"] == "spoiler", wrap("tg-spoiler")).when(p["href"].isNotNull(), F.concat(F.lit('<a href="'), p["href"], F.lit('">'), body, F.lit("</a>"))).otherwise(body)

    return F.array_join(F.transform(entities(text), tag), "")


def buttons(text: Column) -> Column:
    """Links among the parts as array<struct<text,url>>, each pair once."""
    linked = F.filter(entities(text), lambda p: p["href"].isNotNull())
    return F.array_distinct(F.transform(linked, lambda p: F.struct(p["text"].alias("text"), p["href"].alias("url"))))


def images(message_rows: DataFrame) -> DataFrame:
    """An image row for each photo with positive sides."""
    sized = message_rows.select("channel_id", F.col("id").alias("post_id"), "photo", *(F.col(c).try_cast("int").alias(c) for c in ("width", "height", "photo_file_size")))
    return sized.filter("photo is not null and width > 0 and height > 0").withColumn("position", F.lit(0))


def posts(message_rows: DataFrame) -> DataFrame:
    """Posts of message rows: lenient dates, plain and HTML text, buttons."""
    when = F.coalesce(F.try_to_timestamp("date"), F.try_to_timestamp(F.regexp_replace("date", "Z$", "+00:00")))
    return message_rows.select(F.col("id").alias("post_id"), "channel_id", F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("source"), when.cast("date").alias("published"), plain_text(F.col("text")).alias("text"), html_text(F.col("text")).alias("html_text"), buttons(F.col("text")).alias("buttons"))
