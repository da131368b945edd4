"""Analysis results as rows with free-form parts, from JSON text and back.

What has no fixed shape (a decision's data, evidence values and metadata, variants, the raw
answer) is kept as VARIANT, so that any nested value comes back as it was stored. Reading is
lenient: items of a list that are not what they should be go, and wrong optional values
become null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import let

#: Without these, each of its own type, a text holds no result.
REQUIRED = {"content_type": "STRING", "is_useful": "BOOLEAN", "priority": "STRING", "main_decision": "STRING"}


def _get(v: Column, name: str) -> Column:
    """A member, whatever its type; null if it is missing."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))


def _text(v: Column) -> Column:
    """The text of a text; null for any other type."""
    return let(v, lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")))


def _number(v: Column) -> Column:
    """A number, a text that is one, or a truth value as 1 or 0; null for any other type."""

    def of(s: Column) -> Column:
        x, kind = s["x"], s["kind"]
        plain = kind.rlike("^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
        return F.when(plain, F.try_variant_get(x, "$", "double")).when(kind == "STRING", F.trim(F.try_variant_get(x, "$", "string")).try_cast("double")).when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("double"))

    return let(let(v, lambda x: F.struct(x.alias("x"), _kind(x).alias("kind"))), of)


def _is_object(v: Column) -> Column:
    """Whether a value is an object, without a look at its members' types."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _object(v: Column) -> Column:
    """An object, an empty one for any other type."""
    return let(v, lambda x: F.when(_is_object(x), x).otherwise(F.parse_json(F.lit("{}"))))


def _items(v: Column, kind: str) -> Column:
    """The items of a list that are of a kind, none for any other type."""
    every = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce(F.filter(every, _is_object if kind == "OBJECT" else lambda x: _kind(x) == kind), F.array().cast("array<variant>"))


def _named(v: Column, name: str, make) -> Column:
    """make() of each object in a list that has a text of that name."""
    return F.transform(F.filter(_items(v, "OBJECT"), lambda x: _text(_get(x, name)).isNotNull()), make)


def _truthy(v: Column) -> Column:
    """Whether a value counts as true; a missing one does."""
    return let(v, lambda x: F.when(x.isNull(), True).when(F.is_variant_null(x), False).otherwise(~F.to_json(x).isin("false", "0", "0.0", '""', "[]", "{}")))


def _evidence(x: Column) -> Column:
    return F.struct(_text(_get(x, "field")).alias("field"), _get(x, "value").alias("value"), _text(_get(x, "source")).alias("source"), _text(_get(x, "source_text")).alias("source_text"), _number(_get(x, "confidence")).alias("confidence"), _object(_get(x, "metadata")).alias("metadata"))


def _decision(x: Column) -> Column:
    return F.struct(_text(_get(x, "type")).alias("type"), _number(_get(x, "confidence")).alias("confidence"), _object(_get(x, "data")).alias("data"), _named(_get(x, "evidence"), "field", _evidence).alias("evidence"))


def _planned(x: Column) -> Column:
    return F.struct(_text(_get(x, "sql")).alias("sql"), _text(_get(x, "purpose")).alias("purpose"), _number(_get(x, "confidence")).alias("confidence"), _truthy(_get(x, "requires_review")).alias("requires_review"), _object(_get(x, "metadata")).alias("metadata"))


def parsed(json: Column) -> Column:
    """The result in a JSON text as a struct; null if it is no JSON object or a required field is missing or of another type.

    The confidence is required too and may be a number, a text that is one, or a truth value.
    """
    return let(F.try_parse_json(json), _result)


def _result(v: Column) -> Column:
    whole = _number(_get(v, "confidence")).isNotNull()
    for name, kind in REQUIRED.items():
        whole &= _kind(_get(v, name)) == kind
    made = F.struct(
        _text(_get(v, "content_type")).alias("content_type"), F.try_variant_get(v, "$.is_useful", "boolean").alias("is_useful"), _text(_get(v, "priority")).alias("priority"), _number(_get(v, "confidence")).alias("confidence"),
        _text(_get(v, "main_decision")).alias("main_decision"), _named(_get(v, "decisions"), "type", _decision).alias("decisions"), _items(_get(v, "variants"), "OBJECT").alias("variants"), _named(_get(v, "sql_plan"), "sql", _planned).alias("sql_plan"),
        F.transform(_items(_get(v, "warnings"), "STRING"), _text).alias("warnings"), _object(_get(v, "raw")).alias("raw"),
    )
    return F.when(whole, made)


def as_json(result: Column) -> Column:
    """The JSON text of a struct as parsed() gives it; missing optional values are null in it."""
    return F.to_json(result, {"ignoreNullFields": "false"})


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to the table at path; they may have columns that earlier ones had not."""
    rows.write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Everything that was added to the table, with the columns of all of it."""
    return spark.read.option("mergeSchema", True).parquet(path)
