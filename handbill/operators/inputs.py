"""Fields read out of an input: what its metadata says goes first, then labels, then the text itself.

Each field carries the rule that found it and, where it stands in the text, its first and
last character, so that a reader can be shown the place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions import text as t
from ..functions.dates import let
from ..plans.shared import spread
from .posts import once
from .verify import INPUT_CONFIDENCE


@dataclass(frozen=True)
class Extraction:
    """Labels of fields in text, and keys of fields in metadata, the preferred first."""

    labels: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"artist": ("артист", "исполнитель", "artist"), **{n: fields.CONCERTS.labels[n] for n in ("date", "venue", "price")}})
    keys: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"title": ("event_title",), "artist": ("event_artist", "artist"), "date": ("event_date", "date"), "city": ("city",), "venue": ("venue",)})
    cities: dict[str, str] = field(default_factory=lambda: dict(t.CITY_ALIASES))


FIELDS = ("title", "artist", "event_type", "date", "city", "venue", "price", "age_limit")
_FOUND = "struct<value:string,rule:string,start:int,end:int>"
#: Leading lines that are no title: empty ones, addresses, list items and objects.
SKIPPED = r"^(?:[ \t]*(?:(?:https?:|www\.|[-{])[^\r\n]*)?\r?\n)*[ \t]*([^\s](?:[^\r\n]*[^\s])?)"
NO_TITLE = r"^(?:https?:|www\.|[-{])"


def label_of(labels: tuple[str, ...]) -> str:
    """A pattern of the first `label: value` line, list marks before it aside; the value is its group."""
    return rf"(?imu)^[ \t*>\-]*(?:{'|'.join(labels)})[ \t]*:[ \t]*([^\s](?:[^\r\n]*[^\s])?)"


def price_of(labels: tuple[str, ...]) -> str:
    """A pattern of a price anywhere in a line, without blanks, dots and semicolons at its ends."""
    return rf"(?iu)(?:{'|'.join(labels)})\s*[:：]\s*([^\s.;](?:[^\r\n]*[^\s.;])?)"


def _found(value: Column, rule: str, start: Callable[[Column], Column] | None = None) -> Column:
    """The field if there is a value; start gives its place in the text from the value."""
    whole = lambda v, at, end: F.struct(v.alias("value"), F.lit(rule).alias("rule"), at.cast("int").alias("start"), end.cast("int").alias("end"))
    none = F.lit(None)
    placed = lambda v: whole(v, none, none) if start is None else let(start(v), lambda at: whole(v, at, at + F.length(v)))
    return let(value, lambda v: F.when(F.coalesce(v, F.lit("")) != "", placed(v))).cast(_FOUND)


def _matched(text: Column, pattern: str, rule: str, place: bool) -> Column:
    """The pattern's first match, which its group ends."""
    start = lambda v: F.length(F.element_at(F.split(text, pattern, 2), 1)) + F.length(F.regexp_extract(text, pattern, 0)) - F.length(v)
    return _found(F.regexp_extract(text, pattern, 1), rule, start if place else None)


def extracted(texts: DataFrame, how: Extraction | None = None, *, place: bool = True) -> DataFrame:
    """run_id and struct<value,rule,start,end> of each field of each input (run_id, text, and metadata, a map, if there is one); null where nothing says it.

    A null text is empty. A title is the first line that is no address, list item or object; it is the artist too, in title
    case if it is all capitals, where no label names one. A city is the first of the known ones that the text
    contains, by its alias. What has an artist is a concert. Each rule reads a text once; without place, start and end are null.
    """
    how = how or Extraction()
    text, low = F.col("text"), F.col("low")

    def given(name: str) -> list[Column]:
        return [_found(F.trim(F.element_at("metadata", key)), "metadata") for key in how.keys.get(name, ())] if "metadata" in texts.columns else []

    read = once(spread(texts.select("run_id", *(["metadata"] if "metadata" in texts.columns else []), t.text_or_empty(text).alias("text")), "run_id"), F.lower("text").alias("low"), _matched(text, SKIPPED, "first_line", place).alias("first"))
    known = F.lit(None).cast("string")
    for alias in reversed(how.cities):
        known = F.when(low.contains(alias), F.lit(alias)).otherwise(known)
    canonical = F.create_map(*(F.lit(x) for pair in how.cities.items() for x in pair)) if how.cities else F.create_map().cast("map<string,string>")
    at = lambda alias: (F.instr(low, alias) - 1) if place else F.lit(None).cast("int")
    in_text = let(known, lambda alias: F.when(alias.isNotNull(), F.struct(F.element_at(canonical, alias).alias("value"), F.lit("alias").alias("rule"), at(alias).alias("start"), (at(alias) + F.length(alias)).alias("end")))).cast(_FOUND)
    label = lambda name: _matched(text, label_of(how.labels[name]), "label", place)
    age = _found(F.regexp_extract(low, fields.AGE, 1), "age", (lambda v: F.length(F.element_at(F.split(low, fields.AGE, 2), 1))) if place else None)
    found = once(
        read,
        F.coalesce(*given("title"), F.when(~F.col("first.value").rlike(NO_TITLE), F.col("first"))).alias("title"),
        F.coalesce(*given("artist"), label("artist")).alias("named"),
        F.coalesce(*given("date"), label("date")).alias("date"),
        F.coalesce(*given("city"), in_text).alias("city"),
        F.coalesce(*given("venue"), label("venue")).alias("venue"),
        _matched(text, price_of(how.labels["price"]), "label", place).alias("price"),
        age.alias("age_limit"),
    )
    said = F.col("title.value")
    from_title = F.struct(F.when((F.upper(said) == said) & (F.lower(said) != said), F.initcap(F.lower(said))).otherwise(said).alias("value"), F.lit("title").alias("rule"), F.col("title.start").alias("start"), F.col("title.end").alias("end")).cast(_FOUND)
    whole = once(found, F.coalesce("named", F.when(F.col("title").isNotNull(), from_title)).alias("artist"))
    return once(whole, F.when(F.col("artist").isNotNull(), _found(F.lit("concert"), "artist")).alias("event_type")).select("run_id", *FIELDS)


def fields_of(texts: DataFrame, how: Extraction | None = None) -> DataFrame:
    """run_id, field, value, rule, start, end, confidence: a row for each field of each input (run_id, text, and metadata, a map, if there is one)."""
    rows = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("f"), F.lit(INPUT_CONFIDENCE[n]).alias("confidence")) for n in FIELDS))
    return extracted(texts, how).select("run_id", F.explode(F.filter(rows, lambda r: r["f"].isNotNull())).alias("r")).select("run_id", "r.field", "r.f.*", "r.confidence")


def wide(texts: DataFrame, how: Extraction | None = None) -> DataFrame:
    """run_id and the value of each field, as verify.rule_evidence() takes them."""
    return extracted(texts, how, place=False).select("run_id", *(F.col(n)["value"].alias(n) for n in FIELDS))
