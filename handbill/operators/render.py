"""Texts made of drafts and decisions: posts, drafts for review, and search texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t


def _line(label: str, value: Column) -> Column:
    """`label: value`, null when the value is missing, so that joining leaves it out."""
    return F.concat(F.lit(f"{label}: "), t.blank_to_null(value.cast("string")))


def post_text(draft: dict[str, Column], template: str | None = None) -> Column:
    """A post by the default layout, or by a template with {title}, {artists}, {date}, {city}, {venue}, {age}, {links}.

    draft has a column for each placeholder; missing values are empty in a template and left
    out of the layout.
    """
    if template is None:
        age = F.concat(draft["age"].cast("string"), F.lit("+"))
        return F.concat_ws("\n", t.blank_to_null(draft["title"]), t.blank_to_null(draft["artists"]), F.concat_ws(", ", draft["date"].cast("string"), t.blank_to_null(draft["city"]), t.blank_to_null(draft["venue"])), age, t.blank_to_null(draft["links"]))
    made = F.lit(template)
    for name, value in draft.items():
        made = F.replace(made, F.lit("{" + name + "}"), t.text_or_empty(value.cast("string")))
    return made


def draft_message(draft: dict[str, Column]) -> Column:
    """Every field of a draft with its name, one a line."""
    return F.concat_ws("\n", *(_line(name, value) for name, value in draft.items()))


def review_text(title: Column, decision: Column, reasons: Column, issues: Column) -> Column:
    """Header, decision with its reasons, and the grouped issues (an array of `message (n)`)."""
    return F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce(t.blank_to_null(title), F.lit("—"))), F.concat(F.lit("Decision: "), decision), _line("Reasons", reasons), F.when(F.size(issues) > 0, F.concat(F.lit("Issues:\n- "), F.array_join(issues, "\n- "))))


def search_text(*parts: Column, suffix: str = "official site tickets", limit: int = 700) -> Column:
    """At most `limit` characters of the parts in one line, then a fixed suffix."""
    return F.concat(F.rtrim(F.left(t.squeeze(F.concat_ws(" ", *parts)), F.lit(limit))), F.lit(f" {suffix}"))
