"""Personal data: expressions propose, checksums confirm, words nearby adjust the score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text
from .spans import blocks, counted, digits, joined, labelled, let, luhn, matches, mod97, part


@dataclass(frozen=True)
class Kind:
    """gate: a literal every match has, or None; base kinds stay whatever their score."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    gate: str | None = None
    base: bool = True


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: The expressions are written so that no text makes them run long or deep, and so that no
#: leftmost match changes: a run of a class is entered at its beginning, or where the last
#: match ended, and is never given back.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.8, r"e-?mail|contact|write|mailto", gate="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", lambda m: F.length(digits(m)).between(16, 19) & luhn(digits(m)), 0.7, r"card|visa|master|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(8, 15), 0.5, r"phone|call|tel\b|mobile|fax", gate="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", lambda m: mod97(F.concat(F.substring(m, 5, 40), F.substring(m, 1, 4))) == 1, 0.7, r"iban|bank|account|transfer", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, r"ssn|social security|tax id", base=False),
)
#: Characters on either side whose words count, what they add, and the least score of a kind that is not a base kind.
NEARBY, BONUS, LEAST = 48, 0.25, 0.5


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of order, kind, start, end, value, score), by kind as listed, then start.

    A row for every row of docs, an empty array where nothing is found; a null text counts
    as empty. The score, at most 1, rises when a word of the kind's context stands nearby.
    Repeated rows, and rows with a null doc_id, are searched like any other; an empty table
    gives none, and other columns are ignored whatever their names. The time follows the
    text's length, however many matches it has.
    """
    docs = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    parts = [labelled(matches(text, k.pattern, k.valid, F.contains(text, F.lit(k.gate)) & text.rlike(k.pattern) if k.gate else None), k.name, n) for n, k in enumerate(kinds)]
    found = docs.select("doc_id", "text", F.concat(*parts).alias("found"))

    def scored(s: Column, cut: Column) -> Column:
        begin = F.greatest(s["start"] - NEARBY, F.lit(0))
        around = F.lower(F.concat(part(cut, begin, s["start"] - begin), s["value"], part(cut, s["end"], F.lit(NEARBY))))
        near = F.coalesce(*(F.when(s["kind"] == k.name, around.rlike(k.context)) for k in kinds))
        base = F.coalesce(*(F.when(s["kind"] == k.name, F.lit(k.score)) for k in kinds))
        return F.struct(s["order"], s["kind"], s["start"], s["end"], s["value"], F.round(F.least(base + F.when(near, BONUS).otherwise(0.0), F.lit(1.0)), 2).alias("score"))

    stays = [k.name for k in kinds if k.base]
    every = let(F.when(F.size("found") > 0, blocks(text)), lambda cut: F.transform("found", lambda s: scored(s, cut)))
    spans = F.filter(every, lambda s: s["kind"].isin(stays) | (s["score"] >= LEAST))
    return found.select("doc_id", F.array_sort(spans).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (text), best_score of find()'s rows."""
    names = [k.name for k in KINDS if k.base]
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    counts = [counted(F.col("spans"), n).alias(f"n_{n}") for n in names]
    best = F.array_max(F.transform("spans", lambda s: s["score"]))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.coalesce(best, F.lit(0.0)).alias("best_score"))
