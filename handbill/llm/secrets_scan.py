"""Secret scanning through a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams: alternatives, each a
set of trigrams that a match must contain. The index has a posting for each trigram that
any rule asks for and each document that contains it. Intersecting a rule's postings gives
its candidates, and only those are verified with the expression itself. A rule with an
alternative that has no mandatory trigram scans every document.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text
from .spans import counted, joined, matches


@dataclass(frozen=True)
class Rule:
    """pattern is common to Java and Python; valid tests a match further."""

    kind: str
    pattern: str
    valid: Callable[[Column], Column] | None = None


ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"

#: Base kinds in their listed order, then what is known of issuers' key formats.
BASE = (
    Rule("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
#: A class of more letters, or a query of more alternatives, ends what is known of the text.
MOST_LETTERS, MOST_ALTERNATIVES = 6, 200


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory lower-case trigrams; None if a match need not contain any."""
    found = {_grams(known, tail) for tail, known in _walk(parser.parse(pattern), {("", frozenset())})}
    least = [x for x in found if not any(y < x for y in found)]
    return sorted(least, key=sorted) if all(least) else None


def _grams(known: frozenset[str], tail: str) -> frozenset[str]:
    return known | {tail[k : k + 3] for k in range(len(tail) - 2)}


def _walk(nodes, states: set[tuple[str, frozenset[str]]]) -> set[tuple[str, frozenset[str]]]:
    """States after the nodes: the literal text that ends here, and the trigrams before it."""
    flushed = lambda s: {("", _grams(known, tail)) for tail, known in s}
    for kind, value in nodes:
        if kind is op.LITERAL:
            states = {(tail + chr(value).lower(), known) for tail, known in states}
        elif kind is op.IN and (letters := _letters(value)):
            states = {(tail + c, known) for tail, known in states for c in letters}
        elif kind is op.SUBPATTERN:
            states = _walk(value[3], states)
        elif kind is op.BRANCH:
            states = set().union(*(_walk(branch, states) for branch in value[1]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            for _ in range(min(least, 3)):
                states = _walk(inner, states)
            if (least, most) == (0, 1):
                states = states | _walk(inner, states)
            elif not least == most <= 3:
                states = flushed(states)
        elif kind is not op.AT:
            states = flushed(states)
        if len(states) > MOST_ALTERNATIVES:
            states = flushed(states)
    return states


def _letters(members) -> set[str]:
    found = set()
    for kind, value in members:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MOST_LETTERS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return set()
    return found if len(found) <= MOST_LETTERS else set()


#: A document's key: its doc_id and its text's hash, so that rows without a doc_id are not one key.
KEY = ["doc_id", "key"]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """doc_id, key, gram: which of the trigrams each document contains, in lower case."""
    low = docs.select(*KEY, F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams)))
    return low.select(*KEY, F.explode(held).alias("gram"))


def candidates(docs: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """doc_id, key, kinds: the documents whose postings satisfy a kind's query, with all such kinds."""
    terms = [(kind, n, gram, 1 << k, (1 << len(grams)) - 1) for kind, query in queries.items() for n, grams in enumerate(query) for k, gram in enumerate(sorted(grams))]
    asked = docs.sparkSession.createDataFrame(terms, "kind string, alternative int, gram string, bit long, whole long")
    index = postings(docs, sorted({gram for _, _, gram, _, _ in terms}))
    met = index.join(F.broadcast(asked), "gram").groupBy(*KEY, "kind", "alternative", "whole").agg(F.bit_or("bit").alias("bits"))
    return met.filter("bits = whole").groupBy(*KEY).agg(F.collect_set("kind").alias("kinds"))


_SPANS = "array<struct<start:int,order:int,kind:string,end:int,value:string>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of start, order, kind, end, value), by start, then the rules' order.

    A row for every row of docs, with an empty array where nothing is found; a null text
    counts as empty. Repeated rows, and rows with a null doc_id, are scanned like any other;
    an empty table gives none, and other columns are ignored whatever their names. Rows are
    told apart by doc_id and a 64-bit hash of the text together. The time follows the text's
    length, however many matches it has.
    """
    docs = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    none = F.array().cast(_SPANS)

    def spans_of(k: int, rule: Rule) -> Column:
        found = matches(F.col("text"), rule.pattern, rule.valid)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("order"), F.lit(rule.kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    everywhere = [spans_of(k, r) for k, r in enumerate(rules) if queries[r.kind] is None]
    full = docs.select(*KEY, F.concat(none, *everywhere).alias("spans"))
    asked = {kind: q for kind, q in queries.items() if q is not None}
    if not asked:
        return full.select("doc_id", F.array_sort("spans").alias("spans"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["doc_id"].eqNullSafe(b["found_id"]) & (a["key"] == b["found_key"])

    found = candidates(docs, asked).withColumnsRenamed({"doc_id": "found_id", "key": "found_key"})
    verified = [F.when(F.array_contains("kinds", rule.kind), spans_of(k, rule)).otherwise(none) for k, rule in enumerate(rules) if rule.kind in asked]
    checked = docs.join(found, same(docs, found)).select(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key"), F.concat(*verified).alias("more"))
    checked = checked.dropDuplicates(["found_id", "found_key"])
    both = full.join(checked, same(full, checked), "left").select("doc_id", F.concat("spans", F.coalesce("more", none)).alias("spans"))
    return both.select("doc_id", F.array_sort("spans").alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text) of scan()'s rows."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    counts = [counted(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in BASE]
    return scanned.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
