"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells by source, language and topic. Token weights of the cells are
scaled to the target share of each source, then of each language, then of each topic, again
and again. A cell's rate is its weight times the token budget over its tokens: the expected
number of times that each of its documents is drawn. A draw is a hash of doc_id, so it
repeats exactly.

No rate may exceed most_copies, and the raking itself keeps to that: each step finds the
factor at which a value's cells, none over its bound, have the value's share. Where no
weights reach all targets under the bound, the budget is lowered step by step until some do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, own_columns

DIMENSIONS = ("source", "lang", "topic")
#: Topic rules for tables without a topic column: the first whose text the document contains names its topic.
TOPICS = (("contact", "@"), ("listing", " | "), ("legal", "icense"), ("measure", "%"))
OTHER = "prose"
#: A null source, language or topic is a group of its own under this name.
NONE = "(none)"
#: Targets are met when no share is further from its target; each lower budget is this part of the one before, and so many are tried.
SETTLED, LOWER, BUDGETS = 1e-3, 0.9, 48


@dataclass(frozen=True)
class Plan:
    """Targets: shares by value, renormalised over the values present, or else an exponent.

    A value that a dimension's shares do not list has share 0 and is never drawn. With an
    exponent, a value's share follows its tokens to that power: 1 keeps the natural mix, 0
    makes all values equal.
    """

    shares: dict[str, dict[str, float]] = field(default_factory=lambda: {"topic": {"prose": 0.7, "listing": 0.1, "contact": 0.1, "legal": 0.05, "measure": 0.05}})
    powers: dict[str, float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.5})
    budget: float = 0.5  # of all tokens, or the most of it that meets the targets
    most_copies: int = 4
    sweeps: int = 40
    seed: int = 42

    def budgets(self) -> list[float]:
        return [self.budget * LOWER**k for k in range(BUDGETS)]


def topic(text: Column) -> Column:
    named = F.lit(OTHER)
    for name, sign in reversed(TOPICS):
        named = F.when(F.contains(text, F.lit(sign)), name).otherwise(named)
    return named


def tokens(text: Column) -> Column:
    """The usual estimate of four bytes a token, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.octet_length(text) / F.lit(4)).cast("long"))


@dataclass(frozen=True)
class Columns:
    """Names of what docs has; without topic or tokens they are taken from the text."""

    doc_id: str = "doc_id"
    text: str = "text"
    source: str = "source"
    lang: str = "lang"
    topic: str | None = None
    tokens: str | None = None

    def described(self, prefix: str) -> list[Column]:
        text = F.coalesce(F.col(self.text).cast("string"), F.lit(""))
        named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
        counted = tokens(text) if self.tokens is None else F.greatest(F.coalesce(F.col(self.tokens).cast("long"), F.lit(0)), F.lit(1))
        kinds = {"source": named(self.source), "lang": named(self.lang), "topic": topic(text) if self.topic is None else named(self.topic), "tokens": counted}
        return [c.alias(prefix + n) for n, c in kinds.items()]


def free_prefix(docs: DataFrame) -> str:
    """_mix_, with more underscores where columns of docs begin so already."""
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


def cells_of(described: DataFrame, prefix: str) -> DataFrame:
    """source, lang, topic, tokens: the tokens of each cell."""
    return described.groupBy(*(F.col(prefix + n).alias(n) for n in DIMENSIONS)).agg(F.sum(prefix + "tokens").alias("tokens"))


def targets(cells: DataFrame, name: str, plan: Plan) -> DataFrame:
    """value and share of one dimension; shares sum to 1 over the values present."""
    held = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("tokens"))
    if name in plan.shares:
        pairs = F.create_map(*(F.lit(x) for pair in plan.shares[name].items() for x in pair))
        raw = held.select("value", F.coalesce(F.element_at(pairs, F.col("value")), F.lit(0.0)).alias("raw"))
    else:
        raw = held.select("value", F.pow(F.col("tokens").cast("double"), F.lit(plan.powers.get(name, 1.0))).alias("raw"))
    whole = raw.agg(F.sum("raw").alias("whole"))
    return raw.crossJoin(F.broadcast(whole)).select("value", F.when(F.col("whole") > 0, F.col("raw") / F.col("whole")).otherwise(0.0).alias("share"))


def _factors(at: np.ndarray, share: np.ndarray, latent: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each value the factor of its cells' latent weights at which those, none over its bound, sum to its share.

    In the order in which cells reach their bounds, each place gives the factor that holds if
    exactly the cells before it have done so; the largest is the factor sought.
    """
    full = np.divide(bound, latent, out=np.full_like(bound, np.inf), where=latent > 0)
    order = np.lexsort((full, at))
    values, weights, bounds = at[order], latent[order], bound[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    begin = np.repeat(first, np.diff(np.r_[first, len(values)]))
    sums, held = np.r_[0.0, np.cumsum(weights)], np.r_[0.0, np.cumsum(bounds)]
    end = np.repeat(np.r_[first[1:], len(values)], np.diff(np.r_[first, len(values)]))
    places = np.arange(len(values))
    rest, before = sums[end] - sums[places], held[places] - held[begin]
    rest = np.where(weights > 0, np.maximum(rest, weights), 0.0)
    some = np.divide(share[values] - before, rest, out=np.zeros_like(rest), where=rest > 0)
    out = np.zeros(len(share))
    np.maximum.at(out, values, some)
    return out


def _near(at: list[np.ndarray], goal: list[np.ndarray], start: np.ndarray, bound: np.ndarray, sweeps: int) -> tuple[np.ndarray, float]:
    """Weights under the bound, and how far the worst share is from its target; at has each cell's value by dimension."""
    latent = start
    for _ in range(sweeps):
        for k, share in enumerate(goal):
            latent = np.minimum(latent * _factors(at[k], share, latent, bound)[at[k]], 1e9 * bound)
    weight = np.minimum(latent, bound)
    return weight, max(np.abs(np.bincount(at[k], weight, len(share)) - share).max() for k, share in enumerate(goal))


def _far(cells: DataFrame, wanted: dict[str, DataFrame], whole: int, per_token: float, sweeps: int) -> tuple[DataFrame, float]:
    """_near() as joins over the table of cells, with one of Newton's steps towards each factor in a sweep."""
    bound, latent = F.col("tokens") * F.lit(per_token), F.col("weight")
    raked, far = cells.withColumn("weight", F.col("tokens") / F.lit(float(whole))), np.inf
    held = F.least(latent, bound)
    for sweep in range(3 * sweeps):
        for name in DIMENSIONS:
            sums = raked.groupBy(F.col(name).alias("value")).agg(F.sum(held).alias("have"), F.sum(F.when(latent < bound, latent).otherwise(0.0)).alias("free"), F.sum(latent).alias("all")).join(wanted[name], "value")
            low = F.col("share") / F.col("all")
            step = F.when(F.col("free") > 0, 1 + (F.col("share") - F.col("have")) / F.col("free")).otherwise(low)
            factor = F.when(F.col("all") > 0, F.least(F.greatest(low, step), F.lit(1e3))).otherwise(0.0)
            raked = checkpointed(raked.join(sums.select(F.col("value").alias(name), factor.alias("factor")), name).select(*DIMENSIONS, "tokens", F.least(latent * F.col("factor"), bound * 1e9).alias("weight")))
        if sweep % 3 == 2:
            was = far
            gaps = [raked.groupBy(F.col(n).alias("value")).agg(F.sum(held).alias("have")).join(wanted[n], "value").agg(F.max(F.abs(F.col("have") - F.col("share")))).first()[0] for n in DIMENSIONS]
            far = max(g or 0.0 for g in gaps)
            if far < SETTLED / 10 or sweep > sweeps and far > was * 0.999:
                break
    return raked.withColumn("weight", held), far


def rake(cells: DataFrame, plan: Plan, *, local_cells: int = 20_000) -> tuple[DataFrame, float]:
    """cells (source, lang, topic, tokens) with weight, shares that meet the targets, and the budget for which they hold.

    No cell's rate exceeds most_copies. The budget is the first of plan.budgets() whose
    weights are settled; targets that even the last of them cannot meet, as no weights do,
    are met as closely as there. Up to local_cells cells, a count that is checked, the
    sweeps run on a driver-side copy; beyond, as checkpointed joins over the table of cells.
    """
    wanted = {name: checkpointed(targets(cells, name, plan)) for name in DIMENSIONS}
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    if not whole:
        return cells.withColumn("weight", F.lit(0.0)), plan.budget
    head = cells.limit(local_cells + 1).collect()
    if local := len(head) <= local_cells:
        goal = [{r["value"]: r["share"] for r in wanted[n].collect()} for n in DIMENSIONS]
        index = [{v: k for k, v in enumerate(g)} for g in goal]
        at = [np.array([ix[r[n]] for r in head]) for ix, n in zip(index, DIMENSIONS, strict=True)]
        held = np.array([r["tokens"] for r in head], float)
        shares = [np.array(list(g.values()), float) for g in goal]

    def tried(budget: float) -> tuple:
        per_token = plan.most_copies / (budget * whole)
        return _near(at, shares, held / whole, held * per_token, plan.sweeps) if local else _far(cells, wanted, whole, per_token, plan.sweeps)

    closest = None
    for budget in plan.budgets():
        weight, far = tried(budget)
        if far <= SETTLED:
            break
        closest = tried(plan.budgets()[-1])[1] if closest is None else closest
        if far <= 1.01 * closest:
            break
    if not local:
        return checkpointed(weight), budget
    rows = [(*(r[n] for n in DIMENSIONS), r["tokens"], float(w)) for r, w in zip(head, weight, strict=True)]
    return F.broadcast(cells.sparkSession.createDataFrame(rows, "source string, lang string, topic string, tokens long, weight double")), budget


def mix(docs: DataFrame, plan: Plan | None = None, *, local_cells: int = 20_000, **names: str) -> DataFrame:
    """docs with columns source, lang, topic, tokens, rate, copies and budget, named with free_prefix().

    copies are the times that the row is drawn; the expected tokens drawn are `budget` of all
    tokens, shared as raked. names are those of Columns. A null text is empty and counts one
    token; a null doc_id draws as the text 'null'. Repeated rows draw alike. An empty table
    stays empty.
    """
    plan, columns, prefix = plan or Plan(), Columns(**names), free_prefix(docs)
    described = docs.select("*", *columns.described(prefix))
    cells = checkpointed(cells_of(described, prefix))
    raked, budget = rake(cells, plan, local_cells=local_cells)
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    rates = raked.select(*(F.col(n).alias(prefix + n) for n in DIMENSIONS), F.round(F.col("weight") * F.lit(budget) * F.lit(whole) / F.col("tokens"), 6).alias(prefix + "rate"))
    drawn = described.join(rates, [prefix + n for n in DIMENSIONS], "left")
    drawn = drawn.select(*own_columns(docs), *(prefix + n for n in (*DIMENSIONS, "tokens", "rate")))
    return drawn.withColumns({prefix + "copies": copies(F.col(prefix + "rate"), F.col(columns.doc_id), plan), prefix + "budget": F.lit(float(budget))})


def draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1, the same for the same doc_id and seed."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"/{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(rate: Column, doc_id: Column, plan: Plan) -> Column:
    bounded = F.least(rate, F.lit(float(plan.most_copies)))
    return (F.floor(bounded) + F.when(draw(doc_id, plan.seed) < bounded - F.floor(bounded), 1).otherwise(0)).cast("long")


def sample(docs: DataFrame, plan: Plan | None = None, **names: str) -> DataFrame:
    """The rows of docs that are drawn at least once, with docs' own columns."""
    return mix(docs, plan, **names).filter(F.col(free_prefix(docs) + "copies") > 0).select(*own_columns(docs))


def report(mixed: DataFrame, plan: Plan, prefix: str = "_mix_") -> DataFrame:
    """dimension, value, tokens, target, expected, drawn of mix()'s rows: a value's share as asked for, as expected and as drawn."""
    held = checkpointed(mixed.groupBy(*(F.col(prefix + n).alias(n) for n in DIMENSIONS)).agg(F.sum(prefix + "tokens").alias("tokens"), F.sum(F.col(prefix + "rate") * F.col(prefix + "tokens")).alias("rated"), F.sum(F.col(prefix + "copies") * F.col(prefix + "tokens")).alias("drawn")))
    rated, drawn = held.agg(F.sum("rated"), F.sum("drawn")).first()
    parts = []
    for name in DIMENSIONS:
        of = held.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("tokens"), (F.sum("rated") / F.lit(rated or 1.0)).alias("expected"), (F.sum("drawn") / F.lit(drawn or 1)).alias("drawn"))
        parts.append(of.join(targets(held, name, plan).withColumnRenamed("share", "target"), "value").select(F.lit(name).alias("dimension"), "value", "tokens", "target", "expected", "drawn"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mix_sql(plan: Plan) -> str:
    """DuckDB SQL for mix()'s decisions over the table documents: doc_id, source, lang, topic, tokens, rate, copies.

    All budgets are raked side by side, a step of the recursion for each sweep.
    """
    case = "CASE " + " ".join(f"WHEN contains(coalesce(text, ''), '{sign}') THEN '{name}'" for name, sign in TOPICS) + f" ELSE '{OTHER}' END"
    parts = [
        f"described AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {case} AS topic, greatest(1, ceil(octet_length(encode(coalesce(text, ''))) / 4.0))::BIGINT AS tokens FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM described GROUP BY ALL)",
        f"tried AS MATERIALIZED (SELECT k, {plan.budget} * pow({LOWER}, k) AS budget FROM range({BUDGETS}) AS r(k))",
    ]
    for name in DIMENSIONS:
        if name in plan.shares:
            raw = "CASE value " + " ".join(f"WHEN '{v}' THEN {s}" for v, s in plan.shares[name].items()) + " ELSE 0 END"
        else:
            raw = f"pow(t::DOUBLE, {plan.powers.get(name, 1.0)})"
        parts.append(f"goal_{name} AS MATERIALIZED (SELECT value, ({raw}) / sum({raw}) OVER () AS share FROM (SELECT {name} AS value, sum(tokens) AS t FROM cells GROUP BY {name}))")
    step = f"(SELECT * FROM raked WHERE sweep < {plan.sweeps})"
    for name in DIMENSIONS:
        by = f"PARTITION BY k, {name} ORDER BY bound / nullif(w, 0) NULLS LAST, source, lang, topic"
        places = f"SELECT r.*, share, coalesce(sum(bound) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {step} r JOIN goal_{name} ON value = {name}"
        step = f"(SELECT sweep, k, source, lang, topic, tokens, bound, least(w * greatest(coalesce(max((share - before) / nullif(rest, 0)) OVER (PARTITION BY k, {name}), 0), 0), bound * 1e9) AS w FROM ({places}))"
    parts.append(f"raked AS (SELECT 0 AS sweep, k, source, lang, topic, tokens, tokens * {plan.most_copies} / (budget * sum(tokens) OVER (PARTITION BY k)) AS bound, tokens / (sum(tokens) OVER (PARTITION BY k)) AS w FROM cells, tried UNION ALL SELECT sweep + 1, k, source, lang, topic, tokens, bound, w FROM {step})")
    parts.append(f"ended AS MATERIALIZED (SELECT k, source, lang, topic, tokens, least(w, bound) AS w FROM raked WHERE sweep = {plan.sweeps})")
    gaps = " UNION ALL ".join(f"SELECT k, max(abs(h - share)) AS far FROM (SELECT k, {n} AS value, sum(w) AS h FROM ended GROUP BY k, {n}) JOIN goal_{n} USING (value) GROUP BY k" for n in DIMENSIONS)
    parts.append(f"gaps AS MATERIALIZED (SELECT k, max(far) AS far FROM ({gaps}) GROUP BY k)")
    parts.append(f"chosen AS (SELECT min(k) AS k FROM gaps WHERE far <= greatest({SETTLED}, 1.01 * (SELECT far FROM gaps WHERE k = {BUDGETS - 1})))")
    parts.append("rates AS (SELECT source, lang, topic, round(w * budget * (sum(tokens) OVER ()) / tokens, 6) AS rate FROM ended JOIN chosen USING (k) JOIN tried USING (k))")
    unit = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/{plan.seed}'), 1, 8))::BIGINT / 4294967296.0"
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT doc_id, source, lang, topic, tokens, rate, (floor(rate) + CASE WHEN {unit} < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM described JOIN rates USING (source, lang, topic)"
