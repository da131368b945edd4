"""Exact top k by inner product: every posting of every query term is added up.

Queries and candidates are dealt into groups of bounded size, and each pair of groups meets in
one task. There the candidates become postings: for each component the places of the
candidates that have it, and their weights; a list of more than half of the places is kept as
weights of all. A query is a sparse row: term by term, its weight times the postings' weights
is scattered into one dense array of scores. A partition selection finds the k-th score, and
what reaches it, ties included, is put in order. The groups' best are then merged, some groups
at a time, so that no task gathers what grows with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vector_codes import integers

#: Values of a group of vectors (its bound in memory, 8 bytes each), and groups merged at once.
GROUP_VALUES, MERGED = 1 << 18, 256


def postings(weights: np.ndarray, sizes: np.ndarray) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """For each component: the places of the vectors where it is not zero (None: all) and its weights there.

    weights has the vectors' components one vector after the other.
    """
    place = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = weights != 0
    place, term, weights = place[held], term[held], weights[held]
    order = np.argsort(term, kind="stable")
    terms, begins = np.unique(term[order], return_index=True)
    found = {}
    for t, at in zip(terms.tolist(), np.split(order, begins[1:]), strict=False):
        if 2 * len(at) > len(sizes):
            dense = np.zeros(len(sizes), np.int64)
            dense[place[at]] = weights[at]
            found[t] = None, dense
        else:
            found[t] = place[at], weights[at]
    return found


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, the highest first; ties go to the smaller place."""
    if len(scores) > k:
        held = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        held = np.arange(len(scores))
    return held[np.lexsort((held, -scores[held]))[:k]]


FOUND = pa.schema([("query", pa.string()), ("id", pa.int64()), ("score", pa.int64()), ("times", pa.int64()), ("part", pa.int32())])


def _best_of_groups(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(candidates) or not len(queries):
            return FOUND.empty_table()
        candidates = candidates.sort_by("id")  # nulls last
        listed = candidates["v"].combine_chunks()
        held, rows, scores_of = postings(listed.flatten().to_numpy(), np.diff(listed.offsets.to_numpy())), [], []
        asked = queries["wanted"].combine_chunks()
        for query in np.split(asked.flatten().to_numpy(), (asked.offsets.to_numpy() - asked.offsets[0].as_py())[1:-1]):
            scores = np.zeros(len(candidates), np.int64)
            for term in np.flatnonzero(query).tolist():
                if (posting := held.get(term)) is not None:
                    places, weights = posting
                    if places is None:
                        scores += query[term] * weights
                    else:
                        scores[places] += query[term] * weights
            rows.append(best(scores, k))
            scores_of.append(scores[rows[-1]])
        at = pa.array(np.concatenate(rows))
        of = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
        found = [queries["query"].take(of), candidates["id"].take(at), pa.array(np.concatenate(scores_of)), candidates["times"].take(at), candidates["part"].take(at)]
        return pa.Table.from_arrays(found, schema=FOUND)

    return run


def top(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, group_values: int = GROUP_VALUES, merged: int = MERGED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of the highest inner product with each query.

    is_query is a condition on column id (the id as a long). Candidates are all rows but the query's own; ties go to the
    smaller id, null ids last. Vectors that are null or hold null, NaN or infinity take no part;
    components beyond those of the shorter vector count as zero. A repeated row is a candidate for
    the others, and each repeated query has its rows; an empty table gives none. Other columns are ignored.
    """
    rows = integers(vectors, id_col=id_col, vector_col=vector_col, scale=scale)
    one = F.sha2(F.concat_ws(";", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.array_join("v", ",")), 256)
    once = written(rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("times")).withColumn("query", one), "vectors")  # equal rows are one from here on
    width, n_rows, n_queries = once.agg(F.max(F.size("v")), F.count(F.lit(1)), F.count_if(is_query)).first()
    each = max(1, group_values // max(1, width or 1))
    parts, sides = -(-n_rows // each) or 1, -(-(n_queries or 0) // each) or 1
    dealt = lambda n, seed: F.pmod(F.xxhash64("query", F.lit(seed)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = once.select("id", "v", "times", dealt(parts, 1).alias("part"), all_of(sides).alias("side"))
    queries = once.filter(is_query).select("query", F.col("v").alias("wanted"), dealt(sides, 2).alias("side"), all_of(parts).alias("part"))
    met = candidates.groupBy("part", "side").cogroup(queries.groupBy("part", "side")).applyInArrow(_best_of_groups(k + 1), "query string, id long, score long, times long, part int")
    order = F.desc("score"), F.col("id").asc_nulls_last()
    while parts > 1:
        met, parts = met.withColumn("part", F.floor(F.col("part") / merged).cast("int")), -(-parts // merged)
        met = met.withColumn("place", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).filter(F.col("place") <= k + 1).drop("place")
    # k + 1 rows hold the k wanted ones whether or not the query's own is among them
    own = once.filter(is_query).select("query", F.col("id").alias("query_id"), F.col("times").alias("asked"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("own"))
    found = met.join(own, "query").withColumn("itself", (F.col("id") == F.col("query_id")) & (F.col("score") == F.col("own")))
    taken = F.row_number().over(Window.partitionBy("query", "itself").orderBy("id"))
    others = found.withColumn("left", F.least(F.col("times") - F.when(F.col("itself") & (taken == 1), 1).otherwise(0), F.lit(k))).filter("left > 0")
    copies = others.select("query", "query_id", "asked", "id", "score", F.explode(F.sequence(F.lit(1), F.col("left").cast("int"))).alias("copy"))
    ranked = copies.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("asked").cast("int")))).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


TOP_SQL = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM kept q JOIN kept c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
