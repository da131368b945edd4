"""Every query with SQL gives DuckDB's rows on the smallest data; entry() and the registry hold together."""

import duckdb
import pytest

import __spark_entry__
from handbill import registry
from handbill.plans.fixtures import TABLES

FEW = ["n6_line_dedupe", "n11_url_keys", "x10_explicit_ranges", "f2_message_kinds", "r20_a11_a14_w4_fused_blocks", "j8_links_by_domain", "r14_raw_decisions", "s17_s18_upsert", "w9_text_deltas", "j21_context_rows", "x41_j18_descriptions", "r9_input_fields", "r18_nested_results", "s10_written_csv", "j9_links_by_page_facts", "n15_chunks", "x30_labelled_artists"]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(str(tuple(round(v[k], 6) if isinstance(v[k], float) else v[k] for k in order)) for v in values)


@pytest.mark.parametrize("name", FEW)
def test_equals_sql(spark, small, duck, name):
    found = registry.queries()[name](spark, small)
    want = duck.execute(registry.oracle_sql()[name])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and "total" in found.columns


def test_text_evidence_reads_each_rule_once(spark, small):
    """the plan of the evidence held 232 searches, as every field carried those of the fields it is made of."""
    from handbill.operators import inputs
    from handbill.queries_inputs import texts

    plan = inputs.wide(texts(spark, small))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 8


def test_search_keys(spark):
    """words of letters and digits joined by one blank, as a replacement of all else gives them."""
    from pyspark.sql import functions as F

    from handbill.functions import text as t

    said = ["", None, "  Ёлка—ёж, 12.05!  ", "a", "---", "https://x.y/é?z", "ÀB\nc\td e"]
    old = F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce("v", F.lit(""))), "ё", "е"), "[^0-9a-zа-я]+", " "))
    rows = spark.createDataFrame([(v,) for v in said], "v string").select(t.search_key(F.col("v")).alias("new"), old.alias("old")).collect()
    assert all(r.new == r.old for r in rows)


def test_reports_compute_what_they_read(spark, small):
    """drafts of the wanted fields alone, and the same ones."""
    from handbill.operators import posts as p
    from handbill.plans.fixtures import view

    few = p.drafts(view(spark, small, "posts").limit(200), None, ("kind", "warnings"))
    assert few.columns == ["kind", "warnings"] and few.count() == 200
