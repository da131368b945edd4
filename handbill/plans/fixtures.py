"""Posts, pages, OCR blocks and evidence derived from the given tables.

Each view is SQL that Spark and DuckDB both read, so that a query and its SQL start from
the same rows. {name} stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
_MONTH = "CASE month(d) WHEN 1 THEN 'января' WHEN 2 THEN 'февраля' WHEN 3 THEN 'марта' WHEN 4 THEN 'апреля' WHEN 5 THEN 'мая' WHEN 6 THEN 'июня' WHEN 7 THEN 'июля' WHEN 8 THEN 'августа' WHEN 9 THEN 'сентября' WHEN 10 THEN 'октября' WHEN 11 THEN 'ноября' ELSE 'декабря' END"
_DOTTED = "lpad(cast(day(d) as string), 2, '0') || '.' || lpad(cast(month(d) as string), 2, '0') || '.' || cast(year(d) as string)"
_CITY = "CASE channel_id % 4 WHEN 0 THEN 'Москва' WHEN 1 THEN 'Питер' WHEN 2 THEN 'Минск' ELSE 'Казань' END"
_URL = "'https://tickets.example/' || cast(post_id as string) || '/'"

VIEWS = {
    "dated": """
SELECT o_orderkey AS post_id, cast(c_nationkey as bigint) AS channel_id, c_name AS artist, o_totalprice AS price, o_orderpriority AS priority,
  cast(o_orderdate as date) AS published, cast(o_orderdate as date) + cast(o_orderkey % 40 as int) AS d,
  'src' || cast(c_nationkey % 7 as string) AS source
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "posts": f"""
SELECT post_id, channel_id, source, published, artist, d AS event_date,
  CASE post_id % 12
    WHEN 0 THEN artist || '\n\nДата: ' || {_DOTTED} || '\nМесто: Клуб ' || cast(post_id % 50 as string) || '\nдвери 19:00 / начало 20:00\n18+\nЦена: ' || cast(cast(floor(price) as bigint) as string) || ' руб\nБилеты: ' || {_URL}
    WHEN 1 THEN '★ ' || artist || '\n' || cast(day(d) as string) || ' ' || {_MONTH} || ' - ' || {_CITY} || '\nконцерт 19:30-22:00\nкупить билет ' || {_URL} || '?x=1'
    WHEN 2 THEN artist || ' и друзья\nс ' || cast(1 + post_id % 9 as string) || ' по ' || cast(12 + post_id % 9 as string) || ' ' || {_MONTH} || '\n' || {_CITY} || '\nпромокод: SALE' || cast(post_id % 100 as string)
    WHEN 3 THEN artist || '\nзавтра в клубе «Арена» — начало в 21:00\n16+\nвход свободный'
    WHEN 4 THEN 'Розыгрыш! ' || artist || '\nрепост и лайк\nhttps://vk.com/wall' || cast(post_id as string)
    WHEN 5 THEN 'Афиша недели\n' || {_DOTTED} || ' - ' || {_CITY} || '\n' || cast(day(d) as string) || ' ' || {_MONTH} || ' - Минск\n@club_chat чат тура'
    WHEN 6 THEN artist || ' tour\n' || {_CITY} || ': ' || {_URL} || '\nМинск: https://t.me/minsk' || cast(post_id as string) || '\n12-14 ' || {_MONTH}
    WHEN 7 THEN 'Концерт отменен\n' || artist || '\n' || {_DOTTED} || '\nвозврат билетов'
    WHEN 8 THEN 'спасибо'
    WHEN 9 THEN artist || '\nв эту пятницу\nVenue: Hall ' || cast(post_id % 9 as string) || '\nDoors: 18:00\nTickets: www.tickets.example/a' || cast(post_id as string)
    WHEN 10 THEN artist || '\n1, 2 и 3 ' || {_MONTH} || '\nsold out\n\n\n\nкаждую субботу в баре'
    ELSE '  ' || artist || '\t\tlive\nчерез 3 дня\nв начале ' || {_MONTH} || '\n' || {_CITY} || '\nкод: 12345'
  END AS text
FROM {{dated}}""",
    "lines": """
SELECT post_id, source, channel_id, published, pos, trim(line) AS line FROM {posts_split}
WHERE trim(line) <> ''""",
    "ocr_blocks": """
SELECT l_orderkey AS image_id, cast(l_linenumber as int) AS ordinal, CASE WHEN l_partkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS backend,
  CASE l_partkey % 6 WHEN 0 THEN '18+' WHEN 1 THEN '12.05' WHEN 2 THEN 'Mосква' WHEN 3 THEN 'Supplier#' || lpad(cast(l_suppkey as string), 9, '0') WHEN 4 THEN '...' ELSE 'KOHЦEPT live' END AS text,
  round(0.2 + l_discount * 7, 4) AS confidence,
  cast((l_partkey % 40) * 5 as int) AS x, cast((l_suppkey % 30) * 4 as int) AS y, cast(20 + l_quantity as int) AS w, cast(10 + l_linenumber * 2 as int) AS h,
  CASE l_partkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'text' ELSE 'unknown' END AS block_type, cast(l_partkey % 4 as int) AS n_lines
FROM {lineitem}""",
    "pages_read": """
SELECT o_orderkey AS run_id, cast(k as int) AS pos, 'https://' || CASE o_orderkey % 4 WHEN 0 THEN 'www.site' WHEN 1 THEN 'tickets.site' WHEN 2 THEN 't.me/site' ELSE 'fest' END || cast(c_nationkey as string) || '.example/p' || cast(o_orderkey as string) || '/' AS url,
  o_orderkey % 11 <> 0 AS ok, o_orderkey % 13 = 0 AS blocked, CASE o_orderkey % 7 WHEN 0 THEN 404 WHEN 1 THEN cast(null as int) ELSE 200 END AS status_code,
  'Концерт ' || c_name AS title,
  c_name || ' ' || CASE WHEN (o_orderkey + k) % 3 <> 0 THEN cast(day(cast(o_orderdate as date)) as string) || '.' || lpad(cast(month(cast(o_orderdate as date)) as string), 2, '0') || '.' || cast(year(cast(o_orderdate as date)) as string) ELSE 'скоро' END || ', Минск, Клуб ' || cast(o_orderkey % 50 as string) || CASE WHEN k = 2 THEN ' начало 20:00' ELSE '' END AS text
FROM {orders} JOIN {customer} ON o_custkey = c_custkey CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) AS two""",
    "v_occurrences": """
SELECT o_orderkey AS run_id, cast(0 as int) AS pos, c_name AS artist, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Минск' END AS city_name, 'Клуб ' || cast(o_orderkey % 50 as string) AS venue_name,
  CASE WHEN o_orderkey % 9 = 0 THEN cast(null as date) ELSE cast(o_orderdate as date) END AS event_date, CASE WHEN o_orderkey % 2 = 0 THEN '20:00' ELSE cast(null as string) END AS start_time,
  o_orderkey % 6 = 0 AS verified, cast(round((o_orderkey % 100) / 100.0, 2) as double) AS confidence, CASE WHEN o_orderkey % 6 = 0 THEN 'https://site.example/' ELSE '' END AS source_url
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "v_links": """
SELECT o_orderkey AS run_id, cast(k as int) AS pos, CASE WHEN k = 1 THEN 'https://' || CASE o_orderkey % 4 WHEN 0 THEN 'site' WHEN 1 THEN 'TICKETS.site' WHEN 2 THEN 't.me/site' ELSE 'other' END || cast(c_nationkey as string) || '.example/p' || cast(o_orderkey as string) ELSE 'https://vk.com/club' || cast(o_orderkey as string) END AS url,
  CASE (o_orderkey + k) % 3 WHEN 0 THEN 'ticket' WHEN 1 THEN 'official' ELSE 'social' END AS kind, o_orderkey % 4 = 1 AS verified, cast(round((o_orderkey % 90) / 100.0, 2) as double) AS confidence
FROM {orders} JOIN {customer} ON o_custkey = c_custkey CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) AS two""",
    "v_facts": """
SELECT o_orderkey AS run_id, cast(k as int) AS pos, CASE k WHEN 1 THEN 'artist' WHEN 2 THEN 'дата' WHEN 3 THEN 'venue' ELSE 'price' END AS field,
  CASE k WHEN 1 THEN c_name WHEN 2 THEN cast(cast(o_orderdate as date) as string) WHEN 3 THEN 'Клуб ' || cast(o_orderkey % 50 as string) ELSE cast(o_orderkey % 1000 as string) END AS value,
  CASE (o_orderkey + k) % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' ELSE 'conflicted' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'official_site' WHEN 1 THEN 'search' WHEN 2 THEN 'manual' ELSE 'user' END AS source_type,
  cast(round(((o_orderkey + k) % 100) / 100.0, 2) as double) AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'https://site' || cast(c_nationkey as string) || '.example/' END AS source_url
FROM {orders} JOIN {customer} ON o_custkey = c_custkey CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS four""",
}
#: The one view whose SQL differs: a row for each line.
SPLIT = {"spark": "SELECT *, pos, line FROM {posts} LATERAL VIEW posexplode(split(text, '\\n')) AS pos, line", "duckdb": "SELECT *, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) AS pos, unnest(string_split(text, chr(10))) AS line FROM {posts}"}


def _needs(sql: str) -> list[str]:
    known = {*TABLES, *VIEWS, "posts_split"}
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n in known]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SPLIT["spark"] if name == "posts_split" else VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _needs(sql)})


def plain(df: DataFrame) -> DataFrame:
    """df with dates as ISO text, which reads the same from either engine."""
    return df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "date"})


def with_views(sql: str) -> str:
    """DuckDB SQL whose {name}s are tables or views, as one statement that defines the views it needs."""
    defined: dict[str, str] = {}

    def define(text: str) -> str:
        for n in _needs(text):
            if n not in TABLES and n not in defined:
                body = define(SPLIT["duckdb"] if n == "posts_split" else VIEWS[n])
                defined[n] = body
            text = text.replace("{" + n + "}", n)
        return text

    main = define(sql)
    if not defined:
        return main
    views = ", ".join(f"{n} AS ({body})" for n, body in defined.items())
    head, rest = ("WITH " + views + ", ", main.strip()[5:]) if main.strip().upper().startswith("WITH ") else ("WITH " + views + " ", main)
    return head + rest
