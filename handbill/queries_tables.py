"""Queries over the given tables: text cleaning, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import fields
from .functions import text as t
from .operators import reports
from .plans.fixtures import plain, view, with_views
from .plans.shared import new_folder
from .streaming import jobs

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under the name."""

    def add(f):
        QUERIES[name] = lambda spark, d: plain(f(spark, d))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


# Patterns that both engines read alike.
_EDGE = r"^[\s]+|[\s]+$"
_LINES = r"SELECT doc_id, cast(generate_subscripts(string_split(n, chr(10)), 1) - 1 AS int) AS pos, unnest(string_split(n, chr(10))) AS raw FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), chr(160) || chr(8203) || chr(65279), ' '), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '([A-Za-z])(\d{1,2}\s+[А-Яа-яЁё])', '\1 \2', 'g'), '([A-Za-z])(\d{1,2}[./]\d{1,2}(?:[./]\d{2,4})?)', '\1 \2', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS n FROM documents)"


@query("n5_normal_text", r"SELECT doc_id, length(n) AS n_chars, sha256(n) AS text_sha256 FROM (SELECT doc_id, regexp_replace(string_agg(raw, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS n FROM (" + _LINES + ") GROUP BY doc_id)")
def _(spark, d):
    n = t.normal_text(F.col("text"))
    return view(spark, d, "documents").select("doc_id", n.alias("n")).select("doc_id", F.length("n").cast("long").alias("n_chars"), F.sha2("n", 256).alias("text_sha256"))


@query("n6_line_dedupe", r"WITH l AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(trim(raw), '[–—−]', '-', 'g'), '[«»„“”]', '" + '"' + r"', 'g'), '\s+', ' ', 'g')) AS line, doc_id FROM (" + _LINES + ") x) SELECT sha256(line) AS line_sha256, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE line <> '' GROUP BY line HAVING count(*) > 1")
def _(spark, d):
    """Lines that stand more than once, with how often and in how many documents; only their hashes are shuffled."""
    lines = view(spark, d, "documents").select("doc_id", F.explode(F.split(t.normal_text(F.col("text")), "\n")).alias("raw"))
    held = lines.filter(F.col("raw").rlike(r"[^\s\x{85}\x{a0}]")).select("doc_id", F.sha2(t.normal_line(F.col("raw")), 256).alias("line_sha256"))
    per_doc = held.groupBy("line_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("line_sha256").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).filter("n > 1")


_KEY = r"lower(trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(trim(line), '^[^\p{L}\p{N}_]{1,4}\s*', ''), '^[\s\-–—•*|:;,.]+|[\s\-–—•*|:;,]+$', '', 'g'), '\s+', ' ', 'g')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')))"


@query("n7_n8_entity_keys", "SELECT post_id, pos, " + _KEY + " AS key FROM {lines}")
def _(spark, d):
    return view(spark, d, "lines").select("post_id", "pos", t.entity_key(F.col("line")).alias("key"))


_CITY = "CASE " + " ".join(f"WHEN k = '{a}' THEN '{c}'" for a, c in t.CITY_ALIASES.items())


@query("n9_city_names", f"SELECT line_city AS raw, {_CITY} ELSE raw END AS city, n FROM (SELECT raw AS line_city, raw, lower(raw) AS k, count(*) AS n FROM (SELECT CASE channel_id % 5 WHEN 0 THEN 'Питер' WHEN 1 THEN 'СПБ' WHEN 2 THEN 'москва' WHEN 3 THEN 'Казань' ELSE 'Минск' END AS raw FROM {{posts}}) GROUP BY raw)")
def _(spark, d):
    raw = F.expr("CASE channel_id % 5 WHEN 0 THEN 'Питер' WHEN 1 THEN 'СПБ' WHEN 2 THEN 'москва' WHEN 3 THEN 'Казань' ELSE 'Минск' END")
    return view(spark, d, "posts").select(raw.alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", t.city_name(F.col("raw")).alias("city"), "n")


@query("n10_ordered_dedupe", "WITH w AS (SELECT conv_id, turn, text, lower(text) AS k, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn) AS n FROM conversations WHERE trim(coalesce(text, '')) <> '') SELECT conv_id, count(*) AS kept, sha256(string_agg(text, '|' ORDER BY turn)) AS texts_sha256 FROM w WHERE n = 1 GROUP BY conv_id")
def _(spark, d):
    """The distinct texts of a conversation in order, the first of equal ones."""
    first = view(spark, d, "conversations").filter(t.blank_to_null(F.col("text")).isNotNull()).groupBy("conv_id", F.lower("text").alias("k")).agg(F.min(F.struct("turn", "text")).alias("m"))
    kept = first.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return kept.select("conv_id", F.size("m").cast("long").alias("kept"), F.sha2(F.array_join(F.transform("m", lambda x: x["text"]), "|"), 256).alias("texts_sha256"))


_UN = "replace({0}, '&amp;', '&')"
for _n, _c in reversed([(n, c) for n, c in t.ENTITIES.items() if n != "amp"]):
    _UN = _UN.replace("{0}", f"replace({{0}}, '&{_n};', '{_c.replace(chr(39), chr(39) * 2)}')")
_SQ = r"trim(regexp_replace({0}, '[\s\x{85}\x{a0}]+', ' ', 'g'))"


@query("n2_s16_pages", "SELECT page_id, url, nullif(" + _SQ.replace("{0}", _UN.replace("{0}", r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")) + ", '') AS title, length(v) AS n_chars, CASE WHEN length(v) <= 200 THEN v ELSE rtrim(left(v, 200)) || '...' END AS preview FROM (SELECT *, " + _SQ.replace("{0}", _UN.replace("{0}", r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<noscript\b.*?</noscript>', ' ', 'g'), '(?is)<svg\b.*?</svg>', ' ', 'g'), '(?is)<title\b.*?</title>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')")) + " AS v FROM pages)")
def _(spark, d):
    v = t.page_text(F.col("html"))
    return view(spark, d, "pages").select("page_id", "url", t.page_title(F.col("html")).alias("title"), v.alias("v")).select("page_id", "url", "title", F.length("v").cast("long").alias("n_chars"), t.preview(F.col("v"), 200).alias("preview"))


@query("n3_antibot", "SELECT page_id, regexp_matches(lower(url), 'captcha|challenge') OR regexp_matches(lower(html), '" + "|".join(m.replace("?", "\\?") for m in t.ANTIBOT_MARKERS) + "') AS blocked FROM pages")
def _(spark, d):
    return view(spark, d, "pages").select("page_id", t.is_antibot(F.col("url"), F.lit(""), F.col("html")).alias("blocked"))


@query("n4_charset", "SELECT page_id, coalesce(nullif(regexp_extract(lower(html), 'charset=[\"'']?([a-z0-9_\\-]+)', 1), ''), 'utf-8') AS charset FROM pages")
def _(spark, d):
    return view(spark, d, "pages").select("page_id", t.charset(F.col("html")).alias("charset"))


_HREF = """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages"""
_ABS = r"'^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#\s]*)'"


@query("n11_url_keys", f"SELECT page_id, href, CASE WHEN regexp_extract(href, {_ABS}, 2) <> '' THEN lower(regexp_extract(href, {_ABS}, 1)) || '://' || lower(regexp_extract(href, {_ABS}, 2)) || regexp_replace(regexp_extract(href, {_ABS}, 3), '/+$', '') ELSE regexp_replace(trim(href), '/+$', '') END AS url_key, regexp_replace(lower(trim(href)), '/+$', '') AS loose_key FROM (SELECT DISTINCT * FROM ({_HREF}) h) g")
def _(spark, d):
    href = view(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    return href.select("page_id", "href", t.url_key(F.col("href")).alias("url_key"), t.url_loose_key(F.col("href")).alias("loose_key"))


@query("n12_readable_urls", f"SELECT page_id, full_url AS url, regexp_replace(regexp_replace(lower(regexp_extract(full_url, {_ABS}, 2)), ':[0-9]+$', ''), '^www\\.', '') AS domain FROM (SELECT page_id, CASE WHEN regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN trim(url) ELSE 'https://' || trim(url) END AS full_url FROM pages WHERE trim(url) <> '') WHERE lower(regexp_extract(full_url, {_ABS}, 1)) IN ('http', 'https') AND contains(regexp_extract(full_url, {_ABS}, 2), '.')")
def _(spark, d):
    read = view(spark, d, "pages").select("page_id", t.readable_url(F.col("url")).alias("url")).filter("url is not null")
    return read.select("page_id", "url", t.url_domain(F.col("url")).alias("domain"))


_SEARCH = "trim(regexp_replace(translate(lower({0}), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g'))"


@query("n13_n14_search_keys", "SELECT run_id, pos, " + _SEARCH.replace("{0}", "concat_ws(' ', url, title, text)") + " AS hay FROM {pages_read}")
def _(spark, d):
    return view(spark, d, "pages_read").select("run_id", "pos", t.search_key(F.concat_ws(" ", "url", "title", "text")).alias("hay"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CUT = "CASE WHEN length(rest) <= 2000 THEN length(rest) " + " ".join(f"WHEN length(regexp_extract(left(rest, 2000), '(?s)^(.*){mark}', 1)) > 1000 THEN length(regexp_extract(left(rest, 2000), '(?s)^(.*){mark}', 1)) + {kept}" for mark, kept in ((r"\n", 0), (r"\. ", 1), (", ", 1), (" ", 0))) + " ELSE 2000 END"


@query("n15_chunks", f"WITH RECURSIVE c AS (SELECT doc_id, -1 AS part, '' AS chunk, trim(text, {_WS}) AS rest FROM documents UNION ALL SELECT doc_id, part + 1, trim(left(rest, e), {_WS}), trim(substr(rest, e + 1), {_WS}) FROM (SELECT *, {_CUT} AS e FROM c WHERE rest <> '') q) SELECT doc_id, part, chunk FROM c WHERE part >= 0")
def _(spark, d):
    """Every document in pieces of at most 2000 characters; joined by blanks they are the text, blanks aside."""
    return view(spark, d, "documents").select("doc_id", F.posexplode(t.chunks(t.text_or_empty(F.col("text")), F.lit(2000))).alias("part", "chunk"))


@query("n16_parts", "SELECT conv_id, turn, 'Part ' || row_number() OVER w || '/' || count(*) OVER (PARTITION BY conv_id) || chr(10) || coalesce(text, '') AS part FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id")
    return view(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("Part "), F.row_number().over(by.orderBy("turn")), F.lit("/"), F.count(F.lit(1)).over(by), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("part"))


@query("n17_previews", "SELECT doc_id, CASE WHEN length(text) <= 3500 THEN text ELSE left(text, 3500) || '…' END AS preview FROM documents")
def _(spark, d):
    return view(spark, d, "documents").select("doc_id", F.when(F.length("text") <= 3500, F.col("text")).otherwise(F.concat(F.left("text", F.lit(3500)), F.lit("…"))).alias("preview"))


@query("n18_scripts", "SELECT script, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(w, '[А-Яа-яЁё]') AND regexp_matches(w, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(w, '[А-Яа-яЁё]') THEN 'cyrillic' WHEN regexp_matches(w, '[A-Za-z]') THEN 'latin' WHEN regexp_matches(w, '[0-9]') THEN 'numeric' ELSE 'unknown' END AS script FROM (SELECT unnest(string_split(line, ' ')) AS w FROM {lines}) WHERE w <> '') GROUP BY script")
def _(spark, d):
    words = view(spark, d, "lines").select(F.explode(F.split("line", " ")).alias("w")).filter("w <> ''")
    return words.groupBy(t.script(F.col("w")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query("n21_lookalike_keys", "SELECT image_id, ordinal, translate(lower(text), '" + "".join(t.LOOKALIKES) + "', '" + "".join(t.LOOKALIKES.values()) + "') AS key FROM {ocr_blocks}")
def _(spark, d):
    return view(spark, d, "ocr_blocks").select("image_id", "ordinal", t.lookalike_key(F.col("text")).alias("key"))


@query("n22_ocr_text", r"SELECT image_id, ordinal, trim(regexp_replace(regexp_replace(replace(text, chr(13), ''), '\s{2,}', ' ', 'g'), '[^\p{L}\p{N}_\s.:+\-]', '', 'g')) AS text FROM {ocr_blocks}")
def _(spark, d):
    return view(spark, d, "ocr_blocks").select("image_id", "ordinal", t.ocr_text(F.col("text")).alias("text"))


@query("n24_json_objects", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM (SELECT event_id, props FROM events)")
def _(spark, d):
    """The JSON object of each event, cut out of the text around it."""
    text = F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))
    return view(spark, d, "events").select("event_id", F.get_json_object(t.balanced_object(text), "$.k").alias("k"))


@query("n26_without_urls", r"SELECT post_id, pos, trim(regexp_replace(regexp_replace(line, '(?i)(?:https?://|www\.|t\.me/|vk\.com/)[^\s<>()]+', ' ', 'g'), '\s+', ' ', 'g')) AS line FROM {lines}")
def _(spark, d):
    return view(spark, d, "lines").select("post_id", "pos", t.without_urls(F.col("line")).alias("line"))


@query("n27_notes", "SELECT run_id, pos, CASE WHEN contains(x, 'checked') THEN x ELSE concat_ws(' ', nullif(trim(x), ''), 'checked') END AS explanation FROM (SELECT run_id, pos, CASE run_id % 3 WHEN 0 THEN 'was checked' WHEN 1 THEN '' ELSE status END AS x FROM {v_facts})")
def _(spark, d):
    x = F.expr("CASE run_id % 3 WHEN 0 THEN 'was checked' WHEN 1 THEN '' ELSE status END")
    return view(spark, d, "v_facts").select("run_id", "pos", t.with_note(x, F.lit("checked")).alias("explanation"))


@query("f4_narrative_lines", r"SELECT doc_id, count(*) AS n_lines, count(*) FILTER ((words >= 8 AND letters >= 25) OR (sentences >= 2 AND letters >= 20)) AS narrative FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '')) AS words, length(regexp_replace(line, '[^\p{L}]', '', 'g')) AS letters, len(list_filter(regexp_split_to_array(line, '[.!?]+'), lambda x: trim(x) <> '')) AS sentences FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY doc_id")
def _(spark, d):
    lines = view(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(fields.is_narrative(F.col("line"))).alias("narrative"))


@query("f10_sql_lint", r"SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN q = '' THEN 'empty' END, CASE WHEN q <> '' AND NOT regexp_matches(q, '^(?:select|with)\b') THEN 'prefix' END, CASE WHEN regexp_matches(q, '\b(?:insert|update|delete|drop|alter|truncate|create|grant)\b') THEN 'forbidden_word' END, CASE WHEN regexp_matches(q, '^select\b') AND NOT regexp_matches(q, '\blimit\b') THEN 'no_limit' END], lambda x: x IS NOT NULL), ',') AS errors FROM (SELECT conv_id, turn, lower(trim(CASE turn % 4 WHEN 0 THEN 'SELECT a FROM t LIMIT 5' WHEN 1 THEN 'select * from t' WHEN 2 THEN 'DROP TABLE t' ELSE text END)) AS q FROM conversations)")
def _(spark, d):
    q = F.expr("CASE turn % 4 WHEN 0 THEN 'SELECT a FROM t LIMIT 5' WHEN 1 THEN 'select * from t' WHEN 2 THEN 'DROP TABLE t' ELSE text END")
    return view(spark, d, "conversations").select("conv_id", "turn", F.array_join(fields.lint_sql(q), ",").alias("errors"))


@query("f11_domain_check", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY event_type")
def _(spark, d):
    """Rows whose type is in an allowed domain, by a semi join on the domain's table."""
    domain = spark.createDataFrame([("click",), ("view",), ("purchase",)], "event_type string")
    return view(spark, d, "events").join(F.broadcast(domain), "event_type", "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("w1_last_messages", "SELECT conv_id, turn, role, back FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3")
def _(spark, d):
    return reports.last_messages(view(spark, d, "conversations"), 3).select("conv_id", "turn", "role", "back")


@query("l4_bounded_history", "SELECT conv_id, turn, role, sha256(text) AS text_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3")
def _(spark, d):
    """The last three turns of each conversation, kept as state while its turns arrive in four batches, the last ones in the second."""
    messages, folder = view(spark, d, "conversations"), new_folder(spark, "history")
    for batch in (2, 3, 0, 1):
        messages.filter(F.col("turn") % 4 == batch).write.mode("append").parquet(f"{folder}/arrived")
        jobs.keep_history(spark.readStream.schema(messages.schema).parquet(f"{folder}/arrived"), folder, keep=3)
    return jobs.stored_history(spark, folder).select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


@query("w8_listing", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 20")
def _(spark, d):
    return reports.listing(view(spark, d, "orders"), "o_orderkey", filters=(F.col("o_orderstatus") == "F",), limit=50, offset=20).select("o_orderkey", "o_orderstatus")


@query("w9_text_deltas", "WITH v AS (SELECT conv_id, turn * 3 + k AS seq, CASE k WHEN 0 THEN left(t, length(t) // 2) WHEN 1 THEN t ELSE '~' || t END AS t FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), range(3) AS r(k)), w AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY seq) AS b FROM v) SELECT conv_id AS key, seq, CASE WHEN b IS NOT NULL AND starts_with(t, b) THEN substr(t, length(b) + 1) ELSE t END AS delta FROM w")
def _(spark, d):
    """What each version of a turn's text adds to the one before: its first half, the whole, and another text."""
    text = F.coalesce("text", F.lit(""))
    half = F.left(text, F.floor(F.length(text) / 2).cast("int"))
    versions = view(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.array(half, text, F.concat(F.lit("~"), text))).alias("k", "text"))
    return reports.text_deltas(versions.select(F.col("conv_id").alias("key"), (F.col("turn") * 3 + F.col("k")).alias("seq"), "text"), block=8)


@query("w10_repeated_calls", "SELECT user_id AS run, event_id AS step, nth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS nth FROM events) WHERE nth > 1")
def _(spark, d):
    calls = view(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("tool"), F.col("props").alias("args"), F.col("event_id").alias("step"))
    return reports.repeated_calls(calls).select("run", "step", "nth")


@query("a19_l7_event_rollup", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS name, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY ALL")
def _(spark, d):
    events = view(spark, d, "events").withColumnRenamed("event_type", "name")
    rolled = reports.event_rollup(events, "1 hour")
    return rolled.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "name", "n", F.round("total", 4).alias("total"), "most")


@query("l2_sessions", "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 21600 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id AS key, session::BIGINT AS session, count(*) AS n FROM s GROUP BY ALL")
def _(spark, d):
    events = view(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return reports.sessions(events, 21600).groupBy("key", F.col("session").cast("long").alias("session")).agg(F.count(F.lit(1)).alias("n"))


@query("l2_bursts", "WITH g AS (SELECT user_id, ts, event_id, event_type, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 3600 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id AS key, count(*) AS n, string_agg(event_type, chr(10) || chr(10) ORDER BY event_id) AS text FROM s GROUP BY user_id, session")
def _(spark, d):
    events = view(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("text"))
    return reports.bursts(events.unionByName(events), 3600).select("key", "n", "text")


@query("l3_once_each", "SELECT user_id AS key, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_id, event_type FROM events) GROUP BY ALL")
def _(spark, d):
    events = view(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "event_type")
    return events.unionByName(events).dropDuplicates(["key", "event_id"]).groupBy("key", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("l5_unexpired", "SELECT event_type, count(*) AS n FROM events WHERE ts + INTERVAL 10 DAY > (SELECT max(ts) FROM events) GROUP BY event_type")
def _(spark, d):
    events = view(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    held = events.withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 10 DAY")).crossJoin(F.broadcast(now))
    return reports.unexpired(held, F.col("now")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("l6_f12_released", "SELECT e.event_id, e.user_id AS key FROM events e JOIN (SELECT user_id, min(event_id) + 5 AS after_id FROM events WHERE event_type = 'click' GROUP BY user_id) c ON e.user_id = c.user_id WHERE e.event_id > after_id")
def _(spark, d):
    events = view(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "event_type")
    cutoffs = events.filter("event_type = 'click'").groupBy("key").agg((F.min("id") + 5).alias("after_id"))
    return reports.released(events, cutoffs).select(F.col("id").alias("event_id"), "key")


@query("s17_s18_upsert", "WITH c AS (SELECT l_orderkey AS k, max(l_linenumber) AS v, arg_max(l_quantity, l_linenumber) AS q, arg_max(l_returnflag, l_linenumber) = 'R' AS gone FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS k, o_totalprice AS q FROM orders WHERE o_orderkey NOT IN (SELECT k FROM c) UNION ALL SELECT k, q FROM c WHERE NOT gone")
def _(spark, d):
    """Orders after a change table: the newest line of an order replaces it, a returned one deletes it; of lines of one number the first in the table counts."""
    current = view(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("q"))
    changes = view(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"), "l_linenumber", (F.col("l_returnflag") == "R").alias("deleted"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return reports.upsert(current, changes, "k", "l_linenumber", place=("file", "row"))


@query("j19_j20_work_list", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def _(spark, d):
    """Documents whose content has no stored result yet; results are kept for two thirds of them less."""
    keyed = view(spark, d, "documents").select("doc_id", reports.content_key(F.col("text")).alias("content_key"))
    return reports.work_list(keyed, keyed.filter("doc_id % 3 = 0")).select("doc_id")


@query("j21_context_rows", "WITH w AS (SELECT DISTINCT conv_id, turn, unnest(string_split(lower(text), ' ')) AS w FROM conversations), p AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark), m AS (SELECT conv_id, turn, item_id, count(*) AS hits FROM w JOIN (SELECT DISTINCT * FROM p) USING (w) WHERE length(w) >= 6 GROUP BY ALL) SELECT conv_id, turn, item_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hits DESC, item_id) AS n FROM m) WHERE n <= 20")
def _(spark, d):
    """At most 20 known entities for each message, by shared words."""
    messages = view(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("message"), "text")
    return reports.context_rows(messages, view(spark, d, "benchmark")).select("message.*", "item_id", "hits")


@query("a15_page_counts", "SELECT count(*) AS total, count(*) FILTER (ok AND NOT blocked AND (status_code IS NULL OR status_code BETWEEN 200 AND 399)) AS usable, count(*) FILTER (blocked) AS blocked FROM {pages_read}")
def _(spark, d):
    good = F.col("ok") & ~F.col("blocked") & (F.col("status_code").isNull() | F.col("status_code").between(200, 399))
    return view(spark, d, "pages_read").agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("usable"), F.count_if("blocked").alias("blocked"))


@query("a1_label_completeness", "SELECT source, count(*) AS total, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def _(spark, d):
    joined = view(spark, d, "documents").join(view(spark, d, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
