"""Queries over OCR blocks, and over drafts, links, facts and pages to be verified."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as t
from .operators import ocr, phrases, render, verify
from .operators.posts import once
from .plans.fixtures import plain, view, with_views
from .plans.shared import new_folder
from .sources import chat, sinks

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under the name."""

    def add(f):
        QUERIES[name] = lambda spark, d: plain(f(spark, d))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def tables(spark, d, *names: str):
    return [view(spark, d, n) for n in names]


# OCR blocks

_GOOD = r"SELECT * FROM {ocr_blocks} WHERE length(trim(text)) >= 2 AND confidence >= 0.3 AND regexp_matches(trim(text), '[\p{L}\p{N}]')"
_PAIRS = f"SELECT a.image_id, a.ordinal AS a, b.ordinal AS b FROM ({_GOOD}) a JOIN ({_GOOD}) b ON a.image_id = b.image_id AND a.ordinal < b.ordinal WHERE greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / (a.w * a.h + b.w * b.h - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))::DOUBLE >= 0.35 OR greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) >= 0.8 * least(a.w * a.h, b.w * b.h)"
#: Groups by repeated steps to the smallest neighbour; an image has 7 blocks at most, so 6 steps reach everything.
_STEPS = "e AS (SELECT image_id, a AS u, b AS v FROM pairs UNION ALL SELECT image_id, b, a FROM pairs), g0 AS (SELECT image_id, ordinal, ordinal AS label FROM good)" + "".join(f", g{k + 1} AS (SELECT g.image_id, g.ordinal, least(g.label, coalesce(min(n.label), g.label)) AS label FROM g{k} g LEFT JOIN e ON e.image_id = g.image_id AND e.u = g.ordinal LEFT JOIN g{k} n ON n.image_id = e.image_id AND n.ordinal = e.v GROUP BY g.image_id, g.ordinal, g.label)" for k in range(6))
_GROUPED = f"WITH good AS ({_GOOD}), pairs AS ({_PAIRS}), {_STEPS}, grouped AS (SELECT good.*, g6.label AS group_id FROM good JOIN g6 USING (image_id, ordinal)) "


def good_blocks(spark, d):
    return ocr.accepted(view(spark, d, "ocr_blocks"))


def grouped_blocks(spark, d):
    good = good_blocks(spark, d)
    return ocr.overlap_groups(good, ocr.overlaps(good))


@query("f5_accepted_blocks", f"SELECT image_id, ordinal FROM ({_GOOD}) q")
def _(spark, d):
    return good_blocks(spark, d).select("image_id", "ordinal")


@query("j14_overlaps", _PAIRS)
def _(spark, d):
    return ocr.overlaps(good_blocks(spark, d))


@query("j15_overlap_groups", _GROUPED + "SELECT image_id, ordinal, group_id FROM grouped")
def _(spark, d):
    return grouped_blocks(spark, d).select("image_id", "ordinal", "group_id")


_SCORE = "round(confidence + CASE WHEN n_lines > 0 THEN 0.05 ELSE 0.0 END + least(length(text) / 1000.0, 0.05), 6)"
_FUSED = _GROUPED + f", best AS (SELECT *, row_number() OVER (PARTITION BY image_id, group_id ORDER BY {_SCORE} DESC, n_lines > 0 DESC, length(text) DESC, backend DESC, y, x, ordinal) AS n FROM grouped), types AS (SELECT image_id, group_id, block_type, row_number() OVER (PARTITION BY image_id, group_id ORDER BY count(*) DESC, block_type DESC) AS n FROM grouped WHERE block_type <> 'unknown' GROUP BY image_id, group_id, block_type), fused AS (SELECT b.image_id, b.group_id, b.text, b.x, b.y, s.confidence, s.n_blocks, s.source, coalesce(t.block_type, 'unknown') AS block_type, row_number() OVER (PARTITION BY b.image_id ORDER BY b.y, b.x, b.group_id) - 1 AS reading_order FROM best b JOIN (SELECT image_id, group_id, max(confidence) AS confidence, count(*) AS n_blocks, 'fusion:' || string_agg(DISTINCT backend, ',' ORDER BY backend) AS source FROM grouped GROUP BY image_id, group_id) s USING (image_id, group_id) LEFT JOIN (SELECT * FROM types WHERE n = 1) t ON t.image_id = b.image_id AND t.group_id = b.group_id WHERE b.n = 1) "


@query("r20_a11_a14_w4_fused_blocks", _FUSED + "SELECT image_id, group_id, text, confidence, n_blocks, source, block_type, reading_order FROM fused")
def _(spark, d):
    return ocr.fuse(grouped_blocks(spark, d)).select("image_id", "group_id", "text", "confidence", "n_blocks", "source", "block_type", "reading_order")


@query("a9_a10_image_texts", _FUSED + "SELECT image_id, string_agg(text, chr(10) ORDER BY reading_order) AS raw_text, max(confidence) AS confidence, round(avg(confidence), 6) AS mean_confidence, count(*) AS n_blocks FROM fused GROUP BY image_id")
def _(spark, d):
    return ocr.image_text(ocr.fuse(grouped_blocks(spark, d)))


@query("a12_richest_blocks", _GROUPED + "SELECT image_id, group_id, arg_max(ordinal, n_lines * 1000000 + confidence * 1000 - ordinal / 100.0) AS richest FROM grouped GROUP BY image_id, group_id")
def _(spark, d):
    return ocr.fuse(grouped_blocks(spark, d)).select("image_id", "group_id", "richest")


@query("r19_evidence_rows", _FUSED + "SELECT kind, count(*) AS n FROM (SELECT 'block' AS kind FROM fused UNION ALL SELECT 'raw_text' FROM (SELECT DISTINCT image_id FROM fused) a UNION ALL SELECT 'normal_text' FROM (SELECT DISTINCT image_id FROM fused) b) q GROUP BY kind")
def _(spark, d):
    fused = ocr.fuse(grouped_blocks(spark, d))
    return ocr.evidence(ocr.image_text(fused), fused).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("w5_n23_line_text", "WITH g AS (SELECT image_id, x, y, text, x - lag(x + w) OVER o AS gap, greatest(length(text), length(lag(text) OVER o)) AS longest, row_number() OVER o AS n FROM {ocr_blocks} WINDOW o AS (PARTITION BY image_id ORDER BY x, y, text, w)) SELECT image_id, string_agg(CASE WHEN gap IS NULL OR gap <= CASE WHEN longest <= 1 THEN 28 WHEN longest <= 2 THEN 18 ELSE 6 END THEN text ELSE ' ' || text END, '' ORDER BY n) AS text FROM g GROUP BY image_id")
def _(spark, d):
    words = view(spark, d, "ocr_blocks").withColumn("line", F.lit(0))
    return ocr.line_text(words).select("image_id", "text")


def tokens(spark, d):
    return view(spark, d, "ocr_blocks").select(F.explode(F.split("text", " ")).alias("token")).filter("token rlike '^[A-Za-zА-Яа-я]+$'").distinct()


@query("n19_token_variants")
def _(spark, d):
    return ocr.token_variants(tokens(spark, d))


@query("n20_repaired_tokens")
def _(spark, d):
    return ocr.repaired(tokens(spark, d))


def entities(spark, d):
    return view(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.lit("artist").alias("entity_type"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("Supp "), F.col("s_suppkey").cast("string"))).alias("aliases"))


def block_texts(spark, d):
    return view(spark, d, "ocr_blocks").select(F.concat_ws("/", "image_id", "ordinal", "text").alias("text_id"), "text").distinct()


@query("j2_exact_names", "SELECT DISTINCT image_id || '/' || ordinal || '/' || text AS text_id, s_name AS name, s_suppkey AS entity_id FROM {ocr_blocks} JOIN supplier ON lower(replace(text, ' ', '')) = lower(replace(s_name, ' ', ''))")
def _(spark, d):
    return ocr.exact_names(block_texts(spark, d), entities(spark, d))


@query("j3_j4_fuzzy_names")
def _(spark, d):
    """The nearest name of each distinct block text, over the threshold."""
    texts = view(spark, d, "ocr_blocks").select(F.col("text").alias("text_id"), "text").distinct()
    return ocr.fuzzy_names(texts, entities(spark, d), 0.8)


@query("f13_block_classes")
def _(spark, d):
    texts = view(spark, d, "ocr_blocks").select(F.col("text").alias("text_id"), "text").distinct()
    return ocr.classified(texts, entities(spark, d))


@query("j4_phrases")
def _(spark, d):
    """Each recognised text as the phrase of a dictionary of nations, names and aliases that it is most similar to; some names are misread."""
    texts = block_texts(spark, d).withColumn("text", F.when(F.col("text").rlike("^Supplier#\\d+0$"), F.replace("text", F.lit("pp"), F.lit("p"))).otherwise(F.col("text")))
    held = phrases.matched(texts, ocr.dictionary(view(spark, d, "nation").select(F.col("n_name").alias("text")), entities(spark, d)))
    return held.select("text_id", "phrase", "score")


@query("a17_dictionary", "SELECT count(*) AS n, count(DISTINCT lower(phrase)) AS keys FROM (SELECT arg_min(phrase, r || phrase) AS phrase FROM (SELECT trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS phrase, '0' AS r FROM documents UNION ALL SELECT s_name, '1' FROM supplier UNION ALL SELECT 'Supp ' || s_suppkey, '1' FROM supplier) q WHERE phrase <> '' GROUP BY lower(phrase)) z")
def _(spark, d):
    made = ocr.dictionary(view(spark, d, "documents").select("text"), entities(spark, d))
    return made.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower("phrase")).alias("keys"))


def backend_results(spark, d):
    return view(spark, d, "ocr_blocks").groupBy("image_id", "backend").agg(F.array_join(F.collect_list("text"), " ").alias("raw_text"), F.count(F.lit(1)).alias("n_blocks")).withColumn("error", F.expr("CASE WHEN image_id % 5 = 0 AND backend = 'alpha' THEN 'timeout' END"))


_RESULTS = "SELECT image_id, backend, count(*) AS n_blocks, CASE WHEN image_id % 5 = 0 AND backend = 'alpha' THEN 'timeout' END AS error FROM {ocr_blocks} GROUP BY image_id, backend"


@query("f6_w6_first_backend", f"SELECT image_id, backend FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY backend) AS n FROM ({_RESULTS}) q WHERE error IS NULL) z WHERE n = 1")
def _(spark, d):
    return ocr.first_backend(backend_results(spark, d), {"alpha": 0, "beta": 1}).select("image_id", "backend")


@query("a20_outcomes", f"SELECT image_id, count(*) AS tried, count(*) FILTER (error IS NULL) AS successful, sum(n_blocks)::BIGINT AS n_blocks, coalesce(max(error), '') AS errors FROM ({_RESULTS}) q GROUP BY image_id")
def _(spark, d):
    return ocr.outcomes(backend_results(spark, d))


@query("r21_r22_image_results")
def _(spark, d):
    """Fused blocks with resolved names, as one text for each image."""
    return ocr.pipeline(view(spark, d, "ocr_blocks"), entities(spark, d))[1]


@query("s13_s14_overlay_payloads", "SELECT image_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM {ocr_blocks} GROUP BY image_id")
def _(spark, d):
    """Blocks as an overlay payload and back: a line's box is the union of its words'."""
    word = F.struct("text", F.col("x").alias("left"), F.col("y").alias("top"), F.col("w").alias("width"), F.col("h").alias("height"))
    payload = view(spark, d, "ocr_blocks").groupBy("image_id").agg(F.to_json(F.array(F.struct(F.array(F.struct(F.lit("line").alias("text"), F.collect_list(word).alias("words"))).alias("lines")))).alias("payload"))
    return payload.select("image_id", F.explode(ocr.flatten_overlay(F.col("payload"))).alias("b")).select("image_id", "b.x", "b.y", "b.w", "b.h")


@query("s15_parallel_arrays", "SELECT image_id, text, CASE WHEN ordinal % 2 = 0 THEN 0.0 ELSE confidence END AS score, x, greatest(1, w) AS w FROM {ocr_blocks}")
def _(spark, d):
    rows = view(spark, d, "ocr_blocks").select("image_id", F.array("text").alias("texts"), F.when(F.col("ordinal") % 2 == 0, F.array().cast("array<double>")).otherwise(F.array("confidence")).alias("scores"), F.array(F.array(F.array("x", "y"), F.array(F.col("x") + F.col("w"), F.col("y") + F.col("h")))).alias("polygons"))
    return rows.select("image_id", F.explode(ocr.flatten_arrays(F.col("texts"), F.col("scores"), F.col("polygons"))).alias("b")).select("image_id", "b.text", "b.score", "b.x", "b.w")


# Verification

_KEY = "trim(regexp_replace(translate(lower({0}), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g'))"


def key(x: str) -> str:
    return _KEY.replace("{0}", f"coalesce({x}, '')")


_PAGES = f"SELECT run_id, pos AS page_pos, url, ' ' || {key(chr(39).join(['concat_ws(', ' ', ', url, title, text)']))} || ' ' AS hay FROM {{pages_read}} WHERE ok AND NOT blocked AND (status_code IS NULL OR status_code BETWEEN 200 AND 399)"
_MONTHS = "CASE month(d) " + " ".join(f"WHEN {k + 1} THEN '{m}'" for k, m in enumerate(verify.MONTH_WORDS)) + " END"


def has(value: str) -> str:
    return f"({value} <> '' AND contains(hay, ' ' || {value} || ' '))"


def has_date(d: str) -> str:
    forms = [f"strftime({d}, '{f}')" for f in ("%Y %m %d", "%d %m %Y")] + [f"day({d}) || ' ' || strftime({d}, '%m %Y')", f"day({d}) || ' ' || month({d}) || ' ' || year({d})", f"day({d}) || ' ' || {_MONTHS.replace('month(d)', f'month({d})')}"]
    return f"coalesce({' OR '.join(f'contains(hay, {chr(39)} {chr(39)} || {f} || {chr(39)} {chr(39)})' for f in forms)}, false)"


_OCC = f"SELECT run_id, pos, page_pos, url, {has(key('artist'))} AS a, {has_date('event_date')} AS d, {has(key('city_name'))} AS c, {has(key('venue_name'))} AS v, coalesce({has(key('start_time'))}, false) AS s FROM {{v_occurrences}} JOIN ({_PAGES}) p USING (run_id)"
_MATCH = f"SELECT run_id, pos, page_pos, url, n_fields, score FROM (SELECT *, row_number() OVER (PARTITION BY run_id, pos ORDER BY score DESC, page_pos) AS n FROM (SELECT run_id, pos, page_pos, url, a::INT + d::INT + c::INT + v::INT + s::INT AS n_fields, round(least(0.7 + CASE WHEN a THEN 0.08 ELSE 0 END + CASE WHEN d THEN 0.08 ELSE 0 END + CASE WHEN c THEN 0.05 ELSE 0 END + CASE WHEN v THEN 0.07 ELSE 0 END + CASE WHEN s THEN 0.05 ELSE 0 END, 0.98), 6)::DOUBLE AS score FROM ({_OCC}) o) q WHERE n_fields >= 3) z WHERE n = 1"


@query("j5_j6_j22_occurrence_pages", _MATCH)
def _(spark, d):
    return verify.occurrence_matches(*tables(spark, d, "v_occurrences", "pages_read"))


@query("f7_usable_pages", "SELECT run_id, pos FROM {pages_read} WHERE ok AND NOT blocked AND (status_code IS NULL OR status_code BETWEEN 200 AND 399)")
def _(spark, d):
    return verify.usable(view(spark, d, "pages_read")).select("run_id", "pos")


@query("f8_ticket_urls", "SELECT run_id, pos, regexp_matches(lower(url), 'ticket|kassa') AS ticket FROM {v_links}")
def _(spark, d):
    return view(spark, d, "v_links").select("run_id", "pos", verify.is_ticket_url(F.col("url")).alias("ticket"))


_LOOSE = "regexp_replace(lower(trim({0})), '/+$', '')"
_BY_URL = f"SELECT l.run_id, l.pos, min(page_pos) AS page_pos FROM {{v_links}} l JOIN ({_PAGES}) p ON p.run_id = l.run_id AND {_LOOSE.replace('{0}', 'l.url')} = {_LOOSE.replace('{0}', 'p.url')} GROUP BY l.run_id, l.pos"


@query("j7_links_by_url", _BY_URL)
def _(spark, d):
    return verify.links_by_url(*tables(spark, d, "v_links", "pages_read"))


def domain(x: str) -> str:
    return f"regexp_replace(lower(regexp_extract({x}, '^[A-Za-z]+://([^/?#\\s:]+)', 1)), '^www\\.', '')"


_PAIR = f"SELECT l.run_id, l.pos, page_pos, {domain('l.url')} AS a, {domain('p.url')} AS b FROM {{v_links}} l JOIN ({_PAGES}) p ON p.run_id = l.run_id"
_BY_DOMAIN = f"WITH pair AS ({_PAIR}), same AS (SELECT run_id, pos, min(page_pos) AS page_pos FROM pair WHERE a = b GROUP BY ALL) SELECT run_id, pos, page_pos, true AS exact FROM same UNION ALL SELECT run_id, pos, min(page_pos), false FROM pair WHERE (ends_with(a, '.' || b) OR ends_with(b, '.' || a)) AND (run_id, pos) NOT IN (SELECT run_id, pos FROM same) GROUP BY run_id, pos"


@query("j8_links_by_domain", _BY_DOMAIN)
def _(spark, d):
    return verify.links_by_domain(*tables(spark, d, "v_links", "pages_read"))


@query("j10_j11_fact_pages", f"SELECT run_id, pos, min(page_pos) AS page_pos, arg_min(url, page_pos) AS url FROM (SELECT f.run_id, f.pos, page_pos, p.url, hay, value, field FROM {{v_facts}} f JOIN ({_PAGES}) p ON p.run_id = f.run_id) q WHERE CASE WHEN field = 'дата' THEN {has_date('try_cast(value AS DATE)')} ELSE {has(key('value'))} END GROUP BY run_id, pos")
def _(spark, d):
    return verify.fact_matches(*tables(spark, d, "v_facts", "pages_read"))


@query("r2_source_types", "SELECT run_id, pos, CASE WHEN regexp_matches(lower(source_url), 't\\.me/|telegram\\.me/') THEN 'social' ELSE CASE source_type WHEN 'official_site' THEN 'official' WHEN 'search' THEN 'search' WHEN 'manual' THEN 'manual' WHEN 'user' THEN 'user_input' ELSE 'unknown' END END AS source_type, CASE field WHEN 'дата' THEN 'date' ELSE field END AS field FROM {v_facts}")
def _(spark, d):
    return view(spark, d, "v_facts").select("run_id", "pos", verify.canonical_source(F.col("source_type"), F.col("source_url")).alias("source_type"), verify.canonical_field(F.col("field")).alias("field"))


_SAN_O = "SELECT run_id, pos, verified AND source_url <> '' AS v, CASE WHEN verified AND source_url <> '' THEN confidence ELSE least(confidence, 0.5) END AS c, verified AND source_url = '' AS changed FROM {v_occurrences}"


@query("r3_sanitized_occurrences", f"SELECT run_id, pos, v AS verified, c::DOUBLE AS confidence, changed FROM ({_SAN_O}) q")
def _(spark, d):
    return verify.sanitize_occurrences(view(spark, d, "v_occurrences")).select("run_id", "pos", "verified", "confidence", "changed")


_SOCIAL = "regexp_matches(lower(url), 't\\.me/|telegram\\.me/|vk\\.com/|instagram\\.com/')"


@query("r3_sanitized_links", f"SELECT run_id, pos, CASE WHEN {_SOCIAL} AND kind IN ('official', 'ticket') THEN 'social' ELSE kind END AS kind, verified AND NOT {_SOCIAL} AS verified, (CASE WHEN verified AND NOT {_SOCIAL} THEN confidence ELSE least(confidence, 0.5) END)::DOUBLE AS confidence FROM {{v_links}}")
def _(spark, d):
    return verify.sanitize_links(view(spark, d, "v_links")).select("run_id", "pos", "kind", "verified", "confidence")


_ST = "CASE source_type WHEN 'official_site' THEN 'official' WHEN 'search' THEN 'search' WHEN 'manual' THEN 'manual' ELSE 'user_input' END"


@query("r3_sanitized_facts", f"SELECT run_id, pos, CASE WHEN status = 'verified' AND NOT ({_ST} = 'manual' OR ({_ST} = 'official' AND source_url <> '')) THEN 'unverified' ELSE status END AS status FROM {{v_facts}}")
def _(spark, d):
    return verify.sanitize_facts(view(spark, d, "v_facts")).select("run_id", "pos", "status")


@query("r4_r5_confirmed_occurrences", f"SELECT o.run_id, o.pos, o.verified OR m.url IS NOT NULL AS verified, (CASE WHEN m.url IS NOT NULL THEN greatest(o.confidence, m.score, 0.9) ELSE o.confidence END)::DOUBLE AS confidence, coalesce(m.url, o.source_url) AS source_url FROM {{v_occurrences}} o LEFT JOIN ({_MATCH}) m ON m.run_id = o.run_id AND m.pos = o.pos")
def _(spark, d):
    return verify.confirm_occurrences(*tables(spark, d, "v_occurrences", "pages_read")).select("run_id", "pos", "verified", "confidence", "source_url")


@query("a5_a18_run_metrics", "SELECT run_id, o.v AS v_occurrences, k.a AS v_official, k.b AS v_ticket, k.c AS unverified_tickets, f.v AS v_facts, f.c AS conflicts FROM (SELECT run_id, count(*) FILTER (verified AND source_url <> '') AS v FROM {v_occurrences} GROUP BY run_id) o JOIN (SELECT run_id, count(*) FILTER (verified AND kind = 'official') AS a, count(*) FILTER (verified AND kind = 'ticket') AS b, count(*) FILTER (NOT verified AND kind = 'ticket') AS c FROM {v_links} GROUP BY run_id) k USING (run_id) JOIN (SELECT run_id, count(*) FILTER (status = 'verified' AND source_type = 'manual') AS v, count(*) FILTER (status = 'conflicted') AS c FROM {v_facts} GROUP BY run_id) f USING (run_id)")
def _(spark, d):
    return verify.run_metrics(*tables(spark, d, "v_occurrences", "v_links", "v_facts")).select("run_id", "v_occurrences", "v_official", "v_ticket", "unverified_tickets", "v_facts", "conflicts")


@query("a6_evidence_status", "SELECT run_id, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'unverified') AS unverified, count(*) FILTER (status = 'conflicted') AS conflicted FROM {v_facts} GROUP BY run_id")
def _(spark, d):
    return view(spark, d, "v_facts").groupBy("run_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("verified", "unverified", "conflicted")))


@query("a8_first_values", "SELECT run_id, arg_min(value, pos) FILTER (field = 'artist') AS artist, arg_min(value, pos) FILTER (field = 'venue') AS venue FROM {v_facts} GROUP BY run_id")
def _(spark, d):
    first = lambda name: F.min_by("value", F.when(verify.canonical_field(F.col("field")) == name, F.col("pos"))).alias(name)
    return view(spark, d, "v_facts").groupBy("run_id").agg(first("artist"), first("venue"))


@query("r14_r6_a16_decisions")
def _(spark, d):
    """The whole verification: sanitise, confirm, sanitise, count, score, decide."""
    return verify.verify(*tables(spark, d, "v_occurrences", "v_links", "v_facts", "pages_read"))


_DEC = "SELECT o.run_id, n_occurrences, v_occurrences, b AS best, k.v AS v_links, k.c AS unverified_tickets, f.c AS conflicts FROM (SELECT run_id, count(*) AS n_occurrences, count(*) FILTER (verified AND source_url <> '') AS v_occurrences, max(confidence) AS b FROM {v_occurrences} GROUP BY run_id) o JOIN (SELECT run_id, count(*) FILTER (verified AND kind IN ('official', 'ticket')) AS v, count(*) FILTER (NOT verified AND kind = 'ticket') AS c FROM {v_links} GROUP BY run_id) k USING (run_id) JOIN (SELECT run_id, count(*) FILTER (status = 'conflicted') AS c FROM {v_facts} GROUP BY run_id) f USING (run_id)"
_RAW = "greatest(best, CASE WHEN v_occurrences > 0 AND v_links > 0 THEN 0.85 WHEN v_occurrences > 0 OR v_links > 0 THEN 0.7 ELSE 0 END)"


@query("r14_raw_decisions", f"SELECT run_id, overall, CASE WHEN n_occurrences = 0 THEN 'blocked' WHEN overall >= 0.85 AND unverified_tickets = 0 AND v_occurrences > 0 AND conflicts = 0 THEN 'auto_publish' ELSE 'needs_review' END AS decision FROM (SELECT *, round(CASE WHEN unverified_tickets > 0 THEN least({_RAW}, 0.8) ELSE {_RAW} END, 6)::DOUBLE AS overall FROM ({_DEC}) q) z")
def _(spark, d):
    """Decisions from the given states, without confirming by pages."""
    metrics = verify.run_metrics(*tables(spark, d, "v_occurrences", "v_links", "v_facts"))
    return verify.decide(verify.overall_confidence(metrics)).select("run_id", "overall", "decision")


def review_drafts(spark, d):
    links = view(spark, d, "v_links").groupBy("run_id").agg(F.count_if(F.col("kind") == "ticket").alias("n_tickets"))
    return view(spark, d, "v_occurrences").withColumn("title", F.col("artist")).join(links, "run_id")


_ISSUES = "SELECT run_id, unnest(list_filter([CASE WHEN city_name = '' THEN 'city is missing' END, CASE WHEN event_date IS NULL THEN 'date is missing' END, CASE WHEN NOT verified THEN 'occurrence is not verified' END, CASE WHEN n = 0 THEN 'no ticket link' END], lambda x: x IS NOT NULL)) AS message FROM {v_occurrences} JOIN (SELECT run_id, count(*) FILTER (kind = 'ticket') AS n FROM {v_links} GROUP BY run_id) k USING (run_id)"


@query("r13_a7_issue_counts", f"SELECT CASE message WHEN 'city is missing' THEN 'error' WHEN 'date is missing' THEN 'error' WHEN 'no ticket link' THEN 'info' ELSE 'warning' END AS severity, message, count(*) AS n FROM ({_ISSUES}) q GROUP BY message")
def _(spark, d):
    return verify.issue_counts(verify.issues(review_drafts(spark, d)))


@query("r15_u4_refuted_issues", f"SELECT message, count(*) AS n FROM ({_ISSUES}) q JOIN (SELECT run_id, count(*) FILTER (verified AND kind = 'ticket') AS t FROM {{v_links}} GROUP BY run_id) k USING (run_id) WHERE NOT (message = 'occurrence is not verified' AND t > 0) GROUP BY message")
def _(spark, d):
    metrics = verify.run_metrics(*tables(spark, d, "v_occurrences", "v_links", "v_facts"))
    kept = verify.without_refuted(verify.issues(review_drafts(spark, d)), metrics, {"occurrence is not verified": "v_ticket"})
    return kept.groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query("u3_j17_merged_links", f"SELECT run_id, url, src FROM (SELECT *, row_number() OVER (PARTITION BY run_id, {_LOOSE.replace('{0}', 'url')} ORDER BY src, pos) AS n FROM (SELECT run_id, pos, url, 0 AS src FROM {{v_links}} UNION ALL SELECT run_id, pos, url, 1 FROM {{pages_read}}) q) z WHERE n = 1")
def _(spark, d):
    merged = verify.merge_links(view(spark, d, "v_links").select("run_id", "pos", "url", F.lit(0).alias("origin")), view(spark, d, "pages_read").select("run_id", "pos", "url", F.lit(1).alias("origin")))
    return merged.select("run_id", "url", F.col("origin").alias("src"))


@query("r7_r23_trust", "SELECT run_id, pos, CASE WHEN weak THEN 'low' WHEN source_type = 'search' AND label = 'high' THEN 'medium' ELSE label END AS label, CASE WHEN status = 'verified' AND (weak OR source_type = 'search' OR (source_type = 'user' AND source_url = '')) THEN 'unverified' ELSE status END AS status FROM (SELECT *, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS label, run_id % 7 = 0 AS weak FROM {v_facts}) q")
def _(spark, d):
    evidence = view(spark, d, "v_facts").withColumns({"label": verify.label_of(F.col("confidence")), "explanation": F.expr("CASE WHEN run_id % 7 = 0 THEN 'maybe so' ELSE 'seen' END")})
    return verify.trust(evidence).select("run_id", "pos", "label", "status")


@query("j12_j13_support", f"SELECT f.run_id, f.pos, bool_or({has(key('f.value')).replace('contains(hay', 'contains(hay').replace(chr(39) + ' ' + chr(39) + ' || ', '').replace(' || ' + chr(39) + ' ' + chr(39), '')}) AS supported FROM {{v_facts}} f JOIN (SELECT run_id, {key('text')} AS hay FROM {{pages_read}}) p ON p.run_id = f.run_id WHERE f.field IN ('venue', 'price') GROUP BY f.run_id, f.pos")
def _(spark, d):
    facts = view(spark, d, "v_facts").filter("field in ('venue', 'price')").select("run_id", "pos", "value")
    both = facts.join(view(spark, d, "pages_read").select("run_id", "text"), "run_id")
    plain_support = F.contains(t.search_key(F.col("text")), t.search_key(F.col("value"))) & (t.search_key(F.col("value")) != "")
    return both.groupBy("run_id", "pos").agg(F.bool_or(plain_support & verify.supports(F.col("value"), F.col("text"))).alias("supported"))


@query("r11_confidence_labels", "SELECT run_id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS label, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.55 THEN 'medium' ELSE 'low' END AS sync_label, round(greatest(CASE WHEN city_name <> '' THEN 0.25 ELSE 0 END + CASE WHEN event_date IS NOT NULL THEN 0.3 ELSE 0 END + 0.25, 0.4), 6)::DOUBLE AS built FROM {v_occurrences}")
def _(spark, d):
    o = view(spark, d, "v_occurrences")
    return o.select("run_id", verify.label_of(F.col("confidence")).alias("label"), verify.label_of(F.col("confidence"), *verify.SYNC_CUTS).alias("sync_label"), verify.occurrence_confidence(F.col("city_name"), F.col("event_date"), F.col("venue_name")).alias("built"))


@query("r1_r16_parsed_results", "SELECT run_id, artist AS title, CASE WHEN run_id % 2 = 0 THEN true ELSE false END AS is_useful, least(greatest((run_id % 30) / 10.0 - 0.5, 0), 1)::DOUBLE AS confidence, CASE WHEN run_id % 3 = 0 THEN 'needs_review' ELSE 'publish' END AS recommendation FROM {v_occurrences} WHERE run_id % 5 <> 0")
def _(spark, d):
    """JSON answers within prose, typed; one in five is cut off and goes to the rejects."""
    body = F.expr("concat('Answer:\\n{\"title\": \"', artist, '\", \"is_useful\": \"', CASE WHEN run_id % 2 = 0 THEN 'да' ELSE 'no' END, '\", \"confidence\": ', cast(run_id % 30 / 10.0 - 0.5 as decimal(6, 2)), ', \"recommendation\": \"', CASE WHEN run_id % 3 = 0 THEN ' ' ELSE 'publish' END, '\"', CASE WHEN run_id % 5 = 0 THEN '' ELSE '} bye' END)")
    good, _ = verify.parse_results(view(spark, d, "v_occurrences").select("run_id", body.alias("text")))
    return good.select("run_id", "title", "is_useful", "confidence", "recommendation")


@query("r24_manual_flags", "SELECT run_id, run_id % 4 = 1 AS manual FROM {v_occurrences}")
def _(spark, d):
    metadata = F.create_map(F.lit("manual_confirmation"), F.expr("CASE run_id % 4 WHEN 1 THEN ' Да' WHEN 2 THEN 'no' ELSE '' END"))
    return view(spark, d, "v_occurrences").select("run_id", verify.manual_flag(metadata).alias("manual"))


@query("t2_t6_summaries", f"SELECT run_id, string_agg(CASE WHEN status = 'verified' THEN '✅' ELSE '⚠️' END || ' ' || field || ': ' || value, chr(10) ORDER BY pos) || chr(10) || '→ ' || CASE WHEN run_id % 2 = 0 THEN 'publish' ELSE 'review' END AS text FROM {{v_facts}} GROUP BY run_id")
def _(spark, d):
    rows = view(spark, d, "v_facts").withColumn("decision", F.expr("CASE WHEN run_id % 2 = 0 THEN 'publish' ELSE 'review' END"))
    return verify.summary_text(rows)


@query("n25_spellings", f"SELECT run_id, count(*) AS n_pages FROM {{v_occurrences}} JOIN ({_PAGES}) p USING (run_id) WHERE {has_date('event_date')} GROUP BY run_id")
def _(spark, d):
    """How many of a run's pages carry its date in any spelling."""
    page = verify.usable(view(spark, d, "pages_read")).select("run_id", verify.haystack().alias("hay"))
    met = view(spark, d, "v_occurrences").join(page, "run_id").filter(verify.held(F.col("hay"), verify.date_spellings(F.col("event_date"))))
    return met.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_pages"))


# Rendered texts


def draft_columns():
    return {"title": F.col("artist"), "artists": F.lit(""), "date": F.col("event_date"), "city": F.col("city_name"), "venue": F.col("venue_name"), "age": F.lit(18), "links": F.concat(F.lit("https://t.example/"), F.col("run_id").cast("string"))}


@query("t1_post_texts", "SELECT run_id, concat_ws(chr(10), artist, concat_ws(', ', event_date::VARCHAR, nullif(city_name, ''), venue_name), '18+', 'https://t.example/' || run_id) AS text, '<' || artist || '> ' || coalesce(event_date::VARCHAR, '') || ' ' || city_name AS templated FROM {v_occurrences}")
def _(spark, d):
    o, c = view(spark, d, "v_occurrences"), draft_columns()
    return o.select("run_id", render.post_text(c).alias("text"), render.post_text(c, "<{title}> {date} {city}").alias("templated"))


@query("t4_draft_messages", "SELECT run_id, concat_ws(chr(10), 'title: ' || artist, 'date: ' || event_date::VARCHAR, 'city: ' || nullif(city_name, ''), 'venue: ' || venue_name, 'age: 18', 'links: https://t.example/' || run_id) AS text FROM {v_occurrences}")
def _(spark, d):
    return view(spark, d, "v_occurrences").select("run_id", render.draft_message(draft_columns()).alias("text"))


@query("t3_review_texts", f"SELECT o.run_id, concat_ws(chr(10), '# ' || o.artist, 'Decision: needs_review', 'Issues:' || chr(10) || '- ' || string_agg(message, chr(10) || '- ' ORDER BY message)) AS text FROM {{v_occurrences}} o JOIN ({_ISSUES}) i ON i.run_id = o.run_id GROUP BY o.run_id, o.artist")
def _(spark, d):
    grouped = verify.issues(review_drafts(spark, d)).groupBy("run_id").agg(F.array_sort(F.collect_list("message")).alias("issues"))
    held = view(spark, d, "v_occurrences").join(grouped, "run_id")
    return held.select("run_id", render.review_text(F.col("artist"), F.lit("needs_review"), F.lit(""), F.col("issues")).alias("text"))


@query("t5_search_texts", "SELECT run_id, rtrim(left(trim(regexp_replace(concat_ws(' ', artist, city_name, venue_name), '\\s+', ' ', 'g')), 700)) || ' official site tickets' AS text FROM {v_occurrences}")
def _(spark, d):
    return view(spark, d, "v_occurrences").select("run_id", render.search_text(F.col("artist"), F.col("city_name"), F.col("venue_name")).alias("text"))


# Sources: exports and tool results derived from the tables, as their JSON would be read


def exports(spark, d):
    """Chat exports of up to a hundred messages each, as JSON text; one in eleven is cut off."""
    message = F.struct(F.col("post_id").alias("id"), F.expr("CASE WHEN post_id % 4 = 3 THEN 'service' ELSE 'message' END").alias("type"), F.col("published").cast("string").alias("date"), F.col("text").alias("text"))
    part = F.floor(F.col("post_id") / 100)
    grouped = view(spark, d, "posts").groupBy("channel_id", part.alias("part")).agg(F.to_json(F.struct(F.first("channel_id").alias("id"), F.array_sort(F.collect_list(message)).alias("messages"))).alias("json"))
    text = F.when((F.col("channel_id") + F.col("part")) % 11 == 0, F.left("json", F.lit(40))).otherwise(F.col("json"))
    return grouped.select(F.concat_ws("-", F.col("channel_id"), F.col("part")).alias("file"), F.from_json(text, chat.EXPORT, {"columnNameOfCorruptRecord": "_corrupt"}).alias("x")).select("file", "x.*")


@query("s1_s8_chat_posts", "SELECT post_id, channel_id, published::VARCHAR AS published, length(text) AS n_chars FROM {posts} WHERE post_id % 4 <> 3 AND (channel_id + post_id // 100) % 11 <> 0")
def _(spark, d):
    good, _ = chat.good_and_bad(exports(spark, d))
    made = chat.posts(chat.messages(good.withColumn("file", F.concat("file", F.lit(".json")))))
    return made.select("post_id", "channel_id", "published", F.length("text").cast("long").alias("n_chars"))


@query("s2_bad_exports", "SELECT channel_id || '-' || part AS file, 'unreadable' AS reason FROM (SELECT DISTINCT channel_id, post_id // 100 AS part FROM {posts}) q WHERE (channel_id + part) % 11 = 0")
def _(spark, d):
    return chat.good_and_bad(exports(spark, d))[1].select("file", "reason")


@query("s9_s11_flat_rows", "SELECT run_id, NULL::VARCHAR AS list, title FROM {pages_read} WHERE pos = 1 UNION ALL SELECT o_orderkey, '[\"' || o_orderstatus || '\",\"x\"]', NULL FROM orders")
def _(spark, d):
    """Tables of different columns as rows for one CSV file, nested values as JSON."""
    pages = view(spark, d, "pages_read").filter("pos = 1").select("run_id", "title")
    orders = view(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.array("o_orderstatus", F.lit("x")).alias("list"))
    return sinks.flat_rows(pages, orders)


@query("s12_fingerprints", "SELECT page_id, strlen(html) AS length, sha256(html) AS sha256 FROM pages")
def _(spark, d):
    content = view(spark, d, "pages").select(F.col("page_id").alias("path"), F.octet_length("html").cast("long").alias("length"), F.col("html").cast("binary").alias("content"))
    return sinks.fingerprints(content).withColumnRenamed("path", "page_id")


@query("s22_tool_pages", "SELECT run_id, url, coalesce(status_code, 0) AS status_code FROM {pages_read} WHERE run_id % 6 <> 0")
def _(spark, d):
    """Pages of nested tool results; one run in six has a broken result."""
    page = F.struct("url", "ok", F.col("blocked").alias("blocked_by_antibot"), "status_code", "title", F.col("text").alias("text_preview"))
    results = view(spark, d, "pages_read").groupBy("run_id").agg(F.to_json(F.struct(F.collect_list(page).alias("pages"))).alias("json"))
    data = F.when(F.col("run_id") % 6 == 0, F.lit("{broken")).otherwise(F.col("json"))
    return sinks.tool_pages(results.select("run_id", F.lit(0).alias("step"), F.lit("url_read").alias("tool"), data.alias("data"))).select("run_id", "url", F.coalesce("status_code", F.lit(0)).alias("status_code"))


@query("s20_kept_results", "SELECT image_id, count(*) AS n FROM {ocr_blocks} GROUP BY image_id, backend HAVING count(*) > 0")
def _(spark, d):
    return backend_results(spark, d).filter((F.trim("raw_text") != "") | (F.col("n_blocks") > 0)).select("image_id", F.col("n_blocks").alias("n"))


@query("j16_synced_occurrences", "SELECT o.run_id, coalesce(nullif(o.city_name, ''), CASE WHEN m.url IS NOT NULL THEN 'Минск' END) AS city_name, coalesce(m.url, nullif(o.source_url, '')) AS source_url FROM {v_occurrences} o LEFT JOIN (SELECT run_id, min_by(url, pos) AS url FROM {pages_read} WHERE ok GROUP BY run_id) m USING (run_id)")
def _(spark, d):
    """Occurrences filled from the verified ones at the same place of the run."""
    verified = view(spark, d, "pages_read").filter("ok").groupBy("run_id").agg(F.min_by("url", "pos").alias("source_url")).select("run_id", F.lit(0).alias("pos"), F.lit("Минск").alias("city_name"), "source_url")
    return verify.synced(view(spark, d, "v_occurrences").withColumn("city_name", t.blank_to_null(F.col("city_name"))), verified).select("run_id", "city_name", "source_url")


@query("a21_best_sources", "SELECT run_id, coalesce(min_by(url, pos) FILTER (verified AND kind = 'official'), min_by(source_url, p) FILTER (source_url <> '')) AS url FROM (SELECT run_id, pos, url, verified, kind, NULL AS source_url, NULL AS p FROM {v_links} UNION ALL SELECT run_id, NULL, NULL, NULL, NULL, source_url, pos FROM {v_facts}) q GROUP BY run_id")
def _(spark, d):
    return verify.best_source(*tables(spark, d, "v_links", "v_facts"))


@query("u1_evidence_union", "SELECT field, count(*) AS n FROM (SELECT field FROM {v_facts} UNION ALL SELECT 'page' FROM {pages_read} WHERE ok AND NOT blocked AND (status_code IS NULL OR status_code BETWEEN 200 AND 399)) q GROUP BY field")
def _(spark, d):
    """Evidence of facts, and of the pages that were read, in one table."""
    facts, pages = tables(spark, d, "v_facts", "pages_read")
    every = facts.select("run_id", "field", "value", "status", "source_type", "source_url").unionByName(verify.page_evidence(pages))
    return every.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("r17_consistency", "SELECT run_id, array_to_string(list_filter([CASE WHEN confidence > 0.9 AND NOT verified THEN 'sure_but_unverified' END, CASE WHEN verified AND source_url = '' THEN 'verified_without_source' END], lambda x: x IS NOT NULL), ',') AS warnings FROM {v_occurrences}")
def _(spark, d):
    return view(spark, d, "v_occurrences").select("run_id", F.array_join(verify.consistency(), ",").alias("warnings"))


@query("r10_r12_review_rows", "SELECT o.run_id, o.artist AS title, n AS n_links, CASE WHEN o.event_date IS NULL OR o.city_name = '' THEN 0.55 ELSE 0.7 END::DOUBLE AS confidence, array_to_string(list_filter([CASE WHEN o.event_date IS NULL THEN 'date' END, CASE WHEN o.city_name = '' THEN 'city' END], lambda x: x IS NOT NULL), ',') AS missing FROM {v_occurrences} o JOIN (SELECT run_id, count(*) AS n FROM {v_links} GROUP BY run_id) k USING (run_id)")
def _(spark, d):
    """Verification rows put together from evidence: title, links, what is missing, and a confidence by that."""
    return verify.review_rows(*tables(spark, d, "v_occurrences", "v_links"))


@query("s13_result_json", "SELECT image_id, backend, ordinal, text, confidence, x, y, x + w AS right FROM {ocr_blocks} WHERE image_id % 7 <> 0")
def _(spark, d):
    """Recognition results as JSON, blocks of lines of words, and read back to words; one image in seven has a broken text."""
    word = F.struct("text", "confidence", F.array(*(F.expr(c) for c in ("x", "y", "x + w", "y + h"))).alias("bbox"))
    line = F.struct("text", "confidence", word["bbox"].alias("bbox"), F.array(word).alias("words"))
    block = F.struct("text", "confidence", word["bbox"].alias("bbox"), F.array(line).alias("lines"), "block_type", F.col("ordinal").alias("reading_order"), F.lit("scan").alias("source"))
    grouped = view(spark, d, "ocr_blocks").groupBy("image_id", "backend").agg(F.collect_list(block).alias("blocks"))
    result = F.struct(F.col("backend").alias("backend_name"), F.lit("").alias("raw_text"), F.lit(0.5).alias("confidence"), "blocks", F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    stored = grouped.select("image_id", F.when(F.col("image_id") % 7 == 0, F.lit('{"raw_text": "x"')).otherwise(ocr.result_json(result)).alias("json"))
    read = stored.select("image_id", ocr.result_of(F.col("json")).alias("r")).select("image_id", F.col("r.backend_name").alias("backend"), F.explode("r.blocks").alias("b"))
    words = read.select("image_id", "backend", F.col("b.reading_order").alias("ordinal"), F.explode("b.lines").alias("l")).select("image_id", "backend", "ordinal", F.explode("l.words").alias("w"))
    return words.select("image_id", "backend", "ordinal", "w.text", "w.confidence", F.col("w.bbox")[0].alias("x"), F.col("w.bbox")[1].alias("y"), F.col("w.bbox")[2].alias("right"))


def results(spark, d):
    """Analysis results of runs, a decision for each fact."""
    decision = lambda f: F.struct(f["field"].alias("type"), f["confidence"].alias("confidence"), F.create_map(F.lit("value"), f["value"]).alias("data"), F.array(F.struct(f["source_type"].alias("source"), f["value"].alias("value"), f["confidence"].alias("confidence"))).alias("evidence"))
    grouped = view(spark, d, "v_facts").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "field", "value", "source_type", "confidence"))).alias("f"), F.max("confidence").alias("best"))
    made = F.struct(F.lit("event").alias("content_type"), (F.col("run_id") % 2 == 0).alias("is_useful"), F.lit("normal").alias("priority"), F.col("best").alias("confidence"), F.lit("review").alias("main_decision"), F.transform("f", decision).alias("decisions"), F.array(F.create_map(F.lit("a"), F.lit("b"))).alias("variants"), F.array(F.struct(F.lit("look up").alias("purpose"), F.lit("select 1").alias("query"))).alias("sql_plan"), F.array(F.lit("w")).alias("warnings"), F.create_map(F.lit("raw"), F.lit("text")).alias("raw"))
    return grouped.select("run_id", verify.result_json(made).alias("json"))


@query("r18_results", "SELECT run_id, run_id % 2 = 0 AS is_useful, best AS confidence, n, evidence FROM (SELECT run_id, max(confidence) AS best, count(*) AS n, string_agg(field || '=' || value, ',' ORDER BY pos) AS evidence FROM {v_facts} GROUP BY run_id) q WHERE run_id % 5 > 1")
def _(spark, d):
    """Results as JSON and back; one run in five lacks a required field, one has a word for a truth value."""
    json = F.when(F.col("run_id") % 5 == 0, F.replace("json", F.lit('"priority"'), F.lit('"urgency"'))).when(F.col("run_id") % 5 == 1, F.regexp_replace("json", '"is_useful":(true|false)', '"is_useful":"so"')).otherwise(F.col("json"))
    read = once(results(spark, d), verify.result_of(json).alias("r")).filter("r is not null")
    said = F.array_join(F.transform("r.decisions", lambda x: F.concat_ws("=", x["type"], x["data"]["value"])), ",")
    return read.select("run_id", "r.is_useful", "r.confidence", F.size("r.decisions").cast("long").alias("n"), said.alias("evidence"))


@query("s19_stored_results", "SELECT run_id, count(*) AS n FROM {v_facts} WHERE pos = 1 GROUP BY run_id UNION ALL SELECT run_id, 1 FROM {v_facts} WHERE pos = 1 AND run_id % 3 = 0")
def _(spark, d):
    """Results added to a stored table twice, the second time those of one run in three, and read back."""
    path = new_folder(spark, "results") + "/rows"
    made = results(spark, d)
    sinks.append_results(made.withColumn("batch", F.lit(1)), path)
    sinks.append_results(made.filter("run_id % 3 = 0").withColumn("batch", F.lit(2)), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("run_id", "batch").agg(F.count(F.lit(1)).alias("n")).drop("batch")


def _inputs(spark, d):
    o = view(spark, d, "v_occurrences")
    return o.select("run_id", F.col("artist").alias("title"), "artist", F.date_format("event_date", "d.MM.yyyy").alias("date"), F.col("city_name").alias("city"), F.col("venue_name").alias("venue"), F.lit(None).cast("string").alias("price"), F.lit(18).alias("age_limit"))


_IN = "SELECT run_id, artist, CASE WHEN event_date IS NOT NULL THEN day(event_date) || '.' || strftime(event_date, '%m.%Y') END AS date, city_name AS city, venue_name AS venue FROM {v_occurrences}"
_SAYS = f"SELECT run_id, page_pos, url, field, value, hay FROM (SELECT run_id, unnest(['title', 'artist', 'date', 'city', 'venue']) AS field, unnest([artist, artist, date, city, venue]) AS value FROM ({_IN}) i) f JOIN ({_PAGES}) p USING (run_id)"


@query("r9_rule_evidence", f"SELECT run_id, field, status, confidence, count(*) AS n FROM (SELECT run_id, unnest(['title', 'artist', 'event_type', 'date', 'city', 'venue', 'age_limit']) AS field, unnest([artist, artist, 'concert', date, city, venue, '18']) AS value, 'input' AS status, unnest([0.6, 0.6, 0.5, 0.6, 0.6, 0.6, 0.5])::DOUBLE AS confidence FROM ({_IN}) i UNION ALL SELECT run_id, CASE WHEN regexp_matches(lower(url), 't\\.me/|telegram\\.me/') THEN 'social_link' WHEN regexp_matches(lower(url), 'ticket|kassa') THEN 'ticket_link' ELSE 'official_source' END, url, 'input', 0.4 FROM {{v_links}} UNION ALL SELECT run_id, CASE WHEN regexp_matches(lower(url), 'ticket|kassa') THEN 'ticket_link' ELSE 'official_source' END, url, CASE WHEN regexp_matches(lower(url), 'ticket|kassa') THEN 'unverified' ELSE 'verified' END, CASE WHEN regexp_matches(lower(url), 'ticket|kassa') THEN 0.5 ELSE 0.9 END FROM ({_PAGES}) p UNION ALL SELECT run_id, field, value, 'verified', 0.9 FROM ({_SAYS}) s WHERE {has(key('value'))}) e WHERE trim(value) <> '' GROUP BY ALL")
def _(spark, d):
    """Evidence that rules find in the inputs, among their addresses and on the pages read."""
    found = verify.rule_evidence(_inputs(spark, d), *tables(spark, d, "v_links", "pages_read"))
    return found.groupBy("run_id", "field", "status", "confidence").agg(F.count(F.lit(1)).alias("n"))
