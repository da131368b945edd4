"""Queries over fields read out of input texts, labelled names, stored results and written reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import inputs, results, verify
from .operators import posts as p
from .plans.fixtures import plain, view, with_views
from .plans.shared import checkpointed, new_folder
from .queries_drafts import chain, drafts, key, safe_city
from .queries_verify import _BY_URL, _MATCH, _PAGES, _ST, domain, has, has_date
from .queries_verify import key as search_key
from .sources import sinks

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under the name."""

    def add(f):
        QUERIES[name] = lambda spark, d: plain(f(spark, d))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


# Inputs: posts, some of which bring metadata


def texts(spark, d):
    """Posts as inputs; those of channels whose number is a multiple of three name artist and date in their metadata."""
    metadata = F.expr("CASE WHEN channel_id % 3 = 0 THEN map('artist', artist, 'event_date', cast(event_date as string)) END")
    return view(spark, d, "posts").select(F.col("post_id").alias("run_id"), "text", metadata.alias("metadata"))


HOW = inputs.Extraction()


def at_end(pattern: str) -> str:
    """What regexp_extract gives as the group, the whole and the text before, of a match that its group ends."""
    return f"regexp_extract(text, '{pattern}', 1) AS v, regexp_extract(text, '{pattern}', 0) AS w, regexp_split_to_array(text, '{pattern}')[1] AS b"


def said(name: str, pattern: str, rule: str) -> str:
    return f"SELECT run_id, '{name}' AS field, v AS value, '{rule}' AS rule, (length(b) + length(w) - length(v))::INT AS start, (length(b) + length(w))::INT AS \"end\" FROM (SELECT run_id, {at_end(pattern.replace('(?imu)', '(?im)').replace('(?iu)', '(?i)'))} FROM src) WHERE v <> ''"


_GIVEN = "SELECT run_id, '{f}' AS field, {c} AS value, 'metadata' AS rule, NULL::INT AS start, NULL::INT AS \"end\" FROM src WHERE channel_id % 3 = 0"
_OTHER = "SELECT * FROM ({0}) WHERE run_id NOT IN (SELECT run_id FROM ({1}))"
_FIRST = said("title", inputs.SKIPPED, "first_line") + f" AND NOT regexp_matches(v, '{inputs.NO_TITLE}')"
_CAPITAL = "CASE WHEN upper(value) = value AND lower(value) <> value THEN array_to_string(list_transform(string_split(lower(value), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') ELSE value END"
_ALIAS = "CASE " + " ".join(f"WHEN contains(low, '{a}') THEN '{a}'" for a in HOW.cities) + " END"
_NAMED = "CASE a " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in HOW.cities.items()) + " END"
_AGE = r"(?:^|[^0-9])([0-9]{1,2})\s*(?:\+|лет(?:$|[^\p{L}]))"


def _fields_sql() -> str:
    """CTEs src to fields: run_id, field, value, rule, start, end."""
    artist = _GIVEN.format(f="artist", c="artist")
    by_label = _OTHER.format(said("artist", inputs.label_of(HOW.labels["artist"]), "label"), artist)
    date = _GIVEN.format(f="date", c="event_date::VARCHAR")
    steps = {
        "src": "SELECT post_id AS run_id, channel_id, artist, event_date, text, lower(text) AS low FROM {posts}",
        "title": _FIRST,
        "named": f"{artist} UNION ALL {by_label}",
        "artist": f"SELECT * FROM named UNION ALL SELECT run_id, 'artist', {_CAPITAL}, 'title', start, \"end\" FROM title WHERE run_id NOT IN (SELECT run_id FROM named)",
        "fields": "SELECT * FROM title UNION ALL SELECT * FROM artist UNION ALL SELECT run_id, 'event_type', 'concert', 'artist', NULL, NULL FROM artist"
        f" UNION ALL {date} UNION ALL {_OTHER.format(said('date', inputs.label_of(HOW.labels['date']), 'label'), date)}"
        f" UNION ALL SELECT run_id, 'city', {_NAMED}, 'alias', (instr(low, a) - 1)::INT, (instr(low, a) - 1 + length(a))::INT FROM (SELECT run_id, low, {_ALIAS} AS a FROM src) WHERE a IS NOT NULL"
        f" UNION ALL {said('venue', inputs.label_of(HOW.labels['venue']), 'label')} UNION ALL {said('price', inputs.price_of(HOW.labels['price']), 'label')}"
        f" UNION ALL SELECT run_id, 'age_limit', v, 'age', (length(b) + instr(w, v) - 1)::INT, (length(b) + instr(w, v) - 1 + length(v))::INT FROM (SELECT run_id, regexp_extract(low, '{_AGE}', 1) AS v, regexp_extract(low, '{_AGE}', 0) AS w, regexp_split_to_array(low, '{_AGE}')[1] AS b FROM src) WHERE v <> ''",
    }
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in steps.items()) + " "


@query("r9_input_fields", _fields_sql() + "SELECT run_id, field, value, rule, start, \"end\", CASE WHEN field IN ('event_type', 'price', 'age_limit') THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence FROM fields")
def _(spark, d):
    """Title, artist, type, date, city, venue, price and age of every post, with rule and place."""
    return inputs.fields_of(texts(spark, d))


_TICKET = "regexp_matches(lower(url), '" + "|".join(verify.SOURCES.ticket_hosts) + "')"


@query(
    "r9_text_evidence",
    _fields_sql()
    + f"SELECT run_id, field, value, status, source_url, confidence FROM (SELECT run_id, field, value, 'input' AS status, '' AS source_url, CASE WHEN field IN ('event_type', 'price', 'age_limit') THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence FROM fields UNION ALL SELECT run_id, CASE WHEN regexp_matches(lower(url), '(?:t|telegram)\\.me/') THEN 'social_link' WHEN {_TICKET} THEN 'ticket_link' ELSE 'official_source' END, url, 'input', '', 0.4 FROM {{v_links}} UNION ALL SELECT run_id, CASE WHEN {_TICKET} THEN 'ticket_link' ELSE 'official_source' END, url, CASE WHEN {_TICKET} THEN 'unverified' ELSE 'verified' END, url, CASE WHEN {_TICKET} THEN 0.5 ELSE 0.9 END FROM ({_PAGES}) p UNION ALL SELECT f.run_id, field, value, 'verified', url, 0.9 FROM fields f JOIN ({_PAGES}) p USING (run_id) WHERE field IN ('title', 'artist', 'date', 'city', 'venue') AND {has(search_key('value'))}) e",
)
def _(spark, d):
    """Evidence that rules find in the posts' texts, among their addresses and on the pages read."""
    held = checkpointed(inputs.wide(texts(spark, d)))  # read twice
    found = verify.rule_evidence(held, view(spark, d, "v_links"), view(spark, d, "pages_read"))
    return found.select("run_id", "field", "value", "status", "source_url", "confidence")


@query("a18_missing_fields", _fields_sql() + "SELECT s.run_id, array_to_string(list_filter([CASE WHEN count(*) FILTER (field = 'title') = 0 THEN 'title' END, CASE WHEN count(*) FILTER (field = 'artist') = 0 THEN 'artists' END, CASE WHEN count(*) FILTER (field = 'date') = 0 THEN 'event_date' END, CASE WHEN count(*) FILTER (field = 'city') = 0 THEN 'city' END, CASE WHEN count(*) FILTER (field = 'venue') = 0 THEN 'venue' END], lambda x: x IS NOT NULL), ',') AS missing FROM src s LEFT JOIN fields USING (run_id) GROUP BY s.run_id")
def _(spark, d):
    """Which of the five required fields a post's text and metadata leave open."""
    c = F.col
    missing = p.missing_fields(title=c("title"), artists=c("artist"), event_date=c("date"), city=c("city"), venue=c("venue"))
    return inputs.wide(texts(spark, d)).select("run_id", F.array_join(missing, ",").alias("missing"))


# Names and titles by labels, cities by links

_TEAMS = "SELECT n_nationkey AS post_id, n_name || chr(10) || 'Title: Night of ' || n_name || chr(10) || 'Artists: ' || CASE WHEN n_nationkey % 2 = 0 THEN string_agg(c_name, ', ' ORDER BY c_custkey) ELSE string_agg(c_name, ';' ORDER BY c_custkey) END || ', ' || lower(min(c_name)) AS text FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"


def teams(spark, d):
    """A text for each nation that names its customers as artists, one of them twice."""
    names = view(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("c"))
    both = names.join(view(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    listed = F.array_join(F.transform("c", lambda x: x["c_name"]), ", ")
    apart = F.when(F.col("n_nationkey") % 2 == 0, listed).otherwise(F.replace(listed, F.lit(", "), F.lit(";")))
    text = F.concat("n_name", F.lit("\nTitle: Night of "), "n_name", F.lit("\nArtists: "), apart, F.lit(", "), F.lower(F.array_min(F.transform("c", lambda x: x["c_name"]))))
    return both.select(F.col("n_nationkey").cast("long").alias("post_id"), text.alias("text"), F.lit(None).cast("date").alias("published"))


@query("x30_labelled_artists", f"SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY i)::INT AS \"at\", artist FROM (SELECT post_id, arg_min(artist, i) AS artist, min(i) AS i FROM (SELECT post_id, trim(a) AS artist, i FROM (SELECT post_id, unnest(regexp_split_to_array(regexp_extract(text, '(?im)^Artists: *(.+)$', 1), '[,;]')) AS a, generate_subscripts(regexp_split_to_array(regexp_extract(text, '(?im)^Artists: *(.+)$', 1), '[,;]'), 1) AS i FROM ({_TEAMS}) q)) WHERE artist <> '' GROUP BY post_id, lower(artist))")
def _(spark, d):
    return p.labelled_artists(p.lines(teams(spark, d)))


@query("x28_other_titles", f"SELECT post_id, 'Night of ' || n_name AS labelled, n_name AS plain FROM ({_TEAMS}) q JOIN nation ON n_nationkey = post_id")
def _(spark, d):
    """The labelled title, and the first line that is short and no address."""
    lines = p.lines(teams(spark, d))
    return p.labelled_titles(lines).withColumnRenamed("title", "labelled").join(p.first_titles(lines, longest=120, no_urls=True).withColumnRenamed("title", "plain"), "post_id")


@query("x28_first_lines", chain("SELECT post_id, arg_min(line, pos) AS title FROM ln WHERE NOT regexp_matches(line, '^(?:[{-]|(?i:https?:|www\\.))') GROUP BY post_id", "ln"))
def _(spark, d):
    return p.first_titles(p.lines(view(spark, d, "posts")), no_urls=True)


@query("x33_link_cities", chain(f"SELECT post_id, \"at\"::INT AS \"at\", city FROM (SELECT *, row_number() OVER (PARTITION BY post_id, {key('city')} ORDER BY \"at\") AS n FROM (SELECT post_id, \"at\", {safe_city('label')} AS city FROM links WHERE link_type = 'ticket') WHERE city IS NOT NULL) WHERE n = 1", "links"))
def _(spark, d):
    """Cities that ticket links are labelled with; a tour's links bear one each."""
    return p.link_cities(p.links(p.kept_lines(view(spark, d, "posts"))))


_WORDS = "|".join(verify.SOURCES.ticket_pages)


def _page_facts(links: str) -> str:
    """Steps pair, same, met, held and their rows run_id, pos: links (run_id, pos, kind, url) whose page by domain holds enough facts."""
    paired = f"SELECT l.run_id, l.pos, l.kind, page_pos, {domain('l.url')} AS a, {domain('p.url')} AS b FROM {links} l JOIN ({_PAGES}) p ON p.run_id = l.run_id"
    said = f"max(({has(search_key('artist'))})::INT) + sum(coalesce(({has_date('event_date')})::INT, 0) + ({has(search_key('city_name'))} OR (city_name = 'Минск' AND contains(hay, ' минск ')))::INT + ({has(search_key('venue_name'))})::INT)"
    return (
        f"WITH pair AS ({paired}), same AS (SELECT run_id, pos, kind, min(page_pos) AS page_pos FROM pair WHERE a = b GROUP BY ALL), met AS (SELECT * FROM same UNION ALL SELECT run_id, pos, kind, min(page_pos) FROM pair WHERE (ends_with(a, '.' || b) OR ends_with(b, '.' || a)) AND (run_id, pos) NOT IN (SELECT run_id, pos FROM same) GROUP BY ALL), "
        f"held AS (SELECT p.run_id, p.page_pos, {said} AS n, bool_or(regexp_matches(lower(concat_ws(' ', r.url, r.title)), '{_WORDS}')) AS tickets FROM ({_PAGES}) p JOIN {{pages_read}} r ON r.run_id = p.run_id AND r.pos = p.page_pos JOIN {{v_occurrences}} o ON o.run_id = p.run_id GROUP BY ALL) "
        "SELECT run_id, pos FROM met JOIN held USING (run_id, page_pos) WHERE kind IN ('ticket', 'official', 'source') AND (n >= 3 OR (kind = 'ticket' AND tickets AND n >= 2))"
    )


@query("j9_links_by_page_facts", _page_facts("{v_links}"))
def _(spark, d):
    """Links whose page by domain holds enough of their run's facts."""
    return verify.links_by_page_facts(view(spark, d, "v_links"), view(spark, d, "pages_read"), view(spark, d, "v_occurrences"))


# Analysis results with nested parts

_DATA = "'{\"place\":{\"run\":' || run_id || ',\"tags\":[\"' || field || '\",{\"status\":\"' || status || '\"}]},\"value\":\"' || value || '\"}'"
_VALUE = "CASE pos % 3 WHEN 0 THEN '\"' || value || '\"' WHEN 1 THEN run_id::VARCHAR ELSE '{\"of\":[' || pos || ',null,true]}' END"


def nested(spark, d):
    """Results of runs as JSON texts with nested data; of five, one lacks a field, one has a text for a truth value, one a text that is no number, one a list with stray items."""
    v = view(spark, d, "v_facts")
    data = F.expr(_DATA.replace("|| run_id ||", "|| cast(run_id as string) ||"))
    value = F.expr(_VALUE.replace("run_id::VARCHAR", "cast(run_id as string)").replace("|| pos ||", "|| cast(pos as string) ||"))
    decision = F.concat(F.lit('{"type":"'), "field", F.lit('","confidence":0.5,"data":'), data, F.lit(',"evidence":[{"field":"'), "field", F.lit('","value":'), value, F.lit(',"source":7},{"value":1},"stray"]}'))
    made = v.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", decision.alias("j")))), lambda x: x["j"]), ",").alias("decisions"))
    head = F.expr("CASE run_id % 5 WHEN 0 THEN '{\"content_type\":\"event\",\"is_useful\":true,\"confidence\":1' WHEN 1 THEN '{\"content_type\":\"event\",\"is_useful\":\"so\",\"priority\":\"low\",\"confidence\":1' WHEN 2 THEN '{\"content_type\":\"event\",\"is_useful\":true,\"priority\":\"low\",\"confidence\":\"high\"' WHEN 3 THEN '{\"content_type\":\"event\",\"is_useful\":true,\"priority\":\"low\",\"confidence\":\" 0.25 \"' ELSE '{\"content_type\":\"event\",\"is_useful\":false,\"priority\":\"low\",\"confidence\":0.75' END")
    rest = F.lit(',"main_decision":"review","variants":[{"a":{"b":[1,{"c":null}]}},3],"sql_plan":[{"sql":"select 1"},{"sql":"select 2","requires_review":0},{"purpose":"none"}],"warnings":["w",4],"raw":[]}')
    return made.select("run_id", F.concat(head, F.lit(',"decisions":[1,'), "decisions", F.lit("]"), rest).alias("json"))


_NESTED = f"SELECT run_id, pos, field, {_DATA} AS data, {_VALUE} AS value FROM {{v_facts}} WHERE run_id % 5 > 2"


def decisions(rows):
    """A row for each decision of results read from their JSON."""
    each = rows.select("run_id", F.posexplode_outer("r.decisions").alias("pos", "x"), "r").filter("pos is not null")  # no filter below it, which would read the JSON again
    return each.select("run_id", (F.col("pos") + 1).alias("pos"), F.col("x.type").alias("field"), F.to_json("x.data").alias("data"), F.to_json(F.col("x.evidence")[0]["value"]).alias("value"), F.size("x.evidence").alias("n_evidence"), F.col("r.confidence").alias("confidence"), F.to_json(F.col("r.variants")[0]).alias("variant"), F.array_join(F.transform("r.sql_plan", lambda s: s["requires_review"].cast("string")), ",").alias("reviews"), F.array_join("r.warnings", ",").alias("warnings"))


@query("r18_nested_results", f"SELECT run_id, pos, field, data, value, 1 AS n_evidence, CASE WHEN run_id % 5 = 3 THEN 0.25 ELSE 0.75 END::DOUBLE AS confidence, '{{\"a\":{{\"b\":[1,{{\"c\":null}}]}}}}' AS variant, 'true,false' AS reviews, 'w' AS warnings FROM ({_NESTED}) q")
def _(spark, d):
    """Results from JSON text, to JSON text and back again: every nested value is as it was, wrong items are gone."""
    once = nested(spark, d).select("run_id", results.parsed(F.col("json")).alias("r"))
    again = once.select("run_id", results.parsed(results.as_json(F.col("r"))).alias("r"))
    return decisions(again)


@query("s19_nested_results", f"SELECT run_id, pos, field, data, value, batch, CASE WHEN batch = 2 THEN 'again' END AS note FROM (SELECT *, 1 AS batch FROM ({_NESTED}) a UNION ALL SELECT *, 2 FROM ({_NESTED}) b WHERE run_id % 3 = 0) q")
def _(spark, d):
    """Results added to a stored table in two batches, the second with a column more, and read back."""
    path = new_folder(spark, "results") + "/rows"
    made = nested(spark, d).select("run_id", results.parsed(F.col("json")).alias("r")).filter("r is not null")
    results.append(made.withColumn("batch", F.lit(1)), path)
    results.append(made.filter("run_id % 3 = 0").withColumns({"batch": F.lit(2), "note": F.lit("again")}), path)
    held = results.stored(spark, path)
    each = held.select("run_id", "batch", "note", F.posexplode("r.decisions").alias("pos", "x"))
    return each.select("run_id", (F.col("pos") + 1).alias("pos"), F.col("x.type").alias("field"), F.to_json("x.data").alias("data"), F.to_json(F.col("x.evidence")[0]["value"]).alias("value"), "batch", "note")


# Reports that are written and read back


@query("s9_written_json", "SELECT run_id, artist, city_name, event_date::VARCHAR AS event_date, verified, confidence FROM {v_occurrences}")
def _(spark, d):
    """Occurrences as JSON lines in a folder for each city, dates as ISO text; read back with their types."""
    rows, path = view(spark, d, "v_occurrences").select("run_id", "artist", "city_name", "event_date", "verified", "confidence"), new_folder(spark, "report") + "/rows"
    sinks.write_json(rows.withColumn("city", F.col("city_name")), path, "city")
    return spark.read.schema(rows.schema).json(path).select(rows.columns)


@query("s10_written_csv", "SELECT post_id, text, NULL AS said, NULL AS url FROM {posts} UNION ALL SELECT run_id, NULL, '{\"pos\":' || pos || ',\"status\":\"' || status || '\"}', NULL FROM {v_facts} UNION ALL SELECT run_id, NULL, NULL, url FROM {v_links}")
def _(spark, d):
    """Posts, facts and links as one CSV: the union of their columns as header, nested values as JSON text."""
    path = new_folder(spark, "report") + "/rows"
    facts = view(spark, d, "v_facts").select(F.col("run_id").alias("post_id"), F.struct("pos", "status").alias("said"))
    sinks.write_csv(path, view(spark, d, "posts").select("post_id", "text"), facts, view(spark, d, "v_links").select(F.col("run_id").alias("post_id"), "url"))
    read = sinks.read_csv(spark, path)
    return read.select(F.col("post_id").cast("long").alias("post_id"), "text", "said", "url")


@query("s11_written_text", "SELECT url AS line, count(*) AS n FROM {v_links} GROUP BY url")
def _(spark, d):
    """A report of plain lines, written and read back."""
    path = new_folder(spark, "report") + "/rows"
    sinks.write_text(view(spark, d, "v_links"), "url", path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("s21_written_failures", chain("SELECT post_id, source, kind, title, date_line, warnings FROM drafts WHERE warnings = 'not_an_event'", "drafts"))
def _(spark, d):
    """Drafts with one warning, written as JSON and read back."""
    path = new_folder(spark, "failures") + "/rows"
    failed = sinks.failures(drafts(spark, d), "not_an_event")
    sinks.write_json(failed, path)
    return spark.read.schema(failed.schema).json(path)


# The whole decision, whose query is registered with the verification

_SOCIAL = "regexp_matches(lower(url), 't\\.me/|telegram\\.me/|vk\\.com/|instagram\\.com/')"
_HIT = f"SELECT f.run_id, f.pos, arg_min(p.url, page_pos) AS page_url FROM {{v_facts}} f JOIN ({_PAGES}) p ON p.run_id = f.run_id WHERE CASE WHEN field = 'дата' THEN {has_date('try_cast(value AS DATE)')} ELSE {has(search_key('value'))} END GROUP BY f.run_id, f.pos"
_SOURCE = "CASE WHEN regexp_matches(lower({u}), 't\\.me/|telegram\\.me/') THEN 'social' ELSE {s} END"
_PROVEN = "(s IN ('official', 'ticket') AND u <> '' OR s IN ('manual', 'social'))"
_STEPS = {
    "o": f"SELECT run_id, (v OR m.url IS NOT NULL) AND coalesce(m.url, source_url) <> '' AS v, CASE WHEN m.url IS NOT NULL THEN greatest(c, m.score, 0.9) ELSE c END AS c FROM (SELECT run_id, pos, source_url, verified AND source_url <> '' AS v, CASE WHEN verified AND source_url <> '' THEN confidence ELSE least(confidence, 0.5) END AS c FROM {{v_occurrences}}) q LEFT JOIN ({_MATCH}) m USING (run_id, pos)",
    "os": "SELECT run_id, v, CASE WHEN v THEN c ELSE least(c, 0.5) END AS c FROM o",
    "k1": f"SELECT run_id, pos, url, CASE WHEN {_SOCIAL} AND kind IN ('official', 'ticket') THEN 'social' ELSE kind END AS kind, verified AND NOT {_SOCIAL} AS v FROM {{v_links}}",
    "proven": _page_facts("k1"),
    "k": f"SELECT k1.run_id, kind, (v OR (kind IN ('ticket', 'official', 'source') AND (u.pos IS NOT NULL OR p.pos IS NOT NULL))) AND NOT {_SOCIAL} AS v FROM k1 LEFT JOIN ({_BY_URL}) u USING (run_id, pos) LEFT JOIN proven p USING (run_id, pos)",
    "f1": f"SELECT run_id, pos, s, u, CASE WHEN status = 'verified' AND (NOT {_PROVEN} OR s = 'search') THEN 'unverified' ELSE status END AS status FROM (SELECT run_id, pos, status, source_url AS u, {_SOURCE.format(u='source_url', s=_ST)} AS s FROM {{v_facts}}) q",
    "f": f"SELECT run_id, s, CASE WHEN status = 'verified' AND (NOT {_PROVEN} OR s = 'search') THEN 'unverified' ELSE status END AS status FROM (SELECT run_id, coalesce(page_url, u) AS u, {_SOURCE.format(u='coalesce(page_url, u)', s='s')} AS s, CASE WHEN page_url IS NOT NULL THEN 'verified' ELSE status END AS status FROM f1 LEFT JOIN ({_HIT}) h USING (run_id, pos)) q",
    "m": "SELECT run_id, n_occurrences, v_occurrences, best_occurrence, v_official, v_ticket, unverified_tickets, v_facts, conflicts FROM (SELECT run_id, count(*) AS n_occurrences, count(*) FILTER (v) AS v_occurrences, max(c) AS best_occurrence FROM os GROUP BY run_id) a JOIN (SELECT run_id, count(*) FILTER (v AND kind = 'official') AS v_official, count(*) FILTER (v AND kind = 'ticket') AS v_ticket, count(*) FILTER (NOT v AND kind = 'ticket') AS unverified_tickets FROM k GROUP BY run_id) b USING (run_id) JOIN (SELECT run_id, count(*) FILTER (status = 'verified' AND s IN ('official', 'ticket', 'manual')) AS v_facts, count(*) FILTER (status = 'conflicted') AS conflicts FROM f GROUP BY run_id) c USING (run_id)",
    "scored": "SELECT *, round(CASE WHEN unverified_tickets > 0 THEN least(raw, 0.8) ELSE raw END, 6) AS overall FROM (SELECT *, greatest(best_occurrence, CASE WHEN v_occurrences > 0 AND v_official + v_ticket > 0 THEN 0.85 WHEN v_occurrences > 0 OR v_official + v_ticket > 0 THEN 0.7 ELSE 0 END) AS raw FROM m) q",
    "said": "SELECT *, array_to_string(list_filter([CASE WHEN n_occurrences = 0 THEN 'no_occurrence' END, CASE WHEN overall < 0.85 THEN 'low_confidence' END, CASE WHEN unverified_tickets > 0 THEN 'unverified_ticket_link' END, CASE WHEN v_occurrences = 0 THEN 'unverified_occurrence' END, CASE WHEN conflicts > 0 THEN 'conflicts' END], lambda x: x IS NOT NULL), ',') AS reasons FROM scored",
}
SQL["r14_r6_a16_decisions"] = with_views(
    "WITH " + ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in _STEPS.items()) + " SELECT run_id, n_occurrences, v_occurrences, best_occurrence::DOUBLE AS best_occurrence, v_official, v_ticket, unverified_tickets, v_facts, conflicts, v_occurrences + v_official + v_ticket + v_facts AS v_total, overall::DOUBLE AS overall, CASE WHEN n_occurrences = 0 THEN 'blocked' WHEN reasons = '' THEN 'auto_publish' ELSE 'needs_review' END AS decision, reasons FROM said"
)
