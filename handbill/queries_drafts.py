"""Queries over whole drafts, and the SQL of the cascade and of every part of a draft.

The SQL is one chain of steps (CHAIN), each of which reads those before it; a query's SQL is
the chain and a SELECT of its step.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_posts as q
from .functions import dates, fields
from .functions import text as t
from .operators import posts as p
from .operators import reports
from .plans.fixtures import plain, view, with_views
from .plans.shared import checkpointed
from .queries_posts import L, R, dated, ex, month, num, pick

QUERIES, SQL = {}, {}
RULES = fields.CONCERTS


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under the name."""

    def add(f):
        QUERIES[name] = lambda spark, d: plain(f(spark, d))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def flat(text: str) -> str:
    """A post's text as both engines clean it before its lines are read."""
    steps = ((r"\r\n?", "chr(10)"), (r"[ \t]+", "' '"), (r"([A-Za-z])(\d{1,2}\s+[А-Яа-яЁё])", r"'\1 \2'"), (r"([A-Za-z])(\d{1,2}[./]\d{1,2}(?:[./]\d{2,4})?)", r"'\1 \2'"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", "''"))
    sql = f"translate(coalesce({text}, ''), chr(160) || chr(8203) || chr(65279), ' ')"
    for pattern, to in steps:
        sql = f"regexp_replace({sql}, '{pattern}', {to}, 'g')"
    return sql


def one_line(raw: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({raw}, '[–—−]', '-', 'g'), '[«»„“”]', '\"', 'g'), '\\s+', ' ', 'g'))"


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(trim({x}), '^[^\\p{{L}}\\p{{N}}_]{{1,4}}\\s*', ''), '^[\\s\\-–—•*|:;,.]+|[\\s\\-–—•*|:;,]+$', '', 'g'), '\\s+', ' ', 'g'))"


def key(x: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace({clean(x)}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"


def alias(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in t.CITY_ALIASES.items()) + " END"


def safe_city(x: str) -> str:
    no = q._words_sql(("вход*", "билет*", "концерт*", "начало", "двери", "клуб", "афиша", "live", "чат*", "розыгрыш*", "возврат*"))
    return f"CASE WHEN regexp_matches({clean(x)}, '^\\p{{Lu}}\\p{{L}}+(?:[\\- ]\\p{{L}}+){{0,2}}$') AND NOT regexp_matches(lower({clean(x)}), '{no}') THEN coalesce({alias(key(x))}, nullif({clean(x)}, '')) END"


def label(name: str) -> str:
    return rf"(?i)^\s*(?:{'|'.join(RULES.labels[name])})\s*[:\-]\s*(.+?)\s*$"


FLAGS = {
    "is_labelled": " OR ".join(f"regexp_matches(line, '{label(n)}')" for n in RULES.labels),
    "is_date": q._FLAG["is_date"],
    "is_time": q._FLAG["is_time"],
    "is_age": r"regexp_matches(low, '(?:^|[^0-9])([0-9]{1,2})\s*(?:\+|лет(?:$|[^\p{L}]))')",
    "is_ticket": q._FLAG["is_ticket"],
    "is_promo": q._FLAG["is_promo"],
    "is_service": "regexp_matches(low, '" + "|".join(RULES.service_phrases) + r"') OR regexp_matches(line, '(?i)(?:https?://|www\.|t\.me/|vk\.com/)[^\s<>()]+')",
    "is_price": f"regexp_matches(low, '{L}(?:цена|стоимость|price){R}" + r"|[0-9]+\s*(?:руб|₽|р($|[^\p{L}]))')",
    "is_short": q._FLAG["is_short"],
}


def _cascade() -> tuple[str, str]:
    """Steps that give each line's first date range by the rules in order."""
    weekend = L + r"(эти|этих|следующие|следующих)\s+выходны(?:е|х)" + R
    week = L + r"(эта|эту|этой|следующая|следующую|следующей)\s+недел(?:я|ю|е)" + R
    english = L + r"(\d{1,2})\s+(" + "|".join(dates.ENGLISH_MONTHS) + r")(?:\s+(\d{4}))?" + R
    monday = lambda pattern, add: f"CASE WHEN regexp_matches(x, '{pattern}') THEN date_trunc('week', published)::DATE + {add} + CASE WHEN {ex(pattern, 1)} LIKE 'след%' THEN 7 ELSE 0 END END"
    dotted, worded = dated(ex(q._dot, 3), num(q._dot, 2), num(q._dot, 1)), dated(ex(q._word, 3), month(ex(q._word, 2)), num(q._word, 1))
    in_english = dated(ex(english, 3), pick(ex(english, 2), {m: k + 1 for k, m in enumerate(dates.ENGLISH_MONTHS)}), num(english, 1))
    day_range = tuple(f"published + {pick(ex(q._two, k), dates.DAY_WORDS)}" for k in (1, 2))
    span = f"(({pick(ex(q._range, 2), dates.WEEKDAYS)} - {pick(ex(q._range, 1), dates.WEEKDAYS)} + 7) % 7)::INT"
    rules = {
        "relative_range": day_range, "relative_day": (q._at,) * 2, "relative_offset": (q._offsets(),) * 2, "weekday_range": (q._first, f"{q._first} + {span}"), "weekday": (q._day,) * 2,
        "weekend": (monday(weekend, 5), f"{monday(weekend, 5)} + 1"), "week": (monday(week, 0), f"{monday(week, 0)} + 6"), "part_of_month": (q._ps, f"CASE WHEN {q._pf} = 21 THEN last_day({q._ps}) ELSE {q._ps} + 9 END"),
        "explicit_range": q._ranges(), "dotted": (dotted,) * 2, "worded": (worded,) * 2, "english": (in_english,) * 2,
    }
    assert list(rules) == list(dates.RULES)
    # Each rule only where its sign is: the two ends repeat costly searches.
    sign = lambda n: f"regexp_matches(x, '{dates.SIGNS[n]}')"
    tried = ", ".join(f"CASE WHEN {sign(n)} THEN ({a})::DATE END AS s_{n}, CASE WHEN {sign(n)} THEN ({b})::DATE END AS e_{n}" for n, (a, b) in rules.items())
    first = lambda what: "CASE " + " ".join(f"WHEN s_{n} <= e_{n} THEN {what(n)} END" if n == "english" else f"WHEN s_{n} <= e_{n} THEN {what(n)}" for n in rules)
    return f"SELECT post_id, pos, {tried} FROM ln", f"SELECT post_id, pos, {first(lambda n: f's_{n}')} AS start_date, {first(lambda n: f'e_{n}')} AS end_date, {first(repr)} AS rule FROM tried"


_TRIED, _FOUND = _cascade()
_APART = r"\s*(?:,|;|/|\||\s&\s|\s[xх]\s|\sи\s)\s*"
_PLACE = r"^\s*\d{1,2}(?:[./]\d{1,2}(?:[./]\d{2,4})?|\s+\p{L}+)\s*[-–—:]?\s*(\p{Lu}[\p{L}\- ]{1,40}?)\s*$"
_LINKED = r"(?i)^\s*(\p{Lu}[\p{L}\- ]{1,40}?)\s*[:\-–—]\s*(?:https?://|www\.|t\.me/)"
_URL = r"(?i)(?:https?://|www\.|t\.me/|vk\.com/)[^\s<>()]+"
_NAME = f"k <> '' AND length(artist) BETWEEN 2 AND 60 AND NOT regexp_matches(k, '{q._words_sql(('live', 'концерт*', 'афиша', 'розыгрыш*'))}')"
_TYPE = f"CASE WHEN regexp_matches(lower(coalesce(label, '')), '{'|'.join(RULES.ticket_words)}') OR regexp_matches(lower(url), '{'|'.join(RULES.ticket_hosts)}') THEN 'ticket' WHEN regexp_matches(lower(url), '(?:t|telegram)\\.me/') OR regexp_matches(lower(coalesce(label, '')), '{'|'.join(RULES.chat_words)}') THEN 'chat' ELSE 'external' END"
_IN_CITY = L + r"в\s+(" + "|".join(t.CITY_ALIASES) + ")" + R
_STREET = L + r"(?:ул\.|улица|просп\.|проспект|наб\.|набережная|street|ave)" + R + "|" + L + r"(?:ул|пр)\."
_CODE = r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(RULES.code_words) + r")(?:[^\S\r\n]+code)?[^\S\r\n]*(?:[:=\-]\s*|\s+)([\p{L}\p{N}][\p{L}\p{N}_-]{2,23})(?:$|[^\p{L}\p{N}_])"

STEPS = {
    "split": f"SELECT post_id, published, cast(generate_subscripts(string_split(n, chr(10)), 1) - 1 AS INT) AS pos, unnest(string_split(n, chr(10))) AS raw FROM (SELECT post_id, published, {flat('text')} AS n FROM {{posts}})",
    "plain": f"SELECT *, lower(line) AS low, regexp_replace(lower(line), '\\s+', '  ', 'g') AS x FROM (SELECT post_id, published, pos, {one_line('raw')} AS line FROM split) WHERE line <> ''",
    "ln": f"SELECT *, {key('line')} AS k, {', '.join(f'({c}) AS {n}' for n, c in FLAGS.items())} FROM plain",
    "tried": _TRIED,
    "found": _FOUND,
    "titles": f"SELECT post_id, trim(string_split({clean('arg_min(line, pos)')}, '|')[1]) AS title FROM ln WHERE NOT (is_labelled OR is_date OR is_time OR is_ticket OR is_service OR is_short) GROUP BY post_id",
    "block": "SELECT * FROM (SELECT *, max((is_labelled OR is_date OR is_time OR is_age OR is_ticket OR is_promo OR is_service)::INT) OVER (PARTITION BY post_id ORDER BY pos) AS ended FROM ln WHERE pos BETWEEN 1 AND 5) WHERE ended = 0",
    "parts": f"SELECT post_id, pos, part, artist, {key('artist')} AS k FROM (SELECT post_id, pos, unnest(regexp_split_to_array({clean('line')}, '{_APART}')) AS artist, generate_subscripts(regexp_split_to_array({clean('line')}, '{_APART}'), 1) AS part FROM block)",
    "good": f"SELECT b.* FROM parts b LEFT JOIN (SELECT post_id, {key('title')} AS tk FROM titles) USING (post_id) WHERE {_NAME} AND (tk IS NULL OR k <> tk)",
    "of_title": f"SELECT * FROM (SELECT post_id, -1 AS pos, 0 AS part, artist, {key('artist')} AS k FROM (SELECT post_id, regexp_split_to_array(title, '{_APART}')[1] AS artist FROM titles)) WHERE {_NAME} AND post_id NOT IN (SELECT post_id FROM good)",
    "artists": "SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY pos, part) AS \"at\", artist FROM (SELECT *, row_number() OVER (PARTITION BY post_id, k ORDER BY pos, part) AS n FROM (SELECT * FROM good UNION ALL SELECT * FROM of_title)) WHERE n = 1",
    "urls": f"SELECT post_id, pos, part, line, regexp_replace(CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u ELSE 'https://' || u END, '/+$', '') AS url FROM (SELECT post_id, pos, line, part, regexp_replace(u, '[.,;:!?)\\]}}''\"»]+$', '') AS u FROM (SELECT post_id, pos, line, unnest(regexp_extract_all(line, '{_URL}')) AS u, generate_subscripts(regexp_extract_all(line, '{_URL}'), 1) AS part FROM ln))",
    "linked": f"SELECT post_id, pos, part, url, nullif(trim(regexp_replace(trim(regexp_replace(regexp_replace(line, '{_URL}', ' ', 'g'), '\\s+', ' ', 'g')), '[\\s:\\-–—]+$', '')), '') AS label FROM urls UNION ALL SELECT post_id, pos, 999, 'https://t.me/' || h, line FROM (SELECT post_id, pos, line, regexp_extract(line, '(?:^|[^A-Za-z0-9_@])@([A-Za-z][A-Za-z0-9_]{{4,31}})', 1) AS h FROM ln WHERE regexp_matches(low, 'чат|беседа|обсуждение|chat')) WHERE h <> ''",
    "links": f"SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY pos, part) AS \"at\", url, label, {_TYPE} AS link_type FROM (SELECT *, row_number() OVER (PARTITION BY post_id, url ORDER BY pos, part) AS n FROM linked) WHERE n = 1",
    "placed": f"SELECT post_id, pos, coalesce(s_dotted, s_worded) AS event_date, {safe_city('place')} AS city FROM (SELECT *, {ex(_PLACE, 1, 'line')} AS place FROM ln JOIN tried USING (post_id, pos)) WHERE coalesce(s_dotted, s_worded) IS NOT NULL UNION ALL SELECT post_id, pos, NULL, {safe_city('place')} FROM (SELECT *, {ex(_LINKED, 1, 'line')} AS place FROM ln)",
    "schedule": "SELECT post_id, pos, event_date, city FROM (SELECT *, row_number() OVER (PARTITION BY post_id, city, event_date ORDER BY pos) AS n FROM placed WHERE city IS NOT NULL) WHERE n = 1",
    "clock": f"SELECT post_id, pos, i, concat_ws('@', CASE WHEN dd AND NOT ss THEN 'doors' WHEN ss THEN 'start' END, concat_ws('-', lpad(v, 5, '0'), CASE WHEN u <> '' THEN lpad(u, 5, '0') END)) AS said FROM (SELECT post_id, pos, i, v, u, regexp_matches(c, '{L}(?:двери|doors){R}') AS dd, regexp_matches(c, '{L}(?:начало|start|show){R}') AS ss FROM (SELECT post_id, pos, i, v, u, lower(right(b, 40)) AS c FROM (SELECT post_id, pos, unnest(regexp_extract_all(line, '{q._span}', 1)) AS v, generate_subscripts(regexp_extract_all(line, '{q._span}', 1), 1) AS i, unnest(regexp_extract_all(line, '{q._span}', 2)) AS u, unnest(regexp_split_to_array(line, '{q._cut}')) AS b FROM ln) WHERE v IS NOT NULL))",
    "times": "SELECT post_id, string_agg(said, ',' ORDER BY pos, i) AS times FROM (SELECT post_id, pos, said, min(i) AS i FROM clock GROUP BY ALL) GROUP BY post_id",
    "fielded": f"SELECT *, coalesce({safe_city('place')}, {alias('k')}, CASE WHEN NOT is_date THEN {alias(ex(_IN_CITY, 1, 'low'))} END) AS city, coalesce(nullif({ex(label('venue'), 1, 'line')}, ''), CASE WHEN regexp_matches(low, '{q._words_sql(('клуб*', 'арен*', 'бар*', 'hall', 'club'))}') AND NOT is_service THEN nullif(regexp_extract(line, '[\"«]([^\"»]+)[\"»]', 1), '') END) AS venue, CASE WHEN regexp_matches(low, '{_STREET}') THEN line END AS address FROM (SELECT *, CASE WHEN NOT is_labelled THEN {ex(_PLACE, 1, 'line')} END AS place FROM ln JOIN found USING (post_id, pos))",
    "single": "SELECT post_id, arg_min(start_date, pos) FILTER (rule IS NOT NULL) AS start_date, arg_min(end_date, pos) FILTER (rule IS NOT NULL) AS end_date, arg_min(rule, pos) FILTER (rule IS NOT NULL) AS date_rule, arg_min(line, pos) FILTER (rule IS NOT NULL) AS date_line, arg_min(city, pos) FILTER (city IS NOT NULL) AS city, arg_min(venue, pos) FILTER (venue IS NOT NULL) AS venue, arg_min(address, pos) FILTER (address IS NOT NULL) AS address, coalesce(any_value(times), '') AS times FROM fielded LEFT JOIN times USING (post_id) GROUP BY post_id",
    "many": "SELECT post_id, event_date, city, 'schedule' AS strategy FROM (SELECT *, count(*) OVER (PARTITION BY post_id) AS n FROM schedule) WHERE n >= 2",
    "occurrences": "SELECT * FROM many UNION ALL SELECT post_id, start_date, city, 'single' FROM single WHERE (start_date IS NOT NULL OR city IS NOT NULL) AND post_id NOT IN (SELECT post_id FROM many)",
    "known": f"SELECT post_id, {key('title')} AS k FROM titles UNION SELECT post_id, {key('artist')} FROM artists",
    "descriptions": "SELECT post_id, string_agg(line, chr(10) ORDER BY pos) AS description FROM ln ANTI JOIN known USING (post_id, k) WHERE NOT (is_labelled OR is_date OR is_time OR is_age OR is_ticket OR is_promo OR is_service OR is_price OR is_short) GROUP BY post_id",
    "codes": f"SELECT post_id, regexp_replace({ex(_CODE, 1, 'text')}, '[_-]+$', '') AS promo_codes FROM {{posts}} WHERE regexp_matches({ex(_CODE, 1, 'text')}, '\\p{{L}}') AND lower({ex(_CODE, 1, 'text')}) NOT IN ({', '.join(map(repr, RULES.no_codes))})",
    "drafts": "SELECT p.post_id, p.channel_id, p.source, p.published::VARCHAR AS published, z.kind, z.confidence AS kind_confidence, st.status, try_cast(nullif(regexp_extract(lower(p.text), '(?:^|[^0-9])([0-9]{1,2})\\s*(?:\\+|лет(?:$|[^\\p{L}]))', 1), '') AS INT) AS age_limit, coalesce(promo_codes, '') AS promo_codes, title, (SELECT string_agg(artist, ', ' ORDER BY \"at\") FROM artists a WHERE a.post_id = p.post_id) AS artists, (SELECT string_agg(url, ', ' ORDER BY \"at\") FROM links l WHERE l.post_id = p.post_id) AS links, coalesce((SELECT count(*) FROM links l WHERE l.post_id = p.post_id AND link_type = 'ticket'), 0) AS n_tickets, start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date, date_rule, date_line, coalesce(city, CASE WHEN n_nationkey % 3 = 0 THEN n_name END) AS city, venue, address, times, coalesce(n_occurrences, 0) AS n_occurrences, coalesce(n_dated, 0) AS n_dated, description, CASE WHEN kind IN ('giveaway', 'promo', 'low_signal') THEN 'not_an_event' WHEN coalesce(n_occurrences, 0) > 0 THEN '' WHEN kind = 'digest' THEN 'digest_without_dates' ELSE 'occurrence_not_found' END AS warnings FROM {posts} p JOIN (SELECT post_id, kind, confidence FROM kinds) z USING (post_id) JOIN statuses st USING (post_id) LEFT JOIN titles USING (post_id) LEFT JOIN single USING (post_id) LEFT JOIN codes USING (post_id) LEFT JOIN (SELECT post_id, count(*) AS n_occurrences, count(event_date) AS n_dated FROM occurrences GROUP BY post_id) USING (post_id) LEFT JOIN descriptions USING (post_id) LEFT JOIN nation ON n_nationkey = channel_id",
    "problems": "SELECT post_id, source, unnest(list_filter([CASE WHEN coalesce(title, '') = '' THEN 'no_title' END, CASE WHEN event AND start_date IS NULL THEN 'no_date' END, CASE WHEN event AND coalesce(city, '') = '' THEN 'no_city' END, CASE WHEN event AND coalesce(venue, '') = '' THEN 'no_venue' END, CASE WHEN event AND n_tickets = 0 THEN 'no_ticket_link' END, CASE WHEN warnings <> '' THEN 'has_warnings' END, CASE WHEN status = 'cancelled' AND links <> '' THEN 'cancelled_with_links' END], lambda x: x IS NOT NULL)) AS tag FROM (SELECT *, kind IN ('event', 'tour_announcement', 'unknown') AS event FROM drafts)",
    "stats": "SELECT source, count(*) AS total, count(*) FILTER (post_id IN (SELECT post_id FROM problems)) AS with_problems, round(count(*) FILTER (post_id IN (SELECT post_id FROM problems)) / count(*), 4) AS ratio FROM drafts GROUP BY source",
}
STEPS = {**STEPS, "kinds": q._KINDS, "statuses": q.SQL_STATUSES}
#: What each step reads of the others, in the order in which they must stand.
ORDER = ("split", "plain", "ln", "tried", "found", "titles", "block", "parts", "good", "of_title", "artists", "urls", "linked", "links", "placed", "schedule", "clock", "times", "fielded", "single", "many", "occurrences", "known", "descriptions", "codes", "kinds", "statuses", "drafts", "problems", "stats")


def chain(select: str, upto: str) -> str:
    held = ORDER[: ORDER.index(upto) + 1]
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({STEPS[n]})" for n in held) + " " + select


def drafts(spark, d):
    return checkpointed(q.drafts(spark, d))


def lines(spark, d):
    return p.lines(view(spark, d, "posts"))


@query("x1_cascade", chain("SELECT post_id, pos, start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date, rule FROM found WHERE rule IS NOT NULL", "found"))
def _(spark, d):
    """The whole cascade over every line of every post, with the rule that won."""
    r = dates.date_range(F.col("line"), F.col("published"))
    found = lines(spark, d).select("post_id", "pos", r.alias("r")).filter("r is not null")
    return found.select("post_id", "pos", F.col("r.start").alias("start_date"), F.col("r.end").alias("end_date"), F.col("r.source").alias("rule"))


#: Queries of the parts, registered with the posts, and their SQL.
SQL_OF_PARTS = {
    "x28_titles": chain("SELECT * FROM titles", "titles"),
    "x29_x30_artists": chain("SELECT post_id, \"at\"::INT AS \"at\", artist FROM artists", "artists"),
    "x22_x23_links": chain("SELECT post_id, \"at\"::INT AS \"at\", url, label, link_type FROM links", "links"),
    "x32_x34_schedules": chain("SELECT post_id, pos, event_date::VARCHAR AS event_date, city FROM schedule", "schedule"),
    "x35_x39_single_fields": chain("SELECT post_id, start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date, date_rule, date_line, city, venue, address, times FROM single", "single"),
    "x40_occurrences": chain("SELECT post_id, event_date::VARCHAR AS event_date, city, strategy FROM occurrences", "occurrences"),
    "x41_j18_descriptions": chain("SELECT * FROM descriptions", "descriptions"),
    "x46_source_lines": chain(f"SELECT post_id, arg_min(line, struct_pack(a := rank IS NULL, b := coalesce(rank, 9), c := pos)) AS source_line FROM (SELECT *, CASE WHEN regexp_matches(line, '{label('date')}') THEN 1 WHEN is_date THEN 2 WHEN pos >= 1 THEN 3 END AS rank FROM ln) GROUP BY post_id", "ln"),
    "x43_drafts": chain("SELECT * FROM drafts", "drafts"),
    "a1_completeness": chain("SELECT source, count(*) AS total, " + ", ".join(f"count(*) FILTER (coalesce({c}::VARCHAR, '') <> '') AS with_{n}" for n, c in reports.HAS.items()) + " FROM drafts GROUP BY source", "drafts"),
    "a2_problem_tags": chain("SELECT tag, count(*) AS n FROM problems GROUP BY tag", "problems"),
    "a3_warnings": chain("SELECT warnings AS warning, count(*) AS n FROM drafts WHERE warnings <> '' GROUP BY warnings", "drafts"),
    "a4_w3_source_stats": chain("SELECT * FROM stats", "stats"),
    "w2_examples": chain("SELECT tag, source, post_id, \"at\"::INT AS \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY source, post_id) AS \"at\" FROM problems) WHERE \"at\" <= 20", "problems"),
}
SQL |= {name: with_views(sql) for name, sql in SQL_OF_PARTS.items()}
