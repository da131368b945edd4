"""Draft facts against pages: matching, sanitising, confirming, scoring and deciding.

Tables are keyed by run_id; pos is an item's place in its run. Occurrences have artist,
city_name, venue_name, event_date, start_time, verified, confidence, source_url; links url,
kind, verified, confidence; facts field, value, status, source_type, confidence, source_url;
pages url, ok, blocked, status_code, title, text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields
from ..functions import text as t
from ..functions.dates import let
from ..plans.shared import spread
from .posts import once


@dataclass(frozen=True)
class Sources:
    """What is known of fields, sources and ticket sellers; a caller passes its own."""

    field_aliases: dict[str, str]
    source_types: dict[str, str]
    trusted: tuple[str, ...]
    ticket_hosts: tuple[str, ...]
    ticket_pages: tuple[str, ...]


#: A small set to go with fields.CONCERTS.
SOURCES = Sources(
    field_aliases={"дата": "date", "date": "date", "город": "city", "city": "city", "артист": "artist", "artist": "artist", "место": "venue", "venue": "venue", "цена": "price", "price": "price"},
    source_types={"official_site": "official", "official": "official", "ticket_service": "ticket", "tickets": "ticket", "search": "search", "user": "user_input", "user_input": "user_input", "manual": "manual"},
    trusted=("official", "ticket", "manual"),
    ticket_hosts=fields.CONCERTS.ticket_hosts,
    ticket_pages=(*fields.CONCERTS.ticket_hosts, *fields.CONCERTS.ticket_words),
)
# Fixed values.
MONTH_WORDS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def usable(pages: DataFrame) -> DataFrame:
    """Pages that were read: ok, no robot check, no error status."""
    return pages.filter(F.col("ok") & ~F.col("blocked") & (F.col("status_code").isNull() | F.col("status_code").between(200, 399)))


def haystack() -> Column:
    """A page's address, title and text as one search key."""
    return t.search_key(F.concat_ws(" ", "url", "title", "text"))


def date_spellings(day: Column) -> Column:
    """Search keys of a day: ISO, dotted with and without noughts, day and month word; empty for null."""
    word = F.element_at(F.array(*map(F.lit, MONTH_WORDS)), F.month(day))
    forms = F.array(F.date_format(day, "yyyy MM dd"), F.date_format(day, "dd MM yyyy"), F.date_format(day, "d.MM.yyyy"), F.date_format(day, "d.M.yyyy"), F.concat_ws(" ", F.dayofmonth(day).cast("string"), word))
    return F.when(day.isNull(), F.array().cast("array<string>")).otherwise(F.transform(forms, t.search_key))


def city_spellings(city: Column) -> Column:
    """Search keys of a city and of every alias of its canonical name."""
    named = lambda canonical: F.array(city, canonical, *(F.when(F.lit(name) == canonical, F.lit(alias)) for alias, name in t.CITY_ALIASES.items()))
    spelled = let(t.city_name(city), lambda canonical: F.array_distinct(F.transform(F.array_compact(named(canonical)), t.search_key)))
    return F.filter(spelled, lambda v: v != "")


def held(page: Column, values: Column) -> Column:
    """Whether a search key contains any of the values as whole words."""
    return F.exists(values, lambda v: (v != "") & F.contains(F.concat(F.lit(" "), page, F.lit(" ")), F.concat(F.lit(" "), v, F.lit(" "))))


def occurrence_matches(occurrences: DataFrame, pages: DataFrame) -> DataFrame:
    """run_id, pos, page_pos, url, n_fields, score: the best page of each occurrence that at least three fields support.

    The score is .70 and .08 for the artist, .08 the date, .05 the city, .07 the venue, .05
    the time, at most .98; the first page wins a tie. Pages are joined within their run.
    """
    page = usable(pages).select("run_id", F.col("pos").alias("page_pos"), "url", haystack().alias("hay"))
    one = lambda c: F.array(t.search_key(F.col(c)))
    spelled = {"artist": one("artist"), "date": date_spellings(F.col("event_date")), "city": city_spellings(F.col("city_name")), "venue": one("venue_name"), "time": one("start_time")}
    both = occurrences.select("run_id", "pos", *(c.alias(f"as_{n}") for n, c in spelled.items())).join(page, "run_id")  # spelled once, not for each page
    hits = {n: held(F.col("hay"), F.col(f"as_{n}")) for n in spelled}
    weights = {"artist": 0.08, "date": 0.08, "city": 0.05, "venue": 0.07, "time": 0.05}
    flagged = both.withColumns({f"has_{n}": c for n, c in hits.items()})
    n = sum((F.col(f"has_{k}").cast("int") for k in weights), F.lit(0))
    score = F.round(F.least(sum((F.when(F.col(f"has_{k}"), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.7)), F.lit(0.98)), 6)
    strong = flagged.withColumns({"n_fields": n, "score": score}).filter(F.col("n_fields") >= 3)
    best = F.max_by(F.struct("page_pos", "url", "n_fields", "score"), F.struct("score", -F.col("page_pos"))).alias("best")
    return strong.groupBy("run_id", "pos").agg(best).select("run_id", "pos", "best.*")


def links_by_url(links: DataFrame, pages: DataFrame) -> DataFrame:
    """run_id, pos, page_pos: links whose address is a read page's, whatever the case or closing slash."""
    page = usable(pages).select("run_id", t.url_loose_key(F.col("url")).alias("key"), F.col("pos").alias("page_pos"))
    return links.withColumn("key", t.url_loose_key(F.col("url"))).join(page, ["run_id", "key"]).groupBy("run_id", "pos").agg(F.min("page_pos").alias("page_pos"))


def links_by_domain(links: DataFrame, pages: DataFrame) -> DataFrame:
    """run_id, pos, page_pos, exact: the first page on the link's domain, else on a domain above or below it."""
    page = usable(pages).select("run_id", t.url_domain(F.col("url")).alias("domain"), F.col("pos").alias("page_pos"))
    link = links.select("run_id", "pos", t.url_domain(F.col("url")).alias("domain"))
    exact = link.join(page, ["run_id", "domain"]).groupBy("run_id", "pos").agg(F.min("page_pos").alias("page_pos")).withColumn("exact", F.lit(True))
    rest = link.join(exact.select("run_id", "pos"), ["run_id", "pos"], "left_anti")

    def suffixes(df: DataFrame, name: str) -> DataFrame:
        parts = F.split("domain", r"\.")
        return df.withColumn(name, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))))

    below = suffixes(rest, "up").join(page.select("run_id", F.col("domain").alias("up"), "page_pos"), ["run_id", "up"])
    above = rest.join(suffixes(page, "up").select("run_id", F.col("up").alias("domain"), "page_pos"), ["run_id", "domain"])
    near = below.select("run_id", "pos", "page_pos").unionByName(above.select("run_id", "pos", "page_pos")).groupBy("run_id", "pos").agg(F.min("page_pos").alias("page_pos")).withColumn("exact", F.lit(False))
    return exact.unionByName(near)


def fact_matches(facts: DataFrame, pages: DataFrame, known: Sources = SOURCES) -> DataFrame:
    """run_id, pos, page_pos, url: the first page that contains a fact's value, by the spellings of its kind."""
    page = usable(pages).select("run_id", F.col("pos").alias("page_pos"), "url", haystack().alias("hay"))
    field = canonical_field(F.col("field"), known)
    values = F.when(field == "date", date_spellings(F.col("value").try_cast("date"))).when(field == "city", city_spellings(F.col("value"))).otherwise(F.array(t.search_key(F.col("value"))))
    both = facts.select("run_id", "pos", values.alias("spellings")).join(page, "run_id").filter(held(F.col("hay"), F.col("spellings")))
    return both.groupBy("run_id", "pos").agg(F.min_by(F.struct("page_pos", "url"), "page_pos").alias("best")).select("run_id", "pos", "best.*")


def canonical_field(field: Column, known: Sources = SOURCES) -> Column:
    low = F.lower(F.trim(field))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in known.field_aliases.items() for x in p)), low), low)


def canonical_source(source_type: Column, url: Column, known: Sources = SOURCES) -> Column:
    """The source type by its aliases; a Telegram address makes it social, an unknown name unknown."""
    named = F.element_at(F.create_map(*(F.lit(x) for p in known.source_types.items() for x in p)), F.lower(F.trim(source_type)))
    return F.when(F.lower(t.text_or_empty(url)).rlike(r"t\.me/|telegram\.me/"), "social").otherwise(F.coalesce(named, F.lit("unknown")))


def is_ticket_url(url: Column, known: Sources = SOURCES) -> Column:
    return F.lower(t.text_or_empty(url)).rlike("|".join(known.ticket_hosts))


def sanitize_links(links: DataFrame) -> DataFrame:
    """A Telegram or social address is never official and is not verified; an unverified link is capped at .5."""
    social = F.lower("url").rlike(r"t\.me/|telegram\.me/|vk\.com/|instagram\.com/")
    kind = F.when(social & F.col("kind").isin("official", "ticket"), "social").otherwise(F.col("kind"))
    sure = F.col("verified") & ~social
    return links.withColumns({"changed": (kind != F.col("kind")) | (sure != F.col("verified")), "confidence": F.when(sure, F.col("confidence")).otherwise(F.least("confidence", F.lit(0.5))), "kind": kind, "verified": sure})


def sanitize_occurrences(occurrences: DataFrame) -> DataFrame:
    """Without an external source an occurrence is not verified and is capped at .5."""
    proven = t.blank_to_null(F.col("source_url")).isNotNull()
    sure = F.col("verified") & proven
    return occurrences.withColumns({"changed": sure != F.col("verified"), "confidence": F.when(sure, F.col("confidence")).otherwise(F.least("confidence", F.lit(0.5))), "verified": sure})


def sanitize_facts(facts: DataFrame, known: Sources = SOURCES) -> DataFrame:
    """Canonical fields and sources; what only search or an untrusted source without an address says is unverified."""
    source = canonical_source(F.col("source_type"), F.col("source_url"), known)
    proven = (source.isin(*known.trusted) & (t.blank_to_null(F.col("source_url")).isNotNull() | (source == "manual"))) | (source == "social")
    status = F.when((F.col("status") == "verified") & (~proven | (source == "search")), "unverified").otherwise(F.col("status"))
    return facts.withColumns({"field": canonical_field(F.col("field"), known), "source_type": source, "changed": status != F.col("status"), "confidence": F.when(status == "verified", F.col("confidence")).otherwise(F.least("confidence", F.lit(0.5))), "status": status})


def changed_runs(*tables: DataFrame) -> DataFrame:
    """run_id, changed: whether any row of a run was changed."""
    rows = [d.select("run_id", "changed") for d in tables]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every.groupBy("run_id").agg(F.bool_or("changed").alias("changed"))


def confirm_occurrences(occurrences: DataFrame, pages: DataFrame) -> DataFrame:
    """Occurrences that a page supports are verified with its address and at least .9."""
    found = occurrence_matches(occurrences, pages).select("run_id", "pos", F.col("url").alias("page_url"), "score")
    joined = occurrences.join(found, ["run_id", "pos"], "left")
    hit = F.col("page_url").isNotNull()
    return joined.withColumns({"verified": F.col("verified") | hit, "confidence": F.when(hit, F.greatest("confidence", "score", F.lit(0.9))).otherwise(F.col("confidence")), "source_url": F.coalesce("page_url", "source_url")}).drop("page_url", "score")


def links_by_page_facts(links: DataFrame, pages: DataFrame, occurrences: DataFrame, known: Sources = SOURCES) -> DataFrame:
    """run_id, pos: links whose page by domain holds three of the run's facts, or two for a ticket link on a ticket page.

    Any artist of the run counts once; each occurrence's date, city and venue count each.
    """
    page = usable(pages).select("run_id", F.col("pos").alias("page_pos"), haystack().alias("hay"), F.lower(F.concat_ws(" ", "url", "title")).rlike("|".join(known.ticket_pages)).alias("tickets"))
    met = links_by_domain(links, pages).select("run_id", "pos", "page_pos").join(links.select("run_id", "pos", "kind"), ["run_id", "pos"]).filter(F.col("kind").isin("ticket", "official", "source"))
    one = lambda c: F.array(t.search_key(F.col(c)))
    spelled = occurrences.select("run_id", one("artist").alias("as_artist"), date_spellings(F.col("event_date")).alias("as_date"), city_spellings(F.col("city_name")).alias("as_city"), one("venue_name").alias("as_venue"))
    said = met.select("run_id", "page_pos").distinct().join(page, ["run_id", "page_pos"]).join(spelled, "run_id")
    has = lambda name: F.coalesce(held(F.col("hay"), F.col(f"as_{name}")), F.lit(False)).cast("int")
    counted = said.select("run_id", "page_pos", "tickets", has("artist").alias("artist"), (has("date") + has("city") + has("venue")).alias("rest"))
    facts = counted.groupBy("run_id", "page_pos").agg((F.max("artist") + F.sum("rest")).alias("n"), F.bool_or("tickets").alias("tickets"))
    return met.join(facts, ["run_id", "page_pos"]).filter((F.col("n") >= 3) | ((F.col("kind") == "ticket") & F.col("tickets") & (F.col("n") >= 2))).select("run_id", "pos")


def confirm_links(links: DataFrame, pages: DataFrame, occurrences: DataFrame, known: Sources = SOURCES) -> DataFrame:
    """Ticket and official links whose page was read are verified: 1.0 by address, .8 by domain if the page holds the run's facts."""
    by_url = links_by_url(links, pages).select("run_id", "pos", F.lit(1.0).alias("by_url"))
    by_domain = links_by_page_facts(links, pages, occurrences, known).select("run_id", "pos", F.lit(0.8).alias("by_domain"))
    joined = links.join(by_url, ["run_id", "pos"], "left").join(by_domain, ["run_id", "pos"], "left")
    sure = F.when(F.col("kind").isin("ticket", "official", "source"), F.coalesce("by_url", "by_domain"))
    return joined.withColumns({"verified": F.col("verified") | sure.isNotNull(), "confidence": F.greatest("confidence", F.coalesce(sure, F.lit(0.0)))}).drop("by_url", "by_domain")


def confirm_facts(facts: DataFrame, pages: DataFrame, known: Sources = SOURCES) -> DataFrame:
    """Facts that a page contains are verified with its address and at least .9."""
    found = fact_matches(facts, pages, known).select("run_id", "pos", F.col("url").alias("page_url"))
    joined, hit = facts.join(found, ["run_id", "pos"], "left"), F.col("page_url").isNotNull()
    return joined.withColumns({"status": F.when(hit, "verified").otherwise(F.col("status")), "confidence": F.when(hit, F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence")), "source_url": F.coalesce("page_url", "source_url")}).drop("page_url")


def run_metrics(occurrences: DataFrame, links: DataFrame, facts: DataFrame, known: Sources = SOURCES) -> DataFrame:
    """Verified counts of each run: occurrences with a source, official and ticket links, facts of trusted sources, unverified tickets."""
    proven = F.col("verified") & t.blank_to_null(F.col("source_url")).isNotNull()
    o = occurrences.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_occurrences"), F.count_if(proven).alias("v_occurrences"), F.max("confidence").alias("best_occurrence"))
    k = links.groupBy("run_id").agg(F.count_if(F.col("verified") & (F.col("kind") == "official")).alias("v_official"), F.count_if(F.col("verified") & (F.col("kind") == "ticket")).alias("v_ticket"), F.count_if(~F.col("verified") & (F.col("kind") == "ticket")).alias("unverified_tickets"))
    f = facts.groupBy("run_id").agg(F.count_if((F.col("status") == "verified") & F.col("source_type").isin(*known.trusted)).alias("v_facts"), F.count_if(F.col("status") == "conflicted").alias("conflicts"))
    joined = o.join(k, "run_id", "full").join(f, "run_id", "full").fillna(0)
    return joined.withColumn("v_total", F.col("v_occurrences") + F.col("v_official") + F.col("v_ticket") + F.col("v_facts"))


def overall_confidence(metrics: DataFrame) -> DataFrame:
    """A floor of .85 with a verified occurrence and link, .70 with either; .8 at most while tickets are unverified."""
    some, link = F.col("v_occurrences") > 0, F.col("v_official") + F.col("v_ticket") > 0
    floor = F.when(some & link, 0.85).when(some | link, 0.7).otherwise(0.0)
    raw = F.greatest(F.coalesce("best_occurrence", F.lit(0.0)), floor)
    return metrics.withColumn("overall", F.round(F.when(F.col("unverified_tickets") > 0, F.least(raw, F.lit(0.8))).otherwise(raw), 6))


def decide(scored: DataFrame, auto: float = 0.85) -> DataFrame:
    """decision and reasons: blocked without an occurrence, published when sure and nothing asks for review, else review."""
    reasons = F.array_compact(F.array(F.when(F.col("overall") < auto, "low_confidence"), F.when(F.col("unverified_tickets") > 0, "unverified_ticket_link"), F.when(F.col("v_occurrences") == 0, "unverified_occurrence"), F.when(F.col("conflicts") > 0, "conflicts")))
    blocks = F.array_compact(F.array(F.when(F.col("n_occurrences") == 0, "no_occurrence")))
    decision = F.when(F.size(blocks) > 0, "blocked").when(F.size(reasons) == 0, "auto_publish").otherwise("needs_review")
    return scored.withColumns({"decision": decision, "reasons": F.array_join(F.concat(blocks, reasons), ",")})


def verify(occurrences: DataFrame, links: DataFrame, facts: DataFrame, pages: DataFrame, known: Sources = SOURCES) -> DataFrame:
    """The whole job: sanitise, confirm by pages, sanitise again, count, score and decide."""
    o = sanitize_occurrences(confirm_occurrences(sanitize_occurrences(occurrences), pages))
    k = sanitize_links(confirm_links(sanitize_links(links), pages, occurrences, known))
    f = sanitize_facts(confirm_facts(sanitize_facts(facts, known), pages, known), known)
    return decide(overall_confidence(run_metrics(o, k, f, known)))


def issues(drafts: DataFrame) -> DataFrame:
    """run_id, severity, message of review drafts (title, artist, city_name, event_date, venue_name, verified, n_tickets)."""
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    rule = lambda when, severity, message: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message")))
    rules = F.array_compact(
        F.array(
            rule(empty("title"), "error", "title is missing"), rule(empty("artist"), "warning", "artist is missing"), rule(empty("city_name"), "error", "city is missing"), rule(empty("event_date"), "error", "date is missing"),
            rule(empty("venue_name"), "warning", "venue is missing"), rule(~F.col("verified"), "warning", "occurrence is not verified"), rule(F.col("n_tickets") == 0, "info", "no ticket link"),
        )
    )
    return drafts.select("run_id", F.explode(rules).alias("issue")).select("run_id", "issue.*")


def issue_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity", "message").agg(F.count(F.lit(1)).alias("n"))


def without_refuted(rows: DataFrame, metrics: DataFrame, refutes: dict[str, str]) -> DataFrame:
    """Issues minus those that a verified count refutes: message -> the metric that is over 0."""
    counts = metrics.select("run_id", F.explode(F.array(*(F.when(F.col(m) > 0, F.lit(text)) for text, m in refutes.items()))).alias("message")).filter("message is not null")
    return rows.join(counts, ["run_id", "message"], "left_anti")


def merge_links(first: DataFrame, second: DataFrame) -> DataFrame:
    """The union of two link tables; of equal addresses whatever the case the first table's row stays."""
    every = first.withColumn("src", F.lit(0)).unionByName(second.withColumn("src", F.lit(1)))
    order = Window.partitionBy("run_id", t.url_loose_key(F.col("url"))).orderBy("src", "pos")
    return every.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "src")


def trust(evidence: DataFrame, known: Sources = SOURCES) -> DataFrame:
    """Evidence with its confidence and status corrected: weak words are low and unverified; search is never
    verified nor high; an untrusted source without an address is unverified."""
    weak = F.lower(t.text_or_empty(F.col("explanation"))).rlike("возможно|вероятно|maybe|probably|assum")
    source, bare = canonical_source(F.col("source_type"), F.col("source_url"), known), t.blank_to_null(F.col("source_url")).isNull()
    label = F.when(weak, "low").when((source == "search") & (F.col("label") == "high"), "medium").otherwise(F.col("label"))
    status = F.when((F.col("status") == "verified") & (weak | (source == "search") | (~source.isin(*known.trusted) & bare)), "unverified").otherwise(F.col("status"))
    return evidence.withColumns({"label": label, "status": status})


def supports(value: Column, page: Column) -> Column:
    """Whether a page supports a value: it contains it, or its first four words of four letters or more, as substrings."""
    key, hay = t.search_key(value), t.search_key(page)
    tokens = F.slice(F.filter(F.split(key, " "), lambda w: F.length(w) >= 4), 1, 4)
    return (key != "") & (F.contains(hay, key) | ((F.size(tokens) > 0) & F.forall(tokens, lambda w: F.contains(hay, w))))


def label_of(score: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


#: The second pair of cut-offs in use, for synchronised drafts.
SYNC_CUTS = (0.85, 0.55)


def score_of(label: Column) -> Column:
    return F.when(label == "high", 0.9).when(label == "medium", 0.65).when(label == "low", 0.35).otherwise(0.0)


def occurrence_confidence(city: Column, date: Column, venue: Column) -> Column:
    """.25 for a city and a venue each, .3 for a date, from a floor of .4."""
    has = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""
    return F.round(F.greatest(F.when(has(city), 0.25).otherwise(0.0) + F.when(has(date), 0.3).otherwise(0.0) + F.when(has(venue), 0.25).otherwise(0.0), F.lit(0.4)), 6)


def truthy(value: Column) -> Column:
    return F.lower(F.trim(t.text_or_empty(value))).isin("true", "yes", "1", "да")


def manual_flag(metadata: Column, keys: tuple[str, ...] = ("manual_confirmation", "confirmed_by_user", "manual", "trusted")) -> Column:
    return F.exists(F.array(*map(F.lit, keys)), lambda k: truthy(F.element_at(metadata, k)))


RESULT = "title string, is_useful string, confidence string, recommendation string, occurrences array<struct<city_name:string,event_date:string,verified:string,confidence:string>>, links array<struct<url:string,kind:string>>, missing_fields array<string>"


def parse_results(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed rows of JSON answers in free text (run_id, text), and the rows that hold no JSON object.

    Wrong types become null or the default; a confidence is clamped to 0 and 1; a boolean is
    no number.
    """
    held = texts.withColumn("json", t.balanced_object(F.regexp_replace("text", r"(?m)^```(?:json)?\s*$", ""))).withColumn("data", F.from_json("json", RESULT))
    clamp = lambda c: F.least(F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    good = held.filter(F.try_parse_json("json").isNotNull()).select(
        "run_id", t.blank_to_null(F.col("data.title")).alias("title"), truthy(F.col("data.is_useful")).alias("is_useful"), F.when(F.col("data.confidence").isin("true", "false"), 0.0).otherwise(clamp(F.col("data.confidence"))).alias("confidence"),
        F.coalesce(t.blank_to_null(F.col("data.recommendation")), F.lit("needs_review")).alias("recommendation"), F.coalesce(F.size("data.occurrences"), F.lit(0)).alias("n_occurrences"),
        F.coalesce(F.array_join(F.transform("data.links", lambda x: x["url"]), ","), F.lit("")).alias("links"), F.coalesce(F.array_join("data.missing_fields", ","), F.lit("")).alias("missing"),
    )
    return good, held.filter(F.try_parse_json("json").isNull()).select("run_id", F.left("text", F.lit(500)).alias("preview"))


def summary_text(rows: DataFrame) -> DataFrame:
    """run_id, text: one line for each fact, marked by its status, then the decision (facts joined to decisions)."""
    mark = F.when(F.col("status") == "verified", "✅").otherwise("⚠️")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.concat(mark, F.lit(" "), "field", F.lit(": "), "value").alias("line"))))
    return rows.groupBy("run_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("facts"), F.first("decision").alias("decision")).select("run_id", F.concat_ws("\n", "facts", F.concat(F.lit("→ "), "decision")).alias("text"))


def synced(drafts: DataFrame, verified: DataFrame) -> DataFrame:
    """Draft occurrences with what they lack taken from the verified one at the same place of the run."""
    known = [c for c in verified.columns if c in drafts.columns and c not in ("run_id", "pos")]
    found = verified.select("run_id", "pos", *(F.col(c).alias(f"_v_{c}") for c in known))
    joined = drafts.join(found, ["run_id", "pos"], "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_v_{c}"), t.blank_to_null(F.col(c))) if c == "source_url" else F.coalesce(F.col(c), F.col(f"_v_{c}")) for c in known}).drop(*(f"_v_{c}" for c in known))


def best_source(links: DataFrame, facts: DataFrame) -> DataFrame:
    """run_id, url: the first verified official link, else the first fact's source."""
    official = links.filter("verified and kind = 'official'").select("run_id", F.lit(0).alias("rank"), "pos", "url")
    said = facts.select("run_id", F.lit(1).alias("rank"), "pos", t.blank_to_null(F.col("source_url")).alias("url")).filter("url is not null")
    runs = links.select("run_id").unionByName(facts.select("run_id")).distinct()
    return runs.join(official.unionByName(said).groupBy("run_id").agg(F.min_by("url", F.struct("rank", "pos")).alias("url")), "run_id", "left")


def page_evidence(pages: DataFrame, known: Sources = SOURCES) -> DataFrame:
    """An evidence row for each page that was read."""
    return usable(pages).select("run_id", F.lit("page").alias("field"), F.col("title").alias("value"), F.lit("verified").alias("status"), F.when(is_ticket_url(F.col("url"), known), "ticket_service").otherwise("official_site").alias("source_type"), F.col("url").alias("source_url"))


#: How sure an input's own words make a field.
INPUT_CONFIDENCE = {"title": 0.6, "artist": 0.6, "event_type": 0.5, "date": 0.6, "city": 0.6, "venue": 0.6, "price": 0.5, "age_limit": 0.5}
_EVIDENCE = ("run_id", "field", "value", "status", "source_type", "source_url", "confidence")


def input_evidence(inputs: DataFrame) -> DataFrame:
    """Evidence rows of what an input says itself: a row for each field that has a value (run_id and columns named like the fields)."""
    value = lambda name: F.lit("concert") if name == "event_type" else F.col(name).cast("string")
    said = [F.when(F.trim(F.col("artist" if n == "event_type" else n).cast("string")) != "", F.struct(F.lit(n).alias("field"), value(n).alias("value"), F.lit(c).alias("confidence"))) for n, c in INPUT_CONFIDENCE.items()]
    rows = inputs.select("run_id", F.explode(F.array_compact(F.array(*said))).alias("e"))
    return rows.select("run_id", "e.field", "e.value", F.lit("input").alias("status"), F.lit("input_text").alias("source_type"), F.lit("").alias("source_url"), "e.confidence")


def link_evidence(links: DataFrame, known: Sources = SOURCES) -> DataFrame:
    """Evidence rows of the addresses to be verified (run_id, url): social, ticket or official, by the address."""
    kind = F.when(F.lower("url").rlike(r"(?:t|telegram)\.me/"), "social_link").when(is_ticket_url(F.col("url"), known), "ticket_link").otherwise("official_source")
    return links.filter(F.col("url").rlike("^https?://")).select("run_id", kind.alias("field"), "url", F.lit("input").alias("status"), F.lit("input_text").alias("source_type"), F.lit("").alias("source_url"), F.lit(0.4).alias("confidence")).toDF(*_EVIDENCE)


def read_evidence(inputs: DataFrame, pages: DataFrame, known: Sources = SOURCES) -> DataFrame:
    """Evidence rows of pages that were read: the page itself, and each of its run's facts that it holds."""
    page = usable(pages).select("run_id", "url", "title", "text")
    own = page.select("run_id", F.when(is_ticket_url(F.col("url"), known), F.struct(F.lit("ticket_link").alias("field"), F.lit("unverified").alias("status"), F.lit(0.5).alias("confidence"))).otherwise(F.struct(F.lit("official_source").alias("field"), F.lit("verified").alias("status"), F.lit(0.9).alias("confidence"))).alias("e"), "url")
    own = own.select("run_id", "e.field", F.col("url").alias("value"), "e.status", F.lit("url").alias("source_type"), F.col("url").alias("source_url"), "e.confidence")
    fact = lambda n: F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value"), F.array(t.search_key(F.col(n).cast("string"))).alias("key"))
    facts = once(inputs.select("run_id", "title", "artist", "date", "city", "venue"), F.array(*(fact(n) for n in ("title", "artist", "date", "city", "venue"))).alias("facts")).select("run_id", "facts")  # spelled once, not for each page
    said = facts.join(once(spread(page, "run_id"), haystack().alias("hay")).select("run_id", "url", "hay"), "run_id").select("run_id", "url", F.explode(F.filter("facts", lambda f: held(F.col("hay"), f["key"]))).alias("f"))
    return own.unionByName(said.select("run_id", "f.field", "f.value", F.lit("verified").alias("status"), F.lit("url").alias("source_type"), F.col("url").alias("source_url"), F.lit(0.9).alias("confidence")))


def rule_evidence(inputs: DataFrame, links: DataFrame, pages: DataFrame, known: Sources = SOURCES) -> DataFrame:
    """All evidence that rules find: in the input, among its addresses and on the pages read. No model is asked."""
    return input_evidence(inputs).unionByName(link_evidence(links, known)).unionByName(read_evidence(inputs, pages, known))


_SEEN = "struct<source:string,value:string,confidence:double>"
STORED = f"struct<content_type:string,is_useful:boolean,priority:string,confidence:double,main_decision:string,decisions:array<struct<type:string,confidence:double,data:map<string,string>,evidence:array<{_SEEN}>>>,variants:array<map<string,string>>,sql_plan:array<struct<purpose:string,query:string>>,warnings:array<string>,raw:map<string,string>>"
#: Without these a stored result is none.
REQUIRED = ("content_type", "is_useful", "priority", "confidence", "main_decision")


def result_json(result: Column) -> Column:
    """An analysis result as JSON text."""
    return F.to_json(result.cast(STORED))


def result_of(json: Column) -> Column:
    """The result in a JSON text, null where a required field is missing or of another type; missing lists are empty."""
    return let(F.from_json(json, STORED), _whole)


def _whole(parsed: Column) -> Column:
    whole = F.lit(True)
    for name in REQUIRED:
        whole &= parsed[name].isNotNull()
    empty = {n: F.coalesce(parsed[n], F.from_json(F.lit("[]"), k)) for n, k in (("variants", "array<map<string,string>>"), ("warnings", "array<string>"))}
    kept = [empty.get(n, parsed[n]).alias(n) for n in ("content_type", "is_useful", "priority", "confidence", "main_decision", "decisions", "variants", "sql_plan", "warnings", "raw")]
    return F.when(whole, F.struct(*kept))


def consistency() -> Column:
    """Warnings of an occurrence whose parts contradict each other."""
    return F.array_compact(F.array(F.when((F.col("confidence") > 0.9) & ~F.col("verified"), "sure_but_unverified"), F.when(F.col("verified") & t.blank_to_null(F.col("source_url")).isNull(), "verified_without_source")))


def review_rows(occurrences: DataFrame, links: DataFrame) -> DataFrame:
    """run_id, title, n_links, confidence and missing of runs: .70, or .55 where a date or city is missing."""
    counts = links.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_links"))
    missing = F.array_compact(F.array(F.when(F.col("event_date").isNull(), "date"), F.when(t.blank_to_null(F.col("city_name")).isNull(), "city")))
    return occurrences.join(counts, "run_id").select("run_id", F.col("artist").alias("title"), "n_links", F.when(F.size(missing) > 0, 0.55).otherwise(0.7).alias("confidence"), F.array_join(missing, ",").alias("missing"))
