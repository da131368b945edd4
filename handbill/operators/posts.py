"""Posts to line tables, narrow field tables, and drafts. Tables are keyed by post_id; pos carries order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, fields
from ..functions import text as t
from ..plans.shared import checkpointed, spread


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """df with these columns, each computed once a row: no filter on them moves below the generator, where it would compute them again."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def lines(posts: DataFrame) -> DataFrame:
    """A row for each non-empty line: post_id, pos, line, the same in lower case (low) and the line's flags.

    Flags are computed once here; every other operator reads this table.
    """
    return _lines(posts.select("post_id", "published", t.normal_text(F.col("text")).alias("text")))


def _lines(clean: DataFrame) -> DataFrame:
    """lines() of posts whose texts are normal ones."""
    split = clean.select("post_id", "published", F.posexplode(F.split(t.plain_lines(F.col("text")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    flags = fields.line_flags(F.col("line"), low=F.col("low"))
    return once(split, F.lower("line").alias("low")).select(*split.columns, "low", *(c.alias(n) for n, c in flags.items()))


def kept_lines(posts: DataFrame, *columns: str) -> DataFrame:
    """lines(), or these columns of it, computed once and kept in the shared folder for operators that read them more than once."""
    return checkpointed(lines(spread(posts.select("post_id", "published", "text"), "post_id")).select(*(columns or ("*",))))


def first_by_pos(rows: DataFrame, value: Column, alias: str) -> DataFrame:
    """The value of the first row of each post."""
    return rows.groupBy("post_id").agg(F.min_by(value, F.col("pos")).alias(alias))


def titles(line_table: DataFrame) -> DataFrame:
    """The first line that is no field, cleaned; of a line with bars, its first part."""
    usable = line_table.filter("not (is_labelled or is_date or is_time or is_ticket or is_service or is_short)")
    first = first_by_pos(usable, F.col("line"), "line")
    return first.select("post_id", F.trim(F.element_at(F.split(t.clean_line(F.col("line")), r"\|"), 1)).alias("title"))


_APART = r"\s*(?:,|;|/|\||\s&\s|\s[xх]\s|\sи\s)\s*"


def artists(line_table: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """post_id, at, artist: names from the lines below the first, up to the first line that is a field.

    Only the first six lines count, and not those that repeat the title; names are split at
    separators and given once each. Without any, the part of the title before its separators
    is the artist. named is titles() of the same lines, if it is at hand.
    """
    named = titles(line_table) if named is None else named
    top = line_table.filter("pos between 1 and 5")
    stops = F.col("is_labelled") | F.col("is_date") | F.col("is_time") | F.col("is_age") | F.col("is_ticket") | F.col("is_promo") | F.col("is_service")
    ended = F.max(stops.cast("int")).over(Window.partitionBy("post_id").orderBy("pos"))
    block = top.withColumn("ended", ended).filter("ended = 0").select("post_id", "pos", "line")
    titled = once(named, t.entity_key(F.col("title")).alias("title_key")).select("post_id", "title_key")
    parts = block.select("post_id", "pos", F.posexplode(F.split(t.clean_line(F.col("line")), _APART)).alias("part", "artist"))
    good = _names(parts).join(titled, "post_id", "left").filter("title_key is null or key <> title_key").drop("title_key")
    from_title = _names(named.select("post_id", F.lit(-1).alias("pos"), F.lit(0).alias("part"), F.element_at(F.split("title", _APART), 1).alias("artist")))
    last = F.max("pos").over(Window.partitionBy("post_id"))
    every = good.unionByName(from_title).withColumn("last", last).filter("pos >= 0 or last < 0")  # the title only where no line has a name
    first = F.row_number().over(Window.partitionBy("post_id", "key").orderBy("pos", "part"))
    kept = every.withColumn("n", first).filter("n = 1")
    return kept.select("post_id", F.row_number().over(Window.partitionBy("post_id").orderBy("pos", "part")).alias("at"), "artist")


def _names(parts: DataFrame) -> DataFrame:
    """The rows whose artist can be a name, with its key."""
    keyed = once(parts, t.entity_key(F.col("artist")).alias("key"))
    return keyed.filter((F.col("key") != "") & F.length("artist").between(2, 60) & ~F.col("key").rlike(fields.words(("live", "концерт*", "афиша", "розыгрыш*"))))


def organizers(channels: DataFrame, parts: tuple[str, ...] = ("concert", "promo", "agency", "концерт", "промо", "агентств")) -> DataFrame:
    """channel_id, organizer: the cleaned title (channel_id, title) of channels whose title has one of the parts anywhere."""
    named = channels.select("channel_id", t.clean_line(F.col("title")).alias("organizer"))
    return named.filter(F.lower("organizer").rlike("|".join(parts)))


def labelled_artists(line_table: DataFrame, labels: tuple[str, ...] = ("артист", "артисты", "artist", "artists")) -> DataFrame:
    """post_id, at, artist: the names in `label: name, name; name` lines, each once whatever its case, in order."""
    said = F.regexp_extract("line", rf"(?iu)^\s*(?:{'|'.join(labels)})\s*:\s*(.+)$", 1)
    names = line_table.select("post_id", "pos", F.posexplode(F.split(said, "[,;]")).alias("part", "artist")).withColumn("artist", F.trim("artist")).filter("artist <> ''")
    first = names.groupBy("post_id", F.lower("artist").alias("key")).agg(F.min(F.struct("pos", "part", "artist")).alias("m"))
    return first.select("post_id", F.row_number().over(Window.partitionBy("post_id").orderBy("m.pos", "m.part")).alias("at"), "m.artist")


def link_cities(link_table: DataFrame) -> DataFrame:
    """post_id, at, city: cities that ticket links are labelled with, each once by its key, in order of the links."""
    named = link_table.filter("link_type = 'ticket'").select("post_id", "at", safe_city(F.col("label")).alias("city")).filter("city is not null")
    return named.groupBy("post_id", t.entity_key(F.col("city")).alias("key")).agg(F.min(F.struct("at", "city")).alias("m")).select("post_id", "m.*")


def first_titles(line_table: DataFrame, *, longest: int | None = None, no_urls: bool = False) -> DataFrame:
    """post_id, title: the first line as it stands; none that begins an object, is longer than allowed, or (no_urls) is an address or a list item."""
    good = ~F.col("line").rlike(r"^\{")
    if longest is not None:
        good &= F.length("line") <= longest
    if no_urls:
        good &= ~F.col("line").rlike(r"^(?:-|(?i:https?:|www\.))")
    return first_by_pos(line_table.filter(good), F.col("line"), "title")


def labelled_titles(line_table: DataFrame, labels: tuple[str, ...] = ("название", "событие", "title", "event")) -> DataFrame:
    """post_id, title: the first labelled title, else titles()."""
    said = F.regexp_extract("line", rf"(?iu)^\s*(?:{'|'.join(labels)})\s*:\s*(.+)$", 1)
    named = first_by_pos(line_table.withColumn("said", said).filter("said <> ''"), F.trim("said"), "said")
    return titles(line_table).join(named, "post_id", "full").select("post_id", F.coalesce("said", "title").alias("title"))


def missing_fields(**values: Column) -> Column:
    """The names of the fields without a value, in the order given."""
    return F.array_compact(F.array(*(F.when(F.coalesce(F.trim(v.cast("string")), F.lit("")) == "", name) for name, v in values.items())))


def links(line_table: DataFrame, buttons: DataFrame | None = None) -> DataFrame:
    """post_id, at, url, label, link_type: addresses of lines, then of buttons; the first place of an address counts.

    Chat handles count on lines that speak of a chat.
    """
    slashed = F.contains("line", F.lit("/")) | (F.contains("line", F.lit(".")) & F.contains(F.lower("line"), F.lit("www.")))  # no address is without
    found = line_table.filter(slashed).select("post_id", F.lit(0).alias("src"), "pos", F.posexplode(fields.urls(F.col("line"))).alias("part", "url"), "line")
    of_lines = found.select("post_id", "src", "pos", "part", "url", t.blank_to_null(F.regexp_replace(t.without_urls(F.col("line")), r"[\s:\-–—]+$", "")).alias("label"))
    handle = F.regexp_extract("line", r"(?<![\w@])@([A-Za-z][A-Za-z0-9_]{4,31})", 1)
    chats = line_table.filter(F.contains("line", F.lit("@"))).filter(F.lower("line").rlike("чат|беседа|обсуждение|chat")).select("post_id", F.lit(0).alias("src"), "pos", F.lit(99).alias("part"), handle.alias("handle"), "line").filter("handle <> ''")
    every = of_lines.unionByName(chats.select("post_id", "src", "pos", "part", F.concat(F.lit("https://t.me/"), "handle").alias("url"), F.col("line").alias("label")))
    if buttons is not None:
        every = every.unionByName(buttons.select("post_id", F.lit(1).alias("src"), "pos", F.lit(0).alias("part"), F.element_at(fields.urls(F.col("url")), 1).alias("url"), F.col("text").alias("label")).filter("url is not null"))
    order = Window.partitionBy("post_id", "url").orderBy("src", "pos", "part")
    kept = every.withColumn("n", F.row_number().over(order)).filter("n = 1")
    at = F.row_number().over(Window.partitionBy("post_id").orderBy("src", "pos", "part"))
    return kept.select("post_id", at.alias("at"), "url", "label", fields.link_type(F.col("url"), F.col("label")).alias("link_type"))


_CITY = r"([\p{Lu}][\p{L}\- ]{1,40}?)"


def safe_city(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """The canonical city if the text can be one: capitalised letters only, no field word; else null."""
    cleaned = t.clean_line(value)
    good = cleaned.rlike(r"^[\p{Lu}][\p{L}]+(?:[\- ][\p{L}]+){0,2}$") & ~F.lower(cleaned).rlike(fields.words(("вход*", "билет*", "концерт*", "начало", "двери", "клуб", "афиша", "live", "чат*", "розыгрыш*", "возврат*")))
    return F.when(good, t.city_name(value, aliases))


def venue_and_city(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """struct<venue,city> of "venue CITY": a last word in capitals, else a known city anywhere in it; else all is venue."""
    known = aliases or t.CITY_ALIASES
    cleaned = t.clean_line(value)
    last = F.regexp_extract(cleaned, r"\s(\p{Lu}[\p{Lu}\-]+)$", 1)
    within = rf"(?iu){dates.LEFT}({'|'.join(sorted(known, key=len, reverse=True))}){dates.RIGHT}"
    named = F.regexp_extract(cleaned, within, 1)
    pair = lambda venue, city: F.struct(t.blank_to_null(t.clean_line(venue)).alias("venue"), city.alias("city"))
    by_last = pair(F.regexp_replace(cleaned, r"\s\p{Lu}[\p{Lu}\-]+$", ""), safe_city(last, aliases))
    return F.when(last != "", by_last).when(named != "", pair(F.regexp_replace(cleaned, within, " "), t.city_name(named, aliases))).otherwise(pair(cleaned, F.lit(None).cast("string")))


def legacy_occurrences(texts: DataFrame) -> DataFrame:
    """post_id, pos, date, city, raw: lines of free text in which a city follows a dotted date; never verified.

    The city is the first words in capitals behind the date, if they can be one.
    """
    rows = texts.select("post_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    rest = F.get(F.split("raw", dates.DOTTED, 2), 1)
    named = F.regexp_extract(rest, r"(\p{Lu}\p{L}+(?:[ -]\p{Lu}\p{L}+)*)", 1)
    found = rows.select("post_id", "pos", F.trim(F.regexp_extract("raw", dates.DOTTED, 0)).alias("date"), safe_city(named).alias("city"), F.trim("raw").alias("raw"))
    return found.filter("date <> '' and city is not null")


def legacy_issues(texts: DataFrame, marks: tuple[str, ...]) -> DataFrame:
    """post_id, pos, severity, message: lines of free text with one of the marks, which say what is wrong."""
    rows = texts.select("post_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return rows.filter(F.lower("raw").rlike("|".join(marks))).select("post_id", "pos", F.lit("warning").alias("severity"), F.trim("raw").alias("message"))


def _digit_first() -> Column:
    """Whether a line, which has no blanks at its ends, begins with a digit."""
    return F.left("line", F.lit(1)).between("0", "9")


def schedule(line_table: DataFrame) -> DataFrame:
    """post_id, pos, event_date, city: lines of `date - city` and `city: address`, once for each city and date."""
    rest = F.regexp_extract("line", rf"^\s*\d{{1,2}}(?:[./]\d{{1,2}}(?:[./]\d{{2,4}})?|\s+\p{{L}}+)\s*[-–—:]?\s*{_CITY}\s*$", 1)
    named = F.regexp_extract("line", rf"(?i)^\s*{_CITY}\s*[:\-–—]\s*(?:https?://|www\.|t\.me/)", 1)
    slashed = fields.has_any(F.col("low"), "/", "www.")
    both = once(line_table.select("post_id", "pos", "published", "line", "low"), F.when(_digit_first(), rest).alias("rest"), F.when(slashed, named).alias("named")).filter("rest <> '' or named <> ''")
    low = F.col("low")
    date = F.coalesce(dates.dotted_date(low, F.col("published")), dates.worded_date(low, F.col("published")))
    said = F.array(
        F.struct(F.when(F.col("rest") != "", date["start"]).alias("event_date"), F.when(F.col("rest") != "", safe_city(F.col("rest"))).alias("city"), F.lit(True).alias("dated")),
        F.struct(F.lit(None).cast("date").alias("event_date"), F.when(F.col("named") != "", safe_city(F.col("named"))).alias("city"), F.lit(False).alias("dated")),
    )
    every = both.select("post_id", "pos", F.inline(said)).filter("city is not null and (event_date is not null or not dated)").drop("dated")
    first = F.row_number().over(Window.partitionBy("post_id", "city", "event_date").orderBy("pos"))
    return every.withColumn("n", first).filter("n = 1").drop("n")


def single_fields(line_table: DataFrame) -> DataFrame:
    """post_id and the first date, times, city, venue and address of its lines, with the line the date came from."""
    low, alias = F.col("low"), F.create_map(*(F.lit(x) for p in t.CITY_ALIASES.items() for x in p))
    found = dates.date_range(F.col("line"), F.col("published"))
    begins = dict.fromkeys(re.split(r"\W", a)[0] for a in t.CITY_ALIASES)
    city = F.coalesce(
        F.when(~F.col("is_labelled") & _digit_first(), safe_city(F.regexp_extract("line", rf"^\s*\d{{1,2}}(?:[./]\d{{1,2}}(?:[./]\d{{2,4}})?|\s+\p{{L}}+)\s*[-–—:]?\s*{_CITY}\s*$", 1))),
        F.when(fields.has_any(low, *begins) | ~t.is_stable(F.col("line")), F.element_at(alias, t.line_key(F.col("line"), low))),
        F.when(~F.col("is_date") & fields.has_any(low, *t.CITY_ALIASES), F.element_at(alias, F.regexp_extract(low, rf"{dates.LEFT}в\s+({'|'.join(t.CITY_ALIASES)}){dates.RIGHT}", 1))),
    )
    quoted = fields.has_any(F.col("line"), '"', "«") & fields.has_word(low, ("клуб*", "арен*", "бар*", "hall", "club"))
    venue = F.coalesce(F.when(F.col("is_labelled"), fields.labelled(F.col("line"), "venue")), F.when(~F.col("is_service") & quoted, F.nullif(F.regexp_extract("line", "[\"«]([^\"»]+)[\"»]", 1), F.lit(""))))
    street = fields.has_any(low, "ул.", "улица", "просп", "пр.", "наб", "street", "ave") & low.rlike(rf"{dates.LEFT}(?:ул\.|улица|просп\.|проспект|наб\.|набережная|street|ave){dates.RIGHT}|{dates.LEFT}(?:ул|пр)\.")
    address = F.when(street, F.col("line"))
    times = F.when(F.col("is_time"), F.transform(fields.timings(F.col("line")), lambda x: F.concat_ws("@", x["label"], F.concat_ws("-", x["time"], x["until"])))).otherwise(F.array().cast("array<string>"))
    per_line = line_table.select("post_id", "pos", "line", found.alias("found"), times.alias("times"), city.alias("city"), venue.alias("venue"), address.alias("address"))
    first = lambda name, c: F.min_by(c, F.when(c.isNotNull(), F.col("pos"))).alias(name)
    times = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.size("times") > 0, F.struct("pos", "times")))), lambda s: F.array_join(s["times"], ",")), ",").alias("times")
    dated = F.struct(F.col("found.start").alias("start"), F.col("found.end").alias("end"), F.col("found.source").alias("source"), F.col("line").alias("line"))
    held = per_line.groupBy("post_id").agg(F.min_by(dated, F.when(F.col("found").isNotNull(), F.col("pos"))).alias("d"), first("city", F.col("city")), first("venue", F.col("venue")), first("address", F.col("address")), times)
    return held.select("post_id", F.col("d.start").alias("start_date"), F.col("d.end").alias("end_date"), F.col("d.source").alias("date_rule"), F.col("d.line").alias("date_line"), "city", "venue", "address", "times")


def source_lines(line_table: DataFrame) -> DataFrame:
    """The line that announces a post's event: labelled date, else any date, else the second line."""
    rank = F.when(fields.labelled(F.col("line"), "date").isNotNull(), 1).when(F.col("is_date"), 2).when(F.col("pos") >= 1, 3)
    return line_table.groupBy("post_id").agg(F.min_by("line", F.struct(rank.isNull(), rank, F.col("pos"))).alias("source_line"))


def occurrences(line_table: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """post_id, event_date, city, strategy: two or more linked or dated cities, else the post's single fields.

    single is single_fields() of the same lines, if it is at hand.
    """
    plan = schedule(line_table).select("post_id", "event_date", "city", F.lit("schedule").alias("strategy"))
    one = (single_fields(line_table) if single is None else single).filter("start_date is not null or city is not null").select("post_id", F.col("start_date").alias("event_date"), "city", F.lit("single").alias("strategy"))
    many = F.count_if(F.col("strategy") == "schedule").over(Window.partitionBy("post_id")) >= 2
    return plan.unionByName(one).withColumn("many", many).filter("many = (strategy = 'schedule')").drop("many")


def descriptions(line_table: DataFrame, named: DataFrame | None = None, artist_table: DataFrame | None = None) -> DataFrame:
    """The lines of a post that are no field and no short or repeated known value, in order.

    named and artist_table are titles() and artists() of the same lines, if they are at hand.
    """
    named = titles(line_table) if named is None else named
    artist_table = artists(line_table, named) if artist_table is None else artist_table
    known = named.select("post_id", t.entity_key(F.col("title")).alias("key")).unionByName(artist_table.select("post_id", t.entity_key(F.col("artist")).alias("key")))
    rest = line_table.filter("not (is_labelled or is_date or is_time or is_age or is_ticket or is_promo or is_service or is_price or is_short)")
    keyed = rest.select("post_id", "pos", "line", t.line_key(F.col("line"), F.col("low")).alias("key"))
    held = keyed.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "key"))).alias("rows"))
    both = held.join(known.groupBy("post_id").agg(F.collect_set("key").alias("keys")), "post_id", "left")
    unknown = F.filter("rows", lambda s: ~F.coalesce(F.array_contains("keys", s["key"]), F.lit(False)))
    return once(both.select("post_id", "rows", "keys"), F.transform(unknown, lambda s: s["line"]).alias("kept")).filter(F.size("kept") > 0).select("post_id", F.array_join("kept", "\n").alias("description"))


def with_profile(drafts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Null city and venue filled from the channel's profile (channel_id, profile_city, profile_venue)."""
    joined = drafts.join(profiles, "channel_id", "left")
    return joined.withColumns({"city": F.coalesce("city", "profile_city"), "venue": F.coalesce("venue", "profile_venue")}).drop("profile_city", "profile_venue")


def warnings(kind: Column, n_occurrences: Column) -> Column:
    """What is wrong with a draft of this kind without an occurrence."""
    none = n_occurrences == 0
    return F.array_compact(F.array(F.when(none & kind.isin("event", "tour_announcement", "unknown"), "occurrence_not_found"), F.when(none & kind.isin("digest"), "digest_without_dates"), F.when(kind.isin("giveaway", "promo", "low_signal"), "not_an_event")))


def drafts(posts: DataFrame, profiles: DataFrame | None = None, wanted: tuple[str, ...] = ()) -> DataFrame:
    """One row for each post with every field, or the wanted ones alone; the shuffle key of all parts is post_id.

    What no wanted field needs is not computed. The lines, and the fields taken from them, are computed once and kept in the shared folder.
    """
    needs = lambda *names: not wanted or any(n in wanted for n in names)
    clean = checkpointed(spread(posts.select("post_id", "channel_id", "source", "published", "text"), "post_id").withColumn("text", t.normal_text(F.col("text"))))
    table = checkpointed(_lines(clean))
    occurring = needs("n_occurrences", "n_dated", "warnings")
    single = single_fields(table)
    single = checkpointed(single) if occurring else single
    listed = lambda df, of, name: df.groupBy("post_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", of))), lambda s: s[of]), ", ").alias(name))
    parts = []
    if needs("title", "artists", "description"):
        named = checkpointed(titles(table)) if needs("artists", "description") else titles(table)
        parts.append(named)
    if needs("artists", "description"):
        artist_table = checkpointed(artists(table, named)) if needs("description") else artists(table, named)
        parts.append(listed(artist_table, "artist", "artists"))
    if needs("links", "n_tickets"):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda s: s["url"])
        parts.append(links(table).groupBy("post_id").agg(F.array_join(ordered, ", ").alias("links"), F.count_if(F.col("link_type") == "ticket").alias("n_tickets")))
    text = F.col("text")
    said = clean.select("*", fields.message_kind(text).alias("said"))
    out = said.select("post_id", "channel_id", "source", "published", F.col("said.kind").alias("kind"), F.col("said.confidence").alias("kind_confidence"), fields.status(text).alias("status"), fields.age_limit(text).alias("age_limit"), F.array_join(fields.promo_codes(text), ",").alias("promo_codes"))
    if occurring or needs("start_date", "end_date", "date_rule", "date_line", "city", "venue", "address", "times"):
        parts.append(single)
    if occurring:
        parts.append(occurrences(table, single).groupBy("post_id").agg(F.count(F.lit(1)).alias("n_occurrences"), F.count("event_date").alias("n_dated")))
    if needs("description"):
        parts.append(descriptions(table, named, artist_table))
    for part in parts:
        out = out.join(part, "post_id", "left")
    out = out.fillna(0, [c for c in ("n_occurrences", "n_dated", "n_tickets") if c in out.columns])
    if profiles is not None and needs("city", "venue"):
        out = with_profile(out, profiles)
    if occurring:
        out = out.withColumn("warnings", F.array_join(warnings(F.col("kind"), F.col("n_occurrences")), ","))
    return out.select(*wanted) if wanted else out


def with_ocr(posts: DataFrame, images: DataFrame) -> DataFrame:
    """Posts with the first non-empty image text appended: by position, nulls last, then the larger area, then the text."""
    order = Window.partitionBy("post_id").orderBy(F.col("position").asc_nulls_last(), F.desc(F.col("width") * F.col("height")), "ocr_text")
    first = images.filter(F.trim("ocr_text") != "").withColumn("n", F.row_number().over(order)).filter("n = 1").select("post_id", "ocr_text")
    return posts.join(first, "post_id", "left").withColumn("text", F.concat_ws("\n\n", "text", "ocr_text")).drop("ocr_text")
