"""Completeness, problems and activity over drafts, events and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HAS = {"title": "title", "artist": "artists", "date": "start_date", "city": "city", "venue": "venue", "address": "address", "time": "times", "link": "links", "promo": "promo_codes", "age": "age_limit", "description": "description"}


def _has(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def completeness(drafts: DataFrame, *keys: str) -> DataFrame:
    """How many drafts there are, and how many have each field."""
    counts = [F.count_if(_has(c)).alias(f"with_{n}") for n, c in HAS.items()]
    return drafts.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts)


def problems(drafts: DataFrame) -> DataFrame:
    """post_id, source, tag: a row for each problem of a draft."""
    event = F.col("kind").isin("event", "tour_announcement", "unknown")
    tags = F.array_compact(
        F.array(
            F.when(~_has("title"), "no_title"), F.when(event & ~_has("start_date"), "no_date"), F.when(event & ~_has("city"), "no_city"), F.when(event & ~_has("venue"), "no_venue"),
            F.when(event & (F.col("n_tickets") == 0), "no_ticket_link"), F.when(F.col("warnings") != "", "has_warnings"), F.when((F.col("status") == "cancelled") & _has("links"), "cancelled_with_links"),
        )
    )
    return drafts.select("post_id", "source", F.explode(tags).alias("tag"))


def counted(rows: DataFrame, key: str) -> DataFrame:
    """Most common first."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def warning_counts(drafts: DataFrame) -> DataFrame:
    return counted(drafts.select(F.explode(F.split("warnings", ",")).alias("warning")).filter("warning <> ''"), "warning")


def source_stats(drafts: DataFrame, problem_rows: DataFrame) -> DataFrame:
    """source, total, with_problems and their ratio to four places."""
    bad = problem_rows.select("post_id").distinct().withColumn("bad", F.lit(1))
    joined = drafts.select("post_id", "source").join(bad, "post_id", "left")
    stats = joined.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("bad").alias("with_problems"))
    return stats.withColumn("ratio", F.round(F.col("with_problems") / F.col("total"), 4))


def worst_sources(stats: DataFrame, n: int = 100) -> DataFrame:
    return stats.orderBy(F.desc("with_problems"), F.desc("ratio"), "source").limit(n)


def examples(problem_rows: DataFrame, n: int = 20) -> DataFrame:
    """At most n posts for each tag, in order of source and post."""
    order = Window.partitionBy("tag").orderBy("source", "post_id")
    return problem_rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= n)


def last_messages(messages: DataFrame, n: int = 40) -> DataFrame:
    """The last n turns of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= n)


def text_deltas(versions: DataFrame, block: int = 1024) -> DataFrame:
    """key, seq, delta: what each full text (key, seq, text) adds to the one before it, or the whole text if it is no continuation.

    A key's versions are cut into blocks of so many sequence numbers (longs, each once), so that
    a key with a large share of all versions is many groups; what goes from block to block is the last text of each. A null text is empty.
    """
    held = versions.select("key", "seq", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("seq") / block).alias("block"))
    last = held.groupBy("key", "block").agg(F.max_by("text", "seq").alias("end"))
    carried = last.select("key", "block", F.lag("end").over(Window.partitionBy("key").orderBy("block")).alias("carried"))
    before = F.lag("text").over(Window.partitionBy("key", "block").orderBy("seq"))
    first = held.withColumn("before", before).join(carried, ["key", "block"]).withColumn("before", F.coalesce("before", "carried"))
    grown = F.col("before").isNotNull() & F.startswith("text", F.col("before"))
    return first.select("key", "seq", F.when(grown, F.substring("text", F.length("before") + 1, F.length("text"))).otherwise(F.col("text")).alias("delta"))


def repeated_calls(calls: DataFrame) -> DataFrame:
    """Calls (run, tool, args, step) whose tool and arguments were seen at an earlier step of the run."""
    order = Window.partitionBy("run", "tool", "args").orderBy("step")
    return calls.withColumn("nth", F.row_number().over(order)).filter("nth > 1")


def event_rollup(events: DataFrame, width: str = "1 minute") -> DataFrame:
    """Counts and durations by window and name; on a stream, give the events a watermark first."""
    return events.groupBy(F.window("ts", width), "name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")).select(F.col("window.start").alias("start"), "name", "n", "total", "most")


def sessions(events: DataFrame, gap_seconds: float, *, key: str = "key", ts: str = "ts") -> DataFrame:
    """Events with session: runs of one key in which no pause is longer than the gap."""
    order = Window.partitionBy(key).orderBy(ts, "id")
    at = F.col(ts).cast("timestamp")
    new = F.coalesce((at.cast("double") - F.lag(at).over(order).cast("double") > gap_seconds).cast("int"), F.lit(1))
    return events.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def bursts(messages: DataFrame, gap_seconds: float = 0.8) -> DataFrame:
    """One answer for each burst of messages (key, id, ts, text): repeats of an id once, by id, joined by an empty line."""
    once = messages.groupBy("key", "id").agg(F.min("ts").alias("ts"), F.min_by("text", "ts").alias("text"))
    held = sessions(once, gap_seconds)
    parts = F.array_sort(F.collect_list(F.struct("id", "text")))
    return held.groupBy("key", "session").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(parts, lambda s: s["text"]), "\n\n").alias("text"))


def released(messages: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Messages of threads whose cut-off id is known, after that id."""
    return messages.join(cutoffs, "key").filter("id > after_id").drop("after_id")


def unexpired(entries: DataFrame, now: Column) -> DataFrame:
    return entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str, deleted: str = "deleted", place: tuple[str, ...] = ()) -> DataFrame:
    """The table after changes: the newest change of each key replaces its row, and a deletion removes it; of changes of one version the first by place counts."""
    newest = changes.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), *place))).filter("n = 1").drop("n")
    return current.join(newest.select(key), key, "left_anti").unionByName(newest.filter(~F.col(deleted)).select(*current.columns))


def listing(table: DataFrame, key: str, *, filters: tuple[Column, ...] = (), limit: int = 100, offset: int = 0) -> DataFrame:
    for condition in filters:
        table = table.filter(condition)
    return table.orderBy(key).offset(offset).limit(limit)


def content_key(*parts: Column) -> Column:
    """A hash of named parts, the same whatever their order."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def work_list(content: DataFrame, results: DataFrame, key: str = "content_key") -> DataFrame:
    """The content without a stored result."""
    return content.join(results.select(key).distinct(), key, "left_anti")


def context_rows(messages: DataFrame, entities: DataFrame, *, most: int = 20, least_letters: int = 6, few_items: int = 64, few_messages: int = 10_000, salts: int = 32) -> DataFrame:
    """message, item_id, hits: for each message (message, text) the `most` entities (item_id, text) that share most words with it; ties go to the smaller item_id.

    Words are divided by blanks, compared in lower case, and have least_letters or more. Two kinds of words:

    * A word of at most few_items entities has one row with its entities. Messages meet that
      row, and a word of more than few_messages messages has it `salts` times, each for a share of them.
    * A word of more entities is frequent. Entities are ranked once for each set of frequent words
      that some message has, not for each message, and only the first `most` can matter: what
      else shares no rarer word with the message is behind all of them.

    A candidate by a rarer word gets its frequent words counted from the entity's own row.
    """
    split = lambda df, key: df.select(key, F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w")).filter(F.length("w") >= least_letters)
    said, known = split(messages, "message"), split(entities, "item_id").distinct()
    listed = known.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    frequent = listed.filter(F.col("n") > few_items).select("w")
    rare = known.join(listed.filter(F.col("n") <= few_items).select("w"), "w").groupBy("w").agg(F.collect_list("item_id").alias("items"))
    crowded = said.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few_messages).select("w", F.lit(salts).alias("salts"))
    spread = rare.join(crowded, "w", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    dealt = said.join(crowded, "w", "left").withColumn("salt", F.pmod(F.xxhash64("message"), F.coalesce("salts", F.lit(1))).cast("int"))
    by_rare = dealt.join(spread, ["w", "salt"]).select("message", F.explode("items").alias("item_id")).groupBy("message", "item_id").agg(F.count(F.lit(1)).alias("rare"))

    words = F.array_sort(F.collect_list("w")).alias("words")
    own, of_items = said.join(frequent, "w", "left_semi").groupBy("message").agg(words), known.join(frequent, "w", "left_semi").groupBy("item_id").agg(words.alias("item_words"))
    none = F.array().cast("array<string>")
    shared = F.size(F.array_intersect(F.coalesce("words", F.lit(none)), F.coalesce("item_words", F.lit(none))))
    rated = by_rare.join(own, "message", "left").join(of_items, "item_id", "left").select("message", "item_id", (F.col("rare") + shared).alias("hits"))
    sets = own.select("words").distinct()
    ranked = sets.select("words", F.explode("words").alias("w")).join(known.join(frequent, "w", "left_semi"), "w").groupBy("words", "item_id").agg(F.count(F.lit(1)).alias("hits"))
    first = lambda df, *keys: df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("hits"), "item_id"))).filter(F.col("n") <= most).drop("n")
    best = first(ranked, "words").groupBy("words").agg(F.collect_list(F.struct("item_id", "hits")).alias("best"))
    by_frequent = own.join(best, "words").select("message", F.explode("best").alias("b")).select("message", "b.item_id", "b.hits")
    return first(rated.unionByName(by_frequent).groupBy("message", "item_id").agg(F.max("hits").alias("hits")), "message")
