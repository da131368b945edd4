"""Operators on small tables: posts, OCR, verification, reports, sources and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from handbill.operators import ocr, posts, reports, verify
from handbill.sources import chat, sinks
from handbill.streaming import jobs

POST = "Ария\n\nДата: 12.06.2024\nМесто: Клуб Волга\nдвери 19:00 / начало 20:00\n18+\nЦена: 1500 руб\nБилеты: https://tickets.example/1/\nпромокод: ROCK10"
TOUR = "Сплин\n12 июня - Питер\n13 июня - Минск\nчат тура @splin_chat"


def post_table(spark, *texts):
    return spark.createDataFrame([(k, 7, "s", dt.date(2024, 5, 15), v) for k, v in enumerate(texts)], "post_id long, channel_id long, source string, published date, text string")


def test_draft_of_a_post(spark):
    profiles = spark.createDataFrame([(7, "Казань", "Зал")], "channel_id long, profile_city string, profile_venue string")
    a, b, c = posts.drafts(post_table(spark, POST, TOUR, None), profiles).orderBy("post_id").collect()
    assert (a.title, str(a.start_date), a.venue, a.times, a.age_limit, a.promo_codes, a.n_tickets, a.city) == ("Ария", "2024-06-12", "Клуб Волга", "doors@19:00,start@20:00", 18, "ROCK10", 1, "Казань")
    assert (b.n_occurrences, b.n_dated, b.links, b.title) == (2, 2, "https://t.me/splin_chat", "Сплин")
    assert c.title is None and c.kind == "unknown" and c.n_occurrences == 0


def test_schedule_and_links(spark):
    lines = posts.lines(post_table(spark, TOUR))
    assert [(str(r.event_date), r.city) for r in posts.schedule(lines).orderBy("pos").collect()] == [("2024-06-12", "Санкт-Петербург"), ("2024-06-13", "Минск")]
    assert [r.link_type for r in posts.links(lines).collect()] == ["chat"]
    assert {r.strategy for r in posts.occurrences(lines).collect()} == {"schedule"}


def block_table(spark, rows):
    return spark.createDataFrame([(1, k, "alpha", text, conf, x, y, 100, 20, kind, 0) for k, (text, conf, x, y, kind) in enumerate(rows)], "image_id long, ordinal int, backend string, text string, confidence double, x int, y int, w int, h int, block_type string, n_lines int")


def test_fusion_follows_long_chains(spark):
    chain = block_table(spark, [(f"word {k}", 0.5 + k / 100, 30 * k, 0, "text") for k in range(12)])
    grouped = ocr.overlap_groups(chain, ocr.overlaps(chain))
    assert {r.group_id for r in grouped.collect()} == {0}
    (fused,) = ocr.fuse(grouped).collect()
    assert fused.text == "word 11" and fused.n_blocks == 12 and fused.source == "fusion:alpha"


def test_no_overlap_between_groups(spark):
    rows = block_table(spark, [("one", 0.9, 0, 0, "title"), ("two", 0.8, 5, 2, "text"), ("far", 0.7, 500, 500, "text"), (".", 0.9, 0, 0, "text"), ("low", 0.1, 0, 0, "text")])
    fused, texts = ocr.pipeline(rows)
    assert [r.text for r in fused.orderBy("reading_order").collect()] == ["one", "far"]
    assert texts.first().raw_text == "one\nfar"


def test_names_and_tokens(spark):
    entities = spark.createDataFrame([(1, "artist", "Кино", ["Kino band"]), (2, "city", "Москва", [])], "entity_id long, entity_type string, name string, aliases array<string>")
    texts = spark.createDataFrame([("a", "Mосквa"), ("b", "kino  BAND"), ("c", "зебра"), ("d", "18+"), ("e", "12.05")], "text_id string, text string")
    assert {r.text_id: r.name for r in ocr.fuzzy_names(texts, entities).collect()} == {"a": "Москва", "b": "Кино"}
    assert {r.text_id: r["class"] for r in ocr.classified(texts, entities).collect()} == {"a": "similar_name", "b": "name", "c": "unknown", "d": "age", "e": "date"}
    tokens = spark.createDataFrame([("Moсква",), ("live",)], "token string")
    assert {r.token: r.repaired for r in ocr.repaired(tokens, 7).collect()}["live"] == "live"
    assert ocr.token_variants(spark.createDataFrame([("кот",)], "token string")).count() == 8


def test_verification_decides(spark):
    day = dt.date(2024, 6, 12)
    o = spark.createDataFrame([(1, 0, "Ария", "Минск", "Клуб", day, "20:00", False, 0.4, ""), (2, 0, "Кино", "Минск", "Бар", day, None, True, 0.9, "")], "run_id long, pos int, artist string, city_name string, venue_name string, event_date date, start_time string, verified boolean, confidence double, source_url string")
    k = spark.createDataFrame([(1, 0, "https://WWW.tickets.by/x", "ticket", False, 0.5), (2, 0, "https://t.me/kino", "official", True, 0.9)], "run_id long, pos int, url string, kind string, verified boolean, confidence double")
    f = spark.createDataFrame([(1, 0, "дата", "2024-06-12", "unverified", "search", 0.3, ""), (2, 0, "artist", "Кино", "verified", "search", 0.8, "")], "run_id long, pos int, field string, value string, status string, source_type string, confidence double, source_url string")
    p = spark.createDataFrame([(1, 0, "https://tickets.by/x/", True, False, 200, "Ария", "12 июня, Минск, Клуб, 20:00"), (2, 0, "https://x.y", True, True, 200, "Кино", "")], "run_id long, pos int, url string, ok boolean, blocked boolean, status_code int, title string, text string")
    one, two = verify.verify(o, k, f, p).orderBy("run_id").collect()
    assert (one.decision, one.v_occurrences, one.v_ticket) == ("auto_publish", 1, 1) and one.overall >= 0.9
    assert two.decision == "needs_review" and "unverified_occurrence" in two.reasons


def test_reports(spark):
    rows = spark.createDataFrame([("a", 1, "x", 0.0), ("a", 2, "y", 0.5), ("a", 2, "y", 0.6), ("a", 3, "z", 5.0)], "key string, id long, text string, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.text for r in reports.bursts(rows).collect()) == ["x\n\ny", "z"]
    versions = spark.createDataFrame([("k", 1, "ab"), ("k", 2, "abc"), ("k", 3, "x")], "key string, seq int, text string")
    assert [r.delta for r in reports.text_deltas(versions).orderBy("seq").collect()] == ["ab", "c", "x"]
    current = spark.createDataFrame([(1, "old"), (2, "keep"), (3, "gone")], "k long, v string")
    changes = spark.createDataFrame([(1, "new", 1, False), (1, "newest", 2, False), (3, None, 1, True), (4, "added", 1, False)], "k long, v string, version int, deleted boolean")
    assert sorted(map(tuple, reports.upsert(current, changes, "k", "version").collect())) == [(1, "newest"), (2, "keep"), (4, "added")]


def test_chat_exports(spark, tmp_path):
    good = {"id": 5, "messages": [{"id": 1, "type": "message", "date": "2024-05-01T10:00:00", "text": ["Hi ", {"type": "bold", "text": "all"}, {"type": "text_link", "text": "go", "href": "https://a.b"}], "photo": "p.jpg", "width": 10, "height": "20"}, {"id": 2, "type": "service", "text": "x"}, {"id": 3, "type": "message", "text": ""}, {"id": 4, "type": "message", "date": "bad", "text": "plain", "photo": "q", "width": 0, "height": 5}]}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "chat.json").write_text(json.dumps(good))
    (tmp_path / "in" / "bad.json").write_text("{broken")
    (tmp_path / "in" / "none.json").write_text('{"id": 6}')
    exports = chat.read_exports(spark, str(tmp_path / "in")).cache()
    kept, bad = chat.good_and_bad(exports)
    assert {r.reason for r in bad.collect()} == {"unreadable", "no_messages"}
    rows = chat.messages(kept)
    first, last = chat.posts(rows).orderBy("post_id").collect()
    assert (first.post_id, first.text, str(first.published), first.source) == (1, "Hi allgo https://a.b", "2024-05-01", "chat")
    assert first.html_text == 'Hi <b>all</b><a href="https://a.b">go</a>' and first.buttons[0].url == "https://a.b"
    assert (last.text, last.published) == ("plain", None)
    assert [(r.post_id, r.width) for r in chat.images(rows).collect()] == [(1, 10)]
    sinks.write_json(chat.posts(rows), str(tmp_path / "out"), "source")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    sinks.write_csv(str(tmp_path / "csv"), chat.posts(rows), rows.select(F.col("id").alias("post_id"), "photo"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns[-1] == "photo"


def test_tool_pages(spark):
    rows = spark.createDataFrame([(1, 1, "url_read", '{"pages": [{"url": "u", "ok": true, "status_code": 200}, {"ok": false}]}'), (1, 2, "other", "{}"), (2, 1, "url_read", "broken")], "run_id long, step int, tool string, data string")
    assert [(r.run_id, r.url, r.status_code) for r in sinks.tool_pages(rows).collect()] == [(1, "u", 200)]


def run_stream(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path):
    table = post_table(spark, POST, TOUR, "спасибо")
    table.write.parquet(str(tmp_path / "posts"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "posts"))
    found = run_stream(jobs.classified_posts(stream), "kinds")
    assert sorted(map(str, found.collect())) == sorted(map(str, jobs.classified_posts(table).collect()))

    rows = spark.createDataFrame([("a", 1, "x", 0.0), ("a", 2, "y", 0.5), ("a", 2, "y", 0.6), ("a", 3, "z", 5.0), ("b", 9, "end", 500.0)], "key string, id long, text string, s double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000)).drop("s")
    rows.write.parquet(str(tmp_path / "messages"))
    messages = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "messages"))
    assert {"x\n\ny", "z"} <= {r.text for r in run_stream(jobs.burst_answers(messages), "bursts").collect()}
    assert run_stream(jobs.once_each(messages), "once").count() == 4
    cutoffs = spark.createDataFrame([("a", 1)], "key string, after_id long")
    assert sorted(r.id for r in run_stream(jobs.released(messages, cutoffs), "released").collect()) == [2, 2, 3]
    events = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "messages")).withColumns({"name": F.col("key"), "value": F.lit(1.0)})
    assert run_stream(jobs.minute_rollup(events), "minutes", "complete").agg(F.sum("n")).first()[0] == 5


def test_links_by_domain_need_the_facts_on_their_page(spark):
    day = dt.date(2025, 5, 3)
    o = spark.createDataFrame([(r, 0, "Band X", "Минск", "Club Y", day) for r in range(5)], "run_id long, pos int, artist string, city_name string, venue_name string, event_date date")
    texts = ["nothing of it", "Band X at Club Y", "Band X, Минск, Club Y", "Band X, Минск", "Band X, 2025-05-03, Минск, Club Y"]
    hosts = ["a.example", "a.example", "a.example", "tickets.example", "a.example"]
    p = spark.createDataFrame([(r, 0, f"https://{h}/other", True, False, 200, "", t) for r, (h, t) in enumerate(zip(hosts, texts, strict=True))], "run_id long, pos int, url string, ok boolean, blocked boolean, status_code int, title string, text string")
    kinds = ["ticket", "official", "official", "ticket", "social"]
    k = spark.createDataFrame([(r, 0, f"https://{h}/link", kind, False, 0.1) for r, (h, kind) in enumerate(zip(hosts, kinds, strict=True))], "run_id long, pos int, url string, kind string, verified boolean, confidence double")
    found = {r.run_id: (r.verified, r.confidence) for r in verify.confirm_links(k, p, o).collect()}
    assert found == {0: (False, 0.1), 1: (False, 0.1), 2: (True, 0.8), 3: (True, 0.8), 4: (False, 0.1)}


def test_upsert_takes_the_first_of_one_version(spark):
    current = spark.createDataFrame([(1, "old")], "k int, v string")
    changes = spark.createDataFrame([(1, "third", 7, 3, False), (1, "first", 7, 1, False), (1, "second", 7, 2, True), (1, "older", 6, 0, True)], "k int, v string, version int, row int, deleted boolean")
    for some in (changes, changes.orderBy("row"), changes.orderBy(F.desc("row"))):
        assert list(map(tuple, reports.upsert(current, some, "k", "version", place=("row",)).collect())) == [(1, "first")]



def test_tied_blocks_have_one_winner(spark):
    rows = [(1, 5, "alpha", text, 0.5, 0, 0, w, 10, "text", 1, 5) for text, w in (("Supplier#1", 20), ("Supplier#2", 30), ("Supplier#2", 40))]
    ddl = "image_id long, ordinal int, backend string, text string, confidence double, x int, y int, w int, h int, block_type string, n_lines int, group_id int"
    for some in (rows, rows[::-1], rows[1:] + rows[:1]):
        assert [(r["text"], r["w"]) for r in ocr.fuse(spark.createDataFrame(some, ddl).coalesce(1)).collect()] == [("Supplier#2", 40)]


def test_lines_are_cleaned_once_whatever_is_asked_of_them(spark):
    plan = posts.titles(posts.lines(post_table(spark, POST, TOUR)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("„") == 1


def test_stored_results_are_read_once(spark):
    json_column = verify.result_of(F.col("json"))
    read = posts.once(spark.createDataFrame([(1, "{}")], "run_id long, json string"), json_column.alias("r")).filter("r is not null")
    assert read.count() == 0 and read.select("r.is_useful", "r.decisions")._jdf.queryExecution().optimizedPlan().toString().count("from_json(StructField(content_type") == 1


def test_reports_clean_a_text_once_and_compute_what_they_read(spark):
    table = post_table(spark, POST, TOUR, "спасибо", "", None, "Show12.05\r\r\r\rв\x0bбаре «Дом» ")
    read = ("source", *reports.HAS.values())
    wanted = posts.drafts(table, None, read)
    plan = wanted._jdf.queryExecution().optimizedPlan().toString()
    assert "([A-Za-z])(" not in plan and "low_signal" not in plan and "schedule" not in plan
    assert sorted(map(str, wanted.collect())) == sorted(map(str, posts.drafts(table).select(*read).collect()))


def test_organizers_have_a_part_of_a_word_in_their_title(spark):
    titles = ["★ Concertsville", "Промогруппа Юг", "promo77", "Концертный зал", "Fans", "", None]
    found = posts.organizers(spark.createDataFrame(list(enumerate(titles)), "channel_id int, title string"))
    assert sorted(map(tuple, found.collect())) == [(0, "Concertsville"), (1, "Промогруппа Юг"), (2, "promo77"), (3, "Концертный зал")]
