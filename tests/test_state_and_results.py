"""Kept state through restarts, streamed drafts, hot groups, nested results, and fields read out of texts."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from handbill import registry
from handbill.operators import inputs, posts, reports, results
from handbill.sources import sinks
from handbill.streaming import jobs

POST = "Ария\n\nДата: 12.06.2024\nМесто: Клуб Волга\nдвери 19:00 / начало 20:00\n18+\nЦена: 1500 руб\nБилеты: https://tickets.example/1/\nпромокод: ROCK10"
TOUR = "Сплин\n12 июня - Питер\n13 июня - Минск\nчат тура @splin_chat"
MESSAGES = "conv_id long, turn long, role string, text string"


def test_history_is_bounded_and_goes_on_after_a_restart(spark, tmp_path):
    """Each call is a new stream over the same state: what the last one kept is there, and late old turns push nothing out."""
    rng = random.Random(3)
    every = [(c, k, "user", f"{c}/{k}") for c in range(5) for k in range(30)] + [(9, None, "user", "no turn"), (9, 1, "user", None)]
    rng.shuffle(every)
    folder = str(tmp_path)
    for k in range(3):
        spark.createDataFrame(every[k::3], MESSAGES).write.mode("append").parquet(f"{folder}/arrived")
        jobs.keep_history(spark.readStream.schema(MESSAGES).parquet(f"{folder}/arrived"), folder, keep=4)
        seen = [m for part in range(k + 1) for m in every[part::3]]
        want = sorted((m for c in {m[0] for m in seen} for m in sorted((m for m in seen if m[0] == c), key=lambda m: (m[1] is not None, m[1] or 0))[-4:]), key=str)
        assert sorted((tuple(r) for r in jobs.stored_history(spark, folder).collect()), key=str) == want
    jobs.keep_history(spark.readStream.schema(MESSAGES).parquet(f"{folder}/arrived"), folder, keep=4)  # nothing new
    assert jobs.stored_history(spark, folder).count() == len(want)


def test_streamed_drafts_equal_batch_drafts(spark, tmp_path):
    ddl, folder = "post_id long, channel_id long, source string, published date, text string", str(tmp_path)
    rows = [(k, 7, "s", dt.date(2024, 5, 15), v) for k, v in enumerate((POST, TOUR, None, "спасибо"))]
    profiles = spark.createDataFrame([(7, "Казань", "Зал")], "channel_id long, profile_city string, profile_venue string")
    for part in (rows[:1], rows[1:]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(f"{folder}/arrived")
        jobs.keep_drafts(spark.readStream.schema(ddl).parquet(f"{folder}/arrived"), folder, profiles)
    whole = posts.drafts(spark.createDataFrame(rows, ddl), profiles)
    assert sorted(map(str, jobs.stored_drafts(spark, folder).select(whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_deltas_pass_from_block_to_block(spark):
    rng, rows, before = random.Random(1), [], ""
    for k in range(60):
        before = before + rng.choice("abc") if rng.random() < 0.8 else rng.choice("xyz")
        rows.append(("k", k * 3, before))
    rows += [("other", 5, None), ("other", 2000, "late")]
    want = {(r[0], r[1]): r[2] or "" for r in rows}
    for key, seq, text in rows:
        last = max((s for k, s, _ in rows if k == key and s < seq), default=None)
        if last is not None and (text or "").startswith(want_text := next(t or "" for k, s, t in rows if (k, s) == (key, last))):
            want[key, seq] = (text or "")[len(want_text) :]
    for block in (1, 7, 1024):
        found = reports.text_deltas(spark.createDataFrame(rows, "key string, seq long, text string"), block=block)
        assert {(r.key, r.seq): r.delta for r in found.collect()} == want


@pytest.mark.parametrize(("few_items", "few_messages", "most"), [(64, 10_000, 20), (3, 2, 2), (0, 0, 5)])
def test_context_rows_equal_brute_force(spark, few_items, few_messages, most):
    """A word that half of all messages and entities have is ranked once for each set of such words."""
    rng = random.Random(8)
    words = [f"word{k:03d}" for k in range(40)]
    text = lambda: " ".join([*rng.sample(words, rng.randrange(1, 9)), "tiny", *(["planted"] if rng.random() < 0.5 else [])])
    said, known = [(k, text()) for k in range(60)] + [(99, None), (100, "")], [(k, text().upper()) for k in range(40)]
    split = lambda t: {w for w in (t or "").lower().split(" ") if len(w) >= 6}
    want = set()
    for m, a in said:
        hits = Counter({i: n for i, b in known if (n := len(split(a) & split(b)))})
        want |= {(m, i, n) for i, n in sorted(hits.items(), key=lambda x: (-x[1], x[0]))[:most]}
    found = reports.context_rows(spark.createDataFrame(said, "message long, text string"), spark.createDataFrame(known, "item_id long, text string"), most=most, few_items=few_items, few_messages=few_messages, salts=3)
    assert {tuple(r) for r in found.collect()} == want


def test_results_keep_any_nested_value(spark):
    value = {"a": [1, {"b": None, "c": [True, "x", 2.5]}], "d": {}, "e": ""}
    whole = {
        "content_type": "event", "is_useful": True, "priority": "low", "confidence": 0.5, "main_decision": "review",
        "decisions": [{"type": "t", "confidence": None, "data": value, "evidence": [{"field": "f", "value": value, "source": "s", "source_text": None, "confidence": 1.0, "metadata": value}]}],
        "variants": [value, {}], "sql_plan": [{"sql": "select 1", "purpose": None, "confidence": None, "requires_review": True, "metadata": value}], "warnings": ["w", ""], "raw": value,
    }
    wrong = [dict(whole, is_useful=1), dict(whole, priority=None), dict(whole, confidence="high"), {k: v for k, v in whole.items() if k != "main_decision"}]
    bare = {k: whole[k] for k in ("content_type", "is_useful", "priority", "main_decision")} | {"confidence": True, "decisions": "none", "variants": [1], "sql_plan": [{"sql": "x", "requires_review": []}, {"sql": 1}], "warnings": {"a": 1}, "raw": [1]}
    texts = [json.dumps(whole), json.dumps(bare), *map(json.dumps, wrong), "{broken", "[1]", "", None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, json string").select("k", results.parsed(F.col("json")).alias("r")).filter("r is not null").select("k", results.as_json(F.col("r")).alias("json"))
    found = {r.k: json.loads(r.json) for r in rows.collect()}
    assert found[0] == whole
    assert found[1] == {**{k: bare[k] for k in ("content_type", "is_useful", "priority", "main_decision")}, "confidence": 1.0, "decisions": [], "variants": [], "sql_plan": [{"sql": "x", "purpose": None, "confidence": None, "requires_review": False, "metadata": {}}], "warnings": [], "raw": {}}
    assert set(found) == {0, 1}


def test_fields_say_their_rule_and_place(spark):
    texts = {
        1: "https://x.example\n- point\nНОЧЬ МУЗЫКИ\n* Когда: 5 мая \nГде:  Клуб Волга\nцена: 500 руб. ;\n16+ в Питере",
        2: "Тур\nИсполнитель: Сплин\nдата:\n",
        3: None,
        4: "www.only.example",
    }
    rows = [(k, v, {"event_date": " 2024-05-05 ", "city": "Минск"} if k == 2 else None) for k, v in texts.items()]
    found = inputs.fields_of(spark.createDataFrame(rows, "run_id long, text string, metadata map<string,string>")).collect()
    got = {(r.run_id, r.field): (r.value, r.rule) for r in found}
    assert got == {
        (1, "title"): ("НОЧЬ МУЗЫКИ", "first_line"), (1, "artist"): ("Ночь Музыки", "title"), (1, "event_type"): ("concert", "artist"), (1, "date"): ("5 мая", "label"), (1, "city"): ("Санкт-Петербург", "alias"),
        (1, "venue"): ("Клуб Волга", "label"), (1, "price"): ("500 руб", "label"), (1, "age_limit"): ("16", "age"),
        (2, "title"): ("Тур", "first_line"), (2, "artist"): ("Сплин", "label"), (2, "event_type"): ("concert", "artist"), (2, "date"): ("2024-05-05", "metadata"), (2, "city"): ("Минск", "metadata"),
    }
    for r in found:
        if r.start is not None:
            place = texts[r.run_id][r.start : r.end]
            assert place.lower() == {"title": r.value.lower(), "alias": "питер"}.get(r.rule, r.value.lower())


def test_a_failed_report_leaves_no_rows(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise("x").cast("string").alias("text"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_csv(str(tmp_path / "report"), rows)
    left = [f for f in (tmp_path / "report").rglob("part-*") if "_temporary" not in str(f)] if (tmp_path / "report").exists() else []
    assert not left and not (tmp_path / "report" / "_SUCCESS").exists()
    good = spark.createDataFrame([(1, ' "a",\nb '), (2, None)], "id long, text string")
    sinks.write_csv(str(tmp_path / "good"), good, spark.createDataFrame([(3, [1, 2])], "id long, more array<int>"))
    assert sorted(map(tuple, sinks.read_csv(spark, str(tmp_path / "good")).collect()), key=str) == [("1", ' "a",\nb ', None), ("2", None, None), ("3", None, "[1,2]")]


def test_artists_titles_and_cities_by_labels(spark):
    lines = posts.lines(spark.createDataFrame([(1, dt.date(2024, 5, 1), '{"a": 1}\nhttps://x.example\nНочь\nАртисты: Ария; Кино, ария\nАртист: Сплин\nTitle: Большая ночь'), (2, dt.date(2024, 5, 1), "Казань: https://tickets.example/1\nПитер https://tickets.example/2\nкупить билет https://tickets.example/3\nКазань https://tickets.example/4")], "post_id long, published date, text string"))
    assert [r.artist for r in posts.labelled_artists(lines).orderBy("at").collect()] == ["Ария", "Кино", "Сплин"]
    assert {r.post_id: r.title for r in posts.labelled_titles(lines).collect()}[1] == "Большая ночь"
    assert {r.post_id: r.title for r in posts.first_titles(lines, no_urls=True).collect()}[1] == "Ночь"
    assert [(r.post_id, r.city) for r in posts.link_cities(posts.links(lines)).orderBy("at").collect()] == [(2, "Казань"), (2, "Санкт-Петербург")]


def test_each_json_text_is_read_once(spark, small):
    """A plan that names the parser again for each field, or below a filter, reads each text as often."""
    plan = registry.queries()["r18_nested_results"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 2  # the texts, and what was written of them
