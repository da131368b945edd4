"""Text, date and field functions on small hand-made rows."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from handbill.functions import dates, fields
from handbill.functions import text as t


def apply(spark, values, *columns):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [tuple(r)[0] if len(columns) == 1 else tuple(r) for r in rows.orderBy("k").select(*columns).collect()]


def ref():
    """A Wednesday."""
    return F.lit(dt.date(2024, 5, 15))


def v():
    return F.col("v")


CASES = [
    ("завтра", "2024-05-16", "2024-05-16", "relative_day"),
    ("послезавтра", "2024-05-17", "2024-05-17", "relative_day"),
    ("сегодня-завтра", "2024-05-15", "2024-05-16", "relative_range"),
    ("через 3 дня", "2024-05-18", "2024-05-18", "relative_offset"),
    ("2 недели назад", "2024-05-01", "2024-05-01", "relative_offset"),
    ("через 30 часов", "2024-05-16", "2024-05-16", "relative_offset"),
    ("пт-вс", "2024-05-17", "2024-05-19", "weekday_range"),
    ("сб-пн", "2024-05-18", "2024-05-20", "weekday_range"),
    ("в эту среду", "2024-05-15", "2024-05-15", "weekday"),
    ("в следующую среду", "2024-05-22", "2024-05-22", "weekday"),
    ("в следующую пятницу", "2024-05-17", "2024-05-17", "weekday"),
    ("в эти выходные", "2024-05-18", "2024-05-19", "weekend"),
    ("на следующей неделе", "2024-05-20", "2024-05-26", "week"),
    ("в конце февраля", "2025-02-21", "2025-02-28", "part_of_month"),
    ("с 12 по 14 июня", "2024-06-12", "2024-06-14", "explicit_range"),
    ("30 мая - 2 июня", "2024-05-30", "2024-06-02", "explicit_range"),
    ("12-14.06.2025", "2025-06-12", "2025-06-14", "explicit_range"),
    ("1 мая", "2025-05-01", "2025-05-01", "worded"),
    ("31.12", "2024-12-31", "2024-12-31", "dotted"),
    ("01.02.23", "2023-02-01", "2023-02-01", "dotted"),
    ("12 may 2026", "2026-05-12", "2026-05-12", "english"),
]


def test_cascade(spark):
    found = apply(spark, [c[0] for c in CASES], dates.date_range(v(), ref()))
    assert [(c[0], str(r.start), str(r.end), r.source) for c, r in zip(CASES, found, strict=True)] == CASES


def test_no_dates(spark):
    assert apply(spark, ["", None, "30.02.2024", "99 мая", "12:30", "концерт"], dates.date_range(v(), ref())) == [None] * 6


def test_leap_day_stays_when_the_next_year_has_none(spark):
    assert apply(spark, ["29 февраля"], dates.worded_date(v(), F.lit(dt.date(2024, 3, 1)))["start"]) == [dt.date(2024, 2, 29)]


def test_lists_and_recurrence(spark):
    assert apply(spark, ["1, 2 и 3 июня"], dates.all_dates(v(), ref())) == [[dt.date(2024, 6, d) for d in (1, 2, 3)]]
    assert apply(spark, ["по пятницам", "каждую субботу", "ежедневно"], dates.recurring_weekday(v()), dates.is_daily(v())) == [(4, False), (5, False), (None, True)]
    assert apply(spark, ["Дата: 5.6.24\n7.8", "7 августа"], dates.short_date(v())) == ["05.06.2024", "07.08"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="0123456789./- маяиюнс", max_size=20), min_size=100, max_size=200))
def test_a_rule_never_yields_an_invalid_date(spark, texts):
    for r in apply(spark, texts, dates.date_range(v(), ref())):
        assert r is None or r.start <= r.end


def test_text_functions(spark):
    assert apply(spark, ["a  b\r\n\n\n\nc", "Show12 мая", None], t.normal_text(v())) == ["a b\n\nc", "Show 12 мая", ""]
    assert apply(spark, ["★ Ｈello —", "«Клуб»", "  - x -  "], t.clean_line(v())) == ["Hello", "Клуб»", "x"]
    assert apply(spark, ["Питер", "СПБ", "Казань", ""], t.city_name(v())) == ["Санкт-Петербург", "Санкт-Петербург", "Казань", None]
    assert apply(spark, ["a<br>b <a href='http://x.y'>t</a> &amp; &#1103;"], t.fragment_text(v())) == ["a\nb t http://x.y & я"]
    assert apply(spark, ["HTTP://X.com/A/?q#f", "x.com/"], t.url_key(v()), t.url_domain(v()), t.readable_url(v())) == [("http://x.com/A", "x.com", "HTTP://X.com/A/?q#f"), ("x.com", "x.com", "https://x.com/")]
    assert apply(spark, ["12", "ab", "яб", "aя", "!"], t.script(v())) == ["numeric", "latin", "cyrillic", "mixed", "unknown"]
    assert apply(spark, ['x {"a": "}"} y', '{"b": 1', "none"], t.balanced_object(v())) == ['{"a": "}"}', None, None]
    assert apply(spark, ['z {"b": 1} and {"c": 2}'], t.balanced_object(v())) == ['{"b": 1}']


def test_chunks_join_to_the_text(spark):
    text = "One two three. Four five six, seven eight nine.\nTen eleven twelve thirteen fourteen."
    parts = apply(spark, [text, "", None, "x" * 100], t.chunks(v(), F.lit(20)))
    assert all(len(p) <= 20 for row in parts for p in row)
    assert "".join("".join(parts[0]).split()) == "".join(text.split()) and parts[1] == parts[2] == [] and "".join(parts[3]) == "x" * 100


def test_fields(spark):
    assert apply(spark, ["18+", "16 лет", "лета", "118+"], fields.age_limit(v())) == [18, 16, None, None]
    assert apply(spark, ["промокод: SALE10, код ABC", "код: 12345", "промокод на всё ROCK"], fields.promo_codes(v()))[:2] == [["SALE10", "ABC"], []]
    assert apply(spark, ["Розыгрыш проходок", "концерт и промокод", "концерт", "спасибо", "", None], fields.message_kind(v())["kind"]) == ["giveaway", "promo", "event", "low_signal", "unknown", "unknown"]
    assert apply(spark, ["двери 19:00 начало 20:00", "25:00"], F.transform(fields.timings(v()), lambda x: F.concat_ws("@", x["label"], x["time"]))) == [["doors@19:00", "start@20:00"], []]
    assert apply(spark, ["see https://a.b/c/, www.x.y. t.me/z"], fields.urls(v())) == [["https://a.b/c", "https://www.x.y", "https://t.me/z"]]
    assert apply(spark, ["отменён концерт", "перенос", "sold out", "билеты"], fields.status(v())) == ["cancelled", "postponed", "sold_out", "announced"]
    assert apply(spark, ["select 1", "drop table x", "", "with a as (select 1) select * from a limit 1"], fields.lint_sql(v())) == [["no_limit"], ["prefix", "forbidden_word"], ["empty"], []]
