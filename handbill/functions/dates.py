"""Date rules over announcement text.

Each rule is a column struct<start,end,raw> or null; the cascade takes the first rule that
yields. All take the text in lower case and a reference date, never the clock. A date
without a year is in the reference year, or in the next year if it would lie in the past;
29 February then stays in the past when the next year has none. Of day words the longest
wins, and a range of day words goes before a single one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Fixed values.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
ENGLISH_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAY_WORDS = {"позавчера": -2, "послезавтра": 2, "вчера": -1, "сегодня": 0, "завтра": 1}
WEEKDAYS = {
    "понедельник": 0, "понедельника": 0, "понедельнике": 0, "понедельникам": 0, "вторник": 1, "вторника": 1, "вторникам": 1, "среда": 2, "среду": 2, "среды": 2, "средам": 2,
    "четверг": 3, "четверга": 3, "четвергам": 3, "пятница": 4, "пятницу": 4, "пятницы": 4, "пятницам": 4, "суббота": 5, "субботу": 5, "субботы": 5, "субботам": 5,
    "воскресенье": 6, "воскресенья": 6, "воскресеньям": 6, "пн": 0, "вт": 1, "ср": 2, "чт": 3, "пт": 4, "сб": 5, "вс": 6,
}

LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_MONTH = "(" + "|".join(MONTHS) + ")"
_DAY = "(" + "|".join(sorted(WEEKDAYS, key=len, reverse=True)) + ")"
_WORD = "(" + "|".join(sorted(DAY_WORDS, key=len, reverse=True)) + ")"
_YEAR = r"(?:\s+(\d{4}|\d{2})(?!\d))?"


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _number(word: Column, words: dict) -> Column:
    return F.element_at(_map(words), word)


def month_number(word: Column) -> Column:
    return _number(word, {m: k + 1 for k, m in enumerate(MONTHS)})


def ymd(year: Column, month: Column, day: Column) -> Column:
    """A date, null if there is no such day."""

    def of(s: Column) -> Column:
        first = F.when(s["m"].between(1, 12) & s["y"].between(0, 99999) & (s["d"] >= 1), F.make_date(s["y"], s["m"], F.lit(1)))
        return let(F.date_add(first, s["d"] - 1), lambda v: F.when(F.month(v) == s["m"], v))

    return let(F.struct(year.alias("y"), month.alias("m"), F.least(day, F.lit(32)).alias("d")), of)


def year_number(text: Column) -> Column:
    """A written year as a number, two digits in this century; null if none is written."""
    n = text.try_cast("int")
    return F.when(F.length(text) == 2, n + 2000).when(text != "", n)


def dated(year_text: Column, month: Column, day: Column, reference: Column) -> Column:
    """The day meant: in the written year, else on or after the reference date."""

    def of(s: Column) -> Column:
        given, year = year_number(s["y"]), F.year(s["ref"])
        plain = F.struct(ymd(F.coalesce(given, year), s["m"], s["d"]).alias("day"), ymd(year + 1, s["m"], s["d"]).alias("next"), (given.isNull() & s["ref"].isNotNull()).alias("bare"), s["ref"].alias("ref"))
        return let(plain, lambda p: F.when(p["bare"] & (p["day"] < p["ref"]), F.coalesce(p["next"], p["day"])).otherwise(p["day"]))

    return let(F.struct(year_text.alias("y"), month.alias("m"), day.alias("d"), reference.alias("ref")), of)


def _result(start: Column, end: Column, raw: Column) -> Column:
    """Null unless both ends are days and in order."""
    return let(F.struct(start.alias("start"), end.alias("end"), F.trim(raw).alias("raw")), lambda r: F.when(r["start"] <= r["end"], r))


def _single(day: Column, raw: Column) -> Column:
    return let(F.struct(day.alias("day"), F.trim(raw).alias("raw")), lambda r: F.when(r["day"].isNotNull(), F.struct(r["day"].alias("start"), r["day"].alias("end"), r["raw"].alias("raw"))))


class Found:
    """A pattern's first match in a text: its groups as text and as numbers."""

    def __init__(self, text: Column, pattern: str) -> None:
        self.text, self._text, self._pattern = text, text, pattern

    def __getitem__(self, group: int) -> Column:
        return F.regexp_extract(self._text, self._pattern, group)

    def number(self, group: int) -> Column:
        return self[group].try_cast("int")

    @property
    def is_there(self) -> Column:
        return self._text.rlike(self._pattern)


def _first(text: Column, pattern: str, sign: Column, use: Callable[[Found], Column], other: Column | None = None) -> Column:
    """use() of a pattern's first match, else the other value; the pattern is searched for once, where its sign is, and its groups in the match."""
    return let(F.when(sign, F.regexp_extract(text, pattern, 0)), lambda r: F.when(r != "", use(Found(r, pattern))).otherwise(F.lit(None) if other is None else other))


def day_range(text: Column, reference: Column) -> Column:
    m = Found(text, rf"{LEFT}{_WORD}\s*(?:-|–|—|и)\s*{_WORD}{RIGHT}")
    return _result(F.date_add(reference, _number(m[1], DAY_WORDS)), F.date_add(reference, _number(m[2], DAY_WORDS)), m[0])


def day_word(text: Column, reference: Column) -> Column:
    m = Found(text, rf"{LEFT}{_WORD}{RIGHT}")
    return _single(F.date_add(reference, _number(m[1], DAY_WORDS)), m[0])


def offset(text: Column, reference: Column) -> Column:
    """In or ago so many days, hours (whole days of them) or weeks."""
    rules = []
    for unit, size in (("день|дня|дней", F.lit(1)), ("час|часа|часов", None), ("неделю|недели|недель", F.lit(7))):
        for pattern, sign in ((rf"{LEFT}через\s+(\d{{1,3}})\s+(?:{unit}){RIGHT}", 1), (rf"{LEFT}(\d{{1,3}})\s+(?:{unit})\s+назад{RIGHT}", -1)):
            m = Found(text, pattern)
            days = F.floor(m.number(1) / 24).cast("int") if size is None else m.number(1) * size
            rules.append(_single(F.date_add(reference, sign * days), m[0]))
    return F.coalesce(*rules)


def _coming(reference: Column, index: Column) -> Column:
    return F.date_add(reference, F.pmod(index - F.weekday(reference), F.lit(7)).cast("int"))


def weekday_range(text: Column, reference: Column) -> Column:
    def of(m: Found) -> Column:
        ends = F.struct(_number(m[1], WEEKDAYS).alias("a"), _number(m[2], WEEKDAYS).alias("b"))
        return let(ends, lambda e: _result(_coming(reference, e["a"]), F.date_add(_coming(reference, e["a"]), F.pmod(e["b"] - e["a"], F.lit(7)).cast("int")), m.text))

    return _first(text, rf"{LEFT}{_DAY}\s*[-–—]\s*{_DAY}{RIGHT}", text.rlike(r"[а-я]\s*[-–—]\s*[а-я]"), of)


def weekday(text: Column, reference: Column) -> Column:
    """This weekday may be the reference date; the next is the first one after it, even in the same week."""
    this, following = Found(text, rf"{LEFT}(?:эт(?:от|у|о|а))\s+{_DAY}{RIGHT}"), Found(text, rf"{LEFT}(?:следующ(?:ий|ую|ее|ая))\s+{_DAY}{RIGHT}")
    return F.coalesce(_single(_coming(reference, _number(this[1], WEEKDAYS)), this[0]), _single(_coming(F.date_add(reference, 1), _number(following[1], WEEKDAYS)), following[0]))


def _from_monday(m: Found, reference: Column, day: int, days: int) -> Column:
    """So many days from a day of this week, or of the next where the phrase says so; the phrase must be there."""
    start = F.date_add(F.date_trunc("week", reference).cast("date"), F.when(m[1].startswith("след"), day + 7).otherwise(day))
    return F.when(m.is_there, let(start, lambda s: _result(s, F.date_add(s, days - 1), m[0])))


def weekend(text: Column, reference: Column) -> Column:
    return _from_monday(Found(text, rf"{LEFT}(эти|этих|следующие|следующих)\s+выходны(?:е|х){RIGHT}"), reference, 5, 2)


def week(text: Column, reference: Column) -> Column:
    return _from_monday(Found(text, rf"{LEFT}(эта|эту|этой|следующая|следующую|следующей)\s+недел(?:я|ю|е){RIGHT}"), reference, 0, 7)


def part_of_month(text: Column, reference: Column) -> Column:
    """Days 1 to 10, 11 to 20, or 21 to the last."""

    def of(m: Found) -> Column:
        first = F.when(m[1].startswith("нач"), 1).when(m[1].startswith("сер"), 11).otherwise(21)
        said = F.struct(first.alias("first"), month_number(m[2]).alias("month"), year_number(m[3]).alias("year"))

        def days(s: Column) -> Column:
            year = F.coalesce(s["year"], F.year(reference) + F.when(s["month"] < F.month(reference), 1).otherwise(0))
            return let(ymd(year, s["month"], s["first"]), lambda start: _result(start, F.when(s["first"] == 21, F.last_day(start)).otherwise(F.date_add(start, 9)), m.text))

        return let(said, days)

    return _first(text, rf"{LEFT}(начал[оеа]|середин[аеы]|кон(?:ец|це|ца))\s+{_MONTH}{_YEAR}{RIGHT}", has_any(text, *MONTHS), of)


def explicit_range(text: Column, reference: Column) -> Column:
    """Six written shapes in this order; a shape that matches but is no range ends the search."""
    dot = r"(\d{1,2})[./](\d{1,2})(?:[./](\d{4}|\d{2}))?"
    sep = r"\s*[-–—]\s*"
    shapes = (
        (rf"{LEFT}с\s+(\d{{1,2}})\s+по\s+(\d{{1,2}})\s+{_MONTH}{_YEAR}{RIGHT}", (1, 3, 4), (2, 3, 4), True),
        (rf"{LEFT}с\s+{dot}\s+по\s+{dot}{RIGHT}", (1, 2, 3), (4, 5, 6), False),
        (rf"{LEFT}(\d{{1,2}})\s+{_MONTH}{_YEAR}{sep}(\d{{1,2}})\s+{_MONTH}{_YEAR}{RIGHT}", (1, 2, 3), (4, 5, 6), True),
        (rf"{LEFT}(\d{{1,2}}){sep}(\d{{1,2}})\s+{_MONTH}{_YEAR}{RIGHT}", (1, 3, 4), (2, 3, 4), True),
        (rf"{LEFT}{dot}{sep}{dot}{RIGHT}", (1, 2, 3), (4, 5, 6), False),
        (rf"{LEFT}(\d{{1,2}}){sep}{dot}{RIGHT}", (1, 3, 4), (2, 3, 4), False),
    )
    chosen = F.lit(None)
    for pattern, first, last, words in reversed(shapes):

        def of(m: Found, first=first, last=last, words=words) -> Column:
            month = (lambda g: month_number(m[g])) if words else m.number
            start, end = (dated(m[y], month(k), m.number(d), reference) for d, k, y in (first, last))
            return _result(start, end, m.text)

        parts = has_any(text, *MONTHS) if words else text.rlike(r"\d[./]\d")
        chosen = _first(text, pattern, parts & (F.contains(text, F.lit("по")) if r"\s+по\s+" in pattern else has_any(text, *"-–—")), of, chosen)
    return chosen


DOTTED = rf"(?=\d){LEFT}(\d{{1,2}})[./-](\d{{1,2}})(?:[./-](\d{{4}}|\d{{2}}))?{RIGHT}"
WORDED = rf"(?=\d){LEFT}(\d{{1,2}})\s+{_MONTH}{_YEAR}{RIGHT}"
ENGLISH = rf"(?=\d){LEFT}(\d{{1,2}})\s+({'|'.join(ENGLISH_MONTHS)})(?:\s+(\d{{4}}))?{RIGHT}"


def _first_day(text: Column, pattern: str, sign: str, day: Callable[[Found], Column]) -> Column:
    """The day that a pattern's first match means."""
    return _first(text, pattern, text.rlike(sign), lambda m: _single(day(m), m.text))


def dotted_date(text: Column, reference: Column) -> Column:
    return _first_day(text, DOTTED, SIGNS["dotted"], lambda m: dated(m[3], m.number(2), m.number(1), reference))


def worded_date(text: Column, reference: Column) -> Column:
    return _first_day(text, WORDED, SIGNS["worded"], lambda m: dated(m[3], month_number(m[2]), m.number(1), reference))


def english_date(text: Column, reference: Column) -> Column:
    return _first_day(text, ENGLISH, SIGNS["english"], lambda m: dated(m[3], _number(m[2], {w: k + 1 for k, w in enumerate(ENGLISH_MONTHS)}), m.number(1), reference))


#: The cascade, in order.
RULES = {
    "relative_range": day_range, "relative_day": day_word, "relative_offset": offset, "weekday_range": weekday_range, "weekday": weekday, "weekend": weekend, "week": week,
    "part_of_month": part_of_month, "explicit_range": explicit_range, "dotted": dotted_date, "worded": worded_date, "english": english_date,
}


#: What a text must contain for a rule to be tried: one quick search in place of several exact ones.
SIGNS = {
    "relative_range": "сегодня|завтра|вчера", "relative_day": "сегодня|завтра|вчера", "relative_offset": "через|назад", "weekday_range": "[-–—]", "weekday": "эт|следующ", "weekend": "выходн", "week": "недел",
    "part_of_month": "нач|сер|кон", "explicit_range": r"(?s)\d.*(?:[-–—]|\sпо\s).*\d", "dotted": r"\d[./-]\d", "worded": r"\d\s+[а-я]", "english": r"\d\s+[a-z]",
}


def has_any(text: Column, *parts: str) -> Column:
    """Whether a text contains any of the parts: a quick sign, before a pattern that needs one of them is searched for."""
    found = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        found |= F.contains(text, F.lit(part))
    return found


def _signed(text: Column, name: str) -> Column:
    """Whether a rule's sign is there; one of plain words or characters needs no pattern."""
    sign = SIGNS[name].strip("[]")
    return has_any(text, *sign) if f"[{sign}]" == SIGNS[name] else has_any(text, *sign.split("|")) if sign.replace("|", "").isalpha() else text.rlike(SIGNS[name])


#: The rules that need a digit; the last ones of the cascade.
IN_DIGITS = ("explicit_range", "dotted", "worded", "english")
#: What follows a day's number in all of them.
_IN_DIGITS = r"\d(?:[./-]\d|\s+[а-яa-z]|\s*[-–—]\s*\d)"


def date_range(text: Column, reference: Column) -> Column:
    """struct<start,end,raw,source> of the first rule that yields, else null."""

    def of(low: Column) -> Column:
        tried = {name: F.when(_signed(low, name), _named(rule(low, reference), name)) for name, rule in RULES.items()}
        return F.coalesce(*(c for n, c in tried.items() if n not in IN_DIGITS), F.when(low.rlike(_IN_DIGITS), F.coalesce(*(tried[n] for n in IN_DIGITS))))

    return let(F.lower(text), of)


def _named(found: Column, name: str) -> Column:
    return let(found, lambda r: F.when(r.isNotNull(), F.struct(r["start"].alias("start"), r["end"].alias("end"), r["raw"].alias("raw"), F.lit(name).alias("source"))))


def all_dates(text: Column, reference: Column) -> Column:
    """All distinct explicit days of a text in order, as an array: dotted, worded, and lists of days in a month."""
    low = F.lower(text)
    dotted = F.transform(F.regexp_extract_all(low, F.lit(DOTTED), F.lit(0)), lambda v: dotted_date(v, reference)["start"])
    worded = F.transform(F.regexp_extract_all(low, F.lit(WORDED), F.lit(0)), lambda v: worded_date(v, reference)["start"])
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(dotted, worded, day_list(text, reference)))))


def day_list(text: Column, reference: Column) -> Column:
    """The days of a list in one month ("1, 2 и 3 мая"), else an empty array."""
    m = Found(F.lower(text), rf"{LEFT}((?:\d{{1,2}}\s*,\s*)*\d{{1,2}}\s+и\s+\d{{1,2}}|\d{{1,2}}(?:\s*,\s*\d{{1,2}})+)\s+{_MONTH}{_YEAR}{RIGHT}")
    days = F.regexp_extract_all(m[1], F.lit(r"\d{1,2}"), F.lit(0))
    return F.array_compact(F.transform(days, lambda d: dated(m[3], month_number(m[2]), d.cast("int"), reference)))


def is_daily(text: Column) -> Column:
    return F.lower(text).rlike(rf"{LEFT}(?:ежедневно|каждый\s+день){RIGHT}")


def recurring_weekday(text: Column) -> Column:
    """Monday 0 to Sunday 6 for "every Saturday" and "on Saturdays", else null."""
    m = Found(F.lower(text), rf"{LEFT}(?:кажд(?:ый|ую|ое)|по)\s+{_DAY}{RIGHT}")
    return _number(m[1], WEEKDAYS)


def has_year(text: Column) -> Column:
    return text.rlike(r"\b20\d{2}\b")


def short_date(text: Column) -> Column:
    """dd.mm or dd.mm.yyyy as text: from a labelled line if there is one, else from anywhere."""
    low = F.lower(text)
    line = F.regexp_extract(low, r"(?m)^\s*(?:дата|когда|when|date)\s*[:\-]\s*(.+)$", 1)

    def of(part: Column) -> Column:
        d, w = Found(part, DOTTED), Found(part, WORDED)
        full = lambda day, month, year: F.concat_ws(".", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), F.when(year != "", year_number(year).cast("string")))
        return F.coalesce(F.when(d.is_there, full(d[1], d[2], d[3])), F.when(w.is_there, full(w[1], month_number(w[2]).cast("string"), w[3])))

    return F.coalesce(of(line), of(low))
