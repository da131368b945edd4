"""Field rules over a post's text or one of its lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import DOTTED, LEFT, RIGHT, SIGNS, WORDED, has_any, let
from .text import text_or_empty, url_loose_key


@dataclass(frozen=True)
class Kind:
    """A kind of message: how sure a mark makes it, and its marks, whole words or stems that end in *."""

    name: str
    confidence: float
    marks: tuple[str, ...]


@dataclass(frozen=True)
class Rules:
    """Word lists and rule tables of one domain and language; a caller passes its own."""

    labels: dict[str, tuple[str, ...]]
    ticket_words: tuple[str, ...]
    ticket_hosts: tuple[str, ...]
    chat_words: tuple[str, ...]
    service_phrases: tuple[str, ...]
    code_words: tuple[str, ...]
    kinds: tuple[Kind, ...]
    statuses: tuple[tuple[str, tuple[str, ...]], ...]
    short_words: int = 3
    short_confidence: float = 0.65

    @property
    def no_codes(self) -> list[str]:
        """Words that are no promo code: those that other rules know, and parts of addresses."""
        known = {w for group in self.labels.values() for w in group} | set(self.ticket_words) | set(self.code_words) | {m.rstrip("*") for k in self.kinds for m in k.marks}
        return sorted({part for w in known for part in w.split()} | {"http", "https", "www"})


#: A small set for concert announcements in Russian and English. The confidences are the operator's own.
CONCERTS = Rules(
    labels={"date": ("дата", "когда", "date", "when"), "venue": ("место", "площадка", "где", "venue", "place"), "price": ("цена", "стоимость", "price"), "ticket": ("билеты", "билет", "tickets", "ticket"), "chat": ("чат", "chat")},
    ticket_words=("билет", "купить", "ticket", "buy"),
    ticket_hosts=("ticket", "kassa"),
    chat_words=("чат", "chat"),
    service_phrases=("вход свободный", "подробнее по ссылке", "ссылка в описании"),
    code_words=("промокод", "promo", "код", "code"),
    kinds=(
        Kind("giveaway", 0.95, ("розыгрыш*", "разыгрыва*", "выиграй*", "giveaway", "raffle")),
        Kind("promo", 0.9, ("промокод*", "скидк*", "promo", "discount*", "код")),
        Kind("digest", 0.85, ("афиша", "подборка", "digest")),
        Kind("tour_announcement", 0.8, ("тур", "турне", "tour")),
        Kind("event", 0.75, ("концерт*", "клуб*", "билет*", "live", "завтра", "tickets")),
        Kind("low_signal", 0.7, ("спасибо", "привет", "ура", "thanks")),
    ),
    statuses=(("cancelled", ("отмен*", "cancel*")), ("postponed", ("перенос*", "перенес*", "перенёс*", "postpon*")), ("sold_out", ("sold out", "солдаут", "билетов нет", "распродан*"))),
)
AGE = r"(?=\d)(?<![0-9])(\d{1,2})\s*(?:\+|лет(?!\p{L}))"
URL = r"(?i)(?:https?://|www\.|t\.me/|vk\.com/)[^\s<>()]+"


def words(of: tuple[str, ...]) -> str:
    """A pattern of whole words and of stems."""
    return LEFT + "(?:" + "|".join(w[:-1] + r"\p{L}*" if w.endswith("*") else w.replace(" ", r"\s*") for w in of) + ")" + RIGHT


def has_word(low: Column, of: tuple[str, ...]) -> Column:
    """Whether a text in lower case has any of the words and stems."""
    return signs_of(low, of) & low.rlike(words(of))


def signs_of(low: Column, of: tuple[str, ...]) -> Column:
    """Whether a text contains what any of the words or stems begins with, as part of a word or not."""
    return has_any(low, *dict.fromkeys(w.rstrip("*").split(" ")[0] for w in of))


def urls(text: Column) -> Column:
    """Addresses with a scheme, without closing punctuation and slash, each once in order."""

    def clean(v: Column) -> Column:
        v = F.regexp_replace(v, r"[.,;:!?)\]}'\"»]+$", "")
        return F.regexp_replace(F.when(v.rlike("(?i)^https?://"), v).otherwise(F.concat(F.lit("https://"), v)), "/+$", "")

    return F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(URL), F.lit(0)), clean))


def first_of_each(values: Column, key: Callable[[Column], Column]) -> Column:
    """The values whose key none before them has, in order; sorts them, so that time follows their number."""
    ranked = F.array_sort(F.transform(values, lambda v, k: F.struct(key(v).alias("key"), k.alias("at"), v.alias("value"))))
    firsts = let(ranked, lambda held: F.filter(held, lambda s, k: (k == 0) | (F.get(held, k - 1)["key"] != s["key"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda s: F.struct(s["at"], s["value"]))), lambda s: s["value"])


def urls_to_verify(text: Column, listed: Column) -> Column:
    """Listed addresses, then those in the text, each once whatever its case."""
    return first_of_each(F.concat(listed, F.filter(urls(text), lambda u: u.rlike("^https?://"))), url_loose_key)


def link_type(url: Column, label: Column, rules: Rules = CONCERTS) -> Column:
    """ticket, chat or external, by the words of the label and the address."""
    low, said = F.lower(url), F.lower(text_or_empty(label))
    chat = low.rlike(r"(?:t|telegram)\.me/") | said.rlike("|".join(rules.chat_words))
    return F.when(said.rlike("|".join(rules.ticket_words)) | low.rlike("|".join(rules.ticket_hosts)), "ticket").when(chat, "chat").otherwise("external")


def label_pattern(name: str, rules: Rules = CONCERTS) -> str:
    return rf"(?iu)^\s*(?:{'|'.join(rules.labels[name])})\s*[:\-]\s*(.+?)\s*$"


def has_label(line: Column, names: Iterable[str], rules: Rules = CONCERTS) -> Column:
    """Whether a line, without blanks at its end, is a `label: value` line of any of the names: one search instead of one for each."""
    every = "|".join(w for n in names for w in rules.labels[n])
    return has_any(line, ":", "-") & line.rlike(rf"(?iu)^\s*(?:{every})\s*[:\-]\s*.")


def labelled(line: Column, name: str, rules: Rules = CONCERTS) -> Column:
    """The value of a `label: value` line, null if it is none."""
    return let(F.regexp_extract(text_or_empty(line), label_pattern(name, rules), 1), lambda found: F.when(found != "", found))


def any_label(line: Column, rules: Rules = CONCERTS) -> Column:
    """struct<label,value> of a line with any known label."""
    found = [F.when(line.rlike(label_pattern(n, rules)), F.struct(F.lit(n).alias("label"), labelled(line, n, rules).alias("value"))) for n in rules.labels]
    return F.coalesce(*found)


def age_limit(text: Column) -> Column:
    low = F.lower(text_or_empty(text))
    return F.when(has_any(low, "+", "лет"), F.regexp_extract(low, AGE, 1).try_cast("int"))


def is_price(line: Column, low: Column | None = None) -> Column:
    """Whole price words, or an amount of money; low is the line in lower case, if it is at hand."""
    low = F.lower(line) if low is None else low
    return (has_any(low, "цена", "стоимость", "price") | (has_any(low, "₽", "р") & low.rlike(r"\d\s*[₽р]"))) & low.rlike(rf"{LEFT}(?:цена|стоимость|price){RIGHT}|\d+\s*(?:руб|₽|р(?!\p{{L}}))")


def price_value(line: Column) -> Column:
    return F.coalesce(labelled(line, "price"), F.when(is_price(line), F.regexp_extract(line, r"(?iu)(\d+\s*(?:руб|₽|р))", 1)))


def status(text: Column, rules: Rules = CONCERTS) -> Column:
    """The first status of the table whose words the text has, else announced."""
    low = F.lower(text_or_empty(text))
    return F.coalesce(*(F.when(has_word(low, marks), F.lit(name)) for name, marks in rules.statuses), F.lit("announced"))


def message_kind(text: Column, rules: Rules = CONCERTS) -> Column:
    """struct<kind,confidence,reason>: of the kinds with a mark in the text the surest; the reason is its mark.

    A text of few words without a mark says little; an empty one nothing.
    """
    low = F.lower(text_or_empty(text))

    def found(kind: Kind) -> Column:
        mark = F.regexp_extract(low, f"({words(kind.marks)})", 1)
        return F.when(signs_of(low, kind.marks) & (mark != ""), F.struct(F.lit(kind.confidence).alias("confidence"), F.lit(kind.name).alias("kind"), mark.alias("reason")))

    other = lambda confidence, kind, reason: F.struct(F.lit(confidence).alias("confidence"), F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    few = rf"^\s*(?:\S+\s*){{1,{rules.short_words}}}$"
    ranked = sorted(rules.kinds, key=lambda k: -k.confidence)
    best = F.coalesce(*(found(k) for k in ranked), F.when(~low.rlike(r"\S"), other(0.0, "unknown", "empty")), F.when(low.rlike(few), other(rules.short_confidence, "low_signal", "few words")), other(0.3, "unknown", "no mark"))
    return best


def promo_codes(text: Column, rules: Rules = CONCERTS) -> Column:
    """Words of letters and digits that follow a code word, each once whatever its case, in order.

    Words that other rules know and numbers are no codes.
    """
    after = rf"(?iu){LEFT}(?:{'|'.join(rules.code_words)})(?:[^\S\r\n]+code)?[^\S\r\n]*(?:[:=\-]\s*|\s+)([\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_-]{{2,23}}){RIGHT}"
    found = F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(after), F.lit(1)), lambda c: F.regexp_replace(c, "[_-]+$", ""))
    good = F.filter(found, lambda c: c.rlike(r"\p{L}") & (F.length(c) >= 3) & ~F.lower(c).isin(rules.no_codes))
    return first_of_each(good, F.lower)


_CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]\d"
#: One time, or a range of two.
TIMES = rf"(?=\d)(?<![0-9:])({_CLOCK})(?:\s*[-–—]\s*({_CLOCK}))?(?![0-9:])"


def timings(text: Column) -> Column:
    """array<struct<label,time,until>>: clock times and ranges in order, labelled doors or start by what stands before them."""
    value = text_or_empty(text)
    before = F.split(value, TIMES, -1)
    first, last = (F.regexp_extract_all(value, F.lit(TIMES), F.lit(k)) for k in (1, 2))

    def one(t: Column, k: Column) -> Column:
        context = F.lower(F.right(F.element_at(before, k + 1), F.lit(40)))
        doors, start = context.rlike(words(("двери", "doors"))), context.rlike(words(("начало", "start", "show")))
        until = F.get(last, k)
        return F.struct(F.when(doors & ~start, "doors").when(start, "start").alias("label"), F.lpad(t, 5, "0").alias("time"), F.when(until != "", F.lpad(until, 5, "0")).alias("until"))

    return F.array_distinct(F.transform(first, one))


def is_narrative(line: Column) -> Column:
    """Long prose: 8 words and 25 letters, or 2 sentences and 20 letters."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    n_words = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    sentences = F.size(F.filter(F.split(line, "[.!?]+"), lambda s: F.trim(s) != ""))
    return ((n_words >= 8) & (letters >= 25)) | ((sentences >= 2) & (letters >= 20))


def line_flags(line: Column, rules: Rules = CONCERTS, low: Column | None = None) -> dict[str, Column]:
    """What a line looks like; low is the line in lower case, if it is at hand."""
    low = F.lower(line) if low is None else low
    return {
        "is_labelled": has_label(line, rules.labels, rules),
        "is_date": (low.rlike(f"{SIGNS['dotted']}|{SIGNS['worded']}") & (low.rlike(DOTTED) | low.rlike(WORDED))) | has_label(line, ["date"], rules),
        "is_time": has_any(line, ":") & line.rlike(TIMES),
        "is_age": has_any(low, "+", "лет") & low.rlike(AGE),
        "is_ticket": has_any(low, *rules.ticket_words),
        "is_promo": has_word(low, rules.code_words),
        "is_service": has_any(low, *rules.service_phrases) | (has_any(low, "/", "www.") & line.rlike(URL)),
        "is_price": is_price(line, low),
        "is_short": F.length(line) <= 2,
    }


def lint_sql(sql: Column) -> Column:
    """Errors of a read-only statement: its first word, words that write, and SELECT without LIMIT."""
    low = F.lower(F.trim(text_or_empty(sql)))
    return F.array_compact(
        F.array(
            F.when(low == "", "empty"),
            F.when((low != "") & ~low.rlike("^(?:select|with)\\b"), "prefix"),
            F.when(low.rlike(r"\b(?:insert|update|delete|drop|alter|truncate|create|grant)\b"), "forbidden_word"),
            F.when(low.rlike("^select\\b") & ~low.rlike(r"\blimit\b"), "no_limit"),
        )
    )
