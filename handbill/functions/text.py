"""Column functions that clean and compare text. Null in, empty text out, unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Fixed values.
DASHES, QUOTES = "[–—−]", "[«»„“”]"
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "mdash": "—", "ndash": "–", "laquo": "«", "raquo": "»", "hellip": "…", "copy": "©", "amp": "&"}
CITY_ALIASES = {"питер": "Санкт-Петербург", "спб": "Санкт-Петербург", "санкт петербург": "Санкт-Петербург", "санкт-петербург": "Санкт-Петербург", "москва": "Москва", "минск": "Минск"}
ANTIBOT_MARKERS = ("captcha", "cloudflare", "are you a robot", "not a robot", "access denied", "проверка браузера", "подтвердите, что вы не робот", "ddos-guard")
#: Cyrillic letters and digits that look like a Latin letter, and that letter.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "0": "o", "1": "l", "3": "e", "6": "b"}
WORD = r"\p{L}\p{N}_"


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it: keeps plans of nested rules small."""
    return F.get(F.transform(F.array(value), use), 0)


def blank_to_null(value: Column) -> Column:
    """An empty text after trimming is a missing one."""
    trimmed = F.trim(value)
    return F.when(trimmed != "", trimmed)


def squeeze(value: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(value, r"[\t\n\x0B\f\r\x{85}\x{a0}][\s\x{85}\x{a0}]*| [\s\x{85}\x{a0}]+", " "))  # single blanks are left alone


def normal_text(value: Column) -> Column:
    """A post's text: plain blanks and newlines, glued dates set apart, at most one empty line in a row."""
    v = text_or_empty(value)
    for old, new in (("\u00a0", " "), ("\u200b", ""), ("\ufeff", ""), ("\r\n", "\n"), ("\r", "\n")):
        v = F.replace(v, F.lit(old), F.lit(new))
    v = F.regexp_replace(v, r"([A-Za-z])(?=\d{1,2}(?:\s+[А-Яа-яЁё]|[./]\d))|\t[ \t]*| [ \t]+", "$1 ")  # both in one pass
    v = let(v, lambda v: F.when(F.contains(v, F.lit("\n\n\n")), F.regexp_replace(v, r"\n{3,}", "\n\n")).otherwise(v))
    return let(v, lambda v: F.when(_edge(F.left(v, F.lit(1))) | _edge(F.right(v, F.lit(1))), F.regexp_replace(v, r"^\s+|\s+$", "")).otherwise(v))


def _edge(char: Column) -> Column:
    """Whether a text that begins or ends with the character may have to be trimmed."""
    return char.isin(" ", "\t", "\n", "\x0b", "\f", "\r", "\x85", "\u2028", "\u2029")


def normal_line(value: Column) -> Column:
    """One kind of dash and of quotes, single blanks."""
    return squeeze(F.translate(text_or_empty(value), DASHES[1:-1] + QUOTES[1:-1], "-" * len(DASHES[1:-1]) + '"' * len(QUOTES[1:-1])))


def plain_lines(value: Column) -> Column:
    """A normal_text() as normal_line() leaves each of its lines, but for blanks at their ends."""
    quotes, dashes = r"\x{ab}\x{bb}\x{201c}-\x{201e}", r"\x{2013}\x{2014}\x{2212}"
    v = let(value, lambda v: F.when(v.rlike(f"[{quotes}{dashes}]"), F.translate(v, DASHES[1:-1] + QUOTES[1:-1], "-" * len(DASHES[1:-1]) + '"' * len(QUOTES[1:-1]))).otherwise(v))
    rare = lambda v: F.contains(v, F.lit("\x0b")) | F.contains(v, F.lit("\f")) | F.contains(v, F.lit("\x85"))
    return let(v, lambda v: F.when(rare(v), F.regexp_replace(v, r"[\x0B\f\x{85}][\x0B\f\x{85} ]*| [\x0B\f\x{85} ]+", " ")).otherwise(v))


def is_stable(value: Column) -> Column:
    """Whether NFKC leaves a text alone for sure."""
    return value.rlike(_STABLE)


def nfkc(value: Column) -> Column:
    """Unicode NFKC, by the library that Spark's own collations use; a null text is empty."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text_or_empty(value), F.lit(True))


#: Texts that NFKC leaves alone: ASCII, Cyrillic, and the quotes and dashes of most posts.
_STABLE = "^[\\x{00}-\\x{7f}\\x{400}-\\x{45f}«»–—]*$"


#: Texts that are clean, if no two blanks in them meet: stable, without control characters, with a word's character at both ends.
_ENDS = "0-9A-Za-z_\\x{400}-\\x{45f}"
_CLEAN = rf"^[{_ENDS}](?:[\x{{20}}-\x{{7e}}\x{{400}}-\x{{45f}}«»–—]*[{_ENDS}])?\z"


def clean_line(value: Column) -> Column:
    """A line without leading icons and noise at its ends; NFKC-normalised where that matters."""
    plain = text_or_empty(value)
    v = F.when(plain.rlike(_STABLE), plain).otherwise(nfkc(plain))
    v = F.trim(F.replace(v, F.lit("\ufeff"), F.lit("")))
    v = F.regexp_replace(v, rf"^[^{WORD}]{{1,4}}\s*", "")
    v = F.regexp_replace(v, r"^[\s\-–—•*|:;,.]+|[\s\-–—•*|:;,]+$", "")
    return F.when(plain.rlike(_CLEAN) & ~F.contains(plain, F.lit("  ")), plain).otherwise(squeeze(v))


def line_key(line: Column, low: Column) -> Column:
    """entity_key of a line whose lower case is at hand: one that is clean needs its signs replaced alone."""
    return F.when(line.rlike(_CLEAN) & ~F.contains(line, F.lit("  ")), F.regexp_replace(low, rf"[^{WORD}]+", " ")).otherwise(entity_key(line))


def entity_key(value: Column) -> Column:
    """Comparison key: cleaned, signs as blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(clean_line(value), rf"[^{WORD}]+", " ")))


def city_name(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """Canonical city for an alias, else the cleaned text, null when empty."""
    pairs = F.create_map(*(F.lit(x) for pair in (aliases or CITY_ALIASES).items() for x in pair))
    return F.coalesce(F.element_at(pairs, entity_key(value)), blank_to_null(clean_line(value)))


def search_key(value: Column) -> Column:
    """Key for containment tests: lower case, ё as е, everything but letters and digits as one blank."""
    low = F.replace(F.lower(text_or_empty(value)), F.lit("ё"), F.lit("е"))
    return F.array_join(F.regexp_extract_all(low, F.lit("[0-9a-zа-я]+"), F.lit(0)), " ")  # several times as fast as a search for what is none


def unescape(value: Column) -> Column:
    """Named and numeric HTML entities as characters; numeric ones only within the basic plane's two-byte range."""
    v = value
    for name, char in ENTITIES.items():
        v = F.replace(v, F.lit(f"&{name};"), F.lit(char))
    return F.coalesce(numeric_entities(F.when(v.contains("&#"), v)), v)


@pandas_udf(T.StringType())
def numeric_entities(values: pd.Series) -> pd.Series:
    """Numeric character references, decimal and hexadecimal."""
    import html

    return values.map(html.unescape, na_action="ignore")


def fragment_text(value: Column) -> Column:
    """An HTML fragment's text: breaks as newlines, links as text and address, no tags."""
    v = F.regexp_replace(text_or_empty(value), r"(?i)<br\s*/?>|</p>|</div>", "\n")
    v = F.regexp_replace(v, r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "$2 $1")
    return F.trim(unescape(F.regexp_replace(v, r"<[^>]*>", "")))


def page_title(html: Column) -> Column:
    return blank_to_null(squeeze(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))))


def page_description(html: Column) -> Column:
    """The description or og:description of a page's head; null if neither is there."""
    meta = r"(?is)<meta\s+(?:name|property)=[\"'](?:og:)?description[\"']\s+content=[\"']([^\"']*)[\"']"
    return blank_to_null(squeeze(unescape(F.regexp_extract(html, meta, 1))))


def page_text(html: Column) -> Column:
    """A page's visible text in one line, without title, scripts, styles and drawings."""
    v = F.regexp_replace(text_or_empty(html), r"(?is)<(script|style|noscript|svg|title)\b.*?</\1>", " ")
    return squeeze(unescape(F.regexp_replace(F.regexp_replace(v, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")))


def preview(value: Column, limit: int) -> Column:
    """At most `limit` characters, with dots where the text was cut."""
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.rtrim(F.left(value, F.lit(limit))), F.lit("...")))


def is_antibot(url: Column, title: Column, text: Column) -> Column:
    """Whether a page is a robot check, by its address or its words."""
    seen = F.lower(F.concat_ws(" ", title, text))
    return F.lower(text_or_empty(url)).rlike("captcha|challenge") | seen.rlike("|".join(m.replace("?", r"\?") for m in ANTIBOT_MARKERS))


def charset(content_type: Column) -> Column:
    found = F.regexp_extract(F.lower(text_or_empty(content_type)), r"charset=[\"']?([a-z0-9_\-]+)", 1)
    return F.when(found != "", found).otherwise("utf-8")


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme, host and path of an absolute address, null where it has no scheme and host."""
    pattern = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#\s]*)"
    host = F.regexp_extract(url, pattern, 2)
    good = host != ""
    return F.when(good, F.lower(F.regexp_extract(url, pattern, 1))), F.when(good, F.lower(host)), F.when(good, F.regexp_extract(url, pattern, 3))


def url_key(url: Column) -> Column:
    """Address without query, fragment and closing slash; scheme and host in lower case."""
    scheme, host, path = url_parts(url)
    return F.coalesce(F.concat(scheme, F.lit("://"), host, F.regexp_replace(path, "/+$", "")), F.regexp_replace(F.trim(text_or_empty(url)), "/+$", ""))


def url_loose_key(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text_or_empty(url))), "/+$", "")


def url_domain(url: Column) -> Column:
    """Host in lower case without port and www."""
    _, host, _ = url_parts(F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url)))
    return F.regexp_replace(F.regexp_replace(host, ":[0-9]+$", ""), r"^www\.", "")


def readable_url(url: Column) -> Column:
    """The address to read, https where none is given; null for other schemes and for no host."""
    v = F.trim(text_or_empty(url))
    full = F.when(v.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*://"), v).when(v != "", F.concat(F.lit("https://"), v))
    scheme, host, _ = url_parts(full)
    return F.when(scheme.isin("http", "https") & host.contains("."), full)


def allowed_urls(value: Column, allowed: tuple[str, ...], denied: tuple[str, ...] = ()) -> Column:
    """The addresses in a search answer, each once in order, whose domain is an allowed one or lies below it and is not denied.

    Closing signs are cut off; addresses that end in a slash or in dots name no page.
    """
    found = F.transform(F.regexp_extract_all(text_or_empty(value), F.lit("https?://[^\\s<>)\"']+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?*\]})]+$", ""))
    below = lambda u, names: F.coalesce(url_domain(u).rlike(r"(?:^|\.)(?:" + "|".join(n.replace(".", r"\.") for n in names) + ")$"), F.lit(False)) if names else F.lit(False)
    return F.array_distinct(F.filter(found, lambda u: ~F.endswith(u, F.lit("/")) & below(u, allowed) & ~below(u, denied)))


def script(value: Column) -> Column:
    """numeric, cyrillic, latin, mixed or unknown."""
    v = text_or_empty(value)
    cyrillic, latin, digit = v.rlike("[А-Яа-яЁё]"), v.rlike("[A-Za-z]"), v.rlike("[0-9]")
    return F.when(cyrillic & latin, "mixed").when(cyrillic, "cyrillic").when(latin, "latin").when(digit, "numeric").otherwise("unknown")


def lookalike_key(value: Column) -> Column:
    """Lower case with Cyrillic letters and digits as the Latin letters they look like."""
    return F.translate(F.lower(text_or_empty(value)), "".join(LOOKALIKES), "".join(LOOKALIKES.values()))


def ocr_text(value: Column) -> Column:
    """Recognised text without carriage returns, wide gaps and stray signs."""
    v = F.regexp_replace(F.replace(text_or_empty(value), F.lit("\r"), F.lit("")), r"\s{2,}", " ")
    return F.trim(F.regexp_replace(v, rf"[^{WORD}\s.:+\-]", ""))


def without_urls(value: Column) -> Column:
    return squeeze(F.regexp_replace(text_or_empty(value), r"(?i)(?:https?://|www\.|t\.me/|vk\.com/)[^\s<>()]+", " "))


def with_note(value: Column, note: Column) -> Column:
    """The explanation with a note appended once."""
    v = text_or_empty(value)
    return F.when(v.contains(note), v).otherwise(F.concat_ws(" ", blank_to_null(v), note))


def balanced_object(value: Column) -> Column:
    """The first JSON object in free text, null if there is none; only texts with nested or several braces leave the JVM."""
    greedy = F.regexp_extract(text_or_empty(value), r"(?s)\{.*\}", 0)
    flat = greedy.rlike(r"(?s)^\{[^{}]*\}$") & F.try_parse_json(greedy).isNotNull()
    return F.coalesce(F.when(flat, greedy), first_object(F.when(~flat & F.contains(value, F.lit("{")), value)))


@pandas_udf(T.StringType())
def first_object(values: pd.Series) -> pd.Series:
    """The first balanced {...} outside of strings, for the texts whose widest braces are no JSON."""

    def cut(text: str | None) -> str | None:
        depth, start, quoted, escaped = 0, -1, False, False
        for at, c in enumerate(text or ""):
            if start < 0:
                if c == "{":
                    start, depth = at, 1
            elif quoted:
                quoted, escaped = escaped or c != '"', c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[start : at + 1]
        return None

    return values.map(cut)


@pandas_udf(T.ArrayType(T.StringType()))
def chunks(values: pd.Series, limits: pd.Series) -> pd.Series:
    """Pieces of at most limit characters, cut at a newline, a sentence, a comma or a blank past the half, else hard."""

    def cut(text: str | None, limit: int) -> list[str]:
        rest, out = (text or "").strip(), []
        while len(rest) > limit:
            end = next((at + len(mark.rstrip()) for mark in ("\n", ". ", ", ", " ") if (at := rest.rfind(mark, 0, limit)) > limit // 2), limit)
            out.append(rest[:end].strip())
            rest = rest[end:].strip()
        return out + [rest] if rest else out

    return pd.Series([cut(v, int(n)) for v, n in zip(values, limits, strict=True)])
