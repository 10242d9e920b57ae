"""Column functions: cleaning, identifiers, dates, references, URLs, HTML, anchors."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import name_words, normalize_space

# Texts that stand for no value.
NO_VALUE = ("", "...", "nan", "NaN", "None")


def clean_scalar(value: Column) -> Column:
    """Non-breaking spaces as spaces, inline white space collapsed, placeholders as null."""
    tidy = F.trim(F.regexp_replace(F.translate(value, " ", " "), r"[ \t\r\f\x0B]+", " "))
    return F.when(~tidy.isin(*NO_VALUE), tidy)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.when(F.trim(v) != "", F.trim(v)) for v in values])


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", F.trim(value))


def identifier(value: Column, upper: bool = True) -> Column:
    """Identifiers without white space and without punctuation at their ends, in one case."""
    bare = F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", ""), r"^[.,;:)]+|[.,;:)]+$", "")
    return F.upper(bare) if upper else F.lower(bare)


def lines_text(value: Column) -> Column:
    """Each line with its inline white space collapsed and trimmed, blank lines left out."""
    lines = F.transform(F.split(value, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


# ---------------------------------------------------------------- dates


def strict_day(value: Column) -> Column:
    """dd/MM/yyyy only, as a date; anything else, also days that don't exist, is null."""
    return F.when(value.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(value, "dd/MM/yyyy"))


def any_day(value: Column) -> Column:
    """ISO dates, dd/MM/yyyy or days since 1970 as a date."""
    v = F.trim(value)
    return F.coalesce(
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd")),
        strict_day(v),
        F.when(v.rlike(r"^\d{1,6}$"), F.date_from_unix_date(v.cast("int"))),
    )


def day_in_text(value: Column) -> Column:
    """The first d/m/yyyy or d-m-yyyy in a text, as a date."""
    found = F.regexp_extract(value, r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})", 1)
    return F.when(found != "", F.try_to_date(F.translate(found, "-", "/"), "d/M/yyyy"))


def event_time(value: Column) -> Column:
    """ISO text or seconds since 1970 as a timestamp."""
    return F.coalesce(F.when(value.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(value.cast("double"))), F.try_to_timestamp(value))


def safe_int(value: Column) -> Column:
    return F.trim(value).try_cast("int")


# ---------------------------------------------------------------- references in legal text

# Patterns of document numbers and of references to articles, clauses and points.
NUMBER = r"(?iU)\b(\d{1,4}/\d{4}/[A-ZĐÂÊÔƠƯ0-9.-]+(?:-[A-ZĐÂÊÔƠƯ0-9.-]+)*)\b"
ARTICLE = r"(?iU)\bđiều\s+(\d+[a-zA-Z]?)\b"
CLAUSE = r"(?iU)\bkhoản\s+(\d+[a-zA-Z]?)\b"
POINT = r"(?iU)\bđiểm\s+([a-zđ])\b"
REFERENCES = {"number": NUMBER, "article": ARTICLE, "clause": CLAUSE, "point": POINT}


def references(text: Column, kind: str) -> Column:
    """Distinct references of one kind in the order they are first named."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REFERENCES[kind]), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: identifier(x) if kind == "number" else F.lower(x)))


# What a named number, article, clause or point is worth.
BOOSTS = {"number": 3.0, "number in text": 1.5, "article": 2.5, "clause": 1.5, "point": 1.0}


def reference_boost(query: Column, number: Column, text: Column, *others: Column) -> Column:
    """What the query names of a document: its number, the number in its texts, and article, clause or point in them (``text`` and the ``others``, as the title or path); each counts once."""
    low = F.lower(F.concat_ws("\n", text, *others, number))
    numbers = references(query, "number")
    total = F.when(F.exists(numbers, lambda n: n == identifier(F.coalesce(number, F.lit("")))), BOOSTS["number"]).otherwise(0.0)
    total += F.when(F.exists(numbers, lambda n: F.contains(low, F.lower(n))), BOOSTS["number in text"]).otherwise(0.0)

    def named(word: str):
        return lambda n: F.contains(low, F.concat(F.lit(word), n))

    for kind, word in (("article", "điều "), ("clause", "khoản "), ("point", "điểm ")):
        total += F.when(F.exists(references(query, kind), named(word)), BOOSTS[kind]).otherwise(0.0)
    return total


def bracket_references(text: Column) -> Column:
    """Numbers of [n] in a text."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))


# ---------------------------------------------------------------- HTML and URLs


def html_text(source: Column) -> Column:
    """Visible text of HTML: scripts and styles dropped, block tags as line ends, entities decoded, blank lines dropped."""
    t = F.regexp_replace(F.coalesce(source, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<\s*/?(?:br|p|div|tr|td|th|li|h[1-6]|table|tbody|thead|section|article)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return lines_text(F.translate(unescaped(t), "\u00a0", " "))


def html_escaped(text: Column) -> Column:
    out = text
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def paragraphs_html(text: Column) -> Column:
    """Each line of a text as an HTML paragraph."""
    return F.array_join(F.transform(F.split(lines_text(text), "\n"), lambda x: F.concat(F.lit("<p>"), html_escaped(x), F.lit("</p>"))), "")


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def safe_url(url: Column) -> Column:
    """True for http(s) URLs with a host."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.length(url_host(url)) > 0), F.lit(False))


def external_id(url: Column) -> Column:
    """The document id in a URL: ItemID, docid or document_id, or the number after two dashes at the end."""
    first = F.regexp_extract(url, r"(?i)[?&](?:itemid|docid|document_id)=(\d+)", 1)
    last = F.regexp_extract(url, r"--(\d+)(?:$|[/?#])", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))


def anchor(prefix: str, value: Column, occurrence: Column) -> Column:
    """Stable anchor of a unit: prefix-value, with .occurrence-n from the second on."""
    return F.concat(F.lit(f"{prefix}-"), F.lower(value), F.when(occurrence > 1, F.concat(F.lit(".occurrence-"), occurrence.cast("string"))).otherwise(""))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


# ---------------------------------------------------------------- rules as data


def by_rules(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The label of the first rule one of whose words stands in the text (lower case)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for label, words in rules:
        cond = None
        for w in words:
            c = F.contains(low, F.lit(w))
            cond = c if cond is None else cond | c
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def code_of(label: Column, codes: dict[str, str], default: str) -> Column:
    """The code of a label, spaces and case aside."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(normalize_space(label))), F.lit(default))


# Last lines that promise more, and the heading of what follows an answer.
OPEN_LINES = ("và", "hoặc", "cũng có thể", "câu trả lời cũng có thể")
SELF_CHECK = r"(?imU)^\s*(?:\*\*)?\s*Tự kiểm tra\s*(?:\*\*)?\s*:"


def looks_complete(answer: Column) -> Column:
    """True if an answer of 20 signs or more ends like a sentence, a quotation or a source, and neither in dots nor in a word that promises more."""
    t = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)^\s+|\s+$", "")
    last_line = F.lower(F.trim(F.element_at(F.split(t, r"\n"), -1)))
    return (F.length(t) >= 20) & ~t.rlike(r"(?:\.\.\.|[…,;:—-])$") & ~last_line.isin(*OPEN_LINES) & t.rlike(r"[.!?。！？)\]}”\"']$")


def without_self_check(answer: Column) -> Column:
    """An answer without the part that begins with the heading of a self-check."""
    return F.rtrim(F.element_at(F.split(answer, SELF_CHECK, 2), 1))


# ---------------------------------------------------------------- records


@F.pandas_udf(T.StringType())
def _unescaped(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """All named and numbered entities of HTML as their signs; texts without "&" stay in the JVM's hands."""
    return F.when(F.contains(text, F.lit("&")), _unescaped(text)).otherwise(text)


def citation_text(value: Column) -> Column:
    """A cited phrase without entities, with single spaces and without punctuation at its ends; null gives an empty text."""
    return F.regexp_replace(normalize_space(unescaped(F.coalesce(value, F.lit("")))), r"^[ ,.;:]+|[ ,.;:]+$", "")


# Fixed value: where an answer begins: a body that "answers".
ANSWER_MARKER = r"(?iU)\b(?:Bộ|Sở|Cục|Tổng cục|Ủy ban nhân dân|BHXH|Bảo hiểm xã hội)[^.\n]{0,120}trả lời"


def question_and_answer(page: Column, marker: str = ANSWER_MARKER) -> tuple[Column, Column]:
    """A page cut where the marker first stands: what is before it (all, if there is none) and the rest."""
    tidy = lambda c: F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))
    first = F.regexp_instr(page, F.lit(marker))
    return tidy(F.when(first > 0, F.substr(page, F.lit(1), first - 1)).otherwise(page)), tidy(F.when(first > 0, F.substr(page, first)))


def token_share(wanted: Column, found: Column) -> Column:
    """Share of the different words of one text that stand in the other; 0 where either has none."""
    words = lambda c: F.array_distinct(F.array_compact(F.transform(F.split(name_words(F.coalesce(c, F.lit(""))), " "), lambda w: F.when(w != "", w))))
    a, b = words(wanted), words(found)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def context_header(fields: dict[str, Column]) -> Column:
    """One line "label: value" for each field that is neither null nor empty."""
    return F.concat_ws("\n", *[F.when(v.cast("string") != "", F.concat(F.lit(f"{label}: "), v.cast("string"))) for label, v in fields.items()])


def url_slug(url: Column) -> Column:
    """The last part of a URL's path without its number; null where there is none."""
    path = F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), r"/+$", "")
    return F.nullif(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"--\d+.*$", ""), F.lit(""))


def allowed_host(url: Column, domains: list[str]) -> Column:
    """True for safe URLs of a domain in the list or below it."""
    host, ok = url_host(url), F.lit(False)
    for d in domains:
        ok = ok | (host == d) | F.endswith(host, F.lit(f".{d}"))
    return F.coalesce(safe_url(url) & ok, F.lit(False))


def number_suffix(identifier_: Column) -> Column:
    """The number after the last colon of an id; null, so last in order, where there is none."""
    return F.regexp_extract(identifier_, r":(\d+)$", 1).try_cast("int")


# Fixed value: the name space of URLs for ids made from names.
URL_NAMES = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(name: Column) -> Column:
    """The version-5 UUID of a name in the name space of URLs: the same for the same name, whoever makes it."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMES)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), 1, 16)
    nibble = F.substr(variant, F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def names_unit(text: Column, own: Column, kind: str, number: Column) -> Column:
    """True if a chunk is or names a unit: its own number, the word with the number, or loosely "2." for clauses and "a)" for points."""
    word, sign = {"article": ("điều ", None), "clause": ("khoản ", "."), "point": ("điểm ", ")")}[kind]
    low, n = F.lower(F.coalesce(text, F.lit(""))), F.lower(number)
    found = F.coalesce(F.lower(own) == n, F.lit(False)) | F.contains(low, F.concat(F.lit(word), n))
    return found | F.contains(low, F.concat(n, F.lit(sign))) if sign else found
