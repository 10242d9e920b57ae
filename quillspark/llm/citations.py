"""Problem 5: matching entities across sources without keys.

A cascade of exact joins on ever weaker combinations of attributes.  Each rule
sees only what the rules before it left, and its confidence is the share of
right matches among labelled records, smoothed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .unify import LOOK_ALIKES, plain_signs

_MAP = str.maketrans(LOOK_ALIKES)

# Kinds of document and their abbreviations, bodies and theirs, without accents.
KINDS = {"nghi quyet": "NQ", "quyet dinh": "QD", "chi thi": "CT", "thong tu": "TT", "nghi dinh": "ND", "phap lenh": "PL", "bo luat": "L", "luat": "L"}
BODIES = ((r"\bubnd\b", "uy ban nhan dan"), (r"\bhdnd\b", "hoi dong nhan dan"), (r"\bttg\b", "thu tuong chinh phu"))

_NUMBER = re.compile(r"(?<![\d/])(\d{1,5})\s*/\s*(?:(\d{4})(?!\d)\s*/?\s*)?([a-z][a-z0-9]*(?:\s*-\s*[a-z0-9]+)*)?", re.I)
_CITED = re.compile(r"(?<![\d/-])(\d{1,5}\s*/\s*(?:\d{4}\s*/\s*)?[a-z]{1,4}\d{0,2}\s*(?:-\s*)?[a-z0-9]*(?:-[a-z0-9]+)*|\d{1,5}\s*/\s*\d{4}(?=\s))")
_DATE = re.compile(r"ngay\s*(\d{1,2})(?:\s*[/.-]\s*|\s+thang\s+)(\d{1,2})(?:\s*[/.-]\s*|\s+nam\s+)(\d{4})")
_YEAR = re.compile(r"\bnam\s+((?:19|20)\d{2})\b")
_BODY = re.compile(r"\b((?:uy ban nhan dan|hoi dong nhan dan)(?: (?:tinh|thanh pho|huyen|quan))?|bo|chinh phu|quoc hoi|thu tuong chinh phu|uy ban thuong vu quoc hoi|chu tich nuoc)\b")
_BODY_END = re.compile(r"[,(;:–—]|\s-\s|\b(?:ve|nam(?= \d)|ngay|ban hanh|quy dinh|phe duyet|sua doi|huong dan|v/v|bai bo|dieu chinh)\b|$")
_NUMBER_IN_TEXT = re.compile(r"\d{1,5}\s*/\s*\d{4}(?:\s*/\s*[a-z]+\d*(?:\s*-\s*[a-z0-9]+)*)?|\d{1,5}\s*/\s*[a-z]+\d*(?:\s*-\s*[a-z0-9]+)*")


def bare(text: str | None) -> str:
    """Plain signs, Latin letters, no accents, lower case, single spaces."""
    if not text:
        return ""
    loose = unicodedata.normalize("NFD", plain_signs(text).translate(_MAP))
    out = "".join(c for c in loose if not unicodedata.combining(c)).lower().replace("đ", "d")
    return " ".join(out.split())


def number_parts(number: str | None) -> tuple[int | None, int | None, str | None]:
    """Serial, year and code of a document number; missing parts are None."""
    m = _NUMBER.match(re.sub(r"^\D+", "", bare(number)))
    if not m:
        return None, None, None
    code = re.sub(r"[^a-z0-9]", "", m[3] or "") or None
    return int(m[1]), int(m[2]) if m[2] else None, code


def body_name(text: str | None) -> str | None:
    """The issuing body as it is written in full, without accents."""
    t = bare(text)
    for short, full in BODIES:
        t = re.sub(short, full, t)
    return re.sub(r"[^a-z0-9 ]+", " ", t).strip() or None


def kind_code(text: str | None) -> str | None:
    t = bare(text)
    return next((code for name, code in KINDS.items() if t.startswith(name)), None)


_STOP = {"so", "va", "cua", "ve", "viec", "cac", "tai", "cho", "o"}


def title_words(title: str | None) -> list[str]:
    """Distinct words of a title in order, without its kind and small words."""
    t = bare(title)
    for name in KINDS:
        if t.startswith(name + " ") and name != "luat":
            t = t[len(name) :]
            break
    return [w for w in dict.fromkeys(re.findall(r"[a-z0-9]+", t)) if w not in _STOP]


def parse_document(number: str | None, title: str | None, body: str | None, day, kind: str | None) -> tuple:
    serial, year, code = number_parts(number)
    code_kind = (code or "")[:2].upper()
    kind = kind_code(kind) or (code_kind if code_kind in KINDS.values() else "L" if (code or "").startswith("qh") else None)
    at = day.isoformat() if day is not None and day == day else None
    return serial, year or (day.year if at else None), code, body_name(body), at, kind, title_words(title)


def parse_citation(raw: str | None, number: str | None, title: str | None) -> tuple:
    t = bare(raw)
    serial, year, code = number_parts(number)
    if serial is None and (m := _CITED.search(re.sub(r"ngay\s*\d{1,2}\s*[/-]\s*\d{1,2}\s*[/-]\s*\d{4}", " ", t))):
        serial, year, code = number_parts(m[1])
    day = None
    if m := _DATE.search(t):
        d, mo, y = int(m[1]), int(m[2]), int(m[3])
        day = f"{y:04d}-{mo:02d}-{d:02d}" if 1 <= mo <= 12 and 1 <= d <= 31 else None
        year = year or y
    if year is None and (m := _YEAR.search(t)):
        year = int(m[1])
    found = [(m.start(), code_) for name, code_ in KINDS.items() for m in [re.search(rf"\b{name}\b", t)] if m]
    short = re.search(r"\b(qd|tt|nq|ct|nd)\b\s*(?:so\s*)?\d", t)
    kind = min(found)[1] if found else short[1].upper() if short else None
    if code and code[:2].upper() in KINDS.values():
        kind = code[:2].upper()
    # the number, which may hold short names of bodies, must not be read as one
    day_free = re.sub(r"\d{1,2}\s*[/-]\s*\d{1,2}\s*[/-]\s*\d{4}", " ", t)
    t = _NUMBER_IN_TEXT.sub(" ", day_free)
    for short, full in BODIES:
        t = re.sub(rf"(?<![-/]){short}", full, t)
    body, rest = None, t
    if m := _BODY.search(t):
        end = _BODY_END.search(t, m.end())
        body = re.sub(r"[^a-z0-9 ]+", " ", t[m.start() : end.start()]).strip()
        rest = t[end.start() :]
    elif m := re.search(r"\b(?:ve|v/v)\b", t):
        rest = t[m.start() :]
    rest = re.sub(r",?\s*ban hanh ngay .*$|\bngay\s*\d.*?\d{4}|\bnam\s+\d{4}\b(?=\s*\()", " ", rest)
    a, b = title_words(re.sub(r"^[\s,(:–—-]*(?:nam \d{4}\s*)?[\s,(:–—-]*(?:ve\b)?", "", rest)), title_words(title)
    if len(a) < 4:
        a = []
    if len(b) < 4:
        b = []
    return serial, year, code, body, day, kind, max(a, b, key=len)


def _parsed(rows: DataFrame, fn, columns: list[str]) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("serial", T.IntegerType()),
            T.StructField("year", T.IntegerType()),
            T.StructField("code", T.StringType()),
            T.StructField("body", T.StringType()),
            T.StructField("day", T.StringType()),
            T.StructField("kind", T.StringType()),
            T.StructField("words", T.ArrayType(T.StringType())),
        ]
    )

    @F.pandas_udf(schema)
    def parse(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            out = pd.DataFrame([fn(*v) for v in zip(*cols)], columns=schema.names)
            for c in ("serial", "year"):
                out[c] = out[c].astype("Int32")
            yield out

    return rows.withColumn("_p", parse(*columns)).select("*", "_p.*").drop("_p")


@dataclass(frozen=True)
class Rule:
    """One pass: records agree exactly on ``on``; titles share at least ``title`` of the citation's words.

    ``blocked`` passes also join on two of the citation's rarest title words.
    Of n words so many are used that a title with the needed share, which is at
    least half of four words or more, must hold two of them, so that nothing is
    lost.  Other passes take a citation without
    title too; if ``lone``, only one that fits a single document.
    """

    name: str
    on: tuple[str, ...]
    title: float
    blocked: bool = False
    lone: bool = False
    numbers: str = "any"


RULES = (
    Rule("number, body, title", ("serial", "year", "code", "body"), 0.5),
    Rule("title, body, day", ("body", "day"), 0.75, blocked=True),
    Rule("title, body, year", ("body", "year"), 0.8, blocked=True),
    Rule("serial, body, kind", ("serial", "year", "body", "kind"), 0.5, numbers="no code"),
    Rule("number, title", ("serial", "year", "code"), 0.5, lone=True, numbers="no body"),
    Rule("title, kind, year", ("kind", "year"), 0.9, blocked=True, numbers="no body"),
    Rule("body, kind, day", ("body", "kind", "day"), 0.5, lone=True, numbers="one open"),
)


def _prefix(cites: DataFrame, docs: DataFrame, share: float) -> DataFrame:
    """``cid, word``: of each title with n words the n - ceil(share n) + 2 that the fewest document titles hold."""
    held = docs.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("_held"))
    words = cites.select("cid", F.size("words").alias("_n"), F.explode("words").alias("word")).join(held, "word", "left")
    rank = F.row_number().over(Window.partitionBy("cid").orderBy(F.coalesce("_held", F.lit(0)), "word"))  # the words of one title
    needed = F.ceil(F.lit(share) * F.col("_n") - 1e-9)
    return words.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_n") - needed + 2).select("cid", "word")


def _word_pairs(rows: DataFrame, key: str, on: list[str]) -> DataFrame:
    """``<key>, <on>, word, word_2``: every two words of one record, in the order of the alphabet."""
    second = rows.select(F.col(key).alias("_of"), F.col("word").alias("word_2"))
    return rows.join(second, (F.col(key) == F.col("_of")) & (F.col("word") < F.col("word_2"))).select(key, *on, "word", "word_2")


def _applied(rule: Rule, cites: DataFrame, docs: DataFrame) -> DataFrame:
    """The best document of each citation by this rule: ``cid, did, rule``."""
    full = lambda df: [df[c].isNotNull() for c in rule.on]
    left, right = cites, docs
    for c in full(cites):
        left = left.where(c)
    for c in full(docs):
        right = right.where(c)
    if rule.numbers == "no code":  # the code is what differs or is missing
        left = left.where("serial is not null")
    right_all = right.select("did", *(F.col(c).alias(f"d_{c}") for c in ("serial", "code", "body", "day", "words")))
    on = list(rule.on)
    if rule.blocked:
        # the wide columns join the few pairs that share two rare words, not the rows for each word
        titled = left.where(F.size("words") >= 4)
        asked = titled.select("cid", *on).join(_prefix(titled, docs, rule.title), "cid")
        # words that nobody asks for in a block are left out before pairs are made
        held = right.select("did", *on, F.explode("words").alias("word")).join(asked.select(*on, "word").distinct(), [*on, "word"], "left_semi")
        met = _word_pairs(asked, "cid", on).join(_word_pairs(held, "did", on), [*on, "word", "word_2"])
        pairs = met.select("cid", "did").distinct().join(titled, "cid").join(right_all, "did")
    else:
        pairs = left.join(right.select("did", *on), on).join(right_all, "did")
    shared = F.size(F.array_intersect("words", "d_words")) / F.size("words")
    score = F.when(F.size("words") >= 4, shared)
    met = pairs.withColumn("_score", score).where((F.col("_score") >= rule.title) | (F.col("_score").isNull() & F.lit(not rule.blocked)))
    if rule.numbers == "no code":
        met = met.where("code is null or d_code is null or code = d_code or (length(code) > 2 and length(d_code) > 2 and left(code, 2) = left(d_code, 2) and (contains(code, substr(d_code, 3)) or contains(d_code, substr(code, 3))))")
    elif rule.numbers == "no body":
        met = met.where("body is null or d_body is null")
    elif rule.numbers == "one open":
        met = met.where("serial is null or d_serial is null")
    same = lambda a: F.coalesce((F.col(a) == F.col(f"d_{a}")).cast("int"), F.lit(0)) if a not in rule.on else F.lit(1)
    order = F.struct(-F.coalesce("_score", F.lit(0.0)), -same("day"), -same("serial"), F.size("d_words"), F.col("did"))
    best = met.groupBy("cid").agg(F.min(order).alias("_b"), F.min("did").alias("_one"), F.max("did").alias("_other"), F.max(F.size("words")).alias("_n"))
    if rule.lone:
        best = best.where("_n >= 4 or _one = _other")
    return best.select("cid", F.col("_b.did").alias("did"), F.lit(rule.name).alias("rule"))


def match_citations(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """``citation_id, document_id, rule, confidence`` for each unlabelled citation that names a known document.

    ``citations`` has ``citation_id, raw_text, document_number, document_title,
    matched_document_id``; rows with a matched id are the labels.  ``documents``
    has ``id, document_number, title, issuing_authority, issued_date,
    document_type, updated_at``; of repeated ids the latest row counts.
    Repeated citations count once (a labelled row before an unlabelled one).
    Null attributes never join.  Rows with a null id are left out.  Of copies
    of one document that fit equally well the one with the smallest id is
    taken.  Without labels every rule has the confidence 1/2; empty tables give
    an empty result.  Other columns are not read.
    """
    told = F.struct(F.col("matched_document_id").isNull().alias("open"), "matched_document_id", "raw_text", "document_number", "document_title")
    once = citations.where("citation_id is not null").groupBy(F.col("citation_id").alias("cid")).agg(F.min(told).alias("r")).select("cid", "r.*")
    same = ["serial", "year", "code", "body", "day", "kind", "words"]
    alike = F.sha2(F.to_json(F.struct(*same)), 256).alias("_alike")
    cites = cut(_parsed(once, parse_citation, ["raw_text", "document_number", "document_title"]).select("cid", F.col("matched_document_id").alias("label"), alike, *same))
    attributes = F.struct("document_number", "title", "issuing_authority", "issued_date", "document_type")
    latest = documents.where("id is not null").groupBy(F.col("id").alias("did")).agg(F.max_by(attributes, F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp")), F.coalesce("title", F.lit("")))).alias("r")).select("did", "r.*")
    docs = cut(_parsed(latest, parse_document, ["document_number", "title", "issuing_authority", "issued_date", "document_type"]).groupBy(*same).agg(F.min("did").alias("did")).select("did", *same))
    # of records alike in all attributes one is matched, so that many copies don't make many pairs
    found = []
    # labelled records alike in all attributes count as often as they stand there
    rest = cut(cites.groupBy("_alike").agg(F.min(F.struct("cid", *same)).alias("r")).select("_alike", "r.*"))
    for rule in RULES:
        # labelled records go as the others do: each rule is measured on what the rules before it left
        hits = cut(_applied(rule, rest, docs))
        found.append(hits)
        rest = cut(rest.join(hits.select("cid"), "cid", "left_anti"))  # else each plan holds those of all passes before
    hits = found[0]
    for x in found[1:]:
        hits = hits.unionByName(x)
    judged = cut(cites.select("cid", "label", "_alike").join(hits.join(cites.select("cid", "_alike"), "cid").drop("cid"), "_alike"))
    # as many rows as there are rules
    worth = judged.groupBy("rule").agg(((F.count(F.when(F.col("label") == F.col("did"), 1)) + 1) / (F.count("label") + 2)).alias("confidence"))
    return judged.where("label is null").join(F.broadcast(worth), "rule").select(F.col("cid").alias("citation_id"), F.col("did").alias("document_id"), "rule", "confidence")
