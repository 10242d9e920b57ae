"""Taking citations out of texts and verifying those of answers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ARTICLE, CLAUSE, NUMBER, POINT, bracket_references, references

_NUMBERED = re.compile(r"\b\d{1,4}/\d{4}/[A-ZĐÂÊÔƠƯ0-9.-]+(?:-[A-ZĐÂÊÔƠƯ0-9.-]+)*\b", re.I)
_NEAR = {name: re.compile(p.replace("(?iU)", ""), re.I) for name, p in (("articles", ARTICLE), ("clauses", CLAUSE), ("points", POINT))}


def citations_in(text: str, before: int = 120, after: int = 80) -> list[tuple]:
    """Numbered citations in order, each number once: number, begin, end and the references named near it."""
    seen: dict[str, list] = {}
    for m in _NUMBERED.finditer(text):
        number = m[0].rstrip(".,;:)").upper()
        near = text[max(0, m.start() - before) : m.end() + after]
        refs = [list(dict.fromkeys(x.lower() for x in p.findall(near))) for p in _NEAR.values()]
        if number in seen:
            for old, new in zip(seen[number][3:], refs):
                old += [x for x in new if x not in old]
        else:
            seen[number] = [number, m.start(), m.end(), *refs]
    return [tuple(x) for x in seen.values()]


def extract_citations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, number, begin_char, end_char, articles, clauses, points`` (lists as texts joined by ", ")."""
    rows = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col(text).rlike(NUMBER))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, n, a, e, *(", ".join(x) for x in refs)) for k, t in zip(b["_key"], b["_text"]) for n, a, e, *refs in citations_in(t)]
            yield pd.DataFrame(out, columns=["_key", "number", "begin_char", "end_char", "articles", "clauses", "points"])

    return rows.mapInPandas(run, f"_key {kind}, number string, begin_char long, end_char long, articles string, clauses string, points string").withColumnRenamed("_key", key)


def answer_errors(answer: Column, sources: Column) -> Column:
    """Errors of an answer against the texts of its sources (an array): bracket numbers out of range, and numbers, articles, clauses and points no source holds."""
    held = F.array_join(F.transform(sources, lambda s: F.coalesce(s, F.lit(""))), "\n")
    out_of_range = F.transform(F.filter(bracket_references(answer), lambda n: (n < 1) | (n > F.size(sources))), lambda n: F.concat(F.lit("source:"), n.cast("string")))

    def tagged(kind: str):
        return lambda x: F.concat(F.lit(f"{kind}:"), x)

    invented = []
    for kind in ("number", "article", "clause", "point"):
        extra = F.array_except(references(answer, kind), references(held, kind))
        known = F.size(references(held, kind)) > 0 if kind in ("clause", "point") else F.lit(True)
        invented.append(F.when(known, F.transform(extra, tagged(kind))).otherwise(F.array().cast("array<string>")))
    return F.concat(out_of_range, *invented)


# Names of documents, words of a legal claim, phrases that own to a lack of sources, and beginnings of names that are none.
_NAME = re.compile(r"\b((?:Bộ\s+luật|Luật|Nghị\s+định|Thông\s+tư|Nghị\s+quyết|Quyết\s+định|Pháp\s+lệnh)(?:\s+số)?\s+[^\n\[\].,;:()]{2,120})", re.I)
_CLAIM = re.compile(r"\b(?:theo|quy định|phải|được|không được|có quyền|nghĩa vụ|trách nhiệm|điều kiện|hồ sơ|thời hạn|xử phạt|thuế|hợp đồng|người lao động|người sử dụng lao động|bảo hiểm xã hội|chuyển nhượng|miễn thuế|bồi thường|lệ phí|đăng ký|cấp giấy phép)\b", re.I)
_INSUFFICIENT = re.compile(r"chưa đủ|không đủ căn cứ|không thể xác minh|không tìm thấy|thiếu căn cứ", re.I)
_NO_NAME = ("ap dung", "hien hanh", "quy dinh", "lien quan", "nay", "nao", "truc tiep", "kiem soat", "nen tang", "cho", "ve")
_KINDS = {"bo luat", "luat", "nghi dinh", "thong tu", "nghi quyet", "quyet dinh", "phap lenh"}
_NAME_ENDS = re.compile(r"\s+(?:theo|cho|về|để|khi|nếu|nhưng|và|hoặc|thì|tại|trong)\s+", re.I)
_BRACKET = re.compile(r"\[(\d{1,3})\]")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s*)?(?:\d+\.\s*[^.!?]{1,80}|[A-ZĐÂÊÔƠƯa-zà-ỹ\s]{1,60}:?\s*)$")


def _name_words(text: str) -> str:
    bare = "".join(x for x in unicodedata.normalize("NFD", text) if unicodedata.category(x) != "Mn").replace("đ", "d").replace("Đ", "D")
    return " ".join(re.sub(r"[^0-9a-zA-Z]+", " ", bare).lower().split())


def _numbers(text: str) -> list[str]:
    return [re.sub(r"\s+", "", x).strip(".,;:)").upper() for x in _NUMBERED.findall(text)]


def _names(text: str) -> list[str]:
    """Names of documents that say which one is meant."""
    out = []
    for raw in _NAME.findall(text):
        name = _NAME_ENDS.split(raw.strip(), maxsplit=1)[0].strip(" \t\r\n.,;:()")
        words = _name_words(_NUMBERED.sub("", name)).split()
        body = " ".join(words[2 if words[:2] == ["bo", "luat"] else 1 :])
        if len(words) < 2 or body.startswith(_NO_NAME):
            continue
        most = 8 if " ".join(words).startswith(("bo luat", "luat", "nghi dinh")) else 10
        if _NUMBERED.search(name) or re.search(r"\b(?:19|20)\d{2}\b", name) or 3 <= len(words) <= most:
            out.append(name)
    return out


def _aliases(title: str | None, kind: str | None, number: str | None) -> set[str]:
    texts = [re.sub(r"\bso$", "", _name_words(_NUMBERED.sub("", x))).strip() for x in (title, kind) if x]
    if title and number:
        texts.append(_name_words(_NUMBERED.sub("", title.replace(number, ""))))
    return {x for x in texts if len(x.split()) > 1 and x not in _KINDS}


def uncited_claims(answer: str, most: int = 180) -> list[str]:
    """Sentences that make a legal claim without a bracket number; headings and sentences that own to a lack of sources make none."""
    out = []
    for line in map(str.strip, answer.splitlines()):
        if not line or _HEADING.match(line):
            continue
        for part in map(str.strip, re.split(r"(?<=[.!?])\s+|(?<=\])\s+", line)):
            if part and not _BRACKET.search(part) and not _INSUFFICIENT.search(part) and any(p.search(part) for p in (_CLAIM, _NEAR["articles"], _NUMBERED, _NAME)):
                short = " ".join(part.split())
                out.append(short if len(short) <= most else short[: most - 1].rstrip() + "…")
    return out


def errors_of(answer: str, n: int, sources: list[tuple], held: dict[str, set[str]]) -> list[str]:
    """Errors of one answer with ``n`` sources, of which (title, kind, number) and the articles, clauses and points they hold are given."""
    numbers = {re.sub(r"\s+", "", x[2]).strip(".,;:)").upper() for x in sources if x[2]}
    aliases = set().union(*(_aliases(*x) for x in sources))
    out = [f"source:{i}" for i in map(int, _BRACKET.findall(answer)) if not 1 <= i <= n]
    out += [f"number:{x}" for x in _numbers(answer) if x not in numbers]
    for name in _names(answer):
        own, words = _numbers(name), _name_words(_NUMBERED.sub("", name))
        if not (own and numbers.issuperset(own)) and not any(a in words or words in a for a in aliases):
            out.append(f"name:{name}")
    for kind, pattern in _NEAR.items():
        if held[kind] or kind == "articles":
            out += [f"{kind[:-1]}:{x}" for x in map(str.lower, pattern.findall(answer)) if x not in held[kind]]
    return list(dict.fromkeys(out + [f"claim:{x}" for x in uncited_claims(answer)]))


def verify_answers(answers: DataFrame, cited: DataFrame, documents: DataFrame, key: str, answer: str, document: str) -> DataFrame:
    """``<key>, errors`` (joined by "; ") of answers against the documents they cite: bracket numbers out of range, numbers, names, articles, clauses and points no source holds, and claims without a bracket number.

    ``cited`` has ``<key>, <document>``, ``documents`` one row per document with
    ``title, kind, number`` and the arrays ``articles, clauses, points`` of its
    text.  A cited document that isn't there counts as a source that holds nothing.
    """
    lists = list(_NEAR)
    met = cited.select(key, document).distinct().join(documents.withColumn("_s", F.struct("title", "kind", "number")), document, "left")
    held = met.groupBy(key).agg(F.count(document).alias("_n"), F.collect_list("_s").alias("_s"), *[F.array_distinct(F.flatten(F.collect_list(x))).alias(x) for x in lists])  # the sources of one answer
    rows = answers.select(key, F.col(answer).alias("_text")).join(held, key, "left").withColumnRenamed(key, "_key")
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text, n, sources, *refs in zip(b["_key"], b["_text"], b["_n"], b["_s"], *(b[x] for x in lists)):
                own = [] if sources is None else [(s["title"], s["kind"], s["number"]) for s in sources]
                out.append((k, "; ".join(errors_of(text or "", 0 if pd.isna(n) else int(n), own, {x: set() if r is None else set(r) for x, r in zip(lists, refs)}))))
            yield pd.DataFrame(out, columns=["_key", "errors"])

    return rows.select("_key", "_text", "_n", "_s", *lists).mapInPandas(run, f"_key {kind}, errors string").withColumnRenamed("_key", key)


def readiness(cited: DataFrame, chunks: DataFrame, key: str, document: str) -> DataFrame:
    """``<key>, status`` of citations with ``articles`` and ``clauses`` (arrays): DOCUMENT_NOT_INDEXED, ARTICLES_INCOMPLETE, CLAUSES_INCOMPLETE, NO_STRUCTURAL_REFS or READY.

    Chunks are folded to the references each document has before the join.
    """
    has = chunks.groupBy(document).agg(F.collect_set(F.lower("article")).alias("_a"), F.collect_set(F.lower("clause")).alias("_c"))
    met = cited.join(has, document, "left")
    lacks = lambda asked, held: F.size(F.array_except(asked, held)) > 0
    status = (
        F.when(F.col("_a").isNull(), "DOCUMENT_NOT_INDEXED")
        .when(lacks(F.col("articles"), F.col("_a")), "ARTICLES_INCOMPLETE")
        .when(lacks(F.col("clauses"), F.col("_c")), "CLAUSES_INCOMPLETE")
        .when((F.size("articles") == 0) & (F.size("clauses") == 0), "NO_STRUCTURAL_REFS")
        .otherwise("READY")
    )
    return met.select(key, status.alias("status"))
