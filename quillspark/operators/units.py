"""Articles, clauses, points and annexes of legal texts, line by line.

A text becomes one row per block; markers are carried forward by windows over
the blocks of a document, so the work is joins and windows and no document is
parsed on its own in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import anchor

# Beginnings of articles, sections by Roman number, clauses, points, annexes and forms, and where a heading runs into its first clause.
ARTICLE = r"(?iu)^\s*[“\"]?điều\s+([0-9]+[a-z]?)\.?(?:\s+(.*))?$"
ROMAN = r"(?i)^\s*([IVXLCDM]+)\.\s+.+$"
CLAUSE = r"^\s*([0-9]+)\.\s+.+$"
POINT = r"(?iu)^\s*([a-zđ])\)\s+.+$"
ANNEX = r"^\s*(?:Phụ\s+lục|PHỤ\s+LỤC)(?:[^\p{L}].*)?$"
TAIL = r"^(\s*[“\"]?(?iu:điều)\s+[0-9]+[a-zA-Z]?\.?(?:\s+(?![0-9]+\.\s).*?)?)\s+([0-9]+\.\s.*)$"
UNIT = r"(?iu)\s+(?=(?:[0-9]+\.|[a-zđ]\))\s)"


def blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, pos, block``: non-blank lines, a heading cut from the clauses and points that follow it in its line."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "block"))
    tail = F.regexp_extract("block", TAIL, 2)
    parts = F.when(tail != "", F.concat(F.array(F.regexp_extract("block", TAIL, 1)), F.split(tail, UNIT))).otherwise(F.array("block"))
    units = lines.select(key, "line", F.posexplode(parts).alias("part", "block")).withColumn("block", F.trim(F.regexp_replace("block", r"[ \t\r\f\x0B]+", " ")))
    return units.where("block <> ''").select(key, F.row_number().over(Window.partitionBy(key).orderBy("line", "part")).alias("pos"), "block")


def _in_articles(rows: DataFrame, key: str) -> DataFrame:
    """Blocks with ``annex_no``, ``article_pos``, and the number ``_art`` where an article begins."""
    mark = lambda p: F.nullif(F.regexp_extract("block", p, 1), F.lit(""))
    doc = Window.partitionBy(key)
    so_far = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns({"_annex": F.col("block").rlike(ANNEX), "_a": mark(ARTICLE), "_r": F.upper(mark(ROMAN))})
    marked = marked.withColumn("annex_no", F.sum(F.col("_annex").cast("int")).over(so_far))
    free = F.col("annex_no") == 0
    first = lambda c: F.min(F.when(free & F.col(c).isNotNull(), F.col("pos"))).over(doc)
    roman = first("_r") < F.coalesce(first("_a"), F.lit(1 << 30))
    marked = marked.withColumn("_art", F.when(free, F.coalesce("_a", F.when(roman, F.col("_r")))))
    carried = F.last(F.when(F.col("_art").isNotNull(), F.col("pos")), ignorenulls=True).over(so_far)
    return marked.withColumn("article_pos", F.when(free, carried))


def articles(rows: DataFrame, key: str) -> DataFrame:
    """Blocks with ``article_pos`` and, at its beginning, the ``number`` of the article: what ``units`` gives, where no clauses and points are asked for."""
    return _in_articles(rows, key).select(key, "pos", "block", F.col("_art").alias("number"), "article_pos")


def units(rows: DataFrame, key: str) -> DataFrame:
    """Blocks with ``kind`` (article, clause, point, annex, text), ``number``, and the ``article_pos, clause_pos, point_pos, annex_no`` they stand under.

    An annex goes on to the end of its document or the next annex and holds no
    articles.  Roman sections count as articles where one stands before the
    first article.  Clauses begin anew in each article, points in each clause.
    """
    mark = lambda p: F.nullif(F.regexp_extract("block", p, 1), F.lit(""))
    marked = _in_articles(rows.withColumns({"_c": mark(CLAUSE), "_p": F.lower(mark(POINT))}), key)
    carried = lambda c, w: F.last(F.when(c, F.col("pos")), ignorenulls=True).over(w)
    in_article = Window.partitionBy(key, "article_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_clause = F.col("article_pos").isNotNull() & F.col("_art").isNull() & F.col("_c").isNotNull()
    marked = marked.withColumn("clause_pos", F.when(F.col("article_pos").isNotNull(), carried(is_clause, in_article)))
    is_point = F.col("clause_pos").isNotNull() & ~is_clause & F.col("_p").isNotNull()
    in_clause = Window.partitionBy(key, "article_pos", "clause_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("point_pos", F.when(F.col("clause_pos").isNotNull(), carried(is_point, in_clause)))
    kind = F.when(F.col("_annex"), "annex").when(F.col("_art").isNotNull(), "article").when(is_clause, "clause").when(is_point, "point").otherwise("text")
    number = F.when(kind == "annex", F.col("annex_no").cast("string")).when(kind == "article", F.col("_art")).when(kind == "clause", F.col("_c")).when(kind == "point", F.col("_p"))
    return marked.select(key, "pos", "block", kind.alias("kind"), number.alias("number"), "article_pos", "clause_pos", "point_pos", "annex_no")


def anchors(marked: DataFrame, key: str) -> DataFrame:
    """``<key>, pos, kind, number, anchor`` of every unit: stable names, the n-th of equal ones told apart."""
    heads = marked.where("kind <> 'text'")
    nth = lambda *by: F.row_number().over(Window.partitionBy(key, "kind", *by, "number").orderBy("pos"))
    occurrence = F.when(F.col("kind") == "clause", nth("article_pos")).when(F.col("kind") == "point", nth("article_pos", "clause_pos")).otherwise(nth())
    own = heads.withColumn("_own", F.when(F.col("kind") == "annex", F.concat(F.lit("annex-"), "number")).otherwise(F.concat("kind", F.substring(anchor("", F.col("number"), occurrence), 1, 1 << 20))))
    last = lambda kind, *by: F.max(F.when(F.col("kind") == kind, F.col("_own"))).over(Window.partitionBy(key, *by))
    whole = own.withColumns({"_of_article": last("article", "article_pos"), "_of_clause": last("clause", "article_pos", "clause_pos")})
    name = F.when(F.col("kind") == "clause", F.concat_ws(".", "_of_article", "_own")).when(F.col("kind") == "point", F.concat_ws(".", "_of_article", "_of_clause", "_own")).otherwise(F.col("_own"))
    return whole.select(key, "pos", "kind", "number", name.alias("anchor"))


def unit_texts(marked: DataFrame, key: str, level: str) -> DataFrame:
    """``<key>, pos, number, blocks, text``: each article, clause or point with the blocks under it, joined by line ends."""
    at = f"{level}_pos"
    under = marked.where(F.col(at).isNotNull()).groupBy(key, at)
    joined = under.agg(F.count(F.lit(1)).alias("blocks"), F.sort_array(F.collect_list(F.struct("pos", "block"))).alias("_b"), F.min_by("number", "pos").alias("number"))  # of one unit
    return joined.select(key, F.col(at).alias("pos"), "number", "blocks", F.array_join("_b.block", "\n").alias("text"))
