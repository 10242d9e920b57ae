"""Searching, paging, joining, set operations and replacement of keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(rows: DataFrame, *, contains: dict[str, str | None] | None = None, equals: dict[str, object] | None = None, since: dict[str, object] | None = None, until: dict[str, object] | None = None) -> DataFrame:
    """Rows that meet every given condition; values that are None or blank ask nothing.

    ``contains`` ignores case.  ``since`` and ``until`` include their bound.
    A null in a searched column meets no condition on it.
    """
    given = lambda d: [(c, v) for c, v in (d or {}).items() if v is not None and str(v).strip() != ""]
    for c, v in given(contains):
        rows = rows.where(F.contains(F.lower(F.col(c)), F.lower(F.lit(str(v).strip()))))
    for c, v in given(equals):
        rows = rows.where(F.col(c) == F.lit(v))
    for c, v in given(since):
        rows = rows.where(F.col(c) >= F.lit(v))
    for c, v in given(until):
        rows = rows.where(F.col(c) <= F.lit(v))
    return rows


def page(rows: DataFrame, order: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """One page of an order (a top-k: no more than (number + 1) * size rows are kept by any task)."""
    size = max(1, min(size, most))
    return rows.orderBy(*order).offset(max(0, number) * size).limit(size)


def check_filters(filters: dict[str, object], allowed: set[str]) -> None:
    """Refuse filters on columns that are not allowed."""
    bad = sorted(set(filters) - allowed)
    if bad:
        raise ValueError(f"unknown filters: {', '.join(bad)}")


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``facet, value, n`` for each non-blank value of the columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return rows.select(pairs).select("p.*").where("trim(value) <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Of rows with equal keys the one with the greatest version; ties are broken by the whole row."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*version, F.xxhash64(*others)))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in others])


def page_with_total(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an order, with the number of all rows in ``total``."""
    return page(rows, order, number, size).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row beside a page


def haystack(rows: DataFrame, columns: list[str], asked: str) -> DataFrame:
    """Rows one of whose columns, or their sequence, holds a text; case is ignored."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(asked.strip().lower())))


def cascade(tables: dict[str, tuple[DataFrame, list[str]]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Tables without the rows that refer to a deleted key in any of their columns."""
    ids = gone.select(F.col(key).alias("_gone")).where("_gone is not null").distinct()
    out = {}
    for name, (rows, columns) in tables.items():
        for c in columns:
            rows = rows.join(ids, F.col(c) == F.col("_gone"), "left_anti")
        out[name] = rows
    return out


def title_hints(citations: DataFrame, documents: DataFrame, *, citation_key: str, hint: str, document_id: str, columns: list[str], least: int = 3) -> DataFrame:
    """``<citation_key>, status, matched_id`` of hints that stand in a title (or another column) of documents, case ignored: MATCHED, AMBIGUOUS or UNRESOLVED.

    A hint can only stand in texts that hold its rarest three signs, so hints
    and texts meet by these, not each with each; hints below ``least`` signs
    are unresolved.  Tables that grow are joined by shuffle: folded titles are
    small when compressed, so Spark would send them to all tasks, where they
    are many times as large.
    """
    hints = citations.select(F.col(citation_key), F.lower(F.trim(hint)).alias("_hint"))
    texts = documents.select(F.col(document_id).alias("_d"), F.explode(F.array_distinct(F.array(*[F.lower(c) for c in columns]))).alias("_t")).where("length(_t) >= 3").distinct()
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(F.col(c), i, F.lit(3))))
    asked = hints.where(F.length("_hint") >= max(3, least)).select("_hint").distinct()
    signs = asked.select("_hint", F.explode(grams("_hint")).alias("_g"))
    # titles of equal wording are looked at once
    wordings = texts.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_d"))
    held = wordings.select("_t", F.explode(grams("_t")).alias("_g"))
    rare = signs.join(held.groupBy("_g").agg(F.count(F.lit(1)).alias("_held")).hint("merge"), "_g", "left").groupBy("_hint").agg(F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("h"), "_g")).alias("_r")).select("_hint", F.col("_r._g").alias("_g"))
    # there are only so many groups of three signs: titles leave those that no hint is met by before the shuffle
    met = rare.join(held.join(F.broadcast(rare.select("_g").distinct()), "_g", "left_semi").hint("merge"), "_g").where(F.contains("_t", F.col("_hint"))).select("_hint", "_t")
    found = met.join(texts.hint("merge"), "_t").groupBy("_hint").agg(F.count_distinct("_d").alias("_n"), F.min("_d").alias("_d"))
    out = hints.join(found.hint("merge"), "_hint", "left")
    status = F.when(F.col("_n") == 1, "MATCHED").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    return out.select(citation_key, status.alias("status"), F.when(F.col("_n") == 1, F.col("_d")).alias("matched_id"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Old rows replaced by new ones of the same keys; of several new ones the latest counts."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(latest(new, keys, version))


def replace_children(old: DataFrame, new: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """Rows of imported keys are dropped, then the new ones are added; running it again changes nothing."""
    return old.join(imported.select(key).distinct(), key, "left_anti").unionByName(new.distinct())


def missing_and_extra(source: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """``<key>, side``: keys of the source without an indexed one (missing), and the reverse (extra)."""
    tagged = source.select(key, F.lit(1).alias("s"), F.lit(0).alias("i")).unionByName(indexed.select(key, F.lit(0).alias("s"), F.lit(1).alias("i")))
    sides = tagged.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("s").alias("s"), F.max("i").alias("i"))
    return sides.where("s <> i").select(key, F.when(F.col("s") == 1, "missing").otherwise("extra").alias("side"))


def resolve(citations: DataFrame, documents: DataFrame, *, citation_key: str, key: Column, document_id: str, document_key: Column) -> DataFrame:
    """``<citation_key>, status, matched_id``: MATCHED with one document of the key, AMBIGUOUS with more, MISSING with none, UNRESOLVED without a key.

    Documents are counted by key before the join, so no pairs are made.
    """
    named = documents.select(document_key.alias("_k"), F.col(document_id).alias("_d")).where("_k is not null").groupBy("_k").agg(F.count_distinct("_d").alias("_n"), F.min("_d").alias("_d"))
    asked = citations.select(citation_key, key.alias("_k")).join(named, "_k", "left")
    status = F.when(F.col("_k").isNull(), "UNRESOLVED").when(F.col("_n") == 1, "MATCHED").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("MISSING")
    return asked.select(citation_key, status.alias("status"), F.when(F.col("_n") == 1, F.col("_d")).alias("matched_id"))


def citation_status(items: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """``<key>, citations, matched, missing, status`` per item: NO_CITATIONS, HAS_MISSING, ALL_MATCHED or PARTIAL."""
    per = resolved.groupBy(key).agg(F.count(F.lit(1)).alias("citations"), F.count_if(F.col("status") == "MATCHED").alias("matched"), F.count_if(F.col("status") == "MISSING").alias("missing"))
    rows = items.select(key).distinct().join(per, key, "left").na.fill(0, ["citations", "matched", "missing"])
    return rows.withColumn("status", F.when(F.col("citations") == 0, "NO_CITATIONS").when(F.col("missing") > 0, "HAS_MISSING").when(F.col("matched") == F.col("citations"), "ALL_MATCHED").otherwise("PARTIAL"))


def duplicate_identity(rows: DataFrame, key: str, identity: list[Column]) -> DataFrame:
    """``identity, first_id, <key>``: records with equal identity, each against the first; null parts are no identity.

    A group of n records gives n - 1 rows, not all pairs.
    """
    parts = [F.lower(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))) for c in identity]
    whole = F.when(F.greatest(*[p.isNull().cast("int") for p in parts]) == 0, F.sha2(F.concat_ws("|", *parts), 256)) if len(parts) > 1 else F.sha2(parts[0], 256)
    named = rows.select(F.col(key), whole.alias("identity")).where("identity is not null").distinct()
    firsts = named.groupBy("identity").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return named.join(firsts, "identity").where(F.col(key) != F.col("first_id")).select("identity", "first_id", key)


def runs(rows: DataFrame, by: list[str], order: list[Column], begins: Column) -> DataFrame:
    """Adds ``run``: the number of the stretch of rows (per ``by``) that starts where ``begins`` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("run", F.sum(F.coalesce(begins.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def id_runs(rows: DataFrame, key: str, lot: int = 1000) -> DataFrame:
    """``first_id, last_id, n``: the stretches of different ids that follow each other without a gap.

    Runs are found within lots of ids; a run whose first id follows the last
    one of another run goes on with it.  The start of each is the greatest
    start so far, within lot x lot ids by a window and before them by the
    greatest start of all earlier ones, so the one window over all has a row
    for lot x lot ids.
    """
    ids = rows.select(F.col(key).alias("id")).distinct().withColumn("_lot", F.floor(F.col("id") / lot))
    stretch = F.col("id") - F.row_number().over(Window.partitionBy("_lot").orderBy("id"))
    parts = ids.withColumn("_g", stretch).groupBy("_lot", "_g").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    ends = parts.where(F.pmod(F.col("last_id") + 1, F.lit(lot)) == 0).select((F.col("last_id") + 1).alias("first_id"), F.lit(True).alias("_goes_on"))
    marked = parts.join(ends, "first_id", "left").withColumn("_start", F.when(F.col("_goes_on").isNull(), F.col("first_id"))).withColumn("_far", F.floor(F.col("_lot") / lot))
    upto = Window.partitionBy("_far").orderBy("first_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_near", F.max("_start").over(upto))
    before = Window.orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("_far").agg(F.max("_start").alias("_m")).select("_far", F.max("_m").over(before).alias("_carried"))
    runs_of = marked.join(carried, "_far", "left").groupBy(F.coalesce("_near", "_carried").alias("_run"))
    return runs_of.agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n").alias("n")).drop("_run")
