"""References to records that do not exist.

Parent and child keys are put into one tagged long table and grouped by parent
table and key, so that one shuffle with map-side combination finds every key
without a living parent.  Child rows then meet only the keys that can make them
orphans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A key is hot if it has more than one in so many child references; so there are fewer hot keys than this.
HOT_ONE_IN = 1000


@dataclass(frozen=True)
class Parent:
    """A table of records. ``removed`` is a log with the same key; either time may be null."""

    name: str
    rows: DataFrame
    key: str
    created: str
    removed: DataFrame | None = None
    removed_key: str | None = None
    removed_at: str | None = None


@dataclass(frozen=True)
class Child:
    """References from ``rows``: the column ``reference`` names a key of ``parent``."""

    name: str
    rows: DataFrame
    row_id: str
    reference: str
    created: str
    parent: str


def _long(parents: list[Parent], children: list[Child]) -> DataFrame:
    """Tagged keys of all tables: parent, key, kind, at. Null keys refer to nothing and are left out."""
    parts = []
    for p in parents:
        parts.append(p.rows.select(F.lit(p.name).alias("parent_table"), F.col(f"`{p.key}`").alias("key"), F.lit("parent").alias("tag"), F.col(f"`{p.created}`").alias("at")))
        if p.removed is not None:
            parts.append(p.removed.select(F.lit(p.name).alias("parent_table"), F.col(f"`{p.removed_key}`").alias("key"), F.lit("removed").alias("tag"), F.col(f"`{p.removed_at}`").alias("at")))
    for c in children:
        parts.append(c.rows.select(F.lit(c.parent).alias("parent_table"), F.col(f"`{c.reference}`").alias("key"), F.lit("child").alias("tag"), F.col(f"`{c.created}`").alias("at")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.where(F.col("key").isNotNull())


def _of(tag: str, value) -> F.Column:
    return F.when(F.col("tag") == tag, value)


def orphan_references(parents: list[Parent], children: list[Child]) -> DataFrame:
    """Every reference whose parent is missing, removed or later than the reference.

    Returns distinct rows ``child_table, row_id, endpoint, parent_table, key,
    orphan_kind, created``.  With c the parent's first creation and t its last
    removal: ``deleted`` if t exists and c does not or t > c; else ``missing``
    if there is no parent row; else ``late`` if the reference is older than c.

    Null references are no references.  A parent whose creation time is null
    exists but can be neither late nor deleted-and-back.  A reference without
    time is never late.  Empty tables give an empty result (or, with no
    parents, only ``missing``).  Repeated rows count once.  Columns beyond the
    named ones are not read, whatever their names.
    """
    state = (
        _long(parents, children)
        .groupBy("parent_table", "key")
        .agg(
            F.max(_of("parent", F.lit(1))).alias("is_there"),
            F.min(_of("parent", F.col("at"))).alias("born"),
            F.max(_of("removed", F.lit(1))).alias("is_removed"),
            F.max(_of("removed", F.col("at"))).alias("gone"),
            F.count(_of("child", F.lit(1))).alias("n"),
            F.min(_of("child", F.col("at"))).alias("first_use"),
        )
    )
    fate = (
        F.when(F.col("is_removed").isNotNull() & (F.col("is_there").isNull() | (F.col("gone") > F.col("born"))), "deleted")
        .when(F.col("is_there").isNull(), "missing")
        .when(F.col("first_use") < F.col("born"), "late")
    )
    suspects = cut(state.where(F.col("n") > 0).withColumn("fate", fate).where(F.col("fate").isNotNull()).select("parent_table", "key", "born", "fate", "n"))
    total = suspects.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_ONE_IN > total
    hot = suspects.where(is_hot).drop("n")
    other = suspects.where(~is_hot).drop("n")
    refs = None
    for c in children:
        part = c.rows.select(
            F.lit(c.name).alias("child_table"), F.col(f"`{c.row_id}`").alias("row_id"), F.lit(c.reference).alias("endpoint"),
            F.lit(c.parent).alias("parent_table"), F.col(f"`{c.reference}`").alias("key"), F.col(f"`{c.created}`").alias("created"),
        ).where(F.col("key").isNotNull())
        refs = part if refs is None else refs.unionByName(part)
    on = ["parent_table", "key"]
    # fewer than HOT_ONE_IN keys are hot, so that side is small enough to send to all; the rest has no hot key left
    met = refs.join(F.broadcast(hot), on).unionByName(refs.join(F.broadcast(hot.select(*on)), on, "left_anti").join(other, on))
    return (
        met.where((F.col("fate") != "late") | (F.col("created") < F.col("born")))
        .select("child_table", "row_id", "endpoint", "parent_table", "key", F.col("fate").alias("orphan_kind"), "created")
        .distinct()
    )


def orphan_counts(orphans: DataFrame, period: str = "yyyy-MM") -> DataFrame:
    """Orphans by tables, kind and period of the reference's time (null where it has none).

    Returns ``child_table, endpoint, parent_table, orphan_kind, period, n``.
    """
    return (
        orphans.withColumn("period", F.date_format("created", period))
        .groupBy("child_table", "endpoint", "parent_table", "orphan_kind", "period")
        .agg(F.count(F.lit(1)).alias("n"))
    )
