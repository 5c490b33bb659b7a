"""References to records that do not exist, no longer exist or did not exist yet.

Parents and children are put in one long form, tagged by what they are, and grouped by parent table and key. A group tells
whether the key has a parent at all, when the parent first arrived and since when it is gone, and how early and how late its
children are; so one combined aggregation separates sound keys from suspect ones. Only children of suspect keys
are looked at one by one. Keys that very many children refer to are combined before the shuffle in the aggregation, and their
children are spread over tasks when the parents' facts are joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.common import clean_key, heavy_keys, latest_rows, salted_join


@dataclass(frozen=True)
class Parent:
    """A table that is referred to. ``withdrawn`` is the time from which a row's record is gone, if there is such a column."""

    name: str
    rows: DataFrame
    key: str
    ingested: str
    withdrawn: str | None = None


@dataclass(frozen=True)
class Child:
    """A table that refers to ``parent`` by the columns ``references``; of the rows sharing ``row_id`` the latest counts."""

    name: str
    rows: DataFrame
    row_id: str
    references: tuple[str, ...]
    parent: str
    recorded: str
    ingested: str


def parent_facts(parent: Parent) -> DataFrame:
    """For each key: parent table, when it first arrived, and since when its latest row is withdrawn.

    Keys are trimmed and in upper case; rows without a key are no parents. Rows that tie as the latest: one withdrawn later counts.
    """
    gone = F.col(parent.withdrawn) if parent.withdrawn else F.lit(None).cast(parent.rows.schema[parent.ingested].dataType)
    rows = parent.rows.select(clean_key(F.col(parent.key)).alias("key"), F.col(parent.ingested).alias("at"), gone.alias("gone"))
    return (
        rows.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("at").alias("first_at"), F.max(F.struct("at", "gone")).alias("latest"))
        .select(F.lit(parent.name).alias("parent"), "key", "first_at", F.col("latest.gone").alias("gone_at"))
    )


def child_references(child: Child) -> DataFrame:
    """References in long form: table, row id, column, parent table, key, and the row's times. Null and empty references are left out."""
    latest = latest_rows(child.rows, child.row_id, child.ingested, child.row_id, child.ingested, child.recorded, *child.references)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), clean_key(F.col(c)).alias("key")) for c in child.references]))
    return (
        latest.select(
            F.lit(child.name).alias("table_name"),
            F.lit(child.parent).alias("parent"),
            F.col(child.row_id).alias("row_id"),
            F.col(child.recorded).alias("recorded_at"),
            F.col(child.ingested).alias("ingested_at"),
            pairs.alias("r"),
        )
        .select("table_name", "parent", "row_id", "recorded_at", "ingested_at", "r.field", "r.key")
        .where(F.col("key").isNotNull())
    )


def orphan_references(parents: list[Parent], children: list[Child]) -> DataFrame:
    """One row for each orphan reference: ``table_name``, ``period``, ``row_id``, ``ref_field``, ``key``, ``kind``.

    ``kind`` is the first that holds of ``missing`` (no row of that key in the parent table), ``late`` (the parent first arrived
    after the referring row) and ``deleted`` (the parent's latest row is withdrawn at a time that is not after the referring
    row was recorded). ``period`` is the month in which the row was recorded, null if that is unknown. A null time makes ``late``
    and ``deleted`` undecidable, hence no case. Rows without a ``row_id`` are left out. Empty tables give an empty result.
    """
    facts = parent_facts(parents[0])
    for p in parents[1:]:
        facts = facts.unionByName(parent_facts(p))
    refs = child_references(children[0])
    for c in children[1:]:
        refs = refs.unionByName(child_references(c))

    none = F.lit(None)  # takes the type of the other side
    tagged = facts.select("parent", "key", F.lit(1).alias("is_parent"), "first_at", "gone_at", none.alias("earliest"), none.alias("latest")).unionByName(
        refs.select(
            "parent", "key", F.lit(0).alias("is_parent"), none.alias("first_at"), none.alias("gone_at"),
            F.col("ingested_at").alias("earliest"), F.col("recorded_at").alias("latest"),
        )
    )
    groups = tagged.groupBy("parent", "key").agg(
        F.max("is_parent").alias("has_parent"),
        F.max("first_at").alias("first_at"),
        F.max("gone_at").alias("gone_at"),
        F.min("earliest").alias("earliest"),
        F.max("latest").alias("latest"),
        F.sum(1 - F.col("is_parent")).alias("references"),
    )
    suspect = groups.where(
        (F.col("references") > 0)
        & ((F.col("has_parent") == 0) | (F.col("first_at") > F.col("earliest")) | (F.col("gone_at") <= F.col("latest")))
    ).select("parent", "key", "has_parent", "first_at", "gone_at")

    hot = heavy_keys(refs.select(F.struct("parent", "key").alias("k")), "k").select("k.parent", "k.key")
    joined = salted_join(refs, suspect, ["parent", "key"], hot, F.struct("row_id", "field"))
    kind = (
        F.when(F.col("has_parent") == 0, "missing")
        .when(F.col("first_at") > F.col("ingested_at"), "late")
        .when(F.col("gone_at") <= F.col("recorded_at"), "deleted")
    )
    return joined.select(
        "table_name", F.date_format("recorded_at", "yyyy-MM").alias("period"), "row_id", F.col("field").alias("ref_field"), "key", kind.alias("kind")
    ).where(F.col("kind").isNotNull())


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references, and of different keys, for each table, month, column and kind."""
    return orphans.groupBy("table_name", "period", "ref_field", "kind").agg(
        F.count("*").alias("n_references"), F.count_distinct("key").alias("n_keys")
    )
