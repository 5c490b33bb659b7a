"""Queries for references between tables and for nested exam documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.common import table
from lamella.operators import nested, references
from lamella.plans.registry import Registry

query = Registry()


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references of both bilateral tables."""
    parents = [
        references.Parent(n, table(spark, d, n, "plate_id", "ingested_at", "withdrawn_at"), "plate_id", "ingested_at", "withdrawn_at")
        for n in ("plate_reference_scores", "plate_index")
    ]
    children = []
    for name, fields, parent in (
        ("bilateral_reference_scores", ("left_reference_plate", "right_reference_plate"), "plate_reference_scores"),
        ("bilateral_dinov2_reference_scores", ("left_plate_id", "right_plate_id"), "plate_index"),
    ):
        rows = table(spark, d, name, "bilateral_pair_id", *fields, "recorded_at", "ingested_at")
        children.append(references.Child(name, rows, "bilateral_pair_id", fields, parent, "recorded_at", "ingested_at"))
    return references.orphan_references(parents, children)


_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _orphan_sql(select: str) -> str:
    parts = []
    for name, left, right, parent in (
        ("bilateral_reference_scores", "left_reference_plate", "right_reference_plate", "plate_reference_scores"),
        ("bilateral_dinov2_reference_scores", "left_plate_id", "right_plate_id", "plate_index"),
    ):
        pair = f"""(SELECT * FROM {name} WHERE bilateral_pair_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY bilateral_pair_id ORDER BY ingested_at DESC, recorded_at DESC) = 1)"""
        facts = f"""(SELECT upper(regexp_replace(plate_id, '{_BLANKS}', '', 'g')) AS key, min(ingested_at) AS first_at,
            max(struct_pack(a := ingested_at, b := coalesce(withdrawn_at, TIMESTAMP '0001-01-01'))).b AS gone FROM {parent} WHERE plate_id IS NOT NULL GROUP BY 1)"""
        for ref in (left, right):
            parts.append(f"""
                SELECT '{name}' AS table_name, strftime(p.recorded_at, '%Y-%m') AS period, p.bilateral_pair_id, '{ref}' AS ref_field,
                       p.key, CASE WHEN f.key IS NULL THEN 'missing' WHEN f.first_at > p.ingested_at THEN 'late'
                              WHEN f.gone > TIMESTAMP '0001-01-01' AND f.gone <= p.recorded_at THEN 'deleted' END AS kind
                FROM (SELECT *, upper(regexp_replace({ref}, '{_BLANKS}', '', 'g')) AS key FROM {pair}) p LEFT JOIN {facts} f ON f.key = p.key
                WHERE p.key <> ''""")
    return f"WITH o AS ({' UNION ALL '.join(parts)}) {select}"


@query(_orphan_sql("SELECT table_name, period, bilateral_pair_id, ref_field, kind FROM o WHERE kind IS NOT NULL"))
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references of pairs, one row each."""
    return _orphans(spark, d).select("table_name", "period", F.col("row_id").alias("bilateral_pair_id"), "ref_field", "kind")


@query(
    _orphan_sql(
        """SELECT table_name, period, ref_field, kind, count(*) AS n_references, count(DISTINCT key) AS n_keys
        FROM o WHERE kind IS NOT NULL GROUP BY ALL"""
    )
)
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted for each table, month, column and kind."""
    return references.orphan_report(_orphans(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    exams = table(spark, d, "exams", "exam_id", "created_at", "result_json")
    return nested.flatten(nested.latest_documents(exams, "exam_id", "created_at", "result_json"), "exam_id", "result_json")


@query()
def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All nodes of exams with their interval labels and the label of their parent."""
    return _nodes(spark, d).drop("path")


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """All objects of exams with their positions and keys."""
    return nested.exam_nodes(_nodes(spark, d), "exam_id")
