"""Building blocks used by several operators: tables, latest rows, checkpoints, hot keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most this many rows.
BROADCAST_ROWS = 100_000

#: White space that careless keys carry at their ends.
EDGE_BLANKS = r"^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$"

#: The seven morphology labels that count.
LABELS = (
    "minimal-response",
    "scattered",
    "linear-like",
    "branched/complex",
    "diffuse/large-region",
    "focal/irregular-region",
    "mixed",
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data directory, pruned to ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest_rows(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row for each key: that with the greatest ``order``.

    Fully equal rows count once. Rows that tie on ``order`` but differ are told apart by the
    values of ``columns`` in the order given, the greatest first, so the result does not depend
    on partitioning. A null ``order`` is the smallest; rows with a null key are left out.
    The maximum of a struct is combined on the map side, so a key with very many rows costs
    one row for each partition in the shuffle.
    """
    rest = [c for c in columns if c not in (key, order)]
    best = F.max(F.struct(order, *rest)).alias("_best")
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(best)
    return out.select(key, *[F.col("_best")[c].alias(c) for c in columns if c != key])


def squeezed_label(label: Column) -> Column:
    """A label reduced to its letters and digits in lower case."""
    return F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", "")


def counting_label(label: Column) -> Column:
    """The canonical spelling of a label, or null if it is none of the seven that count."""
    pairs: list[Column] = []
    for name in LABELS:
        pairs += [F.lit("".join(ch for ch in name if ch.isalnum())), F.lit(name)]
    return F.try_element_at(F.create_map(*pairs), squeezed_label(label))


def clean_key(key: Column) -> Column:
    """A key trimmed of white space and in upper case; null if nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(key, EDGE_BLANKS, "")), F.lit(""))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names, else (local runs only) our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lamella-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of our own, on whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def heavy_keys(df: DataFrame, key: str, share: int = 2_000, floor: int = 10_000) -> DataFrame:
    """Keys that hold more than one ``share``-th of all rows (and more than ``floor`` rows).

    At most ``share`` keys can do so, hence the result may be broadcast whatever the data.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return (
        counts.where(F.col("n") > floor)
        .crossJoin(F.broadcast(total))  # one row
        .where(F.col("n") > F.col("_total") / share)
        .select(key, "n")
    )


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    hot: DataFrame,
    spread: Column,
    salts: int = 32,
    how: str = "inner",
) -> DataFrame:
    """``big`` joined with ``small`` on ``keys``, rows of hot keys spread over ``salts`` tasks.

    ``hot`` holds the hot keys (columns ``keys``); it must come from :func:`heavy_keys`, whose size is bounded.
    ``spread`` is an expression over ``big`` that is about uniform within a hot key. ``how`` is inner or left.
    """
    hot = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
    left = big.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    )
    right = small.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    return left.drop("_hot").join(right.drop("_hot"), [*keys, "_salt"], how).drop("_salt")
