"""Session settings shared by applications, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that the operators rely on for right results, not for speed.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

#: Settings that let the planner adapt to the size of the data.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints go when no frame needs them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "lamella", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **ADAPTIVE, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
