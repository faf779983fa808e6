"""A session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(name: str = "pagemill") -> SparkSession.Builder:
    """UTC timestamps, adaptive execution with skew handling; master and sizes come from the caller."""
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Rounds that no later step reads are removed from the checkpoint folder.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Of repeated keys in one JSON object the last counts.
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )


def local(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    spark = (
        builder("pagemill-local").master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("WARN")
    return spark
