"""Cutting lineage for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named in ``spark.checkpoint.dir``; only a local session may leave it out."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.gettempdir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and read it back from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(new_folder(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def bucketed(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``columns``, one file each: a join on them does not shuffle it again.

    The catalog entry lasts only until the table is read back; the files stay where they are.
    """
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), new_folder(spark, name)
    entry = f"{name}_{path[-32:]}"
    df.repartition(n, *columns).write.format("parquet").bucketBy(n, *columns).option("path", path).saveAsTable(entry)
    table = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return table


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
