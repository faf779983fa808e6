"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.functions.lineage import new_folder


def write(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and return its path.

    A lost executor then costs no more than the tasks it was running, and nothing is computed twice.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``column``, so that a join on it does not shuffle it again.

    The catalog entry lasts only until the table is read back; the files stay where they are.
    """
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), new_folder(spark, name)
    entry = f"{name}_{path[-32:]}"
    df.write.format("parquet").bucketBy(n, column).option("path", path).saveAsTable(entry)
    table = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this module that no later step reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
