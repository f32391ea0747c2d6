"""Tables in the folder that driver and executors share: they cut lineage, so a lost executor
costs no recomputation of what is behind them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "file:///tmp/larkspur-shared"


def shared_dir(spark: SparkSession, name: str = "larkspur") -> str:
    """A fresh folder below spark.checkpoint.dir.

    Where the setting is absent, a folder in /tmp is used on one machine; on a cluster that is
    an error, as executors would write to disks of their own. The session's settings are left
    as they are."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or LOCAL).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Shared tables go when the application ends, on whatever file system they are."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """A table, written to the shared folder and read back."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    remove_at_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")
