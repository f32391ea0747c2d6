"""Runs that append only what no run before them had, by key.

Rows lie with their keys in folders by a hash of the key, beside a Bloom filter of all of them. A new run asks the filter first: what it has not is new, without a look at any old key
(no false "new"); the few that it may have are compared exactly, with the folders of their hashes
only. With 2**27 bits (16 MB) and four hashes a filter of 13 million keys takes one new key in a
hundred for a possible repeat; ``bits`` is a parameter, and more keys cost reading, not results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import free
from ..sources.shared import written

BITS = 1 << 27
HASHES = 4
FOLDERS = 256
KEY, FOLDER = "_key", "_folder"


def bit_places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def bloom(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """One row, ``words``: the filter of a column of keys as an array of bits / 64 numbers. Bits
    are put together by word, before and after the shuffle."""
    if bits % 64 or bits > 1 << 30:
        raise ValueError("a filter has a multiple of 64 bits, at most 2**30")
    set_ = keys.select(F.explode(F.array(*bit_places(F.col(key), bits))).alias("bit"))
    words = set_.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("w"))
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("w"))
    whole = empty.unionByName(words).groupBy("word").agg(F.bit_or("w").alias("w"))
    # bits / 64 small rows, whatever the number of keys
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "w"))), lambda x: x["w"]).alias("words"))


def possible(rows: DataFrame, key: str, filter_: DataFrame, bits: int = BITS) -> tuple[DataFrame, str]:
    """The rows with a flag, and its name: whether the filter may have their key."""
    words, flag = free(rows, "_words", "_possible")
    hit = F.lit(True)
    for at in bit_places(F.col(key), bits):
        word = F.get(F.col(words), F.shiftright(at, 6).cast("int"))
        hit = hit & (F.getbit(word, at.bitwiseAND(63).cast("int")) == 1)
    return rows.crossJoin(F.broadcast(filter_.withColumnRenamed("words", words))).withColumn(flag, hit).drop(words), flag


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def folder_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """All rows that runs have appended below a path."""
    return spark.read.parquet(f"{path}/rows").drop(KEY, FOLDER)


def latest(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The last filter that was written whole, and the number of the next one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/filter")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    runs = [int(x.getPath().getName().split("=")[1]) for x in files.listStatus(place)] if files.exists(place) else []
    whole = [n for n in runs if _exists(spark, f"{path}/filter/run={n}/_SUCCESS")]
    return (spark.read.parquet(f"{path}/filter/run={max(whole)}") if whole else None), max(runs, default=0) + 1


def append_new(rows: DataFrame, key: str, order: str, path: str, bits: int = BITS) -> DataFrame:
    """Append to ``path`` the rows whose key no earlier run has appended, of equal keys the first
    in ``order``, and return them. Null keys are a key. Keys are compared as texts. One run at a
    time may append.

    Rows carry their keys, and a filter is written before the rows that it tells of, under a
    number of its own: a run that is killed leaves a filter with bits too many, which cost reading
    only, or rows whose bits are set."""
    if {KEY, FOLDER} & {c.lower() for c in rows.columns}:
        raise ValueError(f"{KEY} and {FOLDER} are columns of the appended table")
    spark = rows.sparkSession
    keyed = rows.withColumn(KEY, F.sha2(F.coalesce(F.concat(F.lit("v"), F.col(key).cast("string")), F.lit("n")).cast("binary"), 256))
    # Aggregated before the shuffle, so a key of very many rows is no group of its own.
    first = F.min_by(F.struct(*rows.columns), F.struct(order)).alias("r")
    fresh = written(keyed.groupBy(KEY).agg(first).select("r.*", KEY).withColumn(FOLDER, folder_of(F.col(KEY))), "fresh")
    old, number = latest(spark, path)
    if old is not None and _exists(spark, f"{path}/rows"):
        told, flag = possible(fresh, KEY, old, bits)
        told = written(told, "told")
        maybe = told.where(flag)
        # Folders of possible repeats only: at most FOLDERS numbers.
        folders = [r[0] for r in maybe.select(FOLDER).distinct().collect()]
        known = spark.read.parquet(f"{path}/rows").where(F.col(FOLDER).isin(folders)).select(KEY, FOLDER) if folders else None
        repeats = maybe.join(known, [KEY, FOLDER], "left_anti").select(told.columns) if folders else maybe
        fresh = written(told.where(~F.col(flag)).unionByName(repeats).drop(flag), "fresh")
    made = bloom(fresh, KEY, bits)
    if old is not None:
        made = made.crossJoin(F.broadcast(old.withColumnRenamed("words", "before"))).select(F.zip_with("words", "before", lambda a, b: a.bitwiseOR(b)).alias("words"))
    made.write.parquet(f"{path}/filter/run={number}")
    fresh.write.mode("append").partitionBy(FOLDER).parquet(f"{path}/rows")
    return fresh.drop(KEY, FOLDER)
