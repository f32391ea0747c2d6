"""What a row needs of the rows before it in its own trail (a user's events, a session's turns).

A window by trail would put a trail of any length into one task. Rows are numbered in the order of
trails instead (``seeded.numbered``: by range, so ties and long trails are split) and cut into
blocks of BLOCK rows; what a block needs of the one before it is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free
from .seeded import numbered

BLOCK = 1 << 16


def in_blocks(df: DataFrame, key: str, order: list[str], value: Column) -> tuple[DataFrame, str, str, str]:
    """The rows with their place, block and value, and those columns' names."""
    [name] = free(df, "_value")
    rows, place = numbered(df.withColumn(name, value), key, *order)
    [block] = free(rows, "_block")
    return rows.withColumn(block, F.floor(F.col(place) / BLOCK)), place, block, name


def previous_values(df: DataFrame, key: str, order: list[str], value: Column, n: int, name: str) -> DataFrame:
    """``name``: the values (not null) of the n rows before each row of its trail, oldest first.
    The last n rows of every block are in the next one once more."""
    if n > BLOCK:
        raise ValueError(f"at most {BLOCK} rows before")
    rows, place, block, own = in_blocks(df, key, order, value)
    [halo] = free(rows, "_halo")
    rows = rows.withColumn(halo, F.lit(False))
    edge = rows.where(F.col(place) % BLOCK >= BLOCK - n).withColumn(block, F.col(block) + 1).withColumn(halo, F.lit(True))
    before = Window.partitionBy(block, key).orderBy(place).rowsBetween(-n, -1)
    out = rows.unionByName(edge).withColumn(name, F.collect_list(own).over(before))
    return out.where(~F.col(halo)).drop(place, block, own, halo)


def carried(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the last value that is not null up to each row of its trail. Within a block it is
    found there; else it is the last of the trail's blocks before, of which each has one row."""
    rows, place, block, own = in_blocks(df, key, order, value)
    within = Window.partitionBy(block, key).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    # Only the trail that a block begins with can have begun before it.
    going_on = rows.where(F.col(place) % BLOCK == 0).select(F.col(key).alias("k")).distinct()
    ends = rows.join(going_on, rows[key].eqNullSafe(going_on["k"]), "left_semi")
    ends = ends.groupBy(F.col(block).alias("b"), F.col(key).alias("k")).agg(F.max_by(own, F.when(F.col(own).isNotNull(), F.col(place))).alias("v"))
    earlier = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("b", "k", F.last("v", True).over(earlier).alias("v")).where("v IS NOT NULL")
    out = rows.withColumn(name, F.last(own, True).over(within))
    [b, k, v] = free(out, "_b", "_k", "_v")
    ends = ends.withColumnsRenamed({"b": b, "k": k, "v": v})  # at most a row for each block
    out = out.join(ends, (out[block] == ends[b]) & out[key].eqNullSafe(ends[k]), "left")
    return out.withColumn(name, F.coalesce(name, v)).drop(place, block, own, b, k, v)
