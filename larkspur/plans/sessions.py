"""The supplied tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nested(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: Column | str = "role", text: Column | str = "text") -> DataFrame:
    """(key, conversation, num_turns) from one row for each message."""
    role, text = (F.col(x) if isinstance(x, str) else x for x in (role, text))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), role.alias("role"), text.alias("content"))))
    out = rows.groupBy(key).agg(items.alias("m"))
    out = out.select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("conversation"))
    return out.withColumn("num_turns", F.size(F.filter("conversation", lambda x: x["role"] == "user")))


def with_flaws(conversations: DataFrame) -> DataFrame:
    """Conversations with flaws that the supplied ones lack: a repeated role in every seventh
    and a blank message in every eleventh."""
    role = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), "user").otherwise(F.col("role"))
    text = F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") == 2), "  ").otherwise(F.col("text"))
    return conversations.withColumns({"role": role, "text": text})


# Fixed SQL with the same flaws, for the other side of a comparison.
FLAWS_SQL = """m AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN 'user' ELSE role END AS role,
CASE WHEN conv_id % 11 = 0 AND turn = 2 THEN '  ' ELSE text END AS text FROM conversations)"""
