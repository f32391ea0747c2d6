"""Which seeds to generate from: filters, caps, lookups and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free
from ..functions.text import or_default, safe_id

SMALL_KEYS = 1000  # ids that are a filter; beyond, they are a join
MOST_BROADCAST = 1 << 20  # rows of a lookup table that may be broadcast


def lookup(df: DataFrame, known_rows: int | None = None) -> DataFrame:
    """A lookup side, broadcast only where its known number of rows is small; otherwise
    Spark's own thresholds decide."""
    return F.broadcast(df) if known_rows is not None and known_rows <= MOST_BROADCAST else df


def only_ids(df: DataFrame, key: str, ids: list[str] | None) -> DataFrame:
    """Rows of some ids; all for None."""
    if ids is None:
        return df
    if len(ids) <= SMALL_KEYS:
        return df.where(F.col(key).isin(ids))
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} STRING")
    return df.join(wanted, key, "left_semi")


def opening(rewritten: Column, prompt_text: Column) -> Column:
    """The opening message; an empty string counts as missing."""
    return or_default(rewritten, prompt_text, "")


def with_status(seeds: DataFrame, text: str, done: Column) -> DataFrame:
    """Status of each seed: skipped where its text is empty or its output exists."""
    return seeds.withColumn("status", F.when(F.coalesce(F.col(text), F.lit("")) == "", "empty").when(done, "exists").otherwise("todo"))


def top_n_per_key(df: DataFrame, key: str, order: list, n: int | None) -> DataFrame:
    """The first n rows of each key, sorted by key and order; all in their order without n.

    row_number with a bound becomes a group limit before the shuffle.
    """
    if not n:
        return df
    [number] = free(df, "_n")
    at = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(number, F.row_number().over(at)).where(F.col(number) <= n).drop(number)


def without_results(sessions: DataFrame, results: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Sessions whose key has no result yet; a missing key part is an empty one."""
    keys = [F.coalesce(F.col(c), F.lit("")).alias(f"_k{i}") for i, c in enumerate(right)]
    done = results.select(*keys).distinct()
    match = [F.coalesce(sessions[c], F.lit("")) == done[f"_k{i}"] for i, c in enumerate(left)]
    return sessions.join(done, match, "left_anti")


def of_tier(sessions: DataFrame, results: DataFrame, tier: str = "A", left: tuple = ("persona_id", "prompt_id"), right: tuple = ("persona_id", "scenario_id")) -> DataFrame:
    """Sessions that a result puts into a tier."""
    keys = results.where(F.col("tier") == tier).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(right)]).distinct()
    return sessions.join(keys, [sessions[c] == keys[f"_k{i}"] for i, c in enumerate(left)], "left_semi")


def without_outputs(seeds: DataFrame, outputs: DataFrame, key: str, raw_key: bool = True) -> DataFrame:
    """Seeds without an output yet. Keys are compared as they are; ``raw_key=False`` compares
    them as file names, where two ids may fall together."""
    name = F.col(key) if raw_key else safe_id(F.col(key))
    done = outputs.select(F.col(key).alias("_done") if raw_key else safe_id(F.col(key)).alias("_done")).distinct()
    return seeds.withColumn("_name", name).join(done, F.col("_name") == F.col("_done"), "left_anti").drop("_name")


def scenarios_of(personas: DataFrame, scenarios: str, cap: int | None = None) -> DataFrame:
    """A row for each persona's scenario, in order, at most ``cap`` for each."""
    items = F.slice(scenarios, 1, cap) if cap else F.col(scenarios)
    return personas.select("*", F.posexplode(items).alias("pos", "scenario")).drop(scenarios)


def scenario_ids(persona: Column, pos: Column, scenario_id: Column, prefix: Column | str) -> Column:
    """A scenario's id: a default by position, the persona filled in, the prefix in front."""
    base = or_default(scenario_id, F.concat(persona, F.lit("_scenario_"), pos.cast("string")))
    filled = F.replace(base, F.lit("{persona_id}"), persona)
    front = F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("_"))
    return F.when(filled.startswith(front), filled).otherwise(F.concat(front, filled))


def by_path(df: DataFrame, path: str, n: int | None = None) -> DataFrame:
    """In order of path components, the first n."""
    out = df.orderBy(F.split(F.col(path), "/"))
    return out.limit(n) if n else out


def first_items(items: DataFrame, place: str, n: int | None = None) -> DataFrame:
    """The items at the first n places (counted from 0); all for None or 0."""
    return items.where(F.col(place) < n) if n else items


def counts_by_status(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))
