"""A corpus as a whole: duplicates, order and composition."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import free
from ..sources.shared import written
from .selection import lookup
from .seeded import numbered, told_apart

WINDOW = 256  # rows that a look ahead takes in
STRETCH = 1 << 16  # rows of an order that one task goes over
FAN = 256  # digests that are hashed together


def keep_first(df: DataFrame, key: Column | str, order: str) -> DataFrame:
    """Of equal keys the row that comes first."""
    [n] = free(df, "_n")
    at = Window.partitionBy(key).orderBy(order)
    return df.withColumn(n, F.row_number().over(at)).where(F.col(n) == 1).drop(n)


def duplicate_pairs(df: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """(first, duplicate) positions; the first ``limit`` of them where a report wants few.

    Keys are aggregated before they are shuffled, and only repeated ones are joined back, so a
    key with very many copies is a join that can be split and no window of its own.
    """
    rows = df.select(F.col(key).alias("key"), F.col(order).alias("duplicate"))
    first = rows.groupBy(F.col("key").alias("k")).agg(F.min("duplicate").alias("first"), F.count("*").alias("n")).where("n > 1")
    out = rows.join(first, rows["key"].eqNullSafe(first["k"])).where("first <> duplicate").select("first", "duplicate")
    return out.orderBy("duplicate").limit(limit) if limit else out


def is_distinct(df: DataFrame, key: Column | str) -> DataFrame:
    return df.agg((F.count_distinct(key) == F.count("*")).alias("is_distinct"))


def canonical_json(raw: str | Column, path: str = "$") -> Column:
    """A part of a JSON text with sorted keys and no blanks, all its fields kept; null where the
    text has no such part. Equal for equal values."""
    return F.to_json(F.try_variant_get(F.try_parse_json(raw), path, "variant"))


def canonical(messages: str | Column) -> Column:
    """Messages as JSON with sorted keys and no blanks: equal for equal messages."""
    items = F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    return F.to_json(items)


def adjacent_matches(df: DataFrame, order: str | list, fields: list[str]) -> DataFrame:
    """For each field, how often a row's value (not null) is that of the row before it.

    One global window would be one task. Rows are range-partitioned by position instead;
    neighbours inside a partition are compared there, and the few rows at partition edges
    are compared in a second, small window.
    """
    order = [order] if isinstance(order, str) else order
    rows = df.select(*order, *fields).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(*order)
    lagged = rows.select(*fields, "_part", *order, *[F.lag(f).over(inside).alias(f"_{f}") for f in fields], F.row_number().over(inside).alias("_i"))
    hit = lambda f, g: F.coalesce((F.col(f) == F.col(g)) & F.col(f).isNotNull(), F.lit(False))
    edge = [x for f in fields for x in (F.min_by(f, "_i").alias(f"first_{f}"), F.max_by(f, "_i").alias(f"last_{f}"))]
    parts = lagged.groupBy("_part").agg(*[F.count_if(hit(f, f"_{f}")).alias(f"n_{f}") for f in fields], *edge)
    across = Window.orderBy("_part")  # a row for each partition
    parts = parts.select("*", *[F.lag(f"last_{f}").over(across).alias(f"before_{f}") for f in fields])
    return parts.agg(*[F.coalesce(F.sum(F.col(f"n_{f}") + hit(f"first_{f}", f"before_{f}").cast("bigint")), F.lit(0)).alias(f) for f in fields])


def seeded_place(seed: int, key: Column) -> Column:
    """The place of a key in the seeded hash order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)


def numbered_in(df: DataFrame, groups: list[str], order: list[str], number: str, size: str) -> DataFrame:
    """The rows with their number (from 0) in an order within their group, and the group's size.
    All rows are numbered in one order of groups, and each group's first number is taken off, so
    a group of any size, and any number of ties, is spread over tasks."""
    rows, place = numbered(df, *groups, *order)
    names = free(rows, *[f"_g{i}" for i in range(len(groups))], "_first")
    firsts = written(rows.groupBy(*[F.col(g).alias(x) for g, x in zip(groups, names)]).agg(F.min(place).alias(names[-1]), F.count("*").alias(size)), "groups")
    match = [rows[g].eqNullSafe(firsts[x]) for g, x in zip(groups, names)]
    out = rows.join(lookup(firsts, firsts.count()), match) if groups else rows.crossJoin(F.broadcast(firsts))
    return out.withColumn(number, F.col(place) - F.col(names[-1])).drop(place, *names)


def interleaved(df: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """Position in an order that keeps a group's rows apart: every group's first row in
    seeded hash order, then every second row, and so on.

    A group of any size is cut by the first digits of its places, which keep their order: rows
    are numbered within a cut, and the counts of the group's cuts before it are added. Keys are
    ids: rows of one repeated key share a cut (``declustered`` has no such bound).
    """
    if {"place", "round", "_cut", "_group", "_c", "_before", "_i"} & {c.lower() for c in df.columns}:
        raise ValueError("rename columns that are called place, round, _cut, _group, _c, _before or _i")
    place = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    rows = df.withColumn("place", place).withColumn("_cut", F.substring("place", 1, 3))  # 4,096 cuts
    cuts = rows.groupBy(F.col(group).alias("_group"), F.col("_cut").alias("_c")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(group, "_cut").orderBy("place", key)
    rows = rows.withColumn("_i", F.row_number().over(within))
    rows = rows.join(cuts, rows[group].eqNullSafe(cuts["_group"]) & (F.col("_cut") == F.col("_c")))
    return rows.withColumn("round", F.col("_before") + F.col("_i")).drop("_cut", "_group", "_c", "_before", "_i")


def proportional(df: DataFrame, fields: list[str], key: str, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """The rows with two more columns, ``share`` and ``mark``, by which, and then by the key, an
    order mixes all combinations of the fields evenly: row i of a combination of n (in seeded hash
    order) comes at (i + 1/2) / n of the way. Every stretch of the order has about the same
    mixture as the whole. Also the names of the columns of that order."""
    number, size, share, mark = free(df, "_i", "_n", "share", "mark")
    out = numbered_in(df.withColumn(mark, seeded_place(seed, F.col(key))), fields, [mark, key], number, size)
    out = out.withColumn(share, (F.col(number).cast("double") + 0.5) / F.col(size))
    return out.drop(number, size), [share, mark, key]


def shared(a: tuple | None, b: tuple | None) -> int:
    """How many fields (not null) have the same value."""
    return sum(x is not None and x == y for x, y in zip(a, b)) if a and b else 0


def look_ahead(rows: list[tuple], before: tuple | None, window: int, fixed: bool = True) -> list[int]:
    """An order of the rows: always the first of the next ``window`` that shares the fewest
    values with the one before it. A ``fixed`` last row stays the last. What is left over at the end
    shares values with its neighbours; each such row moves back to where it shares fewer, if there
    is such a place among the ``window`` before it."""
    last, out, ahead, following = before, [], [], iter(range(len(rows) - fixed))
    ahead = [i for _, i in zip(range(window), following)]
    while ahead:
        best, least = 0, None
        for at, i in enumerate(ahead):
            shares = shared(last, rows[i])
            if least is None or shares < least:
                best, least = at, shares
                if not shares:
                    break
        out.append(ahead.pop(best))
        last = rows[out[-1]]
        ahead += [i for _, i in zip(range(1), following)]
    if fixed:
        out.append(len(rows) - 1)
    value = lambda p: before if p < 0 else rows[out[p]] if p < len(out) else None
    for p in range(1, len(out) - fixed):
        row = value(p)
        gain = shared(value(p - 1), row) + shared(row, value(p + 1)) - shared(value(p - 1), value(p + 1))
        if gain <= 0:
            continue
        for q in range(p - 1, max(-1, p - 1 - window), -1):  # between q - 1 and q
            if shared(value(q - 1), row) + shared(row, value(q)) - shared(value(q - 1), value(q)) < gain:
                out.insert(q, out.pop(p))
                break
    return out


def declustered(df: DataFrame, fields: list[str], key: str, seed: int = 0, window: int = WINDOW, position: str = "position") -> DataFrame:
    """``position`` (from 0) of each row in an order of the whole corpus in which neighbours share
    few values of the fields, as far as a look ahead of ``window`` rows can find.

    Combinations are mixed in proportion first; so every stretch of STRETCH rows can be gone
    over by itself, with a look ahead, and no field runs out before the end. A stretch's last row
    stays its last, and the next stretch starts from it, so the edges fit too. Tasks hold hashes
    of one stretch's fields; where a row stands decides, and never a group's size. The order is
    found on these narrow rows; the rows themselves are written and joined once."""
    rows, row = told_apart(df)
    codes = [F.when(F.col(f).isNotNull(), F.xxhash64(f)).alias(f"f{i}") for i, f in enumerate(fields)]
    mixed, order = proportional(rows.select(F.col(row).alias("row"), F.col(key).alias("key"), *codes), [f"f{i}" for i in range(len(fields))], "key", seed)
    mixed, place = numbered(mixed, *order)
    narrow = mixed.select("row", F.col(place).alias("place"), *[f"f{i}" for i in range(len(fields))]).withColumn("stretch", F.floor(F.col("place") / STRETCH))
    ends = narrow.where(F.col("place") % STRETCH == STRETCH - 1).withColumn("stretch", F.col("stretch") + 1)
    names, step, final = [f"f{i}" for i in range(len(fields))], STRETCH, (narrow.count() - 1) // STRETCH

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        at = table.column("place").to_pylist()
        values = list(zip(*(table.column(c).to_pylist() for c in names))) or [()] * len(at)
        stretch = table.column("stretch")[0].as_py()
        first = stretch * step
        held = at[0] < first  # the row before the stretch
        if held and len(at) == 1:
            return pa.table({"row": pa.array([], pa.int64()), "position": pa.array([], pa.int64())})
        order = look_ahead(values[held:], values[0] if held else None, window, stretch < final)
        number = table.column("row").to_pylist()
        return pa.table({"row": pa.array([number[held + i] for i in order], pa.int64()), "position": pa.array(range(first, first + len(order)), pa.int64())})

    moved = written(narrow.unionByName(ends).groupBy("stretch").applyInArrow(run, "row BIGINT, position BIGINT"), "positions")
    return rows.join(moved.select(F.col("row").alias(row), F.col("position").alias(position)), row).drop(row)


def shuffled(keys: list, seed: int) -> list:
    """The permutation of the standard library's generator."""
    out = list(keys)
    random.Random(seed).shuffle(out)
    return out


def decluster(rows: list[dict], fields: list[str], seed: int, window: int = 256) -> list[dict]:
    """The exact sequential order: shuffle, then always the first row of the next ``window``
    that shares the fewest values with the last one taken."""
    rest = shuffled(rows, seed)
    if not fields or window <= 1:
        return rest
    out = rest[:1]
    ahead, following = rest[1 : 1 + window], iter(rest[1 + window :])
    while ahead:
        last = out[-1]
        shared = [sum(last.get(f) is not None and last.get(f) == row.get(f) for f in fields) for row in ahead]
        out.append(ahead.pop(shared.index(min(shared))))
        ahead += [row for row in [next(following, None)] if row is not None]
    return out


def reordered(df: DataFrame, group: str, order: str, fields: list[str], seed: int, window: int = 256) -> DataFrame:
    """Exact reordering of each bounded group (a shard of a corpus): adds ``position``.

    The order is sequential by definition, so a corpus is cut into shards that fit a task;
    ``interleaved`` is the order for a whole large corpus.
    """
    out = StructType(list(df.schema.fields)).add("position", "long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        records = [{"_at": i, **{f: None if pd.isna(v) else v for f, v in zip(fields, row)}} for i, row in enumerate(pdf[fields].itertuples(index=False))]
        at = [r["_at"] for r in decluster(records, fields, seed, window)]
        return pdf.iloc[at].assign(position=range(len(at)))

    return df.groupBy(group).applyInPandas(run, out)


def shares(df: DataFrame, label: str, floor: float = 3.0) -> DataFrame:
    """Count and percentage of each label; a text only from ``floor`` percent on."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    percent = (F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("percent")
    return counts.select(label, "n", percent).withColumn("shown", F.when(F.col("percent") >= floor, F.concat(F.format_number("percent", 1), F.lit("%"))))


def digests_above(level: DataFrame, fan: int = FAN) -> DataFrame:
    """(place, digest) of the next level of a tree: the SHA-256 of each ``fan`` digests in order."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), "")
    return level.groupBy(F.floor(F.col("place") / fan).alias("up")).agg(F.sha2(parts.cast("binary"), 256).alias("digest")).withColumnRenamed("up", "place")


def line_digest(line: str | Column) -> Column:
    """SHA-256 of a line; a null one is empty, so that each row has its digest in a tree."""
    line = F.col(line) if isinstance(line, str) else line
    return F.sha2(F.coalesce(line, F.lit("")).cast("binary"), 256)


def digest_root(level: DataFrame, fan: int = FAN) -> DataFrame:
    """(place, digest) of the one root of a tree over (place, digest), no row over none. There is
    a level at least, and as many as it takes until one digest is left."""
    while True:
        level = written(digests_above(level, fan), "digests")
        if len(level.limit(2).collect()) < 2:
            return level


def ordered_digest(df: DataFrame, place: str, line: str | Column, fan: int = FAN) -> str:
    """SHA-256 over lines in order, as a tree: each line's digest, then the digests of ``fan``
    digests in order, until one is left. Lines are hashed where they lie; only digests move, and
    another partitioning gives the same. ``place`` counts from 0 without gaps. Of no lines, the
    digest of nothing."""
    root = digest_root(df.select(F.col(place).alias("place"), line_digest(line).alias("digest")), fan).first()
    return root.digest if root else hashlib.sha256(b"").hexdigest()
