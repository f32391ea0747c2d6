"""The standard library's seeded draws over tables of any length.

``random.Random(seed)`` is a Mersenne Twister whose words numpy gives at the speed of C. A draw
below a bound takes as many bits as the bound has, and takes the next word where they reach it;
so where a draw begins in the stream depends on all before it.

``shuffle_order`` is a whole shuffle: the draws are found in runs of equal width, and the swaps
are resolved by following, for each place, the step that wrote to it last. It holds some 40
bytes a row in one task (10**7 rows: 400 MB); rows are then joined by their place.

``item_orders`` draws for each item of a table. The places at which items begin in the stream
are counted first, from the items' sizes alone; then every task starts from the snapshot of the
generator that lies before its first item.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.names import free
from ..sources.shared import written

SNAPSHOT = 1 << 20  # words between two snapshots of a generator
MOST = 1 << 32


def generator(seed: int) -> np.random.MT19937:
    """A bit generator in the state of ``random.Random(seed)``."""
    *key, place = random.Random(seed).getstate()[1]
    return restored(np.array(key, np.uint32), place)


def restored(key: np.ndarray, place: int) -> np.random.MT19937:
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": place}}
    return out


class Stream:
    """Words of a generator, of which some can be looked at without being used up."""

    def __init__(self, bits: np.random.MT19937):
        self.bits, self.held, self.used, self.before = bits, np.zeros(0, np.uint64), 0, 0

    @property
    def taken(self) -> int:
        """Words used up so far."""
        return self.before + self.used

    def ahead(self, n: int) -> np.ndarray:
        if self.used + n > len(self.held):
            self.before += self.used
            self.held = np.concatenate([self.held[self.used :], self.bits.random_raw(max(n, 4096))])
            self.used = 0
        return self.held[self.used : self.used + n]

    def below(self, bound: int) -> int:
        shift = np.uint64(32 - bound.bit_length())
        while True:
            value = int(self.ahead(1)[0] >> shift)
            self.used += 1
            if value < bound:
                return value


def shuffle_draws(n: int, stream: Stream) -> np.ndarray:
    """For each i from n - 1 to 1 the draw below i + 1, by i (0 at 0)."""
    if n > MOST:
        raise ValueError("a shuffle takes fewer than 2**32 rows")
    out, i = np.zeros(n, np.int64), n - 1
    while i > 0:
        bound = i + 1
        width = bound.bit_length()
        left = min(i, bound - (1 << (width - 1)) + 1)  # draws of this width
        r = (stream.ahead(1 << max(6, width // 2 + 1)) >> np.uint64(32 - width)).astype(np.int64)
        # The bound falls by one with each draw, so few words depend on how many came before.
        taken = r < bound - len(r)
        before = np.cumsum(taken) - taken
        more = 0
        for p in np.flatnonzero((r < bound) & ~taken).tolist():
            if r[p] < bound - before[p] - more:
                taken[p] = True
                more += 1
        at = np.flatnonzero(taken)[:left]
        stream.used += int(at[-1]) + 1 if len(at) == left else len(r)
        out[i - np.arange(len(at))] = r[at]
        i -= len(at)
    return out


def shuffle_order(n: int, seed: int) -> np.ndarray:
    """``order`` with order[k] the place of the row that comes k-th: what
    ``random.Random(seed).shuffle`` makes of ``range(n)``.

    Step i (from n - 1 down) swaps places i and j. A place that no later step swapped out of
    holds what the last step before it wrote: that step's own place's content at its time.
    """
    if n < 2:
        return np.arange(n)
    j = shuffle_draws(n, Stream(generator(seed)))
    steps = np.argsort(j, kind="stable")  # by written place, then by step
    same = j[steps][1:] == j[steps][:-1]
    writer = np.full(n, -1, np.int64)  # the step before i that wrote to the place that i reads
    writer[steps[:-1][same]] = steps[1:][same]
    first = np.searchsorted(j[steps], np.arange(n))
    origin = np.arange(n)  # the step that wrote to place m last before step m; m itself if none
    some = np.append(j[steps], -1)[first] == origin
    origin[some] = steps[first[some]]
    own = some & (origin == np.arange(n))  # a step that swaps a place with itself is none
    origin[own] = np.where(writer[own] >= 0, writer[own], origin[own])
    while True:  # content of a place at its own step, step by step back to where it lay at first
        further = origin[origin]
        if (further == origin).all():
            break
        origin = further
    order = np.where(writer >= 0, origin[writer], j)
    order[own] = origin[own]
    itself = j == np.arange(n)
    order[itself] = origin[itself]
    return order


def numbered(df: DataFrame, *order: str) -> tuple[DataFrame, str]:
    """The rows in a written table with their place (from 0) in an order, and that column's
    name. Rows are range-partitioned and numbered where they lie, and the counts of the
    partitions before are added: ties and hot values are split, and no task has all rows."""
    at, salt, place = free(df, "at", "salt", "place")
    rows = df.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(*order, salt).sortWithinPartitions(*order, salt).drop(salt)
    rows = written(rows.withColumn(at, F.monotonically_increasing_id()), "placed")
    part = F.shiftright(at, 33)
    counts = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, table = 0, []
    for p in sorted(counts):
        table.append((p, before))
        before += counts[p]
    offsets = F.broadcast(df.sparkSession.createDataFrame(table, "part BIGINT, before BIGINT")).withColumnsRenamed(dict(zip(("part", "before"), free(df, "_part", "_before"))))
    p, b = offsets.columns
    out = rows.join(offsets, F.shiftright(at, 33) == F.col(p))
    return out.withColumn(place, F.col(b) + F.col(at).bitwiseAND((1 << 33) - 1)).drop(at, p, b), place


def told_apart(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows in a written table with a number of their own, and its name: an order can be
    found on narrow rows, and brought back in one join."""
    [row] = free(df, "_row")
    return written(df.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def places(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(place, position) of a shuffle of n rows, written by one task."""

    def run(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                order = shuffle_order(n, seed)
                for i in range(0, n, 1 << 16):
                    part = order[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.arange(i, i + len(part)), pa.int64())], names=["place", "position"])

    return written(spark.range(1).mapInArrow(run, "place BIGINT, position BIGINT"), "places")


def shuffled(df: DataFrame, order: str, seed: int, position: str = "position") -> DataFrame:
    """The rows with their position after the standard library's shuffle of them in ``order``."""
    rows, row = told_apart(df)
    narrow, place = numbered(rows.select(F.col(row).alias("row"), F.col(order).alias("order")), "order")
    made = narrow.join(places(df.sparkSession, narrow.count(), seed), place)
    return rows.join(made.select(F.col("row").alias(row), F.col("position").alias(position)), row).drop(row)


def bounds(size: int, kind: str) -> range:
    """The draws' bounds of a list: of the standard library's shuffle, or a sample of all."""
    return range(size, 1, -1) if kind == "shuffle" else range(size, 0, -1)


def drawn(size: int, kind: str, stream: Stream) -> list[int]:
    """The order that one item's draws give to ``range(size)``."""
    pool = list(range(size))
    if kind == "shuffle":
        for i in range(size - 1, 0, -1):
            j = stream.below(i + 1)
            pool[i], pool[j] = pool[j], pool[i]
        return pool
    out = []
    for i in range(size):
        j = stream.below(size - i)
        out.append(pool[j])
        pool[j] = pool[size - i - 1]
    return out


def starts(items: DataFrame, size: str, kind: str, seed: int) -> DataFrame:
    """(place, start): the word at which each item's draws begin. One task reads the sizes in
    order, as a stream; nothing else of the items goes there."""

    def run(batches):
        stream = Stream(generator(seed))
        for batch in batches:
            out = []
            for n in batch.column(1).to_pylist():
                out.append(stream.taken)
                for bound in bounds(n or 0, kind):
                    stream.below(bound)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["place", "start"])

    one = items.select(F.col("place"), F.col(size).alias("size")).repartition(1).sortWithinPartitions("place")
    return one.mapInArrow(run, "place BIGINT, start BIGINT")


def snapshots(seed: int, words: int) -> list[tuple[np.ndarray, int]]:
    """The generator's state after every SNAPSHOT words (2.5 KB each)."""
    bits, out = generator(seed), []
    for _ in range(words // SNAPSHOT + 1):
        state = bits.state["state"]
        out.append((state["key"].copy(), state["pos"]))
        bits.random_raw(SNAPSHOT, output=False)
    return out


def item_orders(items: DataFrame, order: str, size: str, seed: int, kind: str = "sample", name: str = "drawn") -> DataFrame:
    """The items with ``name``: for each an order of its ``size`` parts (0 for null), all from
    one seeded stream over the items in ``order``, in any partitioning. ``kind`` is ``sample``
    (of all parts) or ``shuffle``, which draw differently."""
    rows, place = numbered(items, order)
    begin = written(starts(rows.withColumnRenamed(place, "place"), size, kind, seed), "starts").withColumnsRenamed({"place": place})
    last = begin.agg(F.max("start")).first()[0]
    shared = items.sparkSession.sparkContext.broadcast((SNAPSHOT, snapshots(seed, last or 0)))
    [start] = free(rows, "start")
    held = rows.join(begin.withColumnRenamed("start", start), place).repartitionByRange(place).sortWithinPartitions(place)
    schema = StructType([*items.schema.fields, StructField(name, ArrayType(IntegerType()))])
    arrow, columns = to_arrow_schema(schema), items.columns

    def run(batches):
        step, states = shared.value
        stream, zero = None, 0  # the stream's words are counted from ``zero``
        for batch in batches:
            made = []
            for begin, n in zip(batch.column(start).to_pylist(), batch.column(size).to_pylist()):
                if stream is None or zero + stream.taken != begin:
                    block, rest = divmod(begin, step)
                    bits = restored(*states[block])
                    bits.random_raw(rest, output=False)
                    stream, zero = Stream(bits), begin
                made.append(drawn(n or 0, kind, stream))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in columns), pa.array(made, pa.list_(pa.int32()))], schema=arrow)

    return held.mapInArrow(run, schema)
