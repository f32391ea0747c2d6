"""Mixture-controlled packing by deficit round-robin over source queues.

1. Texts are tokenised once; ids go to a table in the shared folder. Each row knows its
   queue (source), its partition of that table and the queue's tokens before it there.
2. Sums for each (partition, queue) give every document its place in its queue. They are
   small and stay in Spark.
3. The sequences are dealt with in runs of ``RUN`` windows. Where a run starts in each queue
   follows in closed form from the weights (integers of any size, so it is exact), and with
   it the deficit carried into the run. Inside a run every window credits each queue with
   its share, serves whole tokens, and carries the rest: so every full window holds the
   target proportions to about a token. A queue that is empty gets no more credit.
4. Each row's task works out the runs it touches and cuts its document; no ids are shuffled.

By default the target proportions are those of the corpus, so all queues end together.
Every window is full. The last, partial one becomes sequences of powers of two in length,
which need no padding.

A source with at least ``1 / LARGE`` of all tokens, or a weight of its own, has its own queue.
All others share one queue, in which each advances in proportion: its documents are ordered
by how much of their source lies before their middle. So windows hold every source's target
proportion, to a token for large sources and to a document for small ones, whatever the number
of sources; only documents of small sources are shuffled, once.

Null texts are empty: their only id is the end mark. A null source counts as the empty name.
Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_path, default_ranks, encoder
from .kit import in_batches, pieces, small_side, written

WINDOW = 2048
END = 1
RUN = 512
LARGE = 512  # a source has its own queue from this share of all tokens on
SCALE = 96  # bits of the clock


class Schedule:
    """Where each window of each run begins in every queue."""

    def __init__(self, totals: list[int], weights: list[int] | None = None, window: int = WINDOW):
        self.totals, self.window = totals, window
        self.weights = weights or [max(1, t) for t in totals]
        self.total = sum(totals)
        self.runs = -(-self.total // (window * RUN))
        self.cut = lru_cache(4096)(self._cut)
        self.windows = lru_cache(64)(self._windows)

    def _served(self, clock: int) -> list[int]:
        """Tokens of each queue before a time; token x of a queue is due at (x + 1/2) / weight."""
        half = 1 << (SCALE - 1)
        return [min(t, (clock * w + half) >> SCALE) for t, w in zip(self.totals, self.weights)]

    def _cut(self, run: int) -> tuple[list[int], list[float]]:
        """Tokens of each queue before a run, and the deficits carried into it."""
        want = min(run * RUN * self.window, self.total)
        low, high = 0, (max(-(-t // w) for t, w in zip(self.totals, self.weights)) + 1) << SCALE
        while high - low > 1:
            mid = (low + high) // 2
            if sum(self._served(mid)) < want:
                low = mid
            else:
                high = mid
        out, after = self._served(low), self._served(high)
        left = want - sum(out)
        for i in range(len(out)):  # tokens due at the same time, in order of the queues
            more = min(left, after[i] - out[i])
            out[i] += more
            left -= more
        owed = [0.0 if o >= t else ((high * w >> (SCALE - 20)) - (o << 20)) / (1 << 20) for o, t, w in zip(out, self.totals, self.weights)]
        return out, owed

    def _windows(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """For each queue its cumulative tokens by window (one value more than windows), and
        the offset of its tokens inside each window."""
        begin, deficit = self.cut(run)
        left = np.array(self.cut(run + 1)[0], np.int64) - np.array(begin, np.int64)
        begin, deficit = np.array(begin, np.int64), np.array(deficit)
        share = np.array([float(w) for w in self.weights])
        served = []
        while left.sum():
            room = int(min(self.window, left.sum()))
            deficit = np.where(left > 0, deficit + room * share / share[left > 0].sum(), 0.0)
            give = np.clip(np.floor(deficit), 0, left).astype(np.int64)
            while (gap := room - int(give.sum())) != 0:
                ready = np.flatnonzero(give < left if gap > 0 else give > 0)
                order = ready[np.argsort((deficit - give)[ready] * (-1 if gap > 0 else 1), kind="stable")]
                give[order[: abs(gap)]] += 1 if gap > 0 else -1
            deficit -= give
            left -= give
            served.append(give)
        served = np.array(served).reshape(-1, len(begin))
        reach = np.concatenate([begin[None], begin + np.cumsum(served, 0)])
        return np.ascontiguousarray(reach.T), np.ascontiguousarray((np.cumsum(served, 1) - served).T)

    def run_of(self, queue: int, x: int, near: int) -> int:
        """The run that serves token x of a queue."""
        for run in (near, near + 1):
            if run < self.runs and self.cut(run)[0][queue] <= x < self.cut(run + 1)[0][queue]:
                return run
        low, high = 0, self.runs
        while high - low > 1:
            mid = (low + high) // 2
            if self.cut(mid)[0][queue] <= x:
                low = mid
            else:
                high = mid
        return low

    def tail(self) -> list[tuple[int, int]]:
        """(start, length) of the sequences that the last, partial window becomes."""
        rest, out, at = self.total % self.window, [], 0
        while rest:
            size = 1 << (rest.bit_length() - 1)
            out.append((at, size))
            at += size
            rest -= size
        return out

    def cuts(self, queue: int, x: int, n: int, near: int) -> tuple[np.ndarray, int]:
        """Pieces (start, length, sequence, offset) of n tokens from x on, and the last run."""
        out, done, run = [], 0, near
        full = self.total // self.window
        while done < n:
            run = self.run_of(queue, x + done, run)
            reach, inside = self.windows(run)
            column = reach[queue]
            a = int(column.searchsorted(x + done, "right")) - 1
            b = int(column.searchsorted(x + n, "left"))
            begin = np.maximum(column[a:b], x + done)[: len(column) - 1 - a]
            size = np.minimum(column[a + 1 : b + 1], x + n) - begin[: len(column[a + 1 : b + 1])]
            part = np.empty((len(size), 4), np.int64)
            part[:, 0], part[:, 1] = begin - x, size
            part[:, 2] = np.arange(run * RUN + a, run * RUN + a + len(size))
            part[:, 3] = inside[queue, a : a + len(size)] + begin - column[a : a + len(size)]
            out.append(part[size > 0])
            done += int(size.sum())
        out = np.concatenate(out) if len(out) > 1 else out[0]
        if out[-1, 2] == full:  # the partial window: cut at powers of two
            start, size, _, offset = out[-1].tolist()
            tail = [(start + max(offset, at) - offset, min(offset + size, at + length) - max(offset, at), full + k, max(offset, at) - at) for k, (at, length) in enumerate(self.tail()) if max(offset, at) < min(offset + size, at + length)]
            out = np.concatenate([out[:-1], np.array(tail, np.int64)])
        return out, run


def tokenized(docs: DataFrame, key: str, text: str, source: str, path: str, ranks: str | None) -> DataFrame:
    """The token table: key, source, part, before (the source's tokens before it in the part),
    n and ids (little-endian, of the width that the vocabulary needs)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("text"))
    schema = rows.select("key", "source").schema.add("part", "long").add("before", "long").add("n", "long").add("ids", "binary")

    def run(batches):
        bpe = encoder(path, ranks)
        part = TaskContext.get().partitionId()
        before: dict[str, int] = {}
        end = np.array([END], bpe.dtype)
        for batch in batches:
            for piece, buf, off in pieces(batch, "text"):
                ids = [np.append(x, end) for x in bpe.encode(buf, off)]
                start = []
                for q, x in zip(piece.column("source").to_pylist(), ids):
                    start.append(before.get(q, 0))
                    before[q] = start[-1] + len(x)
                columns = [piece.column("key"), piece.column("source"), pa.array([part] * len(ids), pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return written(in_batches(rows, run, schema), "tokens")


def bases(rows: DataFrame, by: str) -> DataFrame:
    """(by, part, base): tokens of each group before each part, from rows with n."""
    ahead = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(rows.groupBy("part", by).agg(F.sum("n").alias("sum")), "parts")
    return parts.select("part", by, F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base"))


def interleaved(small: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows of small sources as one queue, each source advancing in proportion: ordered by the
    share of their source before their middle, which a range partitioning spreads over tasks."""
    placed = small.join(small_side(totals), "source")
    placed = placed.join(small_side(bases(small, "source")), ["source", "part"])
    done = (F.col("base") + F.col("before") + F.col("n") / 2) / F.col("sum")
    ordered = placed.select("key", "source", "n", "ids", done.alias("done"), F.xxhash64("source").alias("tie"), (F.col("base") + F.col("before")).alias("x"))
    ordered = ordered.repartitionByRange("done", "tie", "x").sortWithinPartitions("done", "tie", "x", "source")
    kept = ordered.select("key", "source", "n", "ids")
    schema = kept.select("key", "source").schema.add("part", "long").add("before", "long").add("n", "long").add("ids", "binary")

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("source"), pa.array([part] * len(n), pa.int64()), pa.array(ends - n, pa.int64()), batch.column("n"), batch.column("ids")], names=schema.names)
            before = int(ends[-1]) if len(ends) else before

    return written(in_batches(kept, run, schema), "small")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str, float] | None = None, window: int = WINDOW, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue (the source).

    ``weights`` are the target proportions of the sources; those left out get 1 % of the mean.
    """
    if path is None:
        path, ranks = default_path(), default_ranks()
    tokens = tokenized(docs, key, text, source, path, ranks)
    totals = written(tokens.groupBy("source").agg(F.sum("n").alias("sum")), "totals")
    total = totals.agg(F.coalesce(F.sum("sum"), F.lit(0))).first()[0]
    large = F.col("sum") * LARGE >= total
    if weights:
        large = large | F.col("source").isin(*weights)
    own = {r.source: r.sum for r in totals.where(large).orderBy("source").collect()}  # LARGE and the weighted ones at most
    n_small, rest = totals.where(~large).agg(F.count("*"), F.coalesce(F.sum("sum"), F.lit(0))).first()
    number = F.create_map(*[F.lit(x) for q, i in zip(own, range(len(own))) for x in (q, i)]) if own else F.create_map().cast("map<string, int>")
    numbered = tokens.withColumn("queue", number[F.col("source")])
    queued = numbered.where("queue IS NOT NULL")
    if n_small:
        small = interleaved(numbered.where("queue IS NULL").drop("queue"), totals.where(~large))
        queued = queued.unionByName(small.withColumn("queue", F.lit(len(own))))
    counts = [*own.values(), *([rest] if n_small else [])]
    wanted = None
    if weights:
        least = sum(weights.values()) / len(weights) / 100
        shares = [weights.get(q, least) for q in own] + ([least * n_small] if n_small else [])
        wanted = [max(1, round(x / sum(weights.values()) * (1 << 40))) for x in shares]
    placed = queued.join(small_side(bases(queued, "queue")), ["part", "queue"]).select("key", "source", "queue", (F.col("base") + F.col("before")).alias("x"), "n", "ids")
    schema = placed.select(F.col("key").alias(key), *[F.lit(0).cast("bigint").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], F.col("source").alias("queue")).schema
    wide = "<u4"
    width = 2 if encoder(path, ranks).dtype.itemsize == 2 else 4

    def run(batches):
        schedule = Schedule(counts, wanted, window)
        near = [0] * len(counts)
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(c).to_pylist() for c in ("queue", "x", "n")}
            made, owner, crc = [], [], []
            for i, (q, x, n) in enumerate(zip(col["queue"], col["x"], col["n"])):
                ids = memoryview(np.frombuffer(batch.column("ids")[i].as_buffer(), f"<u{width}").astype(wide)).cast("B")
                got, near[q] = schedule.cuts(q, x, n, near[q])
                made.append(got)
                owner.append(len(got))
                a = (4 * got[:, 0]).tolist()
                crc += [zlib.crc32(ids[u:v]) for u, v in zip(a, a[1:] + [4 * n])]
            table = np.concatenate(made)
            at = pa.array(np.repeat(np.arange(len(owner)), owner))
            columns = [batch.column("key").take(at), table[:, 0], table[:, 1], crc, batch.column("n").take(at), table[:, 2], table[:, 3], batch.column("source").take(at)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=schema.names)

    return in_batches(placed, run, schema)
