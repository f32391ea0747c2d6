"""Vectorised text kernels and Spark helpers shared by the operators of this subpackage.

Word rule (used wherever "word" appears): A-Z is lower-cased, and a word is a maximal run
of ``0-9``, ``a-z`` and every code point from U+0080 on. In UTF-8 that is a property of
single bytes, so words are found on raw bytes without decoding.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.names import free
from ..sources.shared import written

CHUNK_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the rolling-hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        for i, base in enumerate((_P, _P_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, rebased to 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch that hold at most ``limit`` bytes of text (one row at least)."""
    buf, off = utf8(batch.column(column))
    i, n = 0, len(off) - 1
    while i < n:
        j = min(i + 32768, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """Words of a run of texts: byte spans, owning text, and a 64-bit hash of each. ``inside``
    and ``fold`` give another rule of words: the bytes of which they consist, and their case."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, inside: np.ndarray = IS_WORD, fold: np.ndarray = LOWER):
        n = len(buf)
        self.buf, self.n_texts = buf, len(off) - 1
        m = inside[buf]
        before = np.zeros(n + 1, bool)
        before[1:] = m
        after = np.zeros(n + 1, bool)
        after[:n] = m
        before[off] = False
        after[off] = False
        self.start = np.flatnonzero(m & ~before[:n])
        self.end = np.flatnonzero(m & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, off)  # of each text, with the total last
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(self.n_texts), self.count)
        p, inv = powers(n)
        low = fold[buf]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
        self.low = low
        self.hash = mix((total[self.end] - total[self.start]) * inv[self.start])

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words, and the first shingle of each text (total last).

    A text of fewer words, but not none, has one shingle of all its words.
    """
    h, n = words.hash, len(words.hash)
    c = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out[: max(0, n - j)] += h[j:] * c[j]
    left = words.first[1:][words.text] - np.arange(n)  # words from here to the text's end
    keep = left >= k
    short = (words.count > 0) & (words.count < k)
    if short.any():
        at = words.first[:-1][short]
        for i, m in zip(at, words.count[short]):
            with np.errstate(over="ignore"):
                out[i] = (h[i : i + m] * np.array(c[:m])).sum(dtype=np.uint64) + np.uint64(m)
        keep[at] = True
    index = np.flatnonzero(keep)
    return mix(out[index]), np.searchsorted(index, words.first)


def per_text(values: np.ndarray, first: np.ndarray, op: np.ufunc, empty) -> np.ndarray:
    """``op`` reduced over each text's run of values; ``empty`` where the run is empty."""
    n = len(first) - 1
    out = np.full(n, empty, values.dtype)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = op.reduceat(values, first[:-1][full])
    return out


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Only the needed columns, so the scan reads no others; extra columns cannot clash."""
    return docs.select(key, text, *more)


def bucket(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``: the fold rule of the queries."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")




def release() -> None:
    """Give freed memory back to the system when a task ends: the worker process lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def small_batches(spark: SparkSession) -> SparkSession:
    """For applications, not operators: Arrow batches of documents hold a few megabytes, unless
    the user has set their size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow for rows that hold texts: memory is released when a task ends."""
    def released(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(released, schema)


def map_pieces(df: DataFrame, text: str, keep: list[str], fields: str, make: Callable, limit: int = CHUNK_BYTES) -> DataFrame:
    """Run a kernel over every text, a few hundred kilobytes at a time.

    ``make()`` is called once in each task and returns ``kernel(batch, buf, off) -> {field:
    values}``, one value for each row. ``keep`` columns pass through unchanged.
    """
    schema = StructType([df.schema[c] for c in keep] + StructType.fromDDL(fields).fields)
    arrow = to_arrow_schema(schema)
    names = schema.names[len(keep) :]

    def run(batches):
        kernel = make()
        for batch in batches:
            for part, buf, off in pieces(batch, text, limit):
                made = kernel(part, buf, off)
                columns = [part.column(c).cast(arrow.field(c).type) for c in keep]
                columns += [pa.array(made[c], arrow.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return in_batches(df, run, schema)


MOST_BROADCAST = 64 << 20


def small_side(df: DataFrame, limit: int = MOST_BROADCAST) -> DataFrame:
    """A written table, marked for broadcast only where its measured size allows it: its rows,
    each with the lengths of its strings and 16 bytes for every other field."""
    df = written(df, "side")
    width = [F.coalesce(F.octet_length(f.name), F.lit(0)) + 8 if f.dataType.simpleString() in ("string", "binary") else F.lit(16) for f in df.schema]
    size = df.agg(F.coalesce(F.sum(sum(width, F.lit(24))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``ids`` (one column); null keys stay. Texts are not
    shuffled while the ids to drop fit a broadcast."""
    gone = small_side(ids.toDF("_gone").where("_gone IS NOT NULL").distinct())
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, each with a number of its own, in a written table, and the name of that column
    (one that ``docs`` has not): decisions can be joined back whether ids are null, repeated or
    unique."""
    [number] = free(docs, "_number")
    return written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered"), number


PLACE = "_place"


def hash_share(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The rows, with their ``PLACE``, whose hash of ``columns`` (nulls are values too) is in a
    share of all hashes that holds n different ones almost surely. Callers drop repeated places,
    best when rows are narrow, so that the draw is the same in any partitioning and a row of very
    many copies is one row."""
    placed = rows.withColumn(PLACE, F.xxhash64(*columns))  # callers name their columns themselves
    different = placed.agg(F.approx_count_distinct(PLACE, 0.02)).first()[0]
    share = 1.1 * (n + 8 * n**0.5 + 50) / max(1, different)
    if share < 1:
        placed = placed.where(F.col(PLACE) < int(share * (1 << 64)) - (1 << 63))
    return placed


def first_places(rows: DataFrame, n: int) -> DataFrame:
    return rows.dropDuplicates([PLACE]).orderBy(PLACE).limit(n)


def hash_sample(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The n different rows of the least hashes (fewer if there are). A share of the hashes is
    filtered first, so that not every partition sends n rows of its own to the task that merges
    them."""
    return first_places(hash_share(rows, columns, n), n).drop(PLACE)


def keep_rows(docs: DataFrame, text: str, make: Callable) -> DataFrame:
    """The rows that a kernel keeps, with all columns, in the pass that reads them.
    ``make()`` is called once in each task and returns ``kernel(batch, buf, off) -> mask``."""

    def run(batches):
        kernel = make()
        for batch in batches:
            for part, buf, off in pieces(batch, text):
                yield part.filter(pa.array(kernel(part, buf, off)))

    return in_batches(docs, run, docs.schema)
