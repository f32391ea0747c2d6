"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of ``window`` consecutive words of a benchmark item is a pattern (an item of fewer
words, but not none, is one pattern). A block is two words. The shift table says, for the
block that ends a position, how far no pattern can end; zero leads to the bucket of patterns
with that suffix, whose window hash and then whose bytes are compared, for every pattern of an
equal hash. The cursors of many texts move in step, so each move is one numpy operation.

Patterns are places in the benchmark's own text, not strings of their own: a pass holds the
text and about 30 bytes for each of its words. Documents never move: passes of at most
``pass_bytes`` of benchmark text are broadcast, and only documents that several passes hit are
merged. ``keep_clean`` filters in the pass that reads the texts.

Null or empty texts have no words; null items and items without a word give no pattern; a
benchmark row with a null id is ignored. Repeated benchmark rows count once. Repeated
documents each get their row. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import CHUNK_BYTES, Words, keep_rows, map_pieces, written

WINDOW = 10
PASS_BYTES = 32 << 20  # of benchmark text in a pass; its matcher holds up to 16 times as much
BLOCK = np.uint64(0x9FB21C651E98DF25)
SEGMENT = 64
SLICE = 1 << 18  # patterns hashed at a time


class Bench:
    """Words of the benchmark's texts, taken some texts at a time: the fields of Words that
    matchers use."""

    def __init__(self, texts: list[bytes]):
        size = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        parts, i = [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(size, size[i] + CHUNK_BYTES, "right")) - 1)
            words = Words(np.frombuffer(b"".join(texts[i:j]), np.uint8), size[i : j + 1] - size[i])
            parts.append((words.low, words.hash, words.start + size[i], words.end + size[i], words.text + i, words.count))
            i = j
        self.low, self.hash, self.start, self.end, self.text, self.count = (np.concatenate(x) for x in zip(*parts))
        self.first = np.concatenate([[0], np.cumsum(self.count)])


class Matcher:
    """Wu-Manber tables for patterns of one length, in words, that start at given words."""

    def __init__(self, words: Bench, starts: np.ndarray, item: np.ndarray, names: list[str], m: int):
        self.m, self.width, self.names = m, min(2, m), names
        windows = np.lib.stride_tricks.sliding_window_view(words.hash, m)
        full = np.concatenate([self.window_hash(windows[starts[i : i + SLICE]]) for i in range(0, len(starts), SLICE)])
        order = np.argsort(full, kind="stable")
        self.full, self.starts, self.item = full[order], starts[order].astype(np.int32), item[order].astype(np.int32)
        self.text, self.begin, self.end = words.low, words.start.astype(np.int32), words.end.astype(np.int32)
        bits = max(12, int(4 * len(starts)).bit_length())
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, m - self.width + 1, np.int8 if m < 127 else np.int64)
        blocks = []
        for i in range(0, len(starts), SLICE):
            part = windows[starts[i : i + SLICE]]
            for j in range(m - self.width + 1):
                np.minimum.at(self.shift, self.block(part, j + self.width - 1) >> self.down, self.shift.dtype.type(m - self.width - j))
            blocks.append(np.unique(self.block(part, m - 1)))
        self.suffixes = np.unique(np.concatenate(blocks))

    def spelled(self, k: int) -> bytes:
        """Words of a pattern, with single blanks."""
        s = self.starts[k]
        return b" ".join(self.text[self.begin[j] : self.end[j]].tobytes() for j in range(s, s + self.m))

    @staticmethod
    def window_hash(h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint64)
        for j in range(h.shape[1]):
            out = (out ^ h[:, j]) * BLOCK
            out ^= out >> np.uint64(29)
        return out

    def block(self, h: np.ndarray, j: int) -> np.ndarray:
        out = h[:, j] * BLOCK
        return out if self.width == 1 else out + (h[:, j - 1] ^ BLOCK) * np.uint64(0xE7037ED1A0B428DB)

    def find(self, words: Words) -> list[tuple[int, list[str]]]:
        """(first word, items) of every confirmed occurrence."""
        h = words.hash
        lead, stop = words.first[:-1] + self.m - 1, words.first[1:]  # of window ends
        n = np.maximum(0, -(-(stop - lead) // SEGMENT))
        if not n.sum():
            return []
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(lead, n) + part * SEGMENT
        end = np.minimum(at + SEGMENT, np.repeat(stop, n))
        block = h * BLOCK
        if self.width == 2:
            block[1:] += (h[:-1] ^ BLOCK) * np.uint64(0xE7037ED1A0B428DB)
        candidates = []
        while len(at):
            move = self.shift[block[at] >> self.down]
            if len(hit := at[move == 0]):
                candidates.append(hit)
            at = at + np.maximum(move, 1)
            live = at < end
            at, end = at[live], end[live]
        if not candidates:
            return []
        ends = np.concatenate(candidates)
        ends = ends[np.isin(block[ends], self.suffixes)]  # the suffix buckets
        starts = np.sort(ends) - self.m + 1
        full = self.window_hash(h[starts[:, None] + np.arange(self.m)])
        low, high = np.searchsorted(self.full, full), np.searchsorted(self.full, full, "right")
        out = []
        for s, a, b in zip(starts[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
            found = b" ".join(words.word(j) for j in range(s, s + self.m))
            if items := {self.names[self.item[k]] for k in range(a, b) if self.spelled(k) == found}:
                out.append((s, items))
        return out


def compile_patterns(items: list[tuple[str, str]], window: int = WINDOW) -> list[Matcher]:
    """Matchers, one for each pattern length, of (item id, text) rows."""
    items = [(item, text) for item, text in dict.fromkeys(items) if text]
    if not items:
        return []
    words = Bench([text.encode("utf-8", "replace") for _, text in items])
    of = np.minimum(window, words.count)
    out = []
    for m in np.unique(of[of > 0]).tolist():
        place = np.arange(len(words.hash))
        starts = np.flatnonzero((of[words.text] == m) & (place + m <= words.first[1:][words.text]))
        out.append(Matcher(words, starts, words.text[starts], [item for item, _ in items], m))
    return out


def kernel(matchers: list[Matcher]):
    def run(batch, buf, off):
        words = Words(buf, off)
        edge = np.zeros(len(words.hash) + 1, np.int32)
        items: dict[int, set] = defaultdict(set)
        for matcher in matchers:
            for s, ids in matcher.find(words):
                edge[s] += 1
                edge[s + matcher.m] -= 1
                items[int(words.text[s])].update(ids)
        hit = np.zeros(len(edge), np.int64)
        hit[1:] = np.cumsum(np.cumsum(edge)[:-1] > 0)
        n_hit = hit[words.first[1:]] - hit[words.first[:-1]]
        spans: list[list] = [[] for _ in range(words.n_texts)]
        if items:
            covered = np.diff(hit)
            for t in items:
                a, b = words.first[t], words.first[t + 1]
                step = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b], [0]])))
                spans[t] = [{"start": int(x), "end": int(y)} for x, y in step.reshape(-1, 2)]
        return {"n_words": words.count, "n_hit": n_hit, "spans": spans, "items": [sorted(items[i] - {None}) if i in items else [] for i in range(words.n_texts)]}

    return run


def passes(benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, pass_bytes: int = PASS_BYTES):
    """Broadcast matchers of each pass over the benchmark, and whether there are more than one.
    One pass is compiled and held at a time, if its user writes what it made before going on."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // pass_bytes))
    for i in range(n):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).distinct().collect()  # about pass_bytes
        shared = spark.sparkContext.broadcast(compile_patterns([(r.item, r.text) for r in rows], window))
        yield shared, n > 1
        if n > 1:
            shared.unpersist()


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, hit word ``spans`` and the ids (as text) of ``items``.
    Items without an id hit like others; ``items`` does not name them."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    fields = "n_words BIGINT, n_hit BIGINT, spans ARRAY<STRUCT<start: BIGINT, end: BIGINT>>, items ARRAY<STRING>"
    found: list[DataFrame] = []
    for shared, more in passes(benchmark, text, item, window, pass_bytes):
        if not more:
            return map_pieces(docs, "text", ["key"], fields, lambda shared=shared: kernel(shared.value)).withColumnRenamed("key", key)
        if not found:  # repeated rows need a number of their own to merge the passes of each
            docs = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        made = map_pieces(docs, "text", ["_row", "key"], fields, lambda shared=shared: kernel(shared.value))
        found.append(written(made.where("n_hit > 0") if found else made, "pass"))
    first, rest = found[0], found[1].where("n_hit > 0")
    for part in found[2:]:
        rest = rest.unionByName(part)
    rest = rest.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    both = first.join(written(rest, "passes"), "_row", "left")
    whole = F.array_sort(F.concat("spans", F.coalesce("s", F.array().cast(first.schema["spans"].dataType))))
    # Overlapping and neighbouring spans become one, as within a pass.
    last = lambda a: F.element_at(a, -1)
    joined = F.aggregate(whole, F.array().cast(first.schema["spans"].dataType), lambda a, x: F.when((F.size(a) > 0) & (last(a)["end"] >= x["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x))))
    both = both.withColumn("spans", F.when(F.col("s").isNull(), F.col("spans")).otherwise(joined))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i", F.array().cast("array<string>")))))
    return both.select(F.col("key").alias(key), "n_words", hit.alias("n_hit"), "spans", items.alias("items"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of op8: counts and a digest of the items whose windows occur."""
    return found.select(key, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns. Rows
    are dropped in the passes that read them, so each goes by its own text, whatever its id.
    Each of several passes writes what it keeps, so a task holds one pass's matchers."""
    for shared, more in passes(benchmark, text, pass_bytes=pass_bytes):

        def make(shared=shared):
            run = kernel(shared.value)
            return lambda batch, buf, off: run(batch, buf, off)["n_hit"] == 0

        docs = keep_rows(docs, text, make)
        if more:
            docs = written(docs, "clean")
    return docs
