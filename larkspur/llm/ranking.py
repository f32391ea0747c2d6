"""Ranked lexical search by Fagin's threshold algorithm.

Terms are words of the kit's rule (A-Z lowered). Statistics cover all documents: N, how many
have a term; L, all their terms; df of each query term. A term's weight w is
floor(1000 ln((2N+2)/(2df+1))); with n terms in a document, m = 100-50+((50 n N) div L), and its
score is the sum of w * ((10**9 tf) div (1000 tf + 20 m)) over an item's different terms, in
64-bit integers.

1. One pass cuts all whole texts into terms and writes the forward index: for each document
   its number of terms, and the query terms that it holds with their counts. Words are found
   by their hash and compared byte by byte. The statistics are sums over that table.
2. Every task takes blocks of the forward index and sorts them into lists, one a term, by
   falling impact. For each item it goes down the lists of its terms side by side, some depths
   at a time; what it meets for the first time it scores by lookups in the forward index; it
   stops where the threshold, the sum of the impacts at this depth, falls strictly below the
   item's k-th best score. The k-th best goes along from block to block.
3. The k best of each task are merged by item. Before that, a first run over a share of the
   documents (1/``SHARE`` by hash of the row) gives each item's k-th best there, which no k-th
   best of the whole can fall below: every task starts from it, stops earlier, and sends only
   what reaches it. It drops no result.

Queries are taken in groups of at most ``GROUP_BYTES`` of text, each group with a run of its
own, so what is broadcast and sent is bounded.

Defined results: an item or document without a term (null, empty) has no row and does not count
in N; repeated rows, of items or documents, are rows of their own; equal scores are ordered by
id, rows without an id last. Ids of documents are integers. Scores of 0 are left out. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kit import Words, in_batches, pieces, release, utf8, written

TOP = 50
GROUP_BYTES = 8 << 20
BLOCK_TERMS = 1 << 19  # entries of the forward index that a task ranks at a time
SHARE = 32
FIRST_DEPTH = 64
LAST = np.iinfo(np.int64).max  # stands for a missing id, which comes last


def lanes(buf: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, little-endian; bytes beyond ``left`` are 0. ``buf`` has
    eight spare bytes at its end."""
    view = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
    width = np.clip(left, 0, 8).astype(np.uint64) * np.uint64(8)
    mask = np.where(width == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (width & np.uint64(63))) - np.uint64(1))
    return view[np.minimum(at, len(buf) - 8)] & mask


class Terms:
    """The different terms of a group of items, to be found in documents by number."""

    def __init__(self, texts: list[str]):
        spelled: dict[bytes, int] = {}
        self.items = []
        for text in texts:
            words = Words(*utf8(pa.array([text])))
            self.items.append(sorted({spelled.setdefault(words.word(i), len(spelled)) for i in range(len(words.hash))}))
        self.n = len(spelled)
        joined = Words(*utf8(pa.array([" ".join(w.decode() for w in spelled)])))  # in order of their numbers
        self.order = np.argsort(joined.hash, kind="stable")
        self.hash = joined.hash[self.order]
        self.length = joined.end - joined.start
        buf = np.concatenate([joined.low, np.zeros(8, np.uint8)])
        self.lanes = [lanes(buf, joined.start + 8 * j, self.length - 8 * j) for j in range(-(-int(self.length.max(initial=0)) // 8))]

    def number(self, words: Words) -> np.ndarray:
        """The term of each word, or -1."""
        out = np.full(len(words.hash), -1, np.int64)
        if not self.n or not len(out):
            return out
        at, open_ = np.searchsorted(self.hash, words.hash), np.arange(len(out))
        length = words.end - words.start
        buf = np.concatenate([words.low, np.zeros(8, np.uint8)])
        while len(open_):  # more than one round only where terms share a hash
            near = at < self.n
            near[near] = self.hash[at[near]] == words.hash[open_[near]]
            at, open_ = at[near], open_[near]
            if not len(open_):
                break
            term = self.order[at]
            same = length[open_] == self.length[term]
            for j, lane in enumerate(self.lanes):
                check = same & (length[open_] > 8 * j)
                if not check.any():
                    break
                w = open_[check]
                same[check] = lanes(buf, words.start[w] + 8 * j, length[w] - 8 * j) == lane[term[check]]
            out[open_[same]] = term[same]
            at, open_ = at[~same] + 1, open_[~same]
        return out


def counted(words: Words, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms that each text holds and their counts, text after text, and the first of each."""
    term = terms.number(words)
    at = np.flatnonzero(term >= 0)
    pair, n = np.unique(words.text[at] * max(1, terms.n) + term[at], return_counts=True)
    return pair % max(1, terms.n), n, np.searchsorted(pair, np.arange(words.n_texts + 1) * max(1, terms.n))


def forward(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n, terms, counts: the forward index, one row for each document with a term."""

    def run(batches):
        terms = shared.value
        for batch in batches:
            for part, buf, off in pieces(batch, "text"):
                words = Words(buf, off)
                term, n, first = counted(words, terms)
                some = pa.array(words.count > 0)
                first = pa.array(first, pa.int32())
                lists = [pa.ListArray.from_arrays(first, pa.array(x, pa.int32())) for x in (term, n)]
                made = [part.column("doc_id").cast(pa.int64()), pa.array(words.count, pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n", "terms", "counts"]).filter(some)

    return in_batches(docs, run, "doc_id BIGINT, n BIGINT, terms ARRAY<INT>, counts ARRAY<INT>")


class Statistics:
    """N, L and the weight of each term of a group."""

    def __init__(self, n_docs: int, n_terms: int, df: np.ndarray):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def statistics(index: DataFrame, n_terms: int) -> Statistics:
    n_docs, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_terms, np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row for each query term
        df[r.term] = r["count"]
    return Statistics(n_docs, total, df)


class Block:
    """Documents of the forward index, with a list of each term by falling impact."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, term: np.ndarray, count: np.ndarray, first: np.ndarray, stats: Statistics):
        self.ids, self.first, self.term = ids, first, term
        m = 100 - 50 + (50 * n * stats.n_docs) // max(1, stats.n_terms)
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        self.impact = stats.weight[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m[doc]))
        order = np.lexsort((-self.impact, term))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.start = np.searchsorted(term[order], np.arange(len(stats.weight) + 1))
        self.met = np.zeros(len(ids), bool)
        self.asked = np.zeros(len(stats.weight), bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Lookups in the forward index: the sum of the asked terms' impacts."""
        n = self.first[docs + 1] - self.first[docs]
        at = np.repeat(self.first[docs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        hit = self.asked[self.term[at]]
        return np.bincount(np.repeat(np.arange(len(docs)), n)[hit], self.impact[at][hit].astype(np.float64), len(docs)).astype(np.int64)  # sums stay below 2**53

    def search(self, terms: np.ndarray, best: tuple[np.ndarray, np.ndarray], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of those of ``best`` and of this block that reach ``floor``."""
        low, high = self.start[terms], self.start[terms + 1]
        self.asked[terms] = True
        met, depth, step = [], 0, FIRST_DEPTH
        while True:
            stop = np.minimum(low + depth + step, high)
            docs = np.concatenate([self.list_doc[a:b] for a, b in zip(np.minimum(low + depth, high), stop)])
            docs = docs[~self.met[docs]]
            if len(docs):
                docs = np.unique(docs)
                self.met[docs] = True
                met.append(docs)
                found = self.scores(docs)
                good = found >= max(1, floor)
                best = k_best(np.concatenate([best[0], found[good]]), np.concatenate([best[1], self.ids[docs[good]]]), k)
                if len(best[0]) == k:
                    floor = max(floor, int(best[0][-1]))
            depth += step
            open_ = low + depth < high
            # No document that no list has shown so far can score more than the lists' last impacts.
            threshold = int(self.list_impact[low[open_] + depth - 1].sum())
            if threshold < max(1, floor) or not open_.any():
                break
            step = depth
        self.asked[terms] = False
        for docs in met:
            self.met[docs] = False
        return best


def k_best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(score) > 4 * k:
        keep = score >= np.partition(score, -k)[-k]
        score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def blocks(batches, stats: Statistics):
    """Blocks of about BLOCK_TERMS entries of a task's forward index."""
    held, size = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            held.append(batch.slice(i, 512))
            size += len(held[-1].column("terms").flatten())
            if size >= BLOCK_TERMS:
                yield block(held, stats)
                held, size = [], 0
    if held:
        yield block(held, stats)


def block(held: list[pa.RecordBatch], stats: Statistics) -> Block:
    table = pa.Table.from_batches(held).combine_chunks()
    column = lambda c: table.column(c).combine_chunks()
    terms, counts = column("terms"), column("counts")
    first = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    ids = column("doc_id").fill_null(LAST).to_numpy()
    return Block(ids, column("n").to_numpy(), terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64), first, stats)


def ranked(index: DataFrame, shared, k: int) -> DataFrame:
    """The k best of each task for each item, as (item, doc_id, score) rows."""

    def run(batches):
        terms, stats, floors = shared.value
        items = [np.array(t, np.int64) for t in terms.items]
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(items)
        for made in blocks(batches, stats):
            for i, asked in enumerate(items):
                if len(asked):
                    best[i] = made.search(asked, best[i], floors[i], k)
        for i, (score, ids) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i), pa.int32()), pa.array(ids, pa.int64(), mask=ids == LAST), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])
        release()

    return index.mapInArrow(run, "item INT, doc_id BIGINT, score BIGINT")


def merged(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def group_top(docs: DataFrame, items: list, k: int) -> DataFrame:
    """item_id, rank, doc_id, score of a group of (item_id, text) rows."""
    spark = docs.sparkSession
    terms = Terms([r.text for r in items])
    index = written(forward(docs, spark.sparkContext.broadcast(terms)), "forward")
    stats = statistics(index, terms.n)
    floors = [0] * len(items)
    part = index.where(F.pmod(F.xxhash64("doc_id", "n", "terms", "counts"), F.lit(SHARE)) == 0)
    first = merged(ranked(part, spark.sparkContext.broadcast((terms, stats, floors)), k), k)
    for r in first.where(F.col("rank") == k).collect():  # a row for each item
        floors[r.item] = r.score
    out = merged(ranked(index, spark.sparkContext.broadcast((terms, stats, floors)), k), k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], f"item INT, item_id {items_type(items)}")
    return out.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def items_type(items: list) -> str:
    return "STRING" if any(isinstance(r.item_id, str) for r in items) else "BIGINT"


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = TOP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank, doc_id, score."""
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    asked = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("text"))
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // group_bytes))
    out = None
    for i in range(n):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else asked
        found = group_top(docs, rows.collect(), k)  # about group_bytes
        out = found if out is None else out.unionByName(found)
    return out
