"""Quality rules, with an isolation forest on their statistics.

Words are the maximal runs of characters other than blanks (U+0020 and U+0009 to U+000D). The
base rules fail a text of fewer than 20 words, or one in which more than 30 % of the words lie
in windows of 8 words that the text holds twice or more. Every other text goes through a
forest of random splits on its rule statistics: what few splits isolate is unlike the texts
that the forest was grown on. Texts whose score (2 to the power of minus the mean path length
over that of a random tree) passes a threshold are rejected.

A statistic is what it exceeds its tolerance by, and tolerances are calibrated too: one and a
half times as far from the median of the good rows as the value that one in a thousand of them
passes, both exact over all good rows. All labelled rows that pass the base rules are learned
from; they are halved, every other one in the order of a hash of id and text, so alike in any
partitioning. Each tree draws its 256 rows, as the method has it, from all rows of one half, at
most a tenth of them poor ones; all rows of the other half calibrate the threshold, as the one
with the largest share of poor rows rejected less ``care`` times the share of good rows lost
(scores are counted in steps of 2 ** -16, and the threshold lies between two steps that have
rows). Texts are read once, for a narrow table of counts and statistics; rows are learned from
and judged by that table.

Defined results: a null or empty text has no words, all-zero counts, and fails the base rules.
Repeated rows have a row each, equal texts equal values. Of several labels of an id the least
counts; labels with a null id or value are ignored. Where no labelled row is left to learn
from, or none of either label to calibrate with, the forest rejects nothing and the base rules
alone decide. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.seeded import numbered
from .kit import PLACE, Words, keep_rows, map_pieces, mix, per_text, powers, written
from .quality import held

TREES, IN_TREE = 200, 256
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
CARE = 4.0
TOLERATED, SLACK = 0.999, 1.5
POOR_SHARE = 10  # one row in ten of a tree's, at most
STEPS = 1 << 16  # of scores, where they are counted

IS_TOKEN = np.ones(256, bool)
IS_TOKEN[[0x20, 9, 10, 11, 12, 13]] = False
AS_IS = np.arange(256, dtype=np.uint8)


def _set(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


SYMBOL = _set("#*$%&|<>")
UPPER = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = UPPER | _set("abcdefghijklmnopqrstuvwxyz")
END = _set(".!?")
OTHER = _set("!\"'()+,-/:;=?@[\\]^_`{}~")

STATISTICS = ["word_length", "symbols", "dup_lines", "repeated", "upper", "ends", "other", "twice", "doubled"]
COUNTS = "n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT"


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _of_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes of (value, text)."""
    return mix(hashes * np.uint64(0x9E3779B97F4A7C15) + text.astype(np.uint64))


def counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts and the statistics of a run of texts."""
    words = Words(buf, off, IS_TOKEN, AS_IS)
    n_texts, n = words.n_texts, words.count

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[off[1:]] - c[off[:-1]]

    # windows of eight words that a text holds more than once
    place = np.arange(len(words.hash))
    starts = np.flatnonzero(place + WINDOW <= words.first[1:][words.text])
    window = np.zeros(len(starts), np.uint64)
    for j in range(WINDOW):
        window += words.hash[starts + j] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    again = starts[_repeated(_of_text(mix(window), words.text[starts]))]
    edge = np.zeros(len(place) + 1, np.int32)
    edge[again] += 1
    np.add.at(edge, again + WINDOW, -1)
    covered = (np.cumsum(edge)[:-1] > 0).astype(np.int64)
    n_repeat = per_text(covered, words.first, np.add, 0)

    # lines with a word that equal an earlier one of the text
    breaks = buf == 10
    begin = np.unique(np.concatenate([off[:-1], np.flatnonzero(breaks) + 1]))
    begin = begin[begin < len(buf)]
    stop = np.append(begin[1:], len(buf))
    stop = np.where(breaks[np.maximum(stop - 1, 0)] & (stop > begin), stop - 1, stop) if len(begin) else stop[:0]
    if len(begin):
        owner = np.searchsorted(off, begin, "right") - 1
        p, inv = powers(len(buf))
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=sums[1:])
        has = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
        line = _of_text(mix((sums[stop] - sums[begin]) * inv[begin] + (stop - begin).astype(np.uint64)), owner)[has]
        owner = owner[has]
        n_lines = np.bincount(owner, minlength=n_texts)
        _, first = np.unique(line, return_index=True)
        n_dup = n_lines - np.bincount(owner[first], minlength=n_texts)
    else:
        n_lines = n_dup = np.zeros(n_texts, np.int64)

    chars = (buf & 0xC0) != 0x80
    word_chars = total(chars & IS_TOKEN[buf])
    n_symbols, letters = total(SYMBOL[buf]), np.maximum(1, total(LETTER[buf]))
    next_word = np.zeros(len(place), bool)
    next_word[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    mark = SYMBOL[buf] | OTHER[buf] | END[buf]
    double = np.zeros(len(buf), bool)
    double[1:] = mark[1:] & (buf[1:] == buf[:-1])
    some = np.maximum(1, n).astype(float)
    values = [
        word_chars / some,
        n_symbols / some,
        n_dup / np.maximum(1, n_lines),
        n_repeat / some,
        total(UPPER[buf]) / letters,
        total(END[buf]) / some,
        total(OTHER[buf]) / some,
        per_text(next_word.astype(float), words.first, np.add, 0.0) / some,
        total(double) / some,
    ]
    statistics = np.stack(values, 1).astype(np.float32) if n_texts else np.zeros((0, len(STATISTICS)), np.float32)
    statistics[n == 0] = 0
    return {"n_words": n, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "statistics": statistics}


def fails(n_words, n_repeat_words):
    """The base rules, on arrays or Columns."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search in a random tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Random trees over rows of statistics, kept as flat arrays of nodes."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, in_tree: int = IN_TREE, seed: int = 5):
        rng, n = np.random.default_rng(seed), min(in_tree, len(rows))
        self._plant((rows[rng.choice(len(rows), n, replace=False)] for _ in range(trees)), n, rng)

    @classmethod
    def of(cls, drawn: list[np.ndarray], seed: int = 5) -> Forest:
        """A tree of each array of rows."""
        out = cls.__new__(cls)
        out._plant(drawn, max(map(len, drawn)), np.random.default_rng(seed))
        return out

    def _plant(self, drawn, in_tree: int, rng) -> None:
        self.in_tree = in_tree
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.in_tree)))))
        self.split, self.cut, self.left, self.right, self.length = [], [], [], [], []
        self.roots = [self._grow(rows, 0, rng) for rows in drawn]
        for name, kind in (("split", np.int32), ("cut", np.float32), ("left", np.int32), ("right", np.int32), ("length", np.float64)):
            setattr(self, name, np.array(getattr(self, name), kind))

    def _grow(self, rows: np.ndarray, depth: int, rng) -> int:
        at = len(self.split)
        for field in (self.split, self.cut, self.left, self.right, self.length):
            field.append(0)
        self.split[at] = -1
        self.length[at] = depth + _expected(len(rows))
        low, high = rows.min(0), rows.max(0)
        open_ = np.flatnonzero(high > low)
        if depth >= self.depth or len(rows) <= 1 or not len(open_):
            return at
        f = int(rng.choice(open_))
        cut = np.float32(rng.uniform(low[f], high[f]))
        below = rows[:, f] <= cut
        if below.all():  # rounded up to the largest value
            cut = np.nextafter(high[f], np.float32(-np.inf), dtype=np.float32)
            below = rows[:, f] <= cut
        self.split[at], self.cut[at] = f, cut
        self.left[at] = self._grow(rows[below], depth + 1, rng)
        self.right[at] = self._grow(rows[~below], depth + 1, rng)
        return at

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 for what few splits isolate."""
        total = np.zeros(len(rows))
        index = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root, np.int32)
            for _ in range(self.depth):
                f = self.split[node]
                value = rows[index, np.maximum(f, 0)]
                node = np.where(f < 0, node, np.where(value <= self.cut[node], self.left[node], self.right[node]))
            total += self.length[node]
        return 2.0 ** (-total / len(self.roots) / max(_expected(self.in_tree), 1e-9))


def calibrated(good: np.ndarray, poor: np.ndarray, care: float = CARE) -> float:
    """The score above which a row is rejected: the middle of the best gap between the labels'
    scores, by share of poor rows rejected less ``care`` times the share of good rows lost."""
    cuts = np.unique(np.concatenate([good, poor]))
    count = lambda x: np.bincount(np.searchsorted(cuts, x), minlength=len(cuts))
    return best_gap(cuts, cuts, count(good), count(poor), care)


def best_gap(least: np.ndarray, most: np.ndarray, good: np.ndarray, poor: np.ndarray, care: float) -> float:
    """The same of steps of scores in order: the least and most score and the rows of each."""
    lost, caught = 1 - np.cumsum(good) / good.sum(), 1 - np.cumsum(poor) / poor.sum()
    best = int(np.argmax(caught - care * lost))
    return float((most[best] + (least[best + 1] if best + 1 < len(least) else most[best])) / 2)


class Verdict:
    """Tolerances, trees and threshold, learned from the statistics of labelled rows."""

    def __init__(self, tolerance: np.ndarray, drawn: list[np.ndarray]):
        self.tolerance, self.threshold = tolerance, 1.0
        self.forest = Forest.of([self.excess(x) for x in drawn])

    def excess(self, statistics: np.ndarray) -> np.ndarray:
        return np.maximum(0, statistics - self.tolerance).astype(np.float32)

    def score(self, statistics: np.ndarray) -> np.ndarray:
        different, place = np.unique(self.excess(statistics), axis=0, return_inverse=True)
        return self.forest.score(different)[place.reshape(-1)]


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, base counts, statistics) of every row, in a written table. Statistics are the
    bits of floats that are not negative, so their order is that of the integers."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn(PLACE, F.xxhash64("key", "text"))

    def make():
        def kernel(batch, buf, off):
            c = counts(buf, off)
            return c | {"statistics": list(c["statistics"].view(np.int32))}

        return kernel

    return written(map_pieces(rows, "text", ["key", PLACE], f"{COUNTS}, statistics ARRAY<INT>", make), "measured")


def floats(bits: pa.Array) -> np.ndarray:
    """Statistics out of a column of their bits, a row for each row."""
    return bits.flatten().to_numpy().astype(np.int32).view(np.float32).reshape(len(bits), len(STATISTICS))


def of_rank(rows: DataFrame, ranks: list[int]) -> np.ndarray:
    """The values of the given ranks (from 0) of each statistic, over all rows: counted by their
    upper bits, then by the next ones below those that hold a rank."""
    codes = rows.select(F.posexplode("statistics").alias("i", "bits")).select((F.col("i").cast("bigint") * F.lit(1 << 31) + F.col("bits")).alias("code"))
    found, at = [(i, r) for i in range(len(STATISTICS)) for r in ranks], 31  # (upper bits, rank among them)
    for width in (11, 10, 10):
        held_by = F.shiftright("code", at).isin(sorted({p for p, _ in found}))
        n = codes.where(held_by).groupBy(F.shiftright("code", at - width).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # at most 2**width for each
        for k, (prefix, rank) in enumerate(found):
            for r in n:
                if r.p >> width == prefix:
                    if rank < r.n:
                        break
                    rank -= r.n
            found[k] = (r.p, rank)
        at -= width
    return np.array([p & ((1 << 31) - 1) for p, _ in found], np.int32).view(np.float32).reshape(len(STATISTICS), len(ranks))


def tolerances(good: DataFrame, n: int) -> np.ndarray:
    """Of each statistic, from all n good rows."""
    places = [(n - 1) * q for q in (0.5, TOLERATED)]
    values = of_rank(good, [min(int(p) + k, n - 1) for p in places for k in (0, 1)]).astype(np.float64)
    middle, high = (values[:, 2 * j] + (p - int(p)) * (values[:, 2 * j + 1] - values[:, 2 * j]) for j, p in enumerate(places))
    return middle + SLACK * (high - middle)


def drawn(rows: DataFrame, n_good: int, n_poor: int) -> list[np.ndarray]:
    """The rows of each tree: those of the least hashes of tree and row, out of all rows. Hashes
    are cut first where a tree's rows lie almost surely, so that few rows move."""
    few = min(n_poor, max(1, n_good // (POOR_SHARE - 1)))
    size = min(IN_TREE, n_good + few)
    poor = round(size * few / (n_good + few))
    near, wanted = F.lit(False), F.lit(False)
    for label, n, k in ((1, n_good, size - poor), (0, n_poor, poor)):
        share = 1.1 * (k + 8 * k**0.5 + 50) / n
        of = F.col("label") == label
        near |= of & (F.col("draw") < int(share * (1 << 64)) - (1 << 63)) if share < 1 else of
        wanted |= of & (F.col("at") <= k)
    trees = rows.select("label", "statistics", PLACE, F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    trees = trees.select("tree", "label", "statistics", F.xxhash64("tree", PLACE).alias("draw")).where(near)
    first = Window.partitionBy("tree", "label").orderBy("draw", "statistics")
    table = trees.withColumn("at", F.row_number().over(first)).where(wanted).orderBy("tree", "draw", "statistics").select("tree", "statistics").toArrow().combine_chunks()
    tree, values = table["tree"].to_numpy(), floats(table["statistics"].combine_chunks())
    return [values[tree == t] for t in range(TREES)]


def scored(rows: DataFrame, model: Verdict) -> DataFrame:
    """(label, score) of rows of statistics."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(shared.value.score(floats(b.column("statistics"))))], names=["label", "score"])

    return rows.select("label", "statistics").mapInArrow(run, "label INT, score DOUBLE")


def learned(known: DataFrame, labels: DataFrame, key: str, label: str, care: float, held_out: Column | None) -> Verdict | None:
    """The verdict, from all labelled rows of a measured table."""
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~(F.lit(False) if held_out is None else held_out))
    marks = marks.groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("label"))
    rows = known.where(~fails(F.col("n_words"), F.col("n_repeat_words"))).select("key", PLACE, "statistics").join(marks, "key")
    rows, place = numbered(rows.dropDuplicates(["key", PLACE]).select("label", PLACE, "statistics"), "label", PLACE)
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_poor, n_good = n.get(0, 0), n.get(1, 0)
    if min(n_poor, n_good) < 2:
        return None
    first = F.when(F.col("label") == 1, F.col(place) - n_poor).otherwise(F.col(place)) % 2 == 0  # of each two rows of a label
    model = Verdict(tolerances(rows.where("label = 1"), n_good), drawn(rows.where(first), (n_good + 1) // 2, (n_poor + 1) // 2))
    of = lambda v: F.count_if(F.col("label") == v)
    steps = scored(rows.where(~first), model).groupBy(F.floor(F.col("score") * STEPS).alias("step"))
    steps = steps.agg(F.min("score").alias("least"), F.max("score").alias("most"), of(1).alias("good"), of(0).alias("poor")).orderBy("step").toPandas()  # at most STEPS rows
    model.threshold = best_gap(*(steps[c].to_numpy() for c in ("least", "most", "good", "poor")), care)
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", care: float = CARE, held_out: Column | None = None) -> Verdict | None:
    """The verdict, or None where fewer than two rows of either label can be learned from.
    ``held_out`` is a condition on the id: labels of such rows are never used."""
    return learned(measured(docs, key, text), labels, key, label, care, held_out)


def judged(model: Verdict | None, n_words, n_repeat_words, statistics: np.ndarray) -> dict[str, np.ndarray]:
    """base_failed, score and kept of a run of rows."""
    failed = fails(n_words, n_repeat_words)
    score = model.score(statistics) if model else np.zeros(len(failed))
    return {"base_failed": failed, "score": score, "kept": ~failed & (score <= model.threshold if model else True)}


def verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", care: float = CARE, held_out: Column | None = None) -> DataFrame:
    """Per document: the base counts, base_failed, the forest's score and kept."""
    known = measured(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(learned(known, labels, key, label, care, held_out))
    schema = StructType([docs.select(key).schema[0]] + StructType.fromDDL(f"{COUNTS}, base_failed BOOLEAN, score DOUBLE, kept BOOLEAN").fields)
    arrow = to_arrow_schema(schema)
    passed = ["key", *(f.name for f in StructType.fromDDL(COUNTS))]

    def run(batches):
        for b in batches:
            made = judged(shared.value, b.column("n_words").to_numpy(), b.column("n_repeat_words").to_numpy(), floats(b.column("statistics")))
            columns = [b.column(c) for c in passed] + [pa.array(made[c]) for c in schema.names[len(passed) :]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return known.select(*passed, "statistics").mapInArrow(run, schema)


def predictions(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of op11. Labels of one fold in four are kept back, to measure by."""
    held_out = held(key)
    return verdicts(docs, labels, key, held_out=held_out).select("*", held_out.alias("held_out"))


def keep_regular(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", care: float = CARE) -> DataFrame:
    """The documents that pass the base rules and the forest, with all their columns; each row
    goes by its own text, whatever its id."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, label, care))

    def make():
        model = shared.value

        def kernel(batch, buf, off):
            c = counts(buf, off)
            return judged(model, c["n_words"], c["n_repeat_words"], c["statistics"])["kept"]

        return kernel

    return keep_rows(docs, text, make)
