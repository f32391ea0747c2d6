"""Documents scored by masked pseudo-likelihood.

A window network predicts every word from ``SIDE`` words on either side (the word itself is
masked); the sum of the conditional log-probabilities is the document's score.

1. Words are counted over all texts. Those that reach a count which at most ``KNOWN`` words
   reach are symbols of their own. All others share ``ENDINGS`` symbols by their last two
   bytes, and one symbol stands for what lies beyond a text's ends.
2. The network (shared embeddings, one hidden layer, a two-level softmax over symbols) is
   trained in numpy: a start on at most ``START`` texts of up to ``START_BYTES`` (by hash of id
   and text, 38 MB in all) on the driver, then one round over all
   texts, in which every partition trains from that start on every word of its texts. The
   partitions' weights, weighted by words, are averaged in a tree (``FAN`` networks at a time,
   by block), so no task holds more than a few blocks, and the driver gets one network.
3. The probability of a word is that of its symbol times the word's share of its symbol's
   occurrences in the corpus, so that probabilities of all words of the corpus sum to one and
   what is gathered grows with the corpus. Counts of the ``NEAR`` most frequent words are
   broadcast (12 bytes each); the shares of all others are joined from the count table.

Null and empty texts have no words: score 0 and a null mean. Repeated rows each get their
row; a table without words has an untrained network and only such rows. Partitions train
apart, so another partitioning of the same rows gives slightly other scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import Words, hash_sample, in_batches, map_pieces, pieces, written

SIDE = 3
CLASSES, MEMBERS = 64, 32
VOCABULARY = CLASSES * MEMBERS
ENDINGS = 255  # symbols that rarer words share
KNOWN = VOCABULARY - ENDINGS - 1
EDGE = VOCABULARY - 1
NEAR = 1 << 19  # bound of the word counts that are broadcast
EMBED, HIDDEN = 16, 24
START = 600  # texts on which the driver trains the first network
START_BYTES = 1 << 16  # of each of them at most; longer ones are trained on in the round over all texts
MINIBATCH = 8192
BLOCK = 4096
FAN = 64
HELD_WORDS = 1 << 20
FINE = 64  # bins of a doubling of counts

SHAPES = {"E": (VOCABULARY, EMBED), "W": (2 * SIDE * EMBED, HIDDEN), "b": (HIDDEN,), "C": (HIDDEN, CLASSES), "c": (CLASSES,), "O": (CLASSES, MEMBERS, HIDDEN), "o": (CLASSES, MEMBERS)}
PLACES = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def endings(words: Words) -> np.ndarray:
    """The shared symbol of each word: of its last two bytes."""
    last = words.low[words.end - 1].astype(np.int64)
    before = np.where(words.end - words.start > 1, words.low[np.maximum(words.end - 2, 0)], 0).astype(np.int64)
    return KNOWN + (before * 257 + last * 31) % ENDINGS


class Lexicon:
    """Symbols of words, and the logarithm of each near word's share of its symbol.

    ``word`` holds sorted hashes, ``count`` and ``shared`` (the ending's symbol) go with it;
    ``totals`` are the occurrences in the corpus of each ending's symbol. Words of ``floor``
    occurrences have symbols of their own.
    """

    def __init__(self, word: np.ndarray, count: np.ndarray, shared: np.ndarray, totals: np.ndarray, floor: int):
        self.word, self.totals = word, np.maximum(1, totals)
        own = np.flatnonzero(count >= floor)
        own = own[np.lexsort((word[own], -count[own]))]
        self.symbol = shared.astype(np.int32)
        self.symbol[own] = np.arange(len(own))
        self.share = np.log(count / self.totals[shared - KNOWN]).astype(np.float32) if len(count) else np.zeros(0, np.float32)
        self.share[own] = 0

    def look(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, log share, whether the share is known here) of words."""
        symbol, share, near = endings(words), np.zeros(len(words.hash)), np.zeros(len(words.hash), bool)
        if len(self.word):
            i = np.minimum(np.searchsorted(self.word, words.hash), len(self.word) - 1)
            near = self.word[i] == words.hash
            symbol[near], share[near] = self.symbol[i[near]], self.share[i[near]]
        return symbol, share, near


def laid(symbol: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols in one row, with SIDE edges before, between and after them, and the
    place of each word in it."""
    at = np.arange(len(symbol)) + SIDE * (words.text + 1)
    row = np.full(len(symbol) + SIDE * (words.n_texts + 1), EDGE, np.int64)
    row[at] = symbol
    return row, at


def softmax(x: np.ndarray, bound: float) -> np.ndarray:
    """In place, by row; ``bound`` is a bound of the values."""
    if bound > 60:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def log_chosen(x: np.ndarray, own: np.ndarray, bound: float) -> np.ndarray:
    """Log-softmax of one value of each row; ``x`` is used up."""
    if bound > 60:
        x -= x.max(1, keepdims=True)
    it = x[np.arange(len(x)), own]
    return it - np.log(np.exp(x, out=x).sum(1))


class Network:
    """Symbol s is member s // CLASSES of class s % CLASSES, so classes have like totals."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(11)
        scale = {"E": 0.3, "W": 1 / np.sqrt(2 * SIDE * EMBED), "C": 0.1, "O": 0.1}
        self.w = weights or {k: (rng.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}
        self.g2 = {k: np.full(s, 0.01, np.float32) for k, s in SHAPES.items()}

    def update(self, k: str, g: np.ndarray, rows=None, rate: float = 0.08) -> None:
        """Adagrad on all or on some rows of a parameter."""
        if rows is None:
            self.g2[k] += g * g
            self.w[k] -= rate * g / np.sqrt(self.g2[k])
        else:
            self.g2[k][rows] += g * g
            self.w[k][rows] -= rate * g / np.sqrt(self.g2[k][rows])

    def forward(self, row: np.ndarray, low: int, high: int):
        """Windows around the places [low, high) of a row (its middle ones are left out by the
        weights), hidden values, and the places in order of their symbols' classes."""
        e = self.w["E"][row[low - SIDE : high + SIDE]]
        n, width = high - low, (2 * SIDE + 1) * EMBED
        x = np.lib.stride_tricks.as_strided(e, (n, width), (e.strides[0], e.strides[1])).copy()
        h = x @ self.window()
        h += self.w["b"]
        np.tanh(h, out=h)
        target = row[low:high]
        group, member = target % CLASSES, target // CLASSES
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(CLASSES + 1))
        return x, h, group, member, order, edges

    def window(self) -> np.ndarray:
        """The input weights with zeros for the masked place."""
        half = SIDE * EMBED
        return np.concatenate([self.w["W"][:half], np.zeros((EMBED, HIDDEN), np.float32), self.w["W"][half:]])

    def bounds(self) -> tuple[float, np.ndarray]:
        """Bounds of the logits, as hidden values lie between -1 and 1."""
        w = self.w
        return float((np.abs(w["C"]).sum(0) + np.abs(w["c"])).max()), (np.abs(w["O"]).sum(2) + np.abs(w["o"])).max(1)

    def train(self, row: np.ndarray, low: int, high: int) -> float:
        """One step on the words at [low, high) of a row; their mean log-probability before it."""
        x, h, group, member, order, edges = self.forward(row, low, high)
        word = row[low:high] != EDGE
        n = max(1, int(word.sum()))
        at = np.arange(high - low)
        top, inside = self.bounds()
        p = softmax(h @ self.w["C"] + self.w["c"], top)
        score = float(np.log(p[word, group[word]]).sum())
        p[at, group] -= 1
        p[~word] = 0
        dh = p @ self.w["C"].T
        grads = {"C": h.T @ p, "c": p.sum(0)}
        g_out, g_bias = np.zeros(SHAPES["O"], np.float32), np.zeros(SHAPES["o"], np.float32)
        hs, ms, ws, back = h[order], member[order], word[order], np.empty_like(h)
        for k in range(CLASSES):
            a, b = edges[k], edges[k + 1]
            if b > a:
                q = softmax(hs[a:b] @ self.w["O"][k].T + self.w["o"][k], inside[k])
                own = at[: b - a]
                score += float(np.log(q[own, ms[a:b]])[ws[a:b]].sum())
                q[own, ms[a:b]] -= 1
                if k == EDGE % CLASSES:
                    q[~ws[a:b]] = 0
                g_out[k], g_bias[k] = q.T @ hs[a:b], q.sum(0)
                back[a:b] = q @ self.w["O"][k]
        dh[order] += back
        h *= h
        dh *= 1 - h
        # What each place of the row gets from the windows it lies in, then summed by symbol.
        places = np.zeros((high - low + 2 * SIDE, EMBED), np.float32)
        dx = dh @ self.window().T
        for j in range(2 * SIDE + 1):
            places[j : j + high - low] += dx[:, j * EMBED : (j + 1) * EMBED]
        near = row[low - SIDE : high + SIDE].astype(np.int16)
        order = np.argsort(near, kind="stable")
        sorted_ = near[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        g_window, half = x.T @ dh, SIDE * EMBED
        grads |= {"W": np.concatenate([g_window[:half], g_window[half + EMBED :]]), "b": dh.sum(0), "O": g_out, "o": g_bias}
        for k, g in grads.items():
            self.update(k, (g * (32 / n)).astype(np.float32))
        self.update("E", np.add.reduceat(places[order], first, axis=0) * np.float32(32 / n), sorted_[first].astype(np.int64))
        return score / n

    def log_probabilities(self, row: np.ndarray, low: int, high: int) -> np.ndarray:
        """Of the symbols at [low, high) of a row, each given those around it."""
        _, h, group, member, order, edges = self.forward(row, low, high)
        top, inside = self.bounds()
        out = log_chosen(h @ self.w["C"] + self.w["c"], group, top)
        hs, ms, within = h[order], member[order], np.empty(high - low, np.float32)
        for k in range(CLASSES):
            a, b = edges[k], edges[k + 1]
            if b > a:
                within[a:b] = log_chosen(hs[a:b] @ self.w["O"][k].T + self.w["o"][k], ms[a:b], inside[k])
        out[order] += within
        return out


def stretches(row: np.ndarray) -> list[tuple[int, int]]:
    """[low, high) of a row's stretches of about MINIBATCH places."""
    inner = len(row) - 2 * SIDE
    return [(SIDE + i, SIDE + min(i + MINIBATCH, inner)) for i in range(0, inner, MINIBATCH)]


def counted(docs: DataFrame, text: str) -> DataFrame:
    """(word, shared, n) of every word of the corpus, as a written table."""

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            h, s, n = (np.concatenate(x) for x in zip(*held))
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            return u, s[first], np.bincount(back, n).astype(np.int64)

        def rows(h, s, n):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s, pa.int32()), pa.array(n, pa.int64())], names=["word", "shared", "n"])

        for batch in batches:
            for _, buf, off in pieces(batch, text):
                words = Words(buf, off)
                u, first, n = np.unique(words.hash, return_index=True, return_counts=True)
                held.append((u, endings(words)[first].astype(np.int32), n))
                size += len(u)
                if size > HELD_WORDS:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD_WORDS // 2:
                        yield rows(*held.pop())
                        size = 0
        if held:
            yield rows(*merged())

    counts = in_batches(docs.select(text), count, "word BIGINT, shared INT, n BIGINT").groupBy("word").agg(F.min("shared").alias("shared"), F.sum("n").alias("n"))
    return written(counts, "counts")


def reached(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach, from a histogram of fine bins."""
    bin_ = F.floor(F.log2("n") * FINE).cast("int")
    bins = counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()  # FINE a doubling
    words, least = 0, 1 << 62
    for r in bins:
        words += r.words
        if words > most:
            break
        least = r.least
    return least


def gathered(counts: DataFrame) -> tuple[Lexicon, int]:
    """The broadcast part of the counts, and the count from which words are in it."""
    least = reached(counts, NEAR)
    near = counts.where(F.col("n") >= least).toArrow()  # NEAR rows at most
    word = near.column("word").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(word)
    count, shared = (near.column(c).to_numpy()[order].astype(np.int64) for c in ("n", "shared"))
    floor = reached(counts, KNOWN)  # words below it have no symbol of their own
    totals = np.zeros(ENDINGS, np.int64)
    for r in counts.where(F.col("n") < floor).groupBy("shared").agg(F.sum("n").alias("n")).collect():  # ENDINGS rows
        totals[r.shared - KNOWN] = r.n
    return Lexicon(word[order], count, shared, totals, floor), least


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def train_on(network: Network, words: Words, lexicon: Lexicon, rng: np.random.Generator) -> int:
    """Train on every word of the texts, in stretches of random order; the number of words."""
    row, at = laid(lexicon.look(words)[0], words)
    if len(at):
        for low, high in rng.permutation(stretches(row)).tolist():
            network.train(row, low, high)
    return len(at)


def averaged(weights: DataFrame) -> DataFrame:
    """Mean of (part, block, n, w) rows by block, FAN parts at a time."""

    def mean(batches):
        total: dict[tuple, np.ndarray] = {}
        weight: dict[tuple, int] = {}
        for batch in batches:
            for p, b, n, w in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "n", "w"))):
                x = np.frombuffer(w, "<f4").astype(np.float64) * n
                total[p, b] = total[p, b] + x if (p, b) in total else x
                weight[p, b] = weight.get((p, b), 0) + n
        if total:
            parts, blocks = zip(*total)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.int32()), pa.array([weight[k] for k in total], pa.int64()), pa.array([(total[k] / weight[k]).astype("<f4").tobytes() for k in total], pa.binary())], names=["part", "block", "n", "w"])

    while True:
        grouped = weights.withColumn("part", (F.col("part") / FAN).cast("int"))
        weights = written(grouped.repartition("part", "block").mapInArrow(mean, "part INT, block INT, n BIGINT, w BINARY"), "weights")
        if not weights.agg(F.max("part")).first()[0]:
            return weights


def fit(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> dict[str, np.ndarray]:
    """Weights of the network, as described above."""
    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    texts = hash_sample(sample.where(F.octet_length("text") <= START_BYTES), ["key", "text"], START).select("text").toArrow()
    network = Network()
    rng = np.random.default_rng(5)
    for epoch in range(2):
        for batch in texts.to_batches():
            for _, buf, off in pieces(batch, "text"):
                train_on(network, Words(buf, off), lexicon, rng)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, flat(network.w)))

    def local(batches):
        lexicon, start = shared.value
        network, trained = Network(shaped(start)), 0
        for batch in batches:
            for _, buf, off in pieces(batch, text):
                words = Words(buf, off)
                trained += train_on(network, words, lexicon, np.random.default_rng(len(words.hash)))
        if trained:
            values = flat(network.w)
            blocks = [values[i : i + BLOCK].astype("<f4").tobytes() for i in range(0, len(values), BLOCK)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([trained] * n, pa.int64()), pa.array(blocks, pa.binary())], names=["part", "block", "n", "w"])

    trained = in_batches(docs.select(text), local, "part INT, block INT, n BIGINT, w BINARY")
    got = averaged(trained).select("block", "w").collect()  # one network
    return shaped(np.concatenate([np.frombuffer(r.w, "<f4") for r in sorted(got)])) if got else network.w


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_tokens, log_likelihood (sum) and mean_log_likelihood of its words."""
    counts = counted(docs, text)
    words, least = gathered(counts)
    shared = docs.sparkSession.sparkContext.broadcast((words, flat(fit(docs, words, key, text))))

    def make():
        lexicon, values = shared.value
        network = Network(shaped(values))

        def kernel(batch, buf, off):
            words = Words(buf, off)
            symbol, share, near = lexicon.look(words)
            row, at = laid(symbol, words)
            got = share
            if len(at):
                got += np.concatenate([network.log_probabilities(row, *x) for x in stretches(row)])[at - SIDE]
            far = ~near
            got[far] -= np.log(lexicon.totals[symbol[far] - KNOWN])
            rare: list = [None] * words.n_texts
            at = np.flatnonzero(far)
            if len(at):
                edges = np.searchsorted(words.text[at], np.arange(words.n_texts + 1))
                hashes = words.hash[at].view(np.int64)
                rare = [hashes[a:b] if b > a else None for a, b in zip(edges, edges[1:])]
            return {"n_tokens": words.count, "sum": np.bincount(words.text, got, minlength=words.n_texts), "rare": rare}

        return kernel

    found = map_pieces(docs.select(key, text), text, [key], "n_tokens BIGINT, sum DOUBLE, rare ARRAY<BIGINT>", make)
    found = written(found.withColumn("_row", F.monotonically_increasing_id()), "sums")
    # Counts of words that are too rare to be broadcast: few of all occurrences.
    each = found.where("rare IS NOT NULL").select("_row", F.explode("rare").alias("word"))
    logs = each.join(counts.where(F.col("n") < least).select("word", "n"), "word").groupBy("_row").agg(F.sum(F.log("n")).alias("more"))
    out = found.join(logs, "_row", "left").withColumn("log_likelihood", F.col("sum") + F.coalesce("more", F.lit(0.0)))
    return out.select(key, "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))
