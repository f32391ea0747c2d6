"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a few small networks by minimising the
non-negative unbiased risk  pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])  with the
logistic loss: where the second term turns negative its gradient is reversed instead. The
class prior pi is estimated from positives and unlabelled text alone, as the least ratio of
their shares above a score (best-bin estimate, cross-fitted; the lower quartile of ``HALVINGS``
random halvings); labels other than 1 are never used.

The networks, whose scores are averaged, are fitted on style features of at most ``sample`` positives and twice as many
unlabelled texts, taken by hash of id and text, so the same ones in any partitioning (rows of
equal id and text count once, rows without an id are unlabelled ones); all whole texts are then
read and scored in one pass, which writes no table.

Scores are rounded to nine digits, as sums of floats depend on the batch. Null and empty texts
have all-zero features and get that score. Repeated rows each get their
row. Without a positive label every score is 0.5 and ``keep_good`` keeps all documents: nothing
is known by which to reject one. Labels of null ids or null values are ignored; of several
labels of an id the largest counts.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kit import IS_WORD, PLACE, Words, bucket, first_places, hash_sample, hash_share, keep_rows, map_pieces, per_text

SAMPLE = 6000  # bound of the positives fitted on; unlabelled rows are twice as many
KEEP = 0.7
HALVINGS, MEMBERS = 15, 5  # halvings of the sample, for the class prior; networks
FOLDS, HELD_OUT = 4, 2

SIGNS = "!#$%&*|.,;:?-_/()<>=@\"'"
N_FEATURES = 16 + 2 * len(SIGNS)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.full(256, len(SIGNS), np.int64)
for _i, _c in enumerate(SIGNS):
    _SIGN[ord(_c)] = _i


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct values in each text's run."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = (values & ~np.uint64(0xFFFF)) | (text & np.uint64(0xFFFF))
    order = np.sort(key)
    new = np.ones(len(order), bool)
    new[1:] = order[1:] != order[:-1]
    return np.bincount((order[new] & np.uint64(0xFFFF)).astype(np.int64), minlength=len(n))[: len(n)]


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Style features of texts (fewer than 65536): letter cases, signs, words, repetition."""
    n_texts = len(off) - 1
    words = Words(buf, off)
    size = np.maximum(1, np.diff(off)).astype(float)
    n = np.maximum(1, words.count).astype(float)
    out = np.zeros((n_texts, N_FEATURES))

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[off[1:]] - c[off[:-1]]

    upper, newline = total(_UPPER[buf]), total(buf == 10)
    spaces = total(buf == 32)
    at = np.flatnonzero(_SIGN[buf] < len(SIGNS))
    owner = np.searchsorted(off, at, "right") - 1
    kind = _SIGN[buf[at]]
    signs = np.bincount(owner * len(SIGNS) + kind, minlength=n_texts * len(SIGNS)).reshape(n_texts, -1)
    twice = np.zeros(len(at), bool)
    twice[1:] = (np.diff(at) == 1) & (kind[1:] == kind[:-1]) & (owner[1:] == owner[:-1])
    double = np.bincount(owner[twice] * len(SIGNS) + kind[twice], minlength=n_texts * len(SIGNS)).reshape(n_texts, -1)
    length = (words.end - words.start).astype(float)
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    inside = (words.text[1:] == words.text[:-1]).astype(np.uint64)  # no word of the text before
    pairs = words.hash.copy()
    pairs[1:] += words.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) * inside
    triples = pairs.copy()
    triples[1:] += pairs[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) * inside
    capital = _UPPER[buf[words.start]] if len(words.start) else np.zeros(0, bool)
    columns = [
        np.log1p(words.count),
        np.log1p(size),
        upper / size,
        total(_DIGIT[buf]) / size,
        total(buf >= 128) / size,
        newline / n,
        spaces / size,
        total(~IS_WORD[buf] & (buf > 32)) / size,
        per_text(length, words.first, np.add, 0.0) / n,
        np.sqrt(per_text(length**2, words.first, np.add, 0.0) / n),
        per_text(again.astype(float), words.first, np.add, 0.0) / n,
        _distinct(words.hash, words.first) / n,
        _distinct(triples, words.first) / n,
        per_text(capital.astype(float), words.first, np.add, 0.0) / n,
        per_text((length <= 2).astype(float), words.first, np.add, 0.0) / n,
        (np.diff(off) > 0).astype(float),
    ]
    for i, c in enumerate(columns):
        out[:, i] = c
    out[:, 16 : 16 + len(SIGNS)] = np.minimum(2.0, signs / n[:, None])
    out[:, 16 + len(SIGNS) :] = np.minimum(2.0, double / n[:, None])
    out[np.diff(off) == 0] = 0
    return out.astype(np.float32)


class Network:
    """One hidden layer on standardised features; trained by the non-negative risk."""

    def __init__(self, width: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rng, self.width = rng, width
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = [rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, width)), np.zeros(width), rng.normal(0, 1 / np.sqrt(width), width), np.zeros(1)]

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        g = np.clip(self.logits(self.prepared(x)), -30, 30)
        return 1 / (1 + np.exp(-g))

    def gradient(self, z: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Of sum(slope * g(z)) by the parameters."""
        h = np.tanh(z @ self.p[0] + self.p[1])
        back = slope[:, None] * self.p[2] * (1 - h**2)
        return [z.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, least_steps: int = 1800, least_epochs: int = 30, batch: int = 256, rate: float = 0.01) -> Network:
        """Some epochs at least, and as many steps as a small sample needs too."""
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        zp, zu = self.prepared(positive), self.prepared(unlabelled)
        m = [np.zeros_like(x) for x in self.p]
        v = [np.zeros_like(x) for x in self.p]
        step = 0
        n_batches = max(1, -(-len(zu) // batch))
        epochs = max(least_epochs, -(-least_steps // n_batches))
        for epoch in range(epochs):
            order = self.rng.permutation(len(zu))
            order_p = self.rng.permutation(len(zp))
            for b in range(n_batches):
                u = zu[order[b::n_batches]]
                p = zp[order_p[b::n_batches]] if len(zp) >= n_batches else zp
                sp = 1 / (1 + np.exp(-np.clip(self.logits(p), -30, 30)))
                su = 1 / (1 + np.exp(-np.clip(self.logits(u), -30, 30)))
                # l(g) = log(1 + exp(-g)); its slope is s - 1, and that of l(-g) is s
                negative = np.mean(-np.log(1 - su + 1e-12)) - prior * np.mean(-np.log(1 - sp + 1e-12))
                if negative >= 0:
                    grads = self.gradient(np.concatenate([p, u]), np.concatenate([prior * (sp - 1) / len(p) - prior * sp / len(p), su / len(u)]))
                else:  # step back on the negative part alone
                    grads = self.gradient(np.concatenate([p, u]), np.concatenate([prior * sp / len(p), -su / len(u)]))
                step += 1
                now = rate * (1 - epoch / epochs)
                for i, g in enumerate(grads):
                    g = g + 1e-4 * self.p[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, wide: float = 0.1) -> float:
    """Ratio of the shares of unlabelled and of positive scores above the threshold at which
    its upper confidence bound (of probability 1 - ``wide``) is least."""
    cuts = np.quantile(positive, np.linspace(0.0, 0.9, 91))
    p, u = (np.maximum([np.mean(x >= c) for c in cuts], 1e-9) for x in (positive, unlabelled))
    error = math.sqrt(math.log(4 / wide) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    best = np.argmin((u + error) / p)
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def halved_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0, parts: int = 2, rounds: int = 2) -> float:
    """Best-bin estimate from scores of texts by networks that were not fitted on them, as a
    random halving deals them; a second round fits those networks with the first round's
    estimate."""
    parts = max(1, min(parts, len(positive), len(unlabelled)))
    rng, prior = np.random.default_rng(seed), 0.5
    of_p, of_u = rng.permutation(len(positive)) % parts, rng.permutation(len(unlabelled)) % parts
    for _ in range(rounds):
        p, u = np.zeros(len(positive)), np.zeros(len(unlabelled))
        for i in range(parts):
            in_p, in_u = of_p == i, of_u == i
            net = Network(seed=seed).fit(positive[~in_p] if parts > 1 else positive, unlabelled[~in_u] if parts > 1 else unlabelled, prior, 600, 10)
            p[in_p], u[in_u] = net.score(positive[in_p]), net.score(unlabelled[in_u])
        prior = best_bin_prior(p, u)
    return prior


class Committee:
    """Networks that differ in their random start; the score is the mean of theirs."""

    def __init__(self, members: list[Network]):
        self.members = members

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.mean([m.score(x) for m in self.members], axis=0)


def in_tasks(spark: SparkSession, run: Callable, n: int) -> list:
    """``run(seed)`` for n seeds, each in a task of its own."""

    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pickle.dumps(run(seed)) for seed in batch.column(0).to_pylist()], pa.binary())], names=["seed", "made"])

    rows = spark.range(0, n, 1, n).mapInArrow(each, "seed BIGINT, made BINARY").collect()
    return [pickle.loads(r.made) for r in sorted(rows)]


def trained(spark: SparkSession, positive: np.ndarray, unlabelled: np.ndarray) -> Committee:
    """Prior and networks. The prior is the lower quartile of the estimates of some random
    halvings: one alone is unsteady where positives are few, and they err upwards rather than
    downwards, as every cut's ratio is at least the prior."""
    shared = spark.sparkContext.broadcast((positive.astype(np.float32), unlabelled.astype(np.float32)))
    data = lambda: (x.astype(float) for x in shared.value)
    prior = float(np.quantile(in_tasks(spark, lambda seed: halved_prior(*data(), seed), HALVINGS), 0.25))
    return Committee(in_tasks(spark, lambda seed: Network(seed=7 + seed).fit(*data(), prior), MEMBERS))


def _featurize():
    return lambda batch, buf, off: {"features": list(features(buf, off))}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, held_out=None) -> Committee | None:
    """The networks, or None where there is no positive label to learn from."""
    held_out = F.lit(False) if held_out is None else held_out
    open_ = docs.where(~held_out).select(F.col(key).alias("key"), F.col(text).alias("text"))
    good = labels.where(F.col(key).isNotNull() & ~held_out).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label")).where("label = 1").select("key")

    def matrix(rows: DataFrame, n: int) -> np.ndarray:
        near = map_pieces(rows, "text", [PLACE], "features ARRAY<FLOAT>", _featurize)
        got = first_places(near, n).select("features").toArrow().column(0).combine_chunks()
        return got.flatten().to_numpy().reshape(-1, N_FEATURES).astype(float)

    # Ids are drawn first, some more than are needed, as some may have no text: no text moves.
    ids = F.broadcast(hash_sample(good, ["key"], 2 * sample))
    positive = matrix(open_.join(ids, "key").withColumn(PLACE, F.xxhash64("key", "text")), sample)
    unlabelled = matrix(hash_share(open_, ["key", "text"], 2 * sample), 2 * sample)
    if not len(positive) or not len(unlabelled):
        return None
    return trained(docs.sparkSession, positive, unlabelled)


def scored(model: Committee | None, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.round(model.score(features(buf, off)), 9) if model else np.full(len(off) - 1, 0.5)


def scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, held_out=None) -> DataFrame:
    """Per document its quality ``score``. ``held_out`` is a condition on the id: labels and
    texts of such rows are never learned from."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, label, sample, held_out))

    def make():
        model = shared.value
        return lambda batch, buf, off: {"score": scored(model, buf, off)}

    return map_pieces(docs.select(key, F.col(text).alias("text")), "text", [key], "score DOUBLE", make)


def held(key: str):
    """Whether a row is of the held-out fold; rows without an id are not."""
    return F.coalesce(bucket(key, FOLDS) == HELD_OUT, F.lit(False))


def predictions(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of op3: the fold of each row, its score and the decision at 0.7."""
    out = scores(docs, labels, key, held_out=held(key))
    return out.select(key, held(key).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose score reaches 0.7, with all their columns; all documents where no
    positive label can be learned from. Rows are dropped in the pass that scores them, so each
    goes by its own score, whatever its id."""
    model = fit(docs, labels, key, text, held_out=held(key))
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        return lambda batch, buf, off: scored(model, buf, off) >= KEEP

    return keep_rows(docs, text, make)
