import random
from collections import Counter

import numpy as np
import pyarrow as pa

from larkspur.llm import pseudolikelihood as P
from larkspur.llm.kit import Words, utf8


def test_odd_rows(odd, odd_rows, none):
    rows = P.scored(odd).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows}
    for i in (3, 4):
        assert (by[i].n_tokens, by[i].log_likelihood, by[i].mean_log_likelihood) == (0, 0.0, None)
    assert by[5].n_tokens == 30_000 and by[5].log_likelihood < 0
    assert abs(by[0].log_likelihood - by[1].log_likelihood) < 1e-3  # float32 sums depend on the batch
    assert abs(by[0].mean_log_likelihood - by[0].log_likelihood / by[0].n_tokens) < 1e-9
    assert P.scored(none).count() == 0


def test_order_matters_to_the_score(spark):
    """Texts of a fixed grammar score higher than the same words shuffled."""
    rng = random.Random(4)
    pairs = [(f"left{i}", f"mid{i}", f"right{i}") for i in range(12)]
    text = lambda: " ".join(w for _ in range(60) for w in rng.choice(pairs))
    rows = [(i, text()) for i in range(300)]
    held = []
    for i in range(20):
        w = text().split()
        held.append((1000 + i, " ".join(w)))
        rng.shuffle(w)
        held.append((2000 + i, " ".join(w)))
    got = {r.doc_id: r.mean_log_likelihood for r in P.scored(spark.createDataFrame(rows + held, "doc_id BIGINT, text STRING")).collect()}
    assert all(got[1000 + i] > got[2000 + i] + 0.5 for i in range(20))


def lexicon_of(texts, floor=2, near=None):
    """A lexicon counted in plain Python; only ``near`` of its words are broadcast."""
    words = Words(*utf8(pa.array(texts)))
    ends = P.endings(words)
    counts = Counter(words.hash.tolist())
    shared = dict(zip(words.hash.tolist(), ends.tolist()))
    totals = np.zeros(P.ENDINGS, np.int64)
    for w, n in counts.items():
        if n < floor:
            totals[shared[w] - P.KNOWN] += n
    known = sorted(w for w, n in counts.items() if near is None or n >= near)
    return P.Lexicon(np.array(known, np.uint64), np.array([counts[w] for w in known], np.int64), np.array([shared[w] for w in known], np.int64), totals, floor), counts


def plain_scores(texts, w, counts, symbol, totals):
    """Scores by a loop over every word and a full softmax, without any batching."""
    out = []
    for text in texts:
        words = Words(*utf8(pa.array([text])))
        sym = [symbol(h, e) for h, e in zip(words.hash.tolist(), P.endings(words).tolist())]
        total = 0.0
        for i, (h, s) in enumerate(zip(words.hash.tolist(), sym)):
            around = [sym[i + d] if 0 <= i + d < len(sym) else P.EDGE for d in P.PLACES]
            hidden = np.tanh(np.concatenate([w["E"][c] for c in around]).astype(float) @ w["W"] + w["b"])
            logits = hidden @ w["C"] + w["c"]
            total += logits[s % P.CLASSES] - np.log(np.exp(logits).sum())
            logits = w["O"][s % P.CLASSES] @ hidden + w["o"][s % P.CLASSES]
            total += logits[s // P.CLASSES] - np.log(np.exp(logits).sum())
            if s >= P.KNOWN:
                total += np.log(counts[h] / totals[s - P.KNOWN])
        out.append(total)
    return out


def test_scores_against_a_plain_double_loop(spark, odd_rows, monkeypatch):
    """The whole operator: counts, symbols, shares that are broadcast or joined, and the net."""
    rng = random.Random(8)
    texts = [r[1] for r in odd_rows if r[1] and len(r[1]) < 5000] + [" ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING").repartition(4)
    weights = []
    monkeypatch.setattr(P, "NEAR", 40)
    fit = P.fit
    monkeypatch.setattr(P, "fit", lambda *a: weights.append(fit(*a)) or weights[0])
    monkeypatch.setattr(P, "reached", lambda counts, most: 4 if most == P.KNOWN else 3)
    got = {r.doc_id: r.log_likelihood for r in P.scored(docs).collect()}
    lexicon, counts = lexicon_of(texts, floor=4)
    own = sorted((w for w, n in counts.items() if n >= 4), key=lambda w: (-counts[w], w))
    number = {w: i for i, w in enumerate(own)}
    want = plain_scores(texts, weights[0], counts, lambda h, e: number.get(h, e), lexicon.totals)
    assert len(own) > 5 and max(abs(got[i] - x) / max(1, abs(x)) for i, x in enumerate(want)) < 1e-5


def test_probabilities_of_all_words_sum_to_one():
    rng = random.Random(1)
    texts = [" ".join(f"{rng.choice('abc')}{int(rng.expovariate(0.05))}" for _ in range(200))]
    lexicon, counts = lexicon_of(texts)
    network = P.Network()
    total = []
    for s in range(P.VOCABULARY):
        row = np.array([P.EDGE] * 3 + [s] + [P.EDGE] * 3)
        total.append(network.log_probabilities(row, 3, 4)[0])
    assert abs(np.exp(total).sum() - 1) < 1e-4
    for s in set(lexicon.symbol[lexicon.symbol >= P.KNOWN].tolist()):
        assert abs(np.exp(lexicon.share[lexicon.symbol == s]).sum() - 1) < 1e-5


def test_threshold_leaves_at_most_so_many_words(spark):
    counts = spark.createDataFrame([(i, 0, n) for i, n in enumerate([900, 500, 70, 70, 9, 3, 3, 3] + [1] * 50)], "word BIGINT, shared INT, n BIGINT")
    assert [P.reached(counts, k) for k in (1, 2, 3, 4, 5, 7, 8, 57, 58)] == [900, 500, 500, 70, 9, 9, 3, 3, 1]
    assert P.reached(counts, 0) > 900 and P.reached(counts.limit(0), 5) > 0


def test_gradients_are_those_of_the_score(monkeypatch):
    """Each parameter's step against a numerical derivative of the mean log-probability."""
    rng = np.random.default_rng(0)
    row = rng.integers(0, P.VOCABULARY - 1, 60)
    row[:3] = row[-3:] = row[20:23] = P.EDGE
    network = P.Network({k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in P.SHAPES.items()})
    place = np.flatnonzero(row[3:-3] != P.EDGE)
    mean = lambda w: P.Network(w).log_probabilities(row, 3, 57)[place].mean(dtype=float)
    grads = {}
    monkeypatch.setattr(P.Network, "update", lambda self, k, g, rows=None: grads.__setitem__(k, (g, rows)))
    assert abs(network.train(row, 3, 57) - mean(network.w)) < 1e-4
    for k, (g, rows) in grads.items():
        full = np.zeros(P.SHAPES[k])
        full[rows if rows is not None else slice(None)] = g
        for at in zip(*np.unravel_index(np.argsort(-np.abs(full), axis=None)[:6], full.shape)):
            up, down = ({n: v.copy() for n, v in network.w.items()} for _ in range(2))
            up[k][at] += 0.02
            down[k][at] -= 0.02
            assert abs(-full[at] / 32 - (mean(up) - mean(down)) / 0.04) < 2e-3


def test_training_raises_the_score_of_every_word():
    for texts in (["one"], ["one", "two words", "and now five more words", ""]):
        words = Words(*utf8(pa.array(texts)))
        lexicon, _ = lexicon_of(texts, floor=1)
        network = P.Network()
        row, at = P.laid(lexicon.look(words)[0], words)
        before = network.log_probabilities(row, 3, len(row) - 3)[at - 3]
        assert P.train_on(network, words, lexicon, np.random.default_rng(0)) == sum(len(t.split()) for t in texts)
        assert (network.log_probabilities(row, 3, len(row) - 3)[at - 3] > before).all()


def test_repeated_texts_score_above_single_ones(spark):
    """Words of its own that a text shares with its copy are twice as likely as those it has alone,
    so its mean is higher by about log 2; what the network makes of endings varies by text."""
    rng = random.Random(6)
    text = lambda: " ".join(f"{''.join(rng.choice('bcdfgh') for _ in range(9))}" for _ in range(80))
    rows = [(i, text()) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(100)]
    got = {r.doc_id: r.mean_log_likelihood for r in P.scored(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    twice, once = (sorted(got[i] for i in part) for part in (range(100), range(100, 200)))
    assert 0.55 < sum(twice) / 100 - sum(once) / 100 < 0.85
    assert sum(a > b for a in twice for b in once) > 0.99 * 100 * 100 and twice[5] > once[-6]


def test_weights_pack_and_unpack():
    w = P.Network().w
    again = P.shaped(P.flat(w))
    assert all((again[k] == w[k]).all() for k in w)


def test_tree_of_means(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN", 3)
    rows = [(p, b, p + 1, np.array([p, b], "<f4").tobytes()) for p in range(20) for b in range(2)]
    got = P.averaged(spark.createDataFrame(rows, "part INT, block INT, n BIGINT, w BINARY")).collect()
    want = sum(p * (p + 1) for p in range(20)) / sum(p + 1 for p in range(20))
    assert sorted(r.block for r in got) == [0, 1]
    assert all(np.allclose(np.frombuffer(r.w, "<f4"), [want, r.block]) for r in got)
