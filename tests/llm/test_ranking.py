import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from larkspur.llm import ranking
from larkspur.llm.queries import ORACLES, op13_threshold

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """Every document scored for every item."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, scores = set(terms(text)), []
        for d, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, d is None, d, s))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(scores[:k])]
    return out


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_against_all_scores(spark, documents, data):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    got = ranking.search(documents.repartition(5), bench, k=7).collect()
    same(got, plain([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in bench.collect()], 7))


def test_query_equals_its_sql(spark, data):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    columns = ["item_id", "rank", "doc_id", "score"]
    want = c.sql(ORACLES["op13_threshold"]).select(*columns).fetchall()
    same(op13_threshold(spark, data).select(*columns).collect(), want)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 40)
    monkeypatch.setattr(ranking, "FIRST_DEPTH", 1)


def test_many_blocks_ties_and_groups(spark, small_blocks):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"W{int(x)}" for x in rng.zipf(1.4, n) % 60)
    docs = [(i, text(rng.integers(1, 30))) for i in range(300)]
    docs += [(i % 40, docs[5][1]) for i in range(120)] + [(None, docs[5][1]), (None, None), (3, ""), (4, "..."), (5, "w1 " * 20000)]
    items = [(i, text(6)) for i in range(12)] + [(3, docs[5][1]), (3, docs[5][1]), (None, "w1 w2 unseen"), (20, None), (21, "--"), (22, "unseen")]
    got = lambda **more: ranking.search(spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(3), spark.createDataFrame(items, "item_id BIGINT, text STRING"), k=5, **more).collect()
    same(got(), plain(docs, items, 5))
    same(got(group_bytes=200), plain(docs, items, 5))


def test_odd_rows(spark, odd, odd_rows, none):
    bench = spark.createDataFrame([("a", "One two PRE token words", 1), ("b", "é ñ 日本 ß", 2), ("c", None, 3)], "item_id STRING, text STRING, rank INT")
    same(ranking.search(odd, bench).collect(), plain([(r[0], r[1]) for r in odd_rows], [("a", "One two PRE token words"), ("b", "é ñ 日本 ß")], 50))
    assert ranking.search(none, bench).count() == 0
    assert ranking.search(odd, bench.where("false")).count() == 0
    clash = odd.withColumnRenamed("n_chars", "rank").withColumnRenamed("source", "item").withColumnRenamed("lang", "terms")
    assert ranking.search(clash, bench).count() > 0


def test_words_are_compared_byte_by_byte():
    from larkspur.llm.kit import Words, utf8
    import pyarrow as pa

    made = ranking.Terms(["alpha beta gamma-delta extraordinarily " + "z" * 40])
    made.hash = np.full(made.n, 7, np.uint64)  # all terms share a hash
    made.order = np.arange(made.n)
    words = Words(*utf8(pa.array(["beta zeta Gamma extraordinarilz extraordinarily alph " + "z" * 40 + " " + "z" * 39 + "y"])))
    words.hash = np.full(len(words.hash), 7, np.uint64)
    names = ["alpha", "beta", "gamma", "delta", "extraordinarily", "z" * 40]
    got = [names[i] if i >= 0 else None for i in made.number(words)]
    assert got == ["beta", None, "gamma", None, "extraordinarily", None, "z" * 40, None]


def test_stops_before_the_lists_end():
    """With one outstanding document the threshold ends the search at the first depth."""
    n = 5000
    stats = ranking.Statistics(n, n * 10, np.array([n // 2, n // 2]))
    counts = np.ones(2 * n, np.int64)
    counts[:2] = 500
    made = ranking.Block(np.arange(n), np.full(n, 10), np.tile([0, 1], n), counts, np.arange(n + 1) * 2, stats)
    looked = []
    scores = made.scores
    made.scores = lambda docs: looked.append(len(docs)) or scores(docs)
    none = np.zeros(0, np.int64)
    score, ids = made.search(np.array([0, 1]), (none, none), 0, 1)
    assert ids.tolist() == [0] and sum(looked) < n / 10
