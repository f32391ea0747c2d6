import random
import re
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import components, similarity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sets(text):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(class_id, text_class, n_links) of each document by comparing all pairs."""
    lead = {}
    for key, text in sorted(rows):
        lead.setdefault(text or "", key)
    sh = {k: sets(t) for t, k in lead.items()}
    links, parent = Counter(), {k: k for k in sh}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sh)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sh[a] & sh[b])
            if n and n >= 0.8 * (len(sh[a]) + len(sh[b]) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (find(lead[t or ""]), lead[t or ""], links[lead[t or ""]]) for k, t in rows}


def got(df):
    return {r.doc_id: (r.class_id, r.text_class, r.n_links) for r in similarity.near_duplicates(df).collect()}


def test_against_all_pairs_on_documents(documents):
    assert got(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows(odd, odd_rows):
    assert got(odd) == brute([(d[0], d[1]) for d in odd_rows if d[0] is not None]) | {None: (None, None, 0)}


def test_rows_without_an_id_have_classes_too(spark):
    text = " ".join(f"w{i}" for i in range(40))
    only = " ".join(f"v{i}" for i in range(40))
    rows = [(None, text), (5, text + " more"), (5, "x y z"), (None, only), (None, only), (None, only + " more"), (7, "lone")]
    out = sorted((r.doc_id, r.class_id, r.text_class, r.n_links) for r in similarity.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect() if r.doc_id)
    assert out == [(5, 5, 5, 0), (5, 5, 5, 1), (7, 7, 7, 0)]
    rest = sorted(((r.class_id, r.text_class, r.n_links) for r in similarity.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect() if r.doc_id is None), key=str)
    assert rest == [(5, None, 1), (None, None, 1), (None, None, 1), (None, None, 1)]


def test_texts_of_one_template_do_not_percolate(spark, monkeypatch):
    """Pairs of like texts share buckets but are far below the threshold: what is dealt out for
    exact comparison is the near copies alone."""
    rng = random.Random(7)
    shared = [f"t{rng.randrange(10**6)}" for _ in range(62)]  # a similarity of 0.47
    rows = [(i, " ".join(shared + [f"u{rng.randrange(10**6)}" for _ in range(33)])) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(40)]
    seen = []
    whole = similarity.components
    monkeypatch.setattr(similarity, "components", lambda e: seen.append(e.count()) or whole(e))
    monkeypatch.setattr(similarity, "SKETCHES", 32)
    assert got(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")) == brute(rows)
    assert seen[0] < 2000  # edges over all buckets; 300 texts of one component would have 57,000 pairs


def test_edges_join_what_all_pairs_would():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (12, 150), dtype=np.uint8)
    sketch = np.repeat(base, 9, 0)
    noise = rng.random(sketch.shape) < 0.14
    sketch[noise] = rng.integers(0, 256, noise.sum())
    need = similarity.least_matches(0.8, similarity.TOLERANCE)
    for sides in (None, (np.arange(50), np.arange(50, len(sketch)))):
        parent = list(range(len(sketch)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(sketch)):
            for j in range(i):
                if sides is not None and (i < 50) == (j < 50):
                    continue
                if all((sketch[i, :n] == sketch[j, :n]).sum() >= m for n, m in need.items()):
                    parent[find(i)] = find(j)
        want = {frozenset(k for k in range(len(sketch)) if find(k) == r) for r in {find(k) for k in range(len(sketch))}}
        parent = list(range(len(sketch)))
        for i, j in similarity.joined_by_sketch(sketch, sides, need):
            parent[find(i)] = find(j)
        assert {frozenset(k for k in range(len(sketch)) if find(k) == r) for r in {find(k) for k in range(len(sketch))}} == want


def test_empty_table(none):
    assert similarity.near_duplicates(none).count() == 0
    assert similarity.keep_one(none).count() == 0


def test_large_groups_in_blocks(spark, monkeypatch):
    """A group of near copies over many blocks, with texts near the threshold."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(50))) for i in range(60)]
    assert got(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")) == brute(rows)


def test_exact_copies_are_one_class_and_one_stays(spark):
    rows = [(i, "the same seven words in every row") for i in range(500)] + [(900, "another text of its own words")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert set(got(df).values()) == {(0, 0, 0), (900, 900, 0)}
    assert sorted(r.doc_id for r in similarity.keep_one(df).collect()) == [0, 900]


def test_repeated_rows_do_not_link_to_themselves(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text + " more"), (2, text + " more"), (3, "x y z")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    out = sorted((r.doc_id, r.class_id, r.n_links) for r in similarity.near_duplicates(df).collect())
    assert out == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 3, 0)]
    assert sorted(r.doc_id for r in similarity.keep_one(df).collect()) == [1, 3]


def test_of_equal_ids_one_stays(odd):
    kept = [r.doc_id for r in similarity.keep_one(odd).collect()]
    assert sorted(k for k in kept if k is not None) == [0, 3, 5, 6, 7, 8, 9, 10] and kept.count(None) == 1


def test_pruning_keeps_pairs_at_the_threshold():
    """At a similarity of 0.8 a pair is pruned with a probability near the tolerance."""
    need = similarity.least_matches(0.8, similarity.TOLERANCE)
    rng = np.random.default_rng(0)
    same = rng.random((200_000, 150)) < 0.8
    lost = np.zeros(len(same), bool)
    for n, m in need.items():
        lost |= same[:, :n].sum(1) < m
    assert lost.mean() < 1e-4
    far = rng.random((2000, 150)) < 0.3
    assert all((far[:, :n].sum(1) < m).mean() > 0.99 for n, m in need.items() if n >= 60)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(5, i) for i in range(10) if i != 5] + [(20, 21), (22, 21)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u BIGINT, v BIGINT")
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {r.u: r.v for r in components.components(df).collect()} == {x: find(x) for x in parent if find(x) != x}


def test_columns_named_like_helpers_stay(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "a", 1, 2), (2, text, "b", 3, 4), (3, "other", "c", 5, 6)], "doc_id BIGINT, text STRING, _number STRING, number INT, class_id INT")
    got = similarity.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, text, "a", 1, 2), (3, "other", "c", 5, 6)]


def test_texts_of_a_large_component_are_dealt_once(spark):
    """A component of 20,000 classes: each text goes to one block, and the first one to all."""
    labelled = spark.range(20_000).selectExpr("id + 5 AS doc", "5L AS root").union(spark.range(3).selectExpr("id + 50000 AS doc", "50000L AS root"))
    sizes = labelled.groupBy("root").count().withColumnRenamed("count", "n")
    rows = similarity.in_blocks(labelled, sizes).toPandas()
    blocks = -(-20_000 // similarity.BLOCK)
    assert len(rows) == 20_003 + blocks
    copies = rows[rows["copy"] == 1]
    assert sorted(copies.block) == list(range(blocks)) and set(copies.doc) == {5}
    assert rows[rows["copy"] == 0].groupby("block").size().max() < 2 * similarity.BLOCK


def test_differences_count_as_whole_sets_do():
    """Shared shingles of two sets from what they lack of a third, and differ from it by."""
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 400, 90).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(0, 80)), rng.integers(0, 800, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(40)]
    differs = [np.setxor1d(base, s, assume_unique=True) for s in sets]
    lacks = np.array([len(np.setdiff1d(base, s)) for s in sets])
    left, right = np.triu_indices(len(sets), 1)
    got = len(base) - lacks[left] - lacks[right] + similarity.in_common(differs, left, right)
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right)]
    assert lacks.tolist() == [len(base) - (len(base) + len(s) - len(d)) // 2 for s, d in zip(sets, differs)]
