import hashlib
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from larkspur.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
words = lambda t: WORD.findall((t or "").translate(LOWER))


def brute(docs, bench):
    patterns = defaultdict(set)
    for item, text in bench:
        w = words(text)
        m = min(10, len(w))
        if m:
            for i in range(len(w) - m + 1):
                patterns[tuple(w[i : i + m])].add(str(item) if item is not None else None)
    out = []
    for key, text in docs:
        w, hit, items = words(text), set(), set()
        for m in {len(p) for p in patterns}:
            for i in range(len(w) - m + 1):
                if found := patterns.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    items |= found - {None}  # an item without an id hits, but has no name
        out.append((key, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(docs, bench, **more):
    return sorted((tuple(r) for r in D.digest(D.contamination(docs, bench, **more)).collect()), key=str)


def test_documents(spark, documents, data):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in documents.collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert got(documents, bench) == want and any(r[-1] for r in want)


@pytest.fixture(scope="module")
def bench(spark):
    text = " ".join(f"b{i}" for i in range(14))
    rows = [(1, text), (1, text), (2, "one TWO"), (3, "é ñ"), (4, None), (5, ""), (6, "..."), (None, "no id here"), (10, "b3 b4 b5 b6 b7 b8 b9 b10 b11 b12")]
    return spark.createDataFrame(rows, "item_id BIGINT, text STRING")


def documents_with_hits(spark, odd_rows):
    text = " ".join(f"b{i}" for i in range(14))
    rows = [(d[0], d[1], "e") for d in odd_rows]
    rows += [(50, f"pre {text.upper()} post", "e"), (51, text.replace(" ", ", "), "e"), (52, "b3 " * 30 + text[:20], "e"), (53, f"{text} {text}", "e"), (54, text + "x", "e"), (54, text + "x", "e")]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, items STRING")


@pytest.mark.parametrize("pass_bytes", [32 << 20, 40])
def test_odd_rows_in_one_pass_and_in_several(spark, odd_rows, bench, pass_bytes):
    docs = documents_with_hits(spark, odd_rows)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert got(docs, bench, pass_bytes=pass_bytes) == want


def test_empty_tables(odd, none, bench, spark):
    assert got(none, bench) == []
    rows = got(odd, spark.createDataFrame([], bench.schema))
    assert len(rows) == odd.count() and not any(r[-1] for r in rows)


def test_shift_table_skips(spark):
    (m,) = D.compile_patterns([("1", " ".join(f"p{i}" for i in range(10)))])
    assert m.shift.max() == 9 and (m.shift == 9).mean() > 0.95


def test_stage_drops_hit_documents_only(spark, odd_rows, bench):
    docs = documents_with_hits(spark, odd_rows)
    kept = D.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {0, 1, 2, 3, 4, 5, 8, 9, 52} <= ids and not ids & {50, 51, 53, 54, 6, 7, None}  # that row holds the item without an id


def test_patterns_of_one_hash_are_all_compared(spark, odd_rows, bench, monkeypatch):
    monkeypatch.setattr(D.Matcher, "window_hash", staticmethod(lambda h: h[:, 0] & D.np.uint64(3)))
    docs = documents_with_hits(spark, odd_rows).where("doc_id <> 5").collect()
    matchers = D.compile_patterns([(str(r.item_id) if r.item_id is not None else None, r.text) for r in bench.collect()])
    from larkspur.llm.kit import utf8

    found = D.kernel(matchers)(None, *utf8(pa.array([r.text for r in docs])))
    want = {(k, n, h) for k, n, h, *_ in brute([(r.doc_id, r.text) for r in docs], [tuple(r) for r in bench.collect()])}
    assert {(r.doc_id, int(n), int(h)) for r, n, h in zip(docs, found["n_words"], found["n_hit"])} == want


def test_memory_of_a_pass():
    """A pass holds its text and some 30 bytes a word beside the words' hashes."""
    import random
    import tracemalloc

    rng = random.Random(1)
    items = [(str(i), " ".join(f"w{rng.randrange(10**5)}" for _ in range(400))) for i in range(500)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    matchers = D.compile_patterns(items)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert matchers and held < 16 * size


def test_items_without_an_id_hit_and_are_not_named(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "before " + text + " after"), (2, "clean words")], "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame([(None, text), (5, "nothing of it"), (6, None)], "item_id BIGINT, text STRING")
    for pass_bytes in (1 << 20, 20):
        got = {r.doc_id: r for r in D.digest(D.contamination(docs, bench, pass_bytes=pass_bytes)).collect()}
        assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (11, 0, True) and not got[2].contaminated
        assert [r.doc_id for r in D.keep_clean(docs, bench, pass_bytes=pass_bytes).collect()] == [2]
