import re

import numpy as np
import pytest

from larkspur.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base counts of one text, by plain Python."""
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def checked(rows, texts):
    for r, text in zip(rows, texts):
        want = plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_base_counts_of_supplied_texts(spark, documents, data):
    got = rules.predictions(documents, spark.read.parquet(f"{data}/labels.parquet")).orderBy("doc_id").collect()
    checked(got, [r.text for r in documents.orderBy("doc_id").select("text").collect()])


def test_base_counts_of_odd_texts(spark, odd, labels):
    texts = ["", None, "\n\n", "a", "a b\na b\n\na b \n", "x\ny\nx\n", "é ñ 日本 x y\u0085z 𝒳 # <>|", "a b c d e f g h " * 3, "a b c d e f g h i j k " * 2 + "b c d e f g h i", "\r\n\v\f\t x", "x\u0000y \u0000", " \n \n", "q" * 70000 + "\n" + "q" * 70000, "w v " * 90000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    checked(rules.predictions(docs, labels).orderBy("doc_id").collect(), texts)
    got = rules.verdicts(odd, labels).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[3][1:] == by[4][1:] and by[0][1:] == by[1][1:]


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = rules.predictions(docs, labels).join(labels, "doc_id").where("held_out AND NOT base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() >= 0.98
    assert got[got.quality == 0].kept.mean() <= 0.1


def test_same_verdicts_in_any_partitioning(spark, documents, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    clash = documents.selectExpr("IF(doc_id % 3 = 0, NULL, IF(doc_id % 3 = 1, 7, doc_id)) AS doc_id", "text", "source AS label", "lang AS _place", "1 AS n", "'x' AS statistics")
    a = sorted(map(str, rules.verdicts(clash.repartition(2), labels).collect()))
    b = sorted(map(str, rules.verdicts(clash.repartition(7), labels).collect()))
    assert a == b


def test_without_labels_or_rows(spark, odd, none, labels):
    empty = spark.createDataFrame([], labels.schema)
    assert all(r.kept != r.base_failed for r in rules.verdicts(odd, empty).collect())
    assert rules.predictions(none, labels).count() == 0
    only_good = spark.createDataFrame([(i, 1, 0) for i in range(11)], labels.schema)
    assert all(r.kept != r.base_failed for r in rules.verdicts(odd, only_good).collect())
    assert rules.keep_regular(odd, empty).columns == odd.columns
    assert rules.keep_regular(odd, empty).count() == sum(not r.base_failed for r in rules.verdicts(odd, empty).collect())


def path(forest, row, root):
    """Path length of one row in one tree, by following its nodes."""
    node = root
    while forest.split[node] >= 0:
        node = forest.left[node] if row[forest.split[node]] <= forest.cut[node] else forest.right[node]
    return forest.length[node]


def test_forest_against_plain_walks():
    rng = np.random.default_rng(2)
    rows = rng.normal(0, 1, (900, 4)).astype(np.float32)
    rows[:, 3] = 0  # never split
    forest = rules.Forest(rows, 20)
    want = [2 ** (-np.mean([path(forest, r, t) for t in forest.roots]) / rules._expected(256)) for r in rows[:50]]
    assert forest.score(rows[:50]) == pytest.approx(want)
    assert 3 not in forest.split
    far = np.array([[9, 9, 9, 0]], np.float32)
    assert forest.score(far)[0] > np.quantile(forest.score(rows), 0.99)


def test_threshold():
    good, poor = np.array([0.1, 0.2, 0.3]), np.array([0.25, 0.6, 0.7])
    assert rules.calibrated(good, poor, 4.0) == pytest.approx(0.45)
    assert 0.2 <= rules.calibrated(good, poor, 0.5) < 0.25


def test_all_labelled_rows_are_learned_from(spark):
    """More rows of a label than a bound of 4,000 would keep; every one counts."""
    rng = np.random.default_rng(4)
    texts = [" ".join("x" * int(k) + str(i) for k in rng.integers(1, 30, 25)) for i in range(9000)]
    texts += [" ".join(f"##{i}x{j}$$" for j in range(25)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(3)
    labels = spark.range(len(texts)).selectExpr("id AS doc_id", "CAST(id < 9000 AS INT) AS quality")
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    c = rules.counts(buf, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    open_ = ~rules.fails(c["n_words"], c["n_repeat_words"])
    good = c["statistics"][:9000][open_[:9000]].astype(float)
    assert len(good) == 9000
    middle = np.median(good, axis=0)
    model = rules.fit(docs, labels)
    assert model.tolerance == pytest.approx(middle + rules.SLACK * (np.quantile(good, rules.TOLERATED, axis=0) - middle))
    assert rules.fit(docs.repartition(5), labels).threshold == model.threshold


def test_ranks_and_trees_of_all_rows(spark):
    rng = np.random.default_rng(6)
    values = np.abs(rng.normal(0, 1, (6000, len(rules.STATISTICS)))).astype(np.float32)
    values[:, 1] = 0
    values[:, 2] = np.round(values[:, 2])
    rows = [(int(i % 20 != 0), i, v.view(np.int32).tolist()) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "label INT, _place BIGINT, statistics ARRAY<INT>").repartition(3)
    ranks = [0, 1, 2999, 5994, 5999]
    assert (rules.of_rank(df, ranks) == np.sort(values, axis=0)[ranks].T).all()
    trees = rules.drawn(df, 5700, 300)
    poor = {v.tobytes() for v in values[::20]}
    seen = [{r.tobytes() for r in t} for t in trees]
    assert len(trees) == rules.TREES and all(len(t) == rules.IN_TREE == len(s) for t, s in zip(trees, seen))
    assert all(0 < len(s & poor) <= rules.IN_TREE / rules.POOR_SHARE + 1 for s in seen)
    assert len(set.union(*seen)) > 5900  # of 6,000
    few = rules.drawn(df.where("_place < 100"), 95, 5)
    assert all(len(t) == 100 for t in few)
    assert not (few[0] == few[1]).all()
