import numpy as np

from larkspur.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.predictions(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95
    assert got[got.quality == 1].predicted.mean() >= 0.98


def test_odd_rows(odd, labels):
    got = quality.predictions(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[0] == by[1] and by[3] == by[4]


def test_without_labels_or_rows(odd, none, labels, spark):
    empty = spark.createDataFrame([], labels.schema)
    assert {r.score for r in quality.scores(odd, empty).collect()} == {0.5}
    assert quality.predictions(none, labels).count() == 0


def test_labels_of_the_held_out_fold_are_not_learned_from(spark, documents, data):
    from larkspur.llm.kit import bucket

    labels = spark.read.parquet(f"{data}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(bucket("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.predictions(documents, labels).collect()}
    b = {r.doc_id: r.score for r in quality.predictions(documents, flipped).collect()}
    assert a == b


def test_risk_learns_from_positives_and_unlabelled_only():
    rng = np.random.default_rng(0)
    good = lambda n: rng.normal(1, 0.5, (n, quality.N_FEATURES))
    bad = lambda n: rng.normal(-1, 0.5, (n, quality.N_FEATURES))
    model = quality.Network().fit(good(500), np.concatenate([good(600), bad(400)]), 0.6)
    assert model.score(good(200)).min() > 0.7 > model.score(bad(200)).max()


def test_prior_from_best_bin():
    rng = np.random.default_rng(1)
    p, n = rng.beta(8, 2, 4000), rng.beta(2, 8, 4000)
    assert abs(quality.best_bin_prior(p[:2000], np.concatenate([p[2000:3200], n[:800]])) - 0.6) < 0.1


def test_stage_keeps_columns(odd, labels):
    assert quality.keep_good(odd, labels).columns == odd.columns


def plain_features(text):
    """The features of one text, by plain Python."""
    import math
    import re

    raw = text.encode()
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered))
    words, low = [text[m.start() : m.end()] for m in found], [m[0] for m in found]
    size, n = max(1, len(raw)), max(1, len(words))
    length = [len(w.encode()) for w in words]
    triples = {tuple(low[max(0, i - 2) : i + 1]) for i in range(len(low))}
    count = lambda test: sum(map(test, raw))
    out = [math.log1p(len(words)), math.log1p(size), count(lambda c: 65 <= c <= 90) / size, count(lambda c: 48 <= c <= 57) / size, count(lambda c: c >= 128) / size, count(lambda c: c == 10) / n, count(lambda c: c == 32) / size]
    out += [count(lambda c: c > 32 and c < 128 and not chr(c).isalnum()) / size, sum(length) / n, math.sqrt(sum(x * x for x in length) / n), sum(a == b for a, b in zip(low, low[1:])) / n, len(set(low)) / n, len(triples) / n]
    out += [sum("A" <= w[0] <= "Z" for w in words) / n, sum(x <= 2 for x in length) / n, 1.0]
    out += [min(2, text.count(c) / n) for c in quality.SIGNS]
    out += [min(2, sum(a == b == c for a, b in zip(text, text[1:])) / n) for c in quality.SIGNS]
    return out


def test_scores_against_a_plain_loop(spark, documents, data):
    """The query against features and network worked out text by text."""
    import math

    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality.fit(documents, labels, held_out=quality.held("doc_id"))
    got = {r.doc_id: r for r in quality.predictions(documents, labels).collect()}
    for d in documents.limit(80).collect():
        x = plain_features(d.text) if d.text else [0.0] * quality.N_FEATURES
        scores = []
        for m in model.members:
            z = [max(-6, min(6, (a - b) / s)) for a, b, s in zip(x, m.mean, m.scale)]
            hidden = [math.tanh(sum(a * w for a, w in zip(z, column)) + b) for column, b in zip(m.p[0].T, m.p[1])]
            scores.append(1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, m.p[2])) + m.p[3][0]))))
        assert abs(got[d.doc_id].score - sum(scores) / len(scores)) < 1e-3


def test_labels_other_than_one_are_not_used(spark, documents, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    a, b = ({r.doc_id: r.score for r in quality.predictions(documents, x).collect()} for x in (labels, labels.where("quality = 1")))
    assert a == b


def test_rows_without_an_id_are_of_no_fold(odd, labels):
    assert [r.held_out for r in quality.predictions(odd, labels).collect() if r.doc_id is None] == [False]


def test_same_scores_in_any_partitioning_with_repeated_and_null_ids(spark, documents, data):
    labels = spark.read.parquet(f"{data}/labels.parquet").union(spark.createDataFrame([(7, 1, 0)], "doc_id BIGINT, quality INT, toxic INT"))
    clash = documents.selectExpr("IF(doc_id % 3 = 0, NULL, IF(doc_id % 3 = 1, 7, doc_id)) AS doc_id", "text")
    a = sorted(map(str, quality.scores(clash.repartition(2), labels).collect()))
    b = sorted(map(str, quality.scores(clash.repartition(7), labels).collect()))
    assert a == b and len(set(a)) > 5


def test_all_documents_stay_where_nothing_is_labelled_good(spark, odd, labels):
    for none_good in (spark.createDataFrame([], labels.schema), labels.where("quality = 0")):
        assert sorted(map(str, quality.keep_good(odd, none_good).collect())) == sorted(map(str, odd.collect()))
