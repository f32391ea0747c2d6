import corpus_pipeline
import __spark_entry__
from larkspur.llm import packing


def test_stages_take_effect_and_keep_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, before = docs.columns, docs.count()
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        assert docs.columns == names
        counts.append(docs.count())
    assert before > counts[0] > counts[1] >= counts[2] == counts[3] > 0.5 * before
    assert docs.where("length(text) <> n_chars").count() == 0
    assert docs.where("text rlike '(?i)token = \"[0-9a-f]{24,}'").count() == 0


def test_run_packs_what_the_stages_keep(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in rows} and all(r.length > 0 for r in rows)
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert max(r.offset + r.length for r in rows) <= packing.WINDOW


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_sql_of_the_operators(spark, data):
    import duckdb

    from larkspur.llm import queries

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, data)
        columns = sorted(df.columns)
        result = c.execute(sql)
        place = {d[0]: i for i, d in enumerate(result.description)}
        want = sorted((tuple(r[place[k]] for k in columns) for r in result.fetchall()), key=str)
        assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == want, name


def test_rows_without_an_id_or_with_a_repeated_one_go_by_their_own_text(spark):
    """Each stage on null and repeated ids: what it decides for a text holds for that row only."""
    from larkspur.llm import decontamination, secrets, similarity

    item = " ".join(f"q{i}" for i in range(12))
    secret = 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y'
    texts = ["clean words of one row", "other clean words, not of that row", item, secret]
    rows = [(k, t) for k in (None, 7) for t in texts] + [(None, texts[0]), (3, item)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    bench = spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")
    seen = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert seen(decontamination.keep_clean(docs, bench)) == sorted([r for r in rows if r[1] != item], key=str)
    assert seen(similarity.keep_one(docs)) == sorted([(7, t) for t in texts if t != item] + [(3, item)], key=str)
    masked = 'x token = "[secret]" y'
    assert seen(secrets.redact(docs)) == sorted([(k, masked if t == secret else t) for k, t in rows], key=str)


def test_quality_decides_each_row(spark, data):
    from larkspur.llm import quality

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    by = {r.doc_id: r.score for r in quality.scores(docs, labels, held_out=quality.bucket("doc_id", 5) == 0).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    worst, best = min(by, key=by.get), max(by, key=by.get)
    assert by[worst] < quality.KEEP <= by[best]
    more = [(None, text[worst]), (None, text[best]), (10**12, text[worst]), (10**12, text[best])]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id BIGINT, text STRING"))
    kept = [(r.doc_id, r.text) for r in quality.keep_good(both, labels).where("doc_id IS NULL OR doc_id = 1000000000000").collect()]
    assert sorted(kept, key=str) == sorted([(None, text[best]), (10**12, text[best])], key=str)


def test_stages_against_brute_force(spark, odd, odd_rows, labels, monkeypatch):
    """Each stage of the pipeline on null, repeated, empty and long rows with clashing columns:
    what it keeps, by plain Python."""
    import random
    from test_decontamination import brute as hits
    from test_packing import check
    from test_secrets import plain
    from test_similarity import brute as classes

    from larkspur.llm import decontamination, quality, secrets, similarity

    rng = random.Random(11)
    extra = [(None, odd_rows[0][1], "en", "a", 1, None, "y"), (0, "x token: abcdefgh12 y", None, None, None, None, None), (20, " ".join(f"q{i}" for i in range(12)), "en", "a", 1, None, None)]
    docs = odd.unionByName(spark.createDataFrame(extra, odd.schema)).repartition(3)
    rows = [tuple(r) for r in docs.collect()]
    seen = lambda df: sorted((tuple(r) for r in df.collect()), key=str)

    got = seen(quality.keep_good(docs, labels))
    score = {}
    for r in docs.join(quality.scores(docs.select("doc_id", "text"), labels, held_out=quality.held("doc_id")).withColumnRenamed("score", "s").distinct(), "doc_id").collect():
        score.setdefault((r.doc_id, r.text), set()).add(r.s >= quality.KEEP)
    unsure = {k for k, v in score.items() if len(v) > 1}  # of a repeated id with several texts
    for r in rows:
        if r[0] is not None and (r[0], r[1]) not in unsure:
            assert (r in got) == (score[r[0], r[1]] == {True})

    numbers = [(i, r[1]) for i, r in enumerate(rows)]
    group = {i: c[0] for i, c in classes(numbers).items()}
    kept = seen(similarity.keep_one(docs))
    members = {}
    for i, g in group.items():
        members.setdefault(g, []).append(i)
    assert len(kept) == len(members)
    for own in members.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        assert any(rows[i] in kept and rows[i][0] == (min(ids) if ids else None) for i in own)

    item = [(1, " ".join(f"q{i}" for i in range(12)))]
    clean = seen(decontamination.keep_clean(docs, spark.createDataFrame(item, "item_id BIGINT, text STRING")))
    hit = {i for i, *_, bad in hits(numbers, item) if bad}
    assert clean == sorted((r for i, r in enumerate(rows) if i not in hit), key=str) and hit

    for r, m in zip(sorted(rows, key=lambda r: (str(r[0]), str(r[2:]))), sorted((tuple(r) for r in secrets.redact(docs).collect()), key=lambda r: (str(r[0]), str(r[2:])))):
        if r[1] and plain(r[1]):
            assert secrets.MASK in m[1] and not plain(m[1].replace(secrets.MASK, ""))
    same = [r for r in rows if not (r[1] and plain(r[1]))]
    masked = seen(secrets.redact(docs))
    assert all(r in masked for r in same) and len(masked) == len(rows)

    keyed = spark.createDataFrame([(i, r[1], r[3]) for i, r in enumerate(rows)], "doc_id BIGINT, text STRING, source STRING")
    check(packing.pack(keyed).collect(), {i: r[1] or "" for i, r in enumerate(rows)})


def test_stages_on_an_empty_table(spark, none, data):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0


def test_the_pipeline_without_labels_keeps_what_the_other_stages_keep(spark, data, tmp_path):
    """An empty labels table: nothing is known by which to reject a document."""
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    labels.where("false").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).count() == docs.count()
    with_labels = {r.doc_id for r in corpus_pipeline.run(spark, data).select("doc_id").distinct().collect()}
    without = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert len(without) > len(with_labels)
