import random
import hashlib
"""Readers, writers, the command line and the stream, on files."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur.functions.messages import MESSAGES
from larkspur.plans import cli
from larkspur.sources import readers, sinks
from larkspur.streaming import ingest


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tolerant_jsonl(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"a": 1}\n\n  {"a": 2}  \nbroken\n[1]\n{"a": 3, "b": "x y"}\n')
    assert [r.a for r in readers.jsonl(spark, p, "a INT").orderBy("line_no").collect()] == [1, 2, 3]
    assert [r.a for r in readers.jsonl(spark, p, "a INT", 2).orderBy("line_no").collect()] == [1, 2]


def test_strict_jsonl_numbers_blank_lines(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    assert [r.line_no for r in readers.strict_jsonl(spark, p).orderBy("line_no").collect()] == [1, 3]
    bad = put(tmp_path / "b.jsonl", '{"a": 1}\n[2]\n')
    with pytest.raises(Exception, match="line 2"):
        readers.strict_jsonl(spark, bad).collect()


def test_personas_last_wins(spark, tmp_path):
    rows = [{"persona_id": "a", "summary": "1"}, {"id": "b", "summary": "2", "metadata": {"refined_summary": "R"}}, {"summary": "x"}, {"persona_id": "a", "summary": "3"}]
    p = put(tmp_path / "p.jsonl", "\n".join(map(json.dumps, rows)) + "\nnot json\n")
    got = {r.persona_id: (r.summary, r.refined_summary) for r in readers.personas(spark, p).collect()}
    assert got == {"a": ("3", None), "b": ("2", "R")}


def test_yaml_personas(spark, tmp_path):
    pytest.importorskip("yaml")
    put(tmp_path / "y/one.yaml", "summary: first")
    put(tmp_path / "y/two.yaml", "id: own\nsummary: second")
    assert [(r.persona_id, r.summary) for r in readers.yaml_personas(spark, str(tmp_path / "y")).collect()] == [("one", "first"), ("own", "second")]


def test_sessions_mark_broken_files_and_sample_by_path(spark, tmp_path):
    put(tmp_path / "s/a/x.json", '{"n": 1}')
    put(tmp_path / "s/a-b/x.json", "broken")
    put(tmp_path / "s/c.txt", "no")
    rows = readers.sessions(spark, str(tmp_path / "s")).collect()
    assert sorted(r.ok for r in rows) == [False, True]
    (one,) = readers.sessions(spark, str(tmp_path / "s"), 1).collect()
    assert one.path.endswith("/a/x.json")


def test_behaviors(spark, tmp_path):
    rows = [{"behavior_id": " b ", "guidance_template": "t", "name": "old"}, {"behavior_id": "b", "guidance_template": "t", "name": "new"}, {"behavior_id": "c", "guidance_template": "  "}, {"guidance_template": "t"}]
    p = put(tmp_path / "b.jsonl", "\n".join(map(json.dumps, rows)))
    assert [(r.behavior_id, r.name) for r in readers.behaviors(spark, p).collect()] == [("b", "new")]


def test_scenario_cache(spark, tmp_path):
    put(tmp_path / "c/p1__affective.json", json.dumps([{"scenario_id": "s", "initial_prompt": "i"}, {"scenario_id": "t"}]))
    put(tmp_path / "c/p2.json", json.dumps([{"scenario_id": "u"}]))
    got = sorted((r.persona_id, r.prefix, r.pos, r.scenario_id) for r in readers.scenario_cache(spark, str(tmp_path / "c")).collect())
    assert got == [("p1", "affective", 0, "s"), ("p1", "affective", 1, "t"), ("p2", "lifelong", 0, "u")]


def test_legacy_cache_serves_one_prefix(spark):
    tasks = spark.createDataFrame([("p", "lifelong"), ("p", "affective"), ("q", "lifelong")], "persona_id STRING, prefix STRING")
    cache = spark.createDataFrame([("q", "lifelong", "new")], "persona_id STRING, prefix STRING, scenarios STRING")
    legacy = spark.createDataFrame([("p", "old"), ("q", "old")], "persona_id STRING, scenarios STRING")
    got = {(r.persona_id, r.prefix): r.scenarios for r in readers.cached_or_legacy(tasks, cache, legacy).collect()}
    assert got == {("p", "lifelong"): "old", ("p", "affective"): None, ("q", "lifelong"): "new"}
    assert {r.scenarios for r in readers.cached_or_legacy(tasks, cache, legacy, True).collect()} == {None}


def test_training_rows_are_equal_in_every_format(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "é")], "i BIGINT, t STRING").coalesce(1)
    df.write.parquet(str(tmp_path / "r.parquet"))
    lines = put(tmp_path / "r.jsonl", "\n".join(json.dumps(r.asDict()) for r in df.collect()))
    array = put(tmp_path / "r.json", json.dumps([r.asDict() for r in df.collect()]))
    want = sorted(map(tuple, df.collect()))
    for p in (str(tmp_path / "r.parquet"), lines, array):
        assert sorted(map(tuple, readers.training_rows(spark, p).select("i", "t").collect())) == want
    bad = put(tmp_path / "bad.jsonl", '{"i": 1}\nbroken\n')
    with pytest.raises(Exception):
        readers.training_rows(spark, bad, "i BIGINT").collect()
    with pytest.raises(ValueError):
        readers.training_rows(spark, "x.csv")


def test_positional_csv(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'a;"b ""q"";";c\nd;e;f\n')
    assert [(r.idx, r._c1) for r in readers.positional_csv(spark, p).orderBy("idx").collect()] == [(0, 'b "q";'), (1, "e")]


def test_json_items_and_folders(spark, tmp_path):
    p = put(tmp_path / "i.json", '[{"q": "x"}, {"q": "y"}]')
    got = readers.json_items(spark, p).select("idx", F.variant_get("item", "$.q", "string").alias("q")).orderBy("idx").collect()
    assert [(r.idx, r.q) for r in got] == [(0, "x"), (1, "y")]
    assert readers.existing_folder("", str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        readers.existing_folder(str(tmp_path / "none"))


def test_ordered_lines(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("pos"), F.format_string("%05d", "id").alias("line")).repartition(5)
    out = str(tmp_path / "o")
    sinks.write_ordered_jsonl(df, out, "pos", "line")
    lines = [x for f in sorted((tmp_path / "o").glob("part-*")) for x in f.read_text().split()]
    assert lines == sorted(lines) and len(lines) == 200
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_ordered_jsonl(df, out, "pos", "line")
    sinks.write_ordered_jsonl(df, out, "pos", "line", overwrite=True)


def test_other_writers(spark, tmp_path):
    df = spark.createDataFrame([("full", "p", "mcq", 1), ("full", "q", "lamp", 2)], "ablation STRING, persona_id STRING, qa_style STRING, v INT")
    sinks.write_sessions(df, str(tmp_path / "s"))
    assert (tmp_path / "s/ablation=full/persona_id=p").exists()
    sinks.write_by_style(df, str(tmp_path / "q"))
    assert {p.name for p in (tmp_path / "q").glob("qa_style=*")} == {"qa_style=mcq", "qa_style=lamp"}
    sinks.append_jsonl(df, str(tmp_path / "j"))
    sinks.append_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.overwrite_by_key(df, str(tmp_path / "k"), "persona_id")
    sinks.overwrite_by_key(df.where("persona_id = 'p'").withColumn("v", F.lit(9)), str(tmp_path / "k"), "persona_id")
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "k")).collect()) == [2, 9]
    sinks.write_json_atomic({"b": 1, "a": "é"}, str(tmp_path / "r/x.json"), True)
    assert list(json.loads((tmp_path / "r/x.json").read_text())) == ["a", "b"]
    assert sinks.fingerprint(df) == sinks.fingerprint(df.repartition(3)) != sinks.fingerprint(df.limit(1))
    assert len(sinks.file_digest(str(tmp_path / "r/x.json"))) == 64


def test_deduplicate_command(spark, tmp_path):
    record = lambda q: json.dumps({"messages": [{"role": "user", "content": q}]})
    p = put(tmp_path / "in.jsonl", "\n".join(map(record, ["q1", "q2", "q1", "q3"])))
    cli.main(["deduplicate", "--input", p, "--out", str(tmp_path / "out"), "--report", str(tmp_path / "report.json")])
    report = json.loads((tmp_path / "report.json").read_text())
    assert report.items() >= {"rows": 4, "kept": 3, "duplicates": 1, "first_pairs": [{"first": 1, "duplicate": 3}]}.items()
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    want = list(map(record, ["q1", "q2", "q3"]))
    random.Random(42).shuffle(want)
    assert lines == want
    leaves = "".join(hashlib.sha256(x.encode()).hexdigest() for x in lines)
    assert report["output_digest"] == hashlib.sha256(leaves.encode()).hexdigest() and report["adjacent_matches_after"] == {}


def test_check_quality_command_resumes(spark, tmp_path, capsys):
    talk = [{"role": r, "content": "word " * 60} for r in ("user", "assistant") * 4]
    s = {"persona_id": "p", "prompt_id": "q", "conversation": talk, "num_turns": 4, "termination": "x", "ablation": "no_state", "profile_summary": "S"}
    put(tmp_path / "s/a.json", json.dumps(s))
    put(tmp_path / "s/b.json", json.dumps(s | {"prompt_id": "r", "num_turns": 1}))
    people = put(tmp_path / "p.jsonl", json.dumps({"persona_id": "p", "summary": "S"}))
    args = ["check-quality", "--sessions", str(tmp_path / "s"), "--personas", people, "--out", str(tmp_path / "out")]
    cli.main(args)
    cli.main([*args, "--resume"])
    got = {r.scenario_id: r.tier for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"q": "A", "r": "C"} and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_scores_each_session_once(spark, tmp_path):
    schema = f"persona_id STRING, conversation {MESSAGES}"
    put(tmp_path / "in/1.jsonl", '{"persona_id": "a", "conversation": [{"role": "user", "content": "x"}]}\nbroken\n')

    def run():
        rows = ingest.session_stream(spark, str(tmp_path / "in"), schema)
        q = ingest.score_stream(rows, lambda b: b.select("persona_id", F.size("conversation").alias("n")), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination(60)

    run()
    put(tmp_path / "in/2.jsonl", '{"persona_id": "b", "conversation": []}\n')
    run()
    run()
    assert sorted((r.persona_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 0)]


def test_deduplicate_command_keeps_fields_and_refuses_flaws(spark, tmp_path):
    """Other fields of a message count; full records, groups that lie apart, and flawed lines."""
    record = lambda text, **more: json.dumps({"messages": [{"role": "user", "content": text} | more], "metadata": {"source": text[0]}})
    lines = [record("a1"), record("a1", name="x"), record("a2"), record("a3"), record("b1"), record("b2"), record("b3"), record("a1")]
    p = tmp_path / "in.jsonl"
    p.write_text("\n".join(lines) + "\n")
    cli.main(["deduplicate", "--input", str(p), "--out", str(tmp_path / "out"), "--report", str(tmp_path / "r.json"), "--decluster-fields", "metadata.source"])
    report = json.loads((tmp_path / "r.json").read_text())
    assert (report["rows"], report["kept"], report["duplicates"]) == (8, 7, 1)
    assert report["adjacent_matches_before"] == {"metadata.source": 5} and report["adjacent_matches_after"] == {"metadata.source": 0}
    assert (report["decluster_fields"], report["window_size"], report["seed"]) == (["metadata.source"], 256, 42)
    got = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert sorted(r["messages"][0]["content"] for r in got) == ["a1", "a1", "a2", "a3", "b1", "b2", "b3"]
    groups = [r["metadata"]["source"] for r in got]
    assert all(set(groups[i : i + 2]) == {"a", "b"} for i in (0, 2, 4))  # every round holds each group once
    p.write_text(lines[0] + "\n" + json.dumps({"messages": [{"role": "tool", "content": "x"}]}) + "\n")
    with pytest.raises(ValueError, match="line 2: unknown role"):
        cli.main(["deduplicate", "--input", str(p), "--out", str(tmp_path / "out2"), "--report", str(tmp_path / "r2.json")])


def test_places_run_over_files_and_splits(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    lines = [f"{i:04d}" if i % 7 else "" for i in range(3000)]
    for k in range(3):
        (folder / f"{k}.txt").write_text("".join(x + "\n" for x in lines[k * 1000 : k * 1000 + 1000]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = sorted((r.line_no, r.value) for r in readers.numbered_lines(spark, str(folder)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i + 1, x) for i, x in enumerate(lines) if x]


def test_default_names_and_lists():
    from larkspur.plans.config import comma_list, deduplicated_path, report_path

    assert comma_list(" a, b,, c ,") == ["a", "b", "c"] and comma_list(None) == []
    assert deduplicated_path("/x.y/data.jsonl") == "/x.y/data.deduped_shuffled.jsonl"
    assert deduplicated_path("/x.y/data") == "/x.y/data.deduped_shuffled"
    assert report_path("/x/d.jsonl") == "/x/d.jsonl.report.json"
