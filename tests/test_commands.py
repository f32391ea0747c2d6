import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from larkspur.operators import appended
from larkspur.plans import cli
from larkspur.sources import readers, sinks
from larkspur.streaming import ingest

CLIENT = '''
import json, os

class Client:
    def chat(self, messages, call_type="", **_):
        with open(os.path.join({folder!r}, "calls"), "a") as f:
            f.write(call_type + "\\n")
        text = messages[0]["content"]
        if call_type == "consistency":
            return json.dumps({{"score": 5, "reason": "fits"}})
        if call_type == "conflict":
            return json.dumps({{"label": "no_contradiction"}})
        if call_type == "scenarios":
            return "Here: " + json.dumps([{{"scenario_id": "", "category": "c", "initial_prompt": "p", "context_note": "n"}}] * 2)
        if call_type == "adherence_preference":
            return "noted: " + messages[-1]["content"]
        if call_type == "adherence_answer":
            return "answer after " + str(len(messages))
        if call_type == "adherence_choice":
            lines = [x for x in messages[-1]["content"].splitlines() if x.endswith("right")]
            return "<choice>" + lines[0].strip()[0] + "</choice>" if "q0" not in messages[-1]["content"] else "?"
        if call_type == "adherence_judge":
            return "<preference>told</preference><explanation>e</explanation><answer>" + ("Yes" if "told" not in text else "No") + "</answer>"
        if call_type == "adherence_restated":
            return "<answer>No</answer>"
        if call_type == "qa_reasoning":
            return "Because."
        return json.dumps({{"user_query": "What?", "correct": "right", "stereotypical": "s", "random": "r", "generic": "g", "preference": "prefers green tea", "question": "Tea?", "assistant_response": "Green tea it is, as you prefer.", "acknowledge_quote": "Green tea it is", "task_family": "f", "profile_items": [{{"input": "i", "output": "o"}}, {{"input": "j", "output": "q"}}], "query": "new", "target": "done"}})

def make():
    return Client()
'''


@pytest.fixture
def place(tmp_path, monkeypatch):
    (tmp_path / "stub_client.py").write_text(CLIENT.format(folder=str(tmp_path)))
    monkeypatch.syspath_prepend(str(tmp_path))
    sys.modules.pop("stub_client", None)
    from pyspark import cloudpickle
    import stub_client

    cloudpickle.register_pickle_by_value(stub_client)
    talk = [{"role": r, "content": "word " * 60} for r in ("user", "assistant") * 4]
    session = {"persona_id": "p", "prompt_id": "q", "conversation": talk, "user_state_trajectory": [], "num_turns": 4, "termination": "x", "ablation": "no_state", "profile_summary": "S"}
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text(json.dumps(session))
    (tmp_path / "s/b.json").write_text(json.dumps(session | {"prompt_id": "r", "num_turns": 1}))
    (tmp_path / "p.jsonl").write_text(json.dumps({"persona_id": "p", "summary": "S"}) + "\n" + json.dumps({"persona_id": "o", "summary": "T"}) + "\n")
    yield tmp_path
    cloudpickle.unregister_pickle_by_value(stub_client)


def told(place):
    return sorted((place / "calls").read_text().split()) if (place / "calls").exists() else []


def test_quality_judges_then_question_answering_data(spark, place):
    asked = ["--client", "stub_client:make", "--ledger", f"file://{place}/ledger", "--concurrency", "2"]
    cli.main(["check-quality", "--sessions", str(place / "s"), "--personas", str(place / "p.jsonl"), "--out", str(place / "qc"), "--tokenizer", *asked])
    got = {r.scenario_id: r for r in spark.read.parquet(str(place / "qc")).collect()}
    assert (got["q"].tier, got["q"].d5, got["q"].d6, got["r"].tier, got["r"].d5) == ("A", 5, "no_contradiction", "C", None)
    assert told(place) == ["conflict", "consistency"]  # the failing session is not judged
    args = ["build-question-answering-data", "--sessions", str(place / "s"), "--results", str(place / "qc"), *asked]
    cli.main([*args, "--out", str(place / "qa")])
    rows = spark.read.json(str(place / "qa")).collect()
    assert sorted(r.qa_style for r in rows) == ["lamp_cls", "personamem_mcq", "prefeval_gen"]
    assert next(r.messages[-1].content for r in rows if r.qa_style == "personamem_mcq").startswith("Because.\n\nFinal Answer: ")
    before = told(place)
    assert before == sorted(["conflict", "consistency", "qa_item", "qa_item", "qa_item", "qa_reasoning"])
    cli.main([*args, "--out", str(place / "qa2"), "--styles", "personamem_mcq", "lamp_cls"])
    assert told(place) == before and spark.read.json(str(place / "qa2")).count() == 2  # all replies are in the ledger


def test_scenarios_are_built_for_personas_without(spark, place):
    asked = ["--client", "stub_client:make", "--ledger", f"file://{place}/ledger", "--out", str(place / "sc"), "--personas", str(place / "p.jsonl")]
    cli.main(["build-scenarios", "--persona-ids", "p", *asked[:4], *asked[4:]])
    assert sorted((r.persona_id, r.scenario_id) for r in spark.read.parquet(str(place / "sc")).collect()) == [("p", "lifelong_p_scenario_0"), ("p", "lifelong_p_scenario_1")]
    cli.main(["build-scenarios", *asked])
    assert told(place) == ["scenarios", "scenarios"]
    cli.main(["build-scenarios", "--constructor", "affective", *asked])
    got = spark.read.parquet(str(place / "sc")).groupBy("prefix", "persona_id").count().collect()
    assert sorted(map(tuple, got)) == [("affective", "o", 2), ("affective", "p", 2), ("lifelong", "o", 2), ("lifelong", "p", 2)]


def test_adherence_stages_run_and_resume(spark, place, capsys):
    (place / "items.json").write_text(json.dumps([{"preference": f"likes {i}", "question": f"q{i}"} for i in range(6)]))
    (place / "options.json").write_text(json.dumps([{"classification_task_options": ["right", "b", "c", "d"]}] * 6))
    (place / "filler.json").write_text(json.dumps({"conversation": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}] * 3}))
    asked = ["--items", str(place / "items.json"), "--options", str(place / "options.json"), "--filler", str(place / "filler.json"), "--turns", "2", "--out", str(place / "out"), "--client", "stub_client:make", "--ledger", f"file://{place}/ledger"]
    cli.main(["adherence-run", "--stage", "gen", "--max-items", "4", *asked])
    cli.main(["adherence-run", "--stage", "gen", *asked])
    got = spark.read.parquet(str(place / "out/gen")).orderBy("idx").collect()
    assert [(r.response_to_pref, r.response_to_q) for r in got] == [(f"noted: likes {i}", "answer after 8") for i in range(6)]
    assert told(place) == ["adherence_answer"] * 6 + ["adherence_preference"] * 6  # the first four were not asked again
    cli.main(["adherence-run", "--stage", "cls", "--seed", "3", *asked])
    got = spark.read.parquet(str(place / "out/cls")).orderBy("idx").collect()
    rng = random.Random(3)
    want = [rng.sample(["right", "b", "c", "d"], 4) for _ in range(6)]
    assert [r.shuffled for r in got] == want and [r.correct_letter for r in got] == ["ABCD"[w.index("right")] for w in want]
    assert [r.mcq_correct for r in got] == [False] + [True] * 5
    assert told(place).count("adherence_preference") == 6
    cli.main(["adherence-run", "--stage", "judge", *asked])
    rows = spark.read.parquet(str(place / "out/judge")).collect()
    assert {(r.acknow, r.violate, r.hallucinate, r.helpful) for r in rows} == {("Yes", "Yes", "No", "Yes")} and len(rows) == 6
    assert told(place).count("adherence_judge") == 18 and told(place).count("adherence_restated") == 6


def test_append_runs(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    rows = lambda keys: spark.createDataFrame([(i, k, "x") for i, k in enumerate(keys)], "i INT, k STRING, folder STRING").repartition(3)
    run = lambda keys, bits=1 << 12: sorted((r.i, r.k) for r in appended.append_new(rows(keys), "k", "i", path, bits).collect())
    assert run(["a", "b", "a", None, "c", None]) == [(0, "a"), (1, "b"), (3, None), (4, "c")]
    assert run(["c", "d", "", None, "d"]) == [(1, "d"), (2, "")]
    assert run([]) == []
    many = [f"k{i % 700}" for i in range(900)] + ["a"]
    assert len(run(many)) == 700 and run(many) == []  # the filter is full, results stay exact
    got = appended.rows_of(spark, path)
    assert got.count() == got.select("k").distinct().count() == 706 and got.columns == ["i", "k", "folder"]


def test_a_killed_append_run_is_made_good(spark, tmp_path, monkeypatch):
    """Killed after its filter and before its rows, or with a filter that is not whole."""
    path = f"file://{tmp_path}/runs"
    rows = lambda keys: spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i INT, k STRING")
    run = lambda keys: sorted(r.k for r in appended.append_new(rows(keys), "k", "i", path, 1 << 12).collect())
    assert run(["a", "b"]) == ["a", "b"]
    filter_ = appended.bloom(rows(["c"]).selectExpr("sha2('vc', 256) AS k"), "k", 1 << 12)
    filter_.crossJoin(spark.read.parquet(f"{path}/filter/run=1").withColumnRenamed("words", "w")).selectExpr("zip_with(words, w, (x, y) -> x | y) AS words").write.parquet(f"{path}/filter/run=2")
    (tmp_path / "runs/filter/run=3").mkdir()
    assert run(["c", "b", "d"]) == ["c", "d"] and run(["a", "b", "c", "d"]) == []
    assert sorted(r.k for r in appended.rows_of(spark, path).collect()) == ["a", "b", "c", "d"]


def test_filter_has_no_false_new_and_few_false_repeats(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    filter_ = appended.bloom(keys, "k", 1 << 15)
    told, flag = appended.possible(spark.range(12000).select(F.col("id").cast("string").alias("k")), "k", filter_, 1 << 15)
    got = {int(r.k): r[flag] for r in told.collect()}
    assert all(got[i] for i in range(2000)) and sum(got[i] for i in range(2000, 12000)) < 400
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_a_session_that_arrives_again_is_not_scored(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda p, q, n: json.dumps({"persona_id": p, "prompt_id": q, "n": n}) + "\n"

    def run():
        rows = ingest.session_stream(spark, str(folder), "persona_id STRING, prompt_id STRING, n INT", 1)
        q = ingest.score_stream(ingest.first_arrivals(rows, ["persona_id", "prompt_id"]), lambda b: b.select("persona_id", "prompt_id", "n"), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination(120)

    (folder / "1.jsonl").write_text(line("a", "x", 1) + line("a", "y", 2) + line("a", None, 3))
    (folder / "2.jsonl").write_text(line("a", "x", 4) + line("b", "x", 5))
    run()
    (folder / "3.jsonl").write_text(line("b", "x", 6) + line("a", None, 7) + line("c", "x", 8))
    run()  # from the checkpoint
    got = sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(got) == 5 and {2, 8} <= set(got) and 6 not in got and 7 not in got
    assert len({1, 4} & set(got)) == 1


def test_folders_are_pruned_by_persona(spark, tmp_path):
    df = spark.createDataFrame([("full", f"p{i}", i) for i in range(9)], "ablation STRING, persona_id STRING, v INT")
    sinks.write_sessions(df, str(tmp_path / "s"))
    read = readers.sessions_by_folder(spark, str(tmp_path / "s"), "v INT, persona_id STRING").where("persona_id = 'p3' AND ablation = 'full'")
    assert [(r.v, "persona_id=p3" in r.file) for r in read.collect()] == [(3, True)]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "persona_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
