import hashlib
"""Operators on hand-made tables: the cases that the survey lists, with their results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import messages as M
from larkspur.functions.messages import MESSAGES
from larkspur.operators import benchmarks, corpus, model, qa, quality, selection, simulation, training
from larkspur.plans.config import Limits, ablation

TEXT = "word " * 60
SESSION = f"persona_id STRING, prompt_id STRING, conversation {MESSAGES}, user_state_trajectory ARRAY<STRUCT<turn: INT, user_state: STRING>>, num_turns INT, termination STRING, ablation STRING, profile_summary STRING, raw STRING"
PERSONAS = "persona_id STRING, summary STRING, refined_summary STRING"


def session(pid="p", roles=("user", "assistant") * 4, text=TEXT, turns=4, states=3, kind="full", summary="S", raw=None, prompt="q"):
    talk = [(r, text) for r in roles]
    raw = raw or json.dumps({"persona_id": pid, "prompt_id": prompt, "conversation": [], "num_turns": turns, "ablation": kind, "profile_summary": "s"})
    return (pid, prompt, talk, [(i, "s") for i in range(states)], turns, "x", kind, summary, raw)


def scored(spark, *rows, judge=None):
    people = spark.createDataFrame([("p", "S", None), ("r", "old", " S ")], PERSONAS)
    return quality.score_sessions(spark.createDataFrame(list(rows), SESSION), people, judge)


def first(spark, *args, **kw):
    return scored(spark, session(*args, **kw)).first()


def test_sound_session_is_tier_a(spark):
    r = first(spark)
    assert (r.d1, r.d2, r.d3, r.d4, r.tier, r.failed_dims, r.notes) == (True, True, True, True, "A", [], [])


@pytest.mark.parametrize(
    "change, failed, note",
    [
        ({"raw": '{"persona_id": "p"}'}, "D1", "missing key prompt_id"),
        ({"raw": '{"persona_id":"p","prompt_id":"q","conversation":[],"num_turns":"4","ablation":"full","profile_summary":"s"}'}, "D1", "num_turns is no integer"),
        ({"turns": 3, "states": 9}, "D2", "num_turns=3 < 4"),
        ({"roles": ("user", "user", "assistant", "user")}, "D2", "consecutive same-role turns at index 1"),
        ({"text": "   "}, "D2", "empty content at turn 0"),
        ({"text": None}, "D2", "empty content at turn 0"),
        ({"roles": ("user",)}, "D2", "missing user or assistant role"),
        ({"roles": ()}, "D2", "empty conversation"),
        ({"roles": (None, None)}, "D2", "missing user or assistant role"),
        ({"states": 2}, "D3", "user_state_trajectory length 2 < expected 3 for ablation=full"),
        ({"pid": "unknown"}, "D4", "persona 'unknown' not resolvable in profile store"),
        ({"pid": None}, "D4", "missing persona_id"),
        ({"summary": "other"}, "D4", "profile_summary does not match persona stored summary"),
    ],
)
def test_failures(spark, change, failed, note):
    r = first(spark, **change)
    assert failed in r.failed_dims and note in r.notes and r.tier == "C"


def test_empty_conversation_ends_the_structure_check(spark):
    assert first(spark, roles=(), turns=0, states=0, kind="no_state").notes == ["num_turns=0 < 4", "empty conversation"]


def test_state_is_not_asked_of_other_ablations(spark):
    assert first(spark, states=0, kind="no_state").d3


def test_refined_summary_and_white_space(spark):
    assert first(spark, pid="r", summary=" S").d4


@pytest.mark.parametrize("d5, d6, tier", [(5, "no_contradiction", "A"), (3, "no_contradiction", "B"), (4, "contradicts", "C"), (2, "no_contradiction", "C"), (5, "unclear", "B"), (None, None, "C")])
def test_tiers(spark, d5, d6, tier):
    df = spark.createDataFrame([(True, d5, d6)], "ok BOOLEAN, d5 INT, d6 STRING")
    assert df.select(quality.tier(F.col("ok"), F.col("d5"), F.col("d6")).alias("t")).first().t == tier


def test_judges_see_passing_sessions_only(spark):
    seen = spark.sparkContext.accumulator(0)

    def judge(df):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(d5=5, d5_reason="fits", d6="no_contradiction", d6_offending_turn=None)

        return df.select("persona_id", "prompt_id").mapInPandas(run, "persona_id STRING, prompt_id STRING, d5 INT, d5_reason STRING, d6 STRING, d6_offending_turn INT")

    rows = scored(spark, session(), session(prompt="bad", roles=("user",)), session(prompt="worse", turns=1), judge=judge).collect()
    assert seen.value == 1
    assert {r.prompt_id: r.tier for r in rows} == {"q": "A", "bad": "C", "worse": "C"}


def test_model_judge(spark):
    class Judge:
        def chat(self, messages, call_type="", **more):
            if "other" in messages[0]["content"]:
                raise ValueError("down")
            return '{"score": 5, "reason": "fits"}' if call_type == "consistency" else 'so {"label": "unclear", "offending_turn": 1}'

    judge = quality.model_judge(Judge, retry=model.Retry(tries=1))
    rows = {r.prompt_id: r for r in scored(spark, session(), session(prompt="x", text="other " * 60), session(prompt="bad", turns=1), judge=judge).collect()}
    assert (rows["q"].d5, rows["q"].d6, rows["q"].d6_offending_turn, rows["q"].tier, rows["q"].failed_dims) == (5, "unclear", 1, "B", ["D6"])
    assert (rows["x"].d5, rows["x"].d6, rows["x"].tier) == (None, None, "C")
    assert rows["bad"].tier == "C" and rows["bad"].failed_dims == ["D2"]


def test_scenarios_from_replies(spark):
    people = spark.createDataFrame([("p", "S"), ("r", None)], "persona_id STRING, summary STRING")
    calls = simulation.scenario_calls(people, "affective")
    assert calls.count() == 2
    text = 'Here: [{"scenario_id": "{persona_id}_a", "initial_prompt": "hi"}, {"category": "c"}, {"scenario_id": "affective_z"}] done'
    got = simulation.built_scenarios(calls.withColumn("reply", F.when(F.col("persona_id") == "p", text).otherwise("nothing"))).orderBy("pos").collect()
    assert [r.scenario_id for r in got] == ["affective_p_a", "affective_p_scenario_1", "affective_z"]
    assert got[0].initial_prompt == "hi" and {r.persona_id for r in got} == {"p"}


def test_verdicts(spark):
    def v(text):
        return tuple(spark.createDataFrame([(text,)], "t STRING").select(quality.verdict(F.try_parse_json("t")).alias("v")).first().v)

    assert v('{"score": 4, "label": "unclear", "offending_turn": 2}') == (4, "unclear", 2)
    assert v('{"score": 9, "label": "maybe", "offending_turn": 2}') == (None, None, None)
    assert v('{"score": true, "label": "contradicts", "offending_turn": "2"}') == (1, "contradicts", None)
    assert v("broken") == (None, None, None)


def test_summary_and_pass_rate_of_no_rows(spark):
    empty = scored(spark, session()).where("false")
    assert quality.summary(empty).count() == 0
    assert tuple(quality.pass_rate(empty).first()) == (0, 0.0)


def test_selection(spark):
    seeds = spark.createDataFrame([("a", 3, "x/1"), ("a", 1, "y"), ("a", 2, "z"), ("b", 9, "w"), (None, 1, "x_1")], "persona_id STRING, line_no INT, prompt_id STRING")
    top = selection.top_n_per_key(seeds, "persona_id", ["line_no"], 2).collect()
    assert sorted((r.persona_id or "", r.line_no) for r in top) == [("", 1), ("a", 1), ("a", 2), ("b", 9)]
    assert selection.top_n_per_key(seeds, "persona_id", ["line_no"], 0).count() == 5
    assert selection.only_ids(seeds, "persona_id", ["b"]).count() == 1 and selection.only_ids(seeds, "persona_id", None).count() == 5
    assert selection.only_ids(seeds, "persona_id", ["b"] + [f"n{i}" for i in range(1500)]).count() == 1
    done = spark.createDataFrame([(None, "x_1"), ("a", "y")], "persona_id STRING, scenario_id STRING")
    left = selection.without_results(seeds, done, ["persona_id", "prompt_id"], ["persona_id", "scenario_id"])
    assert sorted(r.prompt_id for r in left.collect()) == ["w", "x/1", "z"]
    outputs = spark.createDataFrame([("x_1",)], "prompt_id STRING")
    assert selection.without_outputs(seeds, outputs, "prompt_id").count() == 4
    assert selection.without_outputs(seeds, outputs, "prompt_id", raw_key=False).count() == 3


def test_opening_falls_through_empty_strings(spark):
    df = spark.createDataFrame([("", "b"), (None, None), ("a", "b")], "r STRING, p STRING")
    assert [r.o for r in df.select(selection.opening(F.col("r"), F.col("p")).alias("o")).collect()] == ["b", "", "a"]


def test_path_order_is_by_components(spark):
    df = spark.createDataFrame([("a-b/x",), ("a/x",), ("a/b/y",)], "path STRING")
    assert [r.path for r in selection.by_path(df, "path").collect()] == ["a/b/y", "a/x", "a-b/x"]


def student(spark, **change):
    values = {"persona_id": "p", "prompt_id": "q", "conversation": [("system", "s"), ("user", "u"), ("assistant", "a")], "profile_summary": "P", "behavioral_metadata": "", "scenario_category": "", "num_turns": 1, "termination": "t", "ablation": "full", "source": None, "user_state_trajectory": "secret state"} | change
    schema = f"persona_id STRING, prompt_id STRING, conversation {MESSAGES}, profile_summary STRING, behavioral_metadata STRING, scenario_category STRING, num_turns INT, termination STRING, ablation STRING, source STRING, user_state_trajectory STRING"
    return training.student_view(spark.createDataFrame([tuple(values.values())], schema), "Do.")


def test_student_view_hides_state_and_keeps_key_order(spark):
    line = student(spark).toJSON().first()
    assert "secret" not in line
    out = json.loads(line)
    assert [m["role"] for m in out["messages"]] == ["system", "user", "assistant"]
    assert out["messages"][0]["content"] == "Do.\n<persona>\nP\n</persona>"
    assert list(out["metadata"]) == ["persona_id", "scenario_id", "scenario_category", "num_turns", "termination", "ablation"]
    assert out["metadata"]["scenario_category"] == ""
    assert "scenario_category" not in json.loads(student(spark, scenario_category=None).toJSON().first())["metadata"]
    assert json.loads(student(spark, source="seed").toJSON().first())["metadata"]["source"] == "seed"
    assert student(spark, conversation=[("system", "s")]).count() == 0


def test_dedupe_keeps_the_first(spark):
    rows = [(i + 1, [("user", q)]) for i, q in enumerate(["q1", "q2", "q1", "q3"])]
    df = spark.createDataFrame(rows, f"line_no INT, messages {MESSAGES}").withColumn("key", corpus.canonical("messages"))
    assert sorted(r.line_no for r in corpus.keep_first(df, "key", "line_no").collect()) == [1, 2, 4]
    assert [tuple(r) for r in corpus.duplicate_pairs(df, "key", "line_no", 20).collect()] == [(1, 3)]
    assert not corpus.is_distinct(df, "key").first().is_distinct


def test_canonical_json_is_pythons(spark):
    text = 'q "x" \\ \n é   😀 /'
    df = spark.createDataFrame([([("user", text)],)], f"m {MESSAGES}")
    assert df.select(corpus.canonical("m").alias("j")).first().j == json.dumps([{"role": "user", "content": text}], sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_adjacent_matches_over_partition_edges(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None])) for i in range(300)]
    want = sum(a[1] is not None and a[1] == b[1] for a, b in zip(rows, rows[1:]))
    df = spark.createDataFrame(rows, "i INT, v STRING").repartition(7)
    assert corpus.adjacent_matches(df, "i", ["v"]).first().v == want
    assert corpus.adjacent_matches(df.where("false"), "i", ["v"]).first().v == 0


def declustered_places(df, fields, **more):
    out = corpus.declustered(df, fields, "id", 7, **more)
    rows = out.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows))) and out.columns == [*df.columns, "position"]
    return rows


def neighbours(rows, fields):
    return [sum(a[f] is not None and a[f] == b[f] for a, b in zip(rows, rows[1:])) for f in fields]


@pytest.mark.parametrize("stretch", [1, 2, 50, 1 << 16])
def test_declustered_is_no_worse_than_the_greedy_order(spark, monkeypatch, stretch):
    """A hot value, nulls, repeated keys and clashing names, over stretches of any length."""
    monkeypatch.setattr(corpus, "STRETCH", stretch)
    rng = random.Random(2)
    data = [(i if i % 5 else 3, rng.choice(["hot", "hot", "a", "b", "c", None]), rng.choice("xyz"), "p", i, 0.5) for i in range(600)]
    df = spark.createDataFrame(data, "id INT, f STRING, g STRING, place STRING, stretch INT, share DOUBLE").repartition(5)
    rows = declustered_places(df, ["f", "g"])
    assert sorted(r.stretch for r in rows) == list(range(600))
    greedy = corpus.decluster([r.asDict() for r in df.orderBy("stretch").collect()], ["f", "g"], 7)
    if stretch >= 50:  # very short stretches have an edge every few rows
        assert sum(neighbours(rows, ["f", "g"])) <= sum(neighbours(greedy, ["f", "g"])) + (6 if stretch == 50 else 0)
    one = declustered_places(df.where("f = 'hot'"), ["f"])
    assert neighbours(one, ["f"]) == [len(one) - 1]
    assert declustered_places(df.where("false"), ["f"]) == []


def test_supplied_documents_are_declustered(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), "lang", "source")
    rows = declustered_places(docs, ["lang", "source"])
    greedy = corpus.decluster([r.asDict() for r in docs.orderBy("id").collect()], ["lang", "source"], 7)
    assert all(a <= b for a, b in zip(neighbours(rows, ["lang", "source"]), neighbours(greedy, ["lang", "source"])))


def test_digest_of_lines_in_order(spark):
    rows = [(i, f"line {i % 70}") for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "i BIGINT, line STRING")
    level = [hashlib.sha256((x or "").encode()).hexdigest() for _, x in rows]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[k : k + 16]).encode()).hexdigest() for k in range(0, len(level), 16)]
    assert corpus.ordered_digest(df.repartition(7), "i", "line", 16) == corpus.ordered_digest(df, "i", "line", 16) == level[0]
    swapped = df.withColumn("i", F.when(F.col("i") == 5, 6).when(F.col("i") == 6, 5).otherwise(F.col("i")))
    assert corpus.ordered_digest(swapped, "i", "line", 16) != level[0]
    assert corpus.ordered_digest(df.where("false"), "i", "line") == hashlib.sha256(b"").hexdigest()
    one = hashlib.sha256(hashlib.sha256(b"x").hexdigest().encode()).hexdigest()
    assert corpus.ordered_digest(spark.createDataFrame([(0, "x")], "i INT, line STRING"), "i", "line") == one


def slow_decluster(rows, fields, seed, window):
    rest = list(rows)
    random.Random(seed).shuffle(rest)
    if not fields or window <= 1:
        return rest
    out = []
    while rest:
        costs = [sum(out[-1][f] is not None and out[-1][f] == r[f] for f in fields) if out else 0 for r in rest[:window]]
        out.append(rest.pop(costs.index(min(costs))))
    return out


@pytest.mark.parametrize("window", [0, 1, 2, 5, 256])
def test_decluster_is_the_greedy_order(window):
    rng = random.Random(3)
    rows = [{"i": i, "a": rng.choice("xyz"), "b": rng.choice([None, "u", "v"])} for i in range(120)]
    assert corpus.decluster(rows, ["a", "b"], 9, window) == slow_decluster(rows, ["a", "b"], 9, window)


def test_reordered_shards(spark):
    df = spark.createDataFrame([(s, i, "ab"[i % 2]) for s in range(2) for i in range(40)], "shard INT, i INT, a STRING")
    rows = corpus.reordered(df, "shard", "i", ["a"], 4).collect()
    assert sorted(r.position for r in rows) == sorted([*range(40)] * 2)


def test_paired_accuracy(spark):
    make = lambda *v: spark.createDataFrame(list(enumerate(v)), "idx INT, correct BOOLEAN")
    assert benchmarks.paired_accuracy(make(True, True, False), make(True, False, True)).first().paired_accuracy == pytest.approx(1 / 3)
    with pytest.raises(Exception, match="different items"):
        benchmarks.paired_accuracy(make(True), make(True, False)).collect()


def test_taxonomy_refuses_blank_judgments(spark):
    df = spark.createDataFrame([("yes", "no", "no", "yes"), ("yes", " ", "no", "yes")], "acknow STRING, violate STRING, hallucinate STRING, helpful STRING")
    assert benchmarks.error_taxonomy(df.limit(1)).first().preference_adherence_accuracy == 1.0
    with pytest.raises(Exception, match="incomplete"):
        benchmarks.error_taxonomy(df).collect()


def test_aligned_lists(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "idx BIGINT, a STRING")
    b = spark.createDataFrame([(0, "p"), (1, "q")], "idx BIGINT, b STRING")
    assert sorted(tuple(r) for r in benchmarks.aligned(a, b).collect()) == [(0, "x", "p"), (1, "y", "q")]
    with pytest.raises(Exception, match="different length"):
        benchmarks.aligned(a, b.limit(1)).collect()


def test_belief_prompts_share_the_swaps(spark):
    rows = spark.createDataFrame([(i, "s", "t", "f", "q", "good", "bad") for i in range(20)], "idx BIGINT, _c0 STRING, _c1 STRING, _c2 STRING, _c5 STRING, _c8 STRING, _c11 STRING")
    out = benchmarks.belief_prompts(benchmarks.belief_items(rows), 20, 42, "Read.").collect()
    rng = random.Random(42)
    want = []
    for _ in range(20):
        pair = ["good", "bad"]
        rng.shuffle(pair)
        want.append("a)" if pair[0] == "good" else "b)")
    assert [r.answer_key for r in sorted(out, key=lambda r: r.idx) if r.condition == "true_belief"] == want
    assert [r.answer_key for r in sorted(out, key=lambda r: r.idx) if r.condition == "false_belief"] == want


def test_filler_turns(spark):
    talk = [("user", "1"), ("assistant", "2"), ("user", "3")]
    df = spark.createDataFrame([(talk,)], f"m {MESSAGES}")
    assert len(df.select(benchmarks.filler(F.col("m"), 1).alias("f")).first().f) == 2
    with pytest.raises(Exception, match="filler"):
        df.select(benchmarks.filler(F.col("m"), 2)).collect()


def test_shuffled_options_follow_one_stream(spark):
    rng = random.Random(0)
    want = [rng.sample(["r", "x", "y"], 3) for _ in range(3)]
    items = spark.createDataFrame([(i, ["r", "x", "y"]) for i in range(3)], "i INT, o ARRAY<STRING>")
    got = benchmarks.shuffled_options(items.repartition(3), "i", "o", 0).orderBy("i").collect()
    assert [r.shuffled for r in got] == want and [r.right for r in got] == [w.index("r") for w in want]


# ---- model calls and rollouts -----------------------------------------------------------


def test_calls_keep_rows_and_store_errors(spark):
    class Flaky:
        def chat(self, messages, **more):
            if "bad" in messages[-1]["content"]:
                raise ValueError("no")
            return messages[-1]["content"].upper()

    df = spark.createDataFrame([(i, [("user", "bad" if i == 2 else f"m{i}")]) for i in range(5)], f"i INT, messages {MESSAGES}")
    rows = {r.i: r for r in model.ask(df, Flaky, retry=model.Retry(tries=2, linear=0)).collect()}
    assert rows[1].reply == "M1" and rows[2].reply is None and "ValueError" in rows[2].error and rows[2].attempts == 2
    with pytest.raises(Exception, match="ValueError"):
        model.ask(df, Flaky, retry=model.Retry(tries=1), on_error="raise").collect()


def test_pauses_double_up_to_a_ceiling():
    assert [model.EVALUATION.pause(i) for i in range(1, 8)] == [1, 2, 4, 8, 16, 30, 30]
    assert [model.GENERATION.pause(i) for i in (1, 2)] == [2, 4]


def test_unknown_ablation():
    with pytest.raises(ValueError):
        ablation("none")


@pytest.mark.parametrize("forced, n, level, want", [("minimal", 9, "", "minimal"), ("bad", 1, "low", "minimal"), (None, 1, "Very High", "standard"), (None, 3, "low", "standard"), (None, 3, "high", "full"), (None, 6, None, "full")])
def test_disclosure_stage(spark, forced, n, level, want):
    df = spark.createDataFrame([(forced, n, level)], "f STRING, n INT, l STRING")
    assert df.select(simulation.disclosure_stage(F.col("f"), F.col("n"), F.col("l")).alias("s")).first().s == want


def test_behavior_blocks(spark):
    template = "**Authenticity rules:**\n" + "".join(f"- rule{i}\n" for i in range(6)) + "\n**Request type selection:**\n- pick\n\n**Internal question:** why?"
    examples = [(f"type{i}", f"turn{i}") for i in range(7)]
    schema = "behavior_id STRING, name STRING, description STRING, tuna_mode STRING, tuna_strategy STRING, cognitive_delegation_level STRING, guidance_template STRING, few_shot_examples ARRAY<STRUCT<request_type: STRING, user_turn: STRING>>, simulator_control STRUCT<force_disclosure_stage: STRING, force_include_few_shot: BOOLEAN>"
    df = spark.createDataFrame([("b", "B", " d ", "m", "s", "low", template, examples, None), ("c", None, None, None, None, None, " ", [], None), ("e", None, None, None, None, None, "t", examples, (None, False))], schema)
    got = {(r.behavior_id, r.stage): r.block for r in simulation.behavior_blocks(df).collect()}
    assert ("c", "full") not in got and len(got) == 6
    for stage, rules, turns, types in (("minimal", 2, 2, 3), ("standard", 4, 3, 5), ("full", 6, 5, 7)):
        block = got["b", stage]
        assert block.count("- rule") == rules and block.count("turn") - block.count("turn_") == turns and block.count("- type") == types
        assert ("why?" in block) == (stage == "full")
    assert "<progressive_examples>" not in got["e", "full"]


def test_weighted_pick_follows_weights(spark):
    rows = [(g, i, w) for g in range(3000) for i, w in (("a", 1.0), ("b", 3.0))]
    df = spark.createDataFrame(rows, "g INT, item STRING, w DOUBLE")
    n = simulation.weighted_pick(df, ["g"], "item", F.col("w"), F.col("g").cast("string")).where("item = 'b'").count()
    assert 0.7 < n / 3000 < 0.8


# ---- question answering -----------------------------------------------------------------

REPLIES = {
    qa.MCQ: {"user_query": "What? ", "correct": "c", "stereotypical": "s", "random": "r", "generic": "g"},
    qa.PREFERENCE: {"preference": "likes green tea", "question": "Drink?", "assistant_response": "Some green tea", "acknowledge_quote": "green TEA"},
    qa.LAMP: {"task_family": "f", "profile_items": [{"input": "i", "output": "o"}, {"input": "j", "output": ""}], "query": "n", "target": "t"},
}


def answered(spark, replies):
    s = spark.createDataFrame([session()], SESSION).withColumn("scenario_id", F.col("prompt_id"))
    rows = qa.tasks(s)
    reply = F.lit(None).cast("string")
    for style, value in replies.items():
        reply = F.when(F.col("qa_style") == style, F.lit(value if isinstance(value, str) else json.dumps(value))).otherwise(reply)
    return rows.withColumn("reply", reply)


def test_examples_of_every_style(spark):
    valid = qa.replies(answered(spark, REPLIES))
    assert valid.count() == 3
    mcq = qa.multiple_choice(valid).withColumn("answer_text", qa.with_reasoning(F.lit("because"), F.col("final")))
    r = mcq.first()
    import hashlib

    order = ["c", "s", "r", "g"]
    random.Random(int(hashlib.sha256(b"p|q|personamem_mcq").hexdigest()[:16], 16)).shuffle(order)
    assert r.options == order and r.correct_letter == "ABCD"[order.index("c")]
    assert r.answer_text == f"because\n\nFinal Answer: {r.correct_letter}"
    m = qa.records(mcq, qa.MCQ).first()
    assert [x.role for x in m.messages] == ["system"] + ["user", "assistant"] * 4 + ["user", "assistant"]
    assert m.messages[-2].content.startswith("What? Please recall") and m.metadata.correct_letter == r.correct_letter
    p = qa.records(qa.acknowledged(valid), qa.PREFERENCE).first()
    assert len(p.messages) == 5 and p.metadata.preference == "likes green tea"
    f = qa.records(qa.from_items(valid), qa.LAMP).first()
    assert "- input: i | output: o\n\nNew input: n" in f.messages[1].content and f.metadata.task_family == "f"
    everything = qa.records(mcq, qa.MCQ).unionByName(qa.records(qa.acknowledged(valid), qa.PREFERENCE))
    assert everything.count() == 2
    with pytest.raises(ValueError):
        qa.records(mcq, "other")


def test_incomplete_replies_give_nothing(spark):
    bad = {qa.MCQ: {k: v for k, v in REPLIES[qa.MCQ].items() if k != "random"}, qa.PREFERENCE: "no json", qa.LAMP: REPLIES[qa.LAMP] | {"profile_items": [{"input": "i", "output": "o"}]}}
    valid = qa.replies(answered(spark, bad))
    assert [r.qa_style for r in valid.collect()] == [qa.LAMP]
    assert qa.from_items(valid).count() == 0
    other = qa.replies(answered(spark, {qa.PREFERENCE: REPLIES[qa.PREFERENCE] | {"assistant_response": "Coffee", "acknowledge_quote": "x"}}))
    assert other.count() == 1 and qa.acknowledged(other).count() == 0


def test_reasoning_fallbacks(spark):
    df = spark.createDataFrame([(None,), (" ",), ("so Final Answer: B",), ("Final Answer: A, no",)], "t STRING")
    got = [r.a for r in df.select(qa.with_reasoning(F.col("t"), F.lit("Final Answer: B")).alias("a")).collect()]
    assert got == ["Final Answer: B", "Final Answer: B", "so Final Answer: B", "Final Answer: A, no\n\nFinal Answer: B"]


def test_first_bad_message_names_the_flaw(spark):
    rows = [([("user", " "), ("other", "x")], "blank content"), ([("other", " "), ("user", "")], "unknown role"), ([("user", "a"), (None, "b")], "unknown role"), ([("user", "a")], None), ([], "no messages"), (None, "no messages")]
    df = spark.createDataFrame(rows, f"m {MESSAGES}, want STRING")
    assert [r.got for r in df.select(M.flaw(F.col("m")).alias("got")).collect()] == [w for _, w in rows]


def test_interleaved_rounds_of_a_hot_group_and_nulls(spark):
    df = spark.range(30000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("g"))
    out = corpus.interleaved(df, "g", "id", 5)
    assert out.columns == ["id", "g", "place", "round"] and out.count() == 30000
    hot = out.where("g = 'hot'").orderBy("place").collect()
    assert [r["round"] for r in hot] == list(range(1, 10001))
    nulls = out.where("g IS NULL").orderBy("place").collect()
    assert [r["round"] for r in nulls] == list(range(1, 10001))
    assert out.where("g <> 'hot' AND round <> 1").count() == 0


def test_reports_by_benchmark(spark):
    rows = spark.createDataFrame([(True, "a"), (False, "b")], "correct BOOLEAN, kind STRING")
    assert benchmarks.report("bigtom", rows).first().accuracy == 0.5
    assert benchmarks.report("personamem", rows, "kind").count() == 2
    with pytest.raises(ValueError, match="bigtom, personamem, prefeval"):
        benchmarks.report("other", rows)


def test_first_items(spark):
    items = spark.range(5).withColumnRenamed("id", "idx")
    assert selection.first_items(items, "idx", 2).count() == 2
    assert selection.first_items(items, "idx", 0).count() == 5
