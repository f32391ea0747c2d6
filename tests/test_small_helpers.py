import json

from pyspark.sql import functions as F

from larkspur.operators import model, simulation, training
from larkspur.plans.config import FAMILIES
from larkspur.sources import readers, sinks


def test_yaml_file(tmp_path):
    (tmp_path / "a.yaml").write_text("a: 1\nb: [x, y]\n")
    (tmp_path / "none.yaml").write_text("")
    assert readers.yaml_file(str(tmp_path / "a.yaml")) == {"a": 1, "b": ["x", "y"]} and readers.yaml_file(str(tmp_path / "none.yaml")) == {}


def test_result_path():
    assert sinks.result_path("r", "gen", "explicit", "remind", "food", "org/model", 4) == "r/gen/explicit/remind/food/org_model_4turns"


def test_scenario_families():
    assert {k: v.prefix for k, v in FAMILIES.items()} == {"lifelong": "lifelong", "high_frequency": "high_frequency", "affective": "affective"}


def test_catalog_text(spark):
    rows = [("b", "Bee", " first \n", "Mixed", "s"), ("a", "", None, "Mixed", "s"), ("c", None, "third", "Social Interaction", "s")]
    df = spark.createDataFrame(rows, "behavior_id STRING, name STRING, description STRING, tuna_mode STRING, tuna_strategy STRING")
    assert simulation.catalog_text(df).first().catalog == "## Social Interaction\n[0] c: third\n## Mixed\n[1] a: \n[2] Bee: first"
    assert simulation.catalog_text(df.where("false")).first().catalog == ""


def test_persona_block(spark):
    told = {"tone": "dry", "é": [1, {"x": None}]}
    rows = [("S", json.dumps(told)), ("S", "{}"), (None, None), ("S", "broken {")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, s STRING, m STRING")
    got = df.select("i", training.persona_block(F.col("s"), F.col("m")).alias("b"), training.metadata_text(F.col("m")).alias("t")).orderBy("i").collect()
    text = json.dumps(told, indent=2, ensure_ascii=False)
    assert [r.b for r in got] == [f"<summary>\nS\n</summary>\n<behavioral_metadata>\n{text}\n</behavioral_metadata>", "<summary>\nS\n</summary>", "<summary>\n\n</summary>", "<summary>\nS\n</summary>"]
    assert [r.t for r in got] == [text, "N/A", "N/A", "N/A"]


def test_evaluation_calls_lose_their_thoughts():
    class Client:
        def chat(self, **_):
            return "<think>a\nb</think> said </think> more "

    assert model.call(Client(), model.EVALUATION)[0] == "said  more"
    assert model.call(Client(), model.GENERATION)[0] == "<think>a\nb</think> said </think> more "
