import pytest
from pyspark.sql import functions as F

from larkspur.functions import tokens
from larkspur.functions.messages import MESSAGES
from larkspur.operators import quality
from larkspur.plans import catalog

TEXTS = ["Hello, world! It's 12345 o'clock.", "", None, "é ñ 日本語 😀", "  spaces \n\n and\ttabs  ", "<|endoftext|> as text", "a" * 5000, "\u0000x", "don't we'll I'd"]


@pytest.fixture(scope="module")
def other():
    """The same vocabulary in another library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(spark, data, other):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    path, pattern = tokens.supplied()
    assert [tokens.token_ids(t, path, pattern) for t in texts] == [other(t) for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").select("i", tokens.token_counter()(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [len(other(t)) for t in texts]


def test_structure_query_counts_with_the_tokenizer(spark, data, other):
    got = {r.conv_id: r for r in catalog.queries()["p16_a7_f27_structure_by_tokens"](spark, data).collect()}
    from larkspur.plans.sessions import nested, with_flaws

    rows = nested(with_flaws(spark.read.parquet(f"{data}/conversations.parquet"))).collect()
    assert len(rows) == len(got)
    for r in rows:
        n = sum(len(other(m.content)) for m in r.conversation)
        assert got[r.conv_id].tokens == n
        assert (f"total_tokens={n} < 200" in got[r.conv_id].notes) == (n < 200)
        assert (f"total_tokens={n} > 16000" in got[r.conv_id].notes) == (n > 16000)


def test_sessions_are_scored_by_tokens(spark):
    talk = [("user", "word " * 60), ("assistant", "x " * 60)] * 8
    schema = f"persona_id STRING, prompt_id STRING, conversation {MESSAGES}, user_state_trajectory ARRAY<STRUCT<turn: INT, user_state: STRING>>, num_turns INT, ablation STRING, profile_summary STRING, raw STRING, _tokens INT"
    rows = [("p", "long", talk, [], 8, "no_state", "S", "{}", 1), ("p", "none", None, [], 8, "no_state", "S", "{}", 1)]
    people = spark.createDataFrame([("p", "S", "")], "persona_id STRING, summary STRING, refined_summary STRING")
    got = quality.score_sessions(spark.createDataFrame(rows, schema), people, tokens=tokens.message_tokens).collect()
    notes = {r.prompt_id: r.notes for r in got}
    assert not any("total_tokens" in n for n in notes["long"]) and "empty conversation" in notes["none"]
