"""Text functions against small plain-Python statements of the same rules."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import messages as M
from larkspur.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} STRING" for k in values)
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize("s", ["", "  a b ", " x ", "\x1cq\x1f　", "\n\t", "​z", "a "])
def test_strip_is_python_strip(spark, s):
    assert one(spark, T.strip(F.col("x")), x=s) == s.strip()


def test_strip_over_the_basic_plane(spark):
    chars = [chr(c) for c in range(1, 0xD800)]
    df = spark.createDataFrame([(f"{c}a{c}",) for c in chars], "x STRING").select("x", T.strip(F.col("x")).alias("r"))
    assert [r.x for r in df.collect() if r.r != r.x.strip()] == []


@pytest.mark.parametrize(
    "raw, message, ends",
    [
        ("<|End Conversation|>text", "text", True),
        ("<|Continue Conversation|>\ntext", "text", False),
        ("  <|End Conversation|>  \n text ", "text", True),
        ("plain", "plain", False),
        ("a\n<|End Conversation|>", "a\n<|End Conversation|>", False),
        ("<|End Conversation|>", "", True),
    ],
)
def test_end_signal(spark, raw, message, ends):
    r = one(spark, T.end_signal(F.col("x")), x=raw)
    assert (r.message, r.wants_to_end) == (message, ends)


CASES = [
    "<think>t</think><user_state> s </user_state><message> m </message>",
    "<user_state>s only <message>m",
    "<user_state>s</user_state> said without tags",
    "# User State Report " + "x" * 90 + "<message>hello</message>",
    "# User State Report short<message>hello</message>",
    "<user_state></user_state><message></message>rest",
    "<user_state>s</user_state><message><|End Conversation|>bye</message>",
    "",
    "nothing at all",
]


def test_user_turn_parts(spark):
    r = one(spark, T.user_turn(F.col("x")), x=CASES[0])
    assert (r.think, r.user_state, r.message, r.wants_to_end) == ("t", "s", "m", False)
    assert one(spark, T.user_turn(F.col("x")), x=CASES[4]).user_state == ""
    assert one(spark, T.user_turn(F.col("x")), x=CASES[1]).user_state == "s only"


@pytest.mark.parametrize("raw, want", [('{"a": 1}', 1), ('x ```json\n{"a": 2}\n``` y', 2), ('so {"a": 3} it', 3), ("none", None), ('```\n{bad}\n``` {"a": 4}', None)])
def test_json_ladder(spark, raw, want):
    assert one(spark, F.try_variant_get(T.json_object(F.col("x")), "$.a", "int"), x=raw) == want


def test_strip_tags_keeps_unknown_ones(spark):
    assert one(spark, T.strip_tags(F.col("x")), x=" <think>a</think><b>c</b><report> ") == "a<b>c</b>"


def test_render_is_sequential(spark):
    assert one(spark, T.render("{a} {c}", {"a": F.lit("{b}"), "b": F.lit("v")})) == "v {c}"


@pytest.mark.parametrize("raw, want", [("<choice>B</choice>", "B"), ("<CHOICE>x C</choice>", "C"), ("<choice><b>A</b></choice>", None), ("A", None), ("<choice>none</choice>", None)])
def test_choice(spark, raw, want):
    assert one(spark, T.choice(F.col("x")), x=raw) == want


def test_acknowledges(spark):
    a = lambda p, r, q: one(spark, T.acknowledges(F.col("p"), F.col("r"), F.col("q")), p=p, r=r, q=q)
    assert a("I like tea", "So you LIKE tea", "like TEA")
    assert not a("I adore green tea", "Coffee it is", "")
    assert a("quiet, hotels! only", "a quiet place, one of the hotels", "")
    assert not a("", "x", "x") and not a("p", None, "x")


def test_seed_is_the_unsigned_head_of_the_digest(spark):
    import hashlib

    want = int(hashlib.sha256(b"p|s|personamem_mcq").hexdigest()[:16], 16)
    assert int(one(spark, T.seed(F.col("a"), F.col("b"), "personamem_mcq"), a="p", b="s")) == want


@pytest.mark.parametrize("p, key, want", [("it is A)", "a)", True), ("b)", "a)", False), ("both a) b)", "b)", True), ("the answer text goes", "a)", True), ("no", "a)", False)])
def test_answer_score(spark, p, key, want):
    assert one(spark, T.answer_score(F.col("p"), F.lit("The answer text goes on"), F.lit(key)), p=p) is want


def talk(spark, *roles):
    rows = [([(r, f"{r}{i}") for i, r in enumerate(roles)],)]
    return spark.createDataFrame(rows, f"m {M.MESSAGES}")


def test_slices(spark):
    df = talk(spark, "user", "assistant", "user")
    r = df.select(M.tail(F.col("m"), 2).alias("t"), M.tail(F.col("m"), 9).alias("all"), M.head(F.col("m"), 1).alias("h"), M.truncate_assistant(F.col("m"), 1).alias("c"), M.truncate_assistant(F.col("m"), 0).alias("n")).first()
    assert [len(r.t), len(r["all"]), len(r.h), len(r.c), len(r.n)] == [2, 3, 1, 2, 3]
    assert talk(spark).select(M.tail(F.col("m"), 2).alias("t")).first().t == []


def test_transcript_counts_every_other_role_as_assistant(spark):
    assert talk(spark, "system", "user").select(M.transcript(F.col("m")).alias("t")).first().t == "Assistant: system0\nUser: user1"


def test_record_flaws(spark):
    flaw = lambda *roles: talk(spark, *roles).select(M.flaw(F.col("m")).alias("f")).first().f
    assert flaw("user", "assistant") is None
    assert flaw("user", "tool") == "unknown role"
    assert flaw() == "no messages"


def test_lamp_needs_two_items_and_a_line(spark):
    s = "i ARRAY<STRUCT<input: STRING, output: STRING>>"
    f = lambda items: spark.createDataFrame([(items,)], s).select(M.lamp_lines(F.col("i")).alias("l")).first().l
    assert f([("a", "b"), ("c", " "), ("d", "e")]) == "- input: a | output: b\n- input: d | output: e"
    assert f([("a", "b")]) is None and f([("a", ""), (None, "x")]) is None


def test_first_equal_option_gives_the_letter(spark):
    df = spark.createDataFrame([(["x", "y", "y"],)], "o ARRAY<STRING>")
    r = df.select(M.letter_of(F.col("o"), F.lit("y")).alias("a"), M.letter_of(F.col("o"), F.lit("z")).alias("b"), M.lettered(F.col("o")).alias("l")).first()
    assert (r.a, r.b, r.l) == ("B", None, "A. x\nB. y\nC. y")
