"""Checks of a session (D1 to D4), judges (D5, D6), tiers and their summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import message, transcript
from ..functions.names import free
from ..functions.text import json_object, n_tokens, or_default, render, strip
from ..plans.prompts import JUDGE_CONFLICT, JUDGE_CONSISTENCY
from .model import ask

# Bounds of a sound session, and, below, the wording of the notes, which are compared.
LEAST_TURNS, LEAST_TOKENS, MOST_TOKENS = 4, 200, 16000
STATE_ABLATIONS = ("full", "no_behavior")
REQUIRED_KEYS = ("persona_id", "prompt_id", "conversation", "num_turns", "ablation", "profile_summary")
LABELS = ("no_contradiction", "contradicts", "unclear")
DIMENSIONS = ("D1", "D2", "D3", "D4", "D5", "D6")


def notes(*found: Column) -> Column:
    """An array of the notes that apply, in order."""
    return F.array_compact(F.array(*found))


def schema_notes(raw: Column) -> Column:
    """D1: required keys present, the conversation a list, the turns an integer. A boolean
    is an integer here; raw JSON tells an absent key from a null."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    missing = [F.when(~F.array_contains(keys, k), F.lit(f"missing key {k}")) for k in REQUIRED_KEYS]
    kind = lambda k: F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), f"$.{k}", "variant"))
    has = lambda k: F.array_contains(keys, k)
    conversation = F.when(has("conversation") & ~F.coalesce(kind("conversation").startswith("ARRAY"), F.lit(False)), F.lit("conversation is no list"))
    turns = F.when(has("num_turns") & ~F.coalesce(kind("num_turns").isin("BIGINT", "BOOLEAN"), F.lit(False)), F.lit("num_turns is no integer"))
    return notes(*missing, conversation, turns)


def structure_notes(messages: Column, num_turns: Column, least_turns: int = LEAST_TURNS, tokens: Callable[[Column], Column] = n_tokens, least: int = LEAST_TOKENS, most: int = MOST_TOKENS, total: Column | None = None) -> Column:
    """D2, in the order in which the notes are due; an empty conversation ends the check.
    Null content is blank content. ``total`` is the conversation's number of tokens where a
    tokenizer has counted them (``functions.tokens``); else a stand-in counts."""
    m = F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>"))
    turns = F.coalesce(num_turns, F.lit(0))
    few = F.when(turns < least_turns, F.format_string("num_turns=%s < %s", turns.cast("string"), F.lit(str(least_turns))))
    role = F.when(~F.exists(m, lambda x: F.coalesce(x["role"] == "user", F.lit(False))) | ~F.exists(m, lambda x: F.coalesce(x["role"] == "assistant", F.lit(False))), "missing user or assistant role")
    repeat = F.filter(F.transform(m, lambda x, i: F.when((i > 0) & x["role"].eqNullSafe(F.get(m, i - 1)["role"]), i)), lambda i: i.isNotNull())
    blank = F.filter(F.transform(m, lambda x, i: F.when(F.coalesce(strip(x["content"]), F.lit("")) == "", i)), lambda i: i.isNotNull())
    total = F.aggregate(m, F.lit(0), lambda a, x: a + tokens(x["content"])) if total is None else total
    first = lambda label, at: F.when(F.size(at) > 0, F.concat(F.lit(label), F.get(at, F.lit(0)).cast("string")))
    empty = F.size(m) == 0
    rest = [
        role,
        first("consecutive same-role turns at index ", repeat),
        first("empty content at turn ", blank),
        F.when(total < least, F.concat(F.lit("total_tokens="), total.cast("string"), F.lit(f" < {least}"))),
        F.when(total > most, F.concat(F.lit("total_tokens="), total.cast("string"), F.lit(f" > {most}"))),
    ]
    return notes(few, F.when(empty, "empty conversation"), *[F.when(~empty, r) for r in rest])


def trajectory_notes(ablation: Column, length: Column, num_turns: Column) -> Column:
    """D3: states for all turns but the first, where the ablation keeps a state."""
    n = F.coalesce(length, F.lit(0))
    expected = F.greatest(F.lit(1), F.coalesce(num_turns, F.lit(0)) - 1)
    text = F.concat(F.lit("user_state_trajectory length "), n.cast("string"), F.lit(" < expected "), expected.cast("string"), F.lit(" for ablation="), ablation)
    return notes(F.when(ablation.isin(*STATE_ABLATIONS) & (n < expected), text))


def binding_notes(persona_id: Column, found: Column, expected: Column, actual: Column) -> Column:
    """D4: the persona is known and its stored summary is the session's."""
    missing = F.coalesce(persona_id, F.lit("")) == ""
    known = F.coalesce(found, F.lit(False))
    none = F.coalesce(expected, F.lit("")) == ""
    differs = strip(F.coalesce(actual, F.lit(""))) != strip(F.coalesce(expected, F.lit("")))
    return notes(
        F.when(missing, "missing persona_id"),
        F.when(~missing & ~known, F.concat(F.lit("persona '"), persona_id, F.lit("' not resolvable in profile store"))),
        F.when(~missing & known & none, "persona has neither refined_summary nor summary"),
        F.when(~missing & known & ~none & differs, "profile_summary does not match persona stored summary"),
    )


def bind(sessions: DataFrame, personas: DataFrame) -> DataFrame:
    """Sessions with their persona's summary (`expected`) and whether there is one (`found`)."""
    side = personas.select(F.col("persona_id").alias("_pid"), or_default(F.col("refined_summary"), F.col("summary"), "").alias("expected"), F.lit(True).alias("found"))
    return sessions.join(side, sessions["persona_id"] == side["_pid"], "left").drop("_pid")


def tier(passed: Column, d5: Column, d6: Column, skip_judges: bool = False) -> Column:
    """A, B or C; the first rule that applies."""
    if skip_judges:
        return F.when(~passed, "C").otherwise("A")
    rules = F.when(~passed, "C").when(F.coalesce((d5 >= 4) & (d6 == "no_contradiction"), F.lit(False)), "A")
    rules = rules.when(F.coalesce(d6 == "contradicts", F.lit(False)) | F.coalesce(d5 <= 2, F.lit(False)), "C")
    return rules.when(F.coalesce(d5 == 3, F.lit(False)) | F.coalesce(d6 == "unclear", F.lit(False)), "B").otherwise("C")


def failed_dimensions(**failed: Column) -> Column:
    """Names of the dimensions whose flag is set, from D1 to D6."""
    return notes(*[F.when(F.coalesce(failed[d.lower()], F.lit(False)), d) for d in DIMENSIONS if d.lower() in failed])


def verdict(reply: Column) -> Column:
    """struct(score, label, offending_turn) of a judge's JSON reply (VARIANT); what is out of
    range or of another type is null, and a label that is not known takes its turn along."""
    get = lambda k, t: F.try_variant_get(reply, f"$.{k}", t)
    kind = lambda k: F.schema_of_variant(get(k, "variant"))
    whole = lambda k: F.when(kind(k).isin("BIGINT", "BOOLEAN"), get(k, "int"))
    label = F.when(get("label", "string").isin(*LABELS), get("label", "string"))
    return F.struct(F.when(whole("score").between(1, 5), whole("score")).alias("score"), label.alias("label"), F.when(label.isNotNull(), whole("offending_turn")).alias("offending_turn"))


def judged_by(answer: Callable[[DataFrame, str], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A judge for ``score_sessions``: two calls for each session. ``answer`` maps rows with
    ``messages``, and the kind of call, to rows with ``reply``. A call that fails or says nothing
    of use gives nulls."""

    def judge(sessions: DataFrame) -> DataFrame:
        values = {"summary": F.coalesce("profile_summary", F.lit("")), "history": transcript(F.col("conversation"))}

        def asked(prompt: str, kind: str) -> DataFrame:
            rows = sessions.select("persona_id", "prompt_id", F.array(message("user", render(prompt, values))).alias("messages"))
            reply = json_object(F.coalesce("reply", F.lit("")))
            return answer(rows, kind).select("persona_id", "prompt_id", verdict(reply).alias(kind), F.try_variant_get(reply, "$.reason", "string").alias(f"{kind}_reason"))

        both = asked(JUDGE_CONSISTENCY, "consistency").join(asked(JUDGE_CONFLICT, "conflict"), ["persona_id", "prompt_id"])
        return both.select("persona_id", "prompt_id", F.col("consistency.score").alias("d5"), F.col("consistency_reason").alias("d5_reason"), F.col("conflict.label").alias("d6"), F.col("conflict.offending_turn").alias("d6_offending_turn"))

    return judge


def model_judge(make_client: Callable, **how) -> Callable[[DataFrame], DataFrame]:
    """A judge whose calls are made at temperature 0, whenever its plan runs."""
    return judged_by(lambda rows, kind: ask(rows, make_client, call_type=kind, temperature=0.0, **how))


def score_sessions(sessions: DataFrame, personas: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None, key: tuple = ("persona_id", "prompt_id"), least_turns: int = LEAST_TURNS, tokens: Callable[[str], Column] | None = None) -> DataFrame:
    """D1 to D4, the judges on what passes, and the tier of each session. ``tokens`` counts the
    tokens of a column of conversations, as ``functions.tokens.message_tokens`` does.

    ``judge`` maps sessions to (key..., d5, d5_reason, d6, d6_offending_turn); it sees passing
    sessions only, because the others are split off before it and not by a condition.
    """
    s = bind(sessions, personas)
    total = None
    if tokens is not None:
        [name] = free(s, "_tokens")
        s, total = s.withColumn(name, tokens("conversation")), F.col(name)
    s = s.withColumns({
        "n1": schema_notes(F.col("raw")),
        "n2": structure_notes(F.col("conversation"), F.col("num_turns"), least_turns, total=total),
        "n3": trajectory_notes(F.coalesce("ablation", F.lit("")), F.size("user_state_trajectory"), F.col("num_turns")),
        "n4": binding_notes(F.col("persona_id"), F.col("found"), F.col("expected"), F.col("profile_summary")),
    })
    s = s.withColumns({f"d{i}": F.size(f"n{i}") == 0 for i in range(1, 5)})
    s = s.withColumn("qc_pass", F.col("d1") & F.col("d2") & F.col("d3") & F.col("d4"))
    empty = {"d5": "int", "d5_reason": "string", "d6": "string", "d6_offending_turn": "int"}
    if judge is None:
        s = s.withColumns({k: F.lit(None).cast(t) for k, t in empty.items()})
    else:
        passing, rest = s.where("qc_pass"), s.where("NOT qc_pass")
        s = passing.join(judge(passing), list(key), "left").unionByName(rest.withColumns({k: F.lit(None).cast(t) for k, t in empty.items()}))
    flags = {f"d{i}": ~F.col(f"d{i}") for i in range(1, 5)}
    if judge is not None:
        flags |= {"d5": F.col("qc_pass") & (F.coalesce("d5", F.lit(0)) < 4), "d6": F.col("qc_pass") & (F.coalesce("d6", F.lit("")) != "no_contradiction")}
    return s.select(*key, *[f"d{i}" for i in range(1, 5)], *empty, "qc_pass", tier(F.col("qc_pass"), F.col("d5"), F.col("d6"), judge is None).alias("tier"), failed_dimensions(**flags).alias("failed_dims"), F.concat("n1", "n2", "n3", "n4").alias("notes"))


def summary(results: DataFrame) -> DataFrame:
    """(measure, value, n, share): rows, tiers, failed dimensions and verdicts. A null score
    is labelled None, a null label null; the pass rate of no rows is 0."""
    measures = F.explode(F.concat(
        F.array(F.struct(F.lit("total").alias("measure"), F.lit("").alias("value"))),
        F.array(F.struct(F.lit("tier").alias("measure"), F.col("tier").alias("value"))),
        F.array(F.struct(F.lit("d5").alias("measure"), F.coalesce(F.col("d5").cast("string"), F.lit("None")).alias("value"))),
        F.array(F.struct(F.lit("d6").alias("measure"), F.coalesce("d6", F.lit("null")).alias("value"))),
        F.transform("failed_dims", lambda d: F.struct(F.lit("failed").alias("measure"), d.alias("value"))),
    )).alias("m")
    return results.select(measures).groupBy("m.measure", "m.value").agg(F.count("*").alias("n"))


def pass_rate(results: DataFrame) -> DataFrame:
    n = F.count("*")
    return results.agg(n.alias("total"), F.coalesce(F.count_if(F.col("tier") == "A") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("pass_rate"))
