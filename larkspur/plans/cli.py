"""Command line: each command is a plan over files.

    python -m larkspur.plans.cli check-quality --sessions DIR --personas FILE --out DIR
    python -m larkspur.plans.cli check-quality ... --client package.module:factory --ledger DIR
    python -m larkspur.plans.cli build-question-answering-data --sessions DIR --results DIR --out DIR --client ... --ledger DIR
    python -m larkspur.plans.cli build-scenarios --personas FILE --constructor lifelong --out DIR --client ... --ledger DIR
    python -m larkspur.plans.cli deduplicate --input FILE --out DIR
    python -m larkspur.plans.cli training-rows --input FILE --out DIR --first-n 8
    python -m larkspur.plans.cli adherence-run --stage gen --items FILE --out DIR --client ... --ledger DIR
    python -m larkspur.plans.cli adherence --judged FILE
    python -m larkspur.plans.cli benchmark-report --benchmark prefeval --rows DIR --groups topic

A client is a factory of your own (``operators.model.ModelClient``), called once in each task. Its
replies are kept in the ledger, so a command that runs again asks only what has no reply yet.
"""

from __future__ import annotations

import argparse
import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.messages import MESSAGES, flaw
from ..functions.tokens import message_tokens
from ..operators import adherence as adherence_stages
from ..operators import benchmarks, corpus, qa, quality, seeded, selection, simulation, training
from ..operators.model import EVALUATION, GENERATION, Retry, ask_once
from ..sources import readers, sinks
from ..sources.shared import written
from .config import FAMILIES, comma_list, deduplicated_path, report_path
from .prompts import ADHERENCE_HINTS

SESSION = f"persona_id STRING, prompt_id STRING, conversation {MESSAGES}, user_state_trajectory ARRAY<STRUCT<turn: INT, user_state: STRING>>, num_turns INT, ablation STRING, profile_summary STRING"


def client_of(name: str) -> Callable:
    """The factory that ``package.module:name`` names."""
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)


def session_rows(spark, a) -> DataFrame:
    files = readers.sessions(spark, a.sessions, a.sample)
    return files.where("ok").select(F.from_json("raw", SESSION).alias("s"), "raw").select("s.*", "raw")


def calls(a, temperature: float = 0.7, retry: Retry = GENERATION) -> Callable[[DataFrame, str], DataFrame]:
    """Calls through the command's ledger, no more at once than its bound."""
    make = client_of(a.client)
    return lambda rows, kind: ask_once(rows, make, a.ledger, call_type=kind, temperature=temperature, model=a.model, retry=retry, concurrency=a.concurrency)


def check_quality(spark, a) -> None:
    rows = session_rows(spark, a)
    if a.resume:
        done = spark.read.parquet(a.out)
        rows = selection.without_results(rows, done, ["persona_id", "prompt_id"], ["persona_id", "scenario_id"])
    judge = quality.judged_by(calls(a, 0.0)) if a.client else None
    count = message_tokens if a.tokenizer else None
    scored = quality.score_sessions(rows, readers.personas(spark, a.personas), judge, tokens=count).withColumnRenamed("prompt_id", "scenario_id")
    scored.write.mode("append").parquet(a.out)
    everything = spark.read.parquet(a.out)
    quality.summary(everything).orderBy("measure", "value").show(100, False)
    quality.pass_rate(everything).show()


def build_question_answering_data(spark, a) -> None:
    """QA records by style from sessions, of the best tier where results are given."""
    rows = session_rows(spark, a).withColumn("scenario_id", F.col("prompt_id"))
    if a.results:
        rows = selection.of_tier(rows, spark.read.parquet(a.results))
    made = written(qa.examples(rows.drop("raw"), calls(a), tuple(a.styles or qa.REQUIRED)), "records")
    sinks.write_by_style(made, a.out)
    made.groupBy("qa_style").count().orderBy("qa_style").show()


def build_scenarios(spark, a) -> None:
    """Scenarios of a family for the personas that have none yet, in folders by family and
    persona; ``--force`` builds those of all."""
    family = FAMILIES[a.constructor]
    people = readers.personas(spark, a.personas).select("persona_id", F.coalesce("refined_summary", "summary").alias("summary"))
    people = selection.only_ids(people, "persona_id", a.persona_ids)
    if not a.force and os.path.isdir(a.out):
        done = spark.read.parquet(a.out).where(F.col("prefix") == family.prefix).select(F.col("persona_id").cast("string").alias("persona_id")).distinct()
        people = people.join(done, "persona_id", "left_anti")
    answered = calls(a)(simulation.scenario_calls(people, family.prefix), "scenarios")
    built = written(simulation.built_scenarios(answered), "scenarios")
    sinks.overwrite_by_key(built, a.out, "prefix", "persona_id")
    built.groupBy("prefix").agg(F.count_distinct("persona_id").alias("personas"), F.count("*").alias("scenarios")).show()


def deduplicate(spark, a) -> None:
    """Drop records equal in all fields of their messages, or in all fields; a flawed record is
    an error. The rest is shuffled as the standard library does, or, where fields are named,
    reordered so that neighbours share few of their values. The report has the neighbours that
    shared them before and after, and a digest of the lines in their order."""
    out, fields = a.out or deduplicated_path(a.input), comma_list(a.decluster_fields)
    key = corpus.canonical_json("value", "$" if a.dedupe_key == "full-record" else "$.messages")
    rows = readers.strict_jsonl(spark, a.input).select("line_no", "value", flaw(F.from_json("value", f"messages {MESSAGES}")["messages"]).alias("flaw"), F.sha2(key.cast("binary"), 256).alias("key"))
    keyed = written(rows, "keyed")
    bad = keyed.where("flaw IS NOT NULL").orderBy("line_no").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"line {r.line_no}: {r.flaw}" for r in bad))
    names = [f"field_{i}" for i in range(len(fields))]
    values = [F.nullif(corpus.canonical_json("value", f"$.{x}"), F.lit("null")).alias(n) for n, x in zip(names, fields)]
    kept = written(corpus.keep_first(keyed.select("line_no", "key", "value"), "key", "line_no").select("*", *values), "kept")
    if fields and a.window_size > 1:
        moved = corpus.declustered(kept, names, "line_no", a.seed, a.window_size)
    else:
        moved = seeded.shuffled(kept, "line_no", a.seed)
    moved = written(moved, "moved")
    if not corpus.is_distinct(moved, "key").first().is_distinct:
        raise RuntimeError("the reordered records are not distinct")
    sinks.write_ordered_jsonl(moved, out, "position", "value", a.overwrite)
    matches = lambda df, order: dict(zip(fields, corpus.adjacent_matches(df, order, names).first())) if fields else {}
    n, left = keyed.count(), moved.count()
    pairs = [r.asDict() for r in corpus.duplicate_pairs(keyed, "key", "line_no", 20).collect()]
    report = {
        "input_path": a.input, "output_path": out, "dedupe_key": a.dedupe_key, "seed": a.seed, "window_size": a.window_size, "decluster_fields": fields,
        "rows": n, "kept": left, "duplicates": n - left, "first_pairs": pairs,
        "adjacent_matches_before": matches(kept, "line_no"), "adjacent_matches_after": matches(moved, "position"),
        "output_digest": corpus.ordered_digest(moved, "position", "value"),
    }
    sinks.write_json_atomic(report, a.report or report_path(out), True)


def training_rows(spark, a) -> None:
    rows = training.prepared(readers.training_rows(spark, a.input), a.first_n)
    rows.write.mode("errorifexists").parquet(a.out)
    training.turn_histogram(rows).show()


def adherence(spark, a) -> None:
    entry = "STRUCT<answer: STRING>"
    schema = f"evaluation_error_analysis STRUCT<acknow: {entry}, violate: {entry}, hallucinate: {entry}, helpful: {entry}>"
    rows = spark.read.schema(schema).option("multiLine", True).json(a.judged)
    verdicts = rows.select(*[F.col(f"evaluation_error_analysis.{m}.answer").alias(m) for m in benchmarks.METRICS])
    benchmarks.error_taxonomy(verdicts).show(truncate=False)


def adherence_run(spark, a) -> None:
    """A stage of the preference benchmark over a JSON array of items: generation and
    classification read the items, judging reads what generation wrote."""
    if a.stage == "judge":
        made = adherence_stages.judged(spark.read.parquet(f"{a.out}/gen"), calls(a, 0.0, EVALUATION))
    else:
        get = lambda k: F.try_variant_get("item", f"$.{k}", "string").alias(k)
        items = selection.first_items(readers.json_items(spark, a.items), "idx", a.max_items).select("idx", get("preference"), get("question"))
        between = None
        if a.turns:
            turns = spark.read.option("multiLine", True).schema(f"conversation {MESSAGES}").json(a.filler).limit(1)
            items = items.crossJoin(F.broadcast(turns))  # one row
            between = benchmarks.filler(F.col("conversation"), a.turns)
        if a.stage == "gen":
            made = adherence_stages.generated(items, calls(a, 0.0, EVALUATION), between, a.task)
        else:
            options = F.try_variant_get("item", "$.classification_task_options", "ARRAY<STRING>").alias("options")
            given = selection.first_items(readers.json_items(spark, a.options), "idx", a.max_items).select("idx", options)
            made = adherence_stages.classified(benchmarks.aligned(items, given), calls(a, 0.0, EVALUATION), a.seed, between, a.task)
    written(made, a.stage).write.mode("overwrite").parquet(f"{a.out}/{a.stage}")
    if a.stage != "gen":
        adherence_stages.report(a.stage, spark.read.parquet(f"{a.out}/{a.stage}")).show(truncate=False)


def benchmark_report(spark, a) -> None:
    benchmarks.report(a.benchmark, spark.read.parquet(a.rows), *comma_list(a.groups)).show(truncate=False)


CALLS = {"--client": {}, "--ledger": {}, "--model": {"default": ""}, "--concurrency": {"type": int, "default": 40}}
COMMANDS = {
    "check-quality": (check_quality, {"--sessions": {}, "--personas": {}, "--out": {}, "--sample": {"type": int}, "--resume": {"action": "store_true"}, "--tokenizer": {"action": "store_true"}, **CALLS}),
    "build-question-answering-data": (build_question_answering_data, {"--sessions": {}, "--results": {}, "--out": {}, "--sample": {"type": int}, "--styles": {"nargs": "+", "choices": list(qa.REQUIRED)}, **CALLS}),
    "build-scenarios": (build_scenarios, {"--personas": {}, "--constructor": {"choices": list(FAMILIES), "default": "lifelong"}, "--persona-ids": {"nargs": "*"}, "--force": {"action": "store_true"}, "--out": {}, **CALLS}),
    "deduplicate": (deduplicate, {"--input": {}, "--out": {}, "--report": {}, "--seed": {"type": int, "default": 42}, "--dedupe-key": {"choices": ["messages", "full-record"], "default": "messages"}, "--decluster-fields": {}, "--window-size": {"type": int, "default": 256}, "--overwrite": {"action": "store_true"}}),
    "training-rows": (training_rows, {"--input": {}, "--out": {}, "--first-n": {"type": int}}),
    "adherence-run": (adherence_run, {"--stage": {"choices": ["gen", "cls", "judge"]}, "--items": {}, "--options": {}, "--filler": {}, "--turns": {"type": int, "default": 0}, "--task": {"choices": list(ADHERENCE_HINTS), "default": "zero-shot"}, "--max-items": {"type": int}, "--seed": {"type": int, "default": 0}, "--out": {}, **CALLS}),
    "adherence": (adherence, {"--judged": {}}),
    "benchmark-report": (benchmark_report, {"--benchmark": {"choices": list(benchmarks.REPORTS)}, "--rows": {}, "--groups": {}}),
}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        p = sub.add_parser(name)
        for flag, how in options.items():
            p.add_argument(flag, **how)
    a = parser.parse_args(args)
    COMMANDS[a.command][0](SparkSession.builder.appName(f"larkspur {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main()
