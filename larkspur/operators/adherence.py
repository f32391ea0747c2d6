"""Preference adherence, end to end: generation, classification and judging as stages over items.

Each stage maps (idx, preference, question, ...) rows to the same rows with its replies.
``answer`` makes the calls: it maps rows with ``messages``, and the kind of call, to rows with
``reply``. Behind a ledger (``operators.model.ask_once``) a stage that runs again asks only what
has no reply. A call that failed is an empty reply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..plans.prompts import ADHERENCE_HINTS, ADHERENCE_JUDGE, ADHERENCE_SYSTEM
from ..sources.shared import written
from .benchmarks import METRICS, accuracy, choice_of, error_taxonomy, judge_answers, judge_tasks, multiple_choice_question, pivoted, question_messages, restated_tasks, shuffled_options

Answer = Callable[[DataFrame, str], DataFrame]


def asked(rows: DataFrame, messages: Column, answer: Answer, kind: str, name: str, system: str) -> DataFrame:
    """The rows with one more column, the reply to their messages; '' where the call failed."""
    calls = rows.select("idx", F.concat(F.array(M.message("system", F.lit(system))), messages).alias("messages"))
    replies = answer(calls, kind).select("idx", F.coalesce("reply", F.lit("")).alias(name))
    return written(rows.join(replies, "idx"), "asked")


def hinted(question: Column, task: str) -> Column:
    """The question as the task puts it: zero-shot, with a reminder, or step by step."""
    if task not in ADHERENCE_HINTS:
        raise ValueError(f"unknown task {task!r}; there are {', '.join(ADHERENCE_HINTS)}")
    return F.concat(question, F.lit(ADHERENCE_HINTS[task]))


def acknowledged(items: DataFrame, answer: Answer) -> DataFrame:
    """Every item with the assistant's reply to its stated preference, ``response_to_pref``."""
    return asked(items, F.array(M.message("user", F.col("preference"))), answer, "adherence_preference", "response_to_pref", ADHERENCE_SYSTEM)


def generated(items: DataFrame, answer: Answer, between: Column | None = None, task: str = "zero-shot") -> DataFrame:
    """Items with ``response_to_pref`` and ``response_to_q``, the free answer to the question after
    the preference, its reply and the messages in between."""
    between = F.array().cast(M.MESSAGES) if between is None else between
    told = acknowledged(items, answer)
    talk = question_messages(F.col("preference"), F.col("response_to_pref"), between, hinted(F.col("question"), task))
    return asked(told, talk, answer, "adherence_answer", "response_to_q", ADHERENCE_SYSTEM)


def classified(items: DataFrame, answer: Answer, seed: int, between: Column | None = None, task: str = "zero-shot") -> DataFrame:
    """Items with ``options`` (the first is right): those shuffled in one seeded stream, the right
    letter, the reply, the letter chosen and whether it is right."""
    between = F.array().cast(M.MESSAGES) if between is None else between
    told = shuffled_options(acknowledged(items, answer), "idx", "options", seed)
    question = hinted(multiple_choice_question(F.col("question"), F.col("shuffled")), task)
    out = asked(told, question_messages(F.col("preference"), F.col("response_to_pref"), between, question), answer, "adherence_choice", "mcq_response", ADHERENCE_SYSTEM)
    out = out.withColumn("correct_letter", F.substr(F.lit("ABCDEFGHIJ"), F.col("right") + 1, F.lit(1))).withColumn("choice", choice_of(F.col("mcq_response")))
    return out.withColumn("mcq_correct", F.coalesce(F.col("choice") == F.col("correct_letter"), F.lit(False)))


def judged(items: DataFrame, answer: Answer) -> DataFrame:
    """(idx, acknow, violate, hallucinate, helpful): the judges' answers to generated items. The
    restated preference of the first is what the third is asked about."""

    def replies(tasks: DataFrame, kind: str) -> DataFrame:
        system = F.array(M.message("system", F.lit(ADHERENCE_JUDGE)))
        return answer(tasks.withColumn("messages", F.concat(system, "messages")), kind)

    first = written(judge_answers(replies(judge_tasks(items), "adherence_judge")), "judged")
    second = judge_answers(replies(restated_tasks(items, first), "adherence_restated"))
    return pivoted(first.unionByName(second))


def report(stage: str, rows: DataFrame, *groups: str) -> DataFrame:
    """Accuracy of classified items, the error taxonomy of judged ones."""
    return accuracy(rows, "mcq_correct", *groups) if stage == "cls" else error_taxonomy(rows.select(*groups, *METRICS), *groups)
