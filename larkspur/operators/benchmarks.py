"""Benchmark items, scores and error analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.names import free
from ..functions.text import answer_score, choice, element, render, strip
from ..plans.prompts import ADHERENCE
from .seeded import item_orders

METRICS = ("acknow", "violate", "hallucinate", "helpful")


def belief_items(rows: DataFrame) -> DataFrame:
    """Both belief conditions of each positional row: story, question, right and wrong answer.
    The false-belief condition swaps the answers."""
    c = F.explode(F.array(F.lit("true_belief"), F.lit("false_belief"))).alias("condition")
    x = rows.select("*", c)
    true = F.col("condition") == "true_belief"
    return x.select("idx", "condition", F.concat("_c0", F.lit(" "), F.when(true, F.col("_c1")).otherwise(F.col("_c2"))).alias("story"), F.col("_c5").alias("question"), F.when(true, F.col("_c8")).otherwise(F.col("_c11")).alias("true_answer"), F.when(true, F.col("_c11")).otherwise(F.col("_c8")).alias("false_answer"))


def swap_bits(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(idx, swapped): for each of n items whether the standard generator swaps its two answers,
    all in one stream; one seed gives both conditions the same bits."""
    pairs = spark.range(n).select(F.col("id").alias("idx"), F.lit(2).alias("size"))
    return item_orders(pairs, "idx", "size", seed, "shuffle").select("idx", (F.get("drawn", F.lit(0)) == 1).alias("swapped"))


def belief_prompts(items: DataFrame, n: int, seed: int, instruction: str) -> DataFrame:
    """Prompts with the two answers in seeded order, and the right key."""
    x = items.join(swap_bits(items.sparkSession, n, seed), "idx")
    first, second = F.when(F.col("swapped"), F.col("false_answer")).otherwise(F.col("true_answer")), F.when(F.col("swapped"), F.col("true_answer")).otherwise(F.col("false_answer"))
    prompt = F.concat(F.lit(instruction + "\n\nStory: "), F.col("story"), F.lit("\nQuestion: "), F.col("question"), F.lit("\nChoose one of the following:\na)"), first, F.lit("\nb)"), second, F.lit("\nAnswer:"))
    key = F.when(first == F.col("true_answer"), "a)").otherwise("b)")
    return x.withColumns({"prompt": prompt, "answer_key": key}).drop("swapped")


def scored(predictions: DataFrame) -> DataFrame:
    """`correct` for each prediction; a failed call is wrong."""
    right = answer_score(F.col("predicted"), F.col("true_answer"), F.col("answer_key"))
    return predictions.withColumn("correct", F.coalesce(right, F.lit(False)))


def accuracy(df: DataFrame, correct: str = "correct", *groups: str) -> DataFrame:
    n = F.count("*")
    share = F.coalesce(F.sum(F.col(correct).cast("int")), F.lit(0)) / F.greatest(n, F.lit(1))
    return df.groupBy(*groups).agg(n.alias("total"), share.cast("double").alias("accuracy"))


def paired_accuracy(a: DataFrame, b: DataFrame, key: str = "idx", correct: str = "correct") -> DataFrame:
    """Share of the keys that both tables have right; keys of one table only are an error."""
    left, right = a.select(key, F.col(correct).alias("a")), b.select(key, F.col(correct).alias("b"))
    both = left.join(right, key, "full")
    checked = F.when(F.count_if(F.col("a").isNull() | F.col("b").isNull()) > 0, F.raise_error(F.lit("the variants have different items"))).otherwise(F.count_if(F.col("a") & F.col("b")) / F.greatest(F.count("*"), F.lit(1)))
    return both.agg(F.count("*").alias("total"), checked.cast("double").alias("paired_accuracy"))


def aligned(*tables: DataFrame, key: str = "idx") -> DataFrame:
    """Lists of equal length side by side, by position; a missing position is an error."""
    out, check = tables[0].withColumn("_there", F.lit(True)), F.coalesce(F.col("_there"), F.lit(False))
    for i, t in enumerate(tables[1:]):
        out = out.join(t.withColumn(f"_there{i}", F.lit(True)), key, "full")
        check = check & F.coalesce(F.col(f"_there{i}"), F.lit(False))
    out = out.withColumn(key, F.when(check, F.col(key)).otherwise(F.raise_error(F.lit("lists of different length")).cast("bigint")))
    return out.drop("_there", *[f"_there{i}" for i in range(len(tables) - 1)])


def judge_tasks(items: DataFrame, metrics: tuple[str, ...] = ("acknow", "violate", "helpful")) -> DataFrame:
    """A call for each item with a response and each metric that has no answer yet. The
    metrics are literals, so this is a generator and no cross join."""
    x = items.where("response_to_q IS NOT NULL").select("*", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    had = F.lit("")
    prompt = F.lit("")
    for m in metrics:
        if "evaluation_error_analysis" in items.columns:
            had = F.when(F.col("metric") == m, F.coalesce(F.col(f"evaluation_error_analysis.{m}.answer"), F.lit(""))).otherwise(had)
        filled = render(ADHERENCE[m], {"question": F.col("question"), "preference": F.col("preference"), "end_generation": F.col("response_to_q")})
        prompt = F.when(F.col("metric") == m, filled).otherwise(prompt)
    return x.where(had == "").select("idx", "metric", F.array(M.message("user", prompt)).alias("messages"))


def judge_answers(answered: DataFrame) -> DataFrame:
    """(idx, metric, answer, extract_pref, explanation) of judge replies; failures are empty."""
    text = F.coalesce("reply", F.lit(""))
    return answered.select("idx", "metric", element(text, "answer").alias("answer"), element(text, "preference").alias("extract_pref"), element(text, "explanation").alias("explanation"))


def restated_tasks(items: DataFrame, answers: DataFrame) -> DataFrame:
    """The second phase: the restated preference of the first against the real one."""
    taken = answers.where("metric = 'acknow'").select("idx", "extract_pref")
    x = items.join(taken, "idx", "left")
    prompt = render(ADHERENCE["hallucinate"], {"preference": F.col("preference"), "assistant_restatement": F.coalesce("extract_pref", F.lit(""))})
    return x.select("idx", F.lit("hallucinate").alias("metric"), F.array(M.message("user", prompt)).alias("messages"))


def pivoted(answers: DataFrame) -> DataFrame:
    """One row for each item with the answers of its four metrics."""
    return answers.groupBy("idx").agg(*[F.max(F.when(F.col("metric") == m, F.col("answer"))).alias(m) for m in METRICS])


def error_taxonomy(verdicts: DataFrame, *groups: str) -> DataFrame:
    """Counts of eight kinds of error and the adherence rate from the four answers of each
    item. `yes` and `no` count anywhere in an answer; a blank answer is an error."""
    has = lambda m, word: F.contains(F.lower(F.col(m)), F.lit(word))
    ack, bad, useless = has("acknow", "yes"), has("violate", "yes"), has("helpful", "no")
    made_up = ack & has("hallucinate", "yes")
    inconsistent, wrong, unaware = ack & ~made_up & bad & ~useless, ack & made_up & bad & ~useless, ~ack & bad & ~useless
    adheres = ~(inconsistent | wrong | unaware | useless)
    blank = F.lit(False)
    for m in METRICS:
        blank = blank | (F.coalesce(strip(F.col(m)), F.lit("")) == "")
    count = lambda c, name: F.count_if(c).alias(name)
    n = F.count("*")
    total = F.when(F.count_if(blank) > 0, F.raise_error(F.lit("incomplete judge outputs")).cast("bigint")).otherwise(n)
    return verdicts.groupBy(*groups).agg(
        total.alias("total"),
        count(ack, "acknowledgement"),
        count(made_up, "hallucination"),
        count(bad, "violation"),
        count(useless, "error_unhelpful"),
        count(inconsistent, "error_inconsistent"),
        count(wrong, "hallucination_of_preference_violation"),
        count(unaware, "preference_unaware_violation"),
        count(adheres, "preference_adherence"),
        F.coalesce(F.count_if(adheres) / F.nullif(n, F.lit(0)), F.lit(0.0)).cast("double").alias("preference_adherence_accuracy"),
    )


# Names of the benchmarks. Each has the report of its scored or judged rows.
REPORTS = {
    "bigtom": lambda rows, *groups: accuracy(rows, "correct", *groups),
    "personamem": lambda rows, *groups: accuracy(rows, "correct", *groups),
    "prefeval": error_taxonomy,
}


def report(name: str, rows: DataFrame, *groups: str) -> DataFrame:
    """The report of a benchmark, in total or by groups."""
    if name not in REPORTS:
        raise ValueError(f"unknown benchmark {name!r}; there are {', '.join(REPORTS)}")
    return REPORTS[name](rows, *groups)


def choice_of(reply: Column) -> Column:
    """A reply's letter; a reply without the element is read as its content."""
    return F.coalesce(choice(reply), choice(F.concat(F.lit("<choice>"), reply, F.lit("</choice>"))))


def shuffled_options(items: DataFrame, order: str, options: str, seed: int) -> DataFrame:
    """The items with ``shuffled``, their options as samples of all of them in one seeded stream
    over the items in ``order``, and ``right``, the place (from 0) of the first (right) one."""
    [size] = free(items, "_size")
    out = item_orders(items.withColumn(size, F.coalesce(F.size(options), F.lit(0))), order, size, seed).drop(size)
    out = out.withColumn("shuffled", F.transform("drawn", lambda i: F.get(options, i))).drop("drawn")
    return out.withColumn("right", F.array_position("shuffled", F.get(options, F.lit(0))).cast("int") - 1)


def filler(turns: Column, n: int) -> Column:
    """The first 2 n messages between a preference and its question; the last of them must be
    the assistant's."""
    part = F.slice(turns, 1, 2 * n)
    sound = (F.size(part) == 2 * n) & (F.try_element_at(part, F.lit(-1))["role"] == "assistant")
    return F.when(sound, part).otherwise(F.raise_error(F.lit("too few filler turns, or the last is not the assistant's")).cast(M.MESSAGES))


def question_messages(preference: Column, response: Column, between: Column, question: Column) -> Column:
    return F.concat(F.array(M.message("user", preference), M.message("assistant", response)), between, F.array(M.message("user", question)))


def multiple_choice_question(question: Column, options: Column) -> Column:
    head = "\nHere are the options:\n"
    tail = "\nChoose one of them and reply with its letter only, as in <choice>B</choice>."
    return F.concat(question, F.lit(head), M.lettered(options), F.lit(tail))
