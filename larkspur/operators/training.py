"""Training records that a student may see, and the preparation of training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.text import indented_json, or_default

INSTRUCTION = "You are an assistant who adapts to the person you talk with."


def system_prompt(instruction: Column | str, summary: Column | None, metadata: Column | None) -> Column:
    """The parts that are there, line by line: instruction, profile, behaviour."""
    part = lambda tag, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"<{tag}>\n"), x, F.lit(f"\n</{tag}>")))
    first = instruction if isinstance(instruction, Column) else F.lit(instruction)
    parts = [first, *[part(tag, x) for tag, x in (("persona", summary), ("behavior", metadata)) if x is not None]]
    return F.concat_ws("\n", *parts)


def persona_block(summary: Column, metadata: Column) -> Column:
    """A persona for a prompt: its summary and, where it has some, its metadata (a JSON text)."""
    # The names of the tags.
    told = F.concat(F.lit("<summary>\n"), F.coalesce(summary, F.lit("")), F.lit("\n</summary>"))
    return F.concat_ws("\n", told, F.concat(F.lit("<behavioral_metadata>\n"), indented_json(metadata), F.lit("\n</behavioral_metadata>")))


def metadata_text(metadata: Column) -> Column:
    """Metadata as a judge or simulator is shown it; N/A where there is none."""
    return F.coalesce(indented_json(metadata), F.lit("N/A"))


def student_view(sessions: DataFrame, instruction: str = INSTRUCTION, summary: str = "profile_summary", metadata: str = "behavioral_metadata") -> DataFrame:
    """Chat records with visible messages and the profile; no latent state survives. A null
    category is one that the session does not have and is left out of JSON; so is an empty
    source. Sessions without a visible message give no record."""
    shown = M.visible(F.col("conversation"))
    prompt = system_prompt(instruction, F.col(summary), F.col(metadata))
    meta = F.struct(
        F.col("persona_id"),
        F.col("prompt_id").alias("scenario_id"),
        F.col("scenario_category"),
        F.col("num_turns"),
        F.col("termination"),
        F.col("ablation"),
        F.nullif(F.col("source"), F.lit("")).alias("source"),
    )
    return sessions.where(F.size(shown) > 0).select(F.concat(F.array(M.message("system", prompt)), shown).alias("messages"), meta.alias("metadata"))


def prepared(records: DataFrame, first_n: int | None = None, messages: str = "messages") -> DataFrame:
    """Records cut after their n-th assistant message; those without one are dropped."""
    out = records.withColumn(messages, M.truncate_assistant(F.col(messages), first_n))
    return out.where(M.count_role(F.col(messages), "assistant") > 0)


def turn_histogram(records: DataFrame, messages: str = "messages") -> DataFrame:
    return records.groupBy(M.count_role(F.col(messages), "assistant").alias("assistant_turns")).agg(F.count("*").alias("n")).orderBy("assistant_turns")


def mixture(*parts: DataFrame) -> DataFrame:
    """Records of several kinds as one table; absent fields are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def persona_defaults(personas: DataFrame) -> DataFrame:
    """Derived attributes of a persona with their defaults."""
    get = lambda k: F.try_variant_get(F.try_parse_json("attributes"), f"$.{k}", "string")
    domains = F.from_json(F.to_json(F.try_variant_get(F.try_parse_json("attributes"), "$.domains", "variant")), "ARRAY<STRING>")
    return personas.withColumns({
        "domains": F.when(F.size(F.coalesce(domains, F.array().cast("array<string>"))) > 0, domains).otherwise(F.array(F.lit("general"))),
        "register": or_default(get("register"), "casual"),
        "expertise": or_default(get("expertise"), "mid"),
        "profile": or_default(F.col("refined_summary"), F.col("summary"), ""),
    })


def assistant_tokens(messages: Column, tokens) -> Column:
    """Stand-in for the tokens that a training step optimises: those of assistant messages."""
    return F.aggregate(messages, F.lit(0), lambda a, m: a + F.when(m["role"] == "assistant", tokens(m["content"])).otherwise(0))
