"""Functions on arrays of messages, ARRAY<STRUCT<role, content>>, and other arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), (content if isinstance(content, Column) else F.lit(content)).alias("content"))


def visible(messages: Column) -> Column:
    """User and assistant messages only."""
    return F.filter(messages, lambda m: m["role"].isin("user", "assistant"))


def head(messages: Column, n: int = 6) -> Column:
    return F.slice(messages, 1, n)


def tail(messages: Column, n: int) -> Column:
    """The last n, or all where there are fewer."""
    return F.slice(messages, F.greatest(F.lit(1), F.size(messages) - n + 1), n)


def count_role(messages: Column, role: str) -> Column:
    return F.size(F.filter(messages, lambda m: m["role"] == role))


def transcript(messages: Column) -> Column:
    """`User: ...` and `Assistant: ...` lines; every role but user counts as assistant."""
    line = lambda m: F.concat(F.when(m["role"] == "user", "User: ").otherwise("Assistant: "), F.coalesce(m["content"], F.lit("")))
    return F.array_join(F.transform(messages, line), "\n")


def truncate_assistant(messages: Column, n: int | None) -> Column:
    """Up to and with the n-th assistant message; no limit for None or 0."""
    if not n:
        return messages
    at = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull())
    end = F.try_element_at(at, F.lit(n))
    return F.when(end.isNull(), messages).otherwise(F.slice(messages, F.lit(1), F.coalesce(end, F.lit(0)) + 1))


def last_field(items: Column, field: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(items, F.lit(-1))[field], F.lit(default))


def lettered(options: Column) -> Column:
    """`A. ...` lines of up to 26 options."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.chr(i.cast("bigint") + 65), F.lit(". "), o)), "\n")


def letter_of(options: Column, value: Column) -> Column:
    """Letter of the first option that equals a value; null where none does."""
    at = F.array_position(options, value)
    return F.when(at > 0, F.chr(at + 64))


def flaw(messages: Column) -> Column:
    """What makes a chat record invalid: the first bad message's flaw, its role before its
    content; null for a valid record."""

    def of(m: Column) -> Column:
        known = F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False))
        return F.when(~known, "unknown role").when(F.coalesce(strip(m["content"]), F.lit("")) == "", "blank content")

    found = F.filter(F.transform(messages, of), lambda x: x.isNotNull())
    return F.when(messages.isNull() | (F.size(messages) == 0), "no messages").otherwise(F.get(found, F.lit(0)))


def lamp_lines(items: Column) -> Column:
    """`- input: ... | output: ...` lines of the items with both sides; null for fewer than
    two items or no such line."""
    pairs = F.transform(items, lambda i: F.struct(F.coalesce(strip(i["input"]), F.lit("")).alias("i"), F.coalesce(strip(i["output"]), F.lit("")).alias("o")))
    lines = F.transform(F.filter(pairs, lambda p: (p["i"] != "") & (p["o"] != "")), lambda p: F.concat(F.lit("- input: "), p["i"], F.lit(" | output: "), p["o"]))
    return F.when((F.size(items) >= 2) & (F.size(lines) > 0), F.array_join(lines, "\n"))


