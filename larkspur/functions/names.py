"""Names of helper columns that no column of a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until the table has no such column (Spark tells
    no case apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
