import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import trails


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, rng.choice(["hot", "hot", "a", "b", None, f"u{i % 40}"]), rng.randrange(50), rng.choice([None, "x", "y", "z"]) if i > 90 else None) for i in range(700)]


def plain(rows):
    """Values of a row's trail before and at it, in order."""
    trail = {}
    for i, u, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        trail.setdefault(u, []).append((i, v))
    for own in trail.values():
        for p, (i, _) in enumerate(own):
            yield i, [v for _, v in own[:p]], [v for _, v in own[: p + 1]]


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 16])
def test_trails_over_blocks_of_any_size(spark, monkeypatch, rows, block):
    monkeypatch.setattr(trails, "BLOCK", block)
    df = spark.createDataFrame(rows, "i INT, u STRING, t INT, v STRING").withColumns({"place": F.lit("clash"), "_block": F.lit(1), "b": F.lit(2), "k": F.lit(3)}).repartition(5)
    for n in [1, 4] if block >= 4 else [1]:
        got = trails.previous_values(df, "u", ["t", "i"], F.col("v"), n, "before")
        assert got.columns == [*df.columns, "before"]
        assert {r.i: r.before for r in got.collect()} == {i: [v for v in b[-n:] if v is not None] for i, b, _ in plain(rows)}
    got = trails.carried(df, "u", ["t", "i"], F.col("v"), "last")
    assert got.columns == [*df.columns, "last"]
    assert {r.i: r.last for r in got.collect()} == {i: next((v for v in reversed(b) if v is not None), None) for i, _, b in plain(rows)}
    assert trails.carried(df.where("false"), "u", ["t", "i"], F.col("v"), "last").count() == 0
