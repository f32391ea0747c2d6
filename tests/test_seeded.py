import random

import numpy as np
import pytest

from larkspur.operators import seeded


def standard(n, seed):
    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7, 8, 9, 31, 32, 33, 100, 257, 1000, 4096, 65537])
def test_shuffle_is_the_standard_librarys(n):
    for seed in (0, 1, 42, 12345678901234567890):
        assert seeded.shuffle_order(n, seed).tolist() == standard(n, seed)


def test_shuffle_of_a_million():
    assert (seeded.shuffle_order(1_000_000, 42) == np.array(standard(1_000_000, 42))).all()


@pytest.mark.parametrize("order", ["id", "part"])
def test_rows_are_shuffled_in_place_order(spark, order):
    rows = [(i, i % 3 if i % 2 else None, f"x{i}", "clash", 5) for i in range(5000)]
    df = spark.createDataFrame(rows, "id BIGINT, part INT, text STRING, at STRING, place INT").repartition(7)
    got = seeded.shuffled(df, order, 9).orderBy("position").collect()
    assert [r.position for r in got] == list(range(5000)) and got[0].asDict().keys() == {*df.columns, "position"}
    if order == "id":
        want = [r[0] for r in rows]
        random.Random(9).shuffle(want)
        assert [r.id for r in got] == want
    assert seeded.shuffled(df.where("false"), order, 9).count() == 0


@pytest.mark.parametrize("kind", ["sample", "shuffle"])
def test_draws_of_items_are_one_stream(spark, kind, monkeypatch):
    monkeypatch.setattr(seeded, "SNAPSHOT", 500)
    sizes = [random.Random(i).randrange(0, 9) for i in range(3000)]
    sizes[7], sizes[8] = None, 300
    rng, want = random.Random(3), []
    for n in sizes:
        own = list(range(n or 0))
        if kind == "shuffle":
            rng.shuffle(own)
        else:
            own = rng.sample(own, len(own))
        want.append(own)
    items = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "idx BIGINT, n INT, start STRING")
    for parts in (1, 3, 8):
        got = seeded.item_orders(items.repartition(parts), "idx", "n", 3, kind).orderBy("idx").collect()
        assert [list(r.drawn) for r in got] == want and got[0].start == "x"
