import os
import sys
import time
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from larkspur.functions.messages import MESSAGES
from larkspur.operators import model

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


class Counting:
    """Notes every call, and how many are in flight when it is made."""

    def __init__(self, folder, die_at=None, pause=0.0):
        self.folder, self.die_at, self.pause = folder, die_at, pause

    def chat(self, messages, **_):
        name = uuid.uuid4().hex
        open(f"{self.folder}/flying-{name}", "w").close()
        flying = sum(x.startswith("flying") for x in os.listdir(self.folder))
        text = messages[-1]["content"]
        with open(f"{self.folder}/call-{name}", "w") as f:
            f.write(f"{flying} {text}")
        time.sleep(self.pause)
        os.remove(f"{self.folder}/flying-{name}")
        if text == "bad":
            raise ValueError("no")
        if text == self.die_at and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(1)  # the worker is killed before the reply is kept
        return f"re: {text}"


def calls(folder):
    return sorted(open(f"{folder}/{x}").read().split(" ", 1)[1] for x in os.listdir(folder) if x.startswith("call-"))


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "calls"
    made.mkdir()
    return str(made)


def asked(spark, texts):
    return spark.createDataFrame([(i, [("user", t)], "x") for i, t in enumerate(texts)], f"i INT, messages {MESSAGES}, _key STRING")


def test_equal_requests_are_one_call_and_stay_in_the_ledger(spark, tmp_path, folder):
    once = lambda texts, **more: {r.i: r for r in model.ask_once(asked(spark, texts), lambda: Counting(folder), f"file://{tmp_path}/ledger", call_type="t", retry=model.Retry(1), **more).collect()}
    got = once(["a", "b", "a", "bad", "c"])
    assert [got[i].reply for i in range(5)] == ["re: a", "re: b", "re: a", None, "re: c"] and "no" in got[3].error and got[0][2] == "x"
    assert calls(folder) == ["a", "b", "bad", "c"]
    again = once(["c", "d", "a", "bad"])
    assert [again[i].reply for i in range(4)] == ["re: c", "re: d", "re: a", None]
    assert calls(folder) == ["a", "b", "bad", "bad", "c", "d"]  # what failed is asked again
    once(["a"], temperature=0.1)
    assert calls(folder).count("a") == 2  # other settings are another request


def test_a_killed_application_finds_what_it_was_told(spark, tmp_path, folder):
    """Local mode does not run a failed task again, so the second run stands for its retry: it
    makes only the calls that had no reply."""
    texts = [f"q{i}" for i in range(12)] + ["die"]
    run = lambda: model.ask_once(asked(spark, texts).repartition(1), lambda: Counting(folder, "die"), f"file://{tmp_path}/ledger", threads=1, concurrency=1)
    with pytest.raises(Exception):
        run()
    before = calls(folder)
    assert "die" in before
    got = run().collect()
    assert {r.reply for r in got} == {f"re: {t}" for t in texts}
    after = calls(folder)
    assert all(after.count(t) == 1 for t in texts if t != "die") and after.count("die") == 2


@pytest.mark.parametrize("once", [False, True])
def test_calls_in_flight_are_bounded_over_all_tasks(spark, tmp_path, folder, once):
    rows = asked(spark, [f"q{i}" for i in range(60)]).repartition(12)
    how = {"make_client": lambda: Counting(folder, pause=0.03), "threads": 2, "concurrency": 4}
    (model.ask_once(rows, ledger=f"file://{tmp_path}/ledger", **how) if once else model.ask(rows, **how)).agg(F.count("reply")).collect()
    seen = [int(open(f"{folder}/{x}").read().split()[0]) for x in os.listdir(folder) if x.startswith("call-")]
    assert len(seen) == 60 and max(seen) <= 4
