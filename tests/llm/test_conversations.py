import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest

from larkspur.llm import conversations as C
from larkspur.llm.queries import ORACLES, op12_signatures

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, conv STRING, head INT, kind STRING"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WORD = re.compile(r"[^\x20\x09-\x0D]")
ORDER = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """All edits of a few turns (role, text, fault), tried one by one."""
    best = None
    inserts = ["", "u", "a"]
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "u", "a"] for _, _, f in turns]
    for gaps in itertools.product(inserts, repeat=len(turns) + 1):
        for edits in itertools.product(*choices):
            roles, audit, lines, cost = "", "", [], 0
            for i in range(len(turns) + 1):
                if gaps[i]:
                    roles, audit, cost = roles + gaps[i], audit + "I", cost + 2
                    lines.append({"u": "user:", "a": "assistant:"}[gaps[i]])
                if i == len(turns):
                    break
                role, text, fault = turns[i]
                if edits[i] == "D":
                    audit, cost = audit + "D", cost + 3
                    continue
                cost += fault == "truncated"
                if edits[i] == "K":
                    roles, audit = roles + (role[:1] or "-"), audit + "K"
                    lines.append(f"{role}:{text}")
                else:
                    roles, audit, cost = roles + edits[i], audit + "R", cost + 2
                    lines.append({"u": "user:", "a": "assistant:"}[edits[i]] + text)
            if ORDER.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(lines)
    return best


def sha(text):
    return hashlib.sha256(text.encode()).digest()


def plain(rows, damage=True):
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        turns = []
        for c, turn, role, text in (r[:4] for r in rows):
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], sha(t[2])))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not WORD.search(text) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, text = cheapest([(r, t, f) for (_, r, t), f in zip(turns, faults)])
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha(text).hex()))
    return out


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_query_equals_its_sql(spark, data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    same(op12_signatures(spark, data).select(*COLUMNS).collect(), c.sql(ORACLES["op12_signatures"]).select(*COLUMNS).fetchall())


@pytest.fixture(scope="module")
def odd_turns():
    rng = np.random.default_rng(8)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "Yes", "No!", " ", "", None, "a\nb?", "x. \t", "é…", "Yes. "]
    rows = [(int(c), int(t), roles[rng.choice(7, p=[0.35, 0.35, 0.1, 0.05, 0.05, 0.05, 0.05])], texts[rng.integers(10)]) for c in range(250) for t in range(rng.integers(1, 5))]
    rows += [(None, None, "user", "Hm."), (None, 2, None, None), (None, 2, "user", "Hm."), (900, None, "user", "a."), (900, None, "assistant", "b."), (901, 5, "user", "a."), (901, 5, "user", "a."), (901, 5, "user", "b."), (901, -9, "assistant", "b.")]
    return [(*r, "clash", 1, "clash") for r in rows]


def test_against_all_edits(spark, odd_turns):
    got = C.damaged_and_repaired(spark.createDataFrame(odd_turns, SCHEMA).repartition(5)).select(*COLUMNS).collect()
    same(got, plain(odd_turns))


def test_sql_against_all_edits(odd_turns):
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in odd_turns])
    same(c.sql(ORACLES["op12_signatures"]).select(*COLUMNS).fetchall(), plain(odd_turns))


def test_a_conversation_over_many_tasks_and_pieces(spark, monkeypatch):
    """Pieces of a few turns give the same as one signature of all."""
    rng = np.random.default_rng(3)
    rows = [(1, int(i), ["user", "assistant"][i % 2] if rng.random() < 0.9 else "system", f"t{int(rng.integers(700))}" + [".", ""][rng.integers(2)]) for i in range(1500)]
    rows += [(2, 7, "user", "same.")] * 900
    docs = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    whole = C.repair(docs).collect()
    monkeypatch.setattr(C, "PIECE", 7)
    monkeypatch.setattr(C, "CHUNK", 5)
    same(C.repair(docs.repartition(6)).collect(), [tuple(r) for r in whole])
    by = {r.conv: r for r in whole}
    assert by["v2"].audit == "K" + "D" * 899 + "I" or by["v2"].audit == "D" * 900
    assert by["v2"].duplicate == 899 and ORDER.fullmatch(order_of(by["v1"].audit, rows)) is not None


def order_of(audit, rows):
    """Role initials that an audit of conversation 1 leaves, its reroles and inserts as expected."""
    out, turns = "", sorted(r for r in rows if r[0] == 1)
    i = 0
    for edit in audit:
        after = "u" if not out or out[-1] in "sa" else "a"
        if edit in "IR":
            out += after
        elif edit == "K":
            out += turns[i][2][0]
        i += edit != "I"
    return out


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.damaged_and_repaired(empty).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = C.damaged_and_repaired(spark.createDataFrame([(dropped, 0, "user", "Hi.", "", 0, "")], SCHEMA)).collect()
    same(got, [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())])
