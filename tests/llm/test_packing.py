import zlib
from collections import defaultdict

import numpy as np
import pytest

from larkspur.llm import bpe, packing


def check(rows, texts, most=2048):
    """Every id in one piece, sequences gapless, little padding."""
    encoder = bpe.Encoder(bpe.default_path())
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for key, own in pieces.items():
        ids = encoder.whole([texts[key]])[0] + [1]
        copies = sum(r.start == 0 for r in own)
        covered = sorted((r.start, r.length, r.ids_crc32) for r in own)
        assert sum(r.length for r in own) == copies * len(ids)
        for start, length, crc in covered:
            assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
        assert {r.doc_tokens for r in own} == {len(ids)}
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most
        padding += 0 if at & (at - 1) == 0 else most - at
    assert padding == 0
    assert sorted(sequences) == list(range(len(sequences)))


def test_round_trip_on_documents(documents):
    check(packing.pack(documents).collect(), {r.doc_id: r.text or "" for r in documents.collect()})


def test_odd_rows(odd, odd_rows):
    check(packing.pack(odd).collect(), {d[0]: d[1] or "" for d in odd_rows})


def test_empty_table(none):
    assert packing.pack(none).count() == 0


def test_every_full_window_holds_the_proportions(documents):
    rows = packing.pack(documents).collect()
    by = defaultdict(lambda: defaultdict(int))
    for r in rows:
        by[r.sequence_id][r.queue] += r.length
    full = [w for w in by.values() if sum(w.values()) == 2048]
    total = defaultdict(int)
    for r in rows:
        total[r.queue] += r.length
    everything = sum(total.values())
    for w in full:
        assert all(abs(w[q] - 2048 * n / everything) <= 2 for q, n in total.items())


@pytest.mark.parametrize("totals, weights", [([10**6, 3, 50_000], None), ([9_000_000, 4_000_000, 1], [1, 3, 1]), ([5], None), ([2048 * 512 * 3, 0, 7], [5, 5, 5])])
def test_schedule_serves_each_token_once(totals, weights):
    s = packing.Schedule(totals, weights)
    seen = np.zeros(len(totals), np.int64)
    for run in range(s.runs):
        reach, inside = s.windows(run)
        assert (reach[:, 0] == seen).all() and (np.diff(reach, axis=1) >= 0).all()
        served = np.diff(reach, axis=1).sum(0)
        assert (served[:-1] == s.window).all()
        seen = reach[:, -1]
    assert seen.tolist() == totals


def test_deficits_carry_over_runs():
    totals = [40_000_000, 20_000_001, 777]
    s = packing.Schedule(totals)
    for run in range(0, s.runs, 7):
        begin, _ = s.cut(run)
        want = run * packing.RUN * s.window
        assert sum(begin) == min(want, s.total)
        assert all(abs(b - want * t / s.total) <= 2 for b, t in zip(begin, totals))


@pytest.mark.parametrize("text", ["it's we're I'll ''s \n's don't  x 'd", "a\n\n b\t\tc \n", "   ", "", "<|endoftext|> hi", "日本 it's", "'s't're!'s", "a 12½ ³x", "'", "a'", "'re", "x  y  z"])
def test_encoder_gives_the_tokenizers_ids(text):
    import pyarrow as pa

    from larkspur.llm.kit import utf8

    for ranks in (None, bpe.default_ranks()):
        e = bpe.Encoder(bpe.default_path(), ranks)
        got = [x.tolist() for x in e.encode(*utf8(pa.array([text, "b", text])))]
        assert got == e.whole([text, "b", text])


def many_sources(spark, n_small):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["word"] * int(rng.integers(20, 60))), "large" if i % 2 else f"s{i % (2 * n_small)}") for i in range(6000)]
    return rows, spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").repartition(5)


def test_more_sources_than_own_queues(spark):
    """1,200 small sources share a queue: each advances in proportion, none is lost, and the large
    one has its share of every window."""
    rows, df = many_sources(spark, 1200)
    out = packing.pack(df).collect()
    check(out, {r[0]: r[1] for r in rows})
    total, by = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in out:
        total[r.queue] += r.length
        by[r.sequence_id][r.queue] += r.length
    assert len(total) == 1201
    everything, last = sum(total.values()), max(by)
    for k, w in by.items():
        if sum(w.values()) == 2048:
            assert abs(w["large"] - 2048 * total["large"] / everything) <= 2
    # By half of the windows half of the small sources' documents are through.
    middle = sum(w[q] for k, w in by.items() if k < last / 2 for q in w if q != "large")
    assert abs(middle - (everything - total["large"]) / 2) < 0.02 * everything
    for q in list(total)[:50]:
        if q != "large":
            before = sum(w[q] for k, w in by.items() if k < last / 2)
            assert abs(before - total[q] / 2) <= 70


def test_weights_of_small_sources_hold_by_name(spark):
    rows, df = many_sources(spark, 700)
    out = packing.pack(df, weights={"large": 0.5, "s0": 0.25, "s2": 0.25}).collect()
    check(out, {r[0]: r[1] for r in rows})
    first = defaultdict(int)
    for r in out:
        if r.sequence_id == 0:
            first[r.queue] += r.length
    small = 698 / 300  # each source without a weight has a hundredth of the mean weight
    assert abs(first["large"] - 2048 * 0.5 / (1 + small)) < 15
    assert all(abs(first[q] - 2048 * 0.25 / (1 + small)) < 15 for q in ("s0", "s2"))


def test_one_document_each_of_many_sources(spark):
    rows = [(i, f"text number {i}", f"s{i}") for i in range(900)] + [(1000, None, None), (1001, "", None)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    check(packing.pack(df).collect(), {r[0]: r[1] or "" for r in rows})
