import re
import gzip
import hashlib
import io
import random

import pytest

from larkspur.llm import warc


def brute(rows):
    lead = {}
    for key, text in rows:
        b = (text or "").encode()
        if len(b) >= 100 and key is not None:
            lead[b] = min(key, lead.get(b, key))
    out = []
    for key, text in rows:
        b = (text or "").encode()
        first = lead.get(b)
        again = first is not None and key is not None and key > first
        out.append((key, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    assert got(pages) == brute([(r.page_id, r.html) for r in pages.collect()])


def test_odd_pages(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abc é日\r\n") for _ in range(70_000))
    tricky = "x" * 50 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n0\r\n\r\n" + "y" * 80
    rows = [(5, "u", long), (3, "u", long), (9, None, long), (1, "u", None), (2, "u", ""), (4, "a\r\nb", "short"), (6, "u", "short"), (7, "u", tricky), (8, "u", tricky), (8, "u", tricky), (None, "u", tricky), (10, "u", "z" * 100), (11, "u", "z" * 99), (12, "u", "z" * 99), (13, "u", "z" * 100)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id BIGINT, url STRING, html STRING, digest STRING, row INT").repartition(3)
    assert got(df) == brute([(r[0], r[2]) for r in rows])
    assert got(spark.createDataFrame([], df.schema)) == []


def test_archives_are_warc_files(spark, tmp_path):
    text = "line\n" * 9000
    df = spark.createDataFrame([(1, "http://a/", text), (2, "http://b/", text), (3, "http://c/", "tiny")], "page_id BIGINT, url STRING, html STRING").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    records = list(warc.parsed(io.BytesIO(raw)))
    kinds = [f["warc-type"] for f, _ in records]
    assert kinds.count("revisit") == 1 and kinds.count("response") == 2 and kinds.count("continuation") >= 2
    first = next(f for f, _ in records if f.get("warc-segment-number") == "1")
    parts = [b for f, b in records if f.get("warc-segment-origin-id", f["warc-record-id"]) == first["warc-record-id"]]
    total = [f["warc-segment-total-length"] for f, _ in records if "warc-segment-total-length" in f]
    assert total == [str(sum(map(len, parts)))]
    assert warc.unframed(b"".join(parts)).decode() == text


def test_missing_segment_is_reported(spark, tmp_path):
    rows = warc.records(1, 7, "u", "word " * 20_000, "d", None, 16 << 10)
    assert len(rows) > 3
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\n" for r in rows[:2] + rows[3:]))
    (tmp_path / "b.warc").write_bytes(b"".join(r + b"\n" for r in reversed(warc.records(2, 8, "u", "word " * 20_000, "d", None, 16 << 10))))
    got = {r.page: r for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert not got["7"].whole and got["7"].payload is None
    assert got["8"].whole and bytes(got["8"].payload) == b"word " * 20_000


@pytest.mark.parametrize("payload", [b"", b"a", b"x" * 100_000, "é日".encode() * 9000])
def test_chunked_framing(payload):
    assert warc.unframed(warc.framed(payload)) == payload


@pytest.mark.parametrize("bad", [b"no head", warc.HEAD + b"5\r\nab\r\n0\r\n\r\n", warc.HEAD + b"zz\r\n"])
def test_broken_framing_is_refused(bad):
    with pytest.raises(ValueError):
        warc.unframed(bad)


def test_ids_of_any_text_come_back(spark):
    ids = ["a\r\nWARC-Type: revisit", " both ends ", "50%", "é日", "plain", "tab\there", "%0A", "\u2028"]
    html = "same text of all pages " * 10
    df = spark.createDataFrame([(i, "u", html if i != "plain" else "other") for i in ids], "page_id STRING, url STRING, html STRING")
    assert got(df) == brute([(i, html if i != "plain" else "other") for i in ids])


def test_a_broken_record_is_marked_and_the_others_are_read(spark, tmp_path):
    good = warc.records(1, 7, "u", "fine", "d", None, 16 << 10)[0]
    bad = good.replace(b"4\r\nfine", b"9\r\nfine").replace(b"urn:larkspur:1", b"urn:larkspur:2").replace(b"X-Page-ID: 7", b"X-Page-ID: 8")
    (tmp_path / "a.warc").write_bytes(bad + b"\n" + good + b"\n")
    read = {r.page: (r.whole, r.payload and bytes(r.payload)) for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert read == {"7": (True, b"fine"), "8": (False, None)}


def test_a_payload_is_held_against_its_stored_digest(spark, tmp_path):
    """A byte changed in an archive, and a digest of another kind, which says nothing here."""
    pages = spark.createDataFrame([(1, "http://a/", "x" * 300), (2, "http://b/", "y" * 300)], "page_id BIGINT, url STRING, html STRING").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w")
    [archive] = (tmp_path / "w").glob("part-*.gz")
    raw = gzip.decompress(archive.read_bytes())
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.warc").write_bytes(raw.replace(b"x" * 100, b"x" * 99 + b"z", 1))
    got = {r.page: (r.whole, r.payload is not None) for r in warc.read_archives(spark, f"{tmp_path}/bad").collect()}
    assert got == {"1": (False, True), "2": (True, True)}
    (tmp_path / "other").mkdir()
    (tmp_path / "other/a.warc").write_bytes(re.sub(rb"sha256:[0-9a-f]{64}", b"sha1:ABCDEF", raw))
    assert all(r.whole for r in warc.read_archives(spark, f"{tmp_path}/other").collect())
