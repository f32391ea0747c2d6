import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import jpeg
from larkspur.llm.kit import utf8


def padded(text):
    b = (text or "").encode()
    return b + b" " * ((-len(b)) % 192 or (0 if b else 192))


def check(rows, texts):
    for r in rows:
        want = padded(texts[r.doc_id])
        assert r.n_bytes == len((texts[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256) == (len(want), hashlib.sha256(want).hexdigest())
        assert r.tail_crc32 == zlib.crc32(want[-16:])


def test_documents_round_trip(documents):
    rows = jpeg.round_trip(documents).collect()
    texts = {d.doc_id: d.text for d in documents.collect()}
    assert len(rows) == len(texts)
    check(rows, texts)


def test_odd_rows(odd, odd_rows, none):
    rows = jpeg.round_trip(odd).collect()
    assert len(rows) == len(odd_rows)
    check(rows, {d[0]: d[1] for d in odd_rows})
    by = {r.doc_id: r for r in rows}
    assert (by[0].media_sha256, by[0].feature) == (by[1].media_sha256, by[1].feature)
    assert (by[3].media_sha256, by[3].feature) == (by[4].media_sha256, by[4].feature)
    assert jpeg.round_trip(none).count() == 0


@pytest.mark.parametrize("text", ["", "a" * 191, "b" * 192, "c" * 193, "\x00\x7f" * 400, "ÿ" * 1000, "x" * (192 * 8191 + 1)])
def test_encoding_is_lossless(text):
    media = jpeg._encode()(None, *utf8(pa.array([text, "between", text])))["media"]
    assert media[0] == media[2]
    for m, t in zip(media, [text, "between", text]):
        assert b"".join(x.tobytes() for x in jpeg.decode_dc(jpeg.parse(m))) == padded(t)


def bits_to_scan(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


def colour_image(rng, mcus=6):
    """A 4:2:0 colour image with AC coefficients, run lengths and no restarts, encoded symbol
    by symbol with other Huffman tables; with its luminance DC values."""
    dc = {s: 4 for s in range(12)}
    symbols = [0x00, 0xF0, *[r << 4 | s for r in range(4) for s in range(1, 5)]]
    ac = {s: 5 for s in symbols}
    tables = {}
    head = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0] + [16] * 64)) + jpeg._segment(0xDB, bytes([1] + [3] * 64))
    frame = bytes([8]) + (16).to_bytes(2, "big") + (16 * mcus - 5).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])
    head += jpeg._segment(0xC0, frame)
    for kind, lengths in ((0, dc), (1, ac)):
        counts, order, tables[kind] = jpeg._canonical(lengths)
        head += jpeg._segment(0xC4, bytes([kind << 4]) + counts + order)
    head += jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    bits, before = "", [0, 0, 0]
    luma = np.zeros((2, 2 * mcus), int)

    def value(v):
        s = abs(v).bit_length()
        return s, format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""

    for m in range(mcus):
        for c, blocks in ((0, 4), (1, 1), (2, 1)):
            for b in range(blocks):
                level = rng.randrange(-60, 60)
                s, extra = value(level - before[c])
                before[c] = level
                bits += format(tables[0][s], "04b") + extra
                if c == 0:
                    luma[b // 2, 2 * m + b % 2] = level
                k = 1
                while k < 64 and rng.random() < 0.8:
                    if rng.random() < 0.1 and k + 16 < 63:
                        bits += format(tables[1][0xF0], "05b")
                        k += 16
                        continue
                    r, v = rng.randrange(4), rng.choice([-9, -3, -1, 1, 2, 7])
                    if k + r > 63:
                        break
                    s, extra = value(v)
                    bits += format(tables[1][r << 4 | s], "05b") + extra
                    k += r + 1
                if k < 64:
                    bits += format(tables[1][0x00], "05b")
    return head + bits_to_scan(bits) + b"\xff\xd9", np.clip((luma * 16 + 4) // 8 + 128, 0, 255)


@pytest.mark.parametrize("seed", range(5))
def test_decoder_reads_other_baseline_images(seed):
    import random

    media, want = colour_image(random.Random(seed))
    (image,) = jpeg.parse(media)
    assert (image.height, image.width) == (16, 91)
    mixed = jpeg.decode_dc([image, *jpeg.parse(jpeg._encode()(None, *utf8(pa.array(["t"])))["media"][0])])
    assert (mixed[0] == want[:, : -(-91 // 8)]).all()


@pytest.mark.parametrize("bad", [b"no image", b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00"])
def test_other_media_are_refused(bad):
    with pytest.raises((ValueError, IndexError)):
        jpeg.parse(bad)


def test_fingerprints_of_near_images_are_near():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (40, 192)).astype(np.uint8)
    b = a.copy()
    b[0, :20] = 0
    bits = lambda s: np.unpackbits(np.frombuffer(bytes.fromhex(s.replace(":", "")), np.uint8))
    assert (bits(jpeg.fingerprint(a)) != bits(jpeg.fingerprint(b))).sum() < 16
    assert jpeg.fingerprint(np.zeros((1, 192), np.uint8)).count(":") == 1
