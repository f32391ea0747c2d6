"""Baseline JPEG media columns: lossless carriage of bytes, and DC-only decoding in numpy.

Every payload byte is the grey value of one 8x8 block: its DC coefficient, divided by the
quantiser 8, is exactly value - 128, and all AC coefficients are zero. So the DC-only
luminance thumbnail of the image is the payload. A row of 192 blocks is a restart interval;
the Huffman table gives every difference nine bits with its extra bits, so rows are packed
and unpacked without loops. Payloads over 8191 rows go on in further images.

The decoder is for any baseline image: it parses the markers, Huffman-decodes the scan with
the image's own tables (all restart intervals of all images of a batch in step), follows AC
codes without keeping them, and returns the luminance DC values as a thumbnail.

Null texts are empty texts; an empty text is 192 blanks. Repeated rows each get their row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .kit import in_batches, map_pieces, written

ROW = 192  # payload bytes in a row of blocks
MOST_ROWS = 8191  # of 8 pixels: an image's height has 16 bits
PAD = 32

DC_LENGTHS = {size: 9 - size if size else 9 for size in range(9)}  # code bits by difference size


def _canonical(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, int]]:
    """Counts by length, symbols in order, and codes, of a Huffman table."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], -s))
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = code
        code += 1
        counts[last - 1] += 1
    return bytes(counts), bytes(symbols), codes


_COUNTS, _SYMBOLS, _CODES = _canonical(DC_LENGTHS)
_CODE10 = np.zeros(511, np.uint16)  # nine bits of each difference, and the end-of-block bit
for _v in range(-255, 256):
    _s = abs(_v).bit_length()
    _CODE10[_v + 255] = (_CODES[_s] << _s | (_v if _v > 0 else _v + (1 << _s) - 1 if _s else 0)) << 1


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    quant = bytes([0, 8] + [1] * 63)
    frame = bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    tables = bytes([0x00]) + _COUNTS + _SYMBOLS + bytes([0x10]) + bytes([1] + [0] * 15) + b"\0"
    return b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, tables) + _segment(0xDD, ROW.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def encode(payload: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Media of payloads that lie one after another; ``first`` are their first rows."""
    grid = payload.reshape(-1, ROW).astype(np.int16)
    step = np.empty_like(grid)
    step[:, 0] = grid[:, 0] - 128
    step[:, 1:] = grid[:, 1:] - grid[:, :-1]
    c = _CODE10[step + 255].reshape(len(grid), ROW // 4, 4)
    bits = np.stack([c[..., 0] >> 2, (c[..., 0] & 3) << 6 | c[..., 1] >> 4, (c[..., 1] & 15) << 4 | c[..., 2] >> 6, (c[..., 2] & 63) << 2 | c[..., 3] >> 8, c[..., 3] & 255], -1).astype(np.uint8).ravel()
    stuffed = bits == 0xFF
    width = ROW * 10 // 8
    before = np.cumsum(stuffed) - stuffed
    at = np.arange(len(bits)) + before + 2 * (np.arange(len(bits)) // width)  # room for a marker after each row
    out = np.zeros((at[-1] + 4 if len(at) else 0), np.uint8)
    out[at] = bits  # a zero follows each stuffed byte by itself
    ends = np.append(at[width::width] - 2, len(out) - 3 + stuffed[-1]) if len(at) else at
    row_in = np.concatenate([np.arange(b - a) % MOST_ROWS for a, b in zip(first, first[1:])]) if len(first) > 1 else np.zeros(0, int)
    out[ends] = 0xFF
    out[ends + 1] = 0xD0 + row_in % 8
    starts = at[::width]
    media = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        parts = []
        for x in range(a, b, MOST_ROWS):
            y = min(b, x + MOST_ROWS)
            parts += [_header(y - x), out[starts[x] : ends[y - 1]].tobytes(), b"\xff\xd9"]
        media.append(b"".join(parts))
    return media


@dataclass
class Image:
    height: int = 0
    width: int = 0
    components: list = field(default_factory=list)  # id, h, v, quantiser table, DC table, AC table
    restart: int = 0
    quant: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)  # (class, number) -> (counts, symbols)
    scan: bytes = b""


def parse(data: bytes) -> list[Image]:
    """Images of a stream, by their markers. Raises ValueError for what isn't baseline."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of an image")
        image, at = Image(), at + 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker")
            marker = data[at + 1]
            if marker == 0xD9:
                at += 2
                break
            if marker == 0xFF:
                at += 1
                continue
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    image.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + bool(wide)], "big")  # that of the DC coefficient
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    image.tables[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                image.components = [[body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2], 0, 0] for i in range(6, 6 + 3 * body[5], 3)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == 0xDD:
                image.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                if body[0] != len(image.components):
                    raise ValueError("components in several scans")
                for i in range(1, 1 + 2 * body[0], 2):
                    for c in image.components:
                        if c[0] == body[i]:
                            c[4], c[5] = body[i + 1] >> 4, body[i + 1] & 15
                end = at
                while True:  # to a marker that is neither a stuffed byte nor a restart
                    end = data.index(b"\xff", end)
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                    else:
                        break
                image.scan, at = data[at:end], end
        out.append(image)
    return out


def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol by the next 16 bits; length 0 where no code fits."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = k = 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            a, b = code << (16 - bits), (code + 1) << (16 - bits)
            length[a:b], symbol[a:b] = bits, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


_tables: dict = {}


def _table(key) -> tuple[np.ndarray, np.ndarray]:
    if key not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        _tables[key] = lookup(*key)
    return _tables[key]


def intervals(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and restart markers, and where its intervals begin."""
    raw = np.frombuffer(scan, np.uint8)
    lead = np.flatnonzero(raw[:-1] == 0xFF)
    mark = lead[raw[lead + 1] >= 0xD0]
    keep = np.ones(len(raw), bool)
    keep[lead[raw[lead + 1] == 0] + 1] = False
    keep[mark] = keep[mark + 1] = False
    return raw[keep], np.concatenate([[0], np.cumsum(keep)[mark]]) if len(mark) else np.zeros(1, np.int64)


def decode_dc(images: list[Image]) -> list[np.ndarray]:
    """Luminance thumbnails, a value for each 8x8 block, of images in any mixture."""
    groups = defaultdict(list)
    for i, im in enumerate(images):
        layout = tuple((h, v, im.tables[0, dc], im.tables[1, ac]) for _, h, v, _, dc, ac in im.components)
        groups[layout].append(i)
    out: list = [None] * len(images)
    for layout, members in groups.items():
        single = len(layout) == 1  # then blocks are not interleaved, whatever the sampling
        top_h, top_v = max(x[0] for x in layout), max(x[1] for x in layout)
        bits, begin, blocks, where = [], [], [], []
        base = 0
        for i in members:
            im = images[i]
            h, v = (1, 1) if single else (top_h, top_v)
            mcu_w, mcu_h = -(-im.width // (8 * h)), -(-im.height // (8 * v))
            total = mcu_w * mcu_h
            data, starts = intervals(im.scan)
            each = im.restart or total
            n = -(-total // each)
            if len(starts) != n:
                raise ValueError("restart intervals are missing")
            bits.append(data)
            begin.append(base + starts)
            blocks.append(np.minimum(each, total - each * np.arange(n)))
            base += len(data)
            where.append((i, mcu_w, mcu_h, n))
        buf = np.concatenate([*bits, np.zeros(8, np.uint8)]).astype(np.int64)
        word = (buf[:-4] << 32) | (buf[1:-3] << 24) | (buf[2:-2] << 16) | (buf[3:-1] << 8) | buf[4:]  # 40 bits from each byte
        pos = np.concatenate(begin) * 8
        todo = np.concatenate(blocks)
        luma_h, luma_v = (1, 1) if single else layout[0][:2]
        values = np.zeros((len(pos), int(todo.max(initial=0)), luma_h * luma_v), np.int64)
        before = np.zeros((len(layout), len(pos)), np.int64)
        for step in range(values.shape[1]):
            live = np.flatnonzero(todo > step)
            everyone = len(live) == len(pos)
            for c, (h, v, dc, ac) in enumerate(layout):
                dc_len, dc_size = _table(dc)
                ac_len, ac_symbol = _table(ac)
                for b in range(1 if single else h * v):
                    p = pos if everyone else pos[live]
                    w = word[p >> 3] << (p & 7)  # 33 good bits below bit 40
                    ahead = (w >> 24) & 0xFFFF
                    size, length = dc_size[ahead], dc_len[ahead]
                    if not length.all():
                        raise ValueError("no such code")
                    p = p + length
                    extra = ((word[p >> 3] << (p & 7)) >> (40 - size)) & ((1 << size) - 1)
                    half = (1 << size) >> 1
                    diff = np.where(extra < half, extra - (1 << size) + 1, extra)
                    p = p + size
                    if everyone:
                        before[c] += diff
                    else:
                        before[c, live] += diff
                    if c == 0:
                        values[live, step, b] = before[0] if everyone else before[0, live]
                    k = np.ones(len(p), np.int64)
                    on = np.arange(len(p))
                    while len(on):
                        q = p[on]
                        ahead = ((word[q >> 3] << (q & 7)) >> 24) & 0xFFFF
                        symbol, length = ac_symbol[ahead], ac_len[ahead]
                        if not length.all():
                            raise ValueError("no such code")
                        p[on] = q + length + (symbol & 15)
                        k[on] += (symbol >> 4) + 1
                        on = on[(symbol != 0) & (k[on] < 64)]
                    if everyone:
                        pos = p
                    else:
                        pos[live] = p
        row = 0
        for i, mcu_w, mcu_h, n in where:
            im = images[i]
            flat = np.concatenate([values[row + j, : todo[row + j]] for j in range(n)]) if todo[row : row + n].min() != todo[row] else values[row : row + n, : todo[row]].reshape(-1, values.shape[2])
            row += n
            grid = flat.reshape(mcu_h, mcu_w, luma_v, luma_h).transpose(0, 2, 1, 3).reshape(mcu_h * luma_v, mcu_w * luma_h)
            luma = im.components[0]
            wide = -(-im.width * luma[1] // (8 * top_h))
            high = -(-im.height * luma[2] // (8 * top_v))
            level = np.floor_divide(grid[:high, :wide] * im.quant[luma[3]] + 4, 8) + 128
            out[i] = np.clip(level, 0, 255).astype(np.uint8)
    return out


def fingerprint(thumbnail: np.ndarray) -> str:
    """Mean and gradient hashes of a thumbnail on an 8x9 grid, as hexadecimal digits."""
    h, w = thumbnail.shape
    ys, xs = np.arange(9) * h // 8, np.arange(10) * w // 9
    table = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(thumbnail, 0, dtype=np.int64), 1, out=table[1:, 1:])
    y0, y1 = np.minimum(ys[:-1], h - 1), np.maximum(ys[1:], np.minimum(ys[:-1], h - 1) + 1)
    x0, x1 = np.minimum(xs[:-1], w - 1), np.maximum(xs[1:], np.minimum(xs[:-1], w - 1) + 1)
    sums = table[y1[:, None], x1] - table[y0[:, None], x1] - table[y1[:, None], x0] + table[y0[:, None], x0]
    mean = sums / ((y1 - y0)[:, None] * (x1 - x0))
    small = mean[:, :8]
    bits = [(small > small.mean()).ravel(), (mean[:, 1:] > mean[:, :-1]).ravel()]
    return ":".join(np.packbits(b).tobytes().hex() for b in bits)


def _encode():
    def kernel(batch, buf, off):
        size = np.diff(off)
        rows = np.maximum(1, -(-size // ROW))
        first = np.concatenate([[0], np.cumsum(rows)])
        payload = np.full(first[-1] * ROW, PAD, np.uint8)
        payload[np.arange(len(buf)) + np.repeat(first[:-1] * ROW - off[:-1], size)] = buf
        return {"n_bytes": size, "media": encode(payload, first)}

    return kernel


def with_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's bytes, padded, as a JPEG: key, n_bytes and the binary column media."""
    return map_pieces(docs.select(key, text), text, [key], "n_bytes BIGINT, media BINARY", _encode)


FIELDS = "width BIGINT, height BIGINT, payload_bytes BIGINT, payload_sha256 STRING, tail_crc32 BIGINT, media_bytes BIGINT, media_sha256 STRING, feature STRING"


def described(media: list[bytes]) -> dict[str, list]:
    """Dimensions, digests of the carried bytes and of the media, and thumbnail hashes."""
    images, owner = [], [0]
    for m in media:
        images += parse(m)
        owner.append(len(images))
    thumbnails = decode_dc(images)
    out: dict[str, list] = {name.split()[0]: [] for name in FIELDS.split(", ")}
    for i, m in enumerate(media):
        own = thumbnails[owner[i] : owner[i + 1]]
        whole = own[0] if len(own) == 1 else np.concatenate(own)
        data = whole.tobytes()
        width, height = images[owner[i]].width, sum(im.height for im in images[owner[i] : owner[i + 1]])
        row = (width, height, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), f"{width}x{height}:{fingerprint(whole)}")
        for values, x in zip(out.values(), row):
            values.append(x)
    return out


def features(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Decode a column of baseline JPEG media and describe it."""
    rows = media.select(key, "n_bytes", F.col(column).alias("media"))
    schema = StructType([rows.schema[key], rows.schema["n_bytes"], *StructType.fromDDL(FIELDS).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            at = 0
            sizes = np.cumsum([len(x) for x in batch.column("media").to_pylist()])
            while at < batch.num_rows:  # about half a megabyte of media at a time
                done = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + (1 << 19), "right")))
                part = batch.slice(at, to - at)
                made = described(part.column("media").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("n_bytes"), *[pa.array(v, arrow.field(k).type) for k, v in made.items()]], schema=arrow)
                at = to

    return in_batches(rows, run, schema)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of op5: media are written to a table, read back, decoded and described."""
    return features(written(with_media(docs, key, text), "media"), key)
