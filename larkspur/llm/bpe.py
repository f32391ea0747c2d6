"""Byte-level BPE of whole columns through a cache of pre-tokens.

Each distinct pre-token is encoded once for a Python worker; numpy splits texts into
pre-tokens and gathers the cached ids, which is several times faster than encoding every
text and gives the same ids. Single pre-tokens are encoded from the vocabulary's ranks file
where one is given (the same vocabulary, a faster library), else by the tokenizer. Texts with
a code point beyond U+058F go to the tokenizer whole, so the split rule here only has to know
well-settled characters.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from .kit import mix, powers

LAST_SPLIT_HERE = 0x58F
CACHE_WORDS = 1 << 20
FRESH_WORDS = 1 << 14  # looked up in a dict until they are merged into sorted arrays

# Unicode White_Space below U+0590.
SPACES = (9, 10, 11, 12, 13, 32, 133, 160)
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    out = np.full(LAST_SPLIT_HERE + 1, OTHER, np.int8)
    for c in range(len(out)):
        kind = unicodedata.category(chr(c))[0]
        out[c] = SPACE if c in SPACES else {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    return out


CLASS = _classes()


def starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where a pre-token starts. Rule: contractions ('s 't 're 've 'm 'll 'd), or
    one optional blank and a run of letters, numbers or other signs, or white space that
    leaves its last character to what follows it."""
    n = len(cp)
    cls = CLASS[cp]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    prev = np.empty(n, np.int8)
    prev[1:] = cls[:-1]
    prev_blank = np.zeros(n, bool)
    prev_blank[1:] = cp[:-1] == 32
    prev[edge[:n]] = -1
    prev_blank[edge[:n]] = False
    start = (cls != prev) & ~prev_blank
    space = cls == SPACE
    start |= space & (prev != SPACE)
    last = np.zeros(n, bool)  # the last white space before something else in the same text
    last[:-1] = space[:-1] & ~space[1:]
    last[edge[1:]] = False
    start |= last
    for i in np.flatnonzero((cp == 39) & start):
        stop = first[np.searchsorted(first, i, "right")]
        tail = cp[i + 1 : min(i + 3, stop)].tobytes().decode("utf-32-le")
        size = 1 if tail[:1] in ("s", "t", "m", "d") and tail else 2 if tail in ("re", "ve", "ll") else 0
        if size:
            start[i + 1 : i + 1 + size] = False
            if i + 1 + size < stop:
                start[i + 1 + size] = True
    return np.flatnonzero(start)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() < 65536 else np.dtype("<u4")
        self.single = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            # The pattern takes a pre-token whole: texts are split before they come here.
            self.single = tiktoken.Encoding("pre-tokens", pat_str=r"(?s).+", mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.clear()

    def clear(self) -> None:
        self.fresh: dict[int, int] = {}
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of the words merged so far
        self.numbers = np.zeros(0, np.int32)
        self.size = 0
        self.flat = np.zeros(1 << 16, self.dtype)
        self.at = np.zeros((1 << 14, 2), np.int64)  # offset and length by word number
        self.used = 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, hashes: list[int], words: list[str]) -> None:
        got = list(map(self.single, words)) if self.single else self.whole(words)
        k, n = self.size, len(got)
        length = np.fromiter(map(len, got), np.int64, n)
        ids = np.fromiter(chain.from_iterable(got), self.dtype, int(length.sum()))
        while k + n > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[k : k + n, 0] = self.used + np.cumsum(length) - length
        self.at[k : k + n, 1] = length
        self.used += len(ids)
        self.fresh.update(zip(hashes, range(k, k + n)))
        self.size += n

    def merge(self) -> None:
        keys = np.fromiter(self.fresh.keys(), np.uint64, len(self.fresh))
        numbers = np.fromiter(self.fresh.values(), np.int32, len(self.fresh))
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.keys, self.numbers = np.insert(self.keys, place, keys[order]), np.insert(self.numbers, place, numbers[order])
        self.fresh = {}

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Numbers of sorted hashes; -1 for words that are not known."""
        out = np.full(len(h), -1, np.int64)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[i] == h
            out[hit] = self.numbers[i[hit]]
        rest = np.flatnonzero(out < 0)
        get = self.fresh.get
        out[rest] = [get(x, -1) for x in h[rest].tolist()]
        return out

    def encode(self, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each text."""
        lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        first = lead[off]
        raw = buf.tobytes()
        cp = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        if len(cp) != first[-1]:  # not valid UTF-8: each text by itself
            return [np.array(x, self.dtype) for x in self.whole([raw[a:b].decode("utf-8", "replace") for a, b in zip(off, off[1:])])]
        far = np.unique(np.searchsorted(first, np.flatnonzero(cp > LAST_SPLIT_HERE), "right") - 1)
        if len(far):
            cp = cp.copy()
            for t in far:
                cp[first[t] : first[t + 1]] = 32
        at = starts(cp, first) if len(cp) else np.zeros(0, np.int64)
        p, inv = powers(len(cp))
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * p[: len(cp)], out=total[1:])
        end = np.append(at[1:], len(cp))
        h, where, back = np.unique(mix((total[end] - total[at]) * inv[at]) if len(at) else np.zeros(0, np.uint64), return_index=True, return_inverse=True)
        if self.size > CACHE_WORDS:
            self.clear()
        if len(self.fresh) > FRESH_WORDS:
            self.merge()
        number = self.lookup(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            text = cp.tobytes()
            k = self.size
            self.learn(h[new].tolist(), [text[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(at[where[new]].tolist(), end[where[new]].tolist())])
            number[new] = np.arange(k, k + len(new))
        number = number[back]
        offset, length = self.at[number].T if len(number) else (number, number)
        ends = np.cumsum(length)
        index = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - offset, length)
        ids = self.flat[index]
        bounds = np.concatenate([[0], ends])[np.searchsorted(at, first)]
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        if len(far):
            for t, x in zip(far, self.whole([raw[off[t] : off[t + 1]].decode() for t in far])):
                out[t] = np.array(x, self.dtype)
        return out


@lru_cache(2)
def encoder(path: str, ranks: str | None = None) -> Encoder:
    """The worker process's own encoder: its cache outlives a task."""
    return Encoder(path, ranks)
