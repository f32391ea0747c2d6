"""Secret scans with automata inferred from the credentials themselves.

Three patterns give the labelled credentials (the base spans). Two passes over all texts:

1. Labelled values and, from every other run of the credential alphabet, the counts of the
   background: a chain over (place in the run, character class before, class), summed over the
   whole corpus.
2. For each kind a prefix tree of at most ``max_labels`` distinct whole values (by hash), over
   character classes, is merged level by level: states of one level become one where no
   frequency of what follows differs by more than Hoeffding's bound. Place and length survive,
   so an automaton knows where its values end; levels that fewer than ``LEAST`` values reach
   share one looping state. Where one character is nearly all of a class in a state, as in a
   format's fixed prefix, it is a symbol of its own there, and others of its class are rare.
3. Every run of ``LEAST_RUN`` characters or more outside the base spans is a candidate. It
   becomes a span of a kind when its mean log-likelihood is that of 99 of 100 labelled values at
   least, and the kind's posterior against the background, with prior odds of labelled values to
   candidates in this corpus, reaches ``POSTERIOR``. Likelihoods only fall along a run, but
   for what its fixed characters can add, so runs are left as soon as they cannot reach it.

Null or empty texts have no spans. Repeated rows each get their row. Of a kind with fewer than
``LEAST_LABELS`` labelled values no span is added. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import hash_sample, in_batches, map_pieces, pieces, written

KINDS = ("assign", "access", "hex")
MAX_LABELS = 2000  # bound of the labelled sample, for each kind
LEAST_LABELS = 5
LEAST = 10  # values that a level of an automaton needs for states of its own
LEAST_RUN = 6
POSTERIOR = 0.9
ALPHA = 0.05
LITERAL = 0.95  # share of a class in a state from which on its character is a symbol of its own

# The patterns of labelled credentials.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Character classes: digit, a-f, other lower, A-F, other upper, and each sign by itself.
SIGNS = "+/_.=-"
N_CLASSES = 5 + len(SIGNS)
STOP = N_CLASSES
CLASS = np.full(256, -1, np.int8)
CLASS[48:58], CLASS[97:103], CLASS[103:123], CLASS[65:71], CLASS[71:91] = 0, 1, 2, 3, 4
for _i, _c in enumerate(SIGNS):
    CLASS[ord(_c)] = 5 + _i
SIZE = np.bincount(CLASS[CLASS >= 0], minlength=N_CLASSES)
LEVELS = 12  # places of a run that the background tells apart
SHAPE = (LEVELS, N_CLASSES + 1, N_CLASSES + 1)  # place, class before (the last: none), class or stop
SMOOTH = 0.05


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the labelled patterns, leftmost and not overlapping
    within a kind, by start and then kind as listed."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(buf: np.ndarray, off: np.ndarray, base: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of all bytes, starts, ends) of the candidate runs of texts: what base spans
    cover is cut out, signs at a run's ends are left out but for ``=`` behind it."""
    cls = CLASS[buf]
    if any(base):
        lead = np.flatnonzero((buf & 0xC0) != 0x80)  # byte of each code point
        first = np.searchsorted(lead, off)
        lead = np.append(lead, len(buf))
        for t in (t for t, found in enumerate(base) if found):
            for _, a, b, _ in base[t]:
                cls[lead[first[t] + a] : lead[first[t] + b]] = -1
    m = cls >= 0
    before = np.concatenate([[False], m])
    before[off] = False
    after = np.append(m, False)
    after[off] = False
    start, end = np.flatnonzero(m & ~before[:-1]), np.flatnonzero(m & ~after[1:]) + 1
    long = end - start >= LEAST_RUN
    start, end = start[long], end[long]
    if len(start):
        opens = np.append(np.flatnonzero(m & (cls < 5)), len(buf))
        closes = np.append(-1, np.flatnonzero(m & ((cls < 5) | (cls == CLASS[ord("=")]))))
        start = opens[np.searchsorted(opens, start)]
        end = closes[np.searchsorted(closes, end) - 1] + 1
        long = end - start >= LEAST_RUN
        start, end = start[long], end[long]
    return cls, start, end


def _cells(cls: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Background cells of runs, one for each character and one for the stop; first of each run."""
    size = end - start + 1
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    at = np.repeat(start, size) + place
    stop = place == np.repeat(size - 1, size)
    now = np.where(stop, STOP, cls[np.minimum(at, len(cls) - 1)]).astype(np.int64)
    before = np.where(place == 0, N_CLASSES, cls[at - 1]).astype(np.int64)
    return (np.minimum(place, LEVELS - 1) * SHAPE[1] + before) * SHAPE[2] + now, first


class Background:
    """Log-likelihood of runs under the chain counted over all candidates."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SHAPE) + SMOOTH
        self.log_p = np.log(c / c.sum(2, keepdims=True)).ravel()

    def totals(self, cls: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0)
        cells, first = _cells(cls, start, end)
        return np.add.reduceat(self.log_p[cells], first)


class Automaton:
    """A deterministic probabilistic automaton over character classes; state 0 is the start,
    the last state takes what no labelled value did and is never left."""

    def __init__(self, go: np.ndarray, count: np.ndarray, literals: dict[tuple[int, int], tuple[int, int, int]] | None = None):
        """``literals``: by state and class (character, its count, the class's count)."""
        n = len(count)
        self.go = np.full((n + 1, N_CLASSES), n, np.int32)
        self.go[:n] = np.where(go < 0, n, go)
        self.log_p = np.full((n + 1, N_CLASSES + 1), math.log(1e-3))
        self.log_p[:n] = np.log((count + SMOOTH) / (count.sum(1) + SMOOTH * (N_CLASSES + 1))[:, None])
        self.loops = (self.go == np.arange(n + 1)[:, None]).all(1)
        # Against a class whose characters are equally likely, as in the background.
        self.of_character = np.zeros((n + 1, 256))
        for (state, c), (character, k, all_) in (literals or {}).items():
            share = (k + 0.5) / (all_ + 1)
            self.of_character[state, CLASS == c] = math.log((1 - share) * SIZE[c] / (SIZE[c] - 1))
            self.of_character[state, character] = math.log(share * SIZE[c])
        self.literal = bool(literals)
        # What the rest of a run can still gain from a state on: its literals, all met. States
        # lead to later ones or to themselves.
        self.ahead = np.zeros(n + 1)
        for state in range(n - 1, -1, -1):
            after = self.go[state][self.go[state] != state]
            self.ahead[state] = max(0.0, self.of_character[state].max()) + (self.ahead[after].max() if len(after) else 0.0)

    def totals(self, cls: np.ndarray, start: np.ndarray, end: np.ndarray, need: np.ndarray | None = None, raw: np.ndarray | None = None) -> np.ndarray:
        """Log-likelihood of each run, the stop included; runs that can no longer reach ``need``
        are left where they fall below it. ``raw`` are the characters; without them classes alone count."""
        out, state = np.zeros(len(start)), np.zeros(len(start), np.int64)
        live, step = np.arange(len(start)), 0
        while len(live):
            at = start[live] + step
            done = at >= end[live]
            out[live[done]] += self.log_p[state[live[done]], STOP]
            for i in live[~done & self.loops[state[live]]]:  # one state up to the end
                out[i] += np.bincount(cls[start[i] + step : end[i]], minlength=N_CLASSES) @ self.log_p[state[i], :STOP] + self.log_p[state[i], STOP]
                done[live == i] = True
            live = live[~done]
            c = cls[start[live] + step]
            out[live] += self.log_p[state[live], c]
            if raw is not None and self.literal:
                out[live] += self.of_character[state[live], raw[start[live] + step]]
            state[live] = self.go[state[live], c]
            if need is not None:
                reach = out[live] + self.ahead[state[live]] if self.literal else out[live]
                live = live[reach >= need[live]]
            step += 1
        return out

    def score(self, value: str) -> float:
        """Mean log-likelihood of a symbol, the stop included."""
        return float(means(self, [value])[0])


def _raw(values: list[str]) -> np.ndarray:
    return np.frombuffer("".join(values).encode("latin-1", "replace"), np.uint8)


def _laid(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    end = np.cumsum([len(v) for v in values])
    return CLASS[_raw(values)], end - [len(v) for v in values], end


def means(automaton: Automaton, values: list[str]) -> np.ndarray:
    cls, start, end = _laid(values)
    return automaton.totals(cls, start, end, raw=_raw(values)) / (end - start + 1)


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the values' prefix tree, level by level.

    A state is the set of values that pass it; it is never spelled out as a tree.
    """
    cls, start, end = _laid(values)
    raw = _raw(values)
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def follow(members: np.ndarray, level: int) -> np.ndarray:
        at = start[members] + level
        return np.where(at < end[members], cls[np.minimum(at, len(cls) - 1)], STOP)

    def compatible(a: np.ndarray, b: np.ndarray, level: int) -> bool:
        todo = [(a, b, level)]
        while todo:
            a, b, level = todo.pop()
            allowed = bound * (len(a) ** -0.5 + len(b) ** -0.5)
            if allowed >= 1:
                continue
            x, y = follow(a, level), follow(b, level)
            if (np.abs(np.bincount(x, minlength=STOP + 1) / len(a) - np.bincount(y, minlength=STOP + 1) / len(b)) > allowed).any():
                return False
            todo += [(a[x == c], b[y == c], level + 1) for c in np.intersect1d(x, y) if c != STOP]
        return True

    go, count, literals = [], [], {}
    level, states = 0, [np.arange(len(values))]
    while states:
        first = len(go)
        seen = [follow(m, level) for m in states]
        for i, (members, x) in enumerate(zip(states, seen)):
            for c in np.unique(x[x != STOP]):
                characters = np.bincount(raw[start[members[x == c]] + level], minlength=256)
                if SIZE[c] > 1 and characters.sum() >= LEAST and characters.max() >= LITERAL * characters.sum():
                    literals[first + i, int(c)] = int(characters.argmax()), int(characters.max()), int(characters.sum())
        count += [np.bincount(x, minlength=STOP + 1) for x in seen]
        go += [np.full(N_CLASSES, -1) for _ in states]
        groups = [(m[x == c], first + i, c) for i, (m, x) in enumerate(zip(states, seen)) for c in np.unique(x) if c != STOP]
        level += 1
        if sum(len(g) for g, _, _ in groups) < LEAST:
            if groups:  # what few values reach: one state that loops
                tail = len(go)
                rest = np.concatenate([g for g, _, _ in groups])
                count.append(sum(np.bincount(cls[start[i] + level : end[i]], minlength=STOP + 1) for i in rest) + np.bincount([STOP], minlength=STOP + 1) * len(rest))
                go.append(np.full(N_CLASSES, tail))
                for _, state, c in groups:
                    go[state][c] = tail
            break
        merged: list[np.ndarray] = []
        for members, state, c in sorted(groups, key=lambda g: -len(g[0])):
            k = next((k for k, m in enumerate(merged) if compatible(m, members, level)), None)
            if k is None:
                k = len(merged)
                merged.append(members)
            else:
                merged[k] = np.concatenate([merged[k], members])
            go[state][c] = len(go) + k
        states = merged
    return Automaton(np.array(go), np.array(count, float), literals)


class Formats:
    """Automata of all kinds and the background, with the thresholds that the corpus implies."""

    def __init__(self, labelled: dict[str, list[str]], known: dict[str, int], counts: np.ndarray):
        self.background = Background(counts)
        runs = counts.reshape(SHAPE)[0].sum()
        self.kinds = {}
        for kind in KINDS:
            if len(values := labelled.get(kind, [])) >= LEAST_LABELS:
                automaton = infer(values)
                own = np.sort(means(automaton, values))
                odds = math.log(max(1.0, runs / known[kind])) + math.log(POSTERIOR / (1 - POSTERIOR))
                self.kinds[kind] = (automaton, own[len(own) // 100] - 1e-9, odds)

    def classify(self, cls: np.ndarray, start: np.ndarray, end: np.ndarray, raw: np.ndarray) -> list[tuple[int, str]]:
        """(run, kind) of the runs that a kind's format explains, the likeliest kind of each."""
        background = self.background.totals(cls, start, end)
        best, out = np.full(len(start), -np.inf), {}
        for kind, (automaton, least, odds) in self.kinds.items():
            total = automaton.totals(cls, start, end, np.maximum(background + odds, least * (end - start + 1)), raw)
            for i in np.flatnonzero((total - background >= odds) & (total >= least * (end - start + 1)) & (total > best)):
                best[i], out[int(i)] = total[i], kind
        return sorted(out.items())


SPAN = "STRUCT<kind: STRING, start: BIGINT, end: BIGINT, value: STRING>"


def scan(texts: list[str | None], buf: np.ndarray, off: np.ndarray, formats: Formats) -> tuple[list, list]:
    """Base and added spans (kind, start, end, value) of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    added: list[list] = [[] for _ in texts]
    if formats.kinds:
        cls, start, end = candidates(buf, off, base)
        for i, kind in formats.classify(cls, start, end, buf):
            t = int(np.searchsorted(off, start[i], "right")) - 1
            before = int(((buf[off[t] : start[i]] & 0xC0) != 0x80).sum())
            value = buf[start[i] : end[i]].tobytes().decode("ascii")
            added[t].append((kind, before, before + len(value), value))
    return base, added


def fit(docs: DataFrame, text: str = "text", max_labels: int = MAX_LABELS) -> Formats:
    """One pass over all texts: labelled values and the background's counts."""

    def run(batches):
        total = np.zeros(math.prod(SHAPE), np.int64)
        for batch in batches:
            for part, buf, off in pieces(batch, text):
                base = [base_spans(t) if t else [] for t in part.column(text).to_pylist()]
                cls, start, end = candidates(buf, off, base)
                if len(start):
                    total += np.bincount(_cells(cls, start, end)[0], minlength=len(total))
                found = [(s[0], s[3]) for spans in base for s in spans]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found]), pa.array([v for _, v in found]), pa.nulls(len(found), pa.int32()), pa.array([1] * len(found), pa.int64())], names=names)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(cell), pa.string()), pa.nulls(len(cell), pa.string()), pa.array(cell, pa.int32()), pa.array(total[cell], pa.int64())], names=names)

    names = ["kind", "value", "cell", "n"]
    seen = written(in_batches(docs.select(text), run, "kind STRING, value STRING, cell INT, n BIGINT"), "labelled")
    counts = np.zeros(math.prod(SHAPE))
    for r in seen.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # cells of a fixed table
        counts[r.cell] = r.n
    known = {r.kind: r.n for r in seen.where("kind IS NOT NULL").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    labelled = {kind: [r.value for r in hash_sample(seen.where(F.col("kind") == kind).select("value").distinct(), ["value"], max_labels).collect()] for kind in known}
    return Formats(labelled, known, counts)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", max_labels: int = MAX_LABELS) -> DataFrame:
    """Per document: ``base`` spans and ``added`` spans (kind, start, end, value), by start."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text, max_labels))

    def make():
        formats = shared.value

        def kernel(batch, buf, off):
            both = scan(batch.column("text").to_pylist(), buf, off, formats)
            return {name: [[dict(zip(("kind", "start", "end", "value"), s)) for s in found] for found in x] for name, x in zip(("base", "added"), both)}

        return kernel

    return map_pieces(docs.select(key, F.col(text).alias("text")), "text", [key], f"base ARRAY<{SPAN}>, added ARRAY<{SPAN}>", make)


def joined(spans_column) -> F.Column:
    """kind:start:end of each span by start, then kind as listed, comma-joined."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.array_sort(F.transform(spans_column, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("text"))))
    return F.concat_ws(",", F.transform(keyed, lambda s: s["text"]))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of op1."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(key, *[n(k) for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


MASK = "[secret]"


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every secret's characters replaced by a mask, all columns kept. Texts
    are masked in the pass that reads them, so each row goes by its own text, whatever its id."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text))
    names = docs.columns

    def mask(batches):
        formats = shared.value
        for batch in batches:
            for part, buf, off in pieces(batch, text):
                texts = part.column(text).to_pylist()
                found = [a + b for a, b in zip(*scan(texts, buf, off, formats))]
                new = [cut(t, s) if s else t for t, s in zip(texts, found)]
                columns = {c: part.column(c) for c in names} | {text: pa.array(new, part.schema.field(text).type)}
                if length in names:
                    columns[length] = pa.array([len(t) if s else n for n, t, s in zip(part.column(length).to_pylist(), new, found)], part.schema.field(length).type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return in_batches(docs, mask, docs.schema)


def cut(text: str, found: list[tuple]) -> str:
    """Mask the union of the spans; of an assignment only its value is masked."""
    out, at = [], 0
    for _, begin, end, value in sorted(found, key=lambda s: s[1:3]):
        start = max(at, end - len(value))
        if end > at:
            out += [text[at:start], MASK if start == end - len(value) or not out else ""]
            at = end
    return "".join(out) + text[at:]
