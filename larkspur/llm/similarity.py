"""N-gram Jaccard join with Bayesian candidate pruning.

Similarity is the Jaccard coefficient of the sets of five consecutive words (a text of fewer
words, but not none, has one shingle of all its words). Steps:

1. Equal texts form a class, which gets a number.
2. MinHash signatures are cut into bands; a pair at the threshold misses all bands with a
   probability below 1e-5. The classes of a bucket are compared by sketches (the low bytes of
   their MinHash values), some values at a time: a pair is dropped when the posterior
   probability (uniform prior) that it reaches the threshold falls below ``tolerance``. Classes
   that are joined already are not compared again, and only edges that join them are made, so
   a bucket of near copies costs one comparison each. Texts that merely share a template
   (below a similarity of about 0.6) part here: the components of what is left hold every
   candidate pair, and do not grow by chance.
3. Each component's texts are dealt out in blocks. Of a component of one block the pairs' full
   MinHash values are compared in the same way, and what is left is verified exactly on shingle
   sets. In a larger one a text meets no text but the component's first, once: what is left of
   it is in what its shingles differ from that one's, some bytes for a near copy.
4. These differences, and sketches, are dealt to pairs of blocks: pairs are pruned by sketches and
   verified exactly, as two sets share what neither lacks of the first one's, and the differences
   that they have in common. No task holds more than two blocks, and no row is made for a pair.
5. Links are counted for each class and their components give the near-duplicate groups.

Null texts are empty texts; texts without words have no links, equal ones share a class.
Every row goes by its own text, whatever its id: ids may be null or repeated. A group's id is
the least of its rows; it is null where none of them has one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .components import components
from .kit import CHUNK_BYTES, Words, in_batches, map_pieces, mix, numbered, per_text, pieces, shingles, small_side, without, written

THRESHOLD = 0.8
K = 5
BANDS, ROWS = 30, 5
STEP = 30  # MinHash values compared between two prunings
TOLERANCE = 1e-6
BLOCK = 256  # classes in a block
SKETCHES = 2048  # classes of a bucket in a block

_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def signatures(sh: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each text; texts without shingles get the largest value."""
    out = np.empty((len(first) - 1, len(_A)), np.uint64)
    for i in range(len(_A)):
        out[:, i] = per_text(sh * _A[i] + _B[i], first, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    return out


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values, the fewest matches with P(J >= threshold) >= tolerance.

    With a uniform prior that posterior is P(Binomial(n + 1, threshold) <= matches).
    """
    out = {}
    for n in range(STEP, len(_A) + 1, STEP):
        p = 0.0
        for m in range(n + 2):
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if p >= tolerance:
                out[n] = m
                break
    return out


def _bands():
    def kernel(batch, buf, off):
        sh, first = shingles(Words(buf, off), K)
        sig = signatures(sh, first)
        keys = np.zeros((len(sig), BANDS), np.uint64)
        for j in range(ROWS):
            keys = mix(keys + sig[:, j::ROWS]) + np.arange(BANDS, dtype=np.uint64)
        keys = mix(keys).view(np.int64)
        low = sig.astype(np.uint8)
        n = np.diff(first)
        return {"bands": [k if x else [] for k, x in zip(keys, n)], "sketch": [low[i].tobytes() if x else b"" for i, x in enumerate(n.tolist())]}

    return kernel


def joined_by_sketch(sketch: np.ndarray, sides: tuple[np.ndarray, np.ndarray] | None, need: dict[int, int]) -> list[tuple[int, int]]:
    """Edges (i, j) that join the rows whose sketches may reach the threshold, as all pairs
    that may (of one row on either side where ``sides`` are given) would. A row that a group
    takes in is compared with those outside the group only."""
    n = len(sketch)
    other = np.zeros(n, np.int8)
    if sides is not None:
        other[sides[1]] = 1
    outside, edges = np.arange(n), []
    while len(outside):
        front, outside = [int(outside[0])], outside[1:]
        while front and len(outside):
            i = front.pop()
            near = outside if sides is None else outside[other[outside] != other[i]]
            same = np.zeros(len(near), np.int64)
            for m in sorted(need):
                same += (sketch[near, m - STEP : m] == sketch[i, m - STEP : m]).sum(1)
                alive = same >= need[m]
                near, same = near[alive], same[alive]
            edges += [(i, int(j)) for j in near]
            front += near.tolist()
            outside = outside[~np.isin(outside, near)]
    return edges


def pruned(sig, left, right, need) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose values agree as often as ``need`` asks after each STEP of them."""
    left, right = np.asarray(left), np.asarray(right)
    same = np.zeros(len(left), np.int64)
    for n in sorted(need):
        same += (sig[left, n - STEP : n] == sig[right, n - STEP : n]).sum(1)
        alive = same >= need[n]
        left, right, same = left[alive], right[alive], same[alive]
    return left, right


def in_common(sets, left, right) -> np.ndarray:
    """How many elements the sets of each pair share."""
    ids = np.unique(np.concatenate([left, right]))
    if len(left) <= 2 * len(ids):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], float)
    # Many pairs of few texts: one product of their 0/1 shingle rows, some columns at a time.
    flat = np.concatenate([sets[i] for i in ids])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), [len(sets[i]) for i in ids])
    shared = times[column] > 1
    renumber = np.cumsum(times > 1) - 1
    row, column = row[shared], renumber[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(ids), len(ids)), np.float64)
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, [a, a + width])
        m = np.zeros((len(ids), width), np.float32)
        m[row[x:y], column[x:y] - a] = 1
        both += m @ m.T
    return both[np.searchsorted(ids, left), np.searchsorted(ids, right)]


def reached(size, shared, left, right, threshold) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets of some sizes that share enough."""
    ok = shared >= threshold * (size[left] + size[right] - shared) - 1e-9
    return left[ok], right[ok]


def verify(sig, sets, left, right, need, threshold):
    """Pairs (left[i], right[i]) that reach the threshold."""
    left, right = pruned(sig, left, right, need)
    if not len(left):
        return left, right
    return reached(np.array([len(s) for s in sets]), in_common(sets, left, right), left, right, threshold)


def whole_groups(batches, names: tuple[str, ...], least: int = 512):
    """Lists of slices of sorted batches that hold whole groups, a few hundred rows at a time."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in names])
        at = 0
        for cut in [*(np.flatnonzero(np.any(np.diff(keys) != 0, axis=0)) + 1), batch.num_rows]:
            new = held and tuple(held[-1].column(c)[-1].as_py() for c in names) != tuple(int(k) for k in keys[:, at])
            if new and size >= least:
                yield held
                held, size = [], 0
            held.append(batch.slice(at, cut - at))
            size += cut - at
            at = cut
    if held:
        yield held


def _sketched(threshold: float, tolerance: float):
    """Kernel over rows sorted by (band, low, high): edges of classes that may be near."""
    need = least_matches(threshold + (1 - threshold) / 256, tolerance)  # low bytes agree by chance too
    names = ("band", "low", "high")

    def run(batches):
        for held in whole_groups(batches, names, 4096):
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            col = {c: table.column(c).to_numpy() for c in (*names, "doc", "block")}
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
            edges = [0, *(np.flatnonzero(np.any([np.diff(col[c]) != 0 for c in names], axis=0)) + 1), table.num_rows]
            out = []
            for a, b in zip(edges, edges[1:]):
                low, high = col["low"][a], col["high"][a]
                block = col["block"][a:b]
                sides = None if low == high else (np.flatnonzero(block == low), np.flatnonzero(block == high))
                out += [(int(col["doc"][a + i]), int(col["doc"][a + j])) for i, j in joined_by_sketch(sketch[a:b], sides, need)]
            u, v = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def dealt(rows: DataFrame, group: str, sizes: DataFrame, block: int) -> DataFrame:
    """Rows (group, doc, ...) with (low, high, block): each in every pair of blocks of its group
    that its own block is part of."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.join(sizes.select(group, blocks.alias("blocks")), group).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other)
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    return rows


def pairs_of(blocks: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs in a block, or between two."""
    if low == high:
        return np.triu_indices(len(blocks), 1)
    a, b = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def linked(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, int]]:
    """(id, links, least id that links lead to) of the rows with a link."""
    n = len(ids)
    if not len(left):
        return []
    links = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
    order = np.argsort(ids)  # the least id leads
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    lead = rank.copy()
    while True:  # least label over links until nothing changes
        new = lead.copy()
        np.minimum.at(new, left, lead[right])
        np.minimum.at(new, right, lead[left])
        new = np.minimum(new, new[order[new]])
        if (new == lead).all():
            break
        lead = new
    root = ids[order[lead]]
    return [(int(ids[i]), int(links[i]), int(root[i])) for i in np.flatnonzero(links)]


def groups_of(batch: pa.RecordBatch, names: tuple[str, ...]):
    """Bounds of the groups of rows sorted by some columns."""
    col = [batch.column(c).to_numpy() for c in names]
    cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in col], axis=0)) + 1
    edges = [0, *cut.tolist(), batch.num_rows]
    return zip(edges, edges[1:])


COMPARED = "doc BIGINT, links BIGINT, lead BIGINT, root BIGINT, block INT, sketch BINARY, size INT, base INT, lacks INT, differs BINARY"


def _compared(threshold: float, tolerance: float):
    """Kernel over rows sorted by (root, block), of which the first of a component of several
    blocks is the component's first text: links of components of one block, and of others a row
    for each text with the differences of its shingles from that text's."""
    need = least_matches(threshold, tolerance)
    schema = to_arrow_schema(StructType.fromDDL(COMPARED))

    def flush(held):
        out = []
        for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
            sigs, sets = [], []
            for part, buf, off in pieces(batch, "text", CHUNK_BYTES):
                sh, first = shingles(Words(buf, off), K)
                sigs.append(signatures(sh, first))
                sets += [np.unique(sh[a:b]) for a, b in zip(first, first[1:])]
            sig = np.concatenate(sigs)
            col = {c: batch.column(c).to_numpy() for c in ("root", "block", "blocks", "doc", "copy")}
            for a, b in groups_of(batch, ("root", "block")):
                if col["blocks"][a] == 1:
                    left, right = verify(sig[a:b], sets[a:b], *pairs_of(col["block"][a:b], 0, 0), need, threshold)
                    out += [(*x, None, None, None, None, None, None, None) for x in linked(col["doc"][a:b], left, right)]
                    continue
                base = sets[a]
                for i in range(a + 1, b):  # the first row is the copy of the component's first text
                    differs = np.setxor1d(base, sets[i], assume_unique=True)
                    lacks = len(base) - (len(base) + len(sets[i]) - len(differs)) // 2
                    out.append((int(col["doc"][i]), None, None, int(col["root"][i]), int(col["block"][i]), sig[i].astype(np.uint8).tobytes(), len(sets[i]), len(base), lacks, differs.tobytes()))
        columns = list(zip(*out)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        for held in whole_groups(batches, ("root", "block"), BLOCK):
            yield flush(held)

    return run


def _joined(threshold: float, tolerance: float):
    """Kernel over differences sorted by (root, low, high): link counts and star edges of links."""
    need = least_matches(threshold + (1 - threshold) / 256, tolerance)  # low bytes agree by chance too

    def flush(held):
        out = []
        for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("differs").to_pylist()]
            col = {c: batch.column(c).to_numpy() for c in ("low", "high", "doc", "block", "size", "base", "lacks")}
            for a, b in groups_of(batch, ("root", "low", "high")):
                left, right = pruned(sketch[a:b], *pairs_of(col["block"][a:b], col["low"][a], col["high"][a]), need)
                if len(left):
                    lacks = col["lacks"][a:b]
                    shared = col["base"][a] - lacks[left] - lacks[right] + in_common(sets[a:b], left, right)
                    left, right = reached(col["size"][a:b], shared, left, right, threshold)
                out += linked(col["doc"][a:b], left, right)
        docs, links, lead = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(links, pa.int64()), pa.array(lead, pa.int64())], names=["doc", "links", "lead"])

    def run(batches):
        for held in whole_groups(batches, ("root", "low", "high")):
            yield flush(held)

    return run


def in_blocks(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """(root, block, blocks, copy, doc): each class in its block of its component; of a component
    of several blocks the first class is in every block once more, as a ``copy``, so a text is
    dealt once, but for one a block."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = labelled.join(sizes.select("root", blocks.alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.select("root", "block", "blocks", F.lit(0).alias("copy"), "doc")
    firsts = sizes.select("root", blocks.alias("blocks")).where("blocks > 1")
    return rows.unionByName(firsts.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", F.lit(1).alias("copy"), F.col("root").alias("doc")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Per document: ``class_id`` (least id of its near-duplicate group), ``text_class``
    (least id with an equal text) and ``n_links`` (other text classes at the threshold)."""
    same = F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))
    hashed = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("same", same)
    found = written(map_pieces(hashed, "text", ["id", "same"], "bands ARRAY<BIGINT>, sketch BINARY", _bands), "bands")
    # A class is one row with a number of its own; numbers are written, so they stay.
    leads = found.groupBy("same").agg(F.min("id").alias("rep"), F.max(F.struct("bands", "sketch")).alias("s"))
    leads = written(leads.select("same", "rep", "s.*").withColumn("doc", F.monotonically_increasing_id()), "leads")

    banded = leads.select("doc", F.explode("bands").alias("band"))
    buckets = written(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    paired = dealt(banded, "band", buckets, SKETCHES).join(leads.select("doc", "sketch"), "doc")
    paired = paired.select("band", "low", "high", "doc", "block", "sketch").repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "doc")
    edges = in_batches(paired, _sketched(threshold, tolerance), "u BIGINT, v BIGINT")
    candidates = components(edges)
    labelled = candidates.select(F.col("u").alias("doc"), F.col("v").alias("root"))
    labelled = written(labelled.union(labelled.select(F.col("root").alias("doc"), "root").distinct()), "candidates")
    sizes = written(labelled.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    placed = in_blocks(labelled, sizes)
    # One text of each class: repeats are dropped before texts are copied to blocks.
    wanted = small_side(leads.join(labelled.select("doc").distinct(), "doc").select("same", "rep", "doc"))
    texts = hashed.join(wanted, (hashed["same"] == wanted["same"]) & hashed["id"].eqNullSafe(wanted["rep"])).groupBy("doc").agg(F.first("text").alias("text"))
    texts = written(texts, "texts")
    rows = texts.join(small_side(placed), "doc").select("root", "block", "blocks", "copy", "doc", "text")
    rows = rows.repartition("root", "block").sortWithinPartitions("root", "block", F.desc("copy"), "doc")
    compared = written(in_batches(rows, _compared(threshold, tolerance), COMPARED), "compared")
    far = compared.where("root IS NOT NULL").select("root", "doc", "sketch", "size", "base", "lacks", "differs")
    far = dealt(far, "root", sizes.where(F.col("n") > BLOCK), BLOCK).select("root", "low", "high", "doc", "block", "sketch", "size", "base", "lacks", "differs")
    far = far.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "doc")
    more = in_batches(far, _joined(threshold, tolerance), "doc BIGINT, links BIGINT, lead BIGINT")
    links = written(compared.where("links IS NOT NULL").select("doc", "links", "lead").unionByName(more), "links")

    counts = written(links.groupBy("doc").agg(F.sum("links").alias("n_links")), "counts")
    groups = components(links.where("doc <> lead").select(F.col("doc").alias("u"), F.col("lead").alias("v")))
    linked = leads.select("same", "rep", "doc").join(groups.select(F.col("u").alias("doc"), F.col("v").alias("group")), "doc", "left").join(counts, "doc", "left")
    linked = linked.withColumn("group", F.coalesce("group", "doc"))
    # Groups of one class name themselves; those of more take the least id of all.
    least = written(linked.where("n_links IS NOT NULL").groupBy("group").agg(F.min("rep").alias("least")), "least")
    linked = linked.join(small_side(least), "group", "left")
    linked = written(linked.select("same", "rep", F.coalesce("least", "rep").alias("class"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "classes")
    out = found.select("id", "same").join(linked, "same")
    return out.select(F.col("id").alias(key), F.col("class").alias("class_id"), F.col("rep").alias("text_class"), "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each near-duplicate group, the one with the least id, with all its
    columns. Rows without an id are compared too, and stay only where no other row of the group
    has one; rows with equal ids go by their texts."""
    docs, number = numbered(docs)
    found = near_duplicates(docs, number, text).select(F.col(number).alias("number"), "class_id")
    found = written(found.join(docs.select(F.col(number).alias("number"), F.col(key).alias("id")), "number"), "classes")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "number")
    groups = found.groupBy("class_id").agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = small_side(groups.select("class_id", F.col("first.number").alias("lead")))
    extra = found.join(groups, "class_id").where(F.col("number") != F.col("lead"))
    return without(docs, extra.select("number"), number).drop(number)
