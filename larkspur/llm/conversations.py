"""Conversation structure repair by signature deduplication.

Each turn of a conversation has at most one fault (blank, duplicate or truncated), and edits
give the conversation a role order of ``(s?(ua)+)?``: Keep costs 0, Rerole (to user or
assistant) 2, Delete 3 (the only edit of a blank or duplicate turn), Insert (an empty user or
assistant turn) 2, and a truncated turn that stays adds 1. The repair is the cheapest edits;
of equally cheap ones that whose initials are least in ASCII order.

1. Turns are reduced to a symbol: the role's initial, in capitals where truncated, or ``x`` where
   blank or duplicate. A range partitioning puts narrow rows (no text) in order, so a
   conversation of any size is spread over tasks; repeated turns are found by an aggregation.
   The symbols of a conversation, in order, are its signature: one byte a turn.
2. Each different signature is solved once. Memoised recursion over its suffixes gives the
   cost still to come from each state of the role order, and a walk forward takes the first
   edit in ASCII order that keeps to it. Audits are joined back by signature.
3. Edits are replayed on the texts, which are shuffled once, by conversation, behind their edits:
   a task reads them as a stream and holds one conversation's edits, never its texts.

The audit and the SHA-256 of the repaired text are single values of a conversation by their
definition, so one task passes over the turns of a conversation in step 3, however many there
are; all else is split.

Defined results: a null role or text is one space, as is a null in the damage key. Turns of
equal number are in order of role, then of the SHA-256 of the text; null turns come first. Roles
whose initial is not s, u or a are rerouted or deleted. A null conversation id is a conversation
too. Conversations without a turn left have zeros, an empty audit and the hash of an empty text;
gaps are null where they exceed 64 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import in_batches, small_side, written

DAMAGE = 20  # kinds of damage are remainders by this
PIECE = 4096  # turns of a conversation that are gathered at a time
CHUNK = 64  # depth of the recursion
BLANKS = " \t\n\x0b\x0c\r"

# States of the role order: nothing yet, after s, after u, after a. Each has the letter that may
# be put next, and the state that it leads to.
EXPECTED = "uuau"
AFTER = (2, 2, 3, 2)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 30


def _closed(v: list[int]) -> tuple[int, ...]:
    """Costs with insertions, of which two in a row lead from any state to any later one."""
    for _ in range(2):
        v = [min(x, INSERT + v[AFTER[q]]) for q, x in enumerate(v)]
    return tuple(v)


END = _closed([0, FAR, FAR, 0])


@lru_cache(1 << 16)
def costs(symbols: str, behind: tuple[int, ...]) -> tuple[int, ...]:
    """The least cost from each state through ``symbols``, given the costs behind them."""
    if not symbols:
        return behind
    rest = costs(symbols[1:], behind)
    symbol, extra = symbols[0].lower(), TRUNCATED * symbols[0].isupper()
    out = []
    for q in range(4):
        best = DELETE + rest[q]
        if symbol != "x":
            best = min(best, REROLE + extra + rest[AFTER[q]])
            if (q, symbol) in KEPT:
                best = min(best, KEEP + extra + rest[KEPT[q, symbol]])
        out.append(best)
    return _closed(out)


def solve(signature: str) -> tuple[int, str, str]:
    """(cost, audit, edits). Edits say more than the audit: k keeps a turn, x deletes it, u and a
    are its new role, U and A are insertions."""
    chunks = [signature[i : i + CHUNK] for i in range(0, len(signature), CHUNK)]
    behind, total = [END], 0
    for chunk in reversed(chunks):
        v = costs(chunk, behind[-1])
        total += min(v)
        behind.append(tuple(x - min(v) for x in v))
    q, audit, edits = 0, [], []

    def insert():
        nonlocal q
        audit.append("I")
        edits.append(EXPECTED[q].upper())
        q = AFTER[q]

    for i, chunk in enumerate(chunks):
        after = behind[len(chunks) - 1 - i]
        for j, symbol in enumerate(chunk):
            here, rest = costs(chunk[j:], after), costs(chunk[j + 1 :], after)
            extra, kept = TRUNCATED * symbol.isupper(), KEPT.get((q, symbol.lower()))
            while DELETE + rest[q] != here[q] and INSERT + here[AFTER[q]] == here[q]:
                insert()
                kept = KEPT.get((q, symbol.lower()))
            if DELETE + rest[q] == here[q]:
                audit.append("D")
                edits.append("x")
            elif kept is not None and KEEP + extra + rest[kept] == here[q]:
                audit.append("K")
                edits.append("k")
                q = kept
            else:
                audit.append("R")
                edits.append(EXPECTED[q])
                q = AFTER[q]
    while END[q]:
        insert()
    return total + behind[-1][0], "".join(audit), "".join(edits)


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of conv_id, turn, role and text with the damage that their key's CRC-32 deals."""
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % DAMAGE
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copies")


def conversation_key() -> Column:
    """The id as a text that is never null."""
    return F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def symbols(rows: DataFrame) -> DataFrame:
    """Narrow rows: conv, turn, role, text's digest, initial, whether blank and truncated."""
    bare = F.btrim("text", F.lit(BLANKS))
    first = F.substring("role", 1, 1)
    return rows.select(
        conversation_key().alias("conv"),
        "turn",
        "role",
        digest().alias("digest"),
        F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o")).alias("initial"),
        (bare == "").alias("blank"),
        ((bare != "") & ~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )


def placed(narrow: DataFrame) -> DataFrame:
    """The rows in order, over as many tasks as there are: ``at`` rises along the order, and
    ``head`` is that of the first of the (at most PIECE) turns that are gathered together."""
    order = ["conv", "turn", "role", "digest"]
    # Rows equal in all of these are split by their place in the input.
    rows = narrow.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt").sortWithinPartitions(*order)

    def run(batches):
        at = TaskContext.get().partitionId() << 33
        last, n, head = None, 0, at
        for batch in batches:
            conv = batch.column("conv")
            if not len(conv):
                continue
            new = np.ones(len(conv), bool)
            new[0] = conv[0].as_py() != last
            new[1:] = pc.not_equal(conv[1:], conv[:-1]).to_numpy(zero_copy_only=False)
            last = conv[-1].as_py()
            index = np.arange(len(conv))
            starts = np.where(new, index, -1)
            start = np.maximum.accumulate(starts)  # -1: goes on from the batch before
            place = np.where(start < 0, n + index, index - start)
            begins = place % PIECE == 0
            heads = np.maximum.accumulate(np.where(begins, at + index, -1))
            heads[heads < 0] = head
            n, head = int(place[-1]) + 1, int(heads[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEPT_COLUMNS), pa.array(at + index, pa.int64()), pa.array(heads, pa.int64())], names=[*KEPT_COLUMNS, "at", "head"])
            at += len(conv)

    return in_batches(rows.select(*KEPT_COLUMNS), run, "conv STRING, turn BIGINT, role STRING, digest BINARY, initial STRING, blank BOOLEAN, truncated BOOLEAN, at BIGINT, head BIGINT")


KEPT_COLUMNS = ["conv", "turn", "role", "digest", "initial", "blank", "truncated"]


def faulty(rows: DataFrame) -> DataFrame:
    """Adds ``duplicate``: not blank, and role and text seen earlier. Only keys that occur more
    than once are joined back."""
    key = ["conv", "role", "digest"]
    again = rows.where("NOT blank").groupBy(*key).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(small_side(again), key, "left").withColumn("duplicate", ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))).drop("first")


def signatures(rows: DataFrame) -> DataFrame:
    """A row for each conversation: signature, role initials, and how many turns have each
    fault. Turns are gathered by pieces, and then only the pieces' strings."""
    symbol = F.when(F.col("blank") | F.col("duplicate"), F.lit("x")).when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))
    turns = F.array_sort(F.collect_list(F.struct("at", symbol.alias("s"), F.col("initial").alias("i"))))
    faults = {"blank": F.col("blank"), "duplicate": F.col("duplicate"), "truncated": F.col("truncated") & ~F.col("duplicate")}
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "")
    pieces = rows.groupBy("conv", "head").agg(turns.alias("t"), *[F.count_if(c).alias(k) for k, c in faults.items()])
    pieces = pieces.select("conv", "head", joined("t", "s").alias("s"), joined("t", "i").alias("i"), *faults)
    whole = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("head", "s", "i"))).alias("p"), *[F.sum(k).alias(k) for k in faults])
    return whole.select("conv", joined("p", "s").alias("signature"), joined("p", "i").alias("initials"), *faults)


def solved(signatures: DataFrame) -> DataFrame:
    """Each different signature once: signature, cost, audit, edits."""

    def run(batches):
        for batch in batches:
            names = batch.column("signature").to_pylist()
            cost, audit, edits = zip(*map(solve, names)) if names else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(edits, pa.string())], names=["signature", "cost", "audit", "edits"])

    return signatures.select("signature").distinct().mapInArrow(run, "signature STRING, cost BIGINT, audit STRING, edits STRING")


class Replay:
    """The hash of one conversation's repaired turns, fed in order."""

    def __init__(self, edits: str):
        self.edits, self.i, self.hash, self.lines = edits, 0, hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "replace"))
        self.lines += 1

    def inserted(self) -> None:
        while self.i < len(self.edits) and self.edits[self.i] in "UA":
            self.line("user" if self.edits[self.i] == "U" else "assistant", "")
            self.i += 1

    def turn(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.edits[self.i]
        self.i += 1
        if edit != "x":
            self.line({"k": role, "u": "user", "a": "assistant"}[edit], text)

    def done(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def replayed(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """conv, repaired_sha256. Texts are shuffled here, once, each conversation's edits ahead."""
    texts = rows.select(conversation_key().alias("conv"), F.lit(1).alias("kind"), "turn", "role", digest().alias("digest"), "text")
    edits = repaired.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("edits").alias("text"))
    stream = texts.unionByName(edits).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest")

    def run(batches):
        conv, replay = None, None
        for batch in batches:
            names, made = [], []
            for c, kind, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "kind", "role", "text"))):
                if not kind:
                    if replay:
                        names.append(conv)
                        made.append(replay.done())
                    conv, replay = c, Replay(text)
                else:
                    replay.turn(role, text)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(made, pa.string())], names=["conv", "repaired_sha256"])
        if replay:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([replay.done()], pa.string())], names=["conv", "repaired_sha256"])

    return in_batches(stream.select("conv", "kind", "role", "text"), run, "conv STRING, repaired_sha256 STRING")


def repair(turns: DataFrame) -> DataFrame:
    """For each conversation among (conv_id, turn, role, text) rows, as they are: conv, gaps, the
    counts of faults, illegal, cost, audit and repaired_sha256."""
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    narrow = written(placed(symbols(rows)), "turns")
    whole = written(signatures(faulty(narrow)), "signatures")
    repaired = whole.join(small_side(solved(whole)), "signature")
    numbers = narrow.groupBy("conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("n"))
    gaps = numbers.select("conv", F.when(F.col("n") == 0, F.lit(0).cast("bigint")).otherwise(F.expr("try_add(try_subtract(high, low), 1 - n)")).alias("gaps"))
    n = F.length("initials")
    illegal = F.greatest(n - 1, F.lit(0)) - F.regexp_count("initials", F.lit("s(?=u)|u(?=a)|a(?=u)"))
    out = repaired.join(gaps, "conv").join(replayed(rows, repaired), "conv")
    return out.select("conv", "gaps", "blank", "duplicate", "truncated", illegal.cast("bigint").alias("illegal"), "cost", "audit", "repaired_sha256")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The columns of op12, for every original conversation."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    all_ = turns.select("conv_id").distinct().withColumn("conv", conversation_key())
    out = all_.join(repair(damaged(turns)), "conv", "left")
    zero = lambda c: F.when(F.col("audit").isNull(), F.lit(0).cast("bigint")).otherwise(F.col(c)).alias(c)
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
