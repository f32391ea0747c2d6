"""The model-call surface: a client protocol, batched calls from tasks, and a replay client."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free
from ..sources.shared import written

REPLY = "reply STRING, error STRING, attempts INT, elapsed_s DOUBLE"


class ModelClient(Protocol):
    """What the stages need of a model. Implementations must be picklable before first use."""

    def chat(self, messages: list[dict], temperature: float = 0.7, max_tokens: int = 1024, json_mode: bool = False, call_type: str = "") -> str: ...


@dataclass(frozen=True)
class Retry:
    """Tries of a call, and the pause after each failure."""

    tries: int = 3
    linear: float = 2.0  # seconds times the attempt
    exponential: float | None = None  # start of a doubling pause instead
    ceiling: float = 30.0
    strip_think: bool = False  # replies lose their thinking blocks, and blanks around what is left

    def pause(self, attempt: int) -> float:
        if self.exponential is None:
            return self.linear * attempt
        return min(self.ceiling, self.exponential * 2 ** (attempt - 1))


GENERATION = Retry()
EVALUATION = Retry(tries=6, exponential=1.0, strip_think=True)


def without_thoughts(reply: str) -> str:
    """``functions.text.strip_think`` for a reply that a task holds."""
    return re.sub(r"(?s)<think>.*?</think>", "", reply).replace("</think>", "").strip()


def call(client: ModelClient, retry: Retry, sleep: Callable = time.sleep, **request) -> tuple[str | None, str | None, int, float]:
    """(reply, error, attempts, seconds) of a call with retries."""
    began, error = time.monotonic(), None
    for attempt in range(1, retry.tries + 1):
        try:
            reply = client.chat(**request)
            reply = without_thoughts(reply) if retry.strip_think and reply is not None else reply
            return reply, None, attempt, round(time.monotonic() - began, 2)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if attempt < retry.tries:
                sleep(retry.pause(attempt))
    return None, error, retry.tries, round(time.monotonic() - began, 2)


@dataclass
class Replay:
    """Scripted replies, a queue for each kind of call; an empty queue is an error."""

    script: dict[str, list[str]]
    calls: list = field(default_factory=list)

    def __post_init__(self):
        self.queues = {k: deque(v) for k, v in self.script.items()}

    def chat(self, messages, temperature=0.7, max_tokens=1024, json_mode=False, call_type=""):
        self.calls.append((call_type, messages, temperature))
        queue = self.queues.get(call_type)
        if not queue:
            raise LookupError(f"no reply left for {call_type!r}")
        return queue.popleft()


def in_flight(rows: DataFrame, concurrency: int | None, threads: int) -> tuple[DataFrame, int]:
    """The rows in so few partitions, and threads of each, that no more than ``concurrency``
    calls run at once on the whole cluster, however many cores it has."""
    if concurrency is None:
        return rows, threads
    threads = max(1, min(threads, concurrency))
    return rows.repartition(max(1, concurrency // threads)), threads


def ask(rows: DataFrame, make_client: Callable[[], ModelClient], prompt: str = "messages", call_type: str = "", temperature: float = 0.7, max_tokens: int = 1024, retry: Retry = GENERATION, threads: int = 8, on_error: str = "store", concurrency: int | None = None) -> DataFrame:
    """A model call for each row, from a thread pool in each task: adds reply, error, attempts
    and elapsed_s. ``concurrency`` bounds the calls in flight on the whole cluster. ``prompt`` is an array of messages. Rows keep their other columns, so the
    order of replies does not matter. Filter before this stage, never by a condition around
    it, and write its result before using it twice: a plan that runs again calls again
    (``ask_once`` does not).
    """
    rows, threads = in_flight(rows, concurrency, threads)

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        client = make_client()

        def one(messages):
            request = [{"role": m["role"], "content": m["content"]} for m in messages]
            return call(client, retry, messages=request, temperature=temperature, max_tokens=max_tokens, call_type=call_type)

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                got = list(pool.map(one, batch[prompt]))
                out = batch.copy()
                for i, name in enumerate(("reply", "error", "attempts", "elapsed_s")):
                    out[name] = [g[i] for g in got]
                if on_error == "raise" and (bad := [g[1] for g in got if g[1]]):
                    raise RuntimeError(bad[0])
                yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, {REPLY}")


def request_key(prompt: str, call_type: str, temperature: float, max_tokens: int, model: str) -> Column:
    """Digest of a request and its settings: equal requests are one call."""
    settings = json.dumps([model, call_type, temperature, max_tokens])
    return F.sha2(F.concat(F.lit(settings + "\n"), F.to_json(F.transform(prompt, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))).cast("binary"), 256)


class Pending:
    """Replies of calls that no table holds yet: one file each, on any file system that all
    executors see, written as soon as the reply is there. A task that runs again, in this
    application or a later one, finds what its earlier attempts got."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.kind = fs.FileType
        self.fs.create_dir(self.root, recursive=True)

    def get(self, key: str) -> dict | None:
        place = f"{self.root}/{key}.json"
        if self.fs.get_file_info(place).type == self.kind.NotFound:
            return None
        with self.fs.open_input_stream(place) as f:
            return json.loads(f.read())

    def put(self, key: str, value: dict) -> None:
        place = f"{self.root}/{key}-{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(place) as f:
            f.write(json.dumps(value).encode())
        self.fs.move(place, f"{self.root}/{key}.json")


def ask_once(rows: DataFrame, make_client: Callable[[], ModelClient], ledger: str, prompt: str = "messages", call_type: str = "", temperature: float = 0.7, max_tokens: int = 1024, model: str = "", retry: Retry = GENERATION, threads: int = 8, concurrency: int | None = None) -> DataFrame:
    """``ask`` with a ledger: a table of replies by request, in the folder ``ledger``.

    Each different request is called once, whatever runs again. Requests that the ledger has are
    joined, the others are called; each reply is put into a pending file at once, so a task that
    is killed does not repeat the calls of its first attempt; then all are appended to the table
    and the pending files go. A call whose task dies between the reply and its file is repeated,
    and so are calls that failed. One run at a time may use a ledger; speculation must be off.
    """
    spark = rows.sparkSession
    [name] = free(rows, "_key")
    keyed = rows.withColumn(name, request_key(prompt, call_type, temperature, max_tokens, model))
    table, waiting = f"{ledger.rstrip('/')}/replies", f"{ledger.rstrip('/')}/pending"
    held = f"key STRING, {REPLY}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = lambda: spark.read.schema(held).parquet(table) if files.exists(path(table)) else spark.createDataFrame([], held)
    one = keyed.groupBy(F.col(name).alias("key")).agg(F.first(prompt).alias("messages"))
    todo, n = in_flight(one.join(known().select("key"), "key", "left_anti"), concurrency, threads)

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        pending, client = Pending(waiting), make_client()

        def answer(key, messages):
            if got := pending.get(key):
                return got
            request = [{"role": m["role"], "content": m["content"]} for m in messages]
            made = dict(zip(("reply", "error", "attempts", "elapsed_s"), call(client, retry, messages=request, temperature=temperature, max_tokens=max_tokens, call_type=call_type)))
            if made["error"] is None:
                pending.put(key, made)
            return made

        with ThreadPoolExecutor(n) as pool:
            for batch in batches:
                got = list(pool.map(answer, batch["key"], batch["messages"]))
                yield pd.DataFrame({"key": batch["key"], **{c: [g[c] for g in got] for c in ("reply", "error", "attempts", "elapsed_s")}})

    made = written(todo.mapInPandas(run, held), "calls")
    made.where("error IS NULL").write.mode("append").parquet(table)
    files.delete(path(waiting), True)
    # Failed requests are of this run only. The replies are written to a place of their own: a plan
    # that holds two reads of the growing table could take one for the other.
    told = known().join(one.select("key"), "key", "left_semi").join(made.select("key"), "key", "left_anti").dropDuplicates(["key"])
    replies = written(told.unionByName(made), "replies").withColumnRenamed("key", "_reply_to")
    return keyed.join(replies, keyed[name] == replies["_reply_to"], "left").drop(name, "_reply_to")


def usage(calls: DataFrame, tokens) -> DataFrame:
    """Calls, tokens and failures by kind, from a call log."""
    return calls.groupBy("call_type").agg(F.count("*").alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.count("error").alias("failed"))


def by_kind(replies: Iterable[tuple[str, str]]) -> Replay:
    """A replay client from (call type, reply) rows in order."""
    script = defaultdict(list)
    for kind, text in replies:
        script[kind].append(text)
    return Replay(dict(script))
