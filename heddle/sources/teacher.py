"""Replies of a teacher model to a column of prompts, by a client that the caller supplies."""

from __future__ import annotations

import hashlib
import json
import random
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.sources.files import exists

# The system prompt, and sampling settings of a request.
SYSTEM = "You are a code synthesis assistant."
SETTINGS = {"temperature": 0.7, "max_tokens": 2048}


class Busy(Exception):
    """The teacher cannot answer now; asking again may help."""


def http_client(base: str, model: str, key: str = "", timeout: float = 60) -> Callable[[str, str], str]:
    """A client of a chat-completions service: (prompt, system prompt) to a reply, :class:`Busy` where the service is."""

    def ask(prompt: str, system: str) -> str:
        messages = [{"role": role, "content": content} for role, content in (("system", system), ("user", prompt))]
        body = json.dumps({"model": model, "messages": messages, **SETTINGS}).encode()
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{base.rstrip('/')}/chat/completions", body, headers), timeout=timeout) as reply:
                choices = json.load(reply).get("choices") or [{}]
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise Busy(f"HTTP {e.code}") from e
            raise RuntimeError(f"HTTP {e.code}: {e.read().decode('utf-8', 'replace')}") from e
        except (urllib.error.URLError, TimeoutError) as e:
            raise Busy(str(e)) from e
        return choices[0].get("message", {}).get("content") or ""

    return ask


def patiently(ask: Callable[[str, str], str], prompt: str, system: str, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> str:
    """``ask`` again while the teacher is busy, after twice the time each time and a little more; other errors pass."""
    for attempt in range(1, attempts + 1):
        try:
            return ask(prompt, system)
        except Busy:
            sleep(2**attempt + random.uniform(0.5, 2.0))
    raise TimeoutError(f"no reply after {attempts} attempts")


class Log:
    """Replies by prompt, one line of JSON each, written as they come: a task that runs again finds those it had.

    A task appends to a file of its own attempt, named by its partition, and begins with what earlier attempts of its partition
    have left. ``folder`` is one that all executors share.
    """

    def __init__(self, folder: str, system: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.system, self.known = system, {}
        context = TaskContext.get()
        self.part, self.attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        self.out = None
        self.store.create_dir(self.folder, recursive=True)
        for found in self.store.get_file_info(fs.FileSelector(self.folder)):
            if found.base_name.startswith(f"part-{self.part}-"):
                with self.store.open_input_file(found.path) as f:
                    for line in f.read().decode("utf-8", "replace").splitlines():
                        try:
                            entry = json.loads(line)
                        except ValueError:  # a line that was cut off: its prompt is asked again
                            continue
                        self.known[entry["key"]] = entry["reply"]

    def key(self, prompt: str) -> str:
        return key_of(self.system, prompt)

    def reply(self, prompt: str, ask: Callable[[str], str]) -> str:
        key = self.key(prompt)
        if key not in self.known:
            self.known[key] = ask(prompt)
            if self.out is None:
                self.out = self.store.open_output_stream(f"{self.folder}/part-{self.part}-{self.attempt}.jsonl")
            self.out.write((json.dumps({"key": key, "reply": self.known[key]}) + "\n").encode())
            self.out.flush()
        return self.known[key]

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def key_of(system: str, prompt: str) -> str:
    return hashlib.sha256(f"{system}\0{prompt}".encode("utf-8", "surrogatepass")).hexdigest()


def replies(df: DataFrame, prompt: str, ask: Callable[[str, str], str], *, reply: str = "reply", system: str = SYSTEM, attempts: int = 5, log: str | None = None) -> DataFrame:
    """``df`` with the teacher's reply to each prompt; a null prompt gets none. Write the result before using it twice.

    With ``log``, a shared folder, replies are kept as they come: earlier runs' replies are joined by prompt and not asked for
    again, and a task that is lost half way asks for the rest only. Equal prompts of a task then share one reply.
    """
    kept = df.select(*[F.col(c) for c in df.columns if c != reply])
    schema = T.StructType([*kept.schema, T.StructField(reply, T.StringType())])
    if log is None:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                frame[reply] = [None if p is None else patiently(ask, p, system, attempts) for p in frame[prompt]]
                yield frame

        return kept.mapInPandas(run, schema)

    spark = df.sparkSession
    this_run = f"{log.rstrip('/')}/run-{uuid.uuid4().hex}"
    known = None
    if exists(spark, f"{log.rstrip('/')}/run-*/*.jsonl"):
        lines = spark.read.schema("key string, reply string").json(f"{log.rstrip('/')}/run-*/*.jsonl")
        known = lines.where("key is not null").groupBy("key").agg(F.min("reply").alias("_known"))
    keyed = kept.withColumn("_key", F.sha2(F.concat(F.lit(system + "\0"), F.col(prompt)), 256))
    both = keyed.withColumn("_known", F.lit(None).cast("string")) if known is None else keyed.join(known, F.col("_key") == F.col("key"), "left").drop("key")

    def run_logged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Log(this_run, system)
        try:
            for frame in frames:
                asked = lambda p: patiently(ask, p, system, attempts)
                frame[reply] = [None if p is None else k if k is not None else own.reply(p, asked) for p, k in zip(frame[prompt], frame["_known"], strict=True)]
                yield frame.drop(columns=["_key", "_known"])
        finally:
            own.close()

    return both.mapInPandas(run_logged, schema)
