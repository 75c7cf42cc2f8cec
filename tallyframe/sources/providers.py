"""Where decisions come from: saved tables, or a caller's function run once for each batch and written down.

A live provider costs money, so a plan must never call it: ``recorded`` runs it with bounded concurrency, retries
inside the call, logs each answer as it comes and writes them; everything after reads the table.
"""

from __future__ import annotations

import base64
import logging
import math
import os
import pickle
import random
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mounted, send_package

# Limits of the retry policy.
IN_FLIGHT = 8
ATTEMPTS = 5
FIRST_WAIT, LONGEST_WAIT, LONGEST_ASKED_WAIT, JITTER = 1.0, 4.0, 60.0, 0.5


class Retryable(Exception):
    """A provider's failure that may pass; ``after`` is the wait it asks for, in seconds."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


def log_step(kind: str, message: str) -> None:
    """A log line for each step of a provider's call."""
    logging.getLogger("tallyframe.providers").info("%s: %s", kind, message)


def with_retries(call: Callable[[], object], sleep=time.sleep, draw=random.random, publish: Callable[[str, str], None] = log_step) -> object:
    """At most five attempts; asked waits are capped and jittered, others are full-jitter exponential.

    ``publish`` hears of every attempt, failure and answer.
    """
    for attempt in range(ATTEMPTS):
        try:
            publish("asked", f"attempt {attempt + 1}")
            found = call()
            publish("answered", f"attempt {attempt + 1}")
            return found
        except Retryable as failure:
            publish("failed", f"attempt {attempt + 1}: {failure}")
            if attempt + 1 == ATTEMPTS:
                raise
            if failure.after is not None:
                sleep(min(failure.after, LONGEST_ASKED_WAIT) + JITTER * draw())
            else:
                sleep(draw() * min(LONGEST_WAIT, FIRST_WAIT * 2**attempt))
    raise AssertionError("not reached")


class AnswerLog:
    """Answers of one bucket of questions, appended one by one to a file of its own for every attempt at a task.

    An answer counts once its whole line is there, so an attempt that dies midway leaves what it was given. Answers that are there
    at the same time are brought to the disk by one call.
    """

    def __init__(self, folder: str):
        self.folder, self._file, self._lock = folder, None, threading.Lock()
        self.known: dict[str, object] = {}
        for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
            with open(os.path.join(folder, name), "rb") as f:
                for line in f:
                    if line.endswith(b"\n"):
                        key, answer = line.split()
                        self.known[key.decode()] = pickle.loads(base64.b64decode(answer))

    def add(self, key: str, answer: object) -> None:
        self.add_all({key: answer})

    def add_all(self, answers: dict[str, object]) -> None:
        with self._lock:
            if self._file is None:
                os.makedirs(self.folder, exist_ok=True)
                self._file = open(os.path.join(self.folder, uuid.uuid4().hex), "ab")
            self._file.write(b"".join(key.encode() + b" " + base64.b64encode(pickle.dumps(answer)) + b"\n" for key, answer in answers.items()))
            self._file.flush()
            os.fsync(self._file.fileno())
            self.known.update(answers)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


def ask_all(questions: dict[str, tuple[dict, AnswerLog]], ask: Callable[[dict], object], pool: ThreadPoolExecutor, in_flight: int) -> None:
    """Asks every question and logs its answer; ``in_flight`` at most are asked and not yet logged.

    After a failure nothing more is asked; what is under way is logged before the failure is raised.
    """
    waiting, under_way, failure = iter(questions.items()), {}, None
    while True:
        if failure is None:
            under_way |= {pool.submit(ask, q): (k, held) for k, (q, held) in islice(waiting, in_flight - len(under_way))}
        if not under_way:
            break
        said: dict[AnswerLog, dict[str, object]] = {}
        for done in wait(under_way, return_when=FIRST_COMPLETED).done:
            k, held = under_way.pop(done)
            if done.exception() is None:
                said.setdefault(held, {})[k] = done.result()
            else:
                failure = failure or done.exception()
        for held, answers in said.items():
            held.add_all(answers)
    if failure is not None:
        raise failure


def _plain(df: DataFrame, name: str):
    """A column as JSON keeps it: the entries of a map in order."""
    return F.array_sort(F.map_entries(name)).alias(name) if isinstance(df.schema[name].dataType, T.MapType) else F.col(name)


def recorded(questions: DataFrame, answer: Callable[[dict], dict], schema: str, path: str, tasks: int = 1, in_flight: int = IN_FLIGHT, publish: Callable[[str, str], None] = log_step, log: str | None = None) -> DataFrame:
    """Answers of ``answer`` to each question, in ``schema``, written to ``path`` and read back.

    A ``Retryable`` failure is tried again inside the call; any other one ends the job, so nothing is written. Every answer is
    appended to ``log`` (a mounted folder, next to ``path`` if none is named) under its question's digest as soon as it is there:
    a task that is run again, after a lost executor or in another job, asks only what was not answered (but for the calls that
    were under way, ``in_flight`` at most). Equal questions are asked once.
    """
    spark = questions.sparkSession
    log = mounted(log or f"{path}-log")
    names = questions.columns
    key = F.sha2(F.to_json(F.struct(*(_plain(questions, c) for c in names))), 256)
    keyed = questions.withColumn("_key", key).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(tasks)).cast("int"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs: dict[int, AnswerLog] = {}
        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                asked = frame[names].to_dict("records")
                for b in frame["_bucket"].unique():
                    if b not in logs:
                        logs[b] = AnswerLog(f"{log}/{b}")
                held = [logs[b] for b in frame["_bucket"]]
                new = {k: (q, h) for k, q, h in zip(frame["_key"], asked, held) if k not in h.known}
                ask_all(new, lambda q: with_retries(lambda: answer(q), publish=publish), pool, in_flight)
                rows = [h.known[k] for k, h in zip(frame["_key"], held)]
                if rows:
                    yield pd.DataFrame(rows)
        for h in logs.values():
            h.close()

    send_package(spark)
    keyed.repartitionById(tasks, F.col("_bucket")).mapInPandas(run, schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _probability(value: object, of: str) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or not 0 <= value <= 1:
        raise ValueError(f"the probability of {of} is not in [0, 1]: {value}")
    return float(value)


def choose(questions: DataFrame, answer: Callable[[dict], dict], keys: list[str], path: str, **how) -> DataFrame:
    """Bounded choices: ``answer`` gives choice, confidence and probabilities by option; checked where it is called.

    questions: the keys and options (array of strings). Options without a probability and choices that are no option fail.
    """

    def one(q: dict) -> dict:
        said = answer(q)
        options = list(q["options"])
        probabilities = {k: _probability(p, k) for k, p in said["probabilities"].items()}
        if set(probabilities) != set(options) or said["choice"] not in probabilities:
            raise ValueError(f"the answer {said['choice']} with {sorted(probabilities)} does not fit the options {options}")
        return {k: q[k] for k in keys} | {"choice": said["choice"], "confidence": _probability(said["confidence"], "the choice"), "probabilities": probabilities}

    kinds = ", ".join(f"{k} {questions.schema[k].dataType.simpleString()}" for k in keys)
    return recorded(questions.select(*keys, "options"), one, f"{kinds}, choice string, confidence double, probabilities map<string,double>", path, **how)


def decide(batches: DataFrame, answer: Callable[[dict], dict], path: str, **how) -> DataFrame:
    """Yes or no decisions, all of a trial in one call: the ids that come back must be those that were asked.

    batches: trial_id, questions (map from id to text). Gives trial_id and probabilities by id.
    """

    def one(q: dict) -> dict:
        asked = dict(q["questions"])
        said = answer(q)
        if set(said) != set(asked):
            raise ValueError(f"asked for {sorted(asked)}, answered {sorted(said)}")
        return {"trial_id": q["trial_id"], "probabilities": {k: _probability(p, k) for k, p in said.items()}}

    kind = batches.schema["trial_id"].dataType.simpleString()
    return recorded(batches.select("trial_id", "questions"), one, f"trial_id {kind}, probabilities map<string,double>", path, **how)


def complete(prompts: DataFrame, answer: Callable[[dict], str], keys: list[str], path: str, **how) -> DataFrame:
    """Text completions: keys and prompt go in, keys and completion come out; anything but a text fails."""

    def one(q: dict) -> dict:
        said = answer(q)
        if not isinstance(said, str):
            raise ValueError(f"the completion is no text: {type(said).__name__}")
        return {k: q[k] for k in keys} | {"completion": said}

    kinds = ", ".join(f"{k} {prompts.schema[k].dataType.simpleString()}" for k in keys)
    return recorded(prompts.select(*keys, "prompt"), one, f"{kinds}, completion string", path, **how)


def choice_problems(decisions: DataFrame) -> DataFrame:
    """Choices that are not in their map, and probabilities that are not finite or not in [0, 1]."""
    p = F.map_values("probabilities")
    bad = F.exists(p, lambda x: x.isNull() | F.isnan(x) | ~x.between(0, 1)) | ~F.array_contains(F.map_keys("probabilities"), F.col("choice")) | F.col("choice").isNull()
    return decisions.filter(F.coalesce(bad, F.lit(True)))


def exploded_batch(batches: DataFrame) -> DataFrame:
    """One row a question from one row a trial (trial_id, probabilities by id)."""
    return batches.select("trial_id", F.explode("probabilities").alias("id", "probability"))


class Steps:
    """Model steps of a run, each written once; what passes is counted on the way, and each step gives one event."""

    def __init__(self, spark: SparkSession, publish: Callable[[str, str], None] = log_step):
        self.spark, self.publish, self.events = spark, publish, []

    def run(self, name: str, df: DataFrame, path: str, **counts) -> DataFrame:
        """Write ``df`` and read it back; ``counts`` are further aggregates, by name, that are taken in the same pass."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        self.publish("began", name)
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.cast("long").alias(k) for k, c in counts.items()))
        watched.write.mode("overwrite").parquet(path)
        found = seen.get
        self.events.append((len(self.events) + 1, name, found["rows"], {k: found[k] for k in counts}))
        self.publish("ended", f"{name}: {found['rows']} rows")
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self) -> DataFrame:
        """step (from 1), name, rows and counts of every step that ended."""
        return self.spark.createDataFrame(self.events, "step int, name string, rows long, counts map<string,long>")


class Resources:
    """Things that must be closed; closing again does nothing, and failures are raised together."""

    def __init__(self):
        self._held: list = []

    def add(self, resource):
        self._held.append(resource)
        return resource

    def close(self) -> None:
        held, self._held, failures = self._held[::-1], [], []
        for resource in held:
            try:
                resource.close()
            except Exception as failure:
                failures.append(failure)
        if failures:
            raise ExceptionGroup("resources did not close", failures)

    def __enter__(self) -> Resources:
        return self

    def __exit__(self, *_) -> None:
        self.close()
