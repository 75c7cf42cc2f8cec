import hashlib
import os
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import TaskContext

from tallyframe.sources import providers, rollout


def test_an_answer_is_never_paid_twice(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    stop = tmp_path / "stop"
    stop.touch()

    def answer(q):
        if q["k"] == 17 and os.path.exists(stop):
            os._exit(1)  # the worker dies in the midst of a task
        with open(calls / f"{q['k']}", "a") as f:
            f.write("x")
        return {"k": q["k"], "said": {w: 1.0 for w in dict(q["m"])}}

    rows = [(k, {"a": str(k), "b": "2"}) for k in range(40)] + [(3, {"b": "2", "a": "3"})]
    asked = spark.createDataFrame(rows, "k long, m map<string,string>").repartition(3)
    path = str(tmp_path / "answers")
    with pytest.raises(Exception):
        providers.recorded(asked, answer, "k long, said map<string,double>", path, tasks=3, in_flight=1)
    before = len(os.listdir(calls))
    assert 0 < before < 40
    stop.unlink()
    got = providers.recorded(asked, answer, "k long, said map<string,double>", path, tasks=3, in_flight=1).collect()
    assert sorted(r.k for r in got) == sorted([*range(40), 3]) and all(set(r.said) == {"a", "b"} for r in got)
    assert {p.name: p.read_text() for p in calls.iterdir()} == {str(k): "x" for k in range(40)}


def test_torn_answers_do_not_count(tmp_path):
    log = providers.AnswerLog(str(tmp_path / "b"))
    log.add("k1", {"a": 1})
    log.close()
    with open(next((tmp_path / "b").iterdir()), "ab") as f:
        f.write(b"k2 gASV")
    assert providers.AnswerLog(str(tmp_path / "b")).known == {"k1": {"a": 1}}


def test_digests_of_any_file(spark, tmp_path):
    files = {"a": b"", "b": b"x", "c": b"x\n", "d": b"\n\n", "e": b"\xef\xbb\xbfx\ny", "f": b"\xef\xbb\xbfx\n", "g": b"\xff\xfe raw\r\n\x00", "h": b"".join(b"line %d\n" % k for k in range(60_000)), "i": b"\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = {r.trial_id.rsplit("/", 1)[1]: r.source_sha256 for r in rollout.file_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: hashlib.sha256(v).hexdigest() for k, v in files.items() if v}


def test_steps_count_what_passes(spark, tmp_path):
    from pyspark.sql import functions as F

    heard = []
    steps = providers.Steps(spark, lambda kind, text: heard.append((kind, text)))
    rows = steps.run("one", spark.range(10), str(tmp_path / "one"), even=F.count_if(F.col("id") % 2 == 0))
    steps.run("none", rows.filter("id > 99"), str(tmp_path / "none"))
    assert [tuple(r) for r in steps.table().orderBy("step").collect()] == [(1, "one", 10, {"even": 5}), (2, "none", 0, {})]
    assert [k for k, _ in heard] == ["began", "ended"] * 2


def test_answers_at_the_same_time_share_a_disk_call(tmp_path, monkeypatch):
    log, calls, sync, asked, most = providers.AnswerLog(str(tmp_path / "b")), [], os.fsync, [], []

    def slow(fd):
        time.sleep(0.01)
        sync(fd)
        calls.append(fd)

    def ask(q):
        asked.append(q["k"])
        most.append(len(asked) - len(providers.AnswerLog(str(tmp_path / "b")).known))
        return q["k"]

    monkeypatch.setattr(os, "fsync", slow)
    with ThreadPoolExecutor(8) as pool:
        providers.ask_all({f"k{k}": ({"k": k}, log) for k in range(80)}, ask, pool, 8)
    log.close()
    assert sorted(asked) == list(range(80)) and max(most) <= 8 and len(calls) <= 40
    assert providers.AnswerLog(str(tmp_path / "b")).known == {f"k{k}": k for k in range(80)}


def test_a_failure_logs_what_was_answered(tmp_path):
    log, asked, met = providers.AnswerLog(str(tmp_path / "b")), [], threading.Barrier(4)

    def ask(q):
        asked.append(q["k"])
        met.wait(10)  # four are under way
        if q["k"] == 2:
            raise ValueError("no answer")
        time.sleep(0.2)
        return q["k"]

    with ThreadPoolExecutor(4) as pool, pytest.raises(ValueError, match="no answer"):
        providers.ask_all({f"k{k}": ({"k": k}, log) for k in range(20)}, ask, pool, 4)
    log.close()
    assert sorted(asked) == [0, 1, 2, 3]
    assert providers.AnswerLog(str(tmp_path / "b")).known == {"k0": 0, "k1": 1, "k3": 3}


def test_each_bucket_of_questions_has_a_task(spark, tmp_path):
    asked = spark.range(200).withColumnRenamed("id", "k")
    where = lambda q: {"k": q["k"], "task": TaskContext.get().partitionId() if TaskContext.get() else os.getpid()}
    got = providers.recorded(asked, where, "k long, task long", str(tmp_path / "answers"), tasks=4)
    assert got.select("task").distinct().count() == 4
