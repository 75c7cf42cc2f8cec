"""Registered queries of sources and sinks: tables are written to the shared folder and read back."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import functions as F

from ..functions import formatting as fm
from ..operators import compaction, grading, totals
from ..sources import json_files, providers, rollout, shared, text
from ..sources.settings import Settings
from .registry import _W, ledger, query, table


@query("SELECT c_nationkey AS nation, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS line_number, c_custkey || ' | ' || c_name AS source_text FROM customer")
def text_log_scan(spark, sf_dir):
    """A log file of each nation's customers, with the known lines before it."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("at"), F.concat_ws(" | ", "c_custkey", "c_name").alias("value"))
    heads = F.array(*(F.struct(F.lit(k - 9).cast("long").alias("at"), F.lit(t).alias("value")) for k, t in enumerate([*text.PREAMBLE, "  "])))
    heads = rows.select("n").distinct().select("n", F.inline(heads))
    path = shared.fresh(spark, "text-log")
    rows.unionByName(heads).repartition("n").sortWithinPartitions("n", "at").select("n", "value").write.partitionBy("n").text(path)
    lines = text.read_log(spark, f"{path}/n=*")
    return lines.select(F.regexp_extract("log_id", r"/n=(\d+)/", 1).cast("int").alias("nation"), "line_number", "source_text")


@query("SELECT CAST(r_regionkey + 1 AS INTEGER) AS line_number, r_name AS source_text, r_regionkey IN (1, 3) AS confirmed FROM region")
def in_memory_lines(spark, sf_dir):
    """Lines that a caller holds, and the numbers that the caller confirms."""
    names = [r.r_name for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # a caller's list
    confirmed = text.confirmations(spark, [2, 4]).withColumn("confirmed", F.lit(True))
    lines = text.from_lines(spark, names).join(confirmed, ["log_id", "line_number"], "left")
    return lines.select("line_number", "source_text", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


LOGS = 16
_LOG = f"WITH l AS (SELECT conv_id % {LOGS} AS log, row_number() OVER (PARTITION BY conv_id % {LOGS} ORDER BY conv_id, turn) AS line_number, conv_id, turn, role, text FROM conversations)"


def _rollout_logs(spark, sf_dir, line) -> str:
    """Conversations as log files of one JSON line a turn; returns their folder."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") % LOGS).alias("log"), "conv_id", "turn", line.alias("value"))
    path = shared.fresh(spark, "rollout-log")
    turns.repartition("log").sortWithinPartitions("log", "conv_id", "turn").select("log", "value").write.partitionBy("log").text(path)
    return f"{path}/log=*"


def _number(column: str):
    return F.regexp_extract(column, r"/log=(\d+)/", 1).cast("long")


@query(f"{_LOG} SELECT log, line_number, role, text FROM l WHERE role IN ('user', 'assistant')")
def rollout_scan(spark, sf_dir):
    part = F.struct(F.lit("text").alias("type"), F.col("text"))
    record = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.col("role"), F.array(part).alias("content")).alias("payload")))
    lines = rollout.raw_lines(spark, _rollout_logs(spark, sf_dir, record))
    return rollout.records(lines).select(_number("trial_id").alias("log"), "line_number", "role", "text")


@query(f"""{_LOG} SELECT log, sha256(string_agg('{{"turn": ' || turn || '}}' || chr(10), '' ORDER BY conv_id, turn)) AS source_sha256 FROM l GROUP BY log""")
def rollout_digests(spark, sf_dir):
    line = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}"))
    return rollout.file_digests(spark, _rollout_logs(spark, sf_dir, line)).select(_number("trial_id").alias("log"), "source_sha256")


@query(
    f"""{_LOG} SELECT log, line_number, CASE (conv_id + turn) % 5 WHEN 0 THEN 'message without role' WHEN 1 THEN 'message without text' WHEN 2 THEN 'tool call is incomplete' WHEN 3 THEN 'tool output is incomplete' END AS problem
        FROM l WHERE (conv_id + turn) % 5 < 4"""
)
def malformed_records(spark, sf_dir):
    kind = (F.col("conv_id") + F.col("turn")) % 5
    payloads = ['{"type":"message","content":[]}', '{"type":"message","role":"user","content":[{"type":"image"}]}', '{"type":"custom_tool_call","call_id":"a","name":"x"}', '{"type":"custom_tool_call_output","call_id":"a"}', '{"type":"message","role":"system"}']
    payload = F.element_at(F.array(*map(F.lit, payloads)), (kind + 1).cast("int"))
    lines = rollout.raw_lines(spark, _rollout_logs(spark, sf_dir, F.concat(F.lit('{"type":"response_item","payload":'), payload, F.lit("}"))))
    trials = lines.select("trial_id").distinct().select("trial_id", F.lit(1).cast("long").alias("start_line"), F.lit(2**31).cast("long").alias("cutoff_line"))
    return rollout.malformed_records(lines, trials).select(_number("trial_id").alias("log"), "line_number", "problem")


@query("SELECT conv_id, turn, role <> 'assistant' OR (conv_id * 7 + turn * 13) % 100 >= 50 AS kept FROM conversations")
def batched_decisions(spark, sf_dir):
    """One call a conversation answers all its questions; the saved answers then select turns."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select(F.col("conv_id").alias("trial_id"), F.col("turn").alias("position"), F.col("turn").cast("string").alias("id"), F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("kind"), "text")
    asked = compaction.questions(rows).groupBy("trial_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "instructions"))).alias("questions"))
    answer = lambda q: {i: (q["trial_id"] * 7 + int(i) * 13) % 100 / 100 for i in dict(q["questions"])}
    saved = providers.exploded_batch(providers.decide(asked, answer, shared.fresh(spark, "decisions"), tasks=4))
    return compaction.select_segments(rows, saved).select(F.col("trial_id").alias("conv_id"), F.col("position").alias("turn"), "kept")


@query(
    """WITH c AS (SELECT conv_id, turn, (conv_id * 7 + turn * 13) % 100 >= 50 AS kept FROM conversations WHERE role = 'assistant')
       SELECT 1 AS step, 'questions' AS name, count(*) AS rows, count(*) FILTER (turn < 3) AS extra FROM c UNION ALL SELECT 2, 'answers', count(DISTINCT conv_id), count(*) FROM c
       UNION ALL SELECT 3, 'selection', count(*), count(*) FILTER (role <> 'assistant' OR (conv_id * 7 + turn * 13) % 100 >= 50) FROM conversations"""
)
def model_step_progress(spark, sf_dir):
    """What each step of a retention run let pass, counted while it was written."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select(F.col("conv_id").alias("trial_id"), F.col("turn").alias("position"), F.col("turn").cast("string").alias("id"), F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("kind"), "text")
    steps = providers.Steps(spark)
    path = shared.fresh(spark, "steps")
    asked = steps.run("questions", compaction.questions(rows), f"{path}/questions", extra=F.sum((F.col("position") < 3).cast("int")))
    batches = asked.groupBy("trial_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "instructions"))).alias("questions"))
    answer = lambda q: {i: (q["trial_id"] * 7 + int(i) * 13) % 100 / 100 for i in dict(q["questions"])}
    said = steps.run("answers", providers.decide(batches, answer, f"{path}/said", tasks=4), f"{path}/answers", extra=F.sum(F.size("probabilities")))
    steps.run("selection", compaction.select_segments(rows, providers.exploded_batch(said)), f"{path}/selection", extra=F.count_if("kept"))
    return steps.table().select("step", "name", "rows", F.col("counts")["extra"].alias("extra"))


@query(
    """WITH t AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY c_nationkey)
       SELECT nation, n AS opened, n AS closed, CASE WHEN nation % 4 = 0 THEN n ELSE 0 END AS failures FROM t"""
)
def closed_resources(spark, sf_dir):
    """A task opens a resource for each customer of a nation and closes them all; those of every fourth nation do not close."""
    shared.send_package(spark)

    class Held:
        def __init__(self, nation: int):
            self.nation, self.closed = nation, 0

        def close(self) -> None:
            self.closed += 1
            if self.nation % 4 == 0:
                raise OSError("busy")

    def run(frames):
        for frame in frames:
            for nation, part in frame.groupby("nation"):
                kept = [Held(int(nation)) for _ in range(len(part))]
                failures = 0
                try:
                    with providers.Resources() as held:
                        for one in kept:
                            held.add(one)
                except ExceptionGroup as group:
                    failures = len(group.exceptions)
                held.close()  # closes nothing twice
                yield pd.DataFrame([(nation, len(kept), sum(h.closed for h in kept), failures)], columns=["nation", "opened", "closed", "failures"])

    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    found = rows.repartition("nation").mapInPandas(run, "nation int, opened long, closed long, failures long")
    return found.groupBy("nation").agg(*(F.sum(c).alias(c) for c in ("opened", "closed", "failures")))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'pets' WHEN 1 THEN 'travel' ELSE 'other' END AS choice, 0.75 AS confidence, 3 AS options FROM part")
def bounded_choice_source(spark, sf_dir):
    options = ["pets", "travel", "other"]
    asked = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.array(*map(F.lit, options)).alias("options"))

    def answer(q: dict) -> dict:
        choice = list(q["options"])[q["p_size"] % 3]
        return {"choice": choice, "confidence": 0.75, "probabilities": {o: 0.75 if o == choice else 0.125 for o in q["options"]}}

    said = providers.choose(asked, answer, ["p_partkey", "p_size"], shared.fresh(spark, "choices"), tasks=4)
    good = said.join(providers.choice_problems(said).select("p_partkey"), "p_partkey", "left_anti")
    return good.select("p_partkey", "choice", F.col("confidence").cast("decimal(3,2)").alias("confidence"), F.size("probabilities").alias("options"))


@query("SELECT r_regionkey, 'say ' || r_name || '!' AS completion, CASE WHEN r_regionkey % 2 = 1 THEN 2 ELSE 1 END AS attempts FROM region")
def completions_after_retries(spark, sf_dir):
    """Odd regions' provider is busy at the first attempt; the wait that it asks for is none."""
    asked = table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("say "), "r_name").alias("prompt"))
    tried: dict[int, int] = {}

    def answer(q: dict) -> str:
        tried[q["r_regionkey"]] = tried.get(q["r_regionkey"], 0) + 1
        if q["r_regionkey"] % 2 == 1 and tried[q["r_regionkey"]] == 1:
            raise providers.Retryable("busy", 0.0)
        return f"{q['prompt']}!#{tried[q['r_regionkey']]}"

    said = providers.complete(asked, answer, ["r_regionkey"], shared.fresh(spark, "completions"))
    parts = F.split("completion", "#")
    return said.select("r_regionkey", parts[0].alias("completion"), parts[1].cast("int").alias("attempts"))


@query(
    _W.replace("6900000", "6900000.50")
    + "SELECT category, target, count(*) AS months, count(*) FILTER (variance > 0) AS above FROM bc GROUP BY category, target"
)
def settings_targets(spark, sf_dir):
    """Months that break the targets which a file and the environment set; the environment goes first."""
    path = shared.fresh(spark, "settings")
    line = F.concat(F.lit("export SHOPPING_TARGET='"), F.max(F.lit("7100000")), F.lit("'"))
    table(spark, sf_dir, "region").agg(line.alias("value")).coalesce(1).write.text(path)
    name = next(n for n in os.listdir(shared.mounted(path)) if n.startswith("part-"))
    settings = Settings.from_environment({"DINING_TARGET": "6900000.50"}, os.path.join(shared.mounted(path), name))
    tx = ledger(spark, sf_dir)
    budgets = totals.budget_comparisons(totals.monthly_category_totals(tx), totals.monthly_totals(tx), settings.targets(spark))
    return budgets.groupBy("category", F.col("target").cast("decimal(18,2)").alias("target")).agg(F.count("*").alias("months"), F.count_if(F.col("variance") > 0).alias("above"))


@query("SELECT p_partkey, p_name, p_brand AS brand, p_size AS size FROM part")
def typed_json(spark, sf_dir):
    path = shared.fresh(spark, "typed")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("about")).write.json(path)
    return json_files.read_typed(spark, path, "p_partkey long, p_name string, about struct<brand:string,size:int>").select("p_partkey", "p_name", "about.*")


@query(
    """SELECT 'about.size' AS path, 'int' AS expected, 'STRING' AS found, count(*) AS n FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'about.more[].deep', 'no such field', 'BIGINT', count(*) FROM part WHERE p_partkey % 7 = 0
       UNION ALL SELECT 'about', 'object', 'BOOLEAN', count(*) FROM part WHERE p_partkey % 11 = 1 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0"""
)
def typed_json_problems(spark, sf_dir):
    """Wrong kinds and unknown nested fields, found in the scan that reads the rows."""
    path = shared.fresh(spark, "typed")
    k, text = F.col("p_partkey"), F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"'))
    size = F.when(k % 5 == 0, text).otherwise(F.col("p_size").cast("string"))
    more = F.when(k % 7 == 0, ', "more": [{"name": "a"}, {"name": null, "deep": 1}]').otherwise(', "more": [{"name": "a"}]')
    about = F.concat(F.lit('{"size": '), size, more, F.lit("}"))
    about = F.when((k % 11 == 1) & (k % 5 != 0) & (k % 7 != 0), "true").otherwise(about)
    table(spark, sf_dir, "part").select(F.concat(F.lit('{"p_partkey": '), k.cast("string"), F.lit(', "about": '), about, F.lit("}")).alias("value")).write.text(path)
    found = json_files.type_problems(spark, path, "p_partkey long, about struct<size:int,more:array<struct<name:string>>>")
    return found.groupBy("path", "expected", "found").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS region, arg_max(n_name, lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS name FROM nation GROUP BY n_regionkey")
def latest_scorecards(spark, sf_dir):
    """A folder a nation, as if each were a run; the newest of each region stays."""
    path = shared.fresh(spark, "scorecards")
    rows = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("run"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"))
    rows.repartition("run").write.partitionBy("run").json(path)
    return json_files.latest_scorecards(spark, path, ["region"], "region int, name string", "part-*").select("region", "name")


@query("SELECT c_custkey, '/home/<user>/' || c_name AS folder FROM customer")
def json_artifacts(spark, sf_dir):
    """Account folder names are scrubbed on the way; what an earlier run left is replaced."""
    path = shared.fresh(spark, "artifacts")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/home/sam/"), "c_name").alias("folder"))
    for part in (rows.filter("c_custkey < 10"), rows):
        json_files.write_json(part, path, user_name="sam")
    return spark.read.schema("c_custkey long, folder string").json(path)


_TRIALS = """t AS (SELECT r.run, count(*) FILTER (l_orderkey % r.run = 0) AS kept, count(*) AS every FROM lineitem CROSS JOIN (VALUES (1), (2), (3)) r(run) GROUP BY r.run)"""


def _trial(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")

    def trial(run: int):
        """Grades whether the run keeps all lines and whether it keeps any; the second run fails."""
        seen = lines.agg(F.count_if(F.col("l_orderkey") % run == 0).alias("kept"), F.count("*").alias("every"))
        if run == 2:
            raise ValueError(f"run {run} has no lines")
        verdict = lambda c: F.when(c, "passed").otherwise("failed")
        pair = F.array(F.struct(F.lit("all").alias("check_name"), verdict(F.col("kept") == F.col("every")).alias("status")), F.struct(F.lit("any").alias("check_name"), verdict(F.col("kept") > 0).alias("status")))
        return seen.select(F.inline(pair))

    return trial


@query(f"WITH {_TRIALS} SELECT run, CASE WHEN run = 2 THEN 'ValueError: run 2 has no lines' END AS failure, true AS timed FROM t")
def isolated_trials(spark, sf_dir):
    """Three live runs over all lines, of which the second fails; the others are not touched by it."""
    _, timings = grading.graded_trials(spark, _trial(spark, sf_dir), ["all", "any"], 3)
    return timings.select("run", "failure", (F.col("seconds") >= 0).alias("timed"))


@query(f"WITH {_TRIALS} SELECT run, c AS check_name, CASE WHEN run = 2 THEN 'errored' WHEN c = 'all' AND kept < every THEN 'failed' WHEN c = 'any' AND kept = 0 THEN 'failed' ELSE 'passed' END AS status FROM t CROSS JOIN (VALUES ('all'), ('any')) k(c)")
def graded_live_trials(spark, sf_dir):
    return grading.graded_trials(spark, _trial(spark, sf_dir), ["all", "any"], 3)[0]


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '—' ELSE c_custkey || ', 7' END AS lines, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Dining & Coffee' ELSE 'Pets' END AS category FROM customer")
def list_and_category_texts(spark, sf_dir):
    lines = F.when(F.col("c_acctbal") < 0, F.array().cast("array<long>")).otherwise(F.array(F.col("c_custkey"), F.lit(7).cast("long")))
    category = F.when(F.col("c_mktsegment") == "BUILDING", "dining_coffee").otherwise("pets")
    return table(spark, sf_dir, "customer").select("c_custkey", fm.line_numbers(lines).alias("lines"), fm.category_name(category).alias("category"))
