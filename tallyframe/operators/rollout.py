"""Conversation logs with tool calls: segments, pairing, merged polls, the held-out answer and window checks.

Records are (trial_id, line_number, type, role, text, call_id, call_text, result) of a window's usable lines, as
``sources.rollout.records`` reads them; ``trials`` is (trial_id, start_line, cutoff_line). Windows are partitioned by trial.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import send_package
from . import blocks

# Marks in the text.
PLUGIN_MARK = "<recommended_plugins>"
POLL_MARK = "tools.write_stdin("
POLL_ID = r"""["']?session_id["']?\s*:\s*(\d+)"""
RESULT_ID = r"""["']session_id["']\s*:\s*(\d+)"""
CALL_JOIN, RESULT_JOIN = "\n[continued by poll]\n", "\n[continued output]\n"


#: Before every position.
NOWHERE = -(2**62)


def call_output_pairs(calls: DataFrame, outputs: DataFrame, key: list[str], call_order: str, output_order: str) -> DataFrame:
    """Each call with the first output of its key that comes later: an equi-join with an order condition.

    Calls must be unique by key; other columns keep their names, so they must differ between the two sides.
    """
    met = calls.join(outputs, key).filter(F.col(call_order) < F.col(output_order))
    first = Window.partitionBy(*key).orderBy(output_order)
    return met.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def unmatched_calls(calls: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    return calls.join(pairs, key, "left_anti")


def repeated_call_ids(records: DataFrame) -> DataFrame:
    calls = records.filter(F.col("type") == "custom_tool_call")
    return calls.groupBy("trial_id", "call_id").count().filter("count > 1").select("trial_id", F.left(F.sha2("call_id", 256), F.lit(12)).alias("call_fingerprint"))


def segments(records: DataFrame, trials: DataFrame) -> DataFrame:
    """trial_id, position, id, kind, text, result of messages and completed calls before the cutoff."""
    rows = records.join(trials, "trial_id").filter((F.col("line_number") >= F.col("start_line")) & (F.col("line_number") < F.col("cutoff_line")))
    said = rows.filter((F.col("type") == "message") & F.col("role").isin("user", "assistant") & (F.col("text") != "") & ~F.col("text").startswith(PLUGIN_MARK))
    said = said.select("trial_id", F.col("line_number").alias("position"), F.concat(F.lit("message_"), F.col("line_number")).alias("id"), F.col("role").alias("kind"), "text", F.lit(None).cast("string").alias("result"))
    calls = rows.filter(F.col("type") == "custom_tool_call").select("trial_id", "call_id", F.col("line_number").alias("call_line"), "call_text")
    outputs = rows.filter(F.col("type") == "custom_tool_call_output").select("trial_id", "call_id", F.col("line_number").alias("position"), F.col("result").alias("output"))
    done = call_output_pairs(calls, outputs, ["trial_id", "call_id"], "call_line", "position")
    done = done.select("trial_id", "position", F.concat(F.lit("tool_"), F.col("call_line")).alias("id"), F.lit("tool").alias("kind"), F.col("call_text").alias("text"), F.col("output").alias("result"))
    return said.unionByName(done)


def _summed(batches):
    """Of each block of polls: into which event an event that is open before it turns, for every place that may have begun at.

    An event that began at or before all ``named`` places stays open; one that began after ``lowers[i]`` (the first such i)
    ends, and ``states[i]`` is open after the block. States rise, so each row is put on the stack and taken off once.
    """
    key, stack, least = None, [], None

    def row():
        return (*key, [low for low, _ in stack], [state for _, state in stack])

    out = []
    for batch in batches:
        for trial, block, position, named in batch.itertuples(index=False):
            if (trial, block) != key:
                if key is not None:
                    out.append(row())
                key, stack, least = (trial, block), [], None
            named = NOWHERE - 1 if pd.isna(named) else int(named)
            low = None
            while stack and stack[-1][1] > named:
                low = stack.pop()[0]
            if least is None or named < least:
                low = least = named
            if low is not None:
                stack.append((low, int(position)))
        yield pd.DataFrame(out, columns=["trial_id", "_block", "lowers", "states"])
        out = []
    if key is not None:
        yield pd.DataFrame([row()], columns=["trial_id", "_block", "lowers", "states"])


def _carried(batches):
    """The event that is open before each block, block after block of a trial."""
    key, state = None, None
    for batch in batches:
        out = []
        for trial, block, lowers, states in batch.itertuples(index=False):
            if key is None or (trial,) != key:
                key, state = (trial,), NOWHERE
            out.append((trial, block, state))
            state = next((int(s) for low, s in zip(lowers, states) if state > low), state)
        yield pd.DataFrame(out, columns=["trial_id", "_block", "open"])


def _filled(batches):
    """The place at which the event of each row began."""
    key, state = None, None
    for batch in batches:
        out = []
        for trial, block, position, named, before in batch.itertuples(index=False):
            if (trial, block) != key:
                key, state = (trial, block), int(before)
            if pd.isna(named) or named < state:
                state = int(position)
            out.append((trial, position, state))
        yield pd.DataFrame(out, columns=["trial_id", "position", "began"])


def event_starts(rows: DataFrame, width: int | None = None) -> DataFrame:
    """trial_id, position and the position at which the row's event began.

    rows: trial_id, position (whole, unique in a trial), asked (the session that a poll asks for, else null), named (sessions
    that the row's result names). A poll goes on with the event before it if a row of that event names its session: if the
    session was last named at or after the event's beginning. So all that a fold has to carry is where the open event began;
    trials are folded in blocks of ``width`` positions, whose effect is put in a few numbers and carried on between them.
    """
    send_package(rows.sparkSession)
    kind = rows.schema["trial_id"].dataType.simpleString()
    rows = rows.withColumn("position", F.col("position").cast("long"))
    # what a row names counts after what it asks
    names = rows.select("trial_id", F.explode(F.array_distinct("named")).alias("session"), (F.col("position") * 2 + 1).alias("at"), F.col("position").alias("here"))
    asks = rows.filter("asked is not null").select("trial_id", F.col("asked").alias("session"), (F.col("position") * 2).alias("at"), F.lit(None).cast("long").alias("here"))
    met = blocks.last_before(names.unionByName(asks), ["trial_id", "session"], "at", F.col("here"), "named_at", width)
    polls = met.filter("here is null").select(F.col("trial_id").alias("_t"), F.expr("at div 2").alias("_p"), "named_at")
    items = rows.select("trial_id", "position").join(polls, F.col("trial_id").eqNullSafe(F.col("_t")) & (F.col("position") == F.col("_p")), "left")
    items = blocks.numbered(items.select("trial_id", "position", "named_at"), "position", width)
    dealt = lambda df: df.repartition("trial_id", "_block").sortWithinPartitions("trial_id", "_block", "position")
    sums = dealt(items.select("trial_id", "_block", "position", "named_at")).mapInPandas(_summed, f"trial_id {kind}, _block long, lowers array<long>, states array<long>")
    carried = sums.repartition("trial_id").sortWithinPartitions("trial_id", "_block").mapInPandas(_carried, f"trial_id {kind}, _block long, open long")
    filled = dealt(blocks.met(items, carried, ["trial_id"])).select("trial_id", "_block", "position", "named_at", "open")
    return filled.mapInPandas(_filled, f"trial_id {kind}, position long, began long")


def merge_polls(rows: DataFrame, width: int | None = None) -> DataFrame:
    """In timeline order, a poll of a session that the tool event before it names is appended to that event.

    The event's session ids are those of all parts appended so far. Only numbers are folded, in blocks; the texts of an
    event meet once, where they are joined.
    """
    tool, none = F.col("kind") == "tool", F.array().cast("array<string>")
    poll = F.regexp_extract("text", POLL_ID, 1)
    asked = F.when(tool & F.contains("text", F.lit(POLL_MARK)) & (poll != ""), poll)
    named = F.when(tool, F.coalesce(F.regexp_extract_all("result", F.lit(RESULT_ID), 1), none)).otherwise(none)
    starts = event_starts(rows.select("trial_id", "position", asked.alias("asked"), named.alias("named")), width)
    starts = starts.select(F.col("trial_id").alias("_t"), F.col("position").alias("_p"), "began")
    rows = rows.withColumn("position", F.col("position").cast("long"))
    events = rows.join(starts, F.col("trial_id").eqNullSafe(F.col("_t")) & (F.col("position") == F.col("_p")))
    merged = events.groupBy("trial_id", "began").agg(F.array_sort(F.collect_list(F.struct("position", "id", "kind", "text", "result"))).alias("s"))
    first = F.col("s")[0]
    results = F.transform("s", lambda x: x["result"])
    result = F.when(F.exists(results, lambda x: x.isNotNull()), F.array_join(results, RESULT_JOIN))
    return merged.select("trial_id", first["position"].alias("position"), first["id"].alias("id"), first["kind"].alias("kind"), F.array_join(F.transform("s", lambda x: x["text"]), CALL_JOIN).alias("text"), result.alias("result"))


def held_out_answers(records: DataFrame, trials: DataFrame) -> DataFrame:
    """The first assistant message with text at or after the cutoff."""
    rows = records.join(trials, "trial_id").filter((F.col("line_number") >= F.col("cutoff_line")) & (F.col("type") == "message") & (F.col("role") == "assistant") & (F.col("text") != ""))
    return rows.groupBy("trial_id").agg(F.min_by("text", "line_number").alias("answer"), F.min("line_number").alias("answer_line"))


def window_problems(trials: DataFrame, merged: DataFrame, answers: DataFrame, pending: DataFrame) -> DataFrame:
    """All problems of each trial's window at once; trials without problems give no row. pending: trial_id, call_line."""
    flags = merged.groupBy("trial_id").agg(F.bool_or(F.col("kind") == "user").alias("has_user"), F.bool_or(F.col("kind") == "tool").alias("has_tool"))
    lines = pending.groupBy("trial_id").agg(F.array_sort(F.collect_list("call_line")).alias("lines"))
    rows = trials.join(flags, "trial_id", "left").join(answers.select("trial_id", "answer"), "trial_id", "left").join(lines, "trial_id", "left")
    listed = F.format_string("contains %d unfinished tool calls at lines [%s]", F.size("lines"), F.array_join(F.col("lines").cast("array<string>"), ", "))
    problems = F.array_compact(
        F.array(
            F.when(F.col("start_line") < 1, "start line is below 1"),
            F.when(F.col("cutoff_line") <= F.col("start_line"), "cutoff line is not after the start line"),
            F.when(F.col("answer").isNull(), "needs a later assistant answer"),
            F.when(F.size("lines") > 0, listed),
            F.when(~F.coalesce("has_user", F.lit(False)), "needs a user message"),
            F.when(~F.coalesce("has_tool", F.lit(False)), "needs a completed tool call"),
        )
    )
    return rows.select("trial_id", problems.alias("problems")).filter(F.size("problems") > 0)
