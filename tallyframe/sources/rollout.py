"""Conversation logs in JSON lines, with the digest of the whole file."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import send_package
from .text import numbered_lines

PAYLOAD = "type string, role string, content string, call_id string, name string, input string, output string"


def _parts_text(content):
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    return F.array_join(F.transform(parts, lambda x: x["text"]), "\n")


def _digests(batches):
    """The digest of each file from its lines in order.

    Readers take off a byte order mark and every line feed; the file's size says whether the mark and the last one are there.
    """
    file, size, n, marked, bare = None, 0, 0, None, None

    def end() -> pa.RecordBatch:
        missing = size - n
        if missing not in (0, 1, 3, 4):
            raise ValueError(f"{file} has {size} bytes, of which {n} were read: is it compressed?")
        sha = marked if missing >= 3 else bare
        sha.update(b"\n" * (missing % 3))
        return pa.RecordBatch.from_pydict({"trial_id": [file], "source_sha256": [sha.hexdigest()]})

    for batch in batches:
        for path, length, line in zip(batch.column("trial_id").to_pylist(), batch.column("size").to_pylist(), batch.column("line")):
            feed = b"\n"
            if path != file:
                if file is not None:
                    yield end()
                file, size, n, feed = path, length, 0, b""
                marked, bare = hashlib.sha256(b"\xef\xbb\xbf"), hashlib.sha256()
            n += len(feed) + len(line.as_buffer())
            for sha in (marked, bare):
                sha.update(feed)
                sha.update(line.as_buffer())
    if file is not None:
        yield end()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """trial_id and the SHA-256 of each whole file, of any size.

    A digest runs through a file from end to end, so one task has each file; but as lines, sorted by block and place on disk
    where they are many, of which it holds a batch at a time. Files are read by Spark and may lie in any store. Readers pass
    over files without a byte, so these give no row.
    """
    send_package(spark)
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(meta["file_path"].alias("trial_id"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
    ordered = lines.repartition("trial_id").sortWithinPartitions("trial_id", "block", "at").select("trial_id", "size", "line")
    return ordered.mapInArrow(_digests, "trial_id string, source_sha256 string")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """trial_id, line_number and line; only a line feed ends a line."""
    return numbered_lines(spark.read.option("lineSep", "\n").text(path)).toDF("trial_id", "line_number", "line")


def invalid_lines(lines: DataFrame) -> DataFrame:
    """Lines that are no JSON at all: must be none, whatever the window."""
    return lines.filter(F.expr("try_parse_json(line)").isNull()).select("trial_id", "line_number")


def malformed_records(lines: DataFrame, trials: DataFrame) -> DataFrame:
    """Lines of a trial's window whose record is of a known type but lacks what that type must have: must be none.

    trials: trial_id, start_line, cutoff_line. Messages of other roles and records of other types are not looked at.
    """
    item = F.from_json("line", "type string, payload string").alias("r")
    rows = lines.join(trials, "trial_id").filter((F.col("line_number") >= F.col("start_line")) & (F.col("line_number") < F.col("cutoff_line")))
    rows = rows.select("trial_id", "line_number", item).filter("r.type = 'response_item'").select("trial_id", "line_number", F.from_json("r.payload", PAYLOAD).alias("p"))
    parts = F.from_json(F.col("p.content"), "array<struct<type:string,text:string>>")
    no_text = F.coalesce(F.exists(parts, lambda x: x["text"].isNull()), F.lit(True))
    kind, role = F.col("p.type"), F.col("p.role")
    list_output = F.from_json(F.col("p.output"), "array<struct<type:string,text:string>>")
    problem = (
        F.when(F.col("p").isNull(), "payload is no object")
        .when((kind == "message") & role.isNull(), "message without role")
        .when((kind == "message") & role.isin("user", "assistant") & no_text, "message without text")
        .when((kind == "custom_tool_call") & (F.col("p.call_id").isNull() | F.col("p.name").isNull() | F.col("p.input").isNull()), "tool call is incomplete")
        .when((kind == "custom_tool_call_output") & (F.col("p.call_id").isNull() | F.col("p.output").isNull()), "tool output is incomplete")
        .when((kind == "custom_tool_call_output") & F.col("p.output").startswith("[") & F.coalesce(F.exists(list_output, lambda x: x["text"].isNull()), F.lit(True)), "tool output has parts that are no text")
    )
    return rows.select("trial_id", "line_number", problem.alias("problem")).filter("problem is not null")


def records(lines: DataFrame) -> DataFrame:
    """Usable payloads: messages of users and assistants, tool calls and tool outputs; other records are left out."""
    item = F.from_json("line", f"type string, payload struct<{PAYLOAD.replace(' ', ':')}>".replace(",:", ","))
    rows = lines.select("trial_id", "line_number", item.alias("r")).filter("r.type = 'response_item' and r.payload is not null").select("trial_id", "line_number", "r.payload.*")
    text = F.when(F.col("type") == "message", _parts_text(F.col("content")))
    output = F.col("output")
    result = F.when(output.startswith("["), _parts_text(output)).otherwise(output)
    kept = rows.filter(F.col("type").isin("custom_tool_call", "custom_tool_call_output") | (F.col("type") == "message") & F.col("role").isin("user", "assistant"))
    return kept.select(
        "trial_id",
        "line_number",
        "type",
        "role",
        text.alias("text"),
        "call_id",
        F.when(F.col("type") == "custom_tool_call", F.concat(F.col("name"), F.lit(": "), F.col("input"))).alias("call_text"),
        F.when(F.col("type") == "custom_tool_call_output", result).alias("result"),
    )
