"""Text logs and in-memory lines as (log_id, line_number, source_text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What ends a line besides carriage return and line feed, and the lines that may stand before a log.
LINE_BREAK = r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
PREAMBLE = (
    "misc expenses - running list",
    "(started keeping track of this after i realized i had no idea where money was going. not super consistent about it, some entries are from memory a day or two late. june through august.)",
)
BYTE_ORDER_MARK = "\ufeff"


def read_log(spark: SparkSession, path: str, preamble: tuple[str, ...] = PREAMBLE) -> DataFrame:
    """Lines of text files, numbered from 1 after an exactly matching preamble and one blank line are taken off.

    Files are read in blocks: a line's number is its place in its block and the lines of the blocks before it, so no
    task reads a whole log. A file whose last character is one of the rarer line breaks ends with an empty line.
    """
    numbered = numbered_lines(spark.read.text(path), LINE_BREAK)
    bare = F.when(F.col("line_number") == 1, F.ltrim(F.col("source_text"), F.lit(BYTE_ORDER_MARK))).otherwise(F.col("source_text"))
    lines = numbered.select("log_id", F.col("line_number").cast("int").alias("line_number"), bare.alias("source_text"))
    if not preamble:
        return lines
    n = len(preamble)
    head = lines.filter(F.col("line_number") <= n + 1)
    expected = F.create_map(*(F.lit(x) for pair in enumerate(preamble, 1) for x in pair))
    same = F.count_if(F.col("source_text") == F.try_element_at(expected, F.col("line_number"))) == n
    blank = F.bool_or((F.col("line_number") == n + 1) & (F.btrim("source_text") == ""))
    skips = head.groupBy("log_id").agg(F.when(same & blank, n + 1).when(same, n).otherwise(0).alias("_skip"))
    out = lines.join(skips, "log_id", "left").withColumn("line_number", (F.col("line_number") - F.coalesce("_skip", F.lit(0))).cast("int"))
    return out.filter("line_number > 0").select("log_id", "line_number", "source_text")


def numbered_lines(read: DataFrame, breaks: str | None = None) -> DataFrame:
    """log_id, line_number (from 1 in each file) and source_text of a text source; ``breaks`` cuts its lines further.

    A line's number is its place in its block of the file and the lines of the blocks before it.
    """
    parts = F.array("value") if breaks is None else F.split("value", breaks, -1)
    rows = read.select(F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), parts.alias("_parts"))
    blocks = rows.groupBy("log_id", "_block").agg(F.sum(F.size("_parts")).alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy("log_id").orderBy("_block"))  # a row a block
    blocks = blocks.select("log_id", "_block", (so_far - F.col("_n")).alias("_before"))
    inside = F.sum(F.size("_parts")).over(Window.partitionBy("log_id", "_block").orderBy("_at")) - F.size("_parts")
    numbered = rows.withColumn("_first", inside).join(blocks, ["log_id", "_block"])
    numbered = numbered.select("log_id", (F.col("_before") + F.col("_first")).alias("_first"), F.posexplode("_parts").alias("_pos", "source_text"))
    return numbered.select("log_id", (F.col("_first") + F.col("_pos") + 1).alias("line_number"), "source_text")


def from_lines(spark: SparkSession, lines: list[str], log_id: str = "log") -> DataFrame:
    rows = [(log_id, k, text) for k, text in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "log_id string, line_number int, source_text string")


def confirmations(spark: SparkSession, numbers, log_id: str = "log") -> DataFrame:
    return spark.createDataFrame([(log_id, int(k)) for k in numbers], "log_id string, line_number int")
