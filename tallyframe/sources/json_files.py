"""Typed JSON readers and artifact writers with path checks."""

from __future__ import annotations

import getpass
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formatting import scrub_user_name
from .text import numbered_lines

LEDGER = "line_number int, source_text string, merchant string, occurred_on date, amount decimal(18,2), category string, period string, is_counted boolean, note string, policy_name string, alternatives array<string>"
CHECKS = "check_name string, grader string, fact_name string, minimum_pass_rate double, description string"


PROBLEM = "array<struct<path:string,expected:string,found:string>>"


def _problem(path: Column, expected: str, value: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(expected).alias("expected"), F.schema_of_variant(value).alias("found"))


def _problems(value: Column, kind: T.DataType, path: Column) -> Column:
    """Where a variant and its parts do not fit a type: fields that it does not have, and values of another kind.

    Null fits any type; a map takes any key; dates and times are texts that read as such.
    """
    none = F.array().cast(PROBLEM)
    wrong = lambda good, name: F.when(good, none).otherwise(F.array(_problem(path, name, value)).cast(PROBLEM))
    shape = F.schema_of_variant(value)
    below = lambda name: F.concat(path, F.when(path == "", "").otherwise("."), name)
    if isinstance(kind, T.StructType):
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        known = [f.name for f in kind]
        unknown = F.array_except(F.map_keys(fields), F.array(*map(F.lit, known)).cast("array<string>"))
        parts = [F.transform(unknown, lambda k: _problem(below(k), "no such field", fields[k])).cast(PROBLEM)]
        parts += [F.coalesce(F.when(F.map_contains_key(fields, f.name), _problems(fields[f.name], f.dataType, below(F.lit(f.name)))), none) for f in kind]
        inner = F.when(fields.isNotNull(), F.concat(*parts)).otherwise(wrong(F.lit(False), "object"))
    elif isinstance(kind, T.MapType):
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        inner = F.when(fields.isNotNull(), F.flatten(F.transform(F.map_entries(fields), lambda e: _problems(e["value"], kind.valueType, below(e["key"]))))).otherwise(wrong(F.lit(False), "object"))
    elif isinstance(kind, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        inner = F.when(items.isNotNull(), F.flatten(F.transform(items, lambda x: _problems(x, kind.elementType, F.concat(path, F.lit("[]")))))).otherwise(wrong(F.lit(False), "array"))
    else:
        name = kind.simpleString()
        read = F.try_variant_get(value, "$", name).isNotNull()
        if isinstance(kind, T.IntegralType):
            good = (shape == "BIGINT") & read
        elif isinstance(kind, (T.FractionalType, T.DecimalType)):
            good = (shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL")) & read
        elif isinstance(kind, T.BooleanType):
            good = shape == "BOOLEAN"
        else:
            good = (shape == "STRING") & read
        inner = wrong(good, name)
    return F.when(value.isNull() | F.is_variant_null(value), none).otherwise(inner)


def checked(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """file, line_number, row and problems of each record, from one read: a line's, or with ``lines=False`` a file's.

    ``row`` is the record in ``schema``, ``problems`` says with path, expected and found type what does not fit; text that is
    no JSON has the path ``""`` and the found type ``no JSON``. A file that holds an array gives a row for each of its items.
    """
    kind = spark.createDataFrame([], schema).schema
    if lines:
        read = numbered_lines(spark.read.text(path)).toDF("file", "line_number", "text").filter(F.btrim("text") != "")
        read = read.withColumn("v", F.try_parse_json("text"))
    else:
        read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit(1).cast("long").alias("line_number"), F.col("value").alias("text"))
        whole = F.try_parse_json("text")
        items = F.when(F.schema_of_variant(whole).startswith("ARRAY"), F.try_variant_get(whole, "$", "array<variant>")).otherwise(F.array(whole))
        read = read.select("file", "line_number", F.explode(items).alias("v"))
    row = F.from_json(F.to_json("v"), kind)
    lost = F.array(F.struct(F.lit("").alias("path"), F.lit("object").alias("expected"), F.lit("no JSON").alias("found"))).cast(PROBLEM)
    return read.select("file", "line_number", row.alias("row"), F.when(F.col("v").isNull(), lost).otherwise(_problems(F.col("v"), kind, F.lit(""))).alias("problems"))


def type_problems(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """file, line_number, path, expected and found of everything that does not fit."""
    return checked(spark, path, schema, lines).select("file", "line_number", F.inline("problems"))


def read_typed(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """Rows of a schema; reading fails at a record that does not fit, with its place, and the path and types of what is wrong."""
    rows = checked(spark, path, schema, lines)
    said = F.array_join(F.transform("problems", lambda p: F.concat(p["path"], F.lit(" ("), p["expected"], F.lit(", found "), p["found"], F.lit(")"))), ", ")
    failure = F.raise_error(F.concat(F.lit("records do not fit: "), F.col("file"), F.lit(" line "), F.col("line_number").cast("string"), F.lit(": "), said))
    good = F.when(F.size("problems") == 0, F.col("row")).otherwise(failure.cast(rows.schema["row"].dataType))
    return rows.select(good.alias("row")).select("row.*")


def latest_scorecards(spark: SparkSession, folder: str, key: list[str], schema: str, names: str = "scorecard.json") -> DataFrame:
    """The newest scorecard (``*/scorecard.json``) of each key, by run folder name, in key order."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/{names}").withColumn("run_folder", F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1))
    newest = Window.partitionBy(*key).orderBy(F.col("run_folder").desc())
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n").orderBy(*key)


def check_output(source: str | None, output: str) -> None:
    """An output that is a folder, lies in a missing one, or is the input itself is refused before any work."""
    if source is not None and (os.path.realpath(source) == os.path.realpath(output) or os.path.exists(source) and os.path.exists(output) and os.path.samefile(source, output)):
        raise ValueError(f"the output {output} is the input")
    if os.path.isdir(output):
        raise ValueError(f"the output {output} is a folder")
    if not os.path.isdir(os.path.dirname(os.path.abspath(output))):
        raise ValueError(f"the folder of {output} does not exist")


def write_json(df: DataFrame, path: str, source: str | None = None, user_name: str | None = None) -> None:
    """JSON lines in place of what was there; account folder names are scrubbed from text columns."""
    if source is not None and os.path.realpath(source) == os.path.realpath(path):
        raise ValueError(f"the output {path} is the input")
    name = user_name if user_name is not None else getpass.getuser()
    clean = df.select(*(scrub_user_name(F.col(c), name).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes))
    clean.write.mode("overwrite").json(path)
