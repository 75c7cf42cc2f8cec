"""The Markdown report: rows of cells of all logs, and one log's page, written in order by the tasks or read as a text."""

from __future__ import annotations

import os
import shutil
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formatting import category_name, line_numbers, money, month_name
from ..sources.json_files import check_output
from ..sources.shared import fresh, mounted
from . import blocks

NONE = "—"
ARROW = " → "

# Headings and labels of the report.
LEDGER = ("Transaction ledger", ("Line", "Source text", "Date", "Description", "Amount", "Expense category", "Treatment", "Note"))
CATEGORIES = ("Monthly spending by expense category", ("Month", "Expense category", "Amount", "Source lines"))
MONTHS = ("Monthly totals", ("Month", "Classified spending", "Unresolved outflow", "Observed outflow", "Source lines"))
BUDGETS = ("Budget comparisons", ("Month", "Expense category", "Target", "Actual", "Actual minus target", "Source lines", "Coverage", "Coverage source lines"))
CHANGES = ("Month-to-month changes", ("Months", "Expense category", "Previous", "Current", "Change", "Source lines"))
#: What the page says of the method, unless a caller says it otherwise.
METHOD = """Every line is kept with its number in the source. Dates and signed amounts are read by fixed patterns; where a line has several, a saved decision among them is applied, and what is still open takes saved proposals whose evidence is checked against the line. Expense categories come from saved decisions and explicit merchant and cash-movement policy. Only line numbers that the caller confirmed, and that agree with the line before them, are excluded as duplicates. A refund without a minus sign counts as a credit, and refunds stay negative. Uncategorized outflows are reported apart from spending. All sums are exact decimals, and lines, months and categories are reconciled before findings are given.

- Classified spending = sum of the signed amounts of included spending lines, by month and expense category.
- Unresolved outflow = sum of the signed amounts of unresolved outflow lines, which are no verified spending.
- Observed outflow = classified spending + unresolved outflow.
- Budget variance = actual category spending - monthly target.
- Month-to-month change = current category total - previous category total.
- Uncategorized credits stay in the ledger and are in no outflow.
- Charges of mixed retailers that name only the merchant are Other, so Shopping may be understated."""

# Labels of the last table.
SUMMARY = ("Source lines", "Included spending lines", "Confirmed duplicate lines", "Unresolved outflow lines", "Unresolved credit lines", "Refund or negative adjustment lines", "Unparsed lines", "Classified spending", "Unresolved outflow", "Observed outflow", "Reconciled")


def cell(text: Column) -> Column:
    """Text as a table's cell holds it."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _or_none(column):
    return F.coalesce(column, F.lit(NONE))


#: Parts of the report that are rows of cells, in order.
PARTS = ("ledger", "categories", "months", "budgets", "changes", "figures", "issues", "findings")


def cells(analysis) -> DataFrame:
    """log_id, part, place and cells of every row of every log's report; parts and rows are in order."""
    c = F.col

    def part(name: str, df: DataFrame, order: list, columns: list) -> DataFrame:
        if order == ["line_number"]:  # as many rows as the log has lines
            df, place = blocks.row_numbers(df, ["log_id"], "line_number", "_place"), c("_place")
        else:
            place = F.row_number().over(Window.partitionBy("log_id").orderBy(*order))
        return df.select("log_id", F.lit(PARTS.index(name)).alias("part"), place.cast("long").alias("place"), F.array(*(cell(x) for x in columns)).alias("cells"))

    month, category, listed = month_name(c("month")), category_name(c("category")), line_numbers(c("lines"))
    note = F.coalesce("policy_note", F.array_join("issues", ", "))
    number = c("line_number").cast("string")
    figures = [c("n_lines").cast("string"), *(line_numbers(c(x)) for x in ("included", "duplicates", "unresolved_lines", "credits", "refunds", "unparsed")), money(c("classified")), money(c("unresolved")), money(c("observed")), F.when(c("is_balanced"), "Yes").otherwise("No")]
    parts = [
        part("ledger", analysis.transactions, ["line_number"], [number, c("source_text"), _or_none(c("occurred_on").cast("string")), _or_none(c("description")), _or_none(money(c("amount"))), _or_none(category), F.replace("treatment", F.lit("_"), F.lit(" ")), note]),
        part("categories", analysis.category_totals, ["month", "category"], [month, category, money(c("amount")), listed]),
        part("months", analysis.month_totals, ["month"], [month, money(c("classified")), money(c("unresolved")), money(c("observed")), listed]),
        part("budgets", analysis.budgets, ["month", "category"], [month, category, money(c("target")), money(c("actual")), money(c("variance")), listed, _or_none(c("coverage_note")), line_numbers(c("coverage_lines"))]),
        part("changes", analysis.deltas, ["from_month", F.abs("change").desc(), "category"], [F.concat(month_name(c("from_month")), F.lit(ARROW), month_name(c("to_month"))), category, money(c("previous")), money(c("current")), money(c("change")), listed]),
        part("figures", analysis.reconciliation, ["n_lines"], figures),
        part("issues", analysis.parsed.filter(F.size("issues") > 0), ["line_number"], [number, F.array_join("issues", ", ")]),
        part("findings", analysis.findings, ["number"], [c("number").cast("string"), c("statement"), listed]),
    ]
    return reduce(DataFrame.unionByName, parts)


def _heading(columns) -> str:
    return "| " + " | ".join(columns) + " |\n| " + " | ".join(["---"] * len(columns)) + " |"


def page_lines(rows: DataFrame, log_id: str, title: str = "# Expense analysis", method: str = METHOD) -> DataFrame:
    """major, minor and text of one log's page: ``rows`` are ``cells``; the order of both columns is that of the page."""
    spark = rows.sparkSession
    rows = rows.filter(F.col("log_id") == log_id)
    tables = [(k, name, *heads) for k, (name, heads) in enumerate({"ledger": LEDGER, "categories": CATEGORIES, "months": MONTHS, "budgets": BUDGETS, "changes": CHANGES}.items(), 1)]
    quality, last, how = 10, 20, 15
    fixed = [(0, 0, title + "\n")]
    empty = []  # what stands in for a table's rows if there are none
    for k, name, heading, columns in tables:
        fixed += [(10 * k, 0, f"## {heading}\n\n{_heading(columns)}"), (10 * k + 2, 0, "")]
        empty.append((PARTS.index(name), 10 * k + 1, "| No entries" + " |" * len(columns)))
    fixed += [(10 * quality, 0, "## Quality and reconciliation\n"), (10 * quality + 2, 0, _heading(("Check", "Result"))), (10 * quality + 4, 0, "\n### Parsing issues\n\n" + _heading(("Line", "Issue"))), (10 * quality + 6, 0, "")]
    empty.append((PARTS.index("issues"), 10 * quality + 5, "| No entries | |"))
    fixed += [(10 * how, 0, f"## Method and calculation formulas\n\n{method}\n"), (10 * last, 0, "## Three evidence-based findings\n")]

    part, cells_ = F.col("part"), F.col("cells")
    row = F.concat(F.lit("| "), F.array_join(cells_, " | "), F.lit(" |"))
    of = lambda name: rows.filter(part == PARTS.index(name))
    majors = F.create_map(*(F.lit(x) for k, name, *_ in tables for x in (PARTS.index(name), 10 * k + 1)), F.lit(PARTS.index("issues")), F.lit(10 * quality + 5))
    body = rows.filter(F.map_contains_key(majors, part)).select(majors[part].alias("major"), F.col("place").alias("minor"), row.alias("text"))
    figures = of("figures").select(F.posexplode("cells").alias("minor", "value"))
    label = F.element_at(F.array(*map(F.lit, SUMMARY)), F.col("minor") + 1)
    figures = figures.select(F.lit(10 * quality + 3).alias("major"), F.col("minor").cast("long").alias("minor"), F.concat(F.lit("| "), label, F.lit(" | "), F.col("value"), F.lit(" |")).alias("text"))
    lost = F.concat(F.lit("Unable to parse source lines "), cells_[6], F.lit(". Their source text remains in the ledger and is excluded from spending totals.\n"))
    lost = of("figures").filter(cells_[6] != NONE).select(F.lit(10 * quality + 1).alias("major"), F.lit(0).cast("long").alias("minor"), lost.alias("text"))
    found = F.concat(cells_[0], F.lit(". "), cells_[1], F.lit(" (Source lines: "), cells_[2], F.lit(".)"))
    found = of("findings").select(F.lit(10 * last + 1).alias("major"), F.col("place").alias("minor"), found.alias("text"))
    missing = spark.createDataFrame(empty, "part int, major int, text string").join(rows.select("part").distinct(), "part", "left_anti").select("major", F.lit(0).cast("long").alias("minor"), "text")
    return reduce(DataFrame.unionByName, [spark.createDataFrame(fixed, "major int, minor long, text string"), body, figures, lost, found, missing])


def write_page(analysis, log_id: str, folder: str, output: str | None = None, source: str | None = None, **how) -> None:
    """One log's page as text files of ``folder`` that follow each other, written by the tasks; nothing passes the driver.

    ``output``: a file in a folder that the driver sees, into which the parts are copied one after the other; ``folder``
    must then be mounted.
    """
    if output is not None:
        check_output(source, output)
    spark = analysis.transactions.sparkSession
    path = fresh(spark, "cells")
    cells(analysis).filter(F.col("log_id") == log_id).write.parquet(path)
    lines = page_lines(spark.read.parquet(path), log_id, **how)
    lines.orderBy("major", "minor").select("text").write.mode("overwrite").text(folder)
    if output is not None:
        with open(output, "wb") as whole:
            for name in sorted(n for n in os.listdir(mounted(folder)) if n.startswith("part-")):
                with open(os.path.join(mounted(folder), name), "rb") as part:
                    shutil.copyfileobj(part, whole)


def render(analysis, log_id: str, **how) -> str:
    """The same page as one text, for logs that are read on a screen."""
    lines = page_lines(cells(analysis), log_id, **how).orderBy("major", "minor")
    return "".join(r["text"] + "\n" for r in lines.toLocalIterator())


def write(text: str, output: str | None, source: str | None = None) -> None:
    """To standard output first, then to a file whose path was checked before."""
    if output is not None:
        check_output(source, output)
    print(text, end="")
    if output is not None:
        with open(output, "w", encoding="utf-8") as f:
            f.write(text)


def ledger_table(analysis) -> DataFrame:
    """All logs' ledgers as a table, for results that are too large for a page."""
    return analysis.transactions.select("log_id", "line_number", "source_text", "occurred_on", "description", "amount", "category", "treatment", "policy_note", "issues")
