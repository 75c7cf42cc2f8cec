import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import evidence as ev
from tallyframe.functions import formatting as fm
from tallyframe.operators import decisions, findings, parsing, policy, reconcile, report, totals
from tallyframe.plans import expense
from tallyframe.sources import json_files, providers, text
from tallyframe.sources.settings import Settings


def parsed(spark, *lines):
    return parsing.parse(text.from_lines(spark, list(lines))).orderBy("line_number").collect()


@pytest.mark.parametrize(
    "line, date, name, amount, issues",
    [
        ("2026-06-01 | Corner Market | $82.18", dt.date(2026, 6, 1), "Corner Market", "82.18", []),
        ("- June 1, 2026  Joe's  $1,082.18", dt.date(2026, 6, 1), "Joe's", "1082.18", []),
        ("6/2/26: Internet, 64.99", dt.date(2026, 6, 2), "Internet", "64.99", []),
        ("Sept. 3 2026 Shop ($5.00)", dt.date(2026, 9, 3), "Shop", "-5.00", []),
        ("2026-06-01 REI refund $68.00", dt.date(2026, 6, 1), "REI", "-68.00", []),
        ("2026-06-01 no refund REI $68.00", dt.date(2026, 6, 1), "no refund REI", "68.00", []),
        ("2026-06-01 Return processed - REI -$68.00", dt.date(2026, 6, 1), "REI", "-68.00", []),
        ("2026-06-01 refund $68.00", dt.date(2026, 6, 1), "refund", "-68.00", []),
        ("2026-02-30 Shop $1.00", None, "Shop", "1.00", ["invalid_date"]),
        ("0000-02-03 Shop $1.00", None, "Shop", "1.00", ["invalid_date"]),
        ("6/2 Shop $1.00", None, "Shop", "1.00", ["year_not_inferable"]),
        ("2026-06-01 2026-06-02 Shop $1.00 $2.00", None, "Shop", None, ["multiple_dates", "multiple_amounts"]),
        ("Shop", None, "Shop", None, ["missing_date", "missing_amount"]),
        ("2026-06-01 balance of: $5.00", dt.date(2026, 6, 1), "balance of", None, ["nontransaction_amount"]),
        ("2026-06-01 $5.00", dt.date(2026, 6, 1), None, "5.00", ["missing_description"]),
        ("2026-06-01 Shop 5.0 12.345 x1.00 é1.00", dt.date(2026, 6, 1), "Shop 5.0 12.345 x1.00 é1.00", None, ["missing_amount"]),
    ],
)
def test_field_parsing(spark, line, date, name, amount, issues):
    (row,) = parsed(spark, line)
    assert (row.occurred_on, row.description, row.amount, row.issues) == (date, name, amount and D(amount), issues)


def test_year_inference(spark):
    years = lambda *lines: parsing.infer_years(parsing.year_evidence(text.from_lines(spark, list(lines)))).collect()
    assert years("2026-06-01 a $1.00", "6/2 b $1.00")[0].inferred_year == 2026
    assert years("12/30 a $1.00", "2027-01-02 b $1.00")[0].inferred_year is None
    assert years("2026-12-30 a $1.00", "2026-01-02 b $1.00")[0].inferred_year == 2026
    assert years("2026-12-30 a $1.00", "2025-12-30 b $1.00")[0].inferred_year is None
    assert years("2026-06-01 a", "13/40 b", "6/2 c")[0].inferred_year == 2026
    assert years("nothing") == []


def test_many_logs_are_parsed_apart(spark):
    both = text.from_lines(spark, ["2026-06-01 a $1.00", "6/2 b $1.00"], "x").unionByName(text.from_lines(spark, ["2024-06-01 a $1.00", "6/2 b $1.00"], "y"))
    got = {(r.log_id, r.line_number): r.occurred_on.year for r in parsing.parse(both).collect()}
    assert got == {("x", 1): 2026, ("x", 2): 2026, ("y", 1): 2024, ("y", 2): 2024}


def test_evidence_helpers(spark):
    row = spark.createDataFrame([("paid $7.50; balance $102.00 👍 $3.00",)], "t string").select(
        ev.amount_offset(F.col("t"), 2).alias("at"), ev.amount_matches_source(F.col("t"), F.lit("$7.50")).alias("is"), ev.amount_evidence_is_balance(F.col("t"), F.lit("$102.00")).alias("balance"),
        ev.has_descriptive_text(F.lit("2026-01-01 $1.00")).alias("has"), ev.parse_date_evidence(F.lit("(June 5, 26),"), F.lit(None).cast("int")).alias("day"),
    ).first()
    assert (row["at"], row["is"], row.balance, row.has, row.day) == (30, True, True, False, dt.date(2026, 6, 5))


def tx(spark, *rows):
    schema = "line_number long, occurred_on date, amount decimal(18,2), treatment string, category string, policy_note string"
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], schema).withColumn("log_id", F.lit("log"))


def day(m, d=1):
    return dt.date(2026, m, d)


def ledger(spark):
    inc = "included_spending"
    return tx(
        spark,
        (1, day(1), D("10.10"), inc, "groceries"),
        (2, day(1), D("-2.05"), inc, "groceries"),
        (3, day(1), D("300.00"), inc, "dining_coffee"),
        (4, day(1), D("5.00"), inc, "other", policy.MIXED_NOTE),
        (5, day(1), D("7.00"), "uncategorized_outflow", "uncategorized"),
        (6, day(3), D("20.00"), inc, "groceries"),
        (7, day(3), D("20.00"), "excluded_duplicate", "groceries"),
        (8, day(3), D("-9.00"), "uncategorized_credit", "uncategorized"),
        (9, None, None, "unparsed", None),
    )


def test_totals_budgets_and_changes(spark):
    rows = ledger(spark)
    ct, mt = totals.monthly_category_totals(rows, lines=True), totals.monthly_totals(rows, lines=True)
    assert {(r.month, r.category): (r.amount, r.lines) for r in ct.collect()}[(day(1), "groceries")] == (D("8.05"), [1, 2])
    assert [(r.month, r.classified, r.unresolved, r.observed, r.lines) for r in mt.orderBy("month").collect()] == [
        (day(1), D("313.05"), D("7.00"), D("320.05"), [1, 2, 3, 4, 5]),
        (day(3), D("20.00"), D("0.00"), D("20.00"), [6]),
    ]
    budgets = totals.budget_comparisons(ct, mt, Settings().targets(spark), totals.coverage(rows)).collect()
    got = {(r.month, r.category): (r.actual, r.variance, r.coverage_lines, r.coverage_note) for r in budgets}
    assert got[(day(1), "dining_coffee")][:2] == (D("300.00"), D("40.00")) and got[(day(3), "dining_coffee")][1] == D("-260.00")
    assert got[(day(1), "shopping")][2] == [4] and "(source lines 4)" in got[(day(1), "shopping")][3] and got[(day(3), "shopping")][3] is None
    deltas = totals.delta_order(totals.month_deltas(ct, mt)).collect()
    assert [(r.category, r.change) for r in deltas] == [("dining_coffee", D("-300.00")), ("groceries", D("11.95")), ("other", D("-5.00"))]
    r = totals.reconciliation(rows, ct, mt, lines=True).first()
    assert (r.n_lines, r.duplicates, r.credits, r.unparsed, r.refunds, r.is_balanced, r.observed) == (9, [7], [8], [9], [2], True, D("340.05"))
    twice = rows.unionByName(rows.filter("line_number = 1"))
    assert not totals.reconciliation(twice, totals.monthly_category_totals(twice), totals.monthly_totals(twice)).first().is_balanced


def test_zero_sums_stay_where_one_side_is_not_zero(spark):
    inc = "included_spending"
    rows = tx(spark, (1, day(1), D(5), inc, "pets"), (2, day(1), D(-5), inc, "pets"), (3, day(2), D(1), inc, "travel"), (4, day(3), D(2), inc, "pets"), (5, day(2), D(0), inc, "pets"))
    got = totals.month_deltas(totals.monthly_category_totals(rows, lines=True), totals.monthly_totals(rows)).collect()
    assert {(r.from_month, r.category) for r in got} == {(day(1), "travel"), (day(2), "travel"), (day(2), "pets")}


def test_tie_breaks_differ(spark):
    b = spark.createDataFrame([("log", day(1), "dining_coffee", D(260), D(300), D(40)), ("log", day(2), "dining_coffee", D(260), D(300), D(40))], "log_id string, month date, category string, target decimal(28,2), actual decimal(28,2), variance decimal(28,2)")
    assert totals.ranked_breaches(b).first().month == day(1) and totals.largest_breach(b, "dining_coffee").first().month == day(2)


def test_policy(spark):
    rows = [("Shell", "shopping", "transportation", "Known expense merchant: Shell"), ("TARGET", "shopping", "other", policy.MIXED_NOTE), ("Return processed - REI", "other", "shopping", "Known expense merchant: REI"), ("Venmo - Sam", "gifts_donations", "uncategorized", policy.CASH_NOTE),
            ("Venmo rent", "housing", "housing", None), ("ATM  cash withdrawal", "other", "uncategorized", policy.CASH_NOTE), ("Venmorent", "other", "other", None), (None, "pets", "pets", None)]
    got = policy.apply_policy(spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(rows)], "k int, description string, model_category string")).orderBy("k").collect()
    assert [(r.category, r.policy_note) for r in got] == [r[2:] for r in rows]
    one = text.from_lines(spark, ["2026-06-01 Shop $1.00"])
    bad = spark.createDataFrame([("log", 1, "fun", 1.0, {"fun": 1.0})], "log_id string, line_number int, choice string, confidence double, probabilities map<string,double>")
    with pytest.raises(Exception, match="not a known expense category: fun"):
        policy.categorise(parsing.parse(one), bad).collect()


def decided(spark, *choices):
    rows = [("log", k, c, 1.0, {c: 1.0}) for k, c in enumerate(choices, 1) if c]
    return spark.createDataFrame(rows, "log_id string, line_number int, choice string, confidence double, probabilities map<string,double>")


def test_duplicates_and_treatments(spark):
    shop = "2026-06-01 Shop $1.00"
    lines = text.from_lines(spark, [shop, shop, shop, "2026-06-01 Zelle $4.00", "2026-06-01 Zelle -$4.00", "no", "no"])
    result = policy.categorise(parsing.parse(lines), decided(spark, "shopping", "shopping", "shopping", "other", "other", None, None))
    confirmed = text.confirmations(spark, [2, 3])
    got = reconcile.reconcile(result, confirmed)
    assert [(r.treatment, r.duplicate_of) for r in got.orderBy("line_number").collect()] == [
        ("included_spending", None), ("excluded_duplicate", 1), ("excluded_duplicate", 1), ("uncategorized_outflow", None), ("uncategorized_credit", None), ("unparsed", None), ("unparsed", None),
    ]
    assert reconcile.unmatched_confirmations(got, confirmed).count() == 0
    assert [r.line_number for r in reconcile.unmatched_confirmations(reconcile.reconcile(result, text.confirmations(spark, [4, 7])), text.confirmations(spark, [4, 7])).orderBy("line_number").collect()] == [4, 7]
    assert reconcile.aligned(lines, result).count() == 0 and reconcile.aligned(lines, result.filter("line_number > 1")).count() == 1
    problems = reconcile.input_problems(lines, text.confirmations(spark, [1, 3, 3, 9]))
    assert problems.count() == 3
    with pytest.raises(ValueError, match="repeated"):
        reconcile.validate(problems, "input")
    with pytest.raises(Exception, match="no category"):
        reconcile.reconcile(policy.categorise(parsing.parse(lines), decided(spark, None, "pets")), confirmed).collect()


def test_cascade_of_choices_and_proposals(spark):
    lines = text.from_lines(spark, [
        "2026-08-14 | Grocery Market | $12.50", "2026-08-14 | Cafe refund $8.00 from original $10.00", "Purchased 2026-08-14, posted 2026-08-15 | Garage | $20.00",
        "2026-08-16 | Cafe | charge $7.50; available balance $102.00", "2026-08-17 | Shop | amount pending", "2026-08-17 | Den $3.00 and $4.00",
    ])
    base, years = parsing.parse(lines), parsing.infer_years(parsing.year_evidence(lines))
    table = [(2, "amount", "candidate_1", 0.9), (3, "date", "candidate_2", 0.8), (4, "amount", "candidate_2", 0.99), (6, "amount", "candidate_1", 0.79)]
    choices = spark.createDataFrame([("log", k, f, c, {c: p, "none": 1 - p}) for k, f, c, p in table], "log_id string, line_number int, field string, choice string, probabilities map<string,double>")
    got = {r.line_number: r for r in decisions.apply_choices(base, choices, years).collect()}
    assert got[2].amount == D("-8.00") and got[2].issues == [] and got[3].occurred_on == dt.date(2026, 8, 15)
    assert got[4].amount is None and got[4].issues == ["multiple_amounts"] and got[6].amount is None
    schema = "log_id string, line_number int, attempt int, occurred_on date, date_evidence string, description string, description_evidence string, amount string, amount_evidence string, amount_evidence_index int"
    rows = [("log", 4, 1, None, None, None, None, "102.00", "$102.00", None), ("log", 4, 2, None, None, None, None, "7.50", "$7.50", 0), ("log", 6, 1, None, None, None, None, "5.00", "$4.00", 1), ("log", 5, 1, None, None, "Shop", "Shop", "9.99", "$9.99", 0)]
    merged = {r.line_number: r for r in decisions.merge_attempts(decisions.apply_choices(base, choices, years), spark.createDataFrame(rows, schema), years).collect()}
    assert merged[4].amount == D("7.50") and merged[4].issues == []
    assert merged[5].issues == ["missing_amount", "llm_extraction_failed"] and merged[6].issues == ["multiple_amounts", "llm_extraction_failed"] and merged[1].issues == []


def test_whole_analysis_and_report(spark, tmp_path, capsys):
    lines = text.from_lines(spark, ["2026-06-01 Diner $300.00", "2026-06-02 Target | $50.00", "2026-07-01 Diner $10.00", "2026-07-01 Diner $10.00", "junk|\\"])
    confirmed = text.confirmations(spark, [4])
    result = expense.analyse(lines, decided(spark, "dining_coffee", "shopping", "dining_coffee", "dining_coffee", None), confirmed, keep=str(tmp_path / "kept"))
    expense.validate(lines, confirmed, result)
    assert [r.evidence_id for r in result.findings.orderBy("number").collect()] == ["budget-2026-06-01-dining_coffee", "change-2026-06-01-2026-07-01-dining_coffee", "shopping-coverage"]
    page = report.render(result, "log")
    assert "| June 2026 | Dining & Coffee | $300.00 | 1 |" in page and "| Reconciled | Yes |" in page and "Unable to parse source lines 5." in page
    assert "1. In June 2026, Dining & Coffee was $300.00 against a $260.00 monthly target, $40.00 over target. (Source lines: 1.)" in page and "junk\\|\\\\" in page
    report.write_page(result, "log", str(tmp_path / "parts"), str(tmp_path / "whole.md"), method="so")
    assert (tmp_path / "whole.md").read_text() == page.replace(report.METHOD, "so")
    report.write(page, str(tmp_path / "r.md"))
    assert capsys.readouterr().out == page and (tmp_path / "r.md").read_text() == page
    with pytest.raises(ValueError, match="is the input"):
        report.write(page, str(tmp_path / "r.md"), str(tmp_path / "r.md"))
    wrong = result.selection.withColumn("selected", F.array(F.lit("x"), F.lit("x"), F.lit("shopping-coverage")))
    assert len(findings.selection_problems(wrong, result.evidence, result.required).first().problems) == 3
    with pytest.raises(ValueError, match="confirmed lines"):
        expense.validate(lines, text.confirmations(spark, [3]), expense.analyse(lines, decided(spark, "pets", "pets", "pets", "pets", None), text.confirmations(spark, [3])))


def test_formats(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(fm.money(F.lit("-1234.5").cast("decimal(18,2)"))) == "-$1,234.50" and value(fm.finding_money(F.lit("-5").cast("decimal(18,2)"))) == "$-5.00"
    assert [value(fm.duration_text(F.lit(x))) for x in (9.94, 9.99, 10.5, 59.4, 59.6, 3599.0, 3600.0)] == ["9.9s", "10.0s", "10s", "59s", "1m 00s", "59m 59s", "1h 00m"]
    assert value(fm.pass_rate_text(F.lit(2 / 3))) == "66%" and value(fm.pass_rate_text(F.lit(0.57))) == "57%"
    assert value(fm.strip_code_fence(F.lit(' ```JSON\n{"a": 1}\n``` '))) == '{"a": 1}' and value(fm.strip_code_fence(F.lit(" x "))) == "x"
    assert value(fm.scrub_user_name(F.lit("/Users/sam/x /home/SAM Venmo - Sam /home/samuel"), "sam")) == "/Users/<user>/x /home/<user> Venmo - Sam /home/samuel"
    for a, b in ((443, 356), (400, 399), (2000, 667), (3, 1), (8, 7), (80, 79)):
        assert value(fm.float_reduction_percent(F.lit(a).cast("long"), F.lit(b).cast("long"))) == round(100 * (a - b) / a, 1)
    assert [str(value(fm.reduction_percent(F.lit(a).cast("long"), F.lit(b).cast("long")))) for a, b in ((443, 356), (2000, 667), (400, 399), (1, 1))] == ["19.6", "66.6", "0.2", "0.0"]
    assert value(fm.redact(F.lit('x OPENAI_API_KEY="a\\"b c" sk-abcdefghijkl1 bearer abcdefghijklmnop'))) == "x [REDACTED] [REDACTED] [REDACTED]"


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿head\nmore\n \none\r\ntwo\x0bthree four\n\nfive".encode())
    got = text.read_log(spark, str(tmp_path / "a.txt"), ("head", "more")).orderBy("line_number").collect()
    assert [(r.line_number, r.source_text) for r in got] == list(enumerate(["one", "two", "three", "four", "", "five"], 1))
    assert Settings.from_environment({"DINING_TARGET": "3.5"}).dining_target == D("3.5")
    for bad in ({"DINING_TARGET": "0"}, {"DINING_TARGET": "1.234"}, {"SHOPPING_TARGET": "x"}, {"DECISION_THRESHOLD": "1.1"}):
        with pytest.raises(ValueError):
            Settings.from_environment(bad)
    (tmp_path / "c.json").write_text('{"check_name": "a", "grader": "judge", "other": 1}')
    with pytest.raises(Exception, match=r"line 1: other \(no such field, found BIGINT\)"):
        json_files.read_typed(spark, str(tmp_path / "c.json"), json_files.CHECKS).collect()
    for run, key, rate in (("r1", "k", 1), ("r2", "k", 2), ("r1b", "j", 3)):
        (tmp_path / "cards" / run).mkdir(parents=True)
        (tmp_path / "cards" / run / "scorecard.json").write_text('{\n"key": "%s", "rate": %d}' % (key, rate))
    cards = json_files.latest_scorecards(spark, str(tmp_path / "cards"), ["key"], "key string, rate int").collect()
    assert [(r.key, r.rate) for r in cards] == [("j", 3), ("k", 2)]
    json_files.write_json(spark.createDataFrame([("/home/sam/x",)], "t string"), str(tmp_path / "out"), user_name="sam")
    assert spark.read.json(str(tmp_path / "out")).first().t == "/home/<user>/x"


def test_resources():
    closed = []

    class Thing:
        def __init__(self, fails=False):
            self.fails = fails

        def close(self):
            closed.append(self)
            if self.fails:
                raise OSError("no")

    with pytest.raises(ExceptionGroup), providers.Resources() as held:
        held.add(Thing())
        held.add(Thing(fails=True))
    held.close()
    assert len(closed) == 2


def test_providers(spark, tmp_path):
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise providers.Retryable("busy", 90 if len(calls) == 1 else None)
        return "ok"

    assert providers.with_retries(flaky, waits.append, lambda: 1.0) == "ok" and waits == [60.5, 2.0]
    with pytest.raises(providers.Retryable):
        providers.with_retries(lambda: (_ for _ in ()).throw(providers.Retryable()), waits.append)
    asked = spark.createDataFrame([(k, f"q{k}") for k in range(10)], "k long, q string")
    got = providers.recorded(asked, lambda q: {"k": q["k"], "a": q["q"].upper()}, "k long, a string", str(tmp_path / "answers"))
    assert sorted((r.k, r.a) for r in got.collect()) == [(k, f"Q{k}") for k in range(10)]
    rows = spark.createDataFrame([("a", {"a": 0.5}), ("b", {"a": 0.5}), ("a", {"a": 1.5}), (None, None)], "choice string, probabilities map<string,double>")
    assert providers.choice_problems(rows).count() == 3
    ids = spark.createDataFrame([("t1",), ("t2",)], "id string")
    said = spark.createDataFrame([("t1", 0.5), ("t3", float("nan"))], "id string, probability double")
    assert sorted(r.problem for r in decisions.probability_problems(said, ids, "id").collect()) == ["has no decision", "probability is not in [0, 1]", "was not asked for"]


def test_proposals_and_date_evidence_match_each_pattern_once(spark):
    rows = [("a", 1, "2024-01-02 and 2024-01-03 shop fee 5.00, 7.25"), ("a", 2, "no date shop 7.25"), ("a", 3, None)]
    lines = spark.createDataFrame(rows, "log_id string, line_number long, source_text string")
    made = [("a", 1, 1, dt.date(2024, 1, 3), "2024-01-03", None, None, "7.25", "7.25", 1), ("a", 2, 1, dt.date(2024, 1, 3), "2024-01-03", "shop", "shop", "7.26", "7.25", 0), ("a", 3, 2, dt.date(2024, 1, 3), "2024-01-03", "x", "x", "1.00", "1.00", 0)]
    proposals = spark.createDataFrame(made, "log_id string, line_number long, attempt int, occurred_on date, date_evidence string, description string, description_evidence string, amount string, amount_evidence string, amount_evidence_index int")
    years = spark.createDataFrame([("a", 2024)], "log_id string, inferred_year int")
    merged = decisions.merge_proposals(parsing.parse(lines), proposals, years)
    got = {r.line_number: (r.occurred_on, r.amount, r.issues) for r in merged.collect()}
    assert got[1] == (dt.date(2024, 1, 3), D("7.25"), [])
    assert got[2] == (None, D("7.25"), ["missing_date"])
    assert got[3][:2] == (None, None)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 0 and plan.count("split(source_text") <= 2  # one in the parser, one here
