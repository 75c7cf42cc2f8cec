import datetime as dt
import json
import random
import re
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyframe.operators import compaction, grading, policies, rollout
from tallyframe.sources import rollout as source


def item(**payload):
    return json.dumps({"type": "response_item", "payload": payload})


def said(role, text):
    return item(type="message", role=role, content=[{"type": "text", "text": text}])


RECORDS = [
    said("user", "Please check the site."),
    said("assistant", "<recommended_plugins> none"),
    item(type="custom_tool_call", call_id="a", name="exec", input="curl one"),
    item(type="custom_tool_call", call_id="b", name="exec", input="curl two"),
    item(type="custom_tool_call_output", call_id="b", output='{"session_id": 7} started'),
    item(type="custom_tool_call", call_id="p", name="exec", input="tools.write_stdin({session_id: 7})"),
    item(type="custom_tool_call_output", call_id="p", output=[{"type": "t", "text": "more"}, {"type": "t", "text": '{"session_id": 8}'}]),
    item(type="custom_tool_call", call_id="q", name="exec", input="tools.write_stdin({'session_id': 8})"),
    item(type="custom_tool_call_output", call_id="q", output={"done": True}),
    item(type="custom_tool_call_output", call_id="a", output="HTTP/2 200"),
    item(type="custom_tool_call_output", call_id="zz", output="nobody asked"),
    json.dumps([1, 2]),
    said("system", "ignored"),
    said("assistant", ""),
    said("assistant", "All is well."),
    said("assistant", "Later."),
]


def window(spark, path, cutoff=13, records=RECORDS):
    path.write_text("\n".join(records) + "\n")
    lines = source.raw_lines(spark, str(path))
    assert source.invalid_lines(lines).count() == 0
    trials = lines.select("trial_id").distinct().select("trial_id", F.lit(1).cast("long").alias("start_line"), F.lit(cutoff).cast("long").alias("cutoff_line"))
    return source.records(lines), trials


def test_segments_and_polls(spark, tmp_path):
    records, trials = window(spark, tmp_path / "log.jsonl")
    parts = rollout.segments(records, trials)
    assert [r.id for r in parts.orderBy("position").collect()] == ["message_1", "tool_4", "tool_6", "tool_8", "tool_3"]
    merged = rollout.merge_polls(parts).orderBy("position").collect()
    assert [r.id for r in merged] == ["message_1", "tool_4", "tool_3"]
    assert merged[1].text == "exec: curl two\n[continued by poll]\nexec: tools.write_stdin({session_id: 7})\n[continued by poll]\nexec: tools.write_stdin({'session_id': 8})"
    assert merged[1].result.split("\n[continued output]\n")[1] == 'more\n{"session_id": 8}' and json.loads(merged[1].result.split("\n[continued output]\n")[2]) == {"done": True}
    assert rollout.held_out_answers(records, trials).first().answer == "All is well."
    assert rollout.repeated_call_ids(records).count() == 0
    digest = source.file_digests(spark, str(tmp_path / "log.jsonl")).first().source_sha256
    assert len(digest) == 64


def test_window_problems(spark, tmp_path):
    records, trials = window(spark, tmp_path / "log.jsonl", 5, RECORDS[2:5] + [RECORDS[2]])
    merged = rollout.merge_polls(rollout.segments(records, trials))
    calls = records.filter("type = 'custom_tool_call'").select("trial_id", "call_id", F.col("line_number").alias("call_line"))
    done = records.filter("type = 'custom_tool_call_output'").select("trial_id", "call_id")
    pending = rollout.unmatched_calls(calls, done, ["trial_id", "call_id"])
    found = rollout.window_problems(trials, merged, rollout.held_out_answers(records, trials), pending).first().problems
    assert found == ["needs a later assistant answer", "contains 2 unfinished tool calls at lines [1, 4]", "needs a user message"]
    assert rollout.repeated_call_ids(records).count() == 1
    broken = spark.createDataFrame([("t", 1, "{"), ("t", 2, "[]")], "trial_id string, line_number long, line string")
    assert [r.line_number for r in source.invalid_lines(broken).collect()] == [1]


def test_selection_sizes_and_requests(spark, tmp_path):
    records, trials = window(spark, tmp_path / "log.jsonl")
    parts = rollout.merge_polls(rollout.segments(records, trials))
    trial = trials.first().trial_id
    decided = spark.createDataFrame([(trial, "tool_4", 0.49), (trial, "tool_3", 0.5)], "trial_id string, id string, probability double")
    picked = compaction.select_segments(parts, decided)
    assert {r.id: r.kept for r in picked.collect()} == {"message_1": True, "tool_4": False, "tool_3": True}
    rows = picked.collect()
    total = sum(len(r.text) + len(r.result or "") for r in rows)
    left = sum(len(r.text) + len(r.result or "") for r in rows if r.kept)
    size = compaction.sizes(picked).first()
    assert (size.original, size.retained, float(size.reduction_percent)) == (total, left, round(100 * (total - left) / total, 1))
    assert {r.id: r.kept for r in compaction.recency_selection(parts, 1).collect()} == {"message_1": True, "tool_4": False, "tool_3": True}
    about = compaction.describe(parts).first()
    assert about.messages == 1 and set(about.tool_characters) == {"tool_3", "tool_4"}
    asked = compaction.questions(parts)
    assert asked.count() == 2 and "tool_3" in asked.filter("id = 'tool_3'").first().instructions
    goals = spark.createDataFrame([(trial, "check with Bearer abcdefghijklmnop")], "trial_id string, goal string")
    entries = compaction.state(parts, goals)
    assert entries.first().current_goal == "check with [REDACTED]"
    fits = compaction.request_sizes(entries, asked).first()
    assert fits.fits and fits.size > 500
    assert compaction.differences(entries, compaction.state(parts, goals)).count() == 0
    assert compaction.state(parts, goals, "excerpt").count() == 3


def plain_excerpt(result, goal):
    """What an excerpt must be, by sorted windows."""
    if result is None or len(result) <= 500:
        return result
    text = result.replace("\r\n", "\n").replace("\\n", "\n")
    terms = sorted(set(re.findall("[a-z][a-z0-9.-]{4,}", (goal or "").lower())) - {"about", "because", "could", "there", "their", "these", "would"})
    found = []
    for term in terms:
        for m in [*re.finditer(re.escape(term), text.lower())][:6]:
            start = max(0, m.start() - 65)
            piece = text[start : m.end() + 90].replace("\n", " ")
            found.append((-len([t for t in terms if t in piece.lower()]), start, len(found), piece))
    found.sort()
    kept = found[:1] + [w for w in found if abs(w[1] - found[0][1]) > 140][:1]
    middle = "\n".join(w[3] for w in sorted(kept, key=lambda w: w[1]))
    return text[:120] + "\n[Relevant source excerpts]\n" + middle[:360] + "\n[End]\n" + text[-70:]


def test_excerpts(spark):
    rng = random.Random(5)
    words = ["server", "certificate", "ready.", "ready.now", "a-b-c-d", "Server", "x\ny", "\\n", "\r\n", "would", "none", "é" * 9, "ab+cd", "there", "servers"]
    rows = [("x" * 500, "goal"), (None, "goal"), ("y" * 900, None), ("certificate " * 90, "the certificate of the server")]
    rows += [(" ".join(rng.choices(words, k=rng.randint(40, 300))), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for _ in range(150)]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, result string, goal string").select("k", compaction.excerpt(F.col("result"), F.col("goal")).alias("e")).collect()
    assert {r.k: r.e for r in got} == {k: plain_excerpt(*r) for k, r in enumerate(rows)}


def test_request_sizes_are_those_of_the_json_text(spark):
    rows = [("t", k, f"tool_{k}" if k else "message_1", 'a "q" \\ \n\t\x01 é👍' * k, None if k % 2 else "r/</>") for k in range(4)] + [("u", 0, "message_9", "alone", None)]
    parts = spark.createDataFrame(rows, "trial_id string, position long, id string, text string, result string").withColumn("kind", F.when(F.col("id").startswith("tool"), "tool").otherwise("user"))
    entries = compaction.state(parts, spark.createDataFrame([("t", 'goal "x"\n'), ("u", None)], "trial_id string, goal string"))
    asked = compaction.questions(parts)
    wordings = {}
    for r in asked.collect():
        wordings.setdefault(r.trial_id, {})[r.id] = r.instructions
    told = {}
    for r in entries.orderBy("position").collect():
        told.setdefault(r.trial_id, (r.current_goal or "", []))[1].append({k: v for k in ("id", "kind", "text", "call", "result", "full_result_characters") if (v := r[k]) is not None})
    want = {k: len(json.dumps({"current_goal": goal, "timeline": t, "questions": wordings.get(k, {})}, ensure_ascii=False)) for k, (goal, t) in told.items()}
    assert {r.trial_id: r["size"] for r in compaction.request_sizes(entries, asked).collect()} == want


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), "run int, line_number int, source_text string, merchant string, occurred_on date, amount decimal(18,2), treatment string, category string")


def reference(spark):
    day = dt.date(2026, 6, 1)
    rows = [
        (1, "a", "A", day, D(10), "Dining", "2026-06", True, None, None),
        (2, "b", "B", day, D(20), "Shopping", "2026-06", True, "p1", ["Dining"]),
        (3, "c", "C", day, D(30), "Dining", "2026-06", True, "p2", ["Other"]),
        (4, "d", "D", day, D(40), "Dining", "2026-06", False, None, None),
    ]
    return spark.createDataFrame(rows, "line_number int, source_text string, merchant string, occurred_on date, amount decimal(18,2), category string, period string, is_counted boolean, policy_name string, alternatives array<string>")


def test_ledger_and_bucket_differences(spark):
    day, inc = dt.date(2026, 6, 1), "included_spending"
    got = lines(spark, (1, 1, "a", "A", day, D(10), inc, "Dining"), (1, 2, "b", "X", day, D(20), inc, "Dining"), (1, 4, "d", "D", day, D(41), inc, "Dining"), (1, 5, "e", "E", day, D(5), inc, "Dining"))
    found = {r.line_number: r.differences for r in grading.line_differences(reference(spark), got).collect()}
    assert found == {2: ["merchant"], 3: ["missing"], 4: ["amount", "counted"], 5: ["extra"]}
    gaps = policies.separable_differences(reference(spark), got, got.select("line_number"), "Dining", "2026-06")
    best = policies.best_subset(policies.scores(gaps, policies.touching(reference(spark), "Dining", "2026-06")))
    row = best.first()
    assert (row.applied, row.ordinal, row.n, row.effect) == (["p1", "p2"], 3, 2, D(46))
    assert {(r.line_number, r.kind, r.effect) for r in policies.differences_under(gaps, best).collect()} == {(4, "extra", D(41)), (5, "extra", D(5))}
    rest = spark.range(1).select(grading.unexplained(F.lit(D("76.00")), F.lit(D("30.00")), F.lit(D("46.00"))).alias("a"), grading.unexplained(F.lit(D("77.00")), F.lit(D("30.00")), F.lit(D("46.00"))).alias("b")).first()
    assert rest.a is None and rest.b == D(1)


def test_facts_checks_and_scorecard(spark):
    day = dt.date(2026, 6, 1)
    got = lines(spark, (1, 1, "a", "A", day, D(-3), "included_spending", "Dining"), (1, 2, "b", "B", day, D(3), "excluded_duplicate", "Dining"), (1, 3, "c", "C", day, D(3), "uncategorized_credit", "Uncategorized"))
    schema = "fact_name string, reader string, category string, period string, from_period string, to_period string, line_numbers array<int>"
    readers = spark.createDataFrame(
        [("budget", "budget_status", "Dining", "2026-06", None, None, None), ("none", "budget_status", "Pets", "2026-06", None, None, None), ("refund", "refund_treatment", None, None, None, None, [1]), ("gone", "refund_treatment", None, None, None, None, [9]),
         ("dup", "duplicate_excluded", None, None, None, None, [2]), ("all", "lines_counted", None, None, None, None, [1, 2]), ("unc", "uncategorized_count", None, None, None, None, None), ("up", "largest_increase", None, None, "2026-06", "2026-07", None), ("flat", "largest_increase", None, None, "2026-07", "2026-08", None)], schema)
    budgets = spark.createDataFrame([(1, "Dining", "2026-06", D(9), D(8))], "run int, category string, period string, actual decimal(18,2), target decimal(18,2)")
    changes = spark.createDataFrame([(1, "Pets", "2026-06", "2026-07", D(5)), (1, "Dining", "2026-06", "2026-07", D(7))], "run int, category string, from_period string, to_period string, change decimal(18,2)")
    facts = grading.read_facts(readers, got, budgets, changes)
    assert {r.fact_name: r.fact_value for r in facts.collect()} == {"budget": "over", "none": "not_stated", "refund": "netted_against_spending", "gone": "not_mentioned", "dup": "true", "all": "false", "unc": "1", "up": "Dining", "flat": None}
    runs = got.select("run").distinct()
    checks = spark.createDataFrame([("c1", "refund", ["NETTED_against_spending"]), ("c2", "flat", ["x"])], "check_name string, fact_name string, accepted array<string>")
    amounts = spark.createDataFrame([("c3", "Dining", "2026-06", [D("8.99"), D(1)]), ("c4", "Pets", "2026-06", [D(0)])], "check_name string, category string, period string, accepted array<decimal(18,2)>")
    buckets = budgets.select("run", "category", "period", F.col("actual").alias("amount"))
    used = grading.set_differences(budgets.select("category", "target"), budgets.select("category", (F.col("target") + 1).cast("decimal(18,2)").alias("target")))
    assert {r.side for r in used.collect()} == {"invented", "missing"}
    judged = spark.createDataFrame([(1, "c6", None), (1, "c7", True)], "run int, check_name string, passed boolean")
    grades = grading.grade_facts(checks, facts).unionByName(grading.grade_amounts(amounts, buckets, runs)).unionByName(grading.grade_empty("c5", runs.limit(0), runs)).unionByName(grading.grade_judgments(judged))
    assert {r.check_name: r.status for r in grades.collect()} == {"c1": "passed", "c2": "failed", "c3": "passed", "c4": "failed", "c5": "passed", "c6": "errored", "c7": "passed"}
    card = grading.scorecard(grades, spark.createDataFrame([("c1", 1.0), ("c6", 1.0)], "check_name string, minimum_pass_rate double"))
    assert {r.check_name: (r.pass_rate, r.errored, r.meets_minimum) for r in card.collect()}["c6"] == (0.0, 1, False)


def test_projection(spark):
    rows = spark.createDataFrame([(1, "s", "A", dt.date(2026, 6, 1), D(1), "included_spending", "dining_coffee")], "line_number int, source_text string, description string, occurred_on date, amount decimal(18,2), treatment string, category string")
    names = spark.createDataFrame([("dining_coffee", "Dining")], "category string, reference_category string")
    assert grading.project(rows, names, 3).first().asDict() == {"line_number": 4, "source_text": "s", "merchant": "A", "occurred_on": dt.date(2026, 6, 1), "amount": D("1.00"), "treatment": "included_spending", "category": "Dining"}
    month = spark.createDataFrame([(dt.date(2026, 6, 1), "dining_coffee", D(1), [1, 2])], "month date, category string, amount decimal(18,2), lines array<int>")
    assert tuple(grading.project_buckets(month, names, 3).first()) == ("Dining", "2026-06", D("1.00"), [4, 5])
