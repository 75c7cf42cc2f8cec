from pyspark.sql import functions as F

from tallyframe.sources import json_files

SCHEMA = "a long, b struct<c:string,d:array<struct<e:double>>>, m map<string,boolean>, day date, n decimal(5,2)"


def test_problems_have_line_path_and_types(spark, tmp_path):
    lines = [
        '{"a": 1, "b": {"c": "x", "d": [{"e": 1}, {"e": 2.5}, null]}, "m": {"any": true}, "day": "2024-01-02", "n": 1.5}',
        '{"a": null, "b": null}',
        '{"a": "1", "z": {"y": 1}}',
        '{"b": {"c": 5, "d": [{"e": 1, "f": []}, {"e": "no"}], "q": null}}',
        '{"m": {"u": 1, "v": false}, "day": "2024-13-02", "n": 12345.5}',
        '{"b": [1]}',
        "[1]",
        "not json",
        "",
        '{"a": 9.5}',
    ]
    (tmp_path / "x.json").write_text("\n".join(lines) + "\n")
    got = sorted((r.line_number, r.path, r.expected, r.found) for r in json_files.type_problems(spark, str(tmp_path), SCHEMA).collect())
    assert got == sorted([
        (3, "a", "bigint", "STRING"),
        (3, "z", "no such field", "OBJECT<y: BIGINT>"),
        (4, "b.c", "string", "BIGINT"),
        (4, "b.d[].f", "no such field", "ARRAY<VOID>"),
        (4, "b.d[].e", "double", "STRING"),
        (4, "b.q", "no such field", "VOID"),
        (5, "m.u", "boolean", "BIGINT"),
        (5, "day", "date", "STRING"),
        (5, "n", "decimal(5,2)", "DECIMAL(6,1)"),
        (6, "b", "object", "ARRAY<BIGINT>"),
        (7, "", "object", "ARRAY<BIGINT>"),
        (8, "", "object", "no JSON"),
        (10, "a", "bigint", "DECIMAL(2,1)"),
    ])
    rows = {r.line_number: r.row for r in json_files.checked(spark, str(tmp_path), SCHEMA).collect()}
    assert rows[1].a == 1 and rows[1].b.d[1].e == 2.5 and rows[1].m == {"any": True} and str(rows[1].n) == "1.50"


def test_whole_files_and_arrays(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n"a": 1\n}')
    (tmp_path / "many.json").write_text('[{"a": 2},\n {"a": 3}]')
    assert sorted(r.a for r in json_files.read_typed(spark, str(tmp_path), "a long", lines=False).collect()) == [1, 2, 3]
    assert json_files.read_typed(spark, str(tmp_path), "a long", lines=False).agg(F.sum("a")).first()[0] == 6
