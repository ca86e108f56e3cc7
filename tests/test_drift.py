import datetime as dt
import json

from veilscan.operators import drift

SCHEMA = "file_name string, suite string, lane string, line_no int, generated_at timestamp, ingested_at timestamp, line string, field string, prev string"


def lines(spark, files):
    rows = []
    for lane, stamp, records in files:
        for n, r in enumerate(records):
            rows.append((f"s-{lane}-{stamp}.json", "s", lane, n, None, dt.datetime(2031, 1, 1), r if isinstance(r, str) else json.dumps(r), "x", "y"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return {(r.file_name[-21:-5], r.old_field, r.new_field, r.change_kind) for r in drift.schema_changes(lines(spark, files)).collect()}


A, B, C = "20310101T000000Z", "20310102T000000Z", "20310103T000000Z"


def test_every_kind_of_change(spark):
    first = [{"name": f"n{i}", "bypass": i % 3 == 0, "gone": "soon over", "methods": ["a", "b"]} for i in range(9)]
    second = [{"name": f"n{i}", "bypassed": i % 3 == 0, "methods": "a,b", "fresh": i * 7.5} for i in range(9)]
    got = changes(spark, [("l1", B, second), ("l1", A, first), ("l2", C, first)])
    assert got == {(B, "bypass", "bypassed", "renamed"), (B, "gone", "", "removed"), (B, "methods", "methods", "retyped"), (B, "", "fresh", "added")}


def test_unrelated_fields_are_no_rename_and_noise_is_ignored(spark):
    first = [{"name": f"n{i}", "notes": f"the quiet fox number {i}", "m": []} for i in range(6)] + ['{"name": "cut', "[1, 2]", "null"]
    second = [{"name": f"n{i}", "tool_version": "0.6.0", "m": None} for i in range(6)] + [{"name": 5}]
    got = changes(spark, [("l", A, first), ("l", A, first), ("l", B, second)])
    assert got == {(B, "notes", "", "removed"), (B, "", "tool_version", "added")}


def test_empty_and_unreadable(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [("l", A, ["{"]), ("l", B, ["{"])]) == set()


def test_one_table(spark):
    table = drift.unified_table(lines(spark, [("l", A, [{"clean": True, "n": 1}, {"clean": False, "n": 2}]), ("l", B, [{"is_clean": True, "n": "many"}, {"is_clean": False, "n": 4.5}, {"n": 5}])]))
    rows = {(r.file_name[-21:-5], r.line_no): r for r in table.collect()}
    assert [rows[k].f_clean if "f_clean" in table.columns else rows[k].f_is_clean for k in sorted(rows)] == [True, False, True, False, None]
    assert [rows[k].f_n for k in sorted(rows)] == [1, 2, None, 4.5, 5]
    assert rows[B, 0].unfit == {"n": "many"} and rows[B, 1].unfit == {}
    assert rows[B, 0].generated_at == dt.datetime(2031, 1, 2)


def test_lattice():
    assert drift.promote({"number", "boolean", None}) == "number"
    assert drift.promote({"array<string>", "string"}) == "string"
    assert drift.promote({None}) == "string" and drift.promote({"object"}) == "object"


def test_two_names_that_one_line_holds_stay_two_columns(spark):
    first = [{"id": i, "note": f"the text of number {i}"} for i in range(9)]
    second = [{"id": i, "remark": f"the text of number {i}"} for i in range(9)]
    both = [{"id": i, "note": f"note {i}", "remark": f"remark {i}"} for i in range(9)]
    rows = lines(spark, [("a", A, first), ("a", B, second), ("b", A, both)])
    assert ("renamed", "note", "remark") in {(r.change_kind, r.old_field, r.new_field) for r in drift.schema_changes(rows).collect()}
    table = drift.unified_table(rows)
    got = {(r.lane, r.line_no, r.file_name[-21:-5]): (r.f_note, r.f_remark) for r in table.collect()}
    assert got["b", 3, A] == ("note 3", "remark 3") and got["a", 3, A] == ("the text of number 3", None) and got["a", 3, B] == (None, "the text of number 3")
