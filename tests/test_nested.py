import json

from veilscan.operators import nested


def reports(spark, bodies):
    return spark.createDataFrame([(i, "t", b if b is None or isinstance(b, str) else json.dumps(b), "extra") for i, b in bodies], "report_id bigint, target string, body string, path string")


USUAL = {"findings": [{"m": "a", "metadata": {"hits": [{"p": 1}, {"p": 2}]}}]}


def paths(spark, bodies):
    return {(r.report_id, r.parent_path, r.path) for r in nested.bridge(nested.occurrences(reports(spark, bodies))).collect()}


def test_paths_and_parents(spark):
    body = {"findings": [None, {"metadata": {"planes": [[{"x": 1}], []], "hits": {"p": 3}}}, {"metadata": json.dumps({"hits": [{"p": 4}]})}]}
    got = paths(spark, [(1, USUAL), (2, USUAL), (3, body)])
    assert {g for g in got if g[0] == 3} == {
        (3, "report", "findings[1]"), (3, "report", "findings[2]"), (3, "findings[1]", "findings[1].metadata.planes[0][0]"),
        (3, "findings[1]", "findings[1].metadata.hits[0]"), (3, "findings[2]", "findings[2].metadata.hits[0]"),
    }


def test_wrapped_lone_and_decoy(spark):
    decoy = {"findings": {"m": "a", "evidence": '{"items": [{"k": 1}]}'}}
    wrapped = {"findings": json.dumps(json.dumps([{"m": "b"}]))}
    got = paths(spark, [(1, USUAL), (2, USUAL), (4, decoy), (5, wrapped), (6, '{"findings": [{'), (7, None), (8, "[]"), (None, USUAL), (9, {})])
    assert {g for g in got if g[0] and g[0] > 2} == {(4, "report", "findings[0]"), (5, "report", "findings[0]")}


def test_identical_objects_are_stored_once(spark):
    found = nested.occurrences(reports(spark, [(1, USUAL), (1, USUAL), (2, '{"findings": [{"metadata": {"hits": [{"p":1}, {"p": 2}]}, "m": "a"}]}')]))
    assert nested.bridge(found).count() == 6
    rows = nested.objects(found).collect()
    assert len(rows) == 3 and all(r.n_reports == 2 for r in rows)
    links = nested.bridge(found).collect()
    assert {r.parent_object for r in links if r.parent_path != "report"} == {r.object_id for r in links if r.path == "findings[0]"}


def test_deep_and_empty(spark):
    deep = "x"
    for _ in range(150):
        deep = {"layers": [{"metadata": deep}]}
    assert len(paths(spark, [(1, deep)])) == 150
    assert paths(spark, []) == set()


def test_every_object_and_scalar_comes_out(spark):
    body = {"id": 7, "report": {"x": True}, "findings": [{"m": "a", "metadata": {"n": 1.5, "tags": ["t", None, []], "hits": [{"p": 1}]}}]}
    found = nested.occurrences(reports(spark, [(1, body)]))
    links = {(r.parent_path, r.path, r.ordinal): (r.parent_object, r.object_id) for r in nested.full_bridge(found).collect()}
    assert set(links) == {
        (None, "report", 0), ("report", "report", None), ("report", "findings[0]", 0), ("findings[0]", "findings[0].metadata", None),
        ("findings[0].metadata", "findings[0].metadata.hits[0]", 0),
    }
    known = {r.object_id for r in nested.full_objects(found).collect()}
    assert known == {oid for _, oid in links.values()} and {p for p, _ in links.values()} - {None} <= known
    own = {path: oid for (p, path, n), (_, oid) in links.items() if n is not None or path != "report"}
    assert {(r.object_id, r.field, r.value, r.kind) for r in nested.scalars(found).collect()} == {
        (own["report"], "id", "7", "number"), (links["report", "report", None][1], "x", "true", "boolean"), (own["findings[0]"], "m", "a", "string"),
        (own["findings[0].metadata"], "n", "1.5", "number"), (own["findings[0].metadata"], "tags[0]", "t", "string"), (own["findings[0].metadata"], "tags[1]", None, "null"),
        (own["findings[0].metadata"], "tags[2]", "[]", "array"), (own["findings[0].metadata.hits[0]"], "p", "1", "number"),
    }
