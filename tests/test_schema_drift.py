import json

from chunkloom.operators import schema_drift as sd

SCHEMA = "layer_id bigint, version_no int, attributes string, text string, layer string, fields string"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, "t", "l", "f") for a, b, c in rows], SCHEMA)


def changed(spark, rows):
    return {tuple(r) for r in sd.changes(frame(spark, rows), "layer_id", "version_no", "attributes").collect()}


def test_tags():
    tags = {p: t for p, t, _, _ in sd.tagged_fields('{"a": 1, "b": 1.0, "c": 1e2, "d": [1, 2.5], "e": [[1, 1], [2.0]], "f": {}, "g": null, "h": [], "i": [null, 1], "j": ["x", 1], "k": {"l": true, "m": [{}]}}')}
    assert tags == {"a": "integer", "b": "double", "c": "double", "d": "array<double>", "e": "array<array<double>>", "f": "object", "g": "null", "h": "array<>", "i": "array<integer>", "j": "array<integer|string>", "k.l": "boolean", "k.m": "array<object>"}
    for bad in ("", "nope", "[1]", "3", '{"a": NaN}', '{"a": 1', None):
        assert sd.tagged_fields(bad) is None


def test_changes(spark):
    rows = [
        (1, 1, '{"a": 1, "b": {"c": [1, 2]}, "n": null, "t": "x"}'),
        (1, 2, "{broken"),
        (1, 5, '{"A": 1.0, "b": {"c": [1, 2.5]}, "n": 3, "u": 4}'),
        (1, 5, '{"A": 1.0, "b": {"c": [1, 2.5]}, "n": 3, "u": 4}'),
        (1, 300, '{"A": "1", "b": {}, "n": null}'),
        (2, 1, '{"x": true}'), (2, 2, None), (2, 3, '{"y": 1}'),
        (None, 1, '{"a": 1}'), (None, 2, "{}"), (3, None, "{}"), (4, 9, '{"only": 1}'),
    ]
    assert changed(spark, rows) == {
        (1, 5, "renamed", "A"), (1, 5, "retyped", "b.c"), (1, 5, "removed", "t"), (1, 5, "added", "u"),
        (1, 300, "retyped", "A"), (1, 300, "removed", "b.c"), (1, 300, "added", "b"), (1, 300, "removed", "u"),
        (2, 3, "added", "y"), (2, 3, "removed", "x"),
    }


def test_a_hot_layer_is_chained_across_blocks(spark):
    rows = [(1, v, json.dumps({f"f{v}": v})) for v in range(0, 2000, 7)]
    got = changed(spark, rows)
    assert got == {(1, v, k, f) for v in range(7, 2000, 7) for k, f in (("added", f"f{v}"), ("removed", f"f{v - 7}"))}


def test_fused_schema_and_branches(spark):
    rows = [(1, 1, '{"r": [1, 2]}'), (1, 2, '{"r": "1,2.5"}'), (1, 3, '{"r": [1, 2.0]}'), (2, 4, '{"r": true}'), (2, 5, "x"), (2, 6, '{"r": 7}')]
    fused = {(r["field_path"], r["tag"]): (r["n_documents"], r["first_version"]) for r in sd.fused_schema(frame(spark, rows), "version_no", "attributes").collect()}
    assert fused == {("r", "array<integer>"): (1, 1), ("r", "string"): (1, 2), ("r", "array<double>"): (1, 3), ("r", "boolean"): (1, 4), ("r", "integer"): (1, 6)}
    t = {r["version_no"]: r for r in sd.typed_branches(frame(spark, rows), ["layer_id", "version_no"], "attributes").collect()}
    assert t[2]["canonical_numbers"] == [1.0, 2.5] and t[2]["as_string"] == "1,2.5" and t[1]["canonical_numbers"] == [1.0, 2.0] and t[1]["as_json"] == "[1,2]"
    assert t[4]["as_boolean"] is True and t[4]["canonical_numbers"] is None and t[6]["as_integer"] == 7


def test_sparse_version_numbers_and_appearing_alternatives(spark):
    big = 17
    rows = [(1, v * 6_000_011 + big, json.dumps({"a": v % 2 or "x"})) for v in range(300)] + [(2, 5, '{"a": 1}'), (2, 5, '{"a": 1}'), (2, 5, '{"b": 1}')]
    got = changed(spark, rows)
    assert {g for g in got if g[0] == 1} == {(1, v * 6_000_011 + big, "retyped", "a") for v in range(1, 300)}
    assert len({g for g in got if g[0] == 2}) == 1  # one number with two contents: compared in some fixed order
    found = {(r["layer"], r["field_path"], r["tag"]): (r["first_version"], r["n_tags"]) for r in sd.appearing(frame(spark, rows), "layer_id", "version_no", "attributes").collect()}
    assert found == {(1, "a", "string"): (big, 2), (1, "a", "integer"): (big + 6_000_011, 2), (2, "a", "integer"): (5, 1), (2, "b", "integer"): (5, 1)}


def test_empty(spark):
    assert changed(spark, []) == set()
