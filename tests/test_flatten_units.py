import json

from pyspark.sql import functions as F

from chunkloom.operators import flatten, unit_norm

Z3 = "rec_id bigint, layer_id bigint, zinfo string, node_kind string, _v int"


def docs(spark, rows):
    return spark.createDataFrame([(i, i, z, "clash", 0) for i, z in rows], Z3)


def test_flat_nodes(spark):
    ms = [None, {"name": "m", "axes": ["x", {"name": "y"}, None, {}, 5], "datasets": [{"path": "0", "coordinateTransformations": {"type": "scale", "scale": [1]}}, None, {"coordinateTransformations": [None, {"type": "translation"}, {}]}, {}], "coordinateTransformations": [{"type": "scale"}]}]
    rows = [
        (1, json.dumps({"attributes": {"ome": {"multiscales": ms}}})),
        (1, json.dumps({"attributes": {"ome": {"multiscales": ms}}})),
        (2, json.dumps({"attributes": json.dumps({"multiscales": {"name": "one"}})})),
        (3, "{broken"), (4, None), (5, "[]"), (6, '{"attributes": null}'), (7, '{"attributes": {"multiscales": []}}'), (8, ""),
        (9, json.dumps({"attributes": {"multiscales": [{"name": "x" * 100_000}]}})),
    ]
    got = {tuple(r) for r in flatten.flat_nodes(docs(spark, rows), "zinfo", "rec_id").collect()}
    assert got == {
        (1, "multiscale", 1, -1, -1, "m"), (1, "axis", 1, 0, -1, "x"), (1, "axis", 1, 1, -1, "y"), (1, "axis", 1, 3, -1, ""), (1, "axis", 1, 4, -1, ""),
        (1, "dataset", 1, 0, -1, "0"), (1, "dataset", 1, 2, -1, ""), (1, "dataset", 1, 3, -1, ""), (1, "transform", 1, 0, 0, "scale"),
        (1, "transform", 1, 2, 1, "translation"), (1, "transform", 1, 2, 2, ""), (1, "transform", 1, -1, 0, "scale"),
        (2, "multiscale", 0, -1, -1, "one"), (9, "multiscale", 0, -1, -1, "x" * 100_000),
    }
    assert flatten.flat_nodes(docs(spark, []), "zinfo", "rec_id").count() == 0


def axis_values(spark, rows):
    df = spark.createDataFrame([(1, 0, "x", u, v, n, 0.0) for u, v, n in rows], "layer_id bigint, mip int, axis_name string, unit string, scale_value double, note string, common_value double")
    return [r["common_value"] for r in unit_norm.axis_recordings(df).collect()]


def test_axis_recordings(spark):
    ok = [
        ("nm", 4.0, None, 4.0), (" µm ", 2.0, None, 2000.0), ("μm", 2.0, "see 4 mm overview", 2000.0), ("Å", 10.0, None, 1.0), ("Å", 10.0, None, 1.0), ("NANOMETER", 5.0, None, 5.0),
        (None, 3.0, "pitch recorded as um/px", 3000.0), (None, 3.0, None, 3.0), (None, 3.0, "checked", 3.0), (None, 3.0, "values along this axis are given in m", 3e9), ("", 3.0, "unit: Å", 0.3),
        (None, None, "each step is 1,5 um wide", 1500.0), (None, None, "40nanometer per voxel", 40.0), (None, None, "res~5.28000e+02 nm", 528.0), (None, None, "voxel pitch 6.4e-08 meter", 64.0),
    ]
    for u, v, n, want in ok:
        assert axis_values(spark, [(u, v, n)]) == [pytest_approx(want)], (u, v, n)
    bad = [("pixel", 4.0, None), ("second", 4.0, None), ("nm", None, "each step is 3 nm wide"), ("nm", 0.0, None), ("nm", -1.0, None), ("nm", float("nan"), None), ("nm", float("inf"), None), (None, None, "rescan of tile 12"), (None, None, None), (None, None, "")]
    assert axis_values(spark, bad) == []


def pytest_approx(v):
    import pytest

    return pytest.approx(v, rel=1e-9)


def test_documents_and_scales(spark):
    ms = [{"axes": ["z", {"name": "y", "unit": "micrometer"}, {"name": "x", "unit": "second"}], "datasets": [{"path": "0"}, {"path": "1", "coordinateTransformations": [{"type": "translation", "translation": [9, 9, 9]}, {"type": "scale", "scale": [40.0, 0.008, 3]}, {"type": "scale", "scale": [1, 1, 1]}]}]}, {"axes": ["x"], "datasets": []}]
    d = docs(spark, [(7, json.dumps({"attributes": {"multiscales": ms}})), (8, "no"), (None, json.dumps({"attributes": {"multiscales": ms}}))])
    got = {(r["layer_id"], r["mip"], r["axis_name"]): round(r["common_value"], 6) for r in unit_norm.document_recordings(d).collect()}
    assert got == {(7, 1, "z"): 40.0, (7, 1, "y"): 8.0}
    schema = "layer_id bigint, mip int, resolution array<double>, scale_key string, description string"
    s = spark.createDataFrame([(1, 0, [4.0, 4.0, 40.0], "9_9_9", None), (2, 0, None, "8_8_30.5", "resolution missing in source"), (3, 0, [0.5, None, -1.0], "s1", "res given in um"), (4, 0, None, "s1", None), (5, 0, [2.0, 2.0, 2.0], "k", "values are Å"), (None, 0, [1.0], "k", None)], schema)
    got = {(r["layer_id"], r["axis_name"]): round(r["common_value"], 6) for r in unit_norm.scale_recordings(s).collect()}
    assert got == {(1, "x"): 4.0, (1, "y"): 4.0, (1, "z"): 40.0, (2, "x"): 8.0, (2, "y"): 8.0, (2, "z"): 30.5, (3, "x"): 500.0, (5, "x"): 0.2, (5, "y"): 0.2, (5, "z"): 0.2}


def test_disagreements(spark):
    r = spark.createDataFrame([(1, 0, "x", 100.0), (1, 0, "x", 101.0), (2, 0, "x", 100.0), (2, 0, "x", 101.1), (3, 0, "x", 1.0)], "layer_id bigint, mip int, axis_name string, common_value double")
    assert [x["layer_id"] for x in unit_norm.disagreements(r).collect()] == [2]
    assert unit_norm.disagreements(r.where(F.lit(False))).count() == 0


def test_flat_tables_keep_their_parents(spark):
    ms = [{"name": "m", "axes": [{"name": "x", "type": "space", "unit": "nm"}, "y"], "datasets": [None, {"path": "a", "coordinateTransformations": [{"type": "scale", "scale": [4, None, "5", 2.5]}, {"type": "translation", "translation": 7}]}], "coordinateTransformations": {"type": "identity"}}]
    rows = [(1, json.dumps({"attributes": {"multiscales": ms}})), (1, json.dumps({"attributes": {"multiscales": ms}})), (2, "no"), (None, None)]
    got = {n: {tuple(r) for r in t.collect()} for n, t in flatten.flat_tables(docs(spark, rows), "zinfo", "rec_id").items()}
    assert got == {
        "multiscales": {(1, 0, "m")}, "axes": {(1, 0, 0, "x", "space", "nm"), (1, 0, 1, "y", None, None)}, "datasets": {(1, 0, 1, "a")},
        "transforms": {(1, 0, 1, 0, "scale"), (1, 0, 1, 1, "translation"), (1, 0, -1, 0, "identity")}, "transform_values": {(1, 0, 1, 0, 0, 4.0), (1, 0, 1, 0, 3, 2.5), (1, 0, 1, 1, 0, 7.0)},
    }
    assert all(t.count() == 0 for t in flatten.flat_tables(docs(spark, []), "zinfo", "rec_id").values())


def test_seconds_come_with_all_prefixes():
    from chunkloom.functions import units

    known = {a: f for a, f, _ in units.aliases("time")}
    assert known["yottasecond"] == 1e24 and known["zeptosecond"] == 1e-21 and known["hectoseconds"] == 100 and known["millisecond"] == 1e-3 and known["day"] == 86400
