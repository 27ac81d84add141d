import math

import numpy as np
import pytest

from chunkloom.operators import proximity

SCHEMA = "ids bigint, geometry array<float>, x string, cell int"


def points(spark, rows):
    return proximity.usable_points(spark.createDataFrame([(i, g, "clash", 1) for i, g in rows], SCHEMA), "ids", "geometry")


def brute_near(rows, r):
    ok = {(i, tuple(g)) for i, g in rows if i is not None and g is not None and len(g) == 3 and all(v is not None and math.isfinite(v) for v in g)}
    return {(min(a, b), max(a, b)) for a, p in ok for b, q in ok if a != b and sum((u - v) ** 2 for u, v in zip(p, q)) <= r * r}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = [(i, [float(round(v)) for v in rng.uniform(0, 2000, 3)]) for i in range(1200)]
    out += [(5000 + i, [float(round(v)) for v in rng.normal(500, 40, 3)]) for i in range(150)]  # a dense spot
    out += [(6000 + i, [77.0, 77.0, 77.0]) for i in range(30)]  # one place
    out += [(7000, [0.0, 0.0, 5000.0]), (7001, [120.0, 0.0, 5000.0]), (7002, [0.0, 120.5, 5000.0])]
    out += [(1, None), (2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0, 4.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    return [*out, out[0], out[1], (7000, [0.0, 0.0, 5000.0])]


@pytest.mark.parametrize("per_cell,block", [(50, 6000), (400, 64), (10**6, 100)])
def test_pairs_match_brute_force(spark, rows, per_cell, block):
    got = [(r["left_id"], r["right_id"]) for r in proximity.radius_join(points(spark, rows), 120.0, per_cell=per_cell, block=block).collect()]
    assert set(got) == brute_near(rows, 120.0)
    assert (7000, 7001) in set(got) and (7000, 7002) not in set(got)


@pytest.mark.parametrize("per_cell,block", [(60, 6000), (10**6, 90)])
def test_boxes(spark, rows, per_cell, block):
    boxes = [(1, 0, 0, 0, 400, 400, 400), (2, 900, 900, 900, 100, 100, 100), (3, 77, 77, 77, 77, 77, 77), (4, None, 0, 0, 9, 9, 9), (5, -9, -9, -9, 5000, 5000, 5000), (6, 3000, 3000, 3000, 3001, 3001, 3001), (1, 0, 0, 0, 400, 400, 400)]
    df = spark.createDataFrame(boxes, "box_id bigint, x0 bigint, y0 bigint, z0 bigint, x1 bigint, y1 bigint, z1 bigint")
    found = proximity.radius_join(points(spark, rows), 1.0, df, per_cell=per_cell, block=block).where("kind = 'inside'").distinct().collect()
    want = set()
    for i, g in rows:
        if i is None or g is None or len(g) != 3 or not all(v is not None and math.isfinite(v) for v in g):
            continue
        for b in boxes:
            if None not in b and all(min(b[1 + k], b[4 + k]) <= g[k] <= max(b[1 + k], b[4 + k]) for k in range(3)):
                want.add((b[0], i))
    assert {(r["left_id"], r["right_id"]) for r in found} == want


def test_groups_stay_within_blocks(spark):
    """A dense spot beside sparse points, with very many boxes over it."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.uniform(0, 5000, 3)]) for i in range(1500)] + [(10_000 + i, [float(v) for v in rng.normal(2500, 10, 3)]) for i in range(4000)]
    boxes = spark.range(20_000).selectExpr("id + 1000000 as box_id", *[f"2480L as {c}0" for c in "xyz"], *[f"2480L + id % 40 as {c}1" for c in "xyz"])
    groups = proximity._groups(points(spark, rows), 120.0, boxes, "euclidean", 100, 500)
    sizes = groups.groupBy("cell", "part", "i", "j").count().toPandas()
    assert sizes["count"].max() <= 2 * 500 * 1.35  # chunks are even up to chance
    few = rows[::12]
    got = {(r["left_id"], r["right_id"]) for r in proximity.radius_join(points(spark, few), 120.0, boxes.where("box_id % 400 = 0"), per_cell=20, block=30).where("kind = 'near'").collect()}
    assert got == brute_near(few, 120.0)


def test_boxes_on_the_sphere(spark):
    rng = np.random.default_rng(9)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-180, 180, 500), rng.uniform(-90, 90, 500)))]
    boxes = [(1, -20, -30, 45, 60), (2, 100, 80, 170, 90), (3, 0, 0, 0, 0), (4, -180, -90, 180, 90), (5, 10, -5, 30, 70)]
    df = spark.createDataFrame([(b, float(x0), float(y0), float(x1), float(y1)) for b, x0, y0, x1, y1 in boxes], "box_id bigint, x0 double, y0 double, x1 double, y1 double")
    got = {(r["left_id"], r["right_id"]) for r in proximity.radius_join(spark.createDataFrame(pts, "id bigint, x double, y double"), 1000.0, df, metric="great_circle", per_cell=30, block=60).where("kind = 'inside'").collect()}
    assert got == {(b, i) for b, x0, y0, x1, y1 in boxes for i, x, y in pts if min(x0, x1) <= x <= max(x0, x1) and min(y0, y1) <= y <= max(y0, y1)}


def test_great_circle(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(lon), float(lat)) for i, (lon, lat) in enumerate(zip(rng.uniform(-180, 180, 400), rng.uniform(-90, 90, 400)))] + [(900, 179.99, 10.0), (901, -179.99, 10.0), (902, 5.0, 90.0), (903, 100.0, 89.9999)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    got = {(r["left_id"], r["right_id"]) for r in proximity.radius_join(df, 300_000.0, metric="great_circle", per_cell=40).collect()}
    ll = np.array([r[1:] for r in rows])
    d = proximity.distances(ll, ll, "great_circle")
    want = {(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a + 1, len(rows)) if d[a, b] <= 300_000.0}
    assert got == want and (900, 901) in got and (902, 903) in got


def test_empty(spark):
    assert proximity.radius_join(points(spark, []), 120.0).count() == 0
