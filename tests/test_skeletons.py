import random

import numpy as np
import pytest

from chunkloom.operators import mesh, sharding
from chunkloom.operators.sharding import Spec
from chunkloom.sources import codecs, objects

V, E = "segid bigint, vid bigint, x double, y double, z double", "segid bigint, a bigint, b bigint"


def skeleton(spark, n, edges, segid=1):
    return spark.createDataFrame([(segid, i, float(i), 0.0, 0.0) for i in range(n)], V), spark.createDataFrame([(segid, a, b) for a, b in edges], E)


def thinned(spark, n, edges, every):
    v, e = mesh.thin_paths(*skeleton(spark, n, edges), every)
    return sorted(r["vid"] for r in v.collect()), sorted((r["a"], r["b"]) for r in e.collect())


def test_paths_are_thinned_along_their_branches(spark):
    line = [(1, 0), (1, 2), (2, 3), (3, 4), (5, 4)]
    assert thinned(spark, 6, line, 1) == ([0, 1, 2, 3, 4, 5], [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)])
    assert thinned(spark, 6, line, 2) == ([0, 2, 4, 5], [(0, 2), (2, 4), (4, 5)])
    assert thinned(spark, 6, line, 3) == ([0, 3, 5], [(0, 3), (3, 5)])
    assert thinned(spark, 6, [(1, 0), (1, 2), (3, 4), (5, 4)], 2) == ([0, 2, 3, 5], [(0, 2), (3, 5)])
    cross = [(0, 1), (1, 2), (2, 5), (3, 4), (4, 5), (5, 6), (6, 7), (5, 8), (8, 9), (9, 10)]
    assert thinned(spark, 11, cross, 2) == ([0, 2, 3, 5, 7, 9, 10], [(0, 2), (2, 5), (3, 5), (5, 7), (5, 9), (9, 10)])
    for bad in (-1, 0, 0.5, 2.00000000000001):
        with pytest.raises(ValueError):
            mesh.thin_paths(*skeleton(spark, 6, line), bad)


def brute_paths(n, edges):
    """Paths by walking: {vid: {(start, first, pos, length)}}."""
    near = {i: sorted({b for a, b in edges if a == i} | {a for a, b in edges if b == i}) for i in range(n)}
    comp = list(range(n))
    for _ in range(n):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    ends = {i for i in range(n) if near[i] and len(near[i]) != 2}
    ends |= {c for c in set(comp) if near[c] and all(len(near[i]) == 2 for i in range(n) if comp[i] == c)}
    out = {}
    for s in ends:
        for f in near[s]:
            walk = [s, f]
            while walk[-1] not in ends:
                walk.append(next(x for x in near[walk[-1]] if x != walk[-2]))
            if (s, f) <= (walk[-1], walk[-2]):
                for p, v in enumerate(walk):
                    out.setdefault(v, set()).add((s, f, p, len(walk) - 1))
    return out


def test_path_positions_match_walking(spark):
    rng = random.Random(4)
    edges = [(i, rng.choice([i - 1, i - 1, i - 1, rng.randrange(i)])) for i in range(1, 60)]
    edges += [(40, 12), (60, 61), (61, 62), (62, 60), (63, 64), (66, 67), (67, 68), (68, 69), (69, 66), (66, 70)]  # a loop, a ring, an edge, a ring on a stalk
    v, e = skeleton(spark, 72, edges)
    got = {}
    for r in mesh.path_positions(v, e).collect():
        got.setdefault(r["vid"], set()).add((r["start"], r["first"], r["pos"], r["length"]))
    assert got == brute_paths(72, [tuple(x) for x in edges])


def test_smoothing_leaves_ends_and_joints(spark):
    v, e = skeleton(spark, 6, [(0, 1), (1, 2), (2, 3), (3, 4)])
    v = v.selectExpr("segid", "vid", "x * x as x", "y", "z")
    got = {r["vid"]: r["x"] for r in mesh.smooth_paths(v, e, 3).collect()}
    assert got == {0: 0, 1: pytest.approx(5 / 3), 2: pytest.approx(14 / 3), 3: pytest.approx(29 / 3), 4: 16, 5: 25}


def test_skeleton_algebra(spark):
    v, e = skeleton(spark, 5, [(1, 0), (1, 2), (3, 3)])
    kept, edges = mesh.renumbered_skeletons(v.where("vid <> 0"), mesh.consolidate_edges(e).where("a > 0"))
    assert sorted((r["vid"], r["x"]) for r in kept.collect()) == [(0, 1.0), (1, 2.0)] and [(r["a"], r["b"]) for r in edges.collect()] == [(0, 1)]
    cropped, inner = mesh.crop_skeletons(v, e, ((1, 0, 0), (2, 0, 0)))
    assert sorted(r["vid"] for r in cropped.collect()) == [1, 2] and [(r["a"], r["b"]) for r in inner.collect()] == [(1, 2)]
    parts = v.selectExpr("segid", "case when vid < 2 then 'a' else 'b' end as frag", "case when vid < 2 then vid else vid - 2 end as vid", "x", "y", "z", "vid as radius")
    merged, links = mesh.merge_skeletons(parts, spark.createDataFrame([(1, "a", 0, 1), (1, "b", 0, 2)], "segid bigint, frag string, a bigint, b bigint"))
    assert sorted((r["vid"], r["radius"]) for r in merged.collect()) == [(i, i) for i in range(5)] and sorted((r["a"], r["b"]) for r in links.collect()) == [(0, 1), (2, 4)]
    turned = spark.createDataFrame([(1, 2, 1), (1, 0, 1), (1, 3, 3)], E)
    assert [r["is_equivalent"] for r in mesh.equivalent((v, e), (v, turned)).collect()] == [True]
    assert [r["is_equivalent"] for r in mesh.equivalent((v, e), (v, e.where("a <> b and b <> 0"))).collect()] == [False]


def test_meshes_are_inserted_into_shards():
    spec = Spec(0, 2, 0, "murmurhash3_x86_128")

    def one(k):
        m = {"chunk_shape": (1, 1, 1), "grid_origin": (0, 0, 0), "lod_scales": [1.0], "vertex_offsets": np.zeros((1, 3)), "positions": [np.zeros((1, 3))], "sizes": [np.array([k])]}
        return bytes([k]) * k, codecs.encode_manifest(m)

    groups: dict = {}
    for k in range(1, 30):
        groups.setdefault(spec.locate(k)[0], {})[k] = one(k)
    shard = sharding.assemble_meshes(spec, groups)
    assert sharding.disassemble_meshes(spec, shard, objects.data_bytes) == {k: one(k) for k in range(1, 30)}
    more = sharding.insert_mesh(spec, sharding.insert_mesh(spec, shard, 200, *one(77), objects.data_bytes), 5, *one(9), objects.data_bytes)
    assert sharding.disassemble_meshes(spec, more, objects.data_bytes) == {k: one(k) for k in range(1, 30)} | {200: one(77), 5: one(9)}


def test_levels_of_detail(spark, tmp_path):
    rows = [(1, 0, 0, 0, 0, b"aa"), (1, 0, 1, 0, 0, b"b"), (1, 0, 0, 1, 0, b""), (1, 2, 0, 0, 0, b"coarse"), (2, 0, 5, 5, 5, b"x"), (2, 1, 0, 0, 0, b"yz")]
    items = objects.pack_lods(spark.createDataFrame(rows, "segid bigint, lod int, px bigint, py bigint, pz bigint, payload binary"), (1, 1, 1), (0, 0, 0)).cache()
    spec = Spec(0, 1, 0)
    objects.write_lods(items, str(tmp_path / "files"))
    objects.write_lod_shards(items, str(tmp_path / "shards"), spec)
    ids = spark.createDataFrame([(1,), (2,), (2,)], "segid bigint")
    lost = spark.createDataFrame([(1,), (3,)], "segid bigint")
    for path, how in (("files", None), ("shards", spec)):
        read = lambda ids, lod, **more: sorted((r["segid"], r["lod"], r["px"], r["py"], bytes(r["payload"])) for r in objects.read_lods(ids, str(tmp_path / path), lod, spec=how, **more).collect())  # noqa: B023, E731
        assert read(ids, 0) == [(1, 0, 0, 0, b"aa"), (1, 0, 1, 0, b"b"), (2, 0, 5, 5, b"x")]
        assert read(ids, -1) == [(1, 2, 0, 0, b"coarse"), (2, 1, 0, 0, b"yz")] and read(ids, 1) == [(2, 1, 0, 0, b"yz")]
        assert read(lost, 0, allow_missing=True) == [(1, 0, 0, 0, b"aa"), (1, 0, 1, 0, b"b")]
        with pytest.raises(Exception, match="no mesh 3"):
            read(lost, 0)
