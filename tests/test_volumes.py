"""Golden values of boxes, grids, shards, labels and the small operators."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.functions import boxes, grid, labels
from chunkloom.functions.boxes import Box
from chunkloom.operators import graph, mesh, sharding
from chunkloom.operators.ranks import dense_ids
from chunkloom.operators.volume import Misaligned, OutOfBounds, ReadOnly, Volume
from chunkloom.sources import layers


def value(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_shard_locations(spark):
    assert sharding.Spec(6, 11, 7, "murmurhash3_x86_128").locate(1822975381) == (18, "42")
    assert sharding.Spec(2, 3, 3).locate(0b10101010) == (0b010, "5")
    key = F.lit(1822975381).cast("bigint")
    assert value(spark, *sharding.Spec(6, 11, 7, "murmurhash3_x86_128").location(key)) == (18, "42")
    assert value(spark, *sharding.Spec(0, 0, 0).location(key)) == (0, "0")
    murmur = sharding.Spec(1, 2, 1, "murmurhash3_x86_128")
    assert {murmur.locate(k)[1] for k in range(8)} == {"0"} and {murmur.locate(k)[1] for k in (8, 9)} == {"1"}


def test_shard_location_of_a_point(spark):
    cells = [-(-a // b) for a, b in zip((248832, 134144, 7063), (128, 128, 16))]
    at = [-(-a // b) for a, b in zip((144689, 52487, 2829), (128, 128, 16))]
    assert sharding.Spec(9, 6, 16).locate(layers.morton(at, cells)) == (sharding.Spec(9, 6, 16).locate(layers.morton(at, cells))[0], "458d")
    places = grid.bit_places([F.lit(n).cast("bigint") for n in cells])
    code = grid.morton_code([F.lit(n).cast("bigint") for n in at], places)
    assert value(spark, code, *grid.morton_point(code, places)) == (layers.morton(at, cells), *at)


@pytest.mark.parametrize("cells,at,code", [((3, 3, 3), (0, 0, 0), 0), ((3, 3, 3), (1, 0, 0), 1), ((3, 3, 3), (2, 0, 0), 0b001000), ((3, 3, 3), (2, 2, 0), 0b011000), ((3, 3, 3), (2, 2, 1), 0b011100), ((2, 3, 1), (1, 2, 0), 0b000101), ((4, 4, 1), (3, 3, 0), 0b1111), ((8, 8, 2), (5, 5, 0), 0b1100011)])
def test_morton(spark, cells, at, code):
    places = grid.bit_places([F.lit(n).cast("bigint") for n in cells])
    assert layers.morton(at, cells) == code
    assert value(spark, grid.morton_code([F.lit(n).cast("bigint") for n in at], places)) == (code,)


def test_morton_outside():
    for cells, at in (((3, 3, 3), (3, 0, 0)), ((2, 3, 1), (0, 0, 7))):
        with pytest.raises(ValueError):
            layers.morton(at, cells)


def test_shard_parameters():
    p = sharding.params_for_hashed
    assert [p(n) for n in (10**9, 10**6, 10**7, 1000, 0, 10000)] == [(11, 9, 0), (1, 9, 0), (4, 9, 0), (0, 0, 0), (0, 0, 0), (0, 3, 0)]
    assert p(1000, min_shards=1000) == (10, 0, 0) and p(10**9, 2**10) == (14, 6, 0) and p(10**9, minishard_index_bytes=2**13) == (13, 9, 0)
    s = sharding.params_for_image((10240, 10240, 990), (128, 128, 20), "jpeg", 1)
    assert s.preshift_bits + s.minishard_bits + s.shard_bits == 20
    with pytest.raises(ValueError):
        sharding.Spec(0, 40, 40)


@pytest.mark.parametrize("size, chunk", [((1536, 1408, 2046), (128, 128, 64)), ((3072, 2816, 2046), (128, 128, 64)), ((40960, 40960, 990), (128, 128, 20)), ((3000, 70, 1), (64, 64, 1)), ((5, 5, 5), (64, 64, 64))])
def test_image_layouts_keep_every_limit(size, chunk):
    s = sharding.params_for_image(size, chunk, "raw", 1)
    cells = [-(-a // c) for a, c in zip(size, chunk)]
    index = s.preshift_bits + s.minishard_bits
    assert index + s.shard_bits == sum((n - 1).bit_length() for n in cells)
    assert 2**s.preshift_bits <= 40000 // 24 and 16 << s.minishard_bits <= 8192
    assert np.prod(chunk) << index <= 3.5e9
    shape = np.minimum(sharding.image_shard_shape(s, size, chunk), size)
    most = np.prod([-(-int(a) // int(b)) for a, b in zip(size, shape)])
    shards = {s.locate(layers.morton((x, y, z), cells))[1] for x in range(0, cells[0], 5) for y in range(0, cells[1], 5) for z in range(cells[2])}
    assert 0 < len(shards) <= most <= 2**s.shard_bits


def test_shard_files_round_trip(spark):
    for spec in (sharding.Spec(0, 2, 3), sharding.Spec(1, 0, 0, "murmurhash3_x86_128", "raw", "raw")):
        rows = [(k, bytes([k % 256] * (k % 7))) for k in [*range(0, 400, 3), 2**62]]
        items = spark.createDataFrame(rows, "label bigint, payload binary")
        files = sharding.shard_files(items, spec)
        got = {r["label"]: bytes(r["payload"]) for r in sharding.shard_entries(files, spec).collect()}
        assert got == dict(rows)


def test_box_algebra(spark):
    b = lambda lo, hi: Box.of([float(v) for v in lo], [float(v) for v in hi])
    a, touch = b((0, 0, 0), (10, 10, 10)), b((10, 0, 0), (20, 10, 10))
    assert value(spark, a.intersects(b((1, 1, 1), (11, 11, 11))), a.intersects(b((30, 30, 30), (40, 40, 40))), a.intersects(touch), a.overlaps(touch)) == (True, False, False, True)
    i = a.intersection(b((5, 5, 5), (15, 15, 15)))
    assert value(spark, *i.lo, *i.hi) == (5, 5, 5, 10, 10, 10)
    z = a.intersection(b((30, 30, 30), (40, 40, 40)))
    assert value(spark, *z.lo, *z.hi) == (0,) * 6
    whole = Box.of([F.lit(v).cast("bigint") for v in (0, 2, 4)], [F.lit(v).cast("bigint") for v in (4, 8, 16)]).floored_by((2, 2, 2))
    assert value(spark, *whole.lo, *whole.hi) == (0, 1, 2, 2, 4, 8)
    assert int(value(spark, Box.of((0, 0, 0), (2000, 2000, 2000)).volume())[0]) == 8_000_000_000
    sub = b((0, 0, 0), (0.9, 1, 1))
    assert value(spark, sub.subvoxel(), sub.empty(), b((1, 1, 1), (1, 1, 1)).empty()) == (True, False, True)
    shrunk = Box.of([F.lit(v).cast("bigint") for v in (1, 0, 0)], [F.lit(v).cast("bigint") for v in (7, 64, 64)]).shrunk_to((8, 8, 8))
    assert value(spark, *shrunk.lo, *shrunk.hi) == (8, 0, 0, 8, 0, 0)
    offsets = Box.of([F.lit(35).cast("bigint")] * 3, [F.lit(36).cast("bigint")] * 3).to_mip([(2, 2, 2)] * 3)
    assert value(spark, *offsets.lo) == (4, 4, 4)


@pytest.mark.parametrize("name,ok", [("0-512_0-512_0-16", True), ("0-512_0-512_0-16.gz", True), ("0-512_0-512_0-16.br", True), ("0-512_0-512_0-16.zstd", True), ("0-512_0-512_0-16.gzip", False), ("0-512_0-512_0-16.lol", False), ("gibberish", False)])
def test_box_names(spark, name, ok):
    assert (value(spark, Box.named(F.lit(name)).hi[0]) == (512,)) == ok
    if ok:
        assert boxes.corners(name) == ((0, 0, 0), (512, 512, 16))
    else:
        with pytest.raises(ValueError):
            boxes.corners(name)


def test_index_expressions():
    lim = ((0, 0, 0), (10, 20, 30))
    assert boxes.reify((slice(2, 5), Ellipsis), lim) == (((2, 0, 0), (5, 20, 30)), (1, 1, 1))
    assert boxes.reify((3, slice(None, None, 2)), lim) == (((3, 0, 0), (4, 20, 30)), (1, 2, 1))
    assert boxes.reify(slice(-5, 50), lim, autocrop=True)[0] == ((0, 0, 0), (10, 20, 30))
    with pytest.raises(IndexError):
        boxes.reify(slice(0, 11), lim)
    with pytest.raises(ValueError):
        boxes.reify(slice(0, 5, -1), lim)


def test_pyramids():
    info = layers.create_info((2048, 2048, 512), (4, 4, 40), (128, 128, 64), "uint32", max_mip=5)
    assert [s["key"] for s in info["scales"]][::5] == ["4_4_40", "128_128_40"]
    half = layers.create_info((10, 10, 10), (4.5, 4.5, 40.0), (10, 10, 10), "uint8", max_mip=5)
    assert [s["key"] for s in half["scales"]][::5] == ["4.5_4.5_40.0", "144.0_144.0_40.0"]
    assert [s["voxel_offset"][0] for s in layers.create_info((9, 9, 9), (1, 1, 1), (9, 9, 9), "uint8", (35, 35, 35), max_mip=3)["scales"]] == [35, 17, 8, 4]
    assert layers.closest_divisors((128, 128, 128), 64) == [64, 64, 64]
    more = layers.add_scale(info, (2, 2, 1))
    assert len(more["scales"]) == 6 and more["scales"][-1]["size"] == [1024, 1024, 512]
    assert layers.to_mip(info, -1) == 5 and layers.to_mip(info, [8, 8, 40]) == 1
    with pytest.raises(LookupError):
        layers.to_mip(info, 6)


def test_packed_labels(spark):
    bits = labels.LabelBits(8, {k: 10 for k in range(1, 13)})
    packed = bits.encode(F.lit(5), [F.lit(1), F.lit(2), F.lit(3)], F.lit(10))
    assert value(spark, *bits.decode(packed)) == (5, 1, 2, 3, 10)
    layer9 = labels.LabelBits(8, {9: 3})
    assert value(spark, *layer9.decode(F.lit(648518346349515986).cast("bigint"))) == (9, 0, 0, 0, 8164562)
    assert value(spark, bits.encode(F.lit(5), [F.lit(1024), F.lit(0), F.lit(0)], F.lit(1))) == (None,)
    assert value(spark, labels.signed(labels.unsigned(F.lit(-1).cast("bigint"))))[0] == -1
    assert labels.to_unix_time("1970-01-01T00:00:01.2+00:00") == 2


def test_roots_keep_zero_and_arrived_labels(spark):
    bits = labels.LabelBits(8, {1: 4, 2: 4, 3: 4})
    one = 1 << 56
    edges = spark.createDataFrame([(one + 1, 2 * one + 1), (one + 2, 2 * one + 1), (2 * one + 1, 3 * one + 1)], "child bigint, parent bigint")
    ids = spark.createDataFrame([(0,), (one + 1,), (one + 1,), (3 * one + 1,), (one + 7,), (None,)], "label bigint")
    got = {r["label"]: r["root"] for r in graph.roots(ids, edges, bits, 3, 3).collect()}
    assert got == {0: 0, one + 1: 3 * one + 1, 3 * one + 1: 3 * one + 1, one + 7: one + 7}
    down = {(r["root"], r["leaf"]) for r in graph.leaves(spark.createDataFrame([(3 * one + 1,)], "r bigint"), edges, bits, 1, 3).collect()}
    assert down == {(3 * one + 1, one + 1), (3 * one + 1, one + 2)}
    with pytest.raises(ValueError):
        graph.roots(ids, edges, bits, 4, 3)


@pytest.fixture(scope="module")
def cube(spark):
    rows = [(x, y, z, 1 + (x + 8 * y + 64 * z) % 11) for x, y, z in itertools.product(range(8), range(8), range(4)) if (x, y, z) != (3, 3, 3)]
    return Volume(spark.createDataFrame(rows, "x bigint, y bigint, z bigint, label bigint"), ((0, 0, 0), (8, 8, 4)), (4, 4, 2))


def test_reads(cube):
    assert cube.cutout(((1, 0, 0), (8, 8, 4)), (2, 3, 1)).count() == 4 * 3 * 4 - 1
    assert cube.dense(((2, 2, 2), (5, 5, 4))).where("label = 0").count() == 1
    assert cube.cutout(((-4, -4, -4), (4, 4, 4)), autocrop=True).count() == 4 * 4 * 4 - 1
    with pytest.raises(OutOfBounds):
        cube.cutout(((-4, 0, 0), (4, 4, 4)))
    assert {r[0] for r in cube.unique(((3, 3, 3), (4, 4, 4))).collect()} == {0}
    inner = ((1, 1, 1), (8, 8, 4))
    assert {r[0] for r in cube.unique_core_shell(inner, cube.chunk_labels()).collect()} == {r[0] for r in cube.cutout(inner).select("label").distinct().collect()}
    rows, back = cube.renumber(cube.voxels)
    assert sorted(r["new_label"] for r in back.collect()) == list(range(12)) and rows.count() == 255
    assert cube.exists(((0, 0, 0), (1, 1, 1))).count() == 1


def test_writes(cube, spark):
    with pytest.raises(Misaligned):
        cube.write(((0, 0, 0), (3, 4, 2)), cube.voxels)
    with pytest.raises(Misaligned):
        cube.delete(((0, 0, 0), (3, 4, 2)))
    with pytest.raises(ReadOnly):
        Volume(cube.voxels, cube.bounds, cube.chunk, locked=True).write(((0, 0, 0), (4, 4, 2)), cube.voxels)
    assert cube.delete(((0, 0, 0), (4, 4, 2))).count() == 255 - 32
    fives = cube.voxels.withColumn("label", F.lit(5).cast("bigint"))
    box = ((1, 1, 0), (3, 3, 2))
    assert cube.write(box, fives, non_aligned=True).where("label <> 5").count() == cube.voxels.where(~cube.inside(box)).where("label <> 5").count()
    assert cube.overwrite_partial(box, fives).count() == 255 - 32 + 8


@pytest.mark.parametrize("how", [dict(), dict(encoding="compressed_segmentation"), dict(compress="zstd"), dict(spec=sharding.Spec(0, 1, 1)), dict(layer_format="zarr3"), dict(layer_format="zarr3", compress="zstd"), dict(layer_format="zarr2", compress="zlib")])
def test_files_round_trip(cube, spark, tmp_path, how):
    layers.write_layer(cube, str(tmp_path), **how)
    got = layers.read_layer(spark, str(tmp_path))
    assert got.count() == 256 and got.where("value = 0").count() == 1
    assert layers.read_layer(spark, str(tmp_path), skip_background=True).join(cube.voxels.withColumnRenamed("label", "value"), ["x", "y", "z", "value"]).count() == 255
    assert layers.read_layer(spark, str(tmp_path)).where("x >= 6 and y < 2 and z = 1").count() == 4


def test_n5_is_read(spark, tmp_path):
    a = np.arange(5 * 4 * 3, dtype=np.uint16).reshape((5, 4, 3), order="F")
    import json

    attrs = {"dimensions": [5, 4, 3], "blockSize": [4, 4, 3], "dataType": "uint16", "compression": {"type": "gzip"}, "pixelResolution": {"dimensions": [4, 4, 40]}}
    layers.write_object(f"{tmp_path}/attributes.json", json.dumps(attrs | {"scales": [[1, 1, 1]]}).encode())
    layers.write_object(f"{tmp_path}/s0/attributes.json", json.dumps(attrs).encode())
    from chunkloom.sources import codecs

    for k, part in enumerate((a[:4], a[4:])):
        head = np.array([0, 3], ">u2").tobytes() + np.array(part.shape, ">u4").tobytes()
        layers.write_object(f"{tmp_path}/s0/{k}/0/0", head + codecs.stream("gzip")[0](part.astype(">u2").tobytes("F")))
    got = {(r["x"], r["y"], r["z"]): r["value"] for r in layers.read_layer(spark, str(tmp_path)).collect()}
    assert got == {k: int(v) for k, v in np.ndenumerate(a)}


def test_codecs():
    from chunkloom.sources import codecs

    assert codecs.crc32c(b"123456789") == 0xE3069283
    rng = np.random.default_rng(1)
    v, f = rng.random((7, 3), np.float32), rng.integers(0, 7, (5, 3)).astype(np.uint32)
    for enc, dec in ((codecs.encode_mesh, codecs.decode_mesh), (codecs.encode_ply, codecs.decode_ply), (codecs.encode_obj, codecs.decode_obj)):
        v2, f2 = dec(enc(v, f))
        assert np.allclose(v, v2, atol=1e-5) and (f == f2).all()
    e = np.array([[0, 1], [1, 2]], np.uint32)
    sv, se, extra = codecs.decode_skeleton(codecs.encode_skeleton(v, e, [("<f4", np.arange(7)), ("u1", np.ones(7))]), [("radius", "<f4"), ("kind", "u1")])
    assert (sv == v).all() and (se == e).all() and (extra["radius"] == np.arange(7)).all()
    swc = "# x\n1 1 0 0 0 1 -1\n2 3 1 0 0 1 1\n3 3 2 0 0 1 2\n4 3 2 1 0 1 2\n"
    parts = codecs.decode_swc(swc)
    for _ in range(3):
        parts = codecs.decode_swc(codecs.encode_swc(*parts))
    assert len(parts[0]) == 4 and parts[1].tolist() == [[0, 1], [1, 2], [1, 3]]
    dt = codecs.annotation_dtype(1, [("class_label", "int32"), ("flag", "uint8")])
    assert dt.itemsize == 20
    rec = np.zeros(3, dt)
    r2, ids = codecs.decode_annotations(codecs.encode_annotations(rec, np.arange(3)), dt)
    assert len(r2) == 3 and ids.tolist() == [0, 1, 2]
    _, related = codecs.decode_annotation(codecs.encode_annotation(rec[0], [[1, 2], []]), dt, 2)
    assert related[0].tolist() == [1, 2] and len(related[1]) == 0
    m = {"chunk_shape": [1, 2, 3], "grid_origin": [0, 0, 0], "lod_scales": [1, 2], "vertex_offsets": [[0, 0, 0]] * 2, "positions": [[[0, 1, 2], [3, 4, 5]], [[9, 9, 9]]], "sizes": [[10, 20], [30]]}
    back = codecs.decode_manifest(codecs.encode_manifest(m))
    assert back["positions"][0].tolist() == m["positions"][0] and back["sizes"][1].tolist() == [30]
    with pytest.raises(codecs.Unsupported):
        codecs.encode_chunk(np.zeros((1, 1, 1, 1), np.uint8), "jpeg")


def test_dense_ids(spark):
    rows = spark.createDataFrame([(v, 1) for v in [5, 5, -3, 900, None, 7] * 3], "v bigint, new int")
    assert {r["v"]: r["i"] for r in dense_ids(rows, ["v"], "i").collect()} == {None: 0, -3: 1, 5: 2, 7: 3, 900: 4}


def test_components_and_cable(spark):
    v = spark.createDataFrame([(1, i, float(i), 0.0, 0.0) for i in range(6)], "segid bigint, vid bigint, x double, y double, z double")
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 3, 4), (1, 4, 5), (1, 5, 3)], "segid bigint, a bigint, b bigint")
    got = {r["vid"]: r["component"] for r in mesh.components(v, e).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    path = spark.createDataFrame([(1, i, i + 1) for i in range(5)], "segid bigint, a bigint, b bigint")
    assert mesh.cable_length(v, path).first()["cable_length"] == 5
    with pytest.raises(ValueError):
        mesh.thin_paths(v, path, 0)


def test_catalog(tmp_path):
    from chunkloom.sources import catalog

    docs = {"a": {"redirect": "b"}, "b": {"redirect": "b/"}, "c": {"redirect": "d"}, "d": {"redirect": "c"}}
    assert catalog.follow_redirects("a", docs.__getitem__)[0] == "b"
    with pytest.raises(ValueError):
        catalog.follow_redirects("c", docs.__getitem__)
    assert catalog.read_provenance(str(tmp_path))["owners"] == []
    (tmp_path / "provenance").write_text('// note\n{"description": "x", "owners": ["a",],}')
    assert catalog.read_provenance(str(tmp_path))["owners"] == ["a"]
    assert catalog.database("postgres://u:p@h/db") == {"scheme": "postgres", "host": "h", "port": 5432, "user": "u", "password": "p", "path": "db"}
    assert catalog.jdbc("mysql://h") == "jdbc:mysql://h:3306/spatial_index"
    info = layers.create_info((8, 8, 8), (1, 1, 1), (8, 8, 8), "uint8", max_mip=1)
    assert catalog.locked_mips(catalog.lock_mips(info, [1])) == {1}
    with pytest.raises(ValueError):
        catalog.lock_mips(info, [2])
    assert catalog.cache_is_valid(info, layers.create_info((9, 8, 8), (1, 1, 1), (8, 8, 8), "uint8", max_mip=1)) == (True, ["size of level 0 changed", "size of level 1 changed"])
