import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.operators.sharding import Spec, assemble, shard_files
from chunkloom.operators.volume import Volume
from chunkloom.sources import codecs, layers, shards


def one_file(tmp_path, spec, labels, size=100):
    groups: dict = {}
    for x in labels:
        m, _ = spec.place(np.array([x], np.uint64))
        groups.setdefault(int(m[0]), {})[x] = bytes([x % 251]) * size
    path = str(tmp_path / "0.shard")
    layers.write_object(path, assemble(spec, groups))
    return path


@pytest.mark.parametrize("hashed", ["identity", "murmurhash3_x86_128"])
@pytest.mark.parametrize("encoding", ["raw", "gzip"])
def test_only_the_needed_ranges_are_read(tmp_path, hashed, encoding):
    spec = Spec(0, 6, 0, hashed, encoding, "raw")
    labels = [3 * i for i in range(5000)] + [2**63 + 7]
    path = one_file(tmp_path, spec, labels)
    shard = shards.ShardFile(path, spec)
    got = dict(shard.payloads(np.array([9, 10, 2**63 + 7, 3000], np.uint64)))
    assert got == {0: b"\x09" * 100, 2: bytes([(2**63 + 7) % 251]) * 100, 3: bytes([3000 % 251]) * 100}
    fixed, index = 16 << 6, sum(int(b - a) for a, b in shard.fixed()[[int(m) for m in np.unique(spec.place(np.array([9, 10, 2**63 + 7, 3000], np.uint64))[0])]])
    assert shard.n_read == fixed + index + 300 < os.path.getsize(path) / 5
    before = shard.n_read
    assert dict(shard.payloads(np.array([9], np.uint64))) == {0: b"\x09" * 100} and shard.n_read == before + 100  # indices are kept
    assert sorted(int(x) for _, have, _, _ in shards.ShardFile(path, spec).entries() for x in have) == sorted(labels)
    gone = shards.ShardFile(path + "x", spec)
    assert list(gone.payloads(np.array([1], np.uint64))) == [] and list(gone.entries()) == []


def test_broken_files_are_refused(tmp_path):
    spec = Spec(0, 2, 0, "identity", "raw", "raw")
    path = one_file(tmp_path, spec, range(40))
    with open(path, "r+b") as f:
        f.truncate(70)
    with pytest.raises(ValueError):
        list(shards.ShardFile(path, spec).payloads(np.array([1], np.uint64)))


def test_lookups_handle_nulls_and_repetitions(spark, tmp_path):
    spec = Spec(1, 2, 2, "murmurhash3_x86_128")
    items = spark.range(0, 300, 3).select(F.col("id").alias("label"), F.encode(F.col("id").cast("string"), "utf-8").alias("payload"))
    for r in shard_files(items, spec).collect():
        layers.write_object(f"{tmp_path}/{r['filename']}", bytes(r["content"]))
    wanted = spark.createDataFrame([(x, "a") for x in (0, 3, 3, 4, 299, -5, None)], "label bigint, payload string")
    assert {(r["label"], bytes(r["payload"])) for r in shards.shard_lookup(wanted, str(tmp_path), spec).collect()} == {(0, b"0"), (3, b"3")}
    there = {r["label"]: (r["is_stored"], r["size"] is not None) for r in shards.shard_exists(wanted, str(tmp_path), spec).collect()}
    assert there == {0: (True, True), 3: (True, True), 4: (False, False), 299: (False, False), -5: (False, False)}
    assert shards.list_labels(spark, str(tmp_path), spec).count() == 100
    assert shards.shard_lookup(wanted.limit(0), str(tmp_path), spec).count() == 0


@pytest.mark.parametrize("spec", [None, Spec(1, 1, 4), Spec(0, 0, 7), Spec(2, 1, 3, "murmurhash3_x86_128")])
def test_a_plan_numbers_every_chunk_once(spec):
    s = layers.Scale("precomputed", "/x", "uint8", (100, 70, 33), (10, 10, 10), (5, -5, 0), (1, 1, 1), 3, 5, channel_chunk=2, frame_chunk=2, spec=spec and spec.to_dict())
    for lo, hi in ((None, None), ((20, 0, 3), (61, 9, 30)), ((-50, -50, -50), (0, 0, 0)), ((105, 0, 0), (300, 9, 9))):
        plan = layers.ChunkPlan(s, lo, hi)
        got = [k for a, b in plan.partitions() for u in range(a, b) for k in plan.chunks(u)]
        box = [(max(a, o), min(b, o + n)) for a, b, o, n in zip(lo or s.offset, hi or [300] * 3, s.offset, s.size)]
        want = [range((a - o) // c, -(-(b - o) // c)) if b > a else () for (a, b), o, c in zip(box, s.offset, s.chunk)]
        assert sorted(got) == sorted(((x, y, z), c, t) for x, y, z in itertools.product(*want) for c in range(2) for t in range(3))


def test_very_large_levels_are_planned_without_listing_chunks():
    s = layers.Scale("zarr3", "/x", "uint8", (2**20, 2**20, 2**17), (64, 64, 64), (0, 0, 0), (1, 1, 1))
    parts = layers.ChunkPlan(s).partitions()
    assert len(parts) <= layers.MAX_PARTITIONS and parts[-1][1] == 2**14 * 2**14 * 2**11


def test_checksums_of_all_lengths():
    table = [int(x) for x in codecs._CRC]
    rng = np.random.default_rng(0)
    assert codecs.crc32c(b"123456789") == 0xE3069283
    for n in (0, 1, 2, 63, 64, 65, 1000, 70001):
        data, c = rng.bytes(n), 0xFFFFFFFF
        for b in data:
            c = table[(c ^ b) & 255] ^ (c >> 8)
        assert codecs.crc32c(data) == c ^ 0xFFFFFFFF


def test_routes_of_a_transfer(spark, tmp_path):
    rows = spark.createDataFrame([(x, y, 0, 1 + x * 7 + y) for x in range(20) for y in range(9)], "x bigint, y bigint, z bigint, label bigint")
    v = Volume(rows, ((0, 0, 0), (20, 9, 1)), (8, 4, 1))
    a, spec = str(tmp_path / "a"), Spec(1, 1, 2)
    layers.write_layer(v, a)
    s = layers.open_layer(a)[0]
    assert layers.route(s, s.chunk, "precomputed", "raw", None) == "objects" and layers.route(s, s.chunk, "precomputed", "raw", spec) == "pack"
    assert layers.route(s, (4, 4, 1), "precomputed", "raw", None) == "voxels" == layers.route(s, s.chunk, "zarr3", "raw", None) == layers.route(s, s.chunk, "precomputed", "npz", None)
    layers.transfer(spark, a, str(tmp_path / "b"), spec=spec)
    b = layers.open_layer(str(tmp_path / "b"))[0]
    assert layers.route(b, s.chunk, "precomputed", "raw", spec) == "shards" and layers.route(b, s.chunk, "precomputed", "raw", Spec(0, 2, 2)) == "pack" and layers.route(b, s.chunk, "precomputed", "raw", None) == "unpack"
    layers.transfer(spark, str(tmp_path / "b"), str(tmp_path / "c"), spec=Spec(0, 2, 2))
    layers.transfer(spark, str(tmp_path / "c"), str(tmp_path / "d"), compress="zstd")
    got = layers.read_layer(spark, str(tmp_path / "d"), skip_background=True).select("x", "y", "z", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows.collect()))
    assert {p.suffix for p in (tmp_path / "d" / "1_1_1").iterdir()} == {".zstd"}
    assert layers.chunk_exists(spark, str(tmp_path / "d")).where("is_stored").count() == 9
    assert layers.delete_chunks(spark, str(tmp_path / "d"), box=((0, 0, 0), (9, 1, 1))).count() == 2
    assert layers.chunk_exists(spark, str(tmp_path / "d"), box=((0, 0, 0), (20, 1, 1))).where("is_stored").count() == 1
