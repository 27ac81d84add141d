"""Layers of many chunks that hold few voxels each."""

import gzip
import zlib

import numpy as np
import pytest

from chunkloom.operators.sharding import Spec
from chunkloom.operators.volume import Volume
from chunkloom.sources import codecs, layers

WIDE = layers.Scale("precomputed", "/none", "uint32", (1_200_000, 60_000, 7), (1024, 128, 8), (0, 0, 1), (1, 1, 1))


def test_a_wide_grid_is_read_by_few_tasks():
    ranges = layers.ChunkPlan(WIDE).partitions()
    assert len(ranges) <= 300 and ranges[0][0] == 0 and ranges[-1][1] == 1172 * 469
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def test_sparse_data_are_packed_by_their_runs():
    data = np.zeros(1 << 20, np.uint32)
    data[::1000] = np.arange(len(data[::1000]))
    raw = data.tobytes()
    assert gzip.decompress(codecs.packed("gzip", raw, True)) == raw and zlib.decompress(codecs.packed("zlib", raw, True)) == raw
    assert len(codecs.packed("gzip", raw, True)) <= len(codecs.packed("gzip", raw))


def test_voxels_outside_of_the_bounds_are_refused(spark, tmp_path):
    for x in (-1, 6):
        rows = spark.createDataFrame([(0, 0, 0, 5), (x, 0, 0, 5)], "x bigint, y bigint, z bigint, label bigint")
        with pytest.raises(Exception, match="outside"):
            layers.write_layer(Volume(rows, ((0, 0, 0), (6, 2, 2)), (4, 2, 2)), f"{tmp_path}/{x}", "zarr2", compress="zlib")


def wide_layer(path, spec=None):
    info = layers.create_info(WIDE.size, (1, 1, 1), WIDE.chunk, "uint32", WIDE.offset, spec=spec)
    layers.write_object(f"{path}/info", layers.json.dumps(info).encode())
    return path


def test_a_wide_grid_of_shards_is_read_by_few_tasks(tmp_path):
    plan = layers.ChunkPlan(layers.open_layer(wide_layer(str(tmp_path), Spec(1, 2, 8)))[0])
    ranges = plan.partitions()
    assert len(ranges) <= 300 and ranges[-1][1] == plan.units
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("spec", [None, Spec(1, 2, 8)])
def test_which_chunks_of_a_wide_grid_exist_is_asked_by_few_tasks(spark, tmp_path, spec):
    assert layers.chunk_exists(spark, wide_layer(str(tmp_path), spec)).rdd.getNumPartitions() <= 300


def small_layer(spark, path, **how):
    rows = spark.createDataFrame([(0, 0, 0, 5), (5, 1, 1, 9)], "x bigint, y bigint, z bigint, label bigint")
    layers.write_layer(Volume(rows, ((0, 0, 0), (6, 2, 2)), (4, 2, 2)), path, **how)
    return layers.open_layer(path)[0]


def carried(s, packed):
    return {g: data for (g, _, _), data in layers.stored_chunks(s, [((0, 0, 0), 0, 0), ((1, 0, 0), 0, 0)], packed)}


def test_objects_are_carried_over_as_they_are_stored(spark, tmp_path):
    s = small_layer(spark, f"{tmp_path}/a")
    stored = {g: open(layers.chunk_path(s, g) + ".gz", "rb").read() for g in ((0, 0, 0), (1, 0, 0))}
    assert carried(s, "gzip") == stored
    assert {g: codecs.stream("zstd")[1](d) for g, d in carried(s, "zstd").items()} == {g: gzip.decompress(d) for g, d in stored.items()}


def test_payloads_of_shards_are_carried_over_as_they_are_stored(spark, tmp_path):
    s = small_layer(spark, f"{tmp_path}/a", spec=Spec(1, 2, 1))
    got = carried(s, "gzip")
    assert all(d in open(f"{s.root}/0.shard", "rb").read() for d in got.values())
    assert {g: gzip.decompress(d) for g, d in got.items()} == carried(s, None)


def test_packed_payloads_become_the_same_shards(spark, tmp_path):
    spec = Spec(1, 2, 1)
    items = [(k, f"payload {k}".encode() * 9) for k in range(40)]
    layers.write_shards(spark.createDataFrame(items, "label bigint, payload binary"), f"{tmp_path}/a", spec)
    ready = [(k, codecs.packed("gzip", p)) for k, p in items]
    layers.write_shards(spark.createDataFrame(ready, "label bigint, payload binary"), f"{tmp_path}/b", spec, packed=True)
    for n in (0, 1):
        assert open(f"{tmp_path}/a/{n}.shard", "rb").read() == open(f"{tmp_path}/b/{n}.shard", "rb").read()


def test_blocks_of_few_labels_are_encoded_together(monkeypatch):
    a = np.zeros((65, 34, 7, 2), np.uint32)
    a[::3, ::5, ::4, 0] = np.arange(22 * 7 * 2).reshape(22, 7, 2)
    a[:8, :8, :, 1] = np.arange(8 * 8 * 7).reshape(8, 8, 7)
    calls, unique = [], np.unique
    monkeypatch.setattr(codecs.np, "unique", lambda *x, **how: calls.append(1) or unique(*x, **how))
    data = codecs.encode_chunk(a, "compressed_segmentation")
    assert len(calls) == 1
    assert (codecs.decode_chunk(data, "compressed_segmentation", a.shape, np.dtype("uint32")) == a).all()


def test_checksums_are_right_and_steps_are_kept():
    for data in (b"", b"123", b"123456789", bytes(range(256)) * 40):
        c = 0xFFFFFFFF
        for byte in data:
            c = int(codecs._CRC[(c ^ byte) & 0xFF]) ^ (c >> 8)
        assert codecs.crc32c(data) == c ^ 0xFFFFFFFF
    assert codecs.crc32c(b"123456789") == 0xE3069283
    assert codecs._zero_bytes(64) is codecs._zero_bytes(64)


def test_a_sparse_png_is_packed_by_its_runs():
    image = np.zeros((896, 1024, 1), np.uint8)
    image.reshape(-1)[::1000] = 7
    data = codecs.encode_png(image, sparse=True)
    assert (codecs.decode_png(data) == image).all()


def test_small_chunks_share_a_batch(spark, tmp_path):
    rows = spark.range(64).selectExpr("id as x", "0L as y", "0L as z", "id + 1 as label")
    layers.write_layer(Volume(rows, ((0, 0, 0), (64, 1, 1)), (1, 1, 1)), str(tmp_path), spec=Spec(1, 2, 3))
    reader = layers.VolumeReader(layers.open_layer(str(tmp_path))[0], True)
    plan = layers.ChunkPlan(reader.scale)
    batches = list(reader.read(layers.Units(0, plan.units)))
    assert [b.num_rows for b in batches] == [64]
    assert sorted(batches[0]["value"].to_pylist()) == list(range(1, 65))
