"""Layers written from rows that give voxels more than once, and objects that are missing."""

import gzip
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from chunkloom.operators.sharding import Spec
from chunkloom.operators.volume import Volume
from chunkloom.sources import codecs, layers, sparse

ONCE = {"F1": "sharded_cutout", "F4": "transfer_unpack", "F6": "delete_black_files", "F8": "transfer_pack", "F9": "zarr2_frames_roundtrip", "F10": "zarr3_roundtrip", "F11": "png_roundtrip", "F12": "sharded_chunk_exists", "F13": "transfer_format", "F14": "transfer_shards", "F15": "zarr3_frames_roundtrip"}


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ONCE.values(), ids=ONCE)
def test_voxels_are_not_grouped_and_written_before_they_are_chunks(spark, monkeypatch, name):
    def seen(volume, *args, **how):
        assert how["least"] and all(f.endswith("/lineitem.parquet") for f in volume.voxels.inputFiles())
        raise Seen

    monkeypatch.setattr(layers, "write_layer", seen)
    with pytest.raises(Seen):
        entry.queries()[name](spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("how", [{}, {"spec": Spec(1, 1, 2)}, {"layer_format": "zarr3", "compress": "zstd"}, {"layer_format": "zarr2", "compress": "zlib"}])
def test_the_least_of_repeated_voxels_is_stored(spark, tmp_path, how):
    rng = np.random.default_rng(3)
    given = [(int(x), int(y), int(z), int(v)) for x, y, z, v in rng.integers([0, 0, 0, 1], [40, 30, 3, 2**32], (6000, 4))]
    given += [(41, 0, 0, 2**32 - 1), (41, 0, 0, None), (41, 0, 0, 77), (42, 5, 1, None)]  # the null alone is background
    want: dict = {}
    for *p, v in given:
        if v is not None:
            want[tuple(p)] = min(v, want.get(tuple(p), v))
    rows = spark.createDataFrame(given, "x bigint, y bigint, z bigint, label bigint").repartition(5)
    layers.write_layer(Volume(rows, ((0, 0, 0), (50, 30, 3)), (16, 16, 2)), f"{tmp_path}/a", least=True, **how)
    got = layers.read_layer(spark, f"{tmp_path}/a", skip_background=True).collect()
    assert len(got) == len(want) and {(r.x, r.y, r.z): r.value for r in got} == want


def test_a_voxel_that_is_given_very_often_is_kept_once_per_batch():
    import pyarrow as pa

    batch = pa.record_batch({"number": np.repeat([1, 2], 5000), "at": np.repeat([3, 3], 5000), "value": np.arange(10000)})
    assert [(n, a.tolist(), v.tolist()) for n, a, v in layers._runs([batch, batch], True)] == [(1, [3], [0]), (2, [3], [5000]), (1, [3], [0]), (2, [3], [5000])]
    assert [(n, a.tolist(), v.tolist()) for n, a, v in layers._runs([batch.slice(0, 3), batch.slice(3)], True)] == [(1, [3], [0]), (2, [3], [5000])]


def test_missing_objects_of_a_folder_are_not_asked_for_one_by_one(tmp_path, monkeypatch):
    for k in (0, 500, 999):
        layers.write_object(f"{tmp_path}/{k}.gz", gzip.compress(b"%d" % k))
    asked = []
    monkeypatch.setattr(layers, "read_packed", lambda path, suffixes, read=layers.read_packed: asked.extend(suffixes) or read(path, suffixes))
    there = layers.Present()
    found = {k: there.packed(f"{tmp_path}/{k}") for k in range(1000)}
    assert {k: gzip.decompress(f[0]) for k, f in found.items() if f} == {0: b"0", 500: b"500", 999: b"999"} and len(asked) < 100
    assert there.paths(f"{tmp_path}/500") == [f"{tmp_path}/500.gz"] and not layers.listed(f"{tmp_path}/none")


def test_large_folders_are_not_listed_and_changed_ones_anew(tmp_path, monkeypatch):
    monkeypatch.setattr(layers, "MOST_LISTED", 2)
    monkeypatch.setattr(layers, "SETTLED", -1)
    layers.write_object(f"{tmp_path}/a", b"a")
    assert layers.listed(str(tmp_path)) == {"a"} == layers.listed(str(tmp_path))
    layers.os.utime(tmp_path, ns=(1, 1))  # as if the folder had been another one then
    layers.write_object(f"{tmp_path}/b", b"b")
    assert layers.listed(str(tmp_path)) == {"a", "b"}
    layers.write_object(f"{tmp_path}/c", b"c")
    layers.os.utime(tmp_path, ns=(2, 2))
    assert layers.listed(str(tmp_path)) is None
    monkeypatch.setattr(layers, "MISSES", 0)
    assert layers.Present().packed(f"{tmp_path}/c") == (b"c", "") and layers.Present().packed(f"{tmp_path}/d") is None


def test_gzip_files_of_several_members_or_broken_ones():
    data = [bytes(5000), bytes(range(256)) * 50]
    read = codecs.stream("gzip")[1]
    for d in (*data, b"", b"a"):
        assert read(gzip.compress(d)) == d and read(gzip.compress(d) + bytes(7)) == d
    assert read(gzip.compress(data[0]) + gzip.compress(data[0])) == data[0] * 2
    assert read(gzip.compress(data[0]) + gzip.compress(data[1])) == data[0] + data[1]
    for bad in (gzip.compress(data[1])[:-9], gzip.compress(data[1])[:-1] + b"x"):
        with pytest.raises((EOFError, gzip.BadGzipFile, zlib.error)):
            read(bad)


def test_frames_of_many_words_are_read_whole():
    rng = np.random.default_rng(5)
    at = np.unique(np.append(rng.integers(0, 30_000, 6000), rng.integers(0, 600_000, 1500)))
    words = rng.integers(1, 256, (len(at), 4)).astype(np.uint8)
    (data,) = sparse.compressed("zstd", np.array([2_400_000]), np.zeros(len(at), np.int64), at * 4, words)
    size, places, byte = sparse.expanded("zstd", [data])[0]
    raw = np.zeros(size, np.uint8)
    raw[places] = byte
    assert raw.tobytes() == codecs.stream("zstd")[1](data)
    assert sparse.expanded("zstd", [data[:-3]])[0] is None and sparse.expanded("zstd", [data + b"\0"])[0] is None


def test_a_grid_of_many_frames_is_read_by_few_tasks():
    s = layers.Scale("zarr2", "/none", "uint32", (1_200_000, 60_000, 7), (1024, 128, 8), (0, 0, 1), (1, 1, 1), 2, 3, frame_chunk=2)
    ranges = layers.ChunkPlan(s).partitions()
    assert len(ranges) <= 300 and ranges[-1][1] == 1172 * 469 * 4


def test_deflate_streams_are_read_a_few_at_a_time(monkeypatch):
    at = np.arange(2000) * 400
    data = sparse.compressed("zlib", np.full(9, 800_000), np.repeat(np.arange(9), 2000), np.tile(at, 9), np.full((18000, 1), 7, np.uint8))
    sizes = []
    monkeypatch.setattr(sparse, "_inflated", lambda bodies, read=sparse._inflated: sizes.append(sum(map(len, bodies))) or read(bodies))
    got = sparse.expanded("zlib", data)
    assert all(g[0] == 800_000 and (g[1] == at).all() and (g[2] == 7).all() for g in got) and max(sizes) <= (1 << 14) + len(data[0])
