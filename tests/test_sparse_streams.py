"""Chunks of a few voxels, made and read without their background."""

import gzip
import zlib

import numpy as np
import pytest
import zstandard

from chunkloom.operators.sharding import Spec
from chunkloom.operators.volume import Volume
from chunkloom.sources import codecs, layers, sparse

USUAL = {"gzip": gzip.decompress, "zlib": zlib.decompress, "zstd": lambda d: zstandard.ZstdDecompressor().decompress(d)}


@pytest.mark.parametrize("width", [1, 2, 4, 8])
@pytest.mark.parametrize("name", USUAL)
def test_any_decoder_reads_streams_made_without_zeros(name, width):
    rng = np.random.default_rng(width)
    raws, at, words = [], [], []
    for n in (1, 2, 300, 5000, 100_000):
        places = np.sort(rng.choice(n, max(1, n // 40), replace=False))
        some = rng.integers(0, 256, (len(places), width)).astype(np.uint8) * rng.integers(0, 2, (len(places), width)).astype(np.uint8)
        some[~some.any(axis=1), 0] = 200
        raw = np.zeros((n, width), np.uint8)
        raw[places] = some
        raws.append(raw.tobytes())
        at.append(places * width)
        words.append(some)
    owner = np.repeat(np.arange(len(raws)), [len(a) for a in at])
    made = sparse.compressed(name, np.array([len(r) for r in raws]), owner, np.concatenate(at), np.concatenate(words))
    assert [USUAL[name](d) for d in made] == raws
    for raw, found in zip(raws, sparse.expanded(name, made)):
        a = np.zeros(found[0], np.uint8)
        a[found[1]] = found[2]
        assert a.tobytes() == raw


@pytest.mark.parametrize("name", ["gzip", "zlib"])
def test_a_damaged_stream_is_left_to_the_usual_decoder(name):
    (good,) = sparse.compressed(name, [4000], np.zeros(2, int), np.array([100, 3000]), np.array([[7], [9]], np.uint8))
    bad = bytearray(good)
    bad[-3] ^= 1
    assert sparse.told(name, bytes(bad)) and sparse.expanded(name, [bytes(bad)]) == [None]
    assert not sparse.told(name, codecs.stream(name)[0](bytes(4000)))


HOW = {
    "F1 F12 shards": dict(spec=Spec(1, 2, 3)), "F3 objects": {}, "F5 F10 zarr3": dict(layer_format="zarr3", compress="zstd"), "zarr3 gzip": dict(layer_format="zarr3", compress="gzip"),
    "F9 zarr2": dict(layer_format="zarr2", compress="zlib", channels=2, frames=3, channel_chunk=1, frame_chunk=2), "F15 frames": dict(layer_format="zarr3", compress="zstd", channels=2, frames=3, channel_chunk=1, frame_chunk=2), "F11 png": dict(dtype="uint8", encoding="png", compress=""),
}


@pytest.fixture
def dense(monkeypatch):
    """Counts chunks whose background is filled in."""
    seen, blank, whole = [], layers.blank, layers.decode_whole
    monkeypatch.setattr(layers, "blank", lambda *a: seen.append(1) or blank(*a))
    monkeypatch.setattr(layers, "decode_whole", lambda *a: seen.append(1) or whole(*a))
    return seen


@pytest.mark.parametrize("how", HOW.values(), ids=HOW)
def test_sparse_chunks_are_made_and_read_without_background(spark, tmp_path, dense, how):
    """The rim of the layer too, where precomputed chunks are cropped."""
    s = layers._new_scale(Volume(spark.range(0), ((3, -2, 1), (150, 97, 14)), (128, 64, 8)), str(tmp_path), how.get("layer_format", "precomputed"), how.get("dtype", "uint32"), (1, 1, 1), how.get("compress", "gzip"), how.get("encoding", "raw"), how.get("spec"), how.get("channels", 1), how.get("frames", 1), how.get("channel_chunk", 1), how.get("frame_chunk", 1), 0)
    outer = "gzip" if s.layer_format == "precomputed" and s.encoding == "raw" else ""
    name, sizes = layers.sparse_stream(s, outer), (*s.chunk, s.channel_chunk, s.frame_chunk)
    boxes, ats, values, full = [], [], [], []
    for g in ((0, 0, 0), (1, 1, 1)):
        box = s.box(g)
        shape = [b - a for a, b in zip(*box)]
        idx = [np.array([0, n // 2, n - 1, n - 1]) for n in (*shape, s.channel_chunk, s.frame_chunk)]
        v = np.array([5, 200, 8, 9])  # the last of equal places stays
        boxes.append(box)
        ats.append(np.ravel_multi_index(idx, sizes, order="F"))
        values.append(v)
        a = layers.blank(s, shape)
        a[tuple(idx)] = v
        full.append((shape, a))
    dense.clear()
    made = layers.encode_sparse(s, name, boxes, ats, values)
    bodies = [layers.sparse_body(s, name, d, b) for d, b in zip(made, boxes)]
    bad, owner, idx, v = layers.decode_sparse(s, name, boxes, bodies)
    assert not bad and not dense
    for k, ((shape, a), data) in enumerate(zip(full, made)):
        assert (layers.decode_whole(s, codecs.stream(outer)[1](data), shape)[: a.shape[0], : a.shape[1], : a.shape[2]] == a).all()
        mine = owner == k
        got = np.zeros_like(a)
        got[tuple(i[mine] for i in idx)] = v[mine]
        assert (got == a).all()


def test_a_sparse_layer_is_written_and_read_without_background(spark, tmp_path):
    """By the writer and the reader as they are called, values of other chunks and dense ones among them."""
    rows = spark.range(200).selectExpr("id * 7 % 400 as x", "id % 90 as y", "id % 8 as z", "id + 1 as label").unionByName(spark.range(400).selectExpr("500 + id % 20 as x", "id div 20 as y", "0L as z", "id + 1000 as label"))
    want = sorted(map(tuple, rows.collect()))
    for k, how in enumerate(({}, dict(spec=Spec(1, 2, 3)), dict(layer_format="zarr3", compress="zstd"), dict(layer_format="zarr2", compress="zlib"))):
        layers.write_layer(Volume(rows, ((0, 0, 0), (530, 90, 8)), (128, 64, 8)), f"{tmp_path}/{k}", **how)
        got = layers.read_layer(spark, f"{tmp_path}/{k}", skip_background=True).select("x", "y", "z", "value")
        assert sorted(map(tuple, got.collect())) == want
        full = layers.read_layer(spark, f"{tmp_path}/{k}").where("value != 0").select("x", "y", "z", "value")
        assert sorted(map(tuple, full.collect())) == want


def test_f3_sparse_objects_change_their_compression_without_zeros(monkeypatch):
    (data,) = sparse.compressed("gzip", [1 << 20], np.zeros(2, int), np.array([5, 70_000]), np.array([[7], [9]], np.uint8))
    raw = gzip.decompress(data)
    monkeypatch.setattr(codecs, "packed", None)
    assert USUAL["zstd"](codecs.repacked(data, "gzip", "zstd")) == raw


def test_f4_f8_f12_shard_files_stay_open(spark, tmp_path, monkeypatch):
    """A shard file that holds several units of a task is opened once."""
    rows = spark.range(64).selectExpr("id as x", "0L as y", "0L as z", "id + 1 as label")
    layers.write_layer(Volume(rows, ((0, 0, 0), (64, 1, 1)), (1, 1, 1)), str(tmp_path), spec=Spec(1, 0, 1))
    s, opened, kind = layers.open_layer(str(tmp_path))[0], [], layers.ShardFile
    monkeypatch.setattr(layers, "ShardFile", lambda *a: opened.append(a) or kind(*a))
    plan, files = layers.ChunkPlan(s), {}
    got = [d for unit in range(plan.units) for _, d in layers.stored_chunks(s, plan.chunks(unit), None, files)]
    assert plan.units == 32 and len(got) == 64 and None not in got and len(opened) == 2


def test_f12_a_task_keeps_few_shard_files_open(tmp_path, monkeypatch):
    monkeypatch.setattr(layers, "OPEN_SHARDS", 2)
    spec, files = Spec(0, 0, 4), {}
    s = layers.Scale("precomputed", str(tmp_path), "uint32", (4, 4, 1), (1, 1, 1), (0, 0, 0), (1, 1, 1), spec=spec.to_dict())
    for number in (3, 5, 3, 7):
        shard = layers.open_shard(s, spec, number, files)
        assert shard.path.endswith(f"/{number}.shard") and shard is files[number]
    assert sorted(files) == [5, 7]


def test_f10_zstd_frames_that_tell_their_size_are_read_at_once(monkeypatch):
    data = codecs.stream("zstd")[0](bytes(5000))
    monkeypatch.setattr(codecs.io, "BytesIO", None)  # what a stream is read from
    assert codecs.stream("zstd")[1](data) == bytes(5000)
