import json
import os
import struct
import zlib

import numpy as np
import pytest

from chunkloom import session
from chunkloom.sources import catalog, codecs, layers


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_chunks(kind, channels):
    a = np.random.default_rng(1).integers(0, np.iinfo(kind).max, (7, 5, 3, channels)).astype(kind)
    data = codecs.encode_chunk(a, "png")
    assert (codecs.decode_chunk(data, "png", a.shape, np.dtype(kind)) == a).all()
    with pytest.raises(ValueError):
        codecs.decode_chunk(data, "png", (8, 5, 3, channels), np.dtype(kind))
    with pytest.raises(codecs.Unsupported):
        codecs.encode_chunk(a.astype(np.float32), "png")


def filtered(image: np.ndarray) -> bytes:
    """A PNG whose lines use all five filters in turn."""
    rows, columns, channels = image.shape
    flat, body = image.reshape(rows, -1).astype(int), b""
    for r in range(rows):
        how, line, up = r % 5, flat[r], flat[r - 1] if r else np.zeros(columns * channels, int)
        out = []
        for i, v in enumerate(line):
            left, corner = (line[i - channels], up[i - channels]) if i >= channels else (0, 0)
            p = left + up[i] - corner
            paeth = min(((abs(p - x), k, x) for k, x in enumerate((left, up[i], corner))))[2]
            out.append((v - (0, left, up[i], (left + up[i]) // 2, paeth)[how]) % 256)
        body += bytes([how, *out])
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return codecs.PNG_SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", columns, rows, 8, codecs.PNG_COLOURS[channels], 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def test_png_filters():
    for channels in (1, 3):
        image = np.random.default_rng(2).integers(0, 256, (11, 9, channels)).astype(np.uint8)
        assert (codecs.decode_png(filtered(image)) == image).all()


def test_layer_documents(spark, tmp_path):
    info = layers.create_info((1000, 1000, 100), (4, 4, 40), (64, 64, 64), "uint8", max_mip=2)
    assert len(catalog.only_finest(info)["scales"]) == 1 and len(info["scales"]) == 3
    spec = catalog.sharded_image(info, 1, 1)["scales"][1]["sharding"]
    assert spec["preshift_bits"] + spec["minishard_bits"] + spec["shard_bits"] == 7 and "sharding" not in info["scales"][1]
    seg = catalog.with_encoding(info, 0, "compressed_segmentation")
    assert seg["scales"][0]["compressed_segmentation_block_size"] == [8, 8, 8]
    jpeg = catalog.with_encoding(seg, 0, "jpeg", 80)["scales"][0]
    assert jpeg["jpeg_quality"] == 80 and "compressed_segmentation_block_size" not in jpeg
    with pytest.raises(ValueError):
        catalog.with_encoding(info, 0, "raw", 3)
    mesh = {"@type": "neuroglancer_legacy_mesh", "spatial_index": None}
    many = catalog.multi_resolution(catalog.sharded(mesh, 10**6), 10, (4, 4, 40))
    assert many["sharding"]["minishard_bits"] == 9 and many["transform"] == [4, 0, 0, 0, 0, 4, 0, 0, 0, 0, 40, 0]
    assert catalog.unsharded(catalog.single_resolution(many)) == mesh
    with pytest.raises(ValueError):
        catalog.multi_resolution(mesh, 12, (1, 1, 1))
    for name, doc in (("v", info), ("m", mesh), ("s", {"@type": "neuroglancer_skeletons"}), ("a", {"@type": "neuroglancer_annotations_v1"})):
        layers.write_object(f"{tmp_path}/{name}/info", json.dumps(doc).encode())
    assert [catalog.layer_kind(f"{tmp_path}/{n}") for n in "vmsa"] == ["volume", "mesh", "skeletons", "annotations"]
    kind, (vertices, faces) = catalog.open_any(spark, f"{tmp_path}/m")
    assert kind == "mesh" and vertices.count() == 0 and faces.count() == 0
    with pytest.raises(FileNotFoundError):
        catalog.layer_kind(f"{tmp_path}/nothing")
    with pytest.raises(codecs.Unsupported):
        layers.local("s3://bucket/layer")


def test_object_settings():
    assert [catalog.content_type(e) for e in ("png", "crackle", "raw")] == ["image/png", "image/x.crackle", "application/octet-stream"]
    assert [catalog.compression_for(*x) for x in (("raw",), ("png",), ("raw", False), ("png", True), ("png", "zstd"))] == ["gzip", None, None, "gzip", "zstd"]
    assert [catalog.cache_control(x) for x in (None, True, False, 60, "private")] == ["max-age=3600, s-max-age=3600"] * 2 + ["no-cache", "max-age=60, s-max-age=60", "private"]
    with pytest.raises(ValueError):
        catalog.cache_control(-1)


def test_intermediate_tables_can_be_released(spark):
    kept = session.cut(spark.range(5))
    folder = layers.local(session._own_folder(spark))
    assert kept.count() == 5 and os.listdir(folder)
    session.release(spark)
    assert not os.path.exists(folder)
    assert session.cut(spark.range(3)).count() == 3
