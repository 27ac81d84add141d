"""Transfers carry channels, frames and the fill value."""

import numpy as np
import pytest

from chunkloom.operators import sharding
from chunkloom.sources import codecs, layers


def stored(path, frames, fill, dtype="uint16"):
    """A zarr 2 layer of 3 channels in chunks of one, only some chunks stored; its voxels."""
    s = layers.Scale("zarr2", f"{path}/0", dtype, (5, 4, 3), (4, 4, 2), (0, 0, 0), (1, 1, 1), 3, frames, ("t", "c", "z", "y", "x"), codecs=[np.dtype(dtype).newbyteorder("<").str, "zlib"], separator=".", order="C", fill=fill)
    layers.write_zarr2_metadata(path, s)
    a = np.full((5, 4, 3, 3, frames), fill, dtype)
    for t in range(frames):
        for c in range(3):
            part = np.arange(4 * 4 * 2).reshape(4, 4, 2) + 100 * c + 1000 * t
            part[0, 0, 0] = 0
            a[:4, :, :2, c, t] = part
            layers.write_object(layers.chunk_path(s, (0, 0, 0), c, t), layers.encode(s, part[..., None]))
    return sorted((*k, v.item()) for k, v in np.ndenumerate(a))


def voxels(spark, path):
    return sorted(map(tuple, layers.read_layer(spark, path).collect()))


@pytest.mark.parametrize("frames,how", [(2, dict(layer_format="zarr3", compress="zstd")), (2, dict(layer_format="zarr2", compress="zlib")), (1, dict(layer_format="zarr3")), (1, dict()), (1, dict(spec=sharding.Spec(0, 1, 1)))])
@pytest.mark.parametrize("fill", [0, 7])
def test_channels_frames_and_fill(spark, tmp_path, frames, how, fill):
    want = stored(f"{tmp_path}/a", frames, fill)
    assert voxels(spark, f"{tmp_path}/a") == want
    layers.transfer(spark, f"{tmp_path}/a", f"{tmp_path}/b", chunk=(2, 4, 2), **how)
    assert voxels(spark, f"{tmp_path}/b") == want


def test_floats_and_a_fill_that_is_no_number(spark, tmp_path):
    want = stored(f"{tmp_path}/a", 1, float("nan"), "float32")
    layers.transfer(spark, f"{tmp_path}/a", f"{tmp_path}/b", layer_format="zarr3")
    assert list(map(repr, voxels(spark, f"{tmp_path}/b"))) == list(map(repr, want))


def test_frames_are_refused_by_precomputed(spark, tmp_path):
    stored(f"{tmp_path}/a", 2, 0)
    with pytest.raises(codecs.Unsupported, match="2 frames"):
        layers.transfer(spark, f"{tmp_path}/a", f"{tmp_path}/b")
