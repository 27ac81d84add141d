"""Short streams are read together, and tasks write objects without waiting for each other."""

import os

import numpy as np
import pytest

from chunkloom.sources import layers, sparse


def _streams(name: str, words: int, n: int = 40, size: int = 3_600_000):
    rng = np.random.default_rng(words)
    at = [np.sort(rng.choice(size // 4, words, replace=False)) * 4 for _ in range(n)]
    given = rng.integers(1, 256, (n * words, 4)).astype(np.uint8)
    return at, given, sparse.compressed(name, np.full(n, size), np.repeat(np.arange(n), words), np.concatenate(at), given)


@pytest.mark.parametrize("words", [1, 16, 65])
def test_short_zstd_frames_are_read_together(monkeypatch, words):
    at, given, data = _streams("zstd", words)
    monkeypatch.setattr(sparse, "_frame", lambda d: pytest.fail("one by one"))
    broken = [data[0][:-1], data[1] + b"\0", data[2][:5] + b"\0" + data[2][6:], data[3][:9], data[4][:10]]
    got = sparse.expanded("zstd", [*broken, *data])
    assert got[:5] == [None] * 5
    for k, (size, places, byte) in enumerate(got[5:]):
        raw = np.zeros(size, np.uint8)
        raw[places] = byte
        assert size == 3_600_000 and (raw[at[k][:, None] + np.arange(4)] == given[k * words : (k + 1) * words]).all() and len(byte) == words * 4


@pytest.mark.parametrize("name", ["gzip", "zlib"])
def test_deflate_streams_of_few_words_are_read_in_larger_groups(monkeypatch, name):
    at, given, data = _streams(name, 65)
    groups = []
    monkeypatch.setattr(sparse, "_inflated", lambda bodies, read=sparse._inflated: groups.append(len(bodies)) or read(bodies))
    got = sparse.expanded(name, [data[0][:60] + data[0][70:], *data[1:]])
    assert got[0] is None and max(groups) >= 12
    for k, (size, places, byte) in enumerate(got[1:], 1):
        assert size == 3_600_000 and (places == (at[k][:, None] + np.arange(4)).reshape(-1)).all() and (byte == given[k * 65 : (k + 1) * 65].reshape(-1)).all()


def test_parts_of_objects_lie_in_a_folder_of_the_process(tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(os, "replace", lambda a, b, move=os.replace: seen.append((a, b)) or move(a, b))
    for k in range(3):
        layers.write_object(f"{tmp_path}/layer/c/{k}", b"%d" % k, f"{tmp_path}/layer")
    held = {os.path.dirname(a) for a, _ in seen}
    assert len(held) == 1 and not held & {f"{tmp_path}/layer", f"{tmp_path}/layer/c"}
    layers.leave(f"{tmp_path}/layer")
    layers.leave(f"{tmp_path}/layer")
    assert os.listdir(f"{tmp_path}/layer") == ["c"] and sorted(os.listdir(f"{tmp_path}/layer/c")) == ["0", "1", "2"]
