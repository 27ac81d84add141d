"""Chunked volumes in files as a Spark data source, and their writers.

``spark.read.format("chunked_volume").option("mip", 0).load(path)`` yields ``x, y, z, c,
t, value`` rows of precomputed (unsharded or sharded), zarr 2, zarr 3 and N5 layers; the
format is told from the metadata files or given as ``layer_format``.  Filters on x, y
and z are pushed down to the list of chunks, a partition reads a few chunks, and the
option ``skip_background`` leaves out background voxels.  The driver only counts chunks:
a partition is a range of numbers of which the executor works out its chunks, and of
shard files only the byte ranges of wanted chunks are read.  Paths have to be mounted on
all executors.

Chunks are also handled undecoded: listed, looked up, deleted, and transferred, which
decodes voxels only where the two layers' chunks differ.
"""

from __future__ import annotations

import json
import math
import os
import shutil
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from chunkloom.functions.boxes import Corners, reify  # noqa: F401  (re-exported for index expressions)
from chunkloom.operators import sharding
from chunkloom.operators.volume import GXYZ, XYZ, Volume
from chunkloom.session import cut
from chunkloom.sources import codecs, sparse
from chunkloom.sources.shards import ShardFile

#: Chunks that a partition takes at least, and how many at most while there are fewer
#: partitions than allowed; between them a grid makes about ``PARTITIONS`` of them.
CHUNKS_PER_PARTITION, MOST_PER_PARTITION, PARTITIONS = 64, 8192, 256
#: The driver plans no more partitions than this; beyond it they take more chunks each.
MAX_PARTITIONS = 20_000
#: Rows and bytes that are handed over at once, so that small chunks share a batch.
ROWS_OUT, BYTES_OUT = 1 << 16, 16 << 20
#: Sparse chunks that are encoded or decoded at once, and shard files that a task keeps open.
TOGETHER, OPEN_SHARDS = 256, 64
#: Bytes of sparse chunks that are decoded at once, at most and the last chunk.
BYTES_TOGETHER = 1 << 20
#: Of zstd, chunks are made without their background where at most one voxel in so many is stored.
SPARSE_ZSTD = 128
#: How voxel types are carried in Spark, which has no unsigned types.
SPARK_TYPES = {"uint8": "int", "int8": "int", "uint16": "int", "int16": "int", "uint32": "bigint", "int32": "int", "uint64": "bigint", "int64": "bigint", "float32": "float", "float64": "double"}


def local(path: str) -> str:
    """A path that is mounted on all machines; object stores are refused by name."""
    if "://" in path and not path.startswith("file://"):
        raise codecs.Unsupported(f"files in {path.split('://')[0]}")
    return path.removeprefix("file://")


def _json(path: str) -> dict | None:
    try:
        with open(path) as f:
            return json.load(f)
    except FileNotFoundError:
        return None


@dataclass
class Scale:
    """One level of a layer, whatever its format."""

    layer_format: str
    root: str
    dtype: str
    size: tuple[int, ...]
    chunk: tuple[int, ...]
    offset: tuple[int, ...]
    resolution: tuple[float, ...]
    channels: int = 1
    frames: int = 1
    axes: tuple[str, ...] = ("x", "y", "z", "c")
    encoding: str = "raw"
    codecs: list = field(default_factory=list)
    separator: str = "/"
    prefix: str = ""
    order: str = "F"
    fill: float = 0
    channel_chunk: int = 1
    frame_chunk: int = 1
    block: tuple[int, ...] = (8, 8, 8)
    spec: dict | None = None

    def grid(self) -> tuple[int, ...]:
        return tuple(-(-s // c) for s, c in zip(self.size, self.chunk))

    def box(self, g: Sequence[int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
        lo = tuple(o + i * c for o, i, c in zip(self.offset, g, self.chunk))
        return lo, tuple(min(a + c, o + s) for a, c, o, s in zip(lo, self.chunk, self.offset, self.size))


# --- metadata -------------------------------------------------------------------------


def open_layer(path: str, layer_format: str | None = None) -> list[Scale]:
    """All levels of a layer."""
    path = local(path).rstrip("/")
    found = layer_format or ("precomputed" if os.path.exists(f"{path}/info") else "zarr3" if os.path.exists(f"{path}/zarr.json") else "zarr2" if os.path.exists(f"{path}/.zattrs") else "n5" if os.path.exists(f"{path}/attributes.json") else None)
    if found not in OPENERS:
        raise FileNotFoundError(f"no layer at {path}")
    return OPENERS[found](path)


def _open_precomputed(path: str) -> list[Scale]:
    info = _json(f"{path}/info")
    out = []
    for s in info["scales"]:
        out.append(Scale("precomputed", f"{path}/{s['key']}", info["data_type"], tuple(s["size"]), tuple(s["chunk_sizes"][0]), tuple(s.get("voxel_offset", (0, 0, 0))), tuple(s["resolution"]), info["num_channels"], encoding=s["encoding"], channel_chunk=info["num_channels"], block=tuple(s.get("compressed_segmentation_block_size", (8, 8, 8))), spec=s.get("sharding")))
    return out


def _axes(ms: dict, ndim: int) -> tuple[str, ...]:
    named = [a if isinstance(a, str) else a.get("name", "") for a in ms.get("axes", [])]
    return tuple(n.lower() for n in named) if len(named) == ndim else ("t", "c", "z", "y", "x")[-ndim:]


def _by_axis(axes: Sequence[str], values: Sequence, names: str = "xyz", default=1) -> tuple:
    at = dict(zip(axes, values))
    return tuple(at.get(n, default) for n in names)


def _transforms(*lists) -> tuple[list, list]:
    """Products of the scales and sums of the translations."""
    scale: list | None = None
    shift: list | None = None
    for t in (t for ts in lists for t in ([ts] if isinstance(ts, dict) else ts or []) if t):
        if t.get("type") == "scale":
            scale = list(t["scale"]) if scale is None else [a * b for a, b in zip(scale, t["scale"])]
        elif t.get("type") == "translation":
            shift = list(t["translation"]) if shift is None else [a + b for a, b in zip(shift, t["translation"])]
    return scale or [], shift or []


def _ome_scale(fmt: str, root: str, ms: dict, ds: dict, dtype: str, shape: Sequence[int], chunk: Sequence[int], **more) -> Scale:
    axes = _axes(ms, len(shape))
    scale, shift = _transforms(ds.get("coordinateTransformations"), ms.get("coordinateTransformations"))
    res = _by_axis(axes, scale or [1.0] * len(axes), default=1.0)
    off = tuple(int(math.floor(s / r)) for s, r in zip(_by_axis(axes, shift or [0.0] * len(axes), default=0.0), res))
    cc, tt = _by_axis(axes, chunk, "c")[0], _by_axis(axes, chunk, "t")[0]
    return Scale(fmt, root, dtype, _by_axis(axes, shape), _by_axis(axes, chunk), off, res, _by_axis(axes, shape, "c")[0], _by_axis(axes, shape, "t")[0], axes, channel_chunk=cc, frame_chunk=tt, **more)


def _fill(a: dict) -> float:
    """The fill value of an array's metadata; JSON has names for what are no numbers."""
    fill = a.get("fill_value") or 0
    return float(fill) if fill in ("NaN", "Infinity", "-Infinity") else fill


def _named_fill(fill: float) -> float | str:
    return fill if math.isfinite(fill) else "NaN" if math.isnan(fill) else "Infinity" if fill > 0 else "-Infinity"


def _open_zarr3(path: str) -> list[Scale]:
    top = _json(f"{path}/zarr.json")
    attrs = top.get("attributes") or {}
    ms = ((attrs.get("ome") or {}).get("multiscales") or attrs.get("multiscales") or [{"datasets": [{"path": ""}]}])[0]
    out = []
    for ds in ms["datasets"]:
        root = f"{path}/{ds['path']}".rstrip("/")
        a = _json(f"{root}/zarr.json") if ds["path"] else top
        key = a.get("chunk_key_encoding", {"name": "default"})
        sep = (key.get("configuration") or {}).get("separator", "/" if key["name"] == "default" else ".")
        out.append(_ome_scale("zarr3", root, ms, ds, a["data_type"], a["shape"], a["chunk_grid"]["configuration"]["chunk_shape"], codecs=a["codecs"], separator=sep, prefix="c" if key["name"] == "default" else "", order="C", fill=_fill(a)))
    return out


def _open_zarr2(path: str) -> list[Scale]:
    ms = (_json(f"{path}/.zattrs") or {}).get("multiscales", [{"datasets": [{"path": "0"}]}])[0]
    out = []
    for ds in ms["datasets"]:
        root = f"{path}/{ds['path']}"
        a = _json(f"{root}/.zarray")
        comp = a.get("compressor")
        out.append(_ome_scale("zarr2", root, ms, ds, np.dtype(a["dtype"]).name, a["shape"], a["chunks"], codecs=[a["dtype"], comp["id"] if comp else ""], separator=a.get("dimension_separator", "."), order=a["order"], fill=_fill(a)))
    return out


def _open_n5(path: str) -> list[Scale]:
    top = _json(f"{path}/attributes.json")
    px = top.get("pixelResolution") or top.get("resolution") or [1, 1, 1]
    res = px["dimensions"] if isinstance(px, dict) else px
    factors = top.get("scales") or top.get("downsamplingFactors") or [[1, 1, 1]]
    out = []
    for k, f in enumerate(factors):
        a = _json(f"{path}/s{k}/attributes.json") or (top if k == 0 else None)
        if a is None:
            break
        comp = a["compression"]
        out.append(Scale("n5", f"{path}/s{k}", a["dataType"], tuple(a["dimensions"][:3]), tuple(a["blockSize"][:3]), (0, 0, 0), tuple(r * g for r, g in zip(res, f)), axes=("x", "y", "z"), codecs=[comp["type"] if isinstance(comp, dict) else comp]))
    return out


OPENERS = {"precomputed": _open_precomputed, "zarr3": _open_zarr3, "zarr2": _open_zarr2, "n5": _open_n5}


# --- chunks ---------------------------------------------------------------------------


def chunk_path(s: Scale, g: Sequence[int], c: int = 0, t: int = 0) -> str:
    if s.layer_format == "precomputed":
        lo, hi = s.box(g)
        return f"{s.root}/" + "_".join(f"{a}-{b}" for a, b in zip(lo, hi))
    at = dict(zip("xyz", g)) | {"c": c, "t": t}
    key = s.separator.join(str(at[a]) for a in s.axes)
    return f"{s.root}/{s.prefix}{s.separator if s.prefix else ''}{key}"


#: Objects of a folder that a task misses before it lists the folder, and the names that it
#: lists at most; the objects of larger folders are asked for one by one.
MISSES, MOST_LISTED = 16, 200_000
#: Seconds that a folder has to be unchanged before a process keeps its names, and folders kept.
SETTLED, FOLDERS_KEPT = 2, 8
_LISTED: dict[str, tuple[tuple[int, int], frozenset[str] | None]] = {}


def listed(folder: str) -> frozenset[str] | None:
    """The names in a folder, none where it is missing; None if they are too many."""
    try:
        now = os.stat(folder)
        mark = now.st_ino, now.st_mtime_ns
        if _LISTED.get(folder, (None,))[0] == mark:
            return _LISTED[folder][1]
        with os.scandir(folder) as found:
            names = [e.name for e in islice(found, MOST_LISTED + 1)]
    except (FileNotFoundError, NotADirectoryError):
        return frozenset()
    out = frozenset(names) if len(names) <= MOST_LISTED else None
    if time.time() - now.st_mtime > SETTLED:
        if len(_LISTED) >= FOLDERS_KEPT:
            _LISTED.pop(next(iter(_LISTED)), None)
        _LISTED[folder] = mark, out
    return out


class Present:
    """Which objects of a task are there: once some of a folder are missing, its names are
    listed instead of asking for each object under each suffix."""

    def __init__(self) -> None:
        self.missed: dict[str, int] = {}
        self.names: dict[str, frozenset[str] | None] = {}

    def may_be(self, path: str) -> Sequence[str]:
        """The suffixes under which the object may be stored."""
        folder, _, name = path.rpartition("/")
        if self.missed.get(folder, 0) < MISSES:
            return ("", *codecs.SUFFIXES)
        if folder not in self.names:
            self.names[folder] = listed(folder)
        names = self.names[folder]
        return ("", *codecs.SUFFIXES) if names is None else [x for x in ("", *codecs.SUFFIXES) if name + x in names]

    def miss(self, path: str) -> None:
        folder = path.rpartition("/")[0]
        self.missed[folder] = self.missed.get(folder, 0) + 1

    def packed(self, path: str) -> tuple[bytes, str] | None:
        found = read_packed(path, self.may_be(path))
        if found is None:
            self.miss(path)
        return found

    def paths(self, path: str) -> list[str]:
        found = [path + x for x in self.may_be(path) if os.path.exists(path + x)]
        if not found:
            self.miss(path)
        return found


def read_packed(path: str, suffixes: Sequence[str] = ("", *codecs.SUFFIXES)) -> tuple[bytes, str] | None:
    """An object's bytes as they are stored and how they are compressed, whatever suffix it has."""
    for suffix in suffixes:
        how = codecs.SUFFIXES.get(suffix, "")
        try:
            with open(path + suffix, "rb") as f:
                return f.read(), how
        except FileNotFoundError:
            continue
    return None


def read_object(path: str) -> bytes | None:
    """An object's bytes, whatever suffix it was stored with."""
    found = read_packed(path)
    return found and codecs.stream(found[1])[1](found[0])


def write_object(path: str, data: bytes, aside: str | None = None) -> None:
    """Written aside and renamed, so that a retried task leaves one whole object.

    In a folder of many objects new names are slow, the more so if tasks take turns; with
    another folder ``aside`` for the part each object is one name there instead of two.  The
    part lies in a folder of the process below it, so that tasks don't wait for each other.
    """
    part = f"{own_folder(aside)}/part" if aside else f"{path}.{os.getpid()}.part"
    for again in (True, False):
        try:
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, path)
            return
        except FileNotFoundError:  # folders are made where they are missing
            if not again:
                raise
            os.makedirs(os.path.dirname(path), exist_ok=True)
            os.makedirs(os.path.dirname(part), exist_ok=True)


#: The name of each process for the parts of objects; processes may be forked.
_MINE: dict[int, str] = {}


def own_folder(aside: str) -> str:
    return f"{aside}/.{_MINE.setdefault(os.getpid(), uuid.uuid4().hex)}"


def leave(aside: str) -> None:
    """Removes the folder for parts, which is empty unless a task was broken off."""
    try:
        os.rmdir(own_folder(aside))
    except OSError:
        pass


ORDER = ("x", "y", "z", "c", "t")


def copy_object(source: str, target: str) -> int:
    """Copies a file in blocks, aside and renamed; its size."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.{os.getpid()}.part"
    shutil.copyfile(source, part)
    os.replace(part, target)
    return os.path.getsize(target)


def _in_order(s: Scale, a: np.ndarray) -> np.ndarray:
    """An array in stored axis order as (x, y, z, c, t)."""
    axes = [*s.axes, *(n for n in ORDER if n not in s.axes)]
    return a.reshape(a.shape + (1,) * (len(axes) - a.ndim)).transpose([axes.index(n) for n in ORDER])


def decode(s: Scale, data: bytes, shape: Sequence[int]) -> np.ndarray:
    """A stored chunk as (x, y, z, c, t) voxels, its space cropped to ``shape``."""
    return decode_whole(s, data, shape)[: shape[0], : shape[1], : shape[2]]


def decode_whole(s: Scale, data: bytes, shape: Sequence[int]) -> np.ndarray:
    """The same with what is stored beyond ``shape``, a view of memory without gaps."""
    dtype = np.dtype(s.dtype)
    if s.layer_format == "precomputed":
        return codecs.decode_chunk(data, s.encoding, (*shape, s.channel_chunk), dtype, s.block)[..., None]
    if s.layer_format == "n5":
        mode, n = np.frombuffer(data, ">u2", 2)
        if mode:
            raise codecs.Unsupported("N5 blocks of varying length")
        dims = np.frombuffer(data, ">u4", n, 4)
        raw = codecs.stream(s.codecs[0])[1](data[4 + 4 * n :])
        return np.frombuffer(raw, dtype.newbyteorder(">")).astype(dtype).reshape([int(d) for d in dims], order="F")[..., None, None]
    full = [dict(zip("xyz", s.chunk), c=s.channel_chunk, t=s.frame_chunk)[a] for a in s.axes]
    if s.layer_format == "zarr2":
        a = np.frombuffer(codecs.stream(s.codecs[1])[1](data), np.dtype(s.codecs[0])).reshape(full, order=s.order)
    else:
        perm, kind = list(range(len(full))), dtype
        for c in reversed(s.codecs):
            conf = c.get("configuration") or {}
            if c["name"] == "crc32c":
                if codecs.crc32c(data[:-4]) != int.from_bytes(data[-4:], "little"):
                    raise ValueError("checksum does not match")
                data = data[:-4]
            elif c["name"] == "transpose":
                perm = conf["order"]
            elif c["name"] == "bytes":
                kind = dtype.newbyteorder(">" if conf.get("endian") == "big" else "<")
            else:
                data = codecs.stream(c["name"])[1](data)
        a = np.frombuffer(data, kind).reshape([full[p] for p in perm]).transpose(np.argsort(perm))
    return _in_order(s, a)


def _fastest(s: Scale) -> list[str]:
    """Axes in the order of the stored bytes, the fastest first."""
    order = [*ORDER]
    if s.layer_format != "precomputed":
        order = [*s.axes]
        for c in s.codecs if s.layer_format == "zarr3" else ():
            if c["name"] == "transpose":
                order = [order[k] for k in c["configuration"]["order"]]
        order = [n for n in ORDER if n not in order] + (order if s.layer_format == "zarr3" or s.order == "C" else order[::-1])
        order.reverse()
    return order


def blank(s: Scale, shape: Sequence[int]) -> np.ndarray:
    """(x, y, z, c, t) background voxels of a chunk, in memory as they will be stored:
    precomputed chunks cropped to ``shape``, others whole."""
    dtype, order = np.dtype(s.dtype), _fastest(s)
    sizes = dict(zip(ORDER, (*(shape if s.layer_format == "precomputed" else s.chunk), s.channel_chunk, s.frame_chunk)))
    a = np.zeros([sizes[n] for n in reversed(order)], dtype) if s.fill == 0 else np.full([sizes[n] for n in reversed(order)], s.fill, dtype)
    return a.transpose([len(order) - 1 - order.index(n) for n in ORDER])


def encode(s: Scale, a: np.ndarray, sparse: bool = False) -> bytes:
    """(x, y, z, c, t) voxels as a stored chunk; zarr chunks are filled up to full size.

    Voxels without a last axis are one frame; ``sparse`` ones are nearly all background.
    """
    dtype = np.dtype(s.dtype)
    a = a[..., None] if a.ndim == 4 else a
    if s.layer_format == "precomputed":
        return codecs.encode_chunk(np.asfortranarray(a[..., 0].astype(dtype, copy=False)), s.encoding, s.block, sparse)
    if s.layer_format == "n5":
        raise codecs.Unsupported("writing N5")
    full = a if a.shape == (*s.chunk, s.channel_chunk, s.frame_chunk) else blank(s, s.chunk)
    if full is not a:
        full[tuple(slice(0, n) for n in a.shape)] = a
    gone = tuple(i for i, n in enumerate(ORDER) if n not in s.axes)
    kept = [n for n in ORDER if n in s.axes]
    out = full.squeeze(gone).transpose([kept.index(n) for n in s.axes])
    if s.layer_format == "zarr2":
        return codecs.packed(s.codecs[1], out.astype(np.dtype(s.codecs[0]), copy=False).tobytes(s.order), sparse)
    data = b""
    for c in s.codecs:
        conf = c.get("configuration") or {}
        if c["name"] == "transpose":
            out = out.transpose(conf["order"])
        elif c["name"] == "bytes":
            data = out.astype(dtype.newbyteorder(">" if conf.get("endian") == "big" else "<"), copy=False).tobytes()
        elif c["name"] == "crc32c":
            data += codecs.crc32c(data).to_bytes(4, "little")
        else:
            data = codecs.packed(c["name"], data, sparse)
    return data


def stored_voxels(s: Scale, a: np.ndarray, shape: Sequence[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Positions within ``shape`` of what is not background in a whole chunk, and the values;
    looked for in the order of the memory."""
    order = sorted(range(5), key=lambda d: -a.strides[d])
    flat = a.transpose(order).reshape(-1)
    at = np.flatnonzero(flat != s.fill)
    near = dict(zip(order, np.unravel_index(at, [a.shape[d] for d in order])))
    idx, v = [near[d] for d in range(5)], flat[at]
    if a.shape != tuple(shape):
        held = np.logical_and.reduce([i < n for i, n in zip(idx, shape)])
        idx, v = [i[held] for i in idx], v[held]
    return idx, v


def sparse_stream(s: Scale, outer: str | None) -> str | None:
    """The stream of ``sparse`` that makes up a stored chunk, given how its file is compressed."""
    name = codecs.ALIASES.get(outer, outer)
    if s.fill != 0:
        return None
    if s.layer_format == "precomputed" and s.encoding == "png":
        name = "zlib" if name in ("", "raw") and s.dtype == "uint8" and s.channel_chunk == 1 else None
    elif s.layer_format == "zarr2":
        name = None if s.codecs[0].startswith(">") else codecs.ALIASES.get(s.codecs[1], s.codecs[1])
    elif s.layer_format == "zarr3":
        steps = [c for c in s.codecs if c["name"] != "transpose"]
        plain = steps and steps[0]["name"] == "bytes" and (steps[0].get("configuration") or {}).get("endian") != "big"
        name = steps[1]["name"] if plain and [c["name"] for c in steps[2:]] in ([], ["crc32c"]) and len(steps) > 1 else None
    elif s.layer_format != "precomputed" or s.encoding != "raw":
        name = None
    return name if name in ("gzip", "zlib", "zstd") else None


def _lengths(s: Scale, boxes: Sequence) -> dict[str, np.ndarray]:
    """Stored voxels along each axis of each chunk."""
    cropped = np.array([[b - a for a, b in zip(*box)] for box in boxes], np.int64).reshape(-1, 3)
    space = cropped if s.layer_format == "precomputed" else np.broadcast_to(np.array(s.chunk, np.int64), cropped.shape)
    more = {n: np.full(len(cropped), k, np.int64) for n, k in (("c", s.channel_chunk), ("t", s.frame_chunk))}
    return {n: space[:, d] for d, n in enumerate(XYZ)} | more


def encode_sparse(s: Scale, name: str, boxes: Sequence, ats: Sequence[np.ndarray], values: Sequence[np.ndarray]) -> list[bytes | None]:
    """Stored chunks of a few voxels each, made without their background; ``ats`` number the
    voxels of a whole chunk, x fastest.  None for a chunk without any."""
    lengths, owner = _lengths(s, boxes), np.repeat(np.arange(len(boxes)), [len(a) for a in ats])
    left, digits = np.concatenate(ats).astype(np.int64), {}
    for n, size in zip(ORDER, (*s.chunk, s.channel_chunk, s.frame_chunk)):
        left, digits[n] = np.divmod(left, size)
    at, total = np.zeros(len(owner), np.int64), np.ones(len(boxes), np.int64)
    for n in _fastest(s):
        at += digits[n] * total[owner]
        total = total * lengths[n]
    words = np.concatenate(values).astype(np.dtype(s.dtype).newbyteorder("<"))
    if ((owner[1:] == owner[:-1]) & (at[1:] < at[:-1])).any():
        order = np.lexsort((at, owner))
        at, owner, words = at[order], owner[order], words[order]
    words = words.view(np.uint8).reshape(len(at), -1)
    kept = np.append((at[1:] != at[:-1]) | (owner[1:] != owner[:-1]), True) & words.any(axis=1)  # the last of equal places
    at, owner, words = at[kept], owner[kept], words[kept]
    out: list[bytes | None] = [None] * len(boxes)
    full, owner = np.unique(owner, return_inverse=True)
    if not len(full):
        return out
    sizes, width = total[full] * words.shape[1], lengths["x"][full]
    png = s.layer_format == "precomputed" and s.encoding == "png"
    if png:  # a byte in front of each line
        at, sizes = at + at // width[owner] + 1, sizes + sizes // width
    for k, w, n, data in zip(full.tolist(), width.tolist(), sizes.tolist(), sparse.compressed(name, sizes, owner, at if png else at * words.shape[1], words)):
        if s.layer_format == "zarr3" and s.codecs[-1]["name"] == "crc32c":
            data += codecs.crc32c(data).to_bytes(4, "little")
        out[k] = codecs.png_file(w, n // (w + 1), 8, 1, data) if png else data
    return out


def sparse_body(s: Scale, name: str, data: bytes, box: Corners) -> bytes | None:
    """The stream in a stored chunk if ``sparse`` made it."""
    if s.layer_format == "precomputed" and s.encoding == "png":
        x, y, z = (b - a for a, b in zip(*box))
        data = codecs.png_body(data, x, y * z) or b""
    if s.layer_format == "zarr3" and s.codecs[-1]["name"] == "crc32c" and sparse.told(name, data):
        if codecs.crc32c(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("checksum does not match")
        data = data[:-4]
    return data if sparse.told(name, data) else None


def decode_sparse(s: Scale, name: str, boxes: Sequence, bodies: Sequence[bytes]) -> tuple[list[int], np.ndarray, list[np.ndarray], np.ndarray]:
    """Chunks that could not be read so; of the others' voxels their chunk, their place in
    it as (x, y, z, c, t), and their values."""
    lengths, kind = _lengths(s, boxes), np.dtype(s.dtype).newbyteorder("<")
    png, width = s.layer_format == "precomputed" and s.encoding == "png", kind.itemsize
    total = np.prod([lengths[n] for n in ORDER], axis=0) * width
    lines = lengths["x"] + 1
    sizes = total + total // lengths["x"] if png else total
    got = sparse.expanded(name, bodies)
    bad = [k for k, (g, n, line) in enumerate(zip(got, sizes.tolist(), lines.tolist())) if g is None or g[0] != n or png and (g[1] % line == 0).any()]
    good = np.delete(np.arange(len(got)), bad)
    none = np.zeros(0, np.int64)
    if not len(good):
        return bad, none, [none] * 5, none.astype(kind)
    base = np.cumsum(total) - total
    owner = np.repeat(good, [len(got[k][1]) for k in good])
    place = np.concatenate([got[k][1] for k in good])
    if png:
        place = place - place // lines[owner] - 1
    number, words = sparse.as_words(place + base[owner], np.concatenate([got[k][2] for k in good]), width)
    owner = np.searchsorted(base, number * width, "right") - 1
    left, digits = number - base[owner] // width, {}
    for n in _fastest(s):
        left, digits[n] = np.divmod(left, lengths[n][owner])
    return bad, owner, [digits[n] for n in ORDER], words.view(kind).reshape(-1).astype(kind.newbyteorder("="))


def rows_of(s: Scale, lo: Sequence, idx: Sequence[np.ndarray], v: np.ndarray, c0, t0, kind: str) -> list[np.ndarray]:
    """Voxels as columns; where their chunks begin are numbers, or arrays of one for each voxel."""
    if kind == "bigint" and v.dtype == np.uint64:
        v = v.view(np.int64) if v.flags.c_contiguous else np.ascontiguousarray(v).view(np.int64)
    types = {"int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64}
    xyz = [idx[d].astype(np.int64) + lo[d] for d in range(3)]
    return [*xyz, *[(idx[d] + first).astype(np.int32) for d, first in ((3, c0), (4, t0))], v.astype(types[kind])]


class ChunkPlan:
    """The chunks that a box touches, numbered in units: single chunks, or of sharded levels
    the boxes of chunks that share a shard file.  Numbers are dealt out, not lists."""

    def __init__(self, s: Scale, lo: Sequence[int] | None = None, hi: Sequence[int] | None = None) -> None:
        self.scale = s
        lo, hi = lo or s.offset, hi or [o + n for o, n in zip(s.offset, s.size)]
        self.first = [max(0, (a - o) // c) for a, o, c in zip(lo, s.offset, s.chunk)]
        self.last = [min(n, -(-(b - o) // c)) for b, o, c, n in zip(hi, s.offset, s.chunk, s.grid())]
        self.unit = (1, 1, 1)
        if s.spec:
            self.unit = tuple(n // c for n, c in zip(sharding.image_shard_shape(_spec(s.spec), s.size, s.chunk), s.chunk))
        self.from_unit = [a // u for a, u in zip(self.first, self.unit)]
        spans = [max(0, -(-b // u) - f) if b > a else 0 for a, b, u, f in zip(self.first, self.last, self.unit, self.from_unit)]
        self.counts = [*spans, -(-s.channels // s.channel_chunk), -(-s.frames // s.frame_chunk)]
        self.units = math.prod(self.counts)

    def partitions(self) -> list[tuple[int, int]]:
        """Ranges of unit numbers."""
        size = math.prod(min(u, b - a) for u, a, b in zip(self.unit, self.first, self.last)) if self.units else 1
        chunks = min(MOST_PER_PARTITION, max(1 if self.scale.spec else CHUNKS_PER_PARTITION, -(-self.units * size // PARTITIONS)))
        per = max(1, chunks // size, -(-self.units // MAX_PARTITIONS))
        return [(a, min(a + per, self.units)) for a in range(0, self.units, per)] or [(0, 0)]

    def shared(self, units: Iterable[int]) -> Iterator[Iterator[tuple[tuple[int, ...], int, int]]]:
        """The chunks of units: those of a shard file by themselves, single ones all together."""
        if self.scale.spec:
            return (self.chunks(u) for u in units)
        return iter([(k for u in units for k in self.chunks(u))])

    def chunks(self, unit: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
        """(grid position, channel chunk, frame chunk) of a unit's chunks, x fastest."""
        at = []
        for n in self.counts:
            unit, k = divmod(unit, n)
            at.append(k)
        ranges = [range(max(a, (f + k) * u), min(b, (f + k + 1) * u)) for a, b, f, k, u in zip(self.first, self.last, self.from_unit, at, self.unit)]
        for z in ranges[2]:
            for y in ranges[1]:
                for x in ranges[0]:
                    yield (x, y, z), at[3], at[4]


@dataclass
class Units(InputPartition):
    start: int
    stop: int


class VolumeReader(DataSourceReader):
    def __init__(self, s: Scale, skip: bool) -> None:
        self.scale, self.skip = s, skip
        self.lo = list(s.offset)
        self.hi = [o + n for o, n in zip(s.offset, s.size)]

    def pushFilters(self, filters):
        """Bounds on x, y, z narrow the chunks; Spark still applies every filter."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at and len(at) == 1 and at[0] in XYZ and isinstance(getattr(f, "value", None), int):
                d = XYZ.index(at[0])
                if isinstance(f, (GreaterThanOrEqual, EqualTo)):
                    self.lo[d] = max(self.lo[d], f.value)
                if isinstance(f, GreaterThan):
                    self.lo[d] = max(self.lo[d], f.value + 1)
                if isinstance(f, (LessThanOrEqual, EqualTo)):
                    self.hi[d] = min(self.hi[d], f.value + 1)
                if isinstance(f, LessThan):
                    self.hi[d] = min(self.hi[d], f.value)
            yield f

    def partitions(self):
        return [Units(a, b) for a, b in ChunkPlan(self.scale, self.lo, self.hi).partitions()]

    def read(self, partition: Units) -> Iterator[pa.RecordBatch]:
        s, kind = self.scale, SPARK_TYPES[self.scale.dtype]
        plan = ChunkPlan(s, self.lo, self.hi)
        held, n_rows, files, names = [], 0, {}, {}
        short: dict[str, list] = {}
        waiting: dict[str, int] = {}

        def extent(c: int, t: int) -> tuple[int, int, int, int]:
            c0, t0 = c * s.channel_chunk, t * s.frame_chunk
            return c0, t0, min(s.channel_chunk, s.channels - c0), min(s.frame_chunk, s.frames - t0)

        def whole(g, c: int, t: int, data: bytes | None) -> list[np.ndarray]:
            lo, hi = s.box(g)
            shape = [b - a for a, b in zip(lo, hi)]
            c0, t0, n, m = extent(c, t)
            if self.skip:
                idx, v = stored_voxels(s, decode_whole(s, data, shape), (*shape, n, m))
            else:
                a = np.full((*shape, n, m), s.fill, s.dtype) if data is None else decode(s, data, shape)[..., :n, :m]
                idx = [i.reshape(-1) for i in np.indices(a.shape)]
                v = a.reshape(-1)
            return rows_of(s, s.box(g)[0], idx, v, c0, t0, kind)

        def together(name: str) -> Iterator[list[np.ndarray]]:
            some = short.pop(name)
            waiting[name] = 0
            boxes = [box for _, box, *_ in some]
            bad, owner, idx, v = decode_sparse(s, name, boxes, [body for *_, body in some])
            first = np.array([[*box[0], *extent(c, t)[:2]] for (_, c, t), box, *_ in some], np.int64)
            room = np.array([[*(b - a for a, b in zip(*box)), *extent(c, t)[2:]] for (_, c, t), box, *_ in some], np.int64)
            inside = np.logical_and.reduce([i < room[owner, d] for d, i in enumerate(idx)]) & (v != 0)
            idx, v, owner = [i[inside] for i in idx], v[inside], owner[inside]
            yield rows_of(s, first[owner, :3].T, idx, v, first[owner, 3], first[owner, 4], kind)
            for k in bad:
                (g, c, t), _, data, how, _ = some[k]
                yield whole(g, c, t, codecs.repacked(data, how, ""))

        for unit in plan.shared(range(partition.start, partition.stop)):
            for (g, c, t), data, how in chunks_as_stored(s, unit, files):
                if data is None and self.skip:
                    continue
                if how not in names:
                    names[how] = sparse_stream(s, how) if self.skip else None
                name, box = names[how], s.box(g)
                body = sparse_body(s, name, data, box) if name and data is not None else None
                if body is None:
                    found = [whole(g, c, t, data if data is None else codecs.repacked(data, how, ""))]
                else:
                    short.setdefault(name, []).append(((g, c, t), box, data, how, body))
                    waiting[name] = waiting.get(name, 0) + len(body)
                    if len(short[name]) < TOGETHER and waiting[name] < BYTES_TOGETHER:
                        continue
                    found = together(name)
                for part in found:
                    held.append(part)
                    n_rows += len(part[0])
                if n_rows >= ROWS_OUT:
                    yield _batch(held)
                    held, n_rows = [], 0
        for name in [*short]:
            for part in together(name):
                held.append(part)
                n_rows += len(part[0])
        for shard in files.values():
            shard.close()
        if n_rows:
            yield _batch(held)


def _batch(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=[*ORDER, "value"])


def chunks_as_stored(s: Scale, chunks: Iterator[tuple[tuple[int, ...], int, int]], files: dict[int, ShardFile] | None = None) -> Iterator[tuple[tuple[tuple[int, ...], int, int], bytes | None, str]]:
    """Each chunk with its stored bytes, or None, and the stream that its file compresses
    them by.  ``files`` keeps shard files open from one call to the next."""
    if not s.spec:
        there = Present()
        for k in chunks:
            yield k, *(there.packed(chunk_path(s, *k)) or (None, ""))
        return
    spec, grid = _spec(s.spec), s.grid()
    wanted = list(chunks)  # of one shard
    codes = np.array([morton(g, grid) for g, _, _ in wanted], dtype=np.uint64)
    _, shards = spec.place(codes)
    for number in np.unique(shards).tolist():
        mine = np.nonzero(shards == number)[0]
        shard, found = open_shard(s, spec, number, files), set()
        for k, data in shard.payloads(codes[mine], packed=True):
            found.add(k)
            yield wanted[mine[k]], data, spec.data_encoding
        if files is None:
            shard.close()
        for k in set(range(len(mine))) - found:
            yield wanted[mine[k]], None, ""


def open_shard(s: Scale, spec: sharding.Spec, number: int, files: dict[int, ShardFile] | None) -> ShardFile:
    """A shard file, one that is open if there is; the one opened first gives way."""
    if files is not None and number in files:
        return files[number]
    shard = ShardFile(f"{s.root}/{spec.shard_name(number)}.shard", spec)
    if files is not None:
        if len(files) >= OPEN_SHARDS:
            files.pop(next(iter(files))).close()
        files[number] = shard
    return shard


def stored_chunks(s: Scale, chunks: Iterator[tuple[tuple[int, ...], int, int]], packed: str | None = None, files: dict[int, ShardFile] | None = None) -> Iterator[tuple[tuple[tuple[int, ...], int, int], bytes | None]]:
    """Each chunk with its stored bytes, or None: without the stream compression of its file,
    or ``packed`` by the stream of that name, which leaves those as they are that have it."""
    held: list[tuple] = []
    for k, data, how in chunks_as_stored(s, chunks, files):
        if data is None:
            yield k, None
            continue
        if held and (how != held[0][2] or len(held) >= TOGETHER or not packed):
            yield from _repacked(held, packed or "")
            held = []
        held.append((k, data, how))
    yield from _repacked(held, packed or "")


def _repacked(held: list[tuple], packed: str) -> Iterator[tuple[tuple[tuple[int, ...], int, int], bytes]]:
    if held:
        yield from zip([k for k, _, _ in held], codecs.all_repacked([data for _, data, _ in held], held[0][2], packed))


def _spec(d: dict) -> sharding.Spec:
    return sharding.Spec(d["preshift_bits"], d["minishard_bits"], d["shard_bits"], d["hash"], d.get("minishard_index_encoding", "raw"), d.get("data_encoding", "raw"))


def morton(g: Sequence[int], grid: Sequence[int]) -> int:
    """Compressed Morton code of one position on the driver."""
    bits = [max(0, (n - 1).bit_length()) for n in grid]
    code = at = 0
    for i in range(max(bits, default=0)):
        for p, b in zip(g, bits):
            if i < b:
                code |= (p >> i & 1) << at
                at += 1
    if any(p >= n for p, n in zip(g, grid)):
        raise ValueError(f"{tuple(g)} is outside the grid {tuple(grid)}")
    return code


class ChunkedVolume(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunked_volume"

    def _scale(self) -> Scale:
        return open_layer(self.options["path"], self.options.get("layer_format"))[int(self.options.get("mip", "0"))]

    def schema(self) -> str:
        return f"x bigint, y bigint, z bigint, c int, t int, value {SPARK_TYPES[self._scale().dtype]}"

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(self._scale(), self.options.get("skip_background", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    """Makes ``format("chunked_volume")`` known, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkedVolume)


# --- writers --------------------------------------------------------------------------


def create_info(size: Sequence[int], resolution: Sequence[float], chunk: Sequence[int], dtype: str, offset: Sequence[int] = (0, 0, 0), layer_type: str = "segmentation", encoding: str = "raw", channels: int = 1, max_mip: int = 0, factor: Sequence[int] = (2, 2, 1), spec: sharding.Spec | None = None) -> dict:
    """A layer document with its pyramid of scales."""
    info = {"@type": "neuroglancer_multiscale_volume", "type": layer_type, "data_type": dtype, "num_channels": channels, "scales": []}
    for k in range(max_mip + 1):
        f = [n**k for n in factor]
        info["scales"].append(_scale_entry([-(-s // n) for s, n in zip(size, f)], [r * n for r, n in zip(resolution, f)], chunk, [o // n for o, n in zip(offset, f)], encoding, spec))
    return info


def _scale_entry(size, resolution, chunk, offset, encoding, spec=None) -> dict:
    out = {"encoding": encoding, "chunk_sizes": [list(chunk)], "key": "_".join(str(r) for r in resolution), "resolution": list(resolution), "voxel_offset": list(offset), "size": list(size)}
    if encoding == "compressed_segmentation":
        out["compressed_segmentation_block_size"] = [8, 8, 8]
    if spec:
        out["sharding"] = spec.to_dict()
    return out


def add_scale(info: dict, factor: Sequence[float], chunk: Sequence[int] | None = None, encoding: str | None = None) -> dict:
    """A copy of the document with a coarser level; one of equal resolution is replaced."""
    base = info["scales"][0]
    f = [round(x) for x in factor]
    res = [r * n for r, n in zip(base["resolution"], f)]
    entry = _scale_entry([math.ceil(s / n) for s, n in zip(base["size"], f)], res, chunk or closest_divisors(base["chunk_sizes"][0], 64), [math.floor(o / n) for o, n in zip(base["voxel_offset"], f)], encoding or base["encoding"])
    kept = [s for s in info["scales"] if s["resolution"] != res]
    return info | {"scales": [*kept, entry]}


def closest_divisors(sizes: Sequence[int], target: int) -> list[int]:
    """Per axis the divisor nearest to the target; the smaller of two equally near."""
    return [min((d for d in range(1, n + 1) if n % d == 0), key=lambda d: (abs(d - target), d)) for n in sizes]


def to_mip(info: dict, mip) -> int:
    """A level by its number, also negative, or by its resolution."""
    n = len(info["scales"])
    if isinstance(mip, (list, tuple)):
        for k, s in enumerate(info["scales"]):
            if list(s["resolution"]) == [float(r) if isinstance(s["resolution"][0], float) else r for r in mip]:
                return k
        raise LookupError(f"no level of resolution {mip}")
    if not -n <= mip < n:
        raise LookupError(f"no level {mip}")
    return mip % n


def _with_level(levels: list[dict], new: dict) -> list[dict]:
    """The levels of a group with one replaced or added; level 0 begins a new group."""
    kept = [] if new["path"] == "0" else [d for d in levels if d["path"] != new["path"]]
    return sorted([*kept, new], key=lambda d: (len(d["path"]), d["path"]))


def write_zarr3_metadata(path: str, s: Scale) -> None:
    scale = [dict(zip("xyz", s.resolution)).get(a, 1.0) for a in s.axes]
    shift = [dict(zip("xyz", [o * r for o, r in zip(s.offset, s.resolution)])).get(a, 0.0) for a in s.axes]
    kinds = {"t": "time", "c": "channel"}
    axes = [{"name": a, "type": kinds.get(a, "space")} | ({"unit": "nanometer"} if a in "xyz" else {}) for a in s.axes]
    ds = {"path": os.path.basename(s.root), "coordinateTransformations": [{"type": "scale", "scale": scale}, {"type": "translation", "translation": shift}]}
    before = (((_json(f"{path}/zarr.json") or {}).get("attributes") or {}).get("ome") or {}).get("multiscales") or [{"datasets": []}]
    group = {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": "0.5", "multiscales": [{"name": "", "axes": axes, "datasets": _with_level(before[0]["datasets"], ds)}]}}}
    sizes = dict(zip("xyz", s.size)) | {"c": s.channels, "t": s.frames}
    chunks = dict(zip("xyz", s.chunk)) | {"c": s.channel_chunk, "t": s.frame_chunk}
    array = {"zarr_format": 3, "node_type": "array", "shape": [sizes[a] for a in s.axes], "data_type": s.dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [chunks[a] for a in s.axes]}}, "chunk_key_encoding": {"name": "default" if s.prefix else "v2", "configuration": {"separator": s.separator}}, "fill_value": _named_fill(s.fill), "codecs": s.codecs}
    write_object(f"{path}/zarr.json", json.dumps(group).encode())
    write_object(f"{s.root}/zarr.json", json.dumps(array).encode())


def write_zarr2_metadata(path: str, s: Scale) -> None:
    scale = [dict(zip("xyz", s.resolution)).get(a, 1.0) for a in s.axes]
    shift = [dict(zip("xyz", [o * r for o, r in zip(s.offset, s.resolution)])).get(a, 0.0) for a in s.axes]
    ds = {"path": os.path.basename(s.root), "coordinateTransformations": [{"type": "scale", "scale": scale}, {"type": "translation", "translation": shift}]}
    before = (_json(f"{path}/.zattrs") or {}).get("multiscales") or [{"datasets": []}]
    attrs = {"multiscales": [{"version": "0.4", "axes": [{"name": a} for a in s.axes], "datasets": _with_level(before[0]["datasets"], ds)}]}
    sizes = dict(zip("xyz", s.size)) | {"c": s.channels, "t": s.frames}
    chunks = dict(zip("xyz", s.chunk)) | {"c": s.channel_chunk, "t": s.frame_chunk}
    array = {"zarr_format": 2, "shape": [sizes[a] for a in s.axes], "chunks": [chunks[a] for a in s.axes], "dtype": s.codecs[0], "compressor": {"id": s.codecs[1]} if s.codecs[1] else None, "order": s.order, "dimension_separator": s.separator, "fill_value": _named_fill(s.fill), "filters": None}
    write_object(f"{path}/.zattrs", json.dumps(attrs).encode())
    write_object(f"{s.root}/.zarray", json.dumps(array).encode())


def write_layer(volume: Volume, path: str, layer_format: str = "precomputed", dtype: str = "uint32", resolution: Sequence[float] = (1, 1, 1), compress: str = "gzip", encoding: str = "raw", spec: sharding.Spec | None = None, channels: int = 1, frames: int = 1, channel_chunk: int | None = None, frame_chunk: int = 1, level: int = 0, erase: bool = False, least: bool = False) -> DataFrame:
    """Writes a volume's stored chunks in parallel; ``path, n_bytes`` of each object.

    Chunks that hold only background are not written, unless the format has no fill value
    and the background is not 0; with ``erase`` objects that stood in their place are
    deleted.  Voxels may have columns ``c`` and ``t``, numbers of at most ``channels`` and
    ``frames``; precomputed layers hold one frame.  A ``level`` above 0 is added to a layer
    that is there.  Of voxels that are given more than once one value is stored, with
    ``least`` the least one that is not null; so the rows are shuffled once instead of being
    grouped before.  Objects have names that follow from the grid, so a retried task
    replaces what it wrote before.
    """
    path = local(path).rstrip("/")
    s = _new_scale(volume, path, layer_format, dtype, resolution, compress, encoding, spec, channels, frames, channel_chunk or channels, frame_chunk, level)
    suffix = codecs.suffix_of(compress) if layer_format == "precomputed" and not spec else ""
    value = volume.value

    sizes = (*s.chunk, s.channel_chunk, s.frame_chunk)
    counts = (*s.grid(), -(-s.channels // s.channel_chunk), -(-s.frames // s.frame_chunk))

    outer = spec.data_encoding if spec else compress if suffix else ""
    name = sparse_stream(s, outer)
    fewest = SPARSE_ZSTD if name == "zstd" else codecs.SPARSE

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], int, int, bytes]]:
        """Stored chunks, those of a few voxels made together."""
        short, n = [], 0

        def together() -> Iterator[tuple[tuple[int, ...], int, int, bytes]]:
            made = encode_sparse(s, name, [box for _, box, *_ in short], [at for *_, at, _ in short], [v for *_, v in short])
            for ((g, c, t), box, at, values), data in zip(short, made):
                yield g, c, t, whole(box, at, values) if data is None else data

        def whole(box, at: np.ndarray, values: np.ndarray) -> bytes:
            a = blank(s, [q - p for p, q in zip(*box)])
            a[np.unravel_index(at, sizes, order="F")] = values
            few = len(at) * codecs.SPARSE <= a.size
            return codecs.packed(outer, encode(s, a, few), few)

        for number, at, values in _runs(batches, least):
            if (at < 0).any():
                at, values = at[at >= 0], values[at >= 0]
            if least and values.dtype.kind == "f" and np.dtype(dtype).kind != "f":
                values = np.where(np.isnan(values), s.fill, values)  # nulls only
            digits = []
            for k in counts:
                number, d = divmod(number, k)
                digits.append(d)
            *g, c, t = digits
            box = s.box(g)
            shape = [q - p for p, q in zip(*box)] if s.layer_format == "precomputed" else s.chunk
            if name and len(at) and len(at) * fewest <= math.prod(shape) * s.channel_chunk * s.frame_chunk:
                short.append(((tuple(g), c, t), box, at, values))
                n += len(at)
                if n >= ROWS_OUT or len(short) >= TOGETHER:
                    yield from together()
                    short, n = [], 0
            else:
                yield tuple(g), c, t, whole(box, at, values)
        if short:
            yield from together()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for g, c, t, data in payloads(batches):
            at = chunk_path(s, g, c, t) + suffix
            write_object(at, data, path)
            done.append((at, len(data)))
        leave(path)
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "n_bytes": pa.array([n for _, n in done], pa.int64())})

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for g, _, _, data in payloads(batches):
            done.append((morton(g, s.grid()), data))
            size += len(data)
            if size >= BYTES_OUT:
                yield _items(done)
                done, size = [], 0
        yield _items(done)

    ct = [F.col(n).cast("int").alias(n) if n in volume.voxels.columns else F.lit(0).alias(n) for n in "ct"]
    rows = volume.with_chunks(volume.voxels).select(*GXYZ, *XYZ, *ct, F.col(value).alias("value"), F.lit(True).alias("held"))
    if layer_format == "precomputed" and volume.background != 0:  # a chunk that isn't there reads as 0
        zero = {n: F.lit(0).cast(kind) for n, kind in rows.dtypes if n not in (*GXYZ, "held")}
        rows = rows.unionByName(volume.touched_chunks(volume.bounds).withColumns(zero | {"held": F.lit(False)}))
    rows = rows.withColumn("gc", F.floor(F.col("c") / s.channel_chunk)).withColumn("gt", F.floor(F.col("t") / s.frame_chunk))
    if erase and not spec:
        stale = chunk_objects(volume.spark, path, level).join(rows.select(*GXYZ, "gc", "gt").distinct(), [*GXYZ, "gc", "gt"], "left_anti")
        _delete(stale).count()
    within = [(F.col("c") >= 0) & (F.col("c") < s.channels) & (F.col("t") >= 0) & (F.col("t") < s.frames), volume.inside(volume.bounds)]
    said = [f"a channel or frame outside of {s.channels} and {s.frames}", f"a voxel outside of {volume.bounds}"]
    number = _mixed([*GXYZ, "gc", "gt"], counts)
    for ok, why in zip(within, said):
        number = F.when(ok | ~F.col("held"), number).otherwise(F.raise_error(F.lit(why)).cast("bigint"))
    first = dict(zip(XYZ, (F.col(g) * n + o for g, n, o in zip(GXYZ, s.chunk, s.offset)))) | {"c": F.col("gc") * s.channel_chunk, "t": F.col("gt") * s.frame_chunk}
    at = F.when(F.col("held"), _mixed([F.col(n) - first[n] for n in ORDER], sizes)).otherwise(-1)
    order = [F.col("number") * (math.prod(sizes) + 1) + F.col("at")] if math.prod(counts) * (math.prod(sizes) + 1) < 1 << 62 else ["number", "at"]
    rows = rows.select(number.alias("number"), at.alias("at"), "value").repartition("number").sortWithinPartitions(*order)
    if spec is None:
        return cut(rows.mapInArrow(write, "path string, n_bytes bigint"), "written")
    return write_shards(rows.mapInArrow(coded, "label bigint, payload binary"), s.root, spec, packed=True)


def _mixed(digits: Sequence, counts: Sequence[int]) -> Column:
    """One number of digits that are below the counts, the first one fastest."""
    out = F.lit(0).cast("bigint")
    for d, n in reversed(list(zip(digits, counts))):
        out = out * n + (F.col(d) if isinstance(d, str) else d)
    return out.cast("bigint")


def _runs(batches: Iterator[pa.RecordBatch], least: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The second and third column for each run of equal numbers in the first, over the
    ends of batches too; with ``least`` the least of the third for each of the second,
    which is sorted."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None
    for batch in batches:
        number, *more = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if least and len(number):
            number, *more = _least(number, *more)
        ends = [*(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)] if len(number) else []
        for a, b in zip([0, *ends], ends):
            if held and number[a] != now:
                yield now, *_joined(held, least)
                held = []
            now = int(number[a])
            held.append(tuple(m[a:b] for m in more))
    if held:
        yield now, *_joined(held, least)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]], least: bool = False) -> tuple[np.ndarray, ...]:
    if len(parts) == 1:
        return parts[0]
    at, values = (np.concatenate(c) for c in zip(*parts))
    return _least(np.zeros(len(at), np.int64), at, values)[1:] if least else (at, values)


def _least(number: np.ndarray, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by number and place, one for each place with its least value; NaN, which
    stands for null, only where there is no other."""
    new = np.append(True, (number[1:] != number[:-1]) | (at[1:] != at[:-1]))
    if new.all():
        return number, at, values
    first = np.flatnonzero(new)
    return number[first], at[first], (np.fmin if values.dtype.kind == "f" else np.minimum).reduceat(values, first)


def _items(done: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"label": pa.array([k for k, _ in done], pa.int64()), "payload": pa.array([p for _, p in done], pa.binary())})


def write_shards(items: DataFrame, root: str, spec: sharding.Spec, packed: bool = False) -> DataFrame:
    """``label, payload`` rows as shard files below a folder; ``path, n_bytes``.

    ``packed`` payloads are encoded as the layout says already, so that less is shuffled.
    """
    root = local(root).rstrip("/")

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["filename"], pdf["content"]):
                write_object(f"{root}/{name}", bytes(content))
            yield pd.DataFrame({"path": [f"{root}/{n}" for n in pdf["filename"]], "n_bytes": [len(c) for c in pdf["content"]]})

    return cut(sharding.shard_files(items, spec, packed=packed).mapInPandas(store, "path string, n_bytes bigint"), "written")


def _new_scale(volume: Volume, path: str, layer_format: str, dtype: str, resolution: Sequence[float], compress: str, encoding: str, spec: sharding.Spec | None, channels: int, frames: int, channel_chunk: int, frame_chunk: int, level: int) -> Scale:
    """Writes the documents of a level and opens it."""
    size = tuple(b - a for a, b in zip(*volume.bounds))
    base = dict(dtype=dtype, size=size, chunk=volume.chunk, offset=volume.bounds[0], resolution=tuple(resolution), fill=volume.background, channels=channels, frames=frames, channel_chunk=channel_chunk, frame_chunk=frame_chunk)
    if layer_format == "precomputed":
        if frames > 1:
            raise codecs.Unsupported(f"writing {frames} frames to a precomputed layer")
        info = create_info(size, resolution, volume.chunk, dtype, volume.bounds[0], encoding=encoding, channels=channels, spec=spec)
        if level:
            old = _json(f"{path}/info")
            info = old | {"scales": [*old["scales"][:level], info["scales"][0], *old["scales"][level + 1 :]]}
        write_object(f"{path}/info", json.dumps(info).encode())
        return replace(_open_precomputed(path)[level], fill=volume.background)
    if layer_format == "zarr3":
        axes = ("t", "c", "z", "y", "x")[frames == 1 :]
        steps = [{"name": "transpose", "configuration": {"order": list(range(len(axes)))[::-1]}}, {"name": "bytes", "configuration": {"endian": "little"}}]
        steps += [{"name": compress, "configuration": {"level": 5}}] if compress else []
        s = Scale("zarr3", f"{path}/{level}", axes=axes, codecs=[*steps, {"name": "crc32c"}], prefix="c", order="C", **base)
        write_zarr3_metadata(path, s)
    elif layer_format == "zarr2":
        s = Scale("zarr2", f"{path}/{level}", axes=("t", "c", "z", "y", "x"), codecs=[np.dtype(dtype).newbyteorder("<").str, compress], separator=".", order="C", **base)
        write_zarr2_metadata(path, s)
    else:
        raise codecs.Unsupported(f"writing {layer_format}")
    return s


# --- undecoded chunks -------------------------------------------------------------------


def chunk_objects(spark: SparkSession, path: str, mip: int = 0, box: Corners | None = None) -> DataFrame:
    """``gx, gy, gz, gc, gt, path`` of all chunks that a box touches, stored or not.

    ``path`` is that of the object without the suffix of its compression, or of the shard.
    """
    s = open_layer(path)[mip]
    plan = ChunkPlan(s, *(box or (None, None)))

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spec = _spec(s.spec) if s.spec else None
        for pdf in batches:
            rows = []
            for unit in pdf["id"].tolist():
                for g, c, t in plan.chunks(unit):
                    rows.append((*g, c, t, f"{s.root}/{spec.locate(morton(g, s.grid()))[1]}.shard" if spec else chunk_path(s, g, c, t)))
            yield pd.DataFrame(rows, columns=[*GXYZ, "gc", "gt", "path"])

    return spark.range(0, plan.units, 1, len(plan.partitions())).mapInPandas(name, "gx bigint, gy bigint, gz bigint, gc bigint, gt bigint, path string")


def chunk_exists(spark: SparkSession, path: str, mip: int = 0, box: Corners | None = None) -> DataFrame:
    """``gx, gy, gz, gc, gt, is_stored, n_bytes`` (as stored); shards are looked up in their indices."""
    s = open_layer(path)[mip]
    plan = ChunkPlan(s, *(box or (None, None)))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: dict[int, ShardFile] = {}
        there = Present()
        for pdf in batches:
            rows = []
            for unit in pdf["id"].tolist():
                wanted = list(plan.chunks(unit))
                if s.spec:
                    spec = _spec(s.spec)
                    codes = np.array([morton(g, s.grid()) for g, _, _ in wanted], dtype=np.uint64)
                    _, shards = spec.place(codes)
                    sizes = np.full(len(codes), -1, np.int64)
                    for number in np.unique(shards).tolist():
                        sizes[shards == number] = open_shard(s, spec, number, files).find(codes[shards == number])[1]
                else:
                    sizes = [next((os.path.getsize(p) for p in there.paths(chunk_path(s, *k))), -1) for k in wanted]
                rows += [(*g, c, t, int(n) >= 0, None if n < 0 else int(n)) for (g, c, t), n in zip(wanted, sizes)]
            out = pd.DataFrame(rows, columns=[*GXYZ, "gc", "gt", "is_stored", "n_bytes"])
            yield out.astype({"n_bytes": "Int64"})
        for shard in files.values():
            shard.close()

    return spark.range(0, plan.units, 1, len(plan.partitions())).mapInPandas(look, "gx bigint, gy bigint, gz bigint, gc bigint, gt bigint, is_stored boolean, n_bytes bigint")


def download_chunks(spark: SparkSession, path: str, mip: int = 0, box: Corners | None = None) -> DataFrame:
    """``gx, gy, gz, gc, gt, payload``: the stored chunks of a box as they were encoded,
    without the compression of their files."""
    s = open_layer(path)[mip]
    plan = ChunkPlan(s, *(box or (None, None)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for unit in plan.shared(pdf["id"].tolist()):
                rows = [(*g, c, t, data) for (g, c, t), data in stored_chunks(s, unit) if data is not None]
                if rows:
                    yield pd.DataFrame(rows, columns=[*GXYZ, "gc", "gt", "payload"])

    return spark.range(0, plan.units, 1, len(plan.partitions())).mapInPandas(read, "gx bigint, gy bigint, gz bigint, gc bigint, gt bigint, payload binary")


def delete_chunks(spark: SparkSession, path: str, mip: int = 0, box: Corners | None = None) -> DataFrame:
    """Deletes the objects of all chunks that a box touches; ``path`` of each that was there."""
    if open_layer(path)[mip].spec:
        raise codecs.Unsupported("deleting single chunks of shard files")
    return cut(_delete(chunk_objects(spark, path, mip, box)), "deleted")


def _delete(objects: DataFrame) -> DataFrame:
    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = Present()
        for pdf in batches:
            gone = []
            for path in pdf["path"]:
                for p in there.paths(path):
                    try:
                        os.remove(p)
                        gone.append(p)
                    except FileNotFoundError:  # by another attempt of this task
                        pass
            yield pd.DataFrame({"path": gone}, dtype=object)

    return objects.select("path").mapInPandas(remove, "path string")


def read_layer(spark: SparkSession, path: str, mip: int = 0, skip_background: bool = False, layer_format: str | None = None) -> DataFrame:
    register(spark)
    r = spark.read.format("chunked_volume").option("mip", str(mip)).option("skip_background", str(skip_background).lower())
    return (r.option("layer_format", layer_format) if layer_format else r).load(local(path))


def route(s: Scale, chunk: Sequence[int], layer_format: str, encoding: str, spec: sharding.Spec | None) -> str:
    """How chunks travel: 'shards' (files as they are), 'objects', 'pack' (into shards),
    'unpack', or 'voxels' where they have to be decoded."""
    if s.layer_format != "precomputed" or layer_format != "precomputed" or tuple(chunk) != tuple(s.chunk) or encoding != s.encoding:
        return "voxels"
    if s.spec and spec and _spec(s.spec) == spec:
        return "shards"
    return "pack" if spec else "unpack" if s.spec else "objects"


def transfer(spark: SparkSession, source: str, target: str, chunk: Sequence[int] | None = None, mip: int = 0, layer_format: str = "precomputed", encoding: str | None = None, spec: sharding.Spec | None = None, compress: str = "gzip", **how) -> DataFrame:
    """A level in another format, chunk size, encoding or sharding; ``path, n_bytes``.

    All channels and frames are carried over, and the fill value of the source.  Between
    precomputed layers of equal chunks and encoding the stored bytes are carried over
    undecoded, whole shard files where the layouts are equal too.
    """
    s = open_layer(source)[mip]
    target, chunk = local(target).rstrip("/"), tuple(chunk or s.chunk)
    encoding = encoding or (s.encoding if s.layer_format == "precomputed" else "raw")
    way = route(s, chunk, layer_format, encoding, spec)
    bounds = (s.offset, tuple(o + n for o, n in zip(s.offset, s.size)))
    if way == "voxels":
        rows = read_layer(spark, source, mip, skip_background=True).select(*XYZ, "c", "t", F.col("value").alias("label"))
        how = {"channel_chunk": s.channel_chunk, "frame_chunk": s.frame_chunk} | how if layer_format != "precomputed" else how
        return write_layer(Volume(rows, bounds, chunk, s.fill), target, layer_format, s.dtype, s.resolution, compress, encoding, spec, s.channels, s.frames, **how)
    new = _new_scale(Volume(spark.range(0), bounds, chunk, s.fill), target, "precomputed", s.dtype, s.resolution, compress, encoding, spec, s.channels, 1, s.channels, 1, how.get("level", 0))
    if way == "shards":
        names = spark.range(0, 1 << spec.shard_bits, 1, min(1 << spec.shard_bits, MAX_PARTITIONS))

        def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                done = []
                for n in pdf["id"]:
                    name = f"{spec.shard_name(n)}.shard"
                    if os.path.exists(f"{s.root}/{name}"):
                        done.append((f"{new.root}/{name}", copy_object(f"{s.root}/{name}", f"{new.root}/{name}")))
                yield pd.DataFrame(done, columns=["path", "n_bytes"])

        return cut(names.mapInPandas(copy, "path string, n_bytes bigint"), "written")
    plan = ChunkPlan(s)
    units = spark.range(0, plan.units, 1, len(plan.partitions()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[int, ShardFile] = {}
        for batch in batches:
            done, size = [], 0
            for unit in plan.shared(batch.column(0).to_pylist()):
                for (g, _, _), data in stored_chunks(s, unit, spec.data_encoding, files):
                    if data is not None:
                        done.append((morton(g, s.grid()), data))
                        size += len(data)
                        if size >= BYTES_OUT:
                            yield _items(done)
                            done, size = [], 0
            yield _items(done)

    if way == "pack":
        return write_shards(units.mapInArrow(pack, "label bigint, payload binary"), new.root, spec, packed=True)
    suffix = codecs.suffix_of(compress)

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: dict[int, ShardFile] = {}
        for pdf in batches:
            done = []
            for unit in plan.shared(pdf["id"].tolist()):
                for (g, _, _), data in stored_chunks(s, unit, compress if suffix else "", files):
                    if data is not None:
                        at = chunk_path(new, g) + suffix
                        write_object(at, data, target)
                        done.append((at, len(data)))
            yield pd.DataFrame(done, columns=["path", "n_bytes"])
        leave(target)

    return cut(units.mapInPandas(store, "path string, n_bytes bigint"), "written")
