"""Shard files: where keys go, how files are laid out, and sizing of the layout.

A shard file is ``[fixed index][data][minishard indices]``.  The fixed index has a
(start, end) pair of uint64 per minishard, relative to its own end; a minishard index
is a 3 by n uint64 table of label differences, gaps between entries and sizes.
"""

from __future__ import annotations

import gzip
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.functions import grid
from chunkloom.functions.murmur import murmur, murmur_low64

ENTRY_BYTES, SLOT_BYTES = 24, 16  # of a minishard index entry, of a fixed index slot


@dataclass(frozen=True)
class Spec:
    """How keys map to shards and minishards."""

    preshift_bits: int
    minishard_bits: int
    shard_bits: int
    hash: str = "identity"
    minishard_index_encoding: str = "gzip"
    data_encoding: str = "gzip"

    def __post_init__(self) -> None:
        for name in ("preshift_bits", "minishard_bits", "shard_bits"):
            if not 0 <= getattr(self, name) <= 64:
                raise ValueError(f"{name} is out of range")
        if self.minishard_bits + self.shard_bits > 64:
            raise ValueError("more than 64 bits")
        if self.hash not in ("identity", "murmurhash3_x86_128"):
            raise ValueError(self.hash)
        if {self.minishard_index_encoding, self.data_encoding} - {"raw", "gzip"}:
            raise ValueError("encodings are raw or gzip")

    def to_dict(self) -> dict:
        return {"@type": "neuroglancer_uint64_sharded_v1", **asdict(self)}

    def hashed(self, key: Column) -> Column:
        shifted = F.shiftrightunsigned(key, self.preshift_bits) if self.preshift_bits < 64 else F.lit(0).cast("bigint")
        return murmur(shifted) if self.hash != "identity" else shifted

    def location(self, key: Column) -> tuple[Column, Column]:
        """(minishard, shard in hex) of bigint keys."""
        return grid.shard_location(self.hashed(key), F.lit(self.minishard_bits), F.lit(self.shard_bits))

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(minishards, shards) of uint64 keys."""
        h = keys.astype(np.uint64) >> np.uint64(self.preshift_bits) if self.preshift_bits < 64 else np.zeros(len(keys), np.uint64)
        if self.hash != "identity":
            h = murmur_low64(h)
        low = np.uint64((1 << self.minishard_bits) - 1)
        high = (h >> np.uint64(self.minishard_bits)) if self.minishard_bits < 64 else np.zeros(len(keys), np.uint64)
        return h & low, high & np.uint64((1 << self.shard_bits) - 1)

    def shard_name(self, shard: int) -> str:
        return format(int(shard), "x").zfill(-(-self.shard_bits // 4))

    def locate(self, key: int) -> tuple[int, str]:
        """The same for one key on the driver."""
        h = key >> self.preshift_bits
        if self.hash != "identity":
            h = int(murmur_low64(np.array([h], dtype=np.uint64))[0])
        minishard = h & ((1 << self.minishard_bits) - 1)
        shard = (h >> self.minishard_bits) & ((1 << self.shard_bits) - 1)
        return minishard, self.shard_name(shard)


def assemble_meshes(spec: Spec, groups: dict[int, dict[int, tuple[bytes, bytes]]]) -> bytes:
    """A shard file of multi-resolution meshes from ``{minishard: {label: (data, manifest)}}``.

    The index names manifests only; a mesh's data lie right before its manifest, in the gap
    that the index leaves.  Manifests are packed as the layout says, data never.
    """
    data, tables = bytearray(), {}
    for m in sorted(groups):
        labels = sorted(groups[m])
        if not labels:
            continue
        table = np.zeros((3, len(labels)), dtype="<u8")
        table[0] = np.diff(np.array(labels, dtype=np.uint64), prepend=np.uint64(0))
        table[1, 0] = len(data)
        for k, x in enumerate(labels):
            body, manifest = groups[m][x][0], _pack(groups[m][x][1], spec.data_encoding)
            table[1, k] += len(body)
            table[2, k] = len(manifest)
            data += body + manifest
        tables[m] = _pack(table.tobytes(), spec.minishard_index_encoding)
    return _with_index(spec, bytes(data), tables)


def disassemble_meshes(spec: Spec, shard: bytes, data_bytes) -> dict[int, tuple[bytes, bytes]]:
    """``{label: (data, manifest)}``; ``data_bytes`` tells from a manifest how long its data are."""
    out = {}
    for _, x, o, s in entries(spec, shard):
        manifest = _unpack(shard[o : o + s], spec.data_encoding)
        out[x] = (shard[o - data_bytes(manifest) : o], manifest)
    return out


def insert_mesh(spec: Spec, shard: bytes, label: int, data: bytes, manifest: bytes, data_bytes) -> bytes:
    """The shard with one mesh added or replaced."""
    groups: dict[int, dict[int, tuple[bytes, bytes]]] = {}
    for x, pair in (disassemble_meshes(spec, shard, data_bytes) | {label: (data, manifest)}).items():
        groups.setdefault(spec.locate(x)[0], {})[x] = pair
    return assemble_meshes(spec, groups)


def _with_index(spec: Spec, data: bytes, tables: dict[int, bytes]) -> bytes:
    """The file around its data: fixed index in front, minishard indices behind."""
    fixed, tail, at = np.zeros((1 << spec.minishard_bits, 2), dtype="<u8"), bytearray(), len(data)
    for m, t in tables.items():
        fixed[m] = at, at + len(t)
        at += len(t)
        tail += t
    return fixed.tobytes() + data + bytes(tail)


def _pack(data: bytes, encoding: str) -> bytes:
    return gzip.compress(data, mtime=0) if encoding == "gzip" else data


def _unpack(data: bytes, encoding: str) -> bytes:
    return gzip.decompress(data) if encoding == "gzip" and data else data


def assemble(spec: Spec, groups: dict[int, dict[int, bytes]], packed: bool = False) -> bytes:
    """One shard file from ``{minishard: {label: payload}}``; ``packed`` payloads are encoded as the layout says."""
    data, tables = bytearray(), {}
    for m in sorted(groups):
        labels = sorted(groups[m])
        if not labels:
            continue
        data_of = [groups[m][x] if packed else _pack(groups[m][x], spec.data_encoding) for x in labels]
        table = np.zeros((3, len(labels)), dtype="<u8")
        table[0] = np.diff(np.array(labels, dtype=np.uint64), prepend=np.uint64(0))
        table[1, 0] = len(data)  # what the minishards before hold
        table[2] = [len(p) for p in data_of]
        data += b"".join(data_of)
        tables[m] = _pack(table.tobytes(), spec.minishard_index_encoding)
    return _with_index(spec, bytes(data), tables)


def entries(spec: Spec, shard: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(minishard, label, offset in the file, size) of a shard file."""
    head = SLOT_BYTES << spec.minishard_bits
    fixed = np.frombuffer(shard[:head], dtype="<u8").reshape(-1, 2)
    for m, (a, b) in enumerate(fixed.tolist()):
        if a == b:
            continue
        table = np.frombuffer(_unpack(shard[head + a : head + b], spec.minishard_index_encoding), dtype="<u8").reshape(3, -1)
        labels = np.cumsum(table[0], dtype=np.uint64)
        ends = np.cumsum(table[1] + table[2], dtype=np.uint64)
        for x, e, s in zip(labels.tolist(), ends.tolist(), table[2].tolist()):
            yield m, x, head + e - s, s


def disassemble(spec: Spec, shard: bytes) -> dict[int, bytes]:
    return {x: _unpack(shard[o : o + s], spec.data_encoding) for _, x, o, s in entries(spec, shard)}


def shard_files(items: DataFrame, spec: Spec, label: str = "label", payload: str = "payload", packed: bool = False) -> DataFrame:
    """``shard, filename, content, n_labels``: one file per shard, in parallel.

    ``packed`` payloads are encoded as the layout says already.  The number of labels per shard is bounded by the layout the spec was sized for.
    """
    minishard, shard = spec.location(F.col(label))
    rows = items.select(F.col(label).alias("label"), F.col(payload).alias("payload"), minishard.alias("minishard"), shard.alias("shard"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: dict[int, dict[int, bytes]] = {}
        for m, x, p in zip(pdf["minishard"], pdf["label"], pdf["payload"]):
            groups.setdefault(int(m), {})[int(x) & (2**64 - 1)] = bytes(p)
        s = pdf["shard"].iloc[0]
        return pd.DataFrame({"shard": [s], "filename": [f"{s}.shard"], "content": [assemble(spec, groups, packed)], "n_labels": [len(pdf)]})

    return rows.groupBy("shard").applyInPandas(build, "shard string, filename string, content binary, n_labels bigint")


def shard_entries(files: DataFrame, spec: Spec, payloads: bool = True) -> DataFrame:
    """``filename, minishard, label, offset, size[, payload]`` of shard files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["filename"], pdf["content"]):
                content = bytes(content)
                for m, x, o, s in entries(spec, content):
                    signed = x - 2**64 if x >= 2**63 else x
                    rows.append((name, m, signed, o, s, _unpack(content[o : o + s], spec.data_encoding) if payloads else None))
            yield pd.DataFrame(rows, columns=["filename", "minishard", "label", "offset", "size", "payload"])

    out = files.select("filename", "content").mapInPandas(read, "filename string, minishard bigint, label bigint, offset bigint, size bigint, payload binary")
    return out if payloads else out.drop("payload")


def delta_encoded(rows: DataFrame, group: Sequence[str], label: str = "label") -> DataFrame:
    """Adds ``label_delta``: the difference to the label before, within a minishard."""
    w = Window.partitionBy(*group).orderBy(label)
    return rows.withColumn("label_delta", F.col(label) - F.coalesce(F.lag(label).over(w), F.lit(0)))


def delta_decoded(rows: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Adds ``label`` and ``offset`` from deltas, gaps and sizes."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("label", F.sum("label_delta").over(w)).withColumn("offset", F.sum(F.col("gap") + F.col("size")).over(w) - F.col("size"))


def coalesced_ranges(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Adjacent byte ranges (``start``, ``end``) of a file as one request each."""
    w = Window.partitionBy(*group).orderBy("start", "end")
    marked = rows.withColumn("_new", F.when(F.col("start") == F.lag("end").over(w), 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*group, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_ranges")).drop("_run")


def _bits(n: float) -> int:
    """Bits that number ``n`` things, none for a single one."""
    return max(0, math.ceil(math.log2(n))) if n > 0 else 0


#: A shard bit is saved where that leaves the shards at most this full.
FULLEST = 1.1


def params_for_hashed(labels: int, shard_index_bytes: int = 2**13, minishard_index_bytes: int = 2**15, min_shards: int = 1) -> tuple[int, int, int]:
    """(shard bits, minishard bits, preshift bits) for evenly hashed labels.

    ``need`` full minishards hold all labels.  A shard has as many minishards as its
    index has slots; as many shards are made as ``need`` asks for, ``min_shards`` at
    least, and every shard bit beyond what is needed is taken from the minishards.
    """
    if min_shards < 1:
        raise ValueError("one shard at least")
    if labels <= 0:
        return 0, 0, 0
    slots, need = shard_index_bytes / SLOT_BYTES, labels * ENTRY_BYTES / minishard_index_bytes
    wanted = _bits(need / slots / FULLEST)
    shard = max(wanted, round(math.log2(min_shards)))
    return shard, max(0, min(_bits(slots), _bits(need)) - (shard - wanted)), 0


def params_for_image(size: Sequence[int], chunk: Sequence[int], encoding: str, byte_width: int, shard_bytes: int = int(3.5e9), max_shard_index: int = 8192, max_minishard_index: int = 40000, max_per_minishard: int = 4000) -> Spec:
    """Layout of an image: the largest shards that keep every limit.

    A shard of ``k`` index bits holds 2^k neighbouring chunks, no more than
    ``shard_bytes`` of raw voxels (one chunk at least).  Its minishards hold as many
    chunks as ``max_per_minishard`` and their index allow, and the shard's own index
    has to list all of its minishards.  Codes have the bits of the grid's axes in all.
    """
    code = sum(_bits(-(-s // c)) for s, c in zip(size, chunk))
    if code > 64:
        raise ValueError("more chunks than 64-bit codes")
    most = math.floor(math.log2(max(1, shard_bytes // (math.prod(chunk) * byte_width))))
    low = math.floor(math.log2(max(1, min(max_per_minishard, max_minishard_index // ENTRY_BYTES))))
    slots = math.floor(math.log2(max(1, max_shard_index // SLOT_BYTES)))
    index = min(code, most, low + slots)
    pre = min(index, low)
    lossy = encoding in ("jpeg", "png", "kempressed", "fpzip", "zfpc")
    return Spec(pre, index - pre, code - index, data_encoding="raw" if lossy else "gzip")


def image_shard_shape(spec: Spec, size: Sequence[int], chunk: Sequence[int]) -> tuple[int, ...]:
    """Voxels per axis that one shard covers: its index bits dealt round to the axes."""
    cells = [-(-s // c) for s, c in zip(size, chunk)]
    need = [math.ceil(math.log2(n)) for n in cells]
    bits, left = [0, 0, 0], spec.preshift_bits + spec.minishard_bits
    while left and any(b < n for b, n in zip(bits, need)):
        for d in range(3):
            if left and bits[d] < need[d]:
                bits[d] += 1
                left -= 1
    return tuple(c << b for c, b in zip(chunk, bits))
