"""Shard files read by byte ranges: the fixed index, the minishard indices that are
needed, then the payloads that are wanted, neighbouring ones in one read.

Nothing is listed: names of shard files follow from the keys.  Work is split by shard
and minishard, so a shard that holds most keys is read by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.sharding import ENTRY_BYTES, SLOT_BYTES, Spec, _unpack

#: Tasks that share the minishards of one shard.
SPLIT = 16
#: Entries handed over at a time.
ROWS_OUT = 50_000


class ShardFile:
    """One shard file; ``n_read`` counts the bytes that were read of it."""

    def __init__(self, path: str, spec: Spec) -> None:
        self.path, self.spec, self.n_read = path, spec, 0
        self._fixed: np.ndarray | None = None
        self._indices: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        try:
            self._file = open(path, "rb")  # noqa: SIM115
        except FileNotFoundError:
            self._file = None

    def close(self) -> None:
        if self._file:
            self._file.close()

    def read(self, start: int, size: int) -> bytes:
        self._file.seek(start)
        data = self._file.read(size)
        if len(data) != size:
            raise ValueError(f"{self.path} ends before byte {start + size}")
        self.n_read += size
        return data

    def _ranges(self, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(number, bytes) of the ranges, adjacent and overlapping ones read at once."""
        order = np.argsort(starts, kind="stable")
        at = 0
        while at < len(order):
            lo, end, to = int(starts[order[at]]), int(starts[order[at]] + sizes[order[at]]), at + 1
            while to < len(order) and int(starts[order[to]]) <= end:
                end, to = max(end, int(starts[order[to]] + sizes[order[to]])), to + 1
            data = self.read(lo, end - lo)
            for k in order[at:to].tolist():
                yield k, data[int(starts[k]) - lo : int(starts[k]) - lo + int(sizes[k])]
            at = to

    def fixed(self) -> np.ndarray:
        """(start, end) of every minishard's index, relative to the end of this table."""
        if self._fixed is None:
            self._fixed = np.frombuffer(self.read(0, SLOT_BYTES << self.spec.minishard_bits), "<u8").reshape(-1, 2)
        return self._fixed

    def index(self, minishards: np.ndarray) -> None:
        """Reads the indices of the given minishards, those that are not known yet."""
        head, fixed = SLOT_BYTES << self.spec.minishard_bits, self.fixed()
        new = [int(m) for m in np.unique(minishards) if int(m) not in self._indices]
        none = np.zeros(0, np.uint64)
        full = np.array([m for m in new if fixed[m, 0] < fixed[m, 1]], dtype=np.int64)
        for m in new:
            self._indices[m] = (none, none, none)
        for k, data in self._ranges(fixed[full, 0].astype(np.int64) + head, (fixed[full, 1] - fixed[full, 0]).astype(np.int64)):
            raw = _unpack(data, self.spec.minishard_index_encoding)
            if len(raw) % ENTRY_BYTES:
                raise ValueError(f"{self.path}: index of minishard {full[k]}")
            table = np.frombuffer(raw, "<u8").reshape(3, -1)
            ends = np.cumsum(table[1] + table[2], dtype=np.uint64)
            self._indices[int(full[k])] = (np.cumsum(table[0], dtype=np.uint64), ends - table[2] + np.uint64(head), table[2])

    def find(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, sizes) of uint64 labels; -1 where a label is not in the file."""
        offsets, sizes = np.full(len(labels), -1, np.int64), np.full(len(labels), -1, np.int64)
        if self._file is None or not len(labels):
            return offsets, sizes
        minishards, _ = self.spec.place(labels)
        self.index(minishards)
        for m in np.unique(minishards):
            mine = np.nonzero(minishards == m)[0]
            have, at, size = self._indices[int(m)]
            if len(have):
                k = np.minimum(np.searchsorted(have, labels[mine]), len(have) - 1)
                hit = have[k] == labels[mine]
                offsets[mine[hit]], sizes[mine[hit]] = at[k[hit]].astype(np.int64), size[k[hit]].astype(np.int64)
        return offsets, sizes

    def payloads(self, labels: np.ndarray, packed: bool = False) -> Iterator[tuple[int, bytes]]:
        """(number of the label, payload) of the labels that are there, in file order;
        ``packed`` ones as they are stored."""
        offsets, sizes = self.find(labels)
        there = np.nonzero(sizes >= 0)[0]
        for k, data in self._ranges(offsets[there], sizes[there]):
            yield int(there[k]), data if packed else _unpack(data, self.spec.data_encoding)

    def entries(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(minishard, labels, offsets, sizes) of all entries; payloads are not read."""
        if self._file is None:
            return
        for at in range(0, 1 << self.spec.minishard_bits, 64):
            some = np.arange(at, min(at + 64, 1 << self.spec.minishard_bits))
            self.index(some)
            for m in some.tolist():
                have = self._indices.pop(m)
                if len(have[0]):
                    yield (m, *have)


def by_shard(labels: DataFrame, spec: Spec, col: str) -> DataFrame:
    """``label, shard, minishard`` once each, in file order within a task."""
    minishard, shard = spec.location(F.col("label"))
    rows = labels.select(F.col(col).cast("bigint").alias("label")).dropna().distinct()
    rows = rows.select("label", shard.alias("shard"), minishard.alias("minishard"))
    return rows.repartition("shard", F.pmod("minishard", F.lit(SPLIT))).sortWithinPartitions("shard", "minishard", "label")


def each_shard(batches: Iterator[pd.DataFrame], root: str, spec: Spec) -> Iterator[tuple[pd.DataFrame, ShardFile]]:
    """The rows of each shard in a task's batches; a file stays open over batches."""
    held: ShardFile | None = None
    for pdf in batches:
        for name, part in pdf.groupby("shard", sort=False):
            path = f"{root}/{name}.shard"
            if held is None or held.path != path:
                if held:
                    held.close()
                held = ShardFile(path, spec)
            yield part, held
    if held:
        held.close()


def shard_lookup(labels: DataFrame, path: str, spec: Spec, col: str = "label") -> DataFrame:
    """``label, payload`` of the labels that are stored; nulls and repetitions are left out."""
    root = path.removeprefix("file://").rstrip("/")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, shard in each_shard(batches, root, spec):
            keys = part["label"].to_numpy(np.int64)
            got, size = [], 0
            for k, data in shard.payloads(keys.view(np.uint64)):
                got.append((keys[k], data))
                size += len(data)
                if size > 64 << 20:
                    yield pd.DataFrame(got, columns=["label", "payload"])
                    got, size = [], 0
            if got:
                yield pd.DataFrame(got, columns=["label", "payload"])

    return by_shard(labels, spec, col).mapInPandas(read, "label bigint, payload binary")


def shard_exists(labels: DataFrame, path: str, spec: Spec, col: str = "label") -> DataFrame:
    """``label, is_stored, offset, size`` from the indices alone."""
    root = path.removeprefix("file://").rstrip("/")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, shard in each_shard(batches, root, spec):
            keys = part["label"].to_numpy(np.int64)
            offsets, sizes = shard.find(keys.view(np.uint64))
            void = sizes < 0
            yield pd.DataFrame({"label": keys, "is_stored": ~void, "offset": pd.arrays.IntegerArray(offsets, void), "size": pd.arrays.IntegerArray(sizes, void.copy())})

    return by_shard(labels, spec, col).mapInPandas(look, "label bigint, is_stored boolean, offset bigint, size bigint")


def list_labels(spark: SparkSession, path: str, spec: Spec) -> DataFrame:
    """``filename, minishard, label, offset, size`` of everything stored, from the indices alone.

    The names of all shards follow from the layout, so no directory is listed.
    """
    root = path.removeprefix("file://").rstrip("/")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n in pdf["id"]:
                name = f"{spec.shard_name(n)}.shard"
                shard = ShardFile(f"{root}/{name}", spec)
                for m, labels, offsets, sizes in shard.entries():
                    for i in range(0, len(labels), ROWS_OUT):
                        part = slice(i, i + ROWS_OUT)
                        yield pd.DataFrame({"filename": name, "minishard": m, "label": labels[part].view(np.int64), "offset": offsets[part].astype(np.int64), "size": sizes[part].astype(np.int64)})
                shard.close()

    shards = 1 << spec.shard_bits
    return spark.range(0, shards, 1, max(1, min(shards, 20_000))).mapInPandas(read, "filename string, minishard bigint, label bigint, offset bigint, size bigint")
