"""Unsigned 64-bit labels, packed graph labels, and small text conversions."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO64 = Decimal(18446744073709551616)


def unsigned(v: Column) -> Column:
    """The unsigned value that a bigint's bits spell, as decimal(20,0)."""
    d = v.cast("decimal(20,0)")
    return F.when(v < 0, (d + F.lit(TWO64).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(d)


def signed(v: Column) -> Column:
    """The bigint whose bits spell an unsigned decimal(20,0)."""
    big = v >= F.lit(TWO64 / 2).cast("decimal(20,0)")
    return F.when(big, v - F.lit(TWO64).cast("decimal(20,0)")).otherwise(v).cast("bigint")


class LabelBits:
    """Labels packed as layer, x, y, z and segment; the bits per axis depend on the layer."""

    def __init__(self, layer_bits: int, axis_bits: Mapping[int, int]) -> None:
        self.layer_bits, self.axis_bits = layer_bits, dict(axis_bits)

    def layer(self, label: Column) -> Column:
        return F.shiftrightunsigned(label, 64 - self.layer_bits)

    def bits(self, layer: Column) -> Column:
        out = F.lit(None).cast("int")
        for k, b in sorted(self.axis_bits.items()):
            out = F.when(layer == k, b).otherwise(out)
        return out

    def decode(self, label: Column) -> list[Column]:
        """layer, x, y, z, segment."""
        layer = self.layer(label)
        b = self.bits(layer)
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), b) - F.lit(1).cast("bigint")
        free = F.lit(64 - self.layer_bits)
        pos = [F.call_function("shiftrightunsigned", label, (free - b * (i + 1)).cast("int")).bitwiseAND(mask) for i in range(3)]
        rest = free - b * 3
        segment = label.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), rest.cast("int")) - F.lit(1).cast("bigint"))
        return [layer, *pos, segment]

    def chunk_id(self, label: Column) -> Column:
        """The label without its segment bits."""
        return label - self.decode(label)[4]

    def encode(self, layer: Column, point: list[Column], segment: Column) -> Column:
        """The packed label; null where a part does not fit its bits."""
        b = self.bits(layer)
        free = F.lit(64 - self.layer_bits)
        out = F.shiftleft(layer.cast("bigint"), 64 - self.layer_bits).bitwiseOR(segment.cast("bigint"))
        one = F.lit(1).cast("bigint")
        ok = (segment >= 0) & (segment < F.call_function("shiftleft", one, (free - b * 3).cast("int"))) & (layer >= 0) & (layer < 2**self.layer_bits)
        for i, p in enumerate(point):
            out = out.bitwiseOR(F.call_function("shiftleft", p.cast("bigint"), (free - b * (i + 1)).cast("int")))
            ok = ok & (p >= 0) & (p < F.call_function("shiftleft", one, b))
        return F.when(ok, out)


def unix_seconds(ts: Column) -> Column:
    """Seconds since 1970, rounded up."""
    return F.ceil(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)).cast("bigint")


def to_unix_time(when: int | float | str | datetime) -> int:
    """The same for a value of the driver."""
    if isinstance(when, str):
        when = datetime.fromisoformat(when)
    if isinstance(when, datetime):
        when = (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp()
    return int(-(-when // 1))


#: The suffixes of compressed objects.
COMPRESSION = r"\.(gz|br|zstd)$"


def without_compression(name: Column) -> Column:
    return F.regexp_replace(name, COMPRESSION, "")


def segment_of_manifest(name: Column) -> Column:
    """Segment of a manifest name like ``123:0``, perhaps below folders; null of other names."""
    return F.regexp_extract(name, r"(?:^|/)([0-9]+):0$", 1).try_cast("bigint")


def byte_range_of(name: Column) -> list[Column]:
    """layer, file, offset, size of a manifest entry like ``~2/a-b.shard:100:50``."""
    pattern = r"^~([0-9]+)/(.+):([0-9]+):([0-9]+)$"
    part = [F.regexp_extract(name, pattern, i) for i in range(1, 5)]
    return [part[0].try_cast("int"), F.nullif(part[1], F.lit("")), part[2].try_cast("bigint"), part[3].try_cast("bigint")]


def path_parts(path: Column) -> list[Column]:
    """format, protocol, bucket, dataset, layer of ``format://protocol://bucket/.../dataset/layer``."""
    m = r"^(?:([a-z0-9]+)://)?(gs|s3|http|https|file|mem|matrix|tigerdata)://([^/]*)(/.*)?$"
    fmt, protocol, bucket, rest = [F.regexp_extract(path, m, i) for i in range(1, 5)]
    steps = F.filter(F.split(rest, "/"), lambda s: s != "")
    return [F.coalesce(F.nullif(fmt, F.lit("")), F.lit("precomputed")), F.nullif(protocol, F.lit("")), F.nullif(bucket, F.lit("")), F.try_element_at(steps, F.lit(-2)), F.try_element_at(steps, F.lit(-1))]
