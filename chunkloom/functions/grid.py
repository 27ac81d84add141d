"""Chunk grids: names of boxes, grid positions, compressed Morton codes, shard numbers.

Everything is a Catalyst expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A chunk object is named by its box, perhaps with one of three suffixes.
CHUNK_NAME = r"^(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)(\.gz|\.br|\.zstd)?$"

def box_of_name(name: Column) -> list[Column]:
    """x0, x1, y0, y1, z0, z1 of a chunk name; null where it is no such name."""
    return [F.regexp_extract(name, CHUNK_NAME, i).try_cast("bigint") for i in range(1, 7)]


def chunk_name(box: list[Column]) -> Column:
    """Name of the box x0, x1, y0, y1, z0, z1."""
    return F.concat_ws("_", *[F.concat_ws("-", box[2 * d].cast("string"), box[2 * d + 1].cast("string")) for d in range(3)])


def floor_div(a: Column, b: Column) -> Column:
    """Integer quotient that rounds down, also below zero."""
    return F.call_function("div", a - F.pmod(a, b), b)


def ceil_div(a: Column, b: Column) -> Column:
    return -floor_div(-a, b)


def axis_bits(size: Column) -> Column:
    """How many bits number the cells of an axis of ``size`` cells."""
    return F.when(size > 1, F.length(F.bin((size - 1).cast("bigint")))).otherwise(0)


def bit_places(grid: list[Column]) -> list[Column]:
    """For every axis, where each of its bits goes in the compressed Morton code.

    Bit i of an axis exists only while 2^i < the axis's size.  Its place is the number
    of bits that exist before it: those of lower order on all axes, and those of the
    same order on the axes before it.  This depends on the grid alone, so it is worked
    out once per grid and not once per chunk.
    """
    have = [axis_bits(g) for g in grid]

    def of_axis(d: int) -> Column:
        def place(i: Column) -> Column:
            p = sum((F.least(i, have[k]) for k in range(3)), F.lit(0))
            return sum((F.when(i < have[k], 1).otherwise(0) for k in range(d)), p).cast("int")

        return F.when(have[d] > 0, F.transform(F.sequence(F.lit(0), have[d] - 1), place)).otherwise(F.array().cast("array<int>"))

    return [of_axis(d) for d in range(3)]


def _shift(name: str, v: Column, by: Column) -> Column:
    return F.call_function(name, v, by.cast("int"))


_or = lambda a, b: a.bitwiseOR(b)


def morton_code(point: list[Column], places: list[Column]) -> Column:
    """Compressed Morton code of a grid position, given the grid's ``bit_places``."""
    code = F.lit(0).cast("bigint")
    for p, at in zip(point, places):
        code = code.bitwiseOR(F.aggregate(F.transform(at, _spread(p.cast("bigint"))), F.lit(0).cast("bigint"), _or))
    return code


def _spread(v: Column):
    """Maps (place q, bit i) to bit i of ``v`` moved to place q."""
    return lambda q, i: _shift("shiftleft", _shift("shiftright", v, i).bitwiseAND(F.lit(1).cast("bigint")), q)


def morton_point(code: Column, places: list[Column]) -> list[Column]:
    """Grid position of a compressed Morton code, given the grid's ``bit_places``."""
    out = []
    for at in places:
        bits = F.transform(at, lambda q, i: _shift("shiftleft", _shift("shiftright", code, q).bitwiseAND(F.lit(1).cast("bigint")), i))
        out.append(F.aggregate(bits, F.lit(0).cast("bigint"), _or))
    return out


def low_bits(v: Column, bits: Column) -> Column:
    """The ``bits`` lowest bits; all of them from 64 on."""
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int")) - F.lit(1).cast("bigint")
    return F.when(bits >= 64, v).when(bits == 63, v.bitwiseAND(F.lit(2**63 - 1).cast("bigint"))).otherwise(v.bitwiseAND(mask))


def drop_bits(v: Column, bits: Column) -> Column:
    return F.when(bits >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", v, bits.cast("int")))


def hex_padded(v: Column, bits: Column) -> Column:
    """Lower-case hex, padded to the digits that ``bits`` bits need."""
    text = F.lower(F.hex(v))
    width = F.ceil(bits / F.lit(4)).cast("int")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def shard_location(hashed: Column, minishard_bits: Column, shard_bits: Column) -> tuple[Column, Column]:
    """(minishard number, shard number in hex) of a hashed, pre-shifted key."""
    minishard = low_bits(hashed, minishard_bits)
    shard = low_bits(drop_bits(hashed, minishard_bits), shard_bits)
    return minishard, hex_padded(shard, shard_bits)
