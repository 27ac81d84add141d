"""Axis-aligned boxes: column algebra, and driver-side constructors.

A ``Box`` holds one column per corner coordinate, so that predicates stay plain
comparisons Catalyst can push down.  Boxes are half open; corners are in order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkloom.functions import grid

AXES = "xyz"


def _both(a: Column, b: Column) -> Column:
    return a & b


def _all(xs) -> Column:
    return reduce(_both, xs)


def _any(xs) -> Column:
    return reduce(lambda a, b: a | b, xs)


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _long(v) -> Column:
    return _col(v).cast("bigint")


@dataclass
class Box:
    lo: list[Column]
    hi: list[Column]

    @classmethod
    def of(cls, lo: Sequence, hi: Sequence) -> Box:
        return cls([_col(v) for v in lo], [_col(v) for v in hi])

    @classmethod
    def sorted(cls, a: Sequence, b: Sequence) -> Box:
        """From two opposite corners in either order."""
        a, b = [_col(v) for v in a], [_col(v) for v in b]
        return cls([F.least(p, q) for p, q in zip(a, b)], [F.greatest(p, q) for p, q in zip(a, b)])

    @classmethod
    def named(cls, name: Column) -> Box:
        """From a file name like ``0-64_0-64_0-16.gz``; nulls where it is none."""
        b = grid.box_of_name(name)
        return cls(b[0::2], b[1::2])

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{d}{e}") for d, a, b in zip(AXES, self.lo, self.hi) for c, e in ((a, 0), (b, 1))]

    def name(self) -> Column:
        return grid.chunk_name([c for p in zip(self.lo, self.hi) for c in p])

    def name_with_precision(self, digits: int) -> Column:
        part = [F.concat(F.format_string(f"%.{digits}f", a.cast("double")), F.lit("-"), F.format_string(f"%.{digits}f", b.cast("double"))) for a, b in zip(self.lo, self.hi)]
        return F.concat_ws("_", *part)

    def _pairs(self, other: Box):
        return zip(self.lo, self.hi, other.lo, other.hi)

    def intersects(self, o: Box) -> Column:
        """Strict: boxes that only touch do not intersect."""
        return _all((a0 < b1) & (a1 > b0) for a0, a1, b0, b1 in self._pairs(o))

    def overlaps(self, o: Box) -> Column:
        """Touching counts."""
        return _all((a1 >= b0) & (a0 <= b1) for a0, a1, b0, b1 in self._pairs(o))

    def contains_point(self, p: Sequence) -> Column:
        return _all(_col(v).between(a, b) for v, a, b in zip(p, self.lo, self.hi))

    def contains_box(self, o: Box) -> Column:
        return _all((b0 >= a0) & (b1 <= a1) for a0, a1, b0, b1 in self._pairs(o))

    def intersection(self, o: Box) -> Box:
        """Common part; the zero box at the origin where there is none."""
        hit = self.intersects(o)
        zero = F.lit(0)
        return Box([F.when(hit, F.greatest(a, b)).otherwise(zero) for a, b in zip(self.lo, o.lo)], [F.when(hit, F.least(a, b)).otherwise(zero) for a, b in zip(self.hi, o.hi)])

    def hull(self, o: Box) -> Box:
        return Box([F.least(a, b) for a, b in zip(self.lo, o.lo)], [F.greatest(a, b) for a, b in zip(self.hi, o.hi)])

    def clamped(self, o: Box) -> Box:
        to = lambda v, a, b: F.least(F.greatest(v, a), b)
        return Box([to(v, a, b) for v, a, b in zip(self.lo, o.lo, o.hi)], [to(v, a, b) for v, a, b in zip(self.hi, o.lo, o.hi)])

    def near_edge(self, o: Box, distance: float = 0) -> Column:
        return _any((F.abs(a0 - b0) <= distance) | (F.abs(a1 - b1) <= distance) for a0, a1, b0, b1 in self._pairs(o))

    def expanded_to(self, chunk: Sequence, offset: Sequence = (0, 0, 0)) -> Box:
        """Outward to the chunk grid, in exact integers."""
        return Box([grid.floor_div(a - _long(o), _long(c)) * _long(c) + _long(o) for a, c, o in zip(self.lo, chunk, offset)], [grid.ceil_div(b - _long(o), _long(c)) * _long(c) + _long(o) for b, c, o in zip(self.hi, chunk, offset)])

    def shrunk_to(self, chunk: Sequence, offset: Sequence = (0, 0, 0)) -> Box:
        """Inward to the chunk grid; where an axis inverts, an empty box at the low corner."""
        lo = [grid.ceil_div(a - _long(o), _long(c)) * _long(c) + _long(o) for a, c, o in zip(self.lo, chunk, offset)]
        hi = [grid.floor_div(b - _long(o), _long(c)) * _long(c) + _long(o) for b, c, o in zip(self.hi, chunk, offset)]
        inverted = _any(b < a for a, b in zip(lo, hi))
        return Box(lo, [F.when(inverted, a).otherwise(b) for a, b in zip(lo, hi)])

    def rounded_to(self, chunk: Sequence, offset: Sequence = (0, 0, 0)) -> Box:
        """To the nearest grid planes, halves to the even one."""
        to = lambda v, c, o: F.bround((v - _long(o)) / _long(c)).cast("bigint") * _long(c) + _long(o)
        return Box([to(v, c, o) for v, c, o in zip(self.lo, chunk, offset)], [to(v, c, o) for v, c, o in zip(self.hi, chunk, offset)])

    def is_aligned(self, chunk: Sequence, offset: Sequence = (0, 0, 0)) -> Column:
        return self.equals(self.expanded_to(chunk, offset))

    def equals(self, o: Box) -> Column:
        return _all((a0 == b0) & (a1 == b1) for a0, a1, b0, b1 in self._pairs(o))

    def size(self) -> list[Column]:
        return [b - a for a, b in zip(self.lo, self.hi)]

    def num_chunks(self, chunk: Sequence) -> Column:
        return reduce(lambda a, b: a * b, [grid.ceil_div(s, _long(c)) for s, c in zip(self.size(), chunk)])

    def volume(self) -> Column:
        """Wide enough for any box of 64-bit corners that fits 38 digits."""
        return reduce(lambda a, b: (a * b).cast("decimal(38,0)"), [s.cast("decimal(20,0)") for s in self.size()])

    def centre(self) -> list[Column]:
        return [(a + b) / 2 for a, b in zip(self.lo, self.hi)]

    def valid(self) -> Column:
        return _all(a <= b for a, b in zip(self.lo, self.hi))

    def subvoxel(self) -> Column:
        return ~self.valid() | (reduce(lambda a, b: a * b, [s.cast("double") for s in self.size()]) < 1)

    def empty(self) -> Column:
        """No extent along some axis, or corners out of order."""
        return reduce(lambda a, b: a | b, [s <= 0 for s in self.size()])

    def grown(self, by: Sequence) -> Box:
        return Box([a - _col(v) for a, v in zip(self.lo, by)], [b + _col(v) for b, v in zip(self.hi, by)])

    def shrunk(self, by: Sequence) -> Box:
        return Box([a + _col(v) for a, v in zip(self.lo, by)], [b - _col(v) for b, v in zip(self.hi, by)])

    def minus(self, by: Sequence) -> Box:
        return Box([a - _col(v) for a, v in zip(self.lo, by)], [b - _col(v) for b, v in zip(self.hi, by)])

    def divided(self, by: Sequence) -> Box:
        return Box([a / _col(v) for a, v in zip(self.lo, by)], [b / _col(v) for b, v in zip(self.hi, by)])

    def transposed(self) -> Box:
        return Box(list(reversed(self.lo)), list(reversed(self.hi)))

    def plus(self, by: Sequence) -> Box:
        return Box([a + _col(v) for a, v in zip(self.lo, by)], [b + _col(v) for b, v in zip(self.hi, by)])

    def times(self, by: Sequence) -> Box:
        return Box([a * _col(v) for a, v in zip(self.lo, by)], [b * _col(v) for b, v in zip(self.hi, by)])

    def floored_by(self, by: Sequence) -> Box:
        return Box([grid.floor_div(a, _long(v)) for a, v in zip(self.lo, by)], [grid.floor_div(b, _long(v)) for b, v in zip(self.hi, by)])

    def to_mip(self, factors: Sequence[Sequence[int]], down: bool = True) -> Box:
        """Through the levels one at a time: low corners floor, high corners ceil.

        ``factors``: per step the scale between neighbouring levels.
        """
        box = self
        for f in factors:
            if down:
                box = Box([grid.floor_div(a, _long(v)) for a, v in zip(box.lo, f)], [grid.ceil_div(b, _long(v)) for b, v in zip(box.hi, f)])
            else:
                box = box.times([_long(v) for v in f])
        return box

    def json(self) -> Column:
        return F.to_json(F.struct(F.array(*self.lo).alias("minpt"), F.array(*self.hi).alias("maxpt")))


def hull_of(lo: Sequence[Column], hi: Sequence[Column]) -> list[Column]:
    """Aggregates: the hull of a group of boxes."""
    return [f(c).alias(f"{d}{e}") for d, a, b in zip(AXES, lo, hi) for f, c, e in ((F.min, a, 0), (F.max, b, 1))]


Corners = tuple[tuple[int, ...], tuple[int, ...]]


def corners(obj, bounds: Corners | None = None) -> Corners:
    """Corners from a name, six numbers, slices, a dictionary or two corners."""
    if isinstance(obj, str):
        m = re.match(grid.CHUNK_NAME, obj)
        if not m:
            raise ValueError(f"no box in {obj!r}")
        n = [int(x) for x in m.groups()[:6]]
        return _in_order(n[0::2], n[1::2])
    if isinstance(obj, dict):
        return _in_order(obj["minpt"], obj["maxpt"])
    obj = list(obj)
    if obj and isinstance(obj[0], (slice, type(Ellipsis))):
        lo, hi = [], []
        for i, s in enumerate(obj):
            if s.step not in (None, 1):
                raise ValueError("a box has no step")
            a = s.start if s.start is not None else bounds[0][i]
            b = s.stop if s.stop is not None else bounds[1][i]
            lo.append(a)
            hi.append(max(a, b))
        return tuple(lo), tuple(hi)
    if len(obj) == 6:
        return _in_order(obj[:3], obj[3:])
    return _in_order(*obj)


def _in_order(a: Sequence, b: Sequence) -> Corners:
    return tuple(min(p, q) for p, q in zip(a, b)), tuple(max(p, q) for p, q in zip(a, b))


def reify(slices, bounds: Corners, bounded: bool = True, autocrop: bool = False) -> tuple[Corners, tuple[int, ...]]:
    """Full slices (start, stop, step) of an index expression within bounds."""
    items = list(slices) if isinstance(slices, (tuple, list)) else [slices]
    if items.count(Ellipsis) > 1:
        raise ValueError("one ellipsis at most")
    n = len(bounds[0])
    if Ellipsis in items:
        i = items.index(Ellipsis)
        items[i : i + 1] = [slice(None)] * (n - len(items) + 1)
    items += [slice(None)] * (n - len(items))
    lo, hi, step = [], [], []
    for k, s in enumerate(items[:n]):
        if isinstance(s, int):
            s = slice(s, s + 1)
        if s.step is not None and s.step < 1:
            raise ValueError("steps are positive")
        a = bounds[0][k] if s.start is None else s.start
        b = bounds[1][k] if s.stop is None else s.stop
        if autocrop:
            a, b = max(a, bounds[0][k]), min(b, bounds[1][k])
        elif bounded and (a < bounds[0][k] or b > bounds[1][k]):
            raise IndexError(f"{a}:{b} is outside {bounds[0][k]}:{bounds[1][k]}")
        lo.append(a)
        hi.append(max(a, b))
        step.append(s.step or 1)
    return (tuple(lo), tuple(hi)), tuple(step)


def dumps(c: Corners) -> str:
    return json.dumps({"minpt": list(c[0]), "maxpt": list(c[1])})
