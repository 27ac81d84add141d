"""Annotations: by id, box or relationship, cropping by type, flat tables with enums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.boxes import Box, Corners

#: Geometry types and how many points each record holds.
GEOMETRIES = {"POINT": 1, "LINE": 2, "AXIS_ALIGNED_BOUNDING_BOX": 2, "ELLIPSOID": 2, "POLYLINE": 0}


def point(geometry: Column | str, which: int = 0) -> list[Column]:
    """Coordinates of a geometry's point; null where the array is too short."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    return [F.get(g, F.lit(3 * which + k)).cast("double") for k in range(3)]


def usable(rows: DataFrame, geometry: str = "geometry", points: int = 1) -> DataFrame:
    """Rows whose geometry is exactly so many finite points."""
    g = F.col(geometry)
    return rows.where(g.isNotNull() & (F.size(g) == 3 * points)).where(F.forall(g, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))


def in_box(kind: str, geometry: Column | str, box: Corners) -> Column:
    """Whether a geometry is kept by a crop; faces are included.

    Boxes are kept if a corner lies inside or the query lies inside them; ellipsoids
    by their centre; lines by either end.
    """
    q = Box.of(*box)
    p = point(geometry)
    if kind in ("POINT", "ELLIPSOID"):
        return q.contains_point(p)
    r = point(geometry, 1)
    either = q.contains_point(p) | q.contains_point(r)
    if kind == "LINE":
        return either
    if kind == "AXIS_ALIGNED_BOUNDING_BOX":
        return either | Box.sorted(p, r).contains_box(q)
    raise ValueError(kind)


def by_box(rows: DataFrame, box: Corners, kind: str = "POINT", geometry: str = "geometry") -> DataFrame:
    return usable(rows, geometry, GEOMETRIES[kind]).where(in_box(kind, geometry, box))


def by_ids(rows: DataFrame, ids: DataFrame, id_col: str = "ids") -> DataFrame:
    return rows.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")


def relationships(rows: DataFrame, relation: str, id_col: str = "ids") -> DataFrame:
    """``ids, related_id``: one row for each related object."""
    return rows.select(id_col, F.explode(relation).alias("related_id")).dropna().distinct()


def by_relationship(rows: DataFrame, relation: str, related: DataFrame, id_col: str = "ids") -> DataFrame:
    """``ids, related_id`` of the annotations related to any of the given objects."""
    return relationships(rows, relation, id_col).join(related.select(F.col(related.columns[0]).alias("related_id")).distinct(), "related_id", "left_semi")


def flat(rows: DataFrame, enums: DataFrame, code: str, label: str, geometry: str = "geometry", id_col: str = "ids") -> DataFrame:
    """``ids, x, y, z, <label>``: coordinates as columns, codes as names (unknown: null).

    ``enums`` is a fixed list of codes.
    """
    xyz = [c.alias(n) for c, n in zip(point(geometry), "xyz")]
    plain = usable(rows, geometry).select(id_col, *xyz, code).distinct()
    return plain.join(F.broadcast(enums.select(code, label).dropna(subset=[code]).distinct()), code, "left").select(id_col, "x", "y", "z", label)


def spread(id_col: str = "ids") -> Column:
    """A number in [0, 1) that looks random and follows from an id alone."""
    low = F.pmod(F.col(id_col), F.lit(2**31).cast("bigint"))
    return F.pmod(low * F.lit(2654435761).cast("bigint"), F.lit(2**32).cast("bigint")) / F.lit(float(2**32))


def levelled(rows: DataFrame, cells: Sequence[Sequence[float]], limit: int, id_col: str = "ids", origin: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """Adds ``level`` and its cell ``i, j, k`` to points (``x, y, z``): the levels of a spatial
    index, coarse ones first, each holding about ``limit`` points a cell at most.

    A level takes the share of the points left that fits its fullest cell, chosen by their
    ids; the last level takes what is left.  Counts of cells merge on the map side, so a
    dense cell is never gathered.
    """
    rest = rows.withColumn("_u", spread(id_col))
    floor = 0.0
    level = F.lit(len(cells) - 1)
    at = lambda k: [F.floor((F.col(c) - F.lit(float(o))) / F.lit(float(s))).cast("bigint") for c, o, s in zip("xyz", origin, cells[k])]
    bounds = []
    for k in range(len(cells) - 1):
        fullest = rest.where(F.col("_u") >= floor).groupBy(*[c.alias(n) for c, n in zip(at(k), "ijk")]).count().agg(F.max("count")).first()[0] or 0
        floor = floor + (1.0 - floor) * min(1.0, limit / fullest) if fullest else 1.0
        bounds.append(floor)
    for k, upper in reversed(list(enumerate(bounds))):
        level = F.when(F.col("_u") < upper, k).otherwise(level)
    out = rest.withColumn("level", level.cast("int"))
    for d, n in enumerate("ijk"):
        place = at(len(cells) - 1)[d]
        for k in range(len(cells) - 1):
            place = F.when(F.col("level") == k, at(k)[d]).otherwise(place)
        out = out.withColumn(n, place)
    return out.drop("_u")


def cells_of_box(box: Corners, cell: Sequence[float], origin: Sequence[float] = (0, 0, 0)) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """First and last cell of a level that a box touches; others need not be read."""
    return tuple(int((a - o) // s) for a, o, s in zip(box[0], origin, cell)), tuple(int((b - o) // s) for b, o, s in zip(box[1], origin, cell))


def by_id_rows(rows: DataFrame, ids: Sequence[int], id_col: str = "ids") -> dict[int, DataFrame]:
    """One frame for each of a few ids: several annotations taken apart."""
    return {i: rows.where(F.col(id_col) == i) for i in dict.fromkeys(ids)}
