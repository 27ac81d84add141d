"""Complete radius joins of points, and the points inside boxes.

Space is divided into Voronoi cells around pivots sampled from the points, so that
cells are small where points are dense.  A point within ``r`` of a point whose
nearest pivot is ``p`` is, by the triangle inequality, at most ``2 r`` farther from
``p`` than from its own pivot; it is copied into exactly those cells, and only into
cells of lower number than its own, so that every pair meets in one cell alone.  A
box is copied into each cell whose covering radius reaches it.  Within a cell a
vantage-point tree answers the radius queries with the exact metric.

Pivots lie apart, as cells much smaller than ``r`` would only multiply the copies.  A
cell with more than ``block`` points, copies or boxes (many in one spot cannot be
divided by pivots) is joined in blocks: its points, its copies and its boxes are each
divided into chunks, and every pair of chunks that may hold results is a group of its
own.  This loses no pair, and no group holds more than about two blocks.

Metrics: ``euclidean`` over three coordinates, ``great_circle`` over (longitude,
latitude) in degrees with distances in metres on a sphere of 6,371,008.8 m; boxes are
then ranges of longitude and latitude that do not cross the 180th meridian.

Defined cases: points with a null id, or whose geometry is null or not exactly three
(great circle: two) finite numbers, take no part; repeated points count once; two
points of one id make no pair; the limit of the distance and the faces of a box are
included; boxes with a null corner hold nothing; corners may come in either order;
empty inputs give empty results; extra columns are not looked at; a pair may come out
more than once where an id has several geometries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.session import cut

EARTH_M = 6_371_008.8
#: Most pivots; what is broadcast is this many coordinates.
MAX_PIVOTS = 100_000
LEAF = 48
#: Result rows that a group hands over at a time.
ROWS_OUT = 65_536


def _unit(lonlat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lonlat[:, 0]), np.radians(lonlat[:, 1])
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``; a block of bounded size."""
    if metric == "euclidean":
        d2 = np.zeros((len(a), len(b)))
        for i in range(a.shape[1]):
            d2 += (a[:, i, None] - b[None, :, i]) ** 2
        return np.sqrt(d2)
    ua, ub = _unit(a), _unit(b)
    half = np.sqrt(sum((ua[:, i, None] - ub[None, :, i]) ** 2 for i in range(3))) / 2
    return 2 * EARTH_M * np.arcsin(np.clip(half, 0, 1))


def within(a: np.ndarray, b: np.ndarray, radius: float, metric: str) -> np.ndarray:
    """Exact test; Euclidean distances are compared as squares, without a root."""
    if metric == "euclidean":
        d2 = np.zeros((len(a), len(b)))
        for i in range(a.shape[1]):
            d2 += (a[:, i, None] - b[None, :, i]) ** 2
        return d2 <= radius * radius
    return distances(a, b, metric) <= radius


class VantageTree:
    """A vantage-point tree over the rows of an array.

    Inner nodes hold the vantage point, the radius that halves its points and both
    children; queries descend in bulk, so the work per node is vectorised.
    """

    def __init__(self, points: np.ndarray, metric: str = "euclidean", leaf: int = LEAF) -> None:
        self.points, self.metric, self.leaf = points, metric, leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, idx: np.ndarray):
        root: list = []
        stack = [(idx, root)]
        while stack:
            at, slot = stack.pop()
            if len(at) <= self.leaf:
                slot.append(("leaf", at))
                continue
            centre = self.points[at[len(at) // 2]]
            d = distances(centre[None, :], self.points[at], self.metric)[0]
            mu = float(np.median(d))
            inside = d <= mu
            if inside.all():  # more than half in one spot: nothing is left to halve
                inside = d < mu
                if not inside.any():
                    slot.append(("leaf", at))
                    continue
            near, far = at[inside], at[~inside]
            kids: tuple[list, list] = ([], [])
            slot.append(("node", centre, float(d[inside].max()), float(d[~inside].min()), kids))
            stack += [(near, kids[0]), (far, kids[1])]
        return root[0]

    def candidates(self, queries: np.ndarray, radii: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, point rows) of each leaf that the queries' radii reach."""
        slack = 1e-9 * (1 + np.abs(radii))
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            if node[0] == "leaf":
                yield q, node[1]
                continue
            _, centre, reach, start, kids = node
            d = distances(centre[None, :], queries[q], self.metric)[0]
            r = radii[q] + slack[q] + 1e-9 * d
            stack.append((kids[0][0], q[d - r <= reach]))
            stack.append((kids[1][0], q[d + r >= start]))


def _nearest_pivots(pts: np.ndarray, tree: VantageTree, pivots: np.ndarray, metric: str, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Own pivot and its distance, then (point, other cell) pairs for the copies."""
    n = len(pts)
    best, home = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    todo, guess = np.arange(n), np.full(n, np.inf)
    probe = distances(pts, pivots[:: max(1, len(pivots) // 16)], metric)
    guess = probe.min(axis=1)  # an upper bound of the distance to the nearest pivot
    src, dst, dist = [], [], []
    for q, p in tree.candidates(pts[todo], guess + 2 * radius):
        d = distances(pts[q], pivots[p], metric)
        j = d.argmin(axis=1)
        m = d[np.arange(len(q)), j]
        # ties go to the lowest pivot number
        low = np.where(d <= m[:, None], p[None, :], np.iinfo(np.int64).max).min(axis=1)
        better = (m < best[q]) | ((m == best[q]) & (low < home[q]))
        best[q[better]], home[q[better]] = m[better], low[better]
        a, b = np.nonzero(d <= best[q][:, None] + 2 * radius * (1 + 1e-9) + 1e-6)
        src.append(q[a])
        dst.append(p[b])
        dist.append(d[a, b])
    s, t, d = np.concatenate(src), np.concatenate(dst), np.concatenate(dist)
    keep = (t < home[s]) & (d <= best[s] + 2 * radius * (1 + 1e-9) + 1e-6)
    return home, best, s[keep], t[keep]


def sample_pivots(points: DataFrame, dims: list[str], count: int, per_cell: int, apart: float = 0.0, metric: str = "euclidean") -> np.ndarray:
    """Pivots: points with the lowest hashes, about one for ``per_cell`` points.

    Of pivots in one cell of a grid of steps ``apart`` only the first is kept.
    """
    k = int(min(MAX_PIVOTS, max(1, count // per_cell)))
    h = F.xxhash64(*dims)
    rate = min(1.0, 4.0 * k / max(1, count))
    picked = points.select(*dims, h.alias("h")).where(F.abs(F.col("h") % 1_000_000) <= F.lit(int(rate * 1_000_000))).distinct().orderBy("h", *dims).limit(k)
    got = picked.select(*dims).toPandas().to_numpy(dtype=float)
    if not len(got):
        return points.select(*dims).limit(1).toPandas().to_numpy(dtype=float)
    if apart > 0:
        place = got if metric == "euclidean" else _unit(got) * EARTH_M
        _, first = np.unique(np.floor(place / apart), axis=0, return_index=True)
        got = got[np.sort(first)]
    return got


def radius_join(points: DataFrame, radius: float, boxes: DataFrame | None = None, metric: str = "euclidean", per_cell: int = 1500, block: int = 6000) -> DataFrame:
    """Pairs of close points and, with ``boxes``, the points inside each box.

    ``points``: ``id`` and coordinates ``x, y, z`` (great circle: ``x, y``), as of
    ``usable_points``.  ``boxes``: ``box_id`` and ``x0 .. z1``.  Returns
    ``kind, left_id, right_id``, kind 'near' (left_id < right_id) or 'inside'.
    """
    dims = ["x", "y", "z"] if metric == "euclidean" else ["x", "y"]
    tall = _groups(points, radius, boxes, metric, per_cell, block)
    schema = "kind string, left_id bigint, right_id bigint"
    if tall is None:
        return points.sparkSession.createDataFrame([], schema)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _cell_pairs(pd.concat(list(batches), ignore_index=True), dims, radius, metric)

    return tall.groupBy("cell", "part", "i", "j").applyInPandas(local, schema)


def _groups(points: DataFrame, radius: float, boxes: DataFrame | None, metric: str, per_cell: int, block: int) -> DataFrame | None:
    """``cell, part, i, j`` (the group), ``role, chunk, id`` and coordinates; None without points.

    Roles: 0 a cell's own point, 1 a copy, 2 a box.  Parts: 0 a whole cell; of a cell in
    blocks 1 points with points, 2 copies with points, 3 boxes with points, where i and j
    are the chunks of either.
    """
    dims = ["x", "y", "z"] if metric == "euclidean" else ["x", "y"]
    spark = points.sparkSession
    pts = cut(points.select("id", *dims).distinct(), "points")
    count = pts.count()
    if not count:
        return None
    found = sample_pivots(pts, dims, count, per_cell, 4 * radius, metric)
    pivots = spark.sparkContext.broadcast((found, VantageTree(found, metric)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piv, tree = pivots.value
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                part = pdf.iloc[i : i + 4096]
                xyz = part[dims].to_numpy(dtype=float)
                home, best, s, t = _nearest_pivots(xyz, tree, piv, metric, radius)
                own = part.assign(cell=home, role=0, reach=best)
                copies = part.iloc[s].assign(cell=t, role=1, reach=0.0)
                yield pd.concat([own, copies])[["cell", "role", "reach", "id", *dims]]

    placed = cut(pts.mapInPandas(assign, "cell bigint, role int, reach double, id bigint, " + ", ".join(f"{c} double" for c in dims)), "cells")
    tall = placed.select("cell", "role", "id", *dims, *([F.lit(None).cast("double").alias(f"h{c}") for c in dims] if boxes is not None else []))
    # at most MAX_PIVOTS rows
    stats = placed.groupBy("cell").agg(F.count_if(F.col("role") == 0).alias("n0"), F.count_if(F.col("role") == 1).alias("n1"), F.max("reach").alias("reach")).toPandas()
    sizes = {int(c): [int(a), int(b), 0] for c, a, b in zip(stats["cell"], stats["n0"], stats["n1"])}
    if boxes is not None:
        own = stats[stats["n0"] > 0]
        reach = np.full(len(found), -1.0)
        reach[own["cell"].to_numpy()] = own["reach"].to_numpy()
        placed_boxes = cut(_place_boxes(boxes, pivots, spark.sparkContext.broadcast(reach), dims, metric), "boxes")
        for r in placed_boxes.groupBy("cell").agg(F.count("*").alias("n")).collect():
            sizes[r["cell"]][2] = r["n"]
        tall = tall.unionByName(placed_boxes)
    hot = [(c, *[-(-n // block) for n in ns]) for c, ns in sizes.items() if max(ns) > block]
    counts = F.broadcast(spark.createDataFrame(hot, "cell bigint, k0 int, k1 int, k2 int"))
    tall = tall.join(counts, "cell", "left")
    mine = F.when(F.col("role") == 0, F.col("k0")).when(F.col("role") == 1, F.col("k1")).otherwise(F.col("k2"))
    chunk = F.coalesce(F.pmod(F.xxhash64("id", *dims), mine), F.lit(0)).cast("int")
    tall = tall.withColumn("chunk", chunk)

    def each(k: str, part: int, of) -> Column:
        spots = F.transform(F.sequence(F.lit(0), F.col(k) - 1), lambda o: F.struct(F.lit(part).alias("part"), *[c.cast("int").alias(n) for c, n in zip(of(o), "ij")]))
        return F.when(F.col(k) > 0, spots).otherwise(F.array().cast("array<struct<part: int, i: int, j: int>>"))

    me = F.col("chunk")
    points_go = F.concat(each("k0", 1, lambda o: (F.least(me, o), F.greatest(me, o))), each("k1", 2, lambda o: (o, me)), each("k2", 3, lambda o: (o, me)))
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    spots = F.when(F.col("k0").isNull(), whole).when(F.col("role") == 0, points_go).when(F.col("role") == 1, each("k0", 2, lambda o: (me, o))).otherwise(each("k0", 3, lambda o: (me, o)))
    return tall.withColumn("spot", F.explode(spots)).select("*", "spot.part", "spot.i", "spot.j").drop("spot", "k0", "k1", "k2")


def _place_boxes(boxes: DataFrame, pivots, reached, dims: list[str], metric: str) -> DataFrame:
    """A row (low and high corner) for each cell whose ball meets the box.

    Pivots are searched by trees, one for each order of size of the cells' reach.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piv, reach = pivots.value[0], reached.value
        live = np.nonzero(reach >= 0)[0]
        order = np.ceil(np.log2(np.maximum(reach[live], 1e-3)))
        trees = [(live[order == o], float(reach[live[order == o]].max())) for o in np.unique(order)]
        trees = [(p, r, VantageTree(piv[p], metric)) for p, r in trees]
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                part = pdf.iloc[i : i + 1024]
                lo, hi = part[[f"{c}0" for c in dims]].to_numpy(float), part[[f"{c}1" for c in dims]].to_numpy(float)
                centre, half = (lo + hi) / 2, _half_extent(lo, hi, metric)
                for ids, most, tree in trees:
                    for q, p in tree.candidates(centre, half + most * (1 + 1e-9) + 1e-6):
                        room = reach[ids[p]][None, :] * (1 + 1e-9) + 1e-6
                        if metric == "euclidean":
                            gap2 = np.zeros((len(q), len(p)))
                            for k in range(len(dims)):
                                at = piv[ids[p], k][None, :]
                                gap2 += np.maximum(0, np.maximum(lo[q, k, None] - at, at - hi[q, k, None])) ** 2
                            b, c = np.nonzero(np.sqrt(gap2) <= room)
                        else:
                            b, c = np.nonzero(distances(centre[q], piv[ids[p]], metric) <= half[q, None] + room)
                        out = pd.DataFrame({"cell": ids[p[c]], "role": 2, "id": part["box_id"].to_numpy()[q[b]]})
                        for k, name in enumerate(dims):
                            out[name], out[f"h{name}"] = lo[q[b], k], hi[q[b], k]
                        yield out

    lo_hi = [F.least(f"{c}0", f"{c}1").cast("double").alias(f"{c}0") for c in dims] + [F.greatest(f"{c}0", f"{c}1").cast("double").alias(f"{c}1") for c in dims]
    whole = boxes.dropna(subset=["box_id"] + [f"{c}{e}" for c in dims for e in "01"]).select("box_id", *lo_hi).distinct()
    return whole.mapInPandas(place, "cell bigint, role int, id bigint, " + ", ".join(f"{c} double, h{c} double" for c in dims))


def _half_extent(lo: np.ndarray, hi: np.ndarray, metric: str) -> np.ndarray:
    """No point of a box is farther than this from its centre."""
    if metric == "euclidean":
        return np.sqrt(((hi - lo) ** 2).sum(axis=1)) / 2
    # along a meridian to the point's latitude, then along its parallel
    widest = np.where((lo[:, 1] <= 0) & (hi[:, 1] >= 0), 1.0, np.cos(np.radians(np.minimum(np.abs(lo[:, 1]), np.abs(hi[:, 1])))))
    return EARTH_M * np.radians((hi[:, 1] - lo[:, 1]) / 2 + widest * (hi[:, 0] - lo[:, 0]) / 2)


def _cell_pairs(pdf: pd.DataFrame, dims: list[str], radius: float, metric: str) -> Iterator[pd.DataFrame]:
    """Results of one group, handed over in bounded pieces."""
    part, i, j = (int(pdf[c].iloc[0]) for c in ("part", "i", "j"))
    role, chunk, ids = pdf["role"].to_numpy(), pdf["chunk"].to_numpy(), pdf["id"].to_numpy()
    xyz = pdf[dims].to_numpy(float)
    home = np.nonzero(role == 0)[0]
    other = home
    if part == 0:
        other = np.nonzero(role <= 1)[0]
    elif part == 1 and i != j:
        home, other = home[chunk[home] == i], home[chunk[home] == j]
    elif part >= 2:
        other = np.nonzero(role == 1)[0]
    if not len(home):
        return
    tree = VantageTree(xyz[home], metric)

    def near() -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for q, p in tree.candidates(xyz[other], np.full(len(other), float(radius))):
            for s in range(0, len(q), 4096):
                qq = other[q[s : s + 4096]]
                a, b = np.nonzero(within(xyz[qq], xyz[home[p]], radius, metric))
                x, y, same = ids[qq[a]], ids[home[p[b]]], role[qq[a]] == 0
                # two own points of one chunk meet twice: once from either side
                ok = np.where(same & (i == j), x < y, x != y)
                x, y = x[ok], y[ok]
                yield "near", np.minimum(x, y), np.maximum(x, y)

    def inside() -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        box = np.nonzero(role == 2)[0]
        if not len(box):
            return
        lo, hi = xyz[box], pdf[[f"h{c}" for c in dims]].to_numpy(float)[box]
        for q, p in tree.candidates((lo + hi) / 2, _half_extent(lo, hi, metric)):
            pt = xyz[home[p]]
            for s in range(0, len(q), 4096):
                qq = q[s : s + 4096]
                ok = np.ones((len(qq), len(p)), dtype=bool)
                for k in range(len(dims)):
                    ok &= (pt[None, :, k] >= lo[qq, k, None]) & (pt[None, :, k] <= hi[qq, k, None])
                a, b = np.nonzero(ok)
                yield "inside", ids[box[qq[a]]], ids[home[p[b]]]

    for hits in (near(), inside()):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        kind, n = "", 0
        for kind, x, y in hits:
            held.append((x, y))
            n += len(x)
            if n >= ROWS_OUT:
                yield _rows(kind, held)
                held, n = [], 0
        if n:
            yield _rows(kind, held)


def _rows(kind: str, held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    left, right = (np.concatenate(v) for v in zip(*held))
    return pd.DataFrame({"kind": kind, "left_id": left, "right_id": right})


def usable_points(df: DataFrame, id_col: str, geometry: str, metric: str = "euclidean") -> DataFrame:
    """``id, x, y, z`` of the rows whose geometry is exactly so many finite numbers."""
    n = 3 if metric == "euclidean" else 2
    g = F.col(geometry)
    finite = F.forall(g, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    names = ["x", "y", "z"][:n]
    return df.where(F.col(id_col).isNotNull() & g.isNotNull() & (F.size(g) == n)).where(finite).select(F.col(id_col).cast("bigint").alias("id"), *[g[k].cast("double").alias(c) for k, c in enumerate(names)])
