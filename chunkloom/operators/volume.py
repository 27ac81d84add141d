"""Sparse volumes as voxel rows: cutouts, lookups, label operators, chunk listings, writes.

A volume is a DataFrame of ``x, y, z`` and one or more value columns in which every
voxel appears at most once and voxels that hold the background are left out.  Chunk
positions are derived columns, so nothing needs painting or scheduling: a cutout is a
range filter the scan can prune by, a lookup is an equi-join, a write is a merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import grid
from chunkloom.functions.boxes import Box, Corners
from chunkloom.operators.ranks import dense_ids

XYZ = ["x", "y", "z"]
GXYZ = ["gx", "gy", "gz"]


class OutOfBounds(ValueError):
    """A request reaches outside the volume."""


class Misaligned(ValueError):
    """A write or delete is not aligned to the chunk grid."""


class ReadOnly(ValueError):
    """A write to a locked level."""


def grid_rows(spark: SparkSession, lo: Sequence[int], hi: Sequence[int], names: Sequence[str] = XYZ) -> DataFrame:
    """All integer positions of a box, generated in parallel along the first axis."""
    if any(b <= a for a, b in zip(lo, hi)):
        return spark.createDataFrame([], ", ".join(f"{n} bigint" for n in names))
    rows = spark.range(lo[0], hi[0]).withColumnRenamed("id", names[0])
    for n, a, b in list(zip(names, lo, hi))[1:]:
        rows = rows.withColumn(n, F.explode(F.sequence(F.lit(a).cast("bigint"), F.lit(b - 1).cast("bigint"))))
    return rows


class Volume:
    """Voxel rows with bounds, chunk size and background."""

    def __init__(self, voxels: DataFrame, bounds: Corners, chunk: Sequence[int], background: int = 0, value: str = "label", locked: bool = False) -> None:
        self.voxels, self.bounds, self.chunk = voxels, bounds, tuple(chunk)
        self.background, self.value, self.locked = background, value, locked

    @property
    def spark(self) -> SparkSession:
        return self.voxels.sparkSession

    # --- where things are -------------------------------------------------

    def box(self) -> Box:
        return Box.of(*[[F.lit(v).cast("bigint") for v in c] for c in self.bounds])

    def grid_size(self) -> tuple[int, ...]:
        return tuple(-(-(b - a) // c) for a, b, c in zip(*self.bounds, self.chunk))

    def chunk_of(self, point: Sequence[Column]) -> list[Column]:
        return [grid.floor_div(p - F.lit(o).cast("bigint"), F.lit(c).cast("bigint")) for p, o, c in zip(point, self.bounds[0], self.chunk)]

    def chunk_box(self, g: Sequence[Column]) -> Box:
        """Box of a grid chunk, its upper ends cut at the bounds."""
        lo = [F.lit(o).cast("bigint") + p * F.lit(c).cast("bigint") for p, o, c in zip(g, self.bounds[0], self.chunk)]
        return Box(lo, [F.least(a + F.lit(c).cast("bigint"), F.lit(b).cast("bigint")) for a, c, b in zip(lo, self.chunk, self.bounds[1])])

    def with_chunks(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns(dict(zip(GXYZ, self.chunk_of([F.col(c) for c in XYZ]))))

    def check(self, box: Corners, bounded: bool = True, autocrop: bool = False) -> Corners:
        """The request, cropped to the bounds or refused."""
        lo, hi = box
        if autocrop:
            lo = tuple(min(max(v, a), b) for v, a, b in zip(lo, *self.bounds))
            hi = tuple(min(max(v, a), b) for v, a, b in zip(hi, *self.bounds))
            return lo, hi
        if bounded and any(p < a or q > b for p, q, a, b in zip(lo, hi, *self.bounds)):
            raise OutOfBounds(f"{box} is outside {self.bounds}")
        return lo, hi

    def aligned_box(self, box: Corners) -> Corners:
        """The box expanded to whole chunks and cut at the bounds."""
        lo = tuple(max(a, (v - a) // c * c + a) for v, a, c in zip(box[0], self.bounds[0], self.chunk))
        hi = tuple(min(b, -(-(v - a) // c) * c + a) for v, a, b, c in zip(box[1], self.bounds[0], self.bounds[1], self.chunk))
        return lo, hi

    def touched_chunks(self, box: Corners) -> DataFrame:
        """Grid positions of all chunks that the box touches."""
        lo, hi = self.aligned_box(box)
        return grid_rows(self.spark, [(v - a) // c for v, a, c in zip(lo, self.bounds[0], self.chunk)], [-(-(v - a) // c) for v, a, c in zip(hi, self.bounds[0], self.chunk)], GXYZ)

    # --- reads -------------------------------------------------------------

    def inside(self, box: Corners) -> Column:
        out = F.lit(True)
        for c, a, b in zip(XYZ, *box):
            out = out & (F.col(c) >= a) & (F.col(c) < b)
        return out

    def cutout(self, box: Corners, step: Sequence[int] = (1, 1, 1), bounded: bool = True, autocrop: bool = False) -> DataFrame:
        """Stored voxels of a box; with steps every step-th plane from the box's corner."""
        box = self.check(box, bounded, autocrop)
        rows = self.voxels.where(self.inside(box))
        for c, a, s in zip(XYZ, box[0], step):
            if s != 1:
                rows = rows.where(F.pmod(F.col(c) - a, F.lit(s)) == 0)
        return rows

    def dense(self, box: Corners, bounded: bool = True) -> DataFrame:
        """All voxels of a box, the background where nothing is stored."""
        box = self.check(box, bounded)
        stored = self.cutout(box, bounded=False).select(*XYZ, self.value)
        return grid_rows(self.spark, *box).join(stored, XYZ, "left").withColumn(self.value, F.coalesce(self.value, F.lit(self.background)))

    def at_points(self, points: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Value at each distinct point (``x, y, z`` and kept columns)."""
        rows = points.select(*keep, *XYZ).distinct()
        return rows.join(self.voxels.select(*XYZ, self.value), XYZ, "left").select(*keep, *XYZ, F.coalesce(self.value, F.lit(self.background)).alias(self.value))

    def around(self, point: Sequence[int], size: int) -> DataFrame:
        """Window of a size around a point, cropped to the bounds."""
        lo = tuple(p - size // 2 for p in point) if size > 1 else tuple(point)
        return self.cutout((lo, tuple(a + size for a in lo)), autocrop=True)

    # --- labels ------------------------------------------------------------

    def unique(self, box: Corners) -> DataFrame:
        """Distinct labels of a box; the background too unless every voxel is stored."""
        box = self.check(box)
        found = self.cutout(box).select(self.value)
        cells = 1
        for a, b in zip(*box):
            cells *= max(0, b - a)
        holes = found.agg(F.count("*").alias("n")).where(F.col("n") < cells).select(F.lit(self.background).cast(found.dtypes[0][1]).alias(self.value))
        return found.distinct().unionByName(holes).distinct()

    def chunk_labels(self) -> DataFrame:
        """``gx, gy, gz, label``: the distinct labels of every chunk."""
        return self.with_chunks(self.voxels).select(*GXYZ, self.value).distinct()

    def unique_core_shell(self, box: Corners, labels: DataFrame) -> DataFrame:
        """Distinct stored labels of a box: from label lists inside, by voxel at its rim."""
        box = self.check(box)
        core = [(-(-(a - o) // c), (b - o) // c if b < e else -(-(e - o) // c)) for a, b, o, e, c in zip(*box, *self.bounds, self.chunk)]
        within = F.lit(all(b > a for a, b in core))
        for g, (a, b) in zip(GXYZ, core):
            within = within & (F.col(g) >= a) & (F.col(g) < b)
        listed = labels.where(within).select(self.value)
        rim = self.with_chunks(self.cutout(box)).where(~within).select(self.value)
        return listed.unionByName(rim).distinct()

    def keep_only(self, rows: DataFrame, ids: Sequence[int], mask: int | None = None) -> DataFrame:
        """Other labels become the background, or with ``mask`` that value (zeros stay)."""
        keep = F.col(self.value).isin(list(ids) + ([self.background] if mask is not None else []))
        return rows.withColumn(self.value, F.when(keep, F.col(self.value)).otherwise(F.lit(self.background if mask is None else mask).cast("bigint")))

    def binary(self, rows: DataFrame, label: int) -> DataFrame:
        return rows.withColumn(self.value, F.col(self.value) == label)

    def renumber(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with dense labels from 1 in label order, and the map old to new."""
        real = rows.where(F.col(self.value) != self.background)
        ids = dense_ids(real, [self.value], "new_label", 1)
        zero = self.spark.createDataFrame([(self.background, self.background)], f"{self.value} bigint, new_label bigint")
        back = ids.unionByName(zero)
        return rows.join(back, self.value, "left"), back

    def remap(self, rows: DataFrame, mapping: DataFrame, preserve_missing: bool = True) -> DataFrame:
        """``mapping``: ``old, new``, one row per old label; others stay or become the background."""
        other = F.col(self.value) if preserve_missing else F.lit(self.background)
        return rows.join(mapping, rows[self.value] == mapping["old"], "left").withColumn(self.value, F.coalesce("new", other).cast("bigint")).drop("old", "new")

    # --- chunks ------------------------------------------------------------

    def stored_chunks(self) -> DataFrame:
        return self.with_chunks(self.voxels).select(*GXYZ).distinct()

    def exists(self, box: Corners) -> DataFrame:
        """For each chunk the box touches, its name and whether it is stored."""
        there = self.stored_chunks().withColumn("_there", F.lit(True))
        rows = self.touched_chunks(self.check(box)).join(there, GXYZ, "left")
        return rows.select(*GXYZ, self.chunk_box([F.col(g) for g in GXYZ]).name().alias("chunk_name"), F.coalesce("_there", F.lit(False)).alias("is_stored"))

    def rechunk(self, chunk: Sequence[int]) -> Volume:
        return Volume(self.voxels, self.bounds, chunk, self.background, self.value)

    # --- writes: each returns the new voxel rows ----------------------------

    def _guard(self) -> None:
        if self.locked:
            raise ReadOnly("this level is locked")

    def write(self, box: Corners, rows: DataFrame, non_aligned: bool = False) -> DataFrame:
        """Replace a box by ``rows``.  Unaligned boxes only with ``non_aligned``."""
        self._guard()
        box = self.check(box)
        if not non_aligned and self.aligned_box(box) != box:
            raise Misaligned(f"{box} is not a union of chunks")
        outside = self.voxels.where(~self.inside(box))
        fresh = rows.where(self.inside(box)).where(F.col(self.value) != self.background)
        return outside.select(*XYZ, self.value).unionByName(fresh.select(*XYZ, self.value))

    def overwrite_partial(self, box: Corners, rows: DataFrame) -> DataFrame:
        """Write a box into whole chunks, what the box does not cover becomes background."""
        self._guard()
        touched = self.aligned_box(self.check(box))
        outside = self.voxels.where(~self.inside(touched))
        fresh = rows.where(self.inside(box)).where(F.col(self.value) != self.background)
        return outside.select(*XYZ, self.value).unionByName(fresh.select(*XYZ, self.value))

    def delete(self, box: Corners, exact: bool = True) -> DataFrame:
        """Drop the chunks of a box, which has to be aligned unless ``exact`` is off."""
        self._guard()
        box = self.check(box)
        whole = self.aligned_box(box)
        if exact and whole != box:
            raise Misaligned(f"{box} is not a union of chunks")
        return self.voxels.where(~self.inside(whole))

    # --- levels -------------------------------------------------------------

    def downsample(self, factor: Sequence[int], how: str = "mode") -> DataFrame:
        """An extension: coarser voxels by the most frequent label (ties: smallest) or mean."""
        pos = [grid.floor_div(F.col(c), F.lit(f).cast("bigint")).alias(c) for c, f in zip(XYZ, factor)]
        rows = self.voxels.select(*pos, F.col(self.value))
        if how == "mean":
            return rows.groupBy(*XYZ).agg(F.avg(self.value).alias(self.value))
        counts = rows.groupBy(*XYZ, self.value).agg(F.count("*").alias("_n"))
        return counts.groupBy(*XYZ).agg(F.min_by(self.value, F.struct(-F.col("_n"), F.col(self.value))).alias(self.value))
