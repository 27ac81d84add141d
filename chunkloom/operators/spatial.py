"""The spatial index: which index files, hence which boxes, hold which labels.

Relations: ``entries(label, file)`` and ``files(file, x0 .. z1)``.  All operators stay
distributed for labels that are in very many files: hulls and counts merge on the map
side, and lists of files come as rows, never gathered per label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.boxes import AXES, Box, Corners, hull_of

#: An index file is named by its box and this suffix.
INDEX_NAME = r"^(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)\.spatial(\.gz|\.br|\.zstd)?$"
BOX = [f"{d}{e}" for d in AXES for e in "01"]


def index_files(files: DataFrame, id_col: str = "id", name: str = "filename") -> DataFrame:
    """``fid, filename, x0 .. z1`` of well-named files, repeated rows once."""
    part = [F.regexp_extract(name, INDEX_NAME, i).try_cast("bigint").alias(c) for i, c in zip(range(1, 7), BOX)]
    return files.select(F.col(id_col).alias("fid"), F.col(name).alias("filename"), *part).dropna(subset=["fid", *BOX]).distinct()


def entries(lookup: DataFrame) -> DataFrame:
    """Distinct (label, fid) with neither null."""
    return lookup.select("label", "fid").dropna().distinct()


def located(lookup: DataFrame, files: DataFrame) -> DataFrame:
    """The index joined: ``label, fid, filename, x0 .. z1``.

    A few files hold most labels; the adaptive planner splits their partitions.
    """
    return entries(lookup).join(index_files(files), "fid")


def labels_in(index: DataFrame, box: Corners) -> DataFrame:
    """Labels with an entry whose box intersects the query box (touching does not count)."""
    q = Box.of(*box)
    e = Box([F.col(f"{d}0") for d in AXES], [F.col(f"{d}1") for d in AXES])
    return index.where(e.intersects(q)).select("label").distinct()


def hulls(index: DataFrame) -> DataFrame:
    """Box around all entries of each label."""
    return index.groupBy("label").agg(*hull_of([F.col(f"{d}0") for d in AXES], [F.col(f"{d}1") for d in AXES]))


def files_of(index: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``label, filename`` rows, of all labels or of those in ``labels``."""
    rows = index if labels is None else index.join(labels.select("label").distinct(), "label", "left_semi")
    return rows.select("label", "filename").distinct()


def tile_join(boxes: DataFrame, queries: DataFrame, tile: tuple[int, int, int]) -> DataFrame:
    """Pairs (label, query_id) of boxes that intersect, by an equi-join on tiles.

    Both sides are listed under the tiles they touch; a pair is taken only in the tile
    that holds the low corner of its common part, so none comes out twice.
    """

    def tiled(df: DataFrame, p: str) -> DataFrame:
        for d, t in zip(AXES, tile):
            lo, hi = F.floor(F.col(f"{p}{d}0") / t).cast("bigint"), F.floor((F.col(f"{p}{d}1") - 1) / t).cast("bigint")
            df = df.withColumn(f"t{d}", F.explode(F.sequence(lo, F.greatest(lo, hi))))
        return df

    a = tiled(boxes.select("label", *[F.col(c).alias(f"a{c}") for c in BOX]), "a")
    b = tiled(queries.select("query_id", *[F.col(c).alias(f"b{c}") for c in BOX]), "b")
    j = a.join(b, [f"t{d}" for d in AXES])
    for d, t in zip(AXES, tile):
        j = j.where((F.col(f"a{d}0") < F.col(f"b{d}1")) & (F.col(f"a{d}1") > F.col(f"b{d}0")) & (F.floor(F.greatest(f"a{d}0", f"b{d}0") / t) == F.col(f"t{d}")))
    return j.select("label", "query_id")
