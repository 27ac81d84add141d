"""Time-versioned label hierarchies: roots, leaves, remapping, as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.boxes import Box, Corners
from chunkloom.functions.labels import LabelBits
from chunkloom.operators.sharding import Spec


def valid_at(edges: DataFrame, when: Column) -> DataFrame:
    """Edges (child, parent, valid_from, valid_to) that hold at a time; open ends allowed."""
    return edges.where(((F.col("valid_from").isNull()) | (F.col("valid_from") <= when)) & (F.col("valid_to").isNull() | (when < F.col("valid_to"))))


def latest_before(edges: DataFrame, when: Column) -> DataFrame:
    """Per child the parent set last at or before a time; merges on the map side."""
    seen = edges.where(F.col("valid_from") <= when)
    return seen.groupBy("child").agg(F.max_by("parent", F.struct("valid_from", "parent")).alias("parent"))


def roots(ids: DataFrame, edges: DataFrame, bits: LabelBits, stop_layer: int, n_layers: int, col: str = "label") -> DataFrame:
    """``label, root``: one row per distinct label, resolved up to ``stop_layer``.

    Zero stays zero and labels at or above the layer stay themselves.  At most one
    join per layer; labels that have arrived are no longer joined.
    """
    if not 1 <= stop_layer <= n_layers:
        raise ValueError(f"layers are 1 to {n_layers}")
    parents = edges.select(F.col("child").alias("_child"), F.col("parent").alias("_parent"))
    at = ids.select(F.col(col).alias("label")).dropna().distinct().withColumn("root", F.col("label"))
    for _ in range(stop_layer - 1):
        on = F.when((F.col("root") != 0) & (bits.layer(F.col("root")) < stop_layer), F.col("root"))
        at = at.withColumn("_at", on).join(parents, F.col("_at") == F.col("_child"), "left").select("label", F.coalesce("_parent", "root").alias("root"))
    return at


def with_roots(rows: DataFrame, found: DataFrame, col: str = "label") -> DataFrame:
    """Rows in full, duplicates kept, with the root of their label."""
    return rows.join(found.withColumnRenamed("label", "_l"), F.col(col) == F.col("_l"), "left").drop("_l").withColumn("root", F.coalesce("root", col))


def leaves(tops: DataFrame, edges: DataFrame, bits: LabelBits, stop_layer: int, n_layers: int, box: Corners | None = None) -> DataFrame:
    """``root, leaf``: descendants at ``stop_layer``, of chunks in ``box`` if given."""
    down = edges.select(F.col("parent").alias("_parent"), F.col("child").alias("_child"))
    at = tops.select(F.col(tops.columns[0]).alias("root")).dropna().distinct().withColumn("leaf", F.col("root"))
    for _ in range(n_layers - stop_layer):
        on = F.when(bits.layer(F.col("leaf")) > stop_layer, F.col("leaf"))
        at = at.withColumn("_at", on).join(down, F.col("_at") == F.col("_parent"), "left").select("root", F.coalesce("_child", "leaf").alias("leaf"))
    at = at.where(bits.layer(F.col("leaf")) == stop_layer).distinct()
    if box is not None:
        at = at.where(Box.of(*box).contains_point(bits.decode(F.col("leaf"))[1:4]))
    return at


def children_per_parent(edges: DataFrame) -> DataFrame:
    """``parent, n_children, first_child, last_child`` without gathering children."""
    return edges.groupBy("parent").agg(F.count("*").alias("n_children"), F.min("child").alias("first_child"), F.max("child").alias("last_child"))


# --- positions in the graph's chunk grid ----------------------------------------------------


def roots_at(ids: DataFrame, edges: DataFrame, bits: LabelBits, stop_layer: int, n_layers: int, when: Column, col: str = "label") -> DataFrame:
    """``label, root`` as of a time: every step goes over the edges that held then.

    Edges: ``child, parent, valid_from, valid_to``.  Labels without a parent then are their
    own root.  Where several parents hold, the one set last counts.
    """
    held = valid_at(edges, when)
    one = held.groupBy("child").agg(F.max_by("parent", F.struct("valid_from", "parent")).alias("parent"))
    return roots(ids, one, bits, stop_layer, n_layers, col)


def chunk_number(label: Column, bits: LabelBits) -> Column:
    """The packed chunk position of a label: what lies between its layer and its segment."""
    _, x, y, z, _ = bits.decode(label)
    width = bits.bits(bits.layer(label))
    up = lambda v, n: F.call_function("shiftleft", v.cast("bigint"), n.cast("int"))
    return up(x, width * 2).bitwiseOR(up(y, width)).bitwiseOR(z.cast("bigint"))


def chunk_of_point(point: Sequence[Column], resolution: Sequence[float], chunk: Sequence[int], offset: Sequence[int] = (0, 0, 0), scale: Sequence[float] = (1, 1, 1)) -> list[Column]:
    """Graph chunk of a point: physical, or with ``scale`` the resolution of its level's voxels."""
    at = [p.cast("double") * F.lit(float(s)) / F.lit(float(r)) - F.lit(float(o)) for p, s, r, o in zip(point, scale, resolution, offset)]
    return [F.floor(a / F.lit(float(c))).cast("bigint") for a, c in zip(at, chunk)]


def chunk_box_of_point(point: Sequence[Column], resolution: Sequence[float], chunk: Sequence[int], offset: Sequence[int] = (0, 0, 0), scale: Sequence[float] = (1, 1, 1)) -> Box:
    """Voxel box of the graph chunk that holds a point."""
    lo = [p * F.lit(c).cast("bigint") + F.lit(o).cast("bigint") for p, c, o in zip(chunk_of_point(point, resolution, chunk, offset, scale), chunk, offset)]
    return Box(lo, [a + F.lit(c).cast("bigint") for a, c in zip(lo, chunk)])


def mesh_name(label: Column, bits: LabelBits, chunk: Sequence[int], fan_out: int = 2) -> Column:
    """Name of a label's mesh object: the label, level of detail 0 and its chunk block's box;
    blocks grow by the fan-out with every layer above the second."""
    layer, x, y, z, _ = bits.decode(label)
    times = F.pow(F.lit(float(fan_out)), F.greatest(layer - 2, F.lit(0))).cast("bigint")
    sides = [F.lit(c).cast("bigint") * times for c in chunk]
    lo = [p.cast("bigint") * s for p, s in zip((x, y, z), sides)]
    return F.concat_ws(":", label.cast("string"), F.lit("0"), Box(lo, [a + s for a, s in zip(lo, sides)]).name())


def mesh_shard(label: Column, bits: LabelBits, spec: Spec) -> tuple[Column, Column]:
    """(minishard, file name) of a label's mesh: shard files are kept by chunk."""
    minishard, shard = spec.location(label)
    return minishard, F.concat(chunk_number(label, bits).cast("string"), F.lit("-"), shard, F.lit(".shard"))


def newest_meshes(initial: DataFrame, dynamic: DataFrame, key: str = "label") -> DataFrame:
    """All meshes, of a label that is in both tables the dynamic one."""
    return dynamic.unionByName(initial.join(dynamic.select(key), key, "left_anti"))
