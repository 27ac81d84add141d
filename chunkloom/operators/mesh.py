"""Meshes and skeletons as vertex and face or edge rows.

Vertices: ``segid, frag, vid, x, y, z`` with ``vid`` from 0 within a fragment; faces:
``segid, frag, v1, v2, v3``; edges: ``segid, a, b``.  Windows are over the fragments of a
segment or over one position, never over the vertices or faces of a segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.functions.boxes import Box, Corners
from chunkloom.operators.ranks import dense_within
from chunkloom.session import cut

POS = ["x", "y", "z"]


def concatenate(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments of a segment as one mesh: ids shifted by the vertices before them.

    Fragments come in the order of their names.
    """
    n = vertices.groupBy("segid", "frag").agg((F.max("vid") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("segid").orderBy("frag").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = n.select("segid", "frag", before.cast("bigint").alias("_s"))
    v = vertices.join(shift, ["segid", "frag"]).select("segid", (F.col("vid") + F.col("_s")).alias("vid"), *POS)
    f = faces.join(shift, ["segid", "frag"]).select("segid", *[(F.col(c) + F.col("_s")).alias(c) for c in ("v1", "v2", "v3")])
    return v, f


def _renumbered(parts: DataFrame, mapping: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        parts = parts.join(mapping.select("segid", F.col("vid").alias(c), F.col("new_vid").alias(f"_{c}")), ["segid", c]).drop(c).withColumnRenamed(f"_{c}", c)
    return parts.select("segid", *cols)


def consolidate(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vertices become one, in coordinate order; equal faces too."""
    v = cut(dense_within(vertices, "segid", POS, "new_vid"), "places")
    mapping = vertices.join(v, ["segid", *POS]).select("segid", "vid", "new_vid")
    return v.select("segid", F.col("new_vid").alias("vid"), *POS), _renumbered(faces, mapping, ["v1", "v2", "v3"]).distinct()


def merge_doubled(vertices: DataFrame, aligned: Column) -> DataFrame:
    """``segid, vid, kept_vid``: vertices found exactly twice on a boundary become one."""
    w = Window.partitionBy("segid", *POS)
    rows = vertices.withColumn("_n", F.count("*").over(w)).withColumn("_first", F.min("vid").over(w))
    return rows.select("segid", "vid", F.when((F.col("_n") == 2) & aligned, F.col("_first")).otherwise(F.col("vid")).alias("kept_vid"))


def on_boundary(chunk: Sequence[int], offset: Sequence[float] = (0, 0, 0)) -> Column:
    """Whether a vertex lies on a face of the chunk grid."""
    hits = [F.pmod(F.col(c) - F.lit(float(o)), F.lit(float(k))) == 0 for c, o, k in zip(POS, offset, chunk)]
    return hits[0] | hits[1] | hits[2]


def near_boundary(chunk: Sequence[int], quantum: Sequence[float]) -> Column:
    """Within half a quantisation step of a face: below it strictly, above it inclusively."""
    out = F.lit(False)
    for c, k, g in zip(POS, chunk, quantum):
        r = F.pmod(F.col(c), F.lit(float(k)))
        out = out | (r <= g / 2) | (r > k - g / 2)
    return out


def crop(vertices: DataFrame, faces: DataFrame, box: Corners) -> tuple[DataFrame, DataFrame]:
    """Vertices inside (faces of the box included), renumbered, and whole triangles."""
    kept = vertices.where(Box.of(*box).contains_point([F.col(c) for c in POS]))
    ids = cut(dense_within(kept, "segid", ["vid"], "new_vid"), "kept")
    return kept.join(ids, ["segid", "vid"]).select("segid", F.col("new_vid").alias("vid"), *POS), _renumbered(faces, ids, ["v1", "v2", "v3"])


def face_edges(faces: DataFrame) -> DataFrame:
    """Three sorted vertex pairs per face; shared ones stay double."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return faces.select("segid", F.explode(F.array(pair("v1", "v2"), pair("v2", "v3"), pair("v1", "v3"))).alias("e")).select("segid", "e.a", "e.b")


def dequantize(fragment: Sequence[Column], lod: Column, bits: int, chunk_shape: Sequence[float], origin: Sequence[float], vertex: Sequence[Column]) -> list[Column]:
    """Quantised vertices of a multi-resolution fragment in model space."""
    scale = F.pow(F.lit(2.0), lod)
    return [F.lit(float(o)) + (p + v / F.lit(float(2**bits - 1))) * F.lit(float(c)) * scale for p, v, c, o in zip(fragment, vertex, chunk_shape, origin)]


def affine(matrix: Sequence[Sequence[float]], point: Sequence[Column]) -> list[Column]:
    """The top three rows of a 4 by 4 (or a 3 by 4) transform applied to a point."""
    return [sum((F.lit(float(row[k])) * point[k] for k in range(3)), F.lit(float(row[3]))) for row in matrix[:3]]


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``segid, section, n, line`` of a Wavefront text, vertices before faces."""
    v = vertices.select("segid", F.lit(0).alias("section"), F.col("vid").alias("n"), F.format_string("v %.5f %.5f %.5f", *[F.col(c).cast("double") for c in POS]).alias("line"))
    f = dense_within(faces, "segid", ["v1", "v2", "v3"], "n")
    f = f.select("segid", F.lit(1).alias("section"), "n", F.format_string("f %d %d %d", F.col("v1") + 1, F.col("v2") + 1, F.col("v3") + 1).alias("line"))
    return v.unionByName(f)


# --- skeletons --------------------------------------------------------------


def edge_lengths(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``segid, a, b, length``."""
    end = lambda c: vertices.select("segid", F.col("vid").alias(c), *[F.col(p).alias(f"{p}_{c}") for p in POS])
    j = edges.join(end("a"), ["segid", "a"]).join(end("b"), ["segid", "b"])
    return j.select("segid", "a", "b", F.sqrt(sum((F.pow(F.col(f"{p}_a") - F.col(f"{p}_b"), F.lit(2.0)) for p in POS), F.lit(0.0))).alias("length"))


def cable_length(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return edge_lengths(vertices, edges).groupBy("segid").agg(F.sum("length").alias("cable_length"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select("segid", F.explode(F.array("a", "b")).alias("vid")).groupBy("segid", "vid").agg(F.count("*").alias("degree"))


def connected_vertices(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that an edge touches."""
    return vertices.join(degrees(edges).select("segid", "vid"), ["segid", "vid"], "left_semi")


def consolidate_edges(edges: DataFrame) -> DataFrame:
    """Sorted pairs once, without loops."""
    return edges.select("segid", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def components(vertices: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """``segid, vid, component``: the smallest vertex of the connected component.

    Labels spread to neighbours and then jump to their label's label, so the rounds
    grow with the logarithm of a path's length.  Each round's table is written.
    """
    both = cut(edges.select("segid", "a", "b").unionByName(edges.select("segid", F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    at = cut(vertices.select("segid", "vid", F.col("vid").alias("c")).distinct(), "components")
    for _ in range(most):
        spread = both.join(at.select("segid", F.col("vid").alias("b"), F.col("c").alias("_c")), ["segid", "b"]).groupBy("segid", "a").agg(F.min("_c").alias("_c")).withColumnRenamed("a", "vid")
        new = at.join(spread, ["segid", "vid"], "left").select("segid", "vid", F.col("c").alias("old"), F.least("c", F.coalesce("_c", "c")).alias("c"))
        jump = at.select("segid", F.col("vid").alias("c"), F.col("c").alias("_j"))
        new = cut(new.join(jump, ["segid", "c"], "left").select("segid", "vid", "old", F.least("c", F.coalesce("_j", "c")).alias("c")), "components")
        done = new.where("old <> c").isEmpty()
        at = new.select("segid", "vid", "c")
        if done:
            return at.withColumnRenamed("c", "component")
    raise RuntimeError("components did not settle")


def path_positions(vertices: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """``segid, start, first, vid, pos, length``: the vertices along each path.

    Paths lead from end or joint to end or joint (degree other than 2) over vertices of
    degree 2; they begin at the smaller of both, ``first`` is the vertex after it.  A ring
    without joints begins at its smallest vertex.  Ends and joints are in all their paths;
    vertices without edges are in none.

    Places are found by pointer doubling over directed edges, so rounds grow with the
    logarithm of the longest path and no path is gathered.  Each round's table is written.
    """
    e = cut(consolidate_edges(edges), "edges")
    deg = cut(degrees(e), "degrees")
    comp = components(deg.select("segid", "vid"), e, most)
    ring = deg.join(comp, ["segid", "vid"]).groupBy("segid", "component").agg(F.max(F.abs(F.col("degree") - 2)).alias("_d")).where("_d = 0")
    ends = deg.where("degree <> 2").select("segid", "vid").unionByName(ring.select("segid", F.col("component").alias("vid"))).withColumn("is_end", F.lit(True))
    darts = e.unionByName(e.select("segid", F.col("b").alias("a"), F.col("a").alias("b")))
    darts = darts.join(ends.withColumnRenamed("vid", "b"), ["segid", "b"], "left").join(ends.select("segid", F.col("vid").alias("a"), F.col("is_end").alias("from_end")), ["segid", "a"], "left")
    darts = cut(darts.select("segid", "a", "b", F.coalesce("is_end", F.lit(False)).alias("is_end"), F.coalesce("from_end", F.lit(False)).alias("from_end")), "darts")
    # a dart goes on from b to the neighbour that is not a
    on = darts.where("not from_end").select("segid", F.col("a").alias("b"), F.col("b").alias("c"))
    go = darts.where("not is_end").join(on, ["segid", "b"]).where("a <> c").select("segid", "a", "b", "c")
    at = darts.join(go, ["segid", "a", "b"], "left").select("segid", "a", "b", "from_end", F.lit(1).cast("bigint").alias("n"), F.col("b").alias("end"), F.col("a").alias("last"), F.when(F.col("c").isNotNull(), F.struct(F.col("b").alias("a"), F.col("c").alias("b"))).alias("next"))
    for _ in range(most):
        at = cut(at, "paths")
        if at.where("next is not null").isEmpty():
            break
        far = at.select("segid", F.struct("a", "b").alias("next"), F.col("n").alias("_n"), F.col("end").alias("_end"), F.col("last").alias("_last"), F.col("next").alias("_next"))
        at = at.join(far, ["segid", "next"], "left").select("segid", "a", "b", "from_end", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.coalesce("_end", "end").alias("end"), F.when(F.col("_end").isNull(), F.col("last")).otherwise(F.col("_last")).alias("last"), F.col("_next").alias("next"))
    else:
        raise RuntimeError("paths did not settle")
    end = F.struct(F.col("end").alias("start"), F.col("last").alias("first"))
    # an end sees its path from one dart, an inner vertex from two
    own = F.struct(F.col("a").alias("start"), F.col("b").alias("first"))
    outer = at.where("from_end").select("segid", F.least(own, end).alias("path"), F.col("a").alias("vid"), F.when(own <= end, F.lit(0).cast("bigint")).otherwise(F.col("n")).alias("pos"), F.col("n").alias("length")).distinct()
    inner = at.where("not from_end").groupBy("segid", F.col("a").alias("vid")).agg(F.min(F.struct(end.alias("path"), F.col("n").alias("pos"))).alias("m"), F.sum("n").alias("length"))
    rows = outer.unionByName(inner.select("segid", "m.path", "vid", "m.pos", "length"))
    return rows.select("segid", "path.start", "path.first", "vid", "pos", "length")


PATH = ["segid", "start", "first"]


def thin_paths(vertices: DataFrame, edges: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges when every ``every``-th vertex of a path is kept, counted from
    its begin, and always ends and joints."""
    if every < 1 or int(every) != every:
        raise ValueError("a positive whole number")
    kept = cut(path_positions(vertices, edges).where((F.col("pos") % int(every) == 0) | (F.col("pos") == F.col("length"))), "kept")
    # the kept vertex before: one step back to the last multiple
    step = F.when(F.col("pos") % int(every) == 0, F.col("pos") - int(every)).otherwise(F.col("pos") - F.col("pos") % int(every))
    back = kept.where("pos > 0").withColumn("pos", step).withColumnRenamed("vid", "b").join(kept.select(*PATH, "pos", F.col("vid").alias("a")), [*PATH, "pos"])
    return vertices.join(kept.select("segid", "vid").distinct(), ["segid", "vid"], "left_semi"), consolidate_edges(back.select("segid", "a", "b"))


def smooth_paths(vertices: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Vertices at the mean of ``n`` neighbours along their path (fewer near its ends); ends
    and joints stay, and so do vertices without edges."""
    if n < 1 or int(n) != n:
        raise ValueError("a positive whole number")
    rows = path_positions(vertices, edges).join(vertices, ["segid", "vid"])
    # each position is handed to the places that it counts for
    near = F.sequence(F.greatest(F.col("pos") - (n - 1) // 2, F.lit(0)), F.least(F.col("pos") + n // 2, F.col("length")))
    means = rows.select(*PATH, "length", F.explode(near).alias("pos"), *POS).groupBy(*PATH, "pos").agg(*[F.avg(c).alias(f"_{c}") for c in POS])
    inner = rows.where("pos > 0 and pos < length").select(*PATH, "pos", "vid").join(means, [*PATH, "pos"]).select("segid", "vid", *[f"_{c}" for c in POS])
    return vertices.join(inner, ["segid", "vid"], "left").select("segid", "vid", *[F.coalesce(f"_{c}", c).alias(c) for c in POS])


def renumbered_skeletons(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices numbered from 0 in their order, without those that no edge touches, and their edges."""
    kept = connected_vertices(vertices, edges)
    ids = cut(dense_within(kept, "segid", ["vid"], "new_vid"), "kept")
    return kept.join(ids, ["segid", "vid"]).select("segid", F.col("new_vid").alias("vid"), *POS), _renumbered(edges, ids, ["a", "b"])


def crop_skeletons(vertices: DataFrame, edges: DataFrame, box: Corners) -> tuple[DataFrame, DataFrame]:
    """Vertices inside (faces of the box included) and the edges between them."""
    kept = vertices.where(Box.of(*box).contains_point([F.col(c) for c in POS]))
    ids = kept.select("segid", "vid")
    both = edges.join(ids.withColumnRenamed("vid", "a"), ["segid", "a"], "left_semi").join(ids.withColumnRenamed("vid", "b"), ["segid", "b"], "left_semi")
    return kept, both.select("segid", "a", "b")


def merge_skeletons(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments of a segment (``frag``, ids from 0 within each) as one skeleton, unconnected.

    Further columns of the vertices are carried over; all fragments share them, being columns.
    """
    n = vertices.groupBy("segid", "frag").agg((F.max("vid") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("segid").orderBy("frag").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = n.select("segid", "frag", before.cast("bigint").alias("_s"))
    extra = [c for c in vertices.columns if c not in ("segid", "frag", "vid")]
    v = vertices.join(shift, ["segid", "frag"]).select("segid", (F.col("vid") + F.col("_s")).alias("vid"), *extra)
    return v, edges.join(shift, ["segid", "frag"]).select("segid", *[(F.col(c) + F.col("_s")).alias(c) for c in "ab"])


def equivalent(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``segid, is_equivalent``: whether both sides have the same places and the same edges
    between places, whatever the numbers of vertices and the directions of edges."""

    def told(v: DataFrame, e: DataFrame) -> DataFrame:
        place = F.struct(*POS)
        points = v.select("segid", place.alias("p"), F.lit(None).cast("struct<x: double, y: double, z: double>").alias("q"))
        end = lambda c: v.select("segid", F.col("vid").alias(c), place.alias(f"_{c}"))
        pairs = e.join(end("a"), ["segid", "a"]).join(end("b"), ["segid", "b"]).select("segid", F.least("_a", "_b").alias("p"), F.greatest("_a", "_b").alias("q"))
        return points.unionByName(pairs).distinct()

    both = told(*a).withColumn("_side", F.lit(1)).unionByName(told(*b).withColumn("_side", F.lit(2)))
    return both.groupBy("segid", "p", "q").agg(F.count("*").alias("_n")).groupBy("segid").agg((F.min("_n") == 2).alias("is_equivalent"))


def smoothed(rows: DataFrame, key: str, order: str, value: str, half: int) -> DataFrame:
    """Moving average over ``2 half + 1`` rows of a key, mirrored at both ends.

    Keys are windows of their own; ``n`` rows are enough for any ``half <= n``.
    """
    w = Window.partitionBy(key)
    r = rows.select(key, order, F.col(value).cast("double").alias("_v")).withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    shifts = [(F.col("_i"), F.lit(True)), (1 - F.col("_i"), F.col("_i") <= half), (2 * F.col("_n") + 1 - F.col("_i"), F.col("_i") > F.col("_n") - half)]
    padded = r.select(key, order, "_v", F.explode(F.filter(F.array(*[F.when(ok, F.struct(p.cast("bigint").alias("p"), F.lit(i == 0).alias("real"))) for i, (p, ok) in enumerate(shifts)]), lambda s: s.isNotNull())).alias("s")).select(key, order, "_v", "s.*")
    out = padded.withColumn("smoothed", F.avg("_v").over(Window.partitionBy(key).orderBy("p").rowsBetween(-half, half)))
    return out.where("real").select(key, order, "smoothed")
