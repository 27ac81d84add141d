"""Round trips through the file formats, and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkloom.operators import sharding, spatial
from chunkloom.operators.sharding import Spec
from chunkloom.operators.volume import XYZ, Volume
from chunkloom.plans.volume_queries import B, V, volume
from chunkloom.plans.object_queries import _INDEX, _MESH, _SKEL, _USABLE
from chunkloom.sources import layers, objects, shards
from chunkloom.session import cut, fresh_path, table
from chunkloom.streaming import ingest

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_ALL = f"WITH {V} SELECT x, y, z, label FROM v"
_FLAT = (1024, 128, 8)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _written(spark, sf_dir, **how) -> str:
    path = layers.local(fresh_path(spark, "layer"))
    layers.write_layer(Volume(_given(spark, sf_dir).select(*XYZ, "label"), volume(spark, sf_dir).bounds, _FLAT), path, least=True, **how)
    return path


def _given(spark, sf_dir):
    """The voxels of V as the table has them, some more than once; V has the least of each."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_linenumber").cast("bigint").alias("z"), (F.col("l_orderkey") + 1).alias("label"), F.col("l_quantity").alias("val"))


def _read(spark, path: str):
    return layers.read_layer(spark, path, skip_background=True).select(*XYZ, F.col("value").alias("label"))


@query(_ALL)
def precomputed_roundtrip(spark, sf_dir):
    """Written as gzipped raw chunks and read back."""
    return _read(spark, _written(spark, sf_dir))


@query(_ALL)
def segmentation_roundtrip(spark, sf_dir):
    """The block-wise compressed label encoding."""
    return _read(spark, _written(spark, sf_dir, encoding="compressed_segmentation"))


@query(f"WITH {V} SELECT x, y, z, CAST(val AS INTEGER) AS value FROM v")
def png_roundtrip(spark, sf_dir):
    """An image layer of 8 bits as PNG chunks."""
    v = volume(spark, sf_dir)
    path = layers.local(fresh_path(spark, "layer"))
    layers.write_layer(Volume(_given(spark, sf_dir).select(*XYZ, F.col("val").cast("int").alias("value")), v.bounds, _FLAT, value="value"), path, dtype="uint8", encoding="png", compress="", least=True)
    return layers.read_layer(spark, path, skip_background=True).select(*XYZ, "value")


@query(_ALL)
def sharded_roundtrip(spark, sf_dir):
    return _read(spark, _written(spark, sf_dir, spec=Spec(1, 2, 8)))


@query(_ALL)
def zarr2_roundtrip(spark, sf_dir):
    return _read(spark, _written(spark, sf_dir, layer_format="zarr2", compress="zlib"))


@query(_ALL)
def zarr3_roundtrip(spark, sf_dir):
    return _read(spark, _written(spark, sf_dir, layer_format="zarr3", compress="zstd"))


@query(f"WITH {V} SELECT x, y, z, label FROM v WHERE x >= 100 AND x < 400 AND y < 50 AND z <= 4")
def source_filter_pushdown(spark, sf_dir):
    """A cutout straight from files: the filters narrow the list of chunks."""
    return _read(spark, _written(spark, sf_dir)).where("x >= 100 and x < 400 and y < 50 and z <= 4")


@query(_ALL)
def transfer_format(spark, sf_dir):
    """Unsharded to sharded with other chunks, by reading and writing anew."""
    target = layers.local(fresh_path(spark, "layer"))
    layers.transfer(spark, _written(spark, sf_dir, layer_format="zarr3"), target, chunk=(512, 128, 8), spec=Spec(1, 1, 8))
    return _read(spark, target)


def _transferred(spark, sf_dir, how: dict, **target):
    """A layer written, transferred without decoding a voxel, and read back."""
    source, out = _written(spark, sf_dir, **how), layers.local(fresh_path(spark, "layer"))
    layers.transfer(spark, source, out, **target)
    return _read(spark, out)


@query(_ALL)
def transfer_objects(spark, sf_dir):
    """Unsharded chunks with another compression of their files."""
    return _transferred(spark, sf_dir, {}, compress="zstd")


@query(_ALL)
def transfer_pack(spark, sf_dir):
    """Encoded chunks packed into shard files."""
    return _transferred(spark, sf_dir, {}, spec=Spec(1, 2, 8))


@query(_ALL)
def transfer_unpack(spark, sf_dir):
    """Encoded chunks taken out of shard files."""
    return _transferred(spark, sf_dir, {"spec": Spec(1, 2, 8)})


@query(_ALL)
def transfer_shards(spark, sf_dir):
    """Whole shard files, as the layouts are equal."""
    return _transferred(spark, sf_dir, {"spec": Spec(1, 2, 8)}, spec=Spec(1, 2, 8))


@query(f"WITH {V} SELECT x, y, z, label FROM v WHERE x >= 100 AND x < 400 AND y < 50 AND z <= 4")
def sharded_cutout(spark, sf_dir):
    """A cutout from shard files: of each only the ranges of chunks in the box are read."""
    return _read(spark, _written(spark, sf_dir, spec=Spec(1, 2, 8))).where("x >= 100 and x < 400 and y < 50 and z <= 4")


_FRAMED = f"WITH {V} SELECT x, y, z, CAST(x % 2 AS INTEGER) AS c, CAST(y % 3 AS INTEGER) AS t, label FROM v"


def _framed(spark, sf_dir, layer_format: str):
    """Voxels in two channels, one chunk each, and three frames, two in a chunk."""
    v = volume(spark, sf_dir)
    rows = _given(spark, sf_dir).select(*XYZ, (F.col("x") % 2).cast("int").alias("c"), (F.col("y") % 3).cast("int").alias("t"), "label")
    path = layers.local(fresh_path(spark, "layer"))
    layers.write_layer(Volume(rows, v.bounds, _FLAT), path, layer_format, least=True, compress="zstd" if layer_format == "zarr3" else "zlib", channels=2, frames=3, channel_chunk=1, frame_chunk=2)
    return layers.read_layer(spark, path, skip_background=True).select(*XYZ, "c", "t", F.col("value").alias("label"))


@query(_FRAMED)
def zarr3_frames_roundtrip(spark, sf_dir):
    return _framed(spark, sf_dir, "zarr3")


@query(_FRAMED)
def zarr2_frames_roundtrip(spark, sf_dir):
    return _framed(spark, sf_dir, "zarr2")


@query(f"WITH {V}, c AS (SELECT CAST(x // 2 AS BIGINT) AS x, CAST(y // 2 AS BIGINT) AS y, z, label, count(*) AS n FROM v GROUP BY 1, 2, 3, 4), d AS (SELECT x, y, z, label FROM (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY n DESC, label) AS r FROM c) WHERE r = 1) SELECT 0 AS mip, x, y, z, label FROM v UNION ALL SELECT 1, x, y, z, label FROM d")
def zarr3_levels_roundtrip(spark, sf_dir):
    """Two levels of one layer, the coarser one added to the finer."""
    v = volume(spark, sf_dir)
    fine = Volume(cut(v.voxels.select(*XYZ, "label"), "voxels"), v.bounds, _FLAT)
    coarse = Volume(fine.downsample((2, 2, 1)), ((0, 0, 1), (-(-v.bounds[1][0] // 2), -(-v.bounds[1][1] // 2), v.bounds[1][2])), _FLAT)
    path = layers.local(fresh_path(spark, "layer"))
    layers.write_layer(fine, path, "zarr3", compress="zstd")
    layers.write_layer(coarse, path, "zarr3", resolution=(2, 2, 1), compress="zstd", level=1)
    out = [layers.read_layer(spark, path, k, skip_background=True).select(F.lit(k).alias("mip"), *XYZ, F.col("value").alias("label")) for k in range(2)]
    return out[0].unionByName(out[1])


_CHUNKS = f"{B}, s AS (SELECT DISTINCT x // 1024 AS gx, y // 128 AS gy, (z - 1) // 8 AS gz FROM v), g AS (SELECT gx, gy, gz, x1, y1, z1 FROM (SELECT unnest(range(0, (x1 + 1023) // 1024)) AS gx FROM b), (SELECT unnest(range(0, (y1 + 127) // 128)) AS gy FROM b), (SELECT unnest(range(0, (z1 + 6) // 8)) AS gz FROM b), b)"


def _known(rows):
    return rows.select("gx", "gy", "gz", "is_stored")


@query(f"WITH {_CHUNKS} SELECT g.gx, g.gy, g.gz, s.gx IS NOT NULL AS is_stored FROM g LEFT JOIN s USING (gx, gy, gz)")
def zarr3_chunk_exists(spark, sf_dir):
    """Which chunks of a layer in files are stored."""
    return _known(layers.chunk_exists(spark, _written(spark, sf_dir, layer_format="zarr3", compress="zstd")))


@query(f"WITH {_CHUNKS} SELECT g.gx, g.gy, g.gz, s.gx IS NOT NULL AS is_stored FROM g LEFT JOIN s USING (gx, gy, gz)")
def sharded_chunk_exists(spark, sf_dir):
    """The same from the indices of shard files."""
    return _known(layers.chunk_exists(spark, _written(spark, sf_dir, spec=Spec(1, 2, 8))))


@query(f"WITH {_CHUNKS} SELECT gx, gy, gz, (least((gx + 1) * 1024, x1) - gx * 1024) * (least((gy + 1) * 128, y1) - gy * 128) * (least((gz + 1) * 8, z1 - 1) - gz * 8) * 4 AS n_bytes FROM g SEMI JOIN s USING (gx, gy, gz)")
def download_chunks(spark, sf_dir):
    """The encoded chunks of a layer, undecoded."""
    return layers.download_chunks(spark, _written(spark, sf_dir)).select("gx", "gy", "gz", F.octet_length("payload").cast("bigint").alias("n_bytes"))


@query(f"WITH {V} SELECT x, y, z, label FROM v WHERE NOT (x < 1024 AND y < 128)")
def zarr3_delete_chunks(spark, sf_dir):
    """A layer in files after the chunks of a box were deleted."""
    path = _written(spark, sf_dir, layer_format="zarr3", compress="zstd")
    layers.delete_chunks(spark, path, box=((0, 0, 1), (10, 10, 2)))
    return _read(spark, path)


@query(f"WITH {V} SELECT x, y, z, label FROM v WHERE val > 40")
def delete_black_files(spark, sf_dir):
    """A layer written again: objects of chunks that hold only background now are deleted."""
    v = volume(spark, sf_dir)
    path, chunk = layers.local(fresh_path(spark, "layer")), (256, 64, 8)
    layers.write_layer(Volume(_given(spark, sf_dir).select(*XYZ, "label"), v.bounds, chunk), path, least=True)
    layers.write_layer(Volume(cut(v.voxels.where("val > 40").select(*XYZ, "label"), "voxels"), v.bounds, chunk), path, erase=True)
    return _read(spark, path)


_STORED = "s AS (SELECT DISTINCT l_orderkey + 1 AS label FROM lineitem), w AS (SELECT DISTINCT p_partkey AS label FROM part)"


def _label_shards(spark, sf_dir, spec: Spec, payload):
    """Shard files of all order numbers, and the part numbers as labels that are asked for."""
    labels = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("label")).distinct()
    path = layers.local(fresh_path(spark, "shards"))
    layers.write_shards(labels.withColumn("payload", payload), path, spec)
    return path, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"))


_HASHED = Spec(1, 4, 5, "murmurhash3_x86_128")


@query(f"WITH {_STORED} SELECT label, concat('label ', label) AS payload FROM s SEMI JOIN w USING (label)")
def shard_lookup(spark, sf_dir):
    """Payloads of some labels by byte ranges: index, minishard indices, then the payloads."""
    path, wanted = _label_shards(spark, sf_dir, _HASHED, F.encode(F.concat(F.lit("label "), F.col("label").cast("string")), "utf-8"))
    return shards.shard_lookup(wanted, path, _HASHED).select("label", F.decode("payload", "utf-8").alias("payload"))


@query(f"WITH {_STORED} SELECT w.label, s.label IS NOT NULL AS is_stored FROM w LEFT JOIN s USING (label)")
def shard_exists(spark, sf_dir):
    """Whether labels are stored, from the indices alone."""
    path, wanted = _label_shards(spark, sf_dir, _HASHED, F.encode(F.col("label").cast("string"), "utf-8"))
    return shards.shard_exists(wanted, path, _HASHED).select("label", "is_stored")


@query(f"WITH {_STORED} SELECT label, label % 50 AS size FROM s")
def shard_list_labels(spark, sf_dir):
    """All labels of shard files with their sizes, from the indices alone."""
    spec = Spec(3, 2, 4, data_encoding="raw")
    path, _ = _label_shards(spark, sf_dir, spec, F.encode(F.repeat(F.lit("v"), (F.col("label") % 50).cast("int")), "utf-8"))
    return shards.list_labels(spark, path, spec).select("label", "size")


def _lines(spark, sf_dir):
    from chunkloom.plans.object_queries import _mesh
    from chunkloom.operators import mesh

    return mesh.concatenate(*_mesh(spark, sf_dir))


@query(f"WITH {_MESH} SELECT segid, vid, x, y, z FROM cv")
def mesh_file_roundtrip(spark, sf_dir):
    """Meshes packed into shard files, taken out and decoded."""
    return _meshes(spark, sf_dir)[0].select("segid", "vid", *[F.col(c).cast("double").alias(c) for c in XYZ])


@query(f"WITH {_MESH} SELECT segid, v1, v2, v3 FROM cf")
def mesh_file_roundtrip_faces(spark, sf_dir):
    """The faces of the meshes taken out of shard files."""
    return _meshes(spark, sf_dir)[1].select("segid", "v1", "v2", "v3")


def _meshes(spark, sf_dir):
    return objects.decode_meshes(_through_shards(objects.mesh_payloads(*_lines(spark, sf_dir))))


_BODIES = """w AS (SELECT l_suppkey AS segid, l_returnflag AS frag, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS vid, CAST(l_partkey % 64 AS DOUBLE) AS x, CAST(l_orderkey % 32 AS DOUBLE) AS y, CAST(l_linenumber AS DOUBLE) AS z FROM lineitem)"""


def _bodies(spark, sf_dir):
    """A mesh for each supplier: its lines as vertices, each three neighbouring ones as a face."""
    from pyspark.sql.window import Window

    t = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    v = t.select(F.col("l_suppkey").alias("segid"), (F.row_number().over(w) - 1).cast("bigint").alias("vid"), (F.col("l_partkey") % 64).cast("double").alias("x"), (F.col("l_orderkey") % 32).cast("double").alias("y"), F.col("l_linenumber").cast("double").alias("z"))
    v = cut(v, "bodies")
    f = v.where("vid >= 2").select("segid", (F.col("vid") - 2).alias("v1"), (F.col("vid") - 1).alias("v2"), F.col("vid").alias("v3"))
    path = layers.local(fresh_path(spark, "meshes"))
    objects.write_meshes(v, f, path)
    return path, v


@query(f"WITH {_BODIES} SELECT segid, vid, x, y, z FROM w WHERE segid % 3 = 0")
def mesh_directory(spark, sf_dir):
    """Meshes as manifests and fragments in a folder; those asked for are read back."""
    path, v = _bodies(spark, sf_dir)
    got, _ = objects.read_meshes(spark, path, v.where("segid % 3 = 0").select("segid"))
    return got.select("segid", "vid", *[F.col(c).cast("double").alias(c) for c in XYZ])


@query(f"WITH {_BODIES} SELECT segid, vid - 2 AS v1, vid - 1 AS v2, vid AS v3 FROM w WHERE vid >= 2")
def mesh_directory_faces(spark, sf_dir):
    return objects.read_meshes(spark, _bodies(spark, sf_dir)[0])[1].select("segid", "v1", "v2", "v3")


@query(f"WITH {_BODIES}, s AS (SELECT DISTINCT segid FROM w) SELECT c_custkey AS segid, s.segid IS NOT NULL AS is_stored FROM customer LEFT JOIN s ON s.segid = c_custkey")
def mesh_exists(spark, sf_dir):
    return objects.mesh_exists(table(spark, sf_dir, "customer").select("c_custkey"), _bodies(spark, sf_dir)[0])


@query(f"WITH {_BODIES} SELECT DISTINCT segid FROM w WHERE segid % 2 = 1")
def mesh_delete(spark, sf_dir):
    """What is left after the meshes of even numbers were deleted."""
    path, v = _bodies(spark, sf_dir)
    objects.delete_meshes(v.where("segid % 2 = 0").select("segid"), path)
    return objects.read_meshes(spark, path)[0].select("segid").distinct()


_LODS = "g AS (SELECT l_suppkey AS segid, l_linenumber % 3 AS lod, l_partkey % 5 AS px, l_orderkey % 3 AS py, l_linenumber // 3 AS pz, CAST(count(*) AS VARCHAR) AS payload FROM lineitem GROUP BY 1, 2, 3, 4, 5)"


def _lods(spark, sf_dir):
    """Encoded fragments in three levels of detail for each supplier."""
    t = table(spark, sf_dir, "lineitem")
    g = t.groupBy(F.col("l_suppkey").alias("segid"), (F.col("l_linenumber") % 3).cast("int").alias("lod"), (F.col("l_partkey") % 5).alias("px"), (F.col("l_orderkey") % 3).alias("py"), F.floor(F.col("l_linenumber") / 3).alias("pz"))
    g = g.agg(F.encode(F.count("*").cast("string"), "utf-8").alias("payload"))
    return cut(objects.pack_lods(g, (64, 64, 64), (0, 0, 0)), "lods")


def _level_rows(rows):
    return rows.select("segid", "px", "py", "pz", F.decode("payload", "utf-8").alias("payload"))


@query(f"WITH {_LODS} SELECT segid, px, py, CAST(pz AS BIGINT) AS pz, payload FROM g WHERE lod = 1")
def mesh_lod_files(spark, sf_dir):
    """One level of detail of meshes in files: manifests, then the level's byte range."""
    items, path = _lods(spark, sf_dir), layers.local(fresh_path(spark, "lods"))
    objects.write_lods(items, path)
    return _level_rows(objects.read_lods(items.select("label"), path, 1))


_LOD_SPEC = Spec(0, 3, 2, "murmurhash3_x86_128")


@query(f"WITH {_LODS}, m AS (SELECT segid, max(lod) AS lod FROM g GROUP BY 1) SELECT segid, px, py, CAST(pz AS BIGINT) AS pz, payload FROM g JOIN m USING (segid, lod)")
def mesh_lod_sharded(spark, sf_dir):
    """The coarsest level of meshes in shard files; numbers without a mesh are allowed."""
    items, path = _lods(spark, sf_dir), layers.local(fresh_path(spark, "lods"))
    objects.write_lod_shards(items, path, _LOD_SPEC)
    asked = items.select("label").unionByName(spark.range(10).select((-F.col("id") - 1).alias("label")))
    return _level_rows(objects.read_lods(asked, path, -1, allow_missing=True, spec=_LOD_SPEC))


@query(f"WITH {_LODS}, o AS (SELECT segid, lod, px, py, pz, length(payload) AS size FROM g) SELECT segid, lod, count(*) AS n_fragments, CAST(sum(size) AS BIGINT) AS n_bytes FROM o GROUP BY 1, 2")
def mesh_lod_manifests(spark, sf_dir):
    """Fragments and bytes of each level, from the manifests alone."""
    path = layers.local(fresh_path(spark, "lods"))
    objects.write_lods(_lods(spark, sf_dir), path)
    return objects.lod_fragments(spark, path).groupBy("segid", "lod").agg(F.count("*").alias("n_fragments"), F.sum("size").alias("n_bytes"))


_THREADS = "t AS (SELECT l_suppkey AS segid, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS vid FROM lineitem)"


def _threads(spark, sf_dir):
    _, v = _bodies(spark, sf_dir)
    path = layers.local(fresh_path(spark, "skeletons"))
    objects.write_skeletons(v, v.where("vid >= 1").select("segid", (F.col("vid") - 1).alias("a"), F.col("vid").alias("b")), path)
    return path


@query(f"WITH {_THREADS} SELECT segid, vid - 1 AS a, vid AS b FROM t WHERE vid >= 1")
def skeleton_directory(spark, sf_dir):
    """Skeletons in a folder, one object each, read back."""
    return objects.read_skeletons(spark, _threads(spark, sf_dir))[1]


@query(f"WITH {_THREADS} SELECT DISTINCT segid FROM t")
def skeleton_list(spark, sf_dir):
    return objects.list_skeletons(spark, _threads(spark, sf_dir))


def _through_shards(items):
    spec = Spec(0, 4, 4, "murmurhash3_x86_128")
    back = sharding.shard_entries(cut(sharding.shard_files(items, spec), "shards"), spec)
    return back.select(F.col("label").cast("string").alias("name"), "payload")


@query(f"WITH {_SKEL} SELECT e.segid, count(*) AS n_edges FROM se e GROUP BY e.segid")
def skeleton_file_roundtrip(spark, sf_dir):
    return _skeletons(spark, sf_dir)[1].groupBy("segid").agg(F.count("*").alias("n_edges"))


_RENUMBERED = f"{_SKEL}, r AS (SELECT segid, vid AS old, row_number() OVER (PARTITION BY segid ORDER BY vid) - 1 AS vid, x, y, z FROM sv)"


@query(f"WITH {_RENUMBERED} SELECT segid, vid, x, y, z FROM r")
def skeleton_file_roundtrip_vertices(spark, sf_dir):
    """The vertices of the skeletons taken out of shard files, numbered from 0."""
    return _skeletons(spark, sf_dir)[0]


@query(f"WITH {_RENUMBERED} SELECT e.segid, p.vid AS a, q.vid AS b FROM se e JOIN r p ON p.segid = e.segid AND p.old = e.a JOIN r q ON q.segid = e.segid AND q.old = e.b")
def skeleton_file_roundtrip_edges(spark, sf_dir):
    """The ends of their edges."""
    return _skeletons(spark, sf_dir)[1]


def _skeletons(spark, sf_dir):
    from chunkloom.plans.object_queries import _skeleton

    return objects.decode_skeletons(_through_shards(objects.skeleton_payloads(*_skeleton(spark, sf_dir))))


@query(f"WITH {_USABLE} SELECT DISTINCT ids, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, class_label FROM a WHERE ids IS NOT NULL")
def annotation_file_roundtrip(spark, sf_dir):
    """Packed records in grid cells, those without a class too."""
    return _cells(spark, sf_dir)


def _cells(spark, sf_dir):
    """All usable annotations with an id; the smallest int32 stands for no class."""
    from chunkloom.operators import annotations

    rows = annotations.usable(table(spark, sf_dir, "annotations")).dropna(subset=["ids"])
    rows = rows.select("ids", *[c.cast("float").alias(n) for c, n in zip(annotations.point("geometry"), XYZ)], "class_label").distinct()
    path, props, nulls = layers.local(fresh_path(spark, "cells")), [("class_label", "int32")], {"class_label": -(2**31)}
    objects.write_annotation_cells(rows, path, (200_000, 200_000, 100_000), props, nulls)
    return objects.read_annotation_cells(spark, path, props, ["int"], nulls)


_LEVELS, _LIMIT = ((600_000, 600_000, 150_000), (300_000, 300_000, 75_000), (100_000, 100_000, 50_000)), 50
_PLACED = f"""{_USABLE}, p AS (SELECT DISTINCT ids, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z, (((ids % 2147483648) * 2654435761) % 4294967296) / 4294967296.0::DOUBLE AS u FROM a WHERE ids IS NOT NULL),
n0 AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM p GROUP BY floor(x / 600000), floor(y / 600000), floor(z / 150000))), f0 AS (SELECT least(1.0::DOUBLE, 50.0::DOUBLE / n) AS f FROM n0),
n1 AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM p, f0 WHERE u >= f GROUP BY floor(x / 300000), floor(y / 300000), floor(z / 75000))), f1 AS (SELECT f0.f + (1.0::DOUBLE - f0.f) * least(1.0::DOUBLE, 50.0::DOUBLE / n) AS f FROM n1, f0)"""


def _points(spark, sf_dir):
    from chunkloom.operators import annotations

    rows = annotations.usable(table(spark, sf_dir, "annotations")).dropna(subset=["ids"])
    return rows.select("ids", *[c.cast("float").cast("double").alias(n) for c, n in zip(annotations.point("geometry"), XYZ)]).distinct()


@query(f"WITH {_PLACED} SELECT ids, x, y, z, CASE WHEN u < f0.f THEN 0 WHEN u < f1.f THEN 1 ELSE 2 END AS level FROM p, f0, f1")
def annotation_levels(spark, sf_dir):
    """Points spread over the levels of a spatial index, few in each coarse cell."""
    from chunkloom.operators import annotations

    return annotations.levelled(_points(spark, sf_dir), _LEVELS, _LIMIT).select("ids", *XYZ, "level")


@query(f"WITH {_PLACED} SELECT ids, x, y, z FROM p WHERE x BETWEEN 200000 AND 700000 AND y BETWEEN 200000 AND 900000 AND z BETWEEN 10000 AND 90000")
def annotation_levels_by_box(spark, sf_dir):
    """Points of a box from files of all levels; only cells that the box touches are read."""
    path = layers.local(fresh_path(spark, "levels"))
    objects.write_annotation_levels(_points(spark, sf_dir), path, _LEVELS, _LIMIT, [])
    got = objects.read_annotation_levels(spark, path, _LEVELS, [], [], ((200000, 200000, 10000), (700000, 900000, 90000)))
    return got.select("ids", *[F.col(c).cast("double").alias(c) for c in XYZ])


def _plain():
    """A tile's name without the suffix of its compression."""
    return F.regexp_replace("filename", r"\.(gz|br|zstd)$", "")


def _tiles(spark, sf_dir):
    """Every located tile, however few its labels, packed into shard files and taken out."""
    i = spatial.located(table(spark, sf_dir, "file_lookup"), table(spark, sf_dir, "index_files")).withColumn("filename", _plain())
    return objects.decode_spatial_index(_through_shards(objects.spatial_payloads(i)))


@query(f"WITH {_INDEX} SELECT regexp_replace(filename, '\\.(gz|br|zstd)$', '') AS filename, label, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, min(z0) AS z0, max(z1) AS z1 FROM i GROUP BY ALL")
def spatial_index_file_roundtrip(spark, sf_dir):
    """The entries of all JSON tiles, packed into shard files and read back."""
    return _tiles(spark, sf_dir)


@query(f"WITH {V}, m AS (SELECT z, min(val) AS lo, max(val) AS hi FROM v GROUP BY z) SELECT x, y, z, CAST(CASE WHEN hi = lo THEN 0 ELSE floor((val - lo) / (hi - lo) * 255) END AS INTEGER) AS gray FROM v JOIN m USING (z)")
def normalized_slices(spark, sf_dir):
    """Gray values of image slices, each stretched between its own extremes."""
    v = volume(spark, sf_dir).voxels
    m = v.groupBy("z").agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    gray = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.floor((F.col("val") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255))
    return v.join(m, "z").select(*XYZ, gray.cast("int").alias("gray"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_window_counts(spark, sf_dir):
    """Hourly counts and sums of a stream of events."""
    source = f"{sf_dir}/events.parquet"
    schema = table(spark, sf_dir, "events").schema
    shape = lambda s: ingest.window_counts(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "1 hour")
    out = ingest.run_available(spark, source, schema, shape)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT file_id FROM chunk_files WHERE file_id IS NOT NULL AND listed_at IS NOT NULL")
def stream_first_deliveries(spark, sf_dir):
    """Listings of a stream, each file once even if listed months late."""
    source = f"{sf_dir}/chunk_files.parquet"
    schema = table(spark, sf_dir, "chunk_files").schema
    shape = lambda s: ingest.first_deliveries(s.where("file_id is not null and listed_at is not null").select("file_id", F.col("listed_at").cast("timestamp").alias("listed_at")), ["file_id"], "listed_at", "3650 days")
    return ingest.run_available(spark, source, schema, shape, mode="append").select("file_id").distinct()


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf_dir):
    """Runs of a user's events without a pause of half an hour."""
    schema = table(spark, sf_dir, "events").schema
    shape = lambda s: ingest.sessions(s.where("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "30 minutes")
    out = ingest.run_available(spark, f"{sf_dir}/events.parquet", schema, shape)
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n_events")
