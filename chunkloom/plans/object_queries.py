"""Queries on indexes, annotations, label hierarchies, meshes, skeletons and metadata.

Embeddings: the hierarchy is lineitem order (layer 1) to customer (2) to nation (3) to
region (4), with labels ``layer << 56 | key + 1``; meshes and skeletons take an order's
lines as vertices (l_partkey, l_suppkey, l_quantity), the return flag as fragment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.functions import labels as L
from chunkloom.functions.boxes import AXES
from chunkloom.operators import annotations, graph, mesh, spatial
from chunkloom.session import cut, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- spatial index -----------------------------------------------------------

_NAME = r"^(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)\.spatial(\.gz|\.br|\.zstd)?$"
_INDEX = f"""f AS (SELECT DISTINCT id AS fid, filename, CAST(b.x0 AS BIGINT) x0, CAST(b.x1 AS BIGINT) x1, CAST(b.y0 AS BIGINT) y0, CAST(b.y1 AS BIGINT) y1, CAST(b.z0 AS BIGINT) z0, CAST(b.z1 AS BIGINT) z1
 FROM (SELECT id, filename, regexp_extract(filename, '{_NAME}', ['x0','x1','y0','y1','z0','z1']) b FROM index_files WHERE id IS NOT NULL AND regexp_matches(filename, '{_NAME}'))),
e AS (SELECT DISTINCT label, fid FROM file_lookup WHERE label IS NOT NULL AND fid IS NOT NULL), i AS (SELECT * FROM e JOIN f USING (fid))"""
_QBOX = ((200000, 200000, 20000), (420000, 500000, 70000))
_HIT = " AND ".join(f"{d}0 < {b} AND {d}1 > {a}" for d, a, b in zip(AXES, *_QBOX))


def _index(spark, sf_dir) -> DataFrame:
    return spatial.located(table(spark, sf_dir, "file_lookup"), table(spark, sf_dir, "index_files"))


@query(f"WITH {_INDEX} SELECT label, fid, filename FROM i")
def index_entries(spark, sf_dir):
    return _index(spark, sf_dir).select("label", "fid", "filename")


@query(f"WITH {_INDEX} SELECT DISTINCT label FROM i WHERE {_HIT}")
def spatial_query(spark, sf_dir):
    return spatial.labels_in(_index(spark, sf_dir), _QBOX)


@query(f"WITH {_INDEX} SELECT label, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, min(z0) AS z0, max(z1) AS z1 FROM i GROUP BY label")
def spatial_get_bbox(spark, sf_dir):
    return spatial.hulls(_index(spark, sf_dir))


@query(f"WITH {_INDEX} SELECT DISTINCT label, filename FROM i")
def label_file_locations(spark, sf_dir):
    return spatial.files_of(_index(spark, sf_dir))


@query(f"WITH {_INDEX}, s AS (SELECT DISTINCT label FROM e JOIN (SELECT fid FROM f WHERE {_HIT}) USING (fid)) SELECT DISTINCT label, filename FROM i SEMI JOIN s USING (label)")
def label_file_locations_some(spark, sf_dir):
    """Files of the labels found in a box."""
    i = _index(spark, sf_dir)
    return spatial.files_of(i, spatial.labels_in(i, _QBOX))


@query("SELECT DISTINCT label FROM file_lookup WHERE label IS NOT NULL")
def distinct_labels(spark, sf_dir):
    return table(spark, sf_dir, "file_lookup").select("label").dropna().distinct()


@query("WITH f AS (SELECT DISTINCT id FROM index_files WHERE id IS NOT NULL) SELECT fid, count(*) AS n_rows FROM file_lookup ANTI JOIN f ON fid = id WHERE fid IS NOT NULL GROUP BY fid")
def index_gaps(spark, sf_dir):
    """References to index files that are not there."""
    f = table(spark, sf_dir, "index_files").select(F.col("id").alias("fid"))
    lost = table(spark, sf_dir, "file_lookup").where("fid is not null").groupBy("fid").agg(F.count("*").alias("n_rows"))
    return lost.join(f, "fid", "left_anti")


@query("SELECT label, fid, count(*) AS n_rows FROM file_lookup WHERE label IS NOT NULL AND fid IS NOT NULL GROUP BY label, fid HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    """Entries loaded more than once."""
    return table(spark, sf_dir, "file_lookup").dropna(subset=["label", "fid"]).groupBy("label", "fid").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


@query("WITH f AS (SELECT DISTINCT id, filename, n_bytes FROM index_files) SELECT regexp_extract(filename, '\\.spatial(\\.(gz|br|zstd))?$', 2) AS compression, count(*) AS n_files, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM f GROUP BY 1")
def index_sizes(spark, sf_dir):
    f = table(spark, sf_dir, "index_files").select("id", "filename", "n_bytes").distinct()
    return f.groupBy(F.regexp_extract("filename", r"\.spatial(\.(gz|br|zstd))?$", 2).alias("compression")).agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


# --- annotations --------------------------------------------------------------

_USABLE = "a AS (SELECT DISTINCT ids, geometry[1]::DOUBLE AS x, geometry[2]::DOUBLE AS y, geometry[3]::DOUBLE AS z, class_label FROM annotations WHERE len(geometry) = 3 AND isfinite(geometry[1]) AND isfinite(geometry[2]) AND isfinite(geometry[3]))"
_ABOX = ((200000, 200000, 10000), (700000, 900000, 90000))
_AIN = " AND ".join(f"{d} BETWEEN {a} AND {b}" for d, a, b in zip(AXES, *_ABOX))


def _annotations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "annotations")


@query("SELECT DISTINCT ids FROM annotations WHERE ids IS NOT NULL")
def annotation_ids(spark, sf_dir):
    return _annotations(spark, sf_dir).select("ids").dropna().distinct()


@query(f"WITH {_USABLE} SELECT DISTINCT ids, x, y, z FROM a WHERE {_AIN}")
def annotations_by_box(spark, sf_dir):
    rows = annotations.by_box(_annotations(spark, sf_dir), _ABOX)
    return rows.select("ids", *[c.alias(n) for c, n in zip(annotations.point("geometry"), "xyz")]).distinct()


@query("WITH w AS (SELECT DISTINCT ids FROM annotations WHERE class_label = 3) SELECT DISTINCT ids, class_label, created_at FROM annotations SEMI JOIN w USING (ids)")
def annotations_by_id(spark, sf_dir):
    a = _annotations(spark, sf_dir)
    return annotations.by_ids(a, a.where("class_label = 3").select("ids")).select("ids", "class_label", "created_at").distinct()


@query("SELECT DISTINCT ids, unnest(skeleton_id) AS related_id FROM annotations WHERE ids IS NOT NULL")
def annotation_relationships(spark, sf_dir):
    return annotations.relationships(_annotations(spark, sf_dir), "skeleton_id")


@query("SELECT DISTINCT ids, unnest(skeleton_id) AS related_id FROM annotations WHERE ids IS NOT NULL AND len(skeleton_id) > 0")
def annotations_by_relationship(spark, sf_dir):
    """The lookup for every object, however few its annotations."""
    a = _annotations(spark, sf_dir)
    return annotations.by_relationship(a, "skeleton_id", annotations.relationships(a, "skeleton_id").select("related_id"))


@query(f"WITH {_USABLE}, c AS (SELECT DISTINCT class_label, label_name FROM class_labels) SELECT DISTINCT ids, x, y, z, label_name FROM a LEFT JOIN c USING (class_label)")
def annotation_table(spark, sf_dir):
    """Coordinates as columns, enum codes as names."""
    return annotations.flat(_annotations(spark, sf_dir), table(spark, sf_dir, "class_labels"), "class_label", "label_name")


@query(f"WITH {_USABLE}, c AS (SELECT DISTINCT class_label, label_name FROM class_labels) SELECT label_name, count(DISTINCT ids) AS n_ids FROM a LEFT JOIN c USING (class_label) GROUP BY label_name")
def annotation_counts(spark, sf_dir):
    t = annotations.flat(_annotations(spark, sf_dir), table(spark, sf_dir, "class_labels"), "class_label", "label_name")
    return t.select("label_name", "ids").distinct().groupBy("label_name").agg(F.count("ids").alias("n_ids"))


_CROP = ((200000, 200000, 10000), (700000, 900000, 90000))


def _crop_sql(kind: str) -> str:
    first = " AND ".join(f"{d}0 BETWEEN {a} AND {b}" for d, a, b in zip(AXES, *_CROP))
    second = " AND ".join(f"{d}1 BETWEEN {a} AND {b}" for d, a, b in zip(AXES, *_CROP))
    around = " AND ".join(f"least({d}0, {d}1) <= {a} AND greatest({d}0, {d}1) >= {b}" for d, a, b in zip(AXES, *_CROP))
    test = {"ELLIPSOID": first, "LINE": f"({first}) OR ({second})", "AXIS_ALIGNED_BOUNDING_BOX": f"({first}) OR ({second}) OR ({around})"}[kind]
    return f"SELECT DISTINCT roi_id FROM rois WHERE x0 + x1 + y0 + y1 + z0 + z1 IS NOT NULL AND ({test})"


def _crop(spark, sf_dir, kind: str) -> DataFrame:
    r = table(spark, sf_dir, "rois").select("roi_id", F.array(*[F.col(f"{d}{e}").cast("float") for e in "01" for d in AXES]).alias("geometry"))
    return annotations.by_box(r.where("not exists(geometry, v -> v is null)"), _CROP, kind).select("roi_id").distinct()


@query(_crop_sql("LINE"))
def crop_lines(spark, sf_dir):
    return _crop(spark, sf_dir, "LINE")


@query(_crop_sql("AXIS_ALIGNED_BOUNDING_BOX"))
def crop_boxes(spark, sf_dir):
    return _crop(spark, sf_dir, "AXIS_ALIGNED_BOUNDING_BOX")


@query(_crop_sql("ELLIPSOID"))
def crop_ellipsoids(spark, sf_dir):
    return _crop(spark, sf_dir, "ELLIPSOID")


# --- label hierarchy -----------------------------------------------------------

BITS = L.LabelBits(8, {1: 10, 2: 10, 3: 9, 4: 8})
_ONE = 1 << 56
_EDGES = f"""edges AS (SELECT {_ONE} + o_orderkey + 1 AS child, {2 * _ONE} + o_custkey + 1 AS parent, o_orderdate AS valid_from FROM orders
 UNION ALL SELECT {2 * _ONE} + c_custkey + 1, {3 * _ONE} + c_nationkey + 1, NULL FROM customer UNION ALL SELECT {3 * _ONE} + n_nationkey + 1, {4 * _ONE} + n_regionkey + 1, NULL FROM nation)"""


def _id(layer: int, key: str):
    return (F.lit(layer * _ONE).cast("bigint") + F.col(key).cast("bigint") + 1)


def _edges(spark, sf_dir) -> DataFrame:
    none = F.lit(None).cast("timestamp_ntz")
    o = table(spark, sf_dir, "orders").select(_id(1, "o_orderkey").alias("child"), _id(2, "o_custkey").alias("parent"), F.col("o_orderdate").cast("timestamp_ntz").alias("valid_from"))
    c = table(spark, sf_dir, "customer").select(_id(2, "c_custkey").alias("child"), _id(3, "c_nationkey").alias("parent"), none.alias("valid_from"))
    n = table(spark, sf_dir, "nation").select(_id(3, "n_nationkey").alias("child"), _id(4, "n_regionkey").alias("parent"), none.alias("valid_from"))
    return o.unionByName(c).unionByName(n)


_LEAF = f"leaf AS (SELECT DISTINCT {_ONE} + o_orderkey + 1 AS label FROM orders UNION SELECT 0)"


def _ids(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(_id(1, "o_orderkey").alias("label")).unionByName(spark.createDataFrame([(0,)], "label bigint"))


def _roots_sql(stop: int) -> str:
    hops = "".join(f" LEFT JOIN edges e{k} ON e{k}.child = e{k - 1}.parent" if k > 1 else " LEFT JOIN edges e1 ON e1.child = label" for k in range(1, stop))
    return f"WITH {_EDGES}, {_LEAF} SELECT label, coalesce({', '.join([f'e{k}.parent' for k in range(stop - 1, 0, -1)] + ['label'])}) AS root FROM leaf{hops}"


@query(_roots_sql(4))
def get_roots(spark, sf_dir):
    return graph.roots(_ids(spark, sf_dir), _edges(spark, sf_dir), BITS, 4, 4)


@query(_roots_sql(3))
def get_roots_stop_layer(spark, sf_dir):
    return graph.roots(_ids(spark, sf_dir), _edges(spark, sf_dir), BITS, 3, 4)


@query(f"WITH {_EDGES} SELECT DISTINCT r.parent AS root, o.child AS leaf FROM edges o JOIN edges c ON c.child = o.parent JOIN edges r ON r.child = c.parent WHERE o.child < {2 * _ONE}")
def get_leaves(spark, sf_dir):
    tops = table(spark, sf_dir, "region").select(_id(4, "r_regionkey").alias("root"))
    return graph.leaves(tops, _edges(spark, sf_dir), BITS, 1, 4)


@query(f"WITH {_EDGES}, v AS (SELECT l_partkey AS x, l_suppkey AS y, min(l_orderkey) AS o FROM lineitem WHERE l_partkey BETWEEN 10 AND 150 GROUP BY 1, 2) SELECT DISTINCT c.parent AS root FROM v JOIN edges o ON o.child = {_ONE} + v.o + 1 JOIN edges c ON c.child = o.parent")
def agglomerate_unique(spark, sf_dir):
    """Distinct roots of the labels in a box: distinct first, then resolved."""
    v = table(spark, sf_dir, "lineitem").where("l_partkey between 10 and 150").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("o"))
    found = graph.roots(v.select(_id(1, "o").alias("label")).distinct(), _edges(spark, sf_dir), BITS, 3, 4)
    return found.select("root").distinct()


@query(f"WITH {_EDGES}, v AS (SELECT l_partkey AS x, l_suppkey AS y, l_linenumber AS z, min({_ONE} + l_orderkey + 1) AS label FROM lineitem GROUP BY 1, 2, 3) SELECT x, y, z, label, c.parent AS root FROM v JOIN edges o ON o.child = label JOIN edges c ON c.child = o.parent")
def agglomerate_cutout(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_linenumber").alias("z")).agg(F.min(_id(1, "l_orderkey")).alias("label"))
    return graph.with_roots(v, graph.roots(v, _edges(spark, sf_dir), BITS, 3, 4))


_TIMED = f"""o AS (SELECT {_ONE} + o_orderkey + 1 AS child, {2 * _ONE} + o_custkey + 1 AS parent FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-17 00:00:00'),
c AS (SELECT {2 * _ONE} + c_custkey + 1 AS child, {3 * _ONE} + c_nationkey + 1 AS parent FROM customer), n AS (SELECT {3 * _ONE} + n_nationkey + 1 AS child, {4 * _ONE} + n_regionkey + 1 AS parent FROM nation)"""


def _timed(spark, sf_dir) -> DataFrame:
    return _edges(spark, sf_dir).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))


@query(f"WITH {_TIMED}, leaf AS (SELECT DISTINCT {_ONE} + o_orderkey + 1 AS label FROM orders UNION SELECT 0) SELECT label, coalesce(n.parent, c.parent, o.parent, label) AS root FROM leaf LEFT JOIN o ON o.child = label LEFT JOIN c ON c.child = o.parent LEFT JOIN n ON n.child = c.parent")
def get_roots_at(spark, sf_dir):
    """Roots as of a time: over the edges that held then, layer by layer."""
    return graph.roots_at(_ids(spark, sf_dir), _timed(spark, sf_dir), BITS, 4, 4, F.to_timestamp_ntz(F.lit(_WHEN)))


@query(f"WITH {_TIMED}, v AS (SELECT l_partkey AS x, l_suppkey AS y, CAST(l_linenumber AS BIGINT) AS z, min({_ONE} + l_orderkey + 1) AS label FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS x, CAST(hour(ts) AS BIGINT) AS y, CAST(day(ts) % 7 + 1 AS BIGINT) AS z FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
    " SELECT x, y, z, coalesce(label, 0) AS label, coalesce(c.parent, o.parent, label, 0) AS root FROM p LEFT JOIN v USING (x, y, z) LEFT JOIN o ON o.child = label LEFT JOIN c ON c.child = o.parent")
def scattered_roots(spark, sf_dir):
    """Points to their labels, those to their roots as of a time: only labels that occur are resolved."""
    from chunkloom.plans.volume_queries import _event_points, volume

    v = volume(spark, sf_dir)
    big = v.voxels.select("x", "y", "z", (F.col("label") + _ONE).alias("label"))
    found = cut(type(v)(big, v.bounds, v.chunk).at_points(_event_points(spark, sf_dir)), "points")
    return graph.with_roots(found, graph.roots_at(found, _timed(spark, sf_dir), BITS, 3, 4, F.to_timestamp_ntz(F.lit(_WHEN))))


_LABEL2 = "(2::BIGINT << 56) | ((l_partkey & 1023) << 46) | ((l_suppkey & 1023) << 36) | (l_linenumber::BIGINT << 26) | (l_orderkey & 67108863)"
_LABEL3 = "(3::BIGINT << 56) | ((l_partkey & 511) << 47) | ((l_suppkey & 511) << 38) | (l_linenumber::BIGINT << 29) | (l_orderkey & 67108863)"


def _packed(spark, sf_dir, layer: int) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    m = {2: 1023, 3: 511}[layer]
    label = BITS.encode(F.lit(layer), [F.col("l_partkey").bitwiseAND(m), F.col("l_suppkey").bitwiseAND(m), F.col("l_linenumber").cast("bigint")], F.expr("l_orderkey & 67108863L"))
    return t.select("l_orderkey", "l_linenumber", label.alias("label"))


@query(f"SELECT l_orderkey, l_linenumber, ({_LABEL2}) AS label, (({_LABEL2}) & 72057594037927935) >> 26 AS chunk_number FROM lineitem")
def graph_chunk_number(spark, sf_dir):
    """Packed chunk positions of labels."""
    return _packed(spark, sf_dir, 2).withColumn("chunk_number", graph.chunk_number(F.col("label"), BITS))


@query(f"SELECT DISTINCT ({_LABEL3}) AS label, concat({_LABEL3}, ':0:', (l_partkey & 511) * 1024, '-', (l_partkey & 511) * 1024 + 1024, '_', (l_suppkey & 511) * 1024, '-', (l_suppkey & 511) * 1024 + 1024, '_', l_linenumber * 128, '-', l_linenumber * 128 + 128) AS mesh_name, (({_LABEL3}) >> 1) & 7 AS minishard, concat((({_LABEL3}) & 72057594037927935) >> 29, '-', lower(to_hex((({_LABEL3}) >> 4) & 15)), '.shard') AS shard_file FROM lineitem")
def graph_mesh_names(spark, sf_dir):
    """Mesh objects and shard files of labels, both kept by chunk."""
    from chunkloom.operators.sharding import Spec

    minishard, name = graph.mesh_shard(F.col("label"), BITS, Spec(1, 3, 4))
    return _packed(spark, sf_dir, 3).select("label", graph.mesh_name(F.col("label"), BITS, (512, 512, 64)).alias("mesh_name"), minishard.alias("minishard"), name.alias("shard_file")).distinct()


@query("WITH p AS (SELECT DISTINCT ids, geometry[1]::DOUBLE x, geometry[2]::DOUBLE y, geometry[3]::DOUBLE z FROM annotations WHERE len(geometry) = 3 AND isfinite(geometry[1]) AND isfinite(geometry[2]) AND isfinite(geometry[3]) AND ids IS NOT NULL), "
    "c AS (SELECT ids, x, y, z, CAST(floor((x / 8.0 - 100) / 512) AS BIGINT) AS cx, CAST(floor((y / 8.0 - 200) / 512) AS BIGINT) AS cy, CAST(floor((z / 40.0 - 30) / 64) AS BIGINT) AS cz FROM p) SELECT DISTINCT ids, cx, cy, cz, cx * 512 + 100 AS x0, cx * 512 + 612 AS x1, cy * 512 + 200 AS y0, cy * 512 + 712 AS y1, cz * 64 + 30 AS z0, cz * 64 + 94 AS z1 FROM c")
def graph_point_chunks(spark, sf_dir):
    """Graph chunks of points in nm, and their boxes in voxels of 8 x 8 x 40 nm."""
    p = annotations.usable(table(spark, sf_dir, "annotations")).dropna(subset=["ids"])
    where = (annotations.point("geometry"), (8, 8, 40), (512, 512, 64), (100, 200, 30))
    return p.select("ids", *[c.alias(f"c{d}") for c, d in zip(graph.chunk_of_point(*where), AXES)], *graph.chunk_box_of_point(*where).columns()).distinct()


@query("WITH i AS (SELECT DISTINCT o_custkey AS label, 'initial' AS origin FROM orders), d AS (SELECT DISTINCT c_custkey AS label, 'dynamic' AS origin FROM customer WHERE c_nationkey < 8) SELECT * FROM d UNION ALL SELECT * FROM i ANTI JOIN d USING (label)")
def graph_newest_meshes(spark, sf_dir):
    """Meshes of both tables, the dynamic one of a label that is in both."""
    i = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("label"), F.lit("initial").alias("origin")).distinct()
    d = table(spark, sf_dir, "customer").where("c_nationkey < 8").select(F.col("c_custkey").alias("label"), F.lit("dynamic").alias("origin")).distinct()
    return graph.newest_meshes(i, d)


_WHEN = "1995-06-17 00:00:00"


@query(f"SELECT o_custkey AS child, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS parent FROM orders WHERE o_orderdate <= TIMESTAMP '{_WHEN}' GROUP BY o_custkey")
def roots_asof(spark, sf_dir):
    """The relation set last at or before a time."""
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("child"), F.col("o_orderkey").alias("parent"), F.col("o_orderdate").cast("timestamp_ntz").alias("valid_from"))
    return graph.latest_before(e, F.to_timestamp_ntz(F.lit(_WHEN)))


@query(f"WITH e AS (SELECT o_custkey AS child, o_orderkey AS parent, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders) SELECT child, parent FROM e WHERE valid_from <= TIMESTAMP '{_WHEN}' AND (valid_to IS NULL OR TIMESTAMP '{_WHEN}' < valid_to)")
def edges_valid_at(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("child"), F.col("o_orderkey").alias("parent"), F.col("o_orderdate").cast("timestamp_ntz").alias("valid_from"))
    e = e.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("child").orderBy("valid_from", "parent")))
    return graph.valid_at(e, F.to_timestamp_ntz(F.lit(_WHEN))).select("child", "parent")


@query(f"WITH {_EDGES} SELECT parent, count(*) AS n_children, min(child) AS first_child, max(child) AS last_child FROM edges GROUP BY parent")
def chunk_mappings(spark, sf_dir):
    return graph.children_per_parent(_edges(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, CAST(2 AS BIGINT) AS layer, l_partkey % 1024 AS x, l_suppkey % 1024 AS y, CAST(l_linenumber AS BIGINT) AS z, l_orderkey & 67108863 AS segment, (2::BIGINT << 56) | ((l_partkey & 1023) << 46) | ((l_suppkey & 1023) << 36) | (l_linenumber::BIGINT << 26) | (l_orderkey & 67108863) AS label FROM lineitem")
def graph_labels(spark, sf_dir):
    """Labels packed and taken apart again."""
    t = table(spark, sf_dir, "lineitem")
    label = BITS.encode(F.lit(2), [F.col("l_partkey") % 1024, F.col("l_suppkey") % 1024, F.col("l_linenumber")], F.expr("l_orderkey & 67108863L"))
    packed = t.select("l_orderkey", "l_linenumber", label.alias("label"))
    return packed.select("l_orderkey", "l_linenumber", *[c.cast("bigint").alias(n) for c, n in zip(BITS.decode(F.col("label")), ("layer", "x", "y", "z", "segment"))], "label")


# --- meshes ----------------------------------------------------------------------

_MESH = """w AS (SELECT l_orderkey AS segid, l_returnflag AS frag, l_partkey, l_suppkey, l_quantity, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS vid FROM lineitem),
ver AS (SELECT segid, frag, vid, CAST(l_partkey % 8 AS DOUBLE) AS x, CAST(l_suppkey % 4 AS DOUBLE) AS y, CAST(l_linenumber % 2 AS DOUBLE) AS z FROM w),
cnt AS (SELECT segid, frag, max(vid) + 1 AS n FROM ver GROUP BY 1, 2), fac AS (SELECT segid, frag, vid AS v1, vid + 1 AS v2, vid + 2 AS v3 FROM ver JOIN cnt USING (segid, frag) WHERE vid + 2 < n),
sh AS (SELECT segid, frag, CAST(coalesce(sum(n) OVER (PARTITION BY segid ORDER BY frag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM cnt),
cv AS (SELECT segid, vid + s AS vid, x, y, z FROM ver JOIN sh USING (segid, frag)), cf AS (SELECT segid, v1 + s AS v1, v2 + s AS v2, v3 + s AS v3 FROM fac JOIN sh USING (segid, frag))"""


def _mesh(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = t.withColumn("vid", (F.row_number().over(w) - 1).cast("bigint"))
    v = rows.select(F.col("l_orderkey").alias("segid"), F.col("l_returnflag").alias("frag"), "vid", (F.col("l_partkey") % 8).cast("double").alias("x"), (F.col("l_suppkey") % 4).cast("double").alias("y"), (F.col("l_linenumber") % 2).cast("double").alias("z"))
    v = cut(v, "vertices")
    n = v.groupBy("segid", "frag").agg((F.max("vid") + 1).alias("n"))
    f = v.join(n, ["segid", "frag"]).where("vid + 2 < n").select("segid", "frag", F.col("vid").alias("v1"), (F.col("vid") + 1).alias("v2"), (F.col("vid") + 2).alias("v3"))
    return v, f


@query(f"WITH {_MESH} SELECT segid, vid, x, y, z FROM cv")
def mesh_vertices(spark, sf_dir):
    return mesh.concatenate(*_mesh(spark, sf_dir))[0]


@query(f"WITH {_MESH} SELECT segid, v1, v2, v3 FROM cf")
def mesh_concatenate(spark, sf_dir):
    return mesh.concatenate(*_mesh(spark, sf_dir))[1]


_CONS = "dr AS (SELECT segid, vid, x, y, z, dense_rank() OVER (PARTITION BY segid ORDER BY x, y, z) - 1 AS nv FROM cv)"


@query(f"WITH {_MESH}, {_CONS} SELECT DISTINCT segid, nv AS vid, x, y, z FROM dr")
def mesh_consolidate(spark, sf_dir):
    return mesh.consolidate(*mesh.concatenate(*_mesh(spark, sf_dir)))[0]


@query(f"WITH {_MESH}, {_CONS} SELECT DISTINCT f.segid, a.nv AS v1, b.nv AS v2, c.nv AS v3 FROM cf f JOIN dr a ON a.segid = f.segid AND a.vid = v1 JOIN dr b ON b.segid = f.segid AND b.vid = v2 JOIN dr c ON c.segid = f.segid AND c.vid = v3")
def mesh_consolidate_faces(spark, sf_dir):
    return mesh.consolidate(*mesh.concatenate(*_mesh(spark, sf_dir)))[1]


@query(f"WITH {_MESH} SELECT segid, vid, CASE WHEN count(*) OVER p = 2 AND (x % 4 = 0 OR y % 2 = 0 OR z % 2 = 0) THEN min(vid) OVER p ELSE vid END AS kept_vid FROM cv WINDOW p AS (PARTITION BY segid, x, y, z)")
def mesh_merge_doubled(spark, sf_dir):
    """Vertices found exactly twice on a chunk boundary become one."""
    return mesh.merge_doubled(mesh.concatenate(*_mesh(spark, sf_dir))[0], mesh.on_boundary((4, 2, 2)))


_MIN = "x BETWEEN 1 AND 6 AND y BETWEEN 0 AND 2 AND z BETWEEN 0 AND 1"


@query(f"WITH {_MESH}, k AS (SELECT segid, vid, row_number() OVER (PARTITION BY segid ORDER BY vid) - 1 AS nv FROM cv WHERE {_MIN}) SELECT f.segid, a.nv AS v1, b.nv AS v2, c.nv AS v3 FROM cf f JOIN k a ON a.segid = f.segid AND a.vid = v1 JOIN k b ON b.segid = f.segid AND b.vid = v2 JOIN k c ON c.segid = f.segid AND c.vid = v3")
def mesh_crop(spark, sf_dir):
    return mesh.crop(*mesh.concatenate(*_mesh(spark, sf_dir)), ((1, 0, 0), (6, 2, 1)))[1]


@query(f"WITH {_MESH} SELECT segid, least(v1, v2) AS a, greatest(v1, v2) AS b FROM cf UNION ALL SELECT segid, least(v2, v3), greatest(v2, v3) FROM cf UNION ALL SELECT segid, least(v1, v3), greatest(v1, v3) FROM cf")
def mesh_edges(spark, sf_dir):
    return mesh.face_edges(mesh.concatenate(*_mesh(spark, sf_dir))[1])


@query(f"WITH {_MESH} SELECT segid, 0 AS section, vid AS n, printf('v %.5f %.5f %.5f', x, y, z) AS line FROM cv UNION ALL SELECT segid, 1, row_number() OVER (PARTITION BY segid ORDER BY v1, v2, v3) - 1, printf('f %d %d %d', v1 + 1, v2 + 1, v3 + 1) FROM (SELECT DISTINCT * FROM cf)")
def mesh_obj(spark, sf_dir):
    return mesh.obj_lines(*mesh.concatenate(*_mesh(spark, sf_dir)))


@query("SELECT l_orderkey, l_linenumber, round(10.0 + (1 + l_partkey % 1024 / 1023.0::DOUBLE) * 64 * 2, 9) AS x, round(20.0 + (2 + l_suppkey % 1024 / 1023.0::DOUBLE) * 64 * 2, 9) AS y, round(30.0 + (3 + l_linenumber % 1024 / 1023.0::DOUBLE) * 32 * 2, 9) AS z FROM lineitem")
def lod_dequantize(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    xyz = mesh.dequantize([F.lit(1), F.lit(2), F.lit(3)], F.lit(1), 10, (64, 64, 32), (10, 20, 30), [F.col(c) % 1024 for c in ("l_partkey", "l_suppkey", "l_linenumber")])
    return t.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(n) for c, n in zip(xyz, "xyz")])


@query("SELECT l_orderkey, l_linenumber, l_partkey * 8.0::DOUBLE + l_suppkey * 0.5 + 100 AS x, l_partkey * 0.25::DOUBLE + l_suppkey * 8 - 50 AS y, l_linenumber * 40.0::DOUBLE AS z FROM lineitem")
def affine_transform(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    xyz = mesh.affine([[8, 0.5, 0, 100], [0.25, 8, 0, -50], [0, 0, 40, 0]], [F.col(c).cast("double") for c in ("l_partkey", "l_suppkey", "l_linenumber")])
    return t.select("l_orderkey", "l_linenumber", *[c.alias(n) for c, n in zip(xyz, "xyz")])


@query(f"WITH {_MESH}, o AS (SELECT segid, frag, n, CAST(coalesce(sum(n) OVER (PARTITION BY segid ORDER BY frag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_byte FROM cnt) SELECT segid, frag, n AS size, first_byte FROM o")
def fragment_offsets(spark, sf_dir):
    """Prefix sums of fragment sizes."""
    v, _ = _mesh(spark, sf_dir)
    n = v.groupBy("segid", "frag").agg((F.max("vid") + 1).alias("size"))
    w = Window.partitionBy("segid").orderBy("frag").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("first_byte", F.coalesce(F.sum("size").over(w), F.lit(0)))


# --- skeletons ------------------------------------------------------------------

_SKEL = """sv AS (SELECT l_orderkey AS segid, l_linenumber::BIGINT AS vid, min(CAST(l_partkey AS DOUBLE)) AS x, min(CAST(l_suppkey AS DOUBLE)) AS y, min(l_quantity) AS z, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
se AS (SELECT a.segid, a.vid AS a, b.vid AS b FROM sv a JOIN sv b ON a.segid = b.segid AND b.vid = a.vid + 1 AND a.flag = b.flag)"""


def _skeleton(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "lineitem")
    v = t.groupBy(F.col("l_orderkey").alias("segid"), F.col("l_linenumber").cast("bigint").alias("vid")).agg(F.min(F.col("l_partkey").cast("double")).alias("x"), F.min(F.col("l_suppkey").cast("double")).alias("y"), F.min("l_quantity").alias("z"), F.min("l_returnflag").alias("flag"))
    v = cut(v, "skeleton")
    b = v.select("segid", F.col("vid").alias("b"), (F.col("vid") - 1).alias("a"), "flag")
    e = b.join(v.select("segid", F.col("vid").alias("a"), "flag"), ["segid", "a", "flag"]).select("segid", "a", "b")
    return v.drop("flag"), e


@query(f"WITH {_SKEL} SELECT e.segid, round(sum(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2))), 6) AS cable_length FROM se e JOIN sv p ON p.segid = e.segid AND p.vid = e.a JOIN sv q ON q.segid = e.segid AND q.vid = e.b GROUP BY e.segid")
def skeleton_cable_length(spark, sf_dir):
    return mesh.cable_length(*_skeleton(spark, sf_dir)).withColumn("cable_length", F.round("cable_length", 6))


@query(f"WITH {_SKEL}, m AS (SELECT v.segid, v.vid, CASE WHEN e.a IS NULL THEN v.vid END AS start FROM sv v LEFT JOIN se e ON e.segid = v.segid AND e.b = v.vid) SELECT segid, vid, max(start) OVER (PARTITION BY segid ORDER BY vid) AS component FROM m")
def skeleton_components(spark, sf_dir):
    return mesh.components(*_skeleton(spark, sf_dir))


@query(f"WITH {_SKEL}, d AS (SELECT segid, a AS vid FROM se UNION ALL SELECT segid, b FROM se) SELECT segid, vid, count(*) AS degree FROM d GROUP BY 1, 2")
def skeleton_degrees(spark, sf_dir):
    return mesh.degrees(_skeleton(spark, sf_dir)[1])


@query(f"WITH {_SKEL} SELECT segid, vid, x, y, z FROM sv v WHERE EXISTS (SELECT 1 FROM se e WHERE e.segid = v.segid AND (e.a = v.vid OR e.b = v.vid))")
def skeleton_connected(spark, sf_dir):
    """Without vertices that no edge touches."""
    return mesh.connected_vertices(*_skeleton(spark, sf_dir))


# Skeletons here are runs of neighbouring lines, so a path is a run and its begin the first line.
_RUNS = f"""{_SKEL}, m AS (SELECT v.*, CASE WHEN e.a IS NULL THEN v.vid END AS start FROM sv v LEFT JOIN se e ON e.segid = v.segid AND e.b = v.vid), c AS (SELECT segid, vid, x, y, z, max(start) OVER (PARTITION BY segid ORDER BY vid) AS start FROM m),
run AS (SELECT *, vid - start AS pos, max(vid) OVER (PARTITION BY segid, start) - start AS length FROM c), path AS (SELECT * FROM run WHERE length > 0)"""


@query(f"WITH {_RUNS} SELECT segid, start, start + 1 AS first, vid, pos, length FROM path")
def skeleton_paths(spark, sf_dir):
    """Vertices by their place along the paths between ends and joints."""
    return mesh.path_positions(*_skeleton(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT segid, vid, x, y, z FROM path WHERE pos % 2 = 0 OR pos = length")
def skeleton_downsample(spark, sf_dir):
    """Every second vertex along each path, ends and joints always."""
    return mesh.thin_paths(*_skeleton(spark, sf_dir), 2)[0]


@query(f"WITH {_RUNS}, k AS (SELECT segid, start, vid FROM path WHERE pos % 2 = 0 OR pos = length), l AS (SELECT segid, lag(vid) OVER (PARTITION BY segid, start ORDER BY vid) AS a, vid AS b FROM k) SELECT * FROM l WHERE a IS NOT NULL")
def skeleton_downsample_edges(spark, sf_dir):
    return mesh.thin_paths(*_skeleton(spark, sf_dir), 2)[1]


@query(f"WITH {_RUNS}, n AS (SELECT r.segid, r.vid, CASE WHEN r.pos = 0 OR r.pos = r.length THEN NULL ELSE r.start END AS start, r.x, r.y, r.z FROM run r), s AS (SELECT n.segid, n.vid, "
    + ", ".join(f"coalesce((SELECT avg(p.{c}) FROM path p WHERE p.segid = n.segid AND p.start = n.start AND abs(p.vid - n.vid) <= 1), n.{c}) AS {c}" for c in "xyz")
    + " FROM n) SELECT segid, vid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM s")
def skeleton_smooth(spark, sf_dir):
    """Vertices at the mean of three neighbours along their path; ends and joints stay."""
    return mesh.smooth_paths(*_skeleton(spark, sf_dir), 3).select("segid", "vid", *[F.round(c, 6).alias(c) for c in "xyz"])


_SBOX = "x BETWEEN 100 AND 1500 AND y BETWEEN 10 AND 80 AND z BETWEEN 5 AND 45"


@query(f"WITH {_SKEL}, k AS (SELECT segid, vid FROM sv WHERE {_SBOX}) SELECT e.segid, e.a, e.b FROM se e JOIN k p ON p.segid = e.segid AND p.vid = e.a JOIN k q ON q.segid = e.segid AND q.vid = e.b")
def skeleton_crop(spark, sf_dir):
    """Edges with both ends in a box."""
    return mesh.crop_skeletons(*_skeleton(spark, sf_dir), ((100, 10, 5), (1500, 80, 45)))[1]


@query(f"WITH {_SKEL}, u AS (SELECT segid, a AS vid FROM se UNION SELECT segid, b FROM se), n AS (SELECT segid, vid, row_number() OVER (PARTITION BY segid ORDER BY vid) - 1 AS nv FROM u) SELECT e.segid, p.nv AS a, q.nv AS b FROM se e JOIN n p ON p.segid = e.segid AND p.vid = e.a JOIN n q ON q.segid = e.segid AND q.vid = e.b")
def skeleton_renumber(spark, sf_dir):
    """Edges after vertices without edges are gone and the others numbered anew."""
    return mesh.renumbered_skeletons(*_skeleton(spark, sf_dir))[1]


@query(f"WITH {_MESH} SELECT segid, vid, x, y, z FROM cv")
def skeleton_merge(spark, sf_dir):
    """Fragments of a skeleton as one, with numbers that go on."""
    v, _ = _mesh(spark, sf_dir)
    return mesh.merge_skeletons(v, v.where("vid > 0").select("segid", "frag", (F.col("vid") - 1).alias("a"), F.col("vid").alias("b")))[0]


@query(f"WITH {_SKEL} SELECT segid, max(flag) <> 'R' AS is_equivalent FROM sv GROUP BY segid")
def skeleton_equivalent(spark, sf_dir):
    """Skeletons against copies with turned edges, whose vertices of flag R lie elsewhere."""
    v, e = _skeleton(spark, sf_dir)
    flag = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("segid"), F.col("l_linenumber").cast("bigint").alias("vid")).agg(F.min("l_returnflag").alias("flag"))
    moved = v.join(flag, ["segid", "vid"]).select("segid", "vid", F.when(F.col("flag") == "R", F.col("x") + 0.5).otherwise(F.col("x")).alias("x"), "y", "z")
    return mesh.equivalent((v, e), (moved, e.select("segid", F.col("b").alias("a"), F.col("a").alias("b"))))


@query("SELECT DISTINCT l_orderkey AS segid, least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def skeleton_consolidate(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("segid"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return mesh.consolidate_edges(e)


@query("""WITH r AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE user_id IS NOT NULL),
p AS (SELECT user_id, event_id, v, i AS p, TRUE AS kept FROM r UNION ALL SELECT user_id, event_id, v, 1 - i, FALSE FROM r WHERE i <= 2 UNION ALL SELECT user_id, event_id, v, 2 * n + 1 - i, FALSE FROM r WHERE i > n - 2),
s AS (SELECT *, avg(v) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM p) SELECT user_id, event_id, round(a, 6) AS smoothed FROM s WHERE kept""")
def moving_average(spark, sf_dir):
    """Rolling means of each user's values, mirrored at both ends."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    return mesh.smoothed(e, "user_id", "event_id", "value", 2).withColumn("smoothed", F.round("smoothed", 6))


# --- metadata -------------------------------------------------------------------


@query("WITH f AS (SELECT DISTINCT file_id, layer_id, mip, chunk_name, n_bytes FROM chunk_files) SELECT layer_id, mip, count(*) AS n_files, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM f GROUP BY 1, 2")
def cache_stats(spark, sf_dir):
    """Files and bytes of every scale."""
    f = table(spark, sf_dir, "chunk_files").select("file_id", "layer_id", "mip", "chunk_name", "n_bytes").distinct()
    return f.groupBy("layer_id", "mip").agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


@query("SELECT DISTINCT file_id, regexp_replace(chunk_name, '\\.(gz|br|zstd)$', '') AS plain_name FROM chunk_files")
def strip_compression(spark, sf_dir):
    return table(spark, sf_dir, "chunk_files").select("file_id", L.without_compression(F.col("chunk_name")).alias("plain_name")).distinct()


@query("WITH s AS (SELECT DISTINCT layer_id, mip, volume_size, chunk_sizes FROM sharded_info) SELECT layer_id, mip, " + ", ".join(f"CAST(ceil(volume_size[{i}] / CAST(chunk_sizes[1][{i}] AS DOUBLE)) AS BIGINT) AS n{d}" for i, d in enumerate("xyz", 1)) + " FROM s")
def grid_size(spark, sf_dir):
    """Chunks per axis of every scale."""
    s = table(spark, sf_dir, "sharded_info").select("layer_id", "mip", "volume_size", "chunk_sizes").distinct()
    return s.select("layer_id", "mip", *[F.ceil(F.get("volume_size", F.lit(i)) / F.get(F.get("chunk_sizes", F.lit(0)), F.lit(i))).cast("bigint").alias(f"n{d}") for i, d in enumerate("xyz")])


@query("WITH s AS (SELECT DISTINCT layer_id, mip, voxel_offset, volume_size FROM sharded_info) SELECT layer_id, mip, " + ", ".join(f"voxel_offset[{i}] AS {d}0, voxel_offset[{i}] + volume_size[{i}] AS {d}1" for i, d in enumerate("xyz", 1)) + " FROM s")
def scale_bounds(spark, sf_dir):
    s = table(spark, sf_dir, "sharded_info").select("layer_id", "mip", "voxel_offset", "volume_size").distinct()
    o, n = (lambda i: F.get("voxel_offset", F.lit(i))), (lambda i: F.get("volume_size", F.lit(i)))
    return s.select("layer_id", "mip", *[c.alias(f"{d}{e}") for i, d in enumerate("xyz") for c, e in ((o(i), 0), (o(i) + n(i), 1))])


@query("SELECT event_id, CAST(ceil(epoch_us(ts) / 1000000.0) AS BIGINT) AS unix_seconds FROM events WHERE ts IS NOT NULL")
def unix_time(spark, sf_dir):
    return table(spark, sf_dir, "events").where("ts is not null").select("event_id", L.unix_seconds(F.col("ts")).alias("unix_seconds"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN v < 0 THEN CAST(v AS DECIMAL(20,0)) + 18446744073709551616 ELSE v END AS DECIMAL(20,0)) AS unsigned FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN -1 - l_orderkey ELSE l_orderkey END AS v FROM lineitem)")
def unsigned_labels(spark, sf_dir):
    v = F.when(F.col("l_linenumber") % 2 == 0, -1 - F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.unsigned(v).alias("unsigned"))


@query("SELECT id, 'precomputed' AS path_format, 'gs' AS protocol, concat('bucket', id % 7) AS bucket, concat('set', id % 11) AS dataset, concat('layer', id) AS layer FROM (SELECT DISTINCT id FROM index_files WHERE id IS NOT NULL)")
def path_extract(spark, sf_dir):
    i = F.col("id")
    path = F.concat(F.lit("precomputed://gs://bucket"), (i % 7).cast("string"), F.lit("/a/set"), (i % 11).cast("string"), F.lit("/layer"), i.cast("string"))
    rows = table(spark, sf_dir, "index_files").select("id").dropna().distinct().select("id", path.alias("path"))
    return rows.select("id", *[c.alias(n) for c, n in zip(L.path_parts(F.col("path")), ("path_format", "protocol", "bucket", "dataset", "layer"))])


@query("SELECT id, CAST(2 AS INTEGER) AS layer, concat('f', id % 5, '.shard') AS shard_file, id * 10 AS first_byte, id % 100 AS n_bytes FROM (SELECT DISTINCT id FROM index_files WHERE id IS NOT NULL)")
def manifest_byte_ranges(spark, sf_dir):
    i = F.col("id")
    name = F.concat(F.lit("~2/f"), (i % 5).cast("string"), F.lit(".shard:"), (i * 10).cast("string"), F.lit(":"), (i % 100).cast("string"))
    rows = table(spark, sf_dir, "index_files").select("id").dropna().distinct().select("id", name.alias("name"))
    return rows.select("id", *[c.alias(n) for c, n in zip(L.byte_range_of(F.col("name")), ("layer", "shard_file", "first_byte", "n_bytes"))])
