"""Volume, chunk, box and sharding queries on the driver's tables.

The volume V embeds ``lineitem``: x = l_partkey, y = l_suppkey, z = l_linenumber, label =
smallest l_orderkey + 1 (0 is the background), val = smallest l_quantity; chunks of
64 x 16 x 4 voxels from the origin (0, 0, 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import grid
from chunkloom.functions.boxes import AXES, Box
from chunkloom.operators import sharding
from chunkloom.operators.volume import GXYZ, XYZ, Volume, grid_rows
from chunkloom.session import table

CHUNK = (64, 16, 4)
ORIGIN = (0, 0, 1)
CUT = ((64, 16, 1), (200, 64, 8))
ODD = ((70, 20, 2), (190, 61, 7))
DENSE = ((100, 20, 1), (116, 28, 8))
WRITTEN = ((64, 16, 1), (128, 32, 5))
KEEP = [17, 4242, 999, 1201]
MASK = 2**32 - 1


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    v = t.groupBy(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_linenumber").cast("bigint").alias("z"))
    return v.agg((F.min("l_orderkey") + 1).alias("label"), F.min("l_quantity").alias("val"))


def volume(spark: SparkSession, sf_dir: str) -> Volume:
    """V, its bounds from the keys' extents (one row)."""
    m = table(spark, sf_dir, "lineitem").agg(F.max("l_partkey"), F.max("l_suppkey"), F.max("l_linenumber")).first()
    return Volume(voxels(spark, sf_dir), (ORIGIN, (m[0] + 1, m[1] + 1, m[2] + 1)), CHUNK)


V = "v AS (SELECT l_partkey AS x, l_suppkey AS y, CAST(l_linenumber AS BIGINT) AS z, min(l_orderkey) + 1 AS label, min(l_quantity) AS val FROM lineitem GROUP BY 1, 2, 3)"
B = f"{V}, b AS (SELECT max(l_partkey) + 1 AS x1, max(l_suppkey) + 1 AS y1, CAST(max(l_linenumber) + 1 AS BIGINT) AS z1 FROM lineitem)"


def _in(box, p: str = "") -> str:
    return " AND ".join(f"{p}{d} >= {a} AND {p}{d} < {b}" for d, a, b in zip(AXES, *box))


G = "CAST(x // 64 AS BIGINT) AS gx, CAST(y // 16 AS BIGINT) AS gy, CAST((z - 1) // 4 AS BIGINT) AS gz"
NAME = "concat(gx * 64, '-', least(gx * 64 + 64, x1), '_', gy * 16, '-', least(gy * 16 + 16, y1), '_', gz * 4 + 1, '-', least(gz * 4 + 5, z1))"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query and its SQL under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- reads ------------------------------------------------------------------


@query(f"WITH {V} SELECT x, y, z, label, val FROM v WHERE {_in(CUT)}")
def cutout(spark, sf_dir):
    return volume(spark, sf_dir).cutout(CUT, bounded=False)


@query(f"WITH {V} SELECT x, y, z, label FROM v WHERE {_in(CUT)} AND (x - 64) % 2 = 0 AND (y - 16) % 3 = 0")
def cutout_stepped(spark, sf_dir):
    return volume(spark, sf_dir).cutout(CUT, (2, 3, 1), bounded=False).select(*XYZ, "label")


@query(f"""WITH {V}, g AS (SELECT x, y, z FROM (SELECT unnest(range(100, 116)) AS x), (SELECT unnest(range(20, 28)) AS y), (SELECT unnest(range(1, 8)) AS z))
SELECT x, y, z, coalesce(label, 0) AS label FROM g LEFT JOIN v USING (x, y, z)""")
def cutout_fill_missing(spark, sf_dir):
    return volume(spark, sf_dir).dense(DENSE, bounded=False)


@query(f"WITH {B} SELECT x, y, z, label FROM v, b WHERE x < least(40, x1) AND y < least(30, y1) AND z < least(4, z1)")
def cutout_autocrop(spark, sf_dir):
    return volume(spark, sf_dir).cutout(((-25, -5, 0), (40, 30, 4)), autocrop=True).select(*XYZ, "label")


_POINTS = "CAST(user_id AS BIGINT) AS x, CAST(hour(ts) AS BIGINT) AS y, CAST(day(ts) % 7 + 1 AS BIGINT) AS z"


def _event_points(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    return e.select(F.col("event_id"), F.col("user_id").cast("bigint").alias("x"), F.hour("ts").cast("bigint").alias("y"), (F.dayofmonth("ts") % 7 + 1).cast("bigint").alias("z"))


@query(f"WITH {V}, p AS (SELECT DISTINCT {_POINTS} FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) SELECT x, y, z, coalesce(label, 0) AS label FROM p LEFT JOIN v USING (x, y, z)")
def scattered_points(spark, sf_dir):
    return volume(spark, sf_dir).at_points(_event_points(spark, sf_dir))


@query(f"WITH {V}, p AS (SELECT event_id AS pos, {_POINTS} FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) SELECT pos, coalesce(label, 0) AS label FROM p LEFT JOIN v USING (x, y, z)")
def coordinate_index(spark, sf_dir):
    """Values at coordinates by their input position, duplicates kept."""
    p = _event_points(spark, sf_dir).withColumnRenamed("event_id", "pos")
    return volume(spark, sf_dir).at_points(p, ["pos"]).select("pos", "label")


@query(f"WITH {B} SELECT x, y, z, label FROM v, b WHERE x >= 118 AND x < least(182, x1) AND y >= 8 AND y < least(72, y1) AND z < least(36, z1)")
def download_point(spark, sf_dir):
    return volume(spark, sf_dir).around((150, 40, 4), 64).select(*XYZ, "label")


@query(f"WITH {V}, p AS (SELECT CAST(42 AS BIGINT) AS x, CAST(42 AS BIGINT) AS y, CAST(3 AS BIGINT) AS z) SELECT x, y, z, coalesce(label, 0) AS label FROM p LEFT JOIN v USING (x, y, z)")
def single_voxel(spark, sf_dir):
    """One voxel, the background if nothing is stored there."""
    return volume(spark, sf_dir).dense(((42, 42, 3), (43, 43, 4)), bounded=False)


# --- labels -----------------------------------------------------------------


@query(f"WITH {V}, c AS (SELECT label FROM v WHERE {_in(CUT)}) SELECT label FROM c UNION SELECT 0 WHERE (SELECT count(*) FROM c) < {136 * 48 * 7}")
def unique_labels(spark, sf_dir):
    return _unbounded(volume(spark, sf_dir)).unique(CUT)


def _unbounded(v: Volume) -> Volume:
    """V with bounds that hold the fixed boxes of the queries at every scale."""
    return Volume(v.voxels, (v.bounds[0], tuple(max(a, b) for a, b in zip(v.bounds[1], (256, 64, 8)))), v.chunk)


@query(f"WITH {V} SELECT DISTINCT label FROM v WHERE {_in(ODD)}")
def unique_core_shell(spark, sf_dir):
    """By label lists for chunks inside the box and by voxel at its rim."""
    v = _unbounded(volume(spark, sf_dir))
    return v.unique_core_shell(ODD, v.chunk_labels())


@query(f"WITH {V} SELECT DISTINCT {G}, label FROM v")
def chunk_labels(spark, sf_dir):
    return volume(spark, sf_dir).chunk_labels()


@query(f"WITH {V} SELECT DISTINCT {G} FROM v WHERE label IN (17, 4242, 999, 1201)")
def chunks_with_label(spark, sf_dir):
    """Chunks that hold any of some labels, from the label lists."""
    return volume(spark, sf_dir).chunk_labels().where(F.col("label").isin(KEEP)).select(*GXYZ).distinct()


@query(f"WITH {V} SELECT x, y, z, label = 17 AS label FROM v")
def label_mask(spark, sf_dir):
    v = volume(spark, sf_dir)
    return v.binary(v.voxels, 17).select(*XYZ, "label")


@query(f"WITH {V} SELECT x, y, z, CASE WHEN label IN (17, 4242, 999, 1201) THEN label ELSE 0 END AS label FROM v")
def mask_except(spark, sf_dir):
    v = volume(spark, sf_dir)
    return v.keep_only(v.voxels, KEEP).select(*XYZ, "label")


@query(f"""WITH {V}, g AS (SELECT x, y, z FROM (SELECT unnest(range(100, 116)) AS x), (SELECT unnest(range(20, 28)) AS y), (SELECT unnest(range(1, 8)) AS z)), d AS (SELECT x, y, z, coalesce(label, 0) AS label FROM g LEFT JOIN v USING (x, y, z))
SELECT x, y, z, CASE WHEN label IN (0, 17, 4242, 999, 1201) THEN label ELSE {MASK} END AS label FROM d""")
def mask_preserve_zeros(spark, sf_dir):
    v = volume(spark, sf_dir)
    return v.keep_only(v.dense(DENSE, bounded=False), KEEP, MASK)


@query(f"WITH {V} SELECT x, y, z, label, dense_rank() OVER (ORDER BY label) AS new_label FROM v WHERE {_in(CUT)}")
def renumber(spark, sf_dir):
    v = volume(spark, sf_dir)
    return v.renumber(v.cutout(CUT, bounded=False))[0].select(*XYZ, "label", "new_label")


@query(f"WITH {V} SELECT x, y, z, coalesce(o_custkey + 1, label) AS label FROM v LEFT JOIN orders ON label = o_orderkey + 1")
def remap_labels(spark, sf_dir):
    """Labels to their parents; labels without one stay."""
    v = volume(spark, sf_dir)
    m = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("old"), (F.col("o_custkey") + 1).alias("new"))
    return v.remap(v.voxels.select(*XYZ, "label"), m).select(*XYZ, "label")


@query(f"WITH {V} SELECT label, count(*) AS n_voxels, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1, min(z) AS z0, max(z) + 1 AS z1 FROM v GROUP BY label")
def label_bounds(spark, sf_dir):
    v = volume(spark, sf_dir).voxels
    return v.groupBy("label").agg(F.count("*").alias("n_voxels"), *[f for c in XYZ for f in (F.min(c).alias(f"{c}0"), (F.max(c) + 1).alias(f"{c}1"))])


# --- chunks -----------------------------------------------------------------


@query(f"""WITH {B}, s AS (SELECT DISTINCT {G} FROM v), g AS (SELECT gx, gy, gz, x1, y1, z1 FROM b, (SELECT unnest(range(0, (x1 + 63) // 64)) AS gx, x1 AS _x FROM b), (SELECT unnest(range(0, (y1 + 15) // 16)) AS gy FROM b), (SELECT unnest(range(0, (z1 + 2) // 4)) AS gz FROM b))
SELECT g.gx, g.gy, g.gz, {NAME.replace("gx", "g.gx").replace("gy", "g.gy").replace("gz", "g.gz")} AS chunk_name, s.gx IS NOT NULL AS is_stored FROM g LEFT JOIN s ON g.gx = s.gx AND g.gy = s.gy AND g.gz = s.gz""")
def exists_chunks(spark, sf_dir):
    v = volume(spark, sf_dir)
    return v.exists(v.bounds)


@query(f"WITH {B}, s AS (SELECT DISTINCT {G} FROM v) SELECT gx, gy, gz, {NAME} AS chunk_name FROM s, b")
def chunk_names(spark, sf_dir):
    v = volume(spark, sf_dir)
    return v.stored_chunks().withColumn("chunk_name", v.chunk_box([F.col(g) for g in GXYZ]).name())


@query(f"WITH {V} SELECT {G}, count(*) AS n_voxels, min(label) AS min_label, max(label) AS max_label, CAST(sum(val) AS DOUBLE) AS sum_val FROM v GROUP BY 1, 2, 3")
def chunk_statistics(spark, sf_dir):
    v = volume(spark, sf_dir)
    return v.with_chunks(v.voxels).groupBy(*GXYZ).agg(F.count("*").alias("n_voxels"), F.min("label").alias("min_label"), F.max("label").alias("max_label"), F.sum("val").alias("sum_val"))


@query(f"WITH {V} SELECT CAST(x // 128 AS BIGINT) AS gx, CAST(y // 64 AS BIGINT) AS gy, CAST((z - 1) // 8 AS BIGINT) AS gz, count(*) AS n_voxels, min(label) AS min_label FROM v GROUP BY 1, 2, 3")
def transfer_rechunk(spark, sf_dir):
    """Rendering into another chunk size: one shuffle on the new chunk key."""
    v = volume(spark, sf_dir).rechunk((128, 64, 8))
    return v.with_chunks(v.voxels).groupBy(*GXYZ).agg(F.count("*").alias("n_voxels"), F.min("label").alias("min_label"))


@query(f"WITH {V}, c AS (SELECT CAST(x // 2 AS BIGINT) AS x, CAST(y // 2 AS BIGINT) AS y, z, label, count(*) AS n FROM v GROUP BY 1, 2, 3, 4) SELECT x, y, z, label FROM (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY n DESC, label) AS r FROM c) WHERE r = 1")
def downsample_mode(spark, sf_dir):
    """Extension: segmentation at the next level."""
    return volume(spark, sf_dir).downsample((2, 2, 1))


@query(f"WITH {V} SELECT CAST(x // 2 AS BIGINT) AS x, CAST(y // 2 AS BIGINT) AS y, z, avg(val) AS val FROM v GROUP BY 1, 2, 3")
def downsample_mean(spark, sf_dir):
    """Extension: an image at the next level, over stored voxels."""
    v = volume(spark, sf_dir)
    return Volume(v.voxels, v.bounds, v.chunk, value="val").downsample((2, 2, 1), "mean")


# --- writes -----------------------------------------------------------------

_NEW = f"n AS (SELECT x, y, z, label + 1000000 AS label FROM v WHERE {_in(WRITTEN)} AND val > 10)"


def _fresh(v: Volume, box) -> DataFrame:
    return v.voxels.where(v.inside(box) & (F.col("val") > 10)).withColumn("label", F.col("label") + 1000000)


@query(f"WITH {V}, {_NEW} SELECT x, y, z, label FROM v WHERE NOT ({_in(WRITTEN)}) UNION ALL SELECT x, y, z, label FROM n")
def write_aligned(spark, sf_dir):
    v = _unbounded(volume(spark, sf_dir))
    return v.write(WRITTEN, _fresh(v, WRITTEN))


@query(f"WITH {V}, n AS (SELECT x, y, z, label + 1000000 AS label FROM v WHERE {_in(ODD)} AND val > 10) SELECT x, y, z, label FROM v WHERE NOT ({_in(ODD)}) UNION ALL SELECT x, y, z, label FROM n")
def write_non_aligned(spark, sf_dir):
    v = _unbounded(volume(spark, sf_dir))
    return v.write(ODD, _fresh(v, ODD), non_aligned=True)


@query(f"WITH {V}, n AS (SELECT x, y, z, label + 1000000 AS label FROM v WHERE {_in(ODD)} AND val > 10) SELECT x, y, z, label FROM v WHERE NOT (x >= 64 AND x < 192 AND y >= 16 AND y < 64 AND z >= 1 AND z < 8) UNION ALL SELECT x, y, z, label FROM n")
def overwrite_partial(spark, sf_dir):
    v = _unbounded(volume(spark, sf_dir))
    return v.overwrite_partial(ODD, _fresh(v, ODD))


@query(f"WITH {V} SELECT x, y, z, label, val FROM v WHERE NOT ({_in(WRITTEN)})")
def delete_region(spark, sf_dir):
    return _unbounded(volume(spark, sf_dir)).delete(WRITTEN)


@query(f"WITH {V}, c AS (SELECT {G}, count(*) FILTER (WHERE val > 5) AS n FROM v GROUP BY 1, 2, 3) SELECT gx, gy, gz, n > 0 AS is_kept FROM c")
def delete_black(spark, sf_dir):
    """Chunks that only hold background (val of at most 5) are deleted, not written."""
    v = volume(spark, sf_dir)
    return v.with_chunks(v.voxels).groupBy(*GXYZ).agg((F.count_if(F.col("val") > 5) > 0).alias("is_kept"))


# --- Morton codes and shards --------------------------------------------------

_MORTON = f"""{B}, s AS (SELECT DISTINCT {G} FROM v), n AS (SELECT (x1 + 63) // 64 AS nx, (y1 + 15) // 16 AS ny, (z1 + 2) // 4 AS nz FROM b),
h AS (SELECT CASE WHEN nx > 1 THEN length(bin(nx - 1)) ELSE 0 END AS hx, CASE WHEN ny > 1 THEN length(bin(ny - 1)) ELSE 0 END AS hy, CASE WHEN nz > 1 THEN length(bin(nz - 1)) ELSE 0 END AS hz FROM n),
m AS (SELECT gx, gy, gz, CAST(coalesce(list_sum(list_transform(range(0, hx), lambda i: ((gx >> i) & 1) << CAST(least(i, hx) + least(i, hy) + least(i, hz) AS INT))), 0)
 + coalesce(list_sum(list_transform(range(0, hy), lambda i: ((gy >> i) & 1) << CAST(least(i, hx) + least(i, hy) + least(i, hz) + CASE WHEN i < hx THEN 1 ELSE 0 END AS INT))), 0)
 + coalesce(list_sum(list_transform(range(0, hz), lambda i: ((gz >> i) & 1) << CAST(least(i, hx) + least(i, hy) + least(i, hz) + CASE WHEN i < hx THEN 1 ELSE 0 END + CASE WHEN i < hy THEN 1 ELSE 0 END AS INT))), 0) AS BIGINT) AS code FROM s, h)"""


def _coded(spark, sf_dir) -> tuple[DataFrame, list]:
    v = volume(spark, sf_dir)
    places = grid.bit_places([F.lit(n).cast("bigint") for n in v.grid_size()])
    code = grid.morton_code([F.col(g) for g in GXYZ], places)
    return v.stored_chunks().withColumn("code", code), places


@query(f"WITH {_MORTON} SELECT gx, gy, gz, code FROM m")
def morton_encode(spark, sf_dir):
    return _coded(spark, sf_dir)[0]


@query(f"WITH {_MORTON} SELECT code, gx, gy, gz FROM m")
def morton_decode(spark, sf_dir):
    """Codes back to grid positions."""
    rows, places = _coded(spark, sf_dir)
    return rows.select("code", *[p.alias(g) for g, p in zip(GXYZ, grid.morton_point(F.col("code"), places))])


SPEC = sharding.Spec(2, 3, 6)


@query(f"WITH {_MORTON} SELECT code, (code >> 2) & 7 AS minishard, lpad(lower(to_hex((code >> 5) & 63)), 2, '0') AS shard FROM m")
def shard_location_identity(spark, sf_dir):
    rows = _coded(spark, sf_dir)[0]
    minishard, shard = SPEC.location(F.col("code"))
    return rows.select("code", minishard.alias("minishard"), shard.alias("shard"))


def _mixed(c: str) -> str:
    """The final mixing of a 32-bit word, in two steps of SQL."""
    one = f"((xor({c}, {c} // 65536) * 2246822507) & {MASK})"
    two = f"((xor({one}, {one} // 8192) * 3266489909) & {MASK})"
    return f"xor({two}, {two} // 65536)"


#: MurmurHash3_x86_128 of the label's 8 bytes after a shift by 6, its lower 64 bits.
_MURMUR = f"""{V}, k AS (SELECT DISTINCT label, CAST(label >> 6 AS HUGEINT) AS key FROM v),
w AS (SELECT label, ((key & {MASK}) * 597399067) & {MASK} AS a, ((key // 4294967296) * 2869860233) & {MASK} AS b FROM k),
r AS (SELECT label, ((((a * 32768) & {MASK}) + a // 131072) * 2869860233) & {MASK} AS a, ((((b * 65536) & {MASK}) + b // 65536) * 951274213) & {MASK} AS b FROM w),
s AS (SELECT label, xor(a, CAST(8 AS HUGEINT)) AS h1, xor(b, CAST(8 AS HUGEINT)) AS h2, CAST(8 AS HUGEINT) AS h3 FROM r),
t AS (SELECT label, (h1 + h2 + h3 + h3) & {MASK} AS h1, h2, h3 FROM s), u AS (SELECT label, h1, (h2 + h1) & {MASK} AS h2, (h3 + h1) & {MASK} AS h3 FROM t),
f AS (SELECT label, {_mixed("h1")} AS h1, {_mixed("h2")} AS h2, {_mixed("h3")} AS h3 FROM u),
g AS (SELECT label, (h1 + h2 + h3 + h3) & {MASK} AS h1, h2 FROM f), h AS (SELECT label, h1 + ((h2 + h1) & {MASK}) * 4294967296 AS h FROM g)"""


@query(f"WITH {_MURMUR} SELECT label, CAST(h & 2047 AS BIGINT) AS minishard, lpad(lower(to_hex(CAST((h // 2048) & 127 AS BIGINT))), 2, '0') AS shard FROM h")
def shard_location_murmur(spark, sf_dir):
    """Hashed placement of all labels."""
    labels = volume(spark, sf_dir).voxels.select("label").distinct()
    minishard, shard = sharding.Spec(6, 11, 7, "murmurhash3_x86_128").location(F.col("label"))
    return labels.select("label", minishard.alias("minishard"), shard.alias("shard"))


_ENTRIES = "e AS (SELECT DISTINCT l_orderkey + 1 AS label, (l_orderkey + 1) & 511 AS minishard FROM lineitem)"


def _minishard_labels(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("label")).distinct()
    return t.withColumn("minishard", F.col("label").bitwiseAND(F.lit(511).cast("bigint")))


@query(f"WITH {_ENTRIES} SELECT minishard, label, label - coalesce(lag(label) OVER (PARTITION BY minishard ORDER BY label), 0) AS label_delta FROM e")
def minishard_delta_encode(spark, sf_dir):
    return sharding.delta_encoded(_minishard_labels(spark, sf_dir), ["minishard"])


_SIZES = "q AS (SELECT l_orderkey + 1 AS label, (l_orderkey + 1) & 511 AS minishard, CAST(sum(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY 1, 2)"


def _label_sizes(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") + 1).alias("label")).agg(F.sum("l_quantity").cast("bigint").alias("size"))
    return t.withColumn("minishard", F.col("label").bitwiseAND(F.lit(511).cast("bigint")))


@query(f"WITH {_SIZES} SELECT minishard, label, CAST(sum(size) OVER (PARTITION BY minishard ORDER BY label) - size AS BIGINT) AS \"offset\", size FROM q")
def minishard_delta_decode(spark, sf_dir):
    """Differences and sizes back to labels and offsets by running sums."""
    rows = sharding.delta_encoded(_label_sizes(spark, sf_dir), ["minishard"]).withColumn("gap", F.lit(0).cast("bigint"))
    coded = rows.select("minishard", F.col("label").alias("i"), "label_delta", "gap", "size")
    return sharding.delta_decoded(coded, ["minishard"], "i").select("minishard", "label", "offset", "size")


@query("""WITH r AS (SELECT l_suppkey AS file_no, l_orderkey * 8 + l_linenumber AS a, l_orderkey * 8 + l_linenumber + 1 + CAST(l_quantity AS BIGINT) % 2 AS z FROM lineitem),
d AS (SELECT DISTINCT file_no, CAST(a AS BIGINT) AS a, CAST(z AS BIGINT) AS z FROM r), m AS (SELECT *, CASE WHEN a = lag(z) OVER w THEN 0 ELSE 1 END AS fresh FROM d WINDOW w AS (PARTITION BY file_no ORDER BY a, z)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY file_no ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT file_no, min(a) AS "start", max(z) AS "end", count(*) AS n_ranges FROM g GROUP BY file_no, run""")
def range_coalesce(spark, sf_dir):
    """Adjacent byte ranges of a file merge into one request."""
    t = table(spark, sf_dir, "lineitem")
    start = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    r = t.select(F.col("l_suppkey").alias("file_no"), start.cast("bigint").alias("start"), (start + 1 + F.col("l_quantity").cast("bigint") % 2).cast("bigint").alias("end")).distinct()
    return sharding.coalesced_ranges(r, ["file_no"])


@query(f"WITH {_SIZES} SELECT label, size FROM q ORDER BY size DESC, label")
def list_labels_by_size(spark, sf_dir):
    """All labels, the largest first."""
    return _label_sizes(spark, sf_dir).select("label", "size").orderBy(F.desc("size"), "label")


@query("SELECT DISTINCT l_orderkey + 1 AS label, concat('label ', l_orderkey + 1) AS payload FROM lineitem")
def shard_roundtrip(spark, sf_dir):
    """Payloads written into shard files and read back."""
    labels = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("label")).distinct()
    items = labels.withColumn("payload", F.encode(F.concat(F.lit("label "), F.col("label").cast("string")), "utf-8"))
    spec = sharding.Spec(0, 3, 5, "murmurhash3_x86_128")
    back = sharding.shard_entries(sharding.shard_files(items, spec), spec)
    return back.select("label", F.decode("payload", "utf-8").alias("payload"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey + 1 AS label FROM lineitem), p AS (SELECT label, (label >> 5) & 15 AS shard, (label >> 3) & 3 AS minishard, label % 50 AS size FROM e)
SELECT concat(lower(to_hex(shard)), '.shard') AS filename, minishard, label, CAST(64 + sum(size) OVER (PARTITION BY shard ORDER BY minishard, label) - size AS BIGINT) AS "offset", size FROM p""")
def shard_index(spark, sf_dir):
    """Byte ranges of all labels in their shard files."""
    labels = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("label")).distinct()
    items = labels.withColumn("payload", F.encode(F.repeat(F.lit("v"), (F.col("label") % 50).cast("int")), "utf-8"))
    spec = sharding.Spec(3, 2, 4, data_encoding="raw")
    return sharding.shard_entries(sharding.shard_files(items, spec), spec, payloads=False)


# --- boxes --------------------------------------------------------------------

_R = "r AS (SELECT DISTINCT roi_id, least(x0, x1) AS x0, greatest(x0, x1) AS x1, least(y0, y1) AS y0, greatest(y0, y1) AS y1, least(z0, z1) AS z0, greatest(z0, z1) AS z1 FROM rois WHERE x0 + x1 + y0 + y1 + z0 + z1 IS NOT NULL)"
_BOX6 = ["x0", "x1", "y0", "y1", "z0", "z1"]
_Q = ((500000, 300000, 40000), (900000, 1000000, 120000))


def regions(spark, sf_dir) -> tuple[DataFrame, Box]:
    """Whole regions with corners in order, and their box."""
    t = table(spark, sf_dir, "rois").dropna(subset=_BOX6)
    b = Box.sorted([F.col(f"{d}0") for d in AXES], [F.col(f"{d}1") for d in AXES])
    return t.select("roi_id", *b.columns()).distinct(), Box([F.col(f"{d}0") for d in AXES], [F.col(f"{d}1") for d in AXES])


def _per_axis(make, join=" AND ") -> str:
    return join.join(make(d, a, b) for d, a, b in zip(AXES, *_Q))


@query(f"""WITH {_R} SELECT roi_id, {_per_axis(lambda d, a, b: f"{d}0 < {b} AND {d}1 > {a}")} AS intersects, {_per_axis(lambda d, a, b: f"{d}1 >= {a} AND {d}0 <= {b}")} AS overlaps,
{_per_axis(lambda d, a, b: f"{a} >= {d}0 AND {b} <= {d}1")} AS contains, {_per_axis(lambda d, a, b: f"{d}0 >= {a} AND {d}1 <= {b}")} AS contained, {_per_axis(lambda d, a, b: f"abs({d}0 - {a}) <= 5000 OR abs({d}1 - {b}) <= 5000", " OR ")} AS near_edge FROM r""")
def box_predicates(spark, sf_dir):
    rows, b = regions(spark, sf_dir)
    q = Box.of(*_Q)
    return rows.select("roi_id", b.intersects(q).alias("intersects"), b.overlaps(q).alias("overlaps"), b.contains_box(q).alias("contains"), q.contains_box(b).alias("contained"), b.near_edge(q, 5000).alias("near_edge"))


_HIT = _per_axis(lambda d, a, b: f"{d}0 < {b} AND {d}1 > {a}")


@query(f"""WITH {_R} SELECT roi_id, {", ".join(f"CASE WHEN {_HIT} THEN greatest({d}0, {a}) ELSE 0 END AS i{d}0, CASE WHEN {_HIT} THEN least({d}1, {b}) ELSE 0 END AS i{d}1, least({d}0, {a}) AS h{d}0, greatest({d}1, {b}) AS h{d}1, least(greatest({d}0, {a}), {b}) AS c{d}0, least(greatest({d}1, {a}), {b}) AS c{d}1" for d, a, b in zip(AXES, *_Q))} FROM r""")
def box_algebra(spark, sf_dir):
    """Intersection (the zero box if disjoint), hull and clamping."""
    rows, b = regions(spark, sf_dir)
    q = Box.of(*[[F.lit(v).cast("bigint") for v in c] for c in _Q])
    return rows.select("roi_id", *b.intersection(q).columns("i"), *b.hull(q).columns("h"), *b.clamped(q).columns("c"))


def _grid_sql() -> str:
    cs, os = (448, 448, 60), (7, -11, 3)
    fl = lambda v, c, o: f"CAST(floor(({v} - {o}) / CAST({c} AS DOUBLE)) AS BIGINT) * {c} + {o}"
    ce = lambda v, c, o: f"CAST(ceil(({v} - {o}) / CAST({c} AS DOUBLE)) AS BIGINT) * {c} + {o}"
    ro = lambda v, c, o: f"CAST(round_even(({v} - {o}) / CAST({c} AS DOUBLE), 0) AS BIGINT) * {c} + {o}"
    z = list(zip(AXES, cs, os))
    bad = " OR ".join(f"({fl(d + '1', c, o)}) < ({ce(d + '0', c, o)})" for d, c, o in z)
    cols = [f"{fl(d + '0', c, o)} AS e{d}0, {ce(d + '1', c, o)} AS e{d}1, {ce(d + '0', c, o)} AS s{d}0, CASE WHEN {bad} THEN {ce(d + '0', c, o)} ELSE {fl(d + '1', c, o)} END AS s{d}1, {ro(d + '0', c, o)} AS r{d}0, {ro(d + '1', c, o)} AS r{d}1" for d, c, o in z]
    n = " * ".join(f"CAST(ceil(({d}1 - {d}0) / CAST({c} AS DOUBLE)) AS BIGINT)" for d, c, o in z)
    return f"WITH {_R} SELECT roi_id, {', '.join(cols)}, {n} AS n_chunks FROM r"


@query(_grid_sql())
def box_chunk_grid(spark, sf_dir):
    """Expanded, shrunk and rounded to a chunk grid with an offset."""
    rows, b = regions(spark, sf_dir)
    cs, os = (448, 448, 60), (7, -11, 3)
    return rows.select("roi_id", *b.expanded_to(cs, os).columns("e"), *b.shrunk_to(cs, os).columns("s"), *b.rounded_to(cs, os).columns("r"), b.num_chunks(cs).alias("n_chunks"))


@query(f"WITH {_R} SELECT roi_id, concat(x0, '-', x1, '_', y0, '-', y1, '_', z0, '-', z1) AS box_name, CAST((x1 - x0) AS DECIMAL(38,0)) * (y1 - y0) * (z1 - z0) AS volume, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (z0 + z1) / 2 AS cz, x0 = x1 OR y0 = y1 OR z0 = z1 AS is_empty FROM r")
def box_measures(spark, sf_dir):
    rows, b = regions(spark, sf_dir)
    return rows.select("roi_id", b.name().alias("box_name"), b.volume().alias("volume"), *[c.alias(f"c{d}") for d, c in zip(AXES, b.centre())], b.empty().alias("is_empty"))


_BY = (7, -11, 3)


@query(f"WITH {_R} SELECT roi_id, " + ", ".join(f"{d}0 + {v} AS p{d}0, {d}1 + {v} AS p{d}1, {d}0 - {v} AS m{d}0, {d}1 - {v} AS m{d}1, {d}0 * {v} AS t{d}0, {d}1 * {v} AS t{d}1, {d}0 / {v}.0::DOUBLE AS q{d}0, {d}1 / {v}.0::DOUBLE AS q{d}1, CAST(floor({d}0 / {abs(v)}.0::DOUBLE) AS BIGINT) AS f{d}0, CAST(floor({d}1 / {abs(v)}.0::DOUBLE) AS BIGINT) AS f{d}1, {d}0 - {abs(v)} AS g{d}0, {d}1 + {abs(v)} AS g{d}1, {d}0 + {abs(v)} AS s{d}0, {d}1 - {abs(v)} AS s{d}1" for d, v in zip(AXES, _BY)) + " FROM r")
def box_arithmetic(spark, sf_dir):
    """Boxes moved, scaled, divided, grown and shrunk by a vector."""
    rows, b = regions(spark, sf_dir)
    size = [abs(v) for v in _BY]
    parts = [(b.plus(_BY), "p"), (b.minus(_BY), "m"), (b.times(_BY), "t"), (b.divided([float(v) for v in _BY]), "q"), (b.floored_by(size), "f"), (b.grown(size), "g"), (b.shrunk(size), "s")]
    return rows.select("roi_id", *[c for box, name in parts for c in box.columns(name)])


def _mip_sql() -> str:
    def down(v, f, fn, n):
        for _ in range(n):
            v = f"CAST({fn}(({v}) / {f}.0) AS BIGINT)"
        return v

    return f"WITH {_R} SELECT roi_id, " + ", ".join(f"{down(d + '0', f, 'floor', 3)} AS d{d}0, {down(d + '1', f, 'ceil', 3)} AS d{d}1, {d}0 * {f**2} AS u{d}0, {d}1 * {f**2} AS u{d}1" for d, f in zip(AXES, (2, 2, 1))) + " FROM r"


@query(_mip_sql())
def box_to_mip(spark, sf_dir):
    """Three levels down (floor and ceil at each), two levels up."""
    rows, b = regions(spark, sf_dir)
    return rows.select("roi_id", *b.to_mip([(2, 2, 1)] * 3).columns("d"), *b.to_mip([(2, 2, 1)] * 2, down=False).columns("u"))


@query(f"WITH {_R} SELECT roi_id, CAST(floor(x0 / 8.0) AS BIGINT) AS vx, CAST(floor(y0 / 8.0) AS BIGINT) AS vy, CAST(floor(z0 / 40.0) AS BIGINT) AS vz, x0 / 1000.0::DOUBLE AS ux, y0 / 1000.0::DOUBLE AS uy, z0 / 1000.0::DOUBLE AS uz FROM r")
def box_units(spark, sf_dir):
    """Corners in voxels of 8 x 8 x 40 nm and in micrometers."""
    rows, b = regions(spark, sf_dir)
    return rows.select("roi_id", *[F.floor(c / F.lit(float(r))).cast("bigint").alias(f"v{d}") for d, c, r in zip(AXES, b.lo, (8, 8, 40))], *[(c / F.lit(1000.0)).alias(f"u{d}") for d, c in zip(AXES, b.lo)])


@query("SELECT file_id, x0, x1, y0, y1, z0, z1 FROM (SELECT DISTINCT file_id, CAST(b.x0 AS BIGINT) x0, CAST(b.x1 AS BIGINT) x1, CAST(b.y0 AS BIGINT) y0, CAST(b.y1 AS BIGINT) y1, CAST(b.z0 AS BIGINT) z0, CAST(b.z1 AS BIGINT) z1 FROM (SELECT file_id, regexp_extract(chunk_name, '^(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)(\\.gz|\\.br|\\.zstd)?$', ['x0','x1','y0','y1','z0','z1']) b FROM chunk_files WHERE regexp_matches(chunk_name, '^(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)(\\.gz|\\.br|\\.zstd)?$')))")
def box_from_filename(spark, sf_dir):
    t = table(spark, sf_dir, "chunk_files")
    return t.select("file_id", *Box.named(F.col("chunk_name")).columns()).dropna(subset=_BOX6).distinct()


@query(f"WITH {_R} SELECT min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, min(z0) AS z0, max(z1) AS z1 FROM r")
def box_hull(spark, sf_dir):
    from chunkloom.functions.boxes import hull_of

    rows, b = regions(spark, sf_dir)
    return rows.agg(*hull_of(b.lo, b.hi))


@query(f"WITH {_R} SELECT a.roi_id AS left_id, b.roi_id AS right_id FROM r a JOIN r b ON a.roi_id < b.roi_id AND " + " AND ".join(f"a.{d}0 < b.{d}1 AND a.{d}1 > b.{d}0" for d in AXES))
def box_overlap_join(spark, sf_dir):
    """Pairs of regions that intersect: an equi-join on tiles, each pair in one tile."""
    from chunkloom.operators.spatial import tile_join

    rows, _ = regions(spark, sf_dir)
    pairs = tile_join(rows.withColumnRenamed("roi_id", "label"), rows.withColumnRenamed("roi_id", "query_id"), (100_000, 100_000, 100_000))
    return pairs.where("label < query_id").select(F.col("label").alias("left_id"), F.col("query_id").alias("right_id")).distinct()


@query("SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM (SELECT unnest(range(-2, 5)) AS x), (SELECT unnest(range(0, 6)) AS y), (SELECT unnest(range(1, 4)) AS z)")
def grid_points(spark, sf_dir):
    table(spark, sf_dir, "region")
    return grid_rows(spark, (-2, 0, 1), (5, 6, 4))
