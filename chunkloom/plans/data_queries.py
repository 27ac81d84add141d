"""Queries of the data-processing problems 1 to 6, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import units
from chunkloom.operators import compaction, flatten, proximity, schema_drift, selection, unit_norm
from chunkloom.session import cut, table

QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]
NEAR_NM = 120.0


def label_file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "file_lookup").select("label", "fid").dropna().distinct(), "pairs")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = selection.heavy_keys(label_file_pairs(spark, sf_dir), ["label", "fid"], 6, 1000)
    return heavy.select(F.col("field").alias("key_field"), F.col("value").alias("key_value"))


def _quantiles(spark: SparkSession, sf_dir: str, key: str, value: str) -> DataFrame:
    q = selection.key_quantiles(label_file_pairs(spark, sf_dir), key, value, QUARTILES)
    return q.select(F.col("key").alias(key), F.col("n").alias("n_values"), *[F.col(f"q{i}") for i in range(len(QUARTILES))])


def p1_label_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantiles(spark, sf_dir, "label", "fid")


def p1_fid_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantiles(spark, sf_dir, "fid", "label")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = proximity.usable_points(table(spark, sf_dir, "annotations"), "ids", "geometry")
    boxes = table(spark, sf_dir, "rois").withColumnRenamed("roi_id", "box_id")
    found = proximity.radius_join(points, NEAR_NM, boxes)
    return found.select(F.col("kind").alias("pair_kind"), "left_id", "right_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schema_drift.changes(table(spark, sf_dir, "n5_attributes"), "layer_id", "version_no", "attributes")
    return found.select(F.col("layer").alias("layer_id"), F.col("version").alias("version_no"), "change_kind", "field_path")


def p3_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused schema: alternatives per path, documents, version of first appearance."""
    docs = table(spark, sf_dir, "n5_attributes").select("file_id", "version_no", "attributes").distinct()
    return schema_drift.fused_schema(docs, "version_no", "attributes")


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consistent table: each value in its typed branch and in canonical form."""
    return _branches(spark, sf_dir).withColumn("as_boolean", F.col("as_boolean").cast("int")).drop("canonical_numbers")


def p3_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its canonical conversion: the numbers of every value that holds any, by place."""
    return _branches(spark, sf_dir).select("file_id", "layer_id", "version_no", "field_path", F.posexplode("canonical_numbers").alias("pos", "number")).distinct()


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.typed_branches(table(spark, sf_dir, "n5_attributes"), ["file_id", "layer_id", "version_no"], "attributes")


def p3_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each typed alternative of a layer's paths first appears."""
    found = schema_drift.appearing(table(spark, sf_dir, "n5_attributes"), "layer_id", "version_no", "attributes")
    return found.withColumnRenamed("layer", "layer_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.flat_nodes(table(spark, sf_dir, "zarr3_metadata"), "zinfo", "rec_id")


def _nested_table(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten.flat_tables(table(spark, sf_dir, "zarr3_metadata"), "zinfo", "rec_id")[name]

    query.__name__, query.__doc__ = f"p4_{name}", f"The table of {name.replace('_', ' ')}, with the positions of its parents."
    return query


p4_multiscales, p4_axes, p4_datasets, p4_transforms, p4_transform_values = map(_nested_table, flatten.TABLES)


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_norm.recordings(*[table(spark, sf_dir, n) for n in ("zarr2_axes", "zarr3_metadata", "sharded_info")])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_norm.disagreements(_recordings(spark, sf_dir)).select("layer_id", "mip", "axis_name")


def p5_nanometers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recordings in nanometers, rounded to a picometer's thousandth."""
    r = _recordings(spark, sf_dir)
    return r.select("layer_id", "mip", "axis_name", "origin", F.round("common_value", 6).alias("size_nm")).distinct()


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compact_chunks(spark, f"{sf_dir}/chunk_files.parquet", table(spark, sf_dir, "sharded_info"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("layer_id", "mip", *[F.col(g).cast("int").alias(g) for g in ("gx", "gy", "gz")], "shard").distinct()


def p6_shard_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each shard consists of: chunks and bytes, counting each chunk's last object."""
    c = _chunks(spark, sf_dir).groupBy("layer_id", "mip", "shard")
    return c.agg(F.count("*").alias("n_chunks"), F.sum("n_bytes").cast("bigint").alias("n_bytes"))


QUERIES = {f.__name__: f for f in (p1_found, p1_label_quantiles, p1_fid_quantiles, p2_found, p3_found, p3_schema, p3_table, p3_numbers, p3_alternatives, p4_found, p4_multiscales, p4_axes, p4_datasets, p4_transforms, p4_transform_values, p5_found, p5_nanometers, p6_found, p6_shard_contents)}

_PAIRS = "pairs AS (SELECT DISTINCT label, fid FROM file_lookup WHERE label IS NOT NULL AND fid IS NOT NULL)"


def _quantile_sql(key: str, value: str) -> str:
    pick = ", ".join(f"max(CASE WHEN r = greatest(1, CAST(ceil(n * {p}) AS BIGINT)) THEN v END) AS q{i}" for i, p in enumerate(QUARTILES))
    return f"""WITH {_PAIRS}, ranked AS (SELECT {key} AS k, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS r, count(*) OVER (PARTITION BY {key}) AS n FROM pairs)
SELECT k AS {key}, max(n) AS n_values, {pick} FROM ranked GROUP BY k"""


_CHUNK_SQL = r"""WITH spec AS (
  SELECT DISTINCT layer_id, mip, voxel_offset[1] ox, voxel_offset[2] oy, voxel_offset[3] oz, CAST(chunk_sizes[1][1] AS BIGINT) cx, CAST(chunk_sizes[1][2] AS BIGINT) cy, CAST(chunk_sizes[1][3] AS BIGINT) cz,
    volume_size[1] sx, volume_size[2] sy, volume_size[3] sz, sharding.preshift_bits pre, sharding.minishard_bits mini, sharding.shard_bits shb
  FROM sharded_info WHERE sharding IS NOT NULL AND layer_id IS NOT NULL AND mip IS NOT NULL),
named AS (
  SELECT DISTINCT file_id, layer_id, mip, n_bytes, written_at, regexp_extract(chunk_name, '^(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)(\.gz|\.br|\.zstd)?$', ['x0','x1','y0','y1','z0','z1']) b
  FROM chunk_files WHERE n_bytes > 0 AND regexp_matches(chunk_name, '^(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)_(-?[0-9]+)-(-?[0-9]+)(\.gz|\.br|\.zstd)?$')),
boxed AS (SELECT file_id, layer_id, mip, n_bytes, written_at, CAST(b.x0 AS BIGINT) x0, CAST(b.x1 AS BIGINT) x1, CAST(b.y0 AS BIGINT) y0, CAST(b.y1 AS BIGINT) y1, CAST(b.z0 AS BIGINT) z0, CAST(b.z1 AS BIGINT) z1 FROM named),
gridded AS (
  SELECT *, (x0 - ox) // cx gx, (y0 - oy) // cy gy, (z0 - oz) // cz gz, (sx + cx - 1) // cx nx, (sy + cy - 1) // cy ny, (sz + cz - 1) // cz nz FROM boxed JOIN spec USING (layer_id, mip)
  WHERE x0 >= ox AND x0 < ox + sx AND (x0 - ox) % cx = 0 AND x1 = least(x0 + cx, ox + sx) AND y0 >= oy AND y0 < oy + sy AND (y0 - oy) % cy = 0 AND y1 = least(y0 + cy, oy + sy)
    AND z0 >= oz AND z0 < oz + sz AND (z0 - oz) % cz = 0 AND z1 = least(z0 + cz, oz + sz)),
counted AS (SELECT *, CASE WHEN nx > 1 THEN length(bin(nx - 1)) ELSE 0 END hx, CASE WHEN ny > 1 THEN length(bin(ny - 1)) ELSE 0 END hy, CASE WHEN nz > 1 THEN length(bin(nz - 1)) ELSE 0 END hz FROM gridded),
coded AS (SELECT *, CAST(coalesce(list_sum(list_transform(range(0, hx), lambda i: ((gx >> i) & 1) << CAST(least(i, hx) + least(i, hy) + least(i, hz) AS INT))), 0) AS BIGINT)
  + CAST(coalesce(list_sum(list_transform(range(0, hy), lambda i: ((gy >> i) & 1) << CAST(least(i, hx) + least(i, hy) + least(i, hz) + CASE WHEN i < hx THEN 1 ELSE 0 END AS INT))), 0) AS BIGINT)
  + CAST(coalesce(list_sum(list_transform(range(0, hz), lambda i: ((gz >> i) & 1) << CAST(least(i, hx) + least(i, hy) + least(i, hz) + CASE WHEN i < hx THEN 1 ELSE 0 END + CASE WHEN i < hy THEN 1 ELSE 0 END AS INT))), 0) AS BIGINT) AS code FROM counted),
placed AS (SELECT *, lower(to_hex((code >> (pre + mini)) & ((1 << shb) - 1))) h, CAST(ceil(shb / 4.0) AS INT) w FROM coded),
chunks AS (SELECT layer_id, mip, gx, gy, gz, CASE WHEN length(h) < w THEN lpad(h, w, '0') ELSE h END AS shard, file_id, n_bytes, written_at FROM placed)
"""

_LEAVES = r"""read AS (SELECT DISTINCT file_id, layer_id, version_no, attributes FROM n5_attributes WHERE json_valid(attributes) AND json_type(attributes) = 'OBJECT'),
tree AS (SELECT read.*, replace(substr(j.fullkey, 3), '"', '') AS field_path, j.type AS kind, CAST(json(j.value) AS VARCHAR) AS value FROM read, json_tree(read.attributes) j WHERE j.key IS NOT NULL AND NOT contains(j.fullkey, '[')),
leaf AS (SELECT file_id, layer_id, version_no, attributes, field_path, kind, value, regexp_replace(value, '"(?:[^"\\]|\\.)*"', 's', 'g') AS bare FROM tree WHERE kind <> 'OBJECT' OR value = '{}'),
token AS (SELECT *, length(regexp_extract(bare, '^\[*')) AS depth, CASE WHEN kind = 'ARRAY' THEN regexp_extract_all(bare, '[-0-9.eE+]+|s|true|false|null') END AS words FROM leaf),
named AS (SELECT *, list_sort(list_distinct(list_transform(words, lambda w: CASE WHEN w = 's' THEN 'string' WHEN w IN ('true', 'false') THEN 'boolean' WHEN w = 'null' THEN 'null' WHEN regexp_matches(w, '[.eE]') THEN 'double' ELSE 'integer' END))) AS kinds FROM token),
fused AS (SELECT *, CASE WHEN len(kinds) > 1 THEN list_filter(kinds, lambda k: k <> 'null' AND NOT (k = 'integer' AND list_contains(kinds, 'double'))) ELSE kinds END AS alternatives FROM named),
tagged AS (SELECT file_id, layer_id, version_no, attributes, field_path, value, CASE kind WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null'
  ELSE concat(repeat('array<', depth), array_to_string(alternatives, '|'), repeat('>', depth)) END AS tag FROM fused)"""


def _member(e: str, name: str, otherwise: str = "''") -> str:
    """A scalar member of a JSON value as text."""
    return f"CASE WHEN json_type({e}, '$.{name}') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') THEN json_extract_string({e}, '$.{name}') ELSE {otherwise} END"


def _unwrapped(e: str) -> str:
    """A JSON value, parsed once more if it is a string."""
    return f"CASE WHEN json_type({e}) <> 'VARCHAR' THEN {e} WHEN json_valid(json_extract_string({e}, '$')) THEN CAST(json_extract_string({e}, '$') AS JSON) END"


def _children(parent: str, keys: str, member: str, pos: str) -> str:
    """Entries of a member that is a list, or one value in place of a list, with their positions."""
    lst = f"CASE WHEN json_type({member}) = 'ARRAY' THEN json_extract({member}, '$[*]') WHEN {member} IS NOT NULL AND json_type({member}) <> 'NULL' THEN [{member}] END"
    return f"SELECT {keys}, CAST(i - 1 AS INTEGER) AS {pos}, l[i] AS e FROM (SELECT {keys}, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {keys}, {lst} AS l FROM {parent}))"


def _nested_sql(key: str) -> str:
    """CTEs ms, ax, ds, tr, va: the levels of the readable documents."""
    return f"""d AS (SELECT DISTINCT {key}, zinfo FROM zarr3_metadata WHERE json_valid(zinfo) AND json_type(zinfo) = 'OBJECT'),
a AS (SELECT {key}, {_unwrapped("x")} AS a FROM (SELECT {key}, json_extract(zinfo, '$.attributes') AS x FROM d)), o AS (SELECT {key}, a, {_unwrapped("x")} AS o FROM (SELECT {key}, a, json_extract(a, '$.ome') AS x FROM a)),
m AS (SELECT {key}, CASE WHEN coalesce(json_type(o, '$.multiscales'), 'NULL') <> 'NULL' THEN json_extract(o, '$.multiscales') ELSE json_extract(a, '$.multiscales') END AS m FROM o),
ms AS (SELECT * FROM ({_children("m", key, "m", "multiscale_pos")}) WHERE json_type(e) <> 'NULL'),
ax AS (SELECT * FROM ({_children("ms", key + ", multiscale_pos", "json_extract(e, '$.axes')", "item_pos")}) WHERE json_type(e) <> 'NULL'),
ds AS (SELECT * FROM ({_children("ms", key + ", multiscale_pos", "json_extract(e, '$.datasets')", "item_pos")}) WHERE json_type(e) <> 'NULL'),
tr AS (SELECT * FROM ({_children(f"(SELECT {key}, multiscale_pos, -1 AS item_pos, e FROM ms UNION ALL SELECT {key}, multiscale_pos, item_pos, e FROM ds)", key + ", multiscale_pos, item_pos", "json_extract(e, '$.coordinateTransformations')", "transform_pos")}) WHERE json_type(e) <> 'NULL'),
va AS ({_children("tr", key + ", multiscale_pos, item_pos, transform_pos", "CASE WHEN coalesce(json_type(e, '$.scale'), 'NULL') <> 'NULL' THEN json_extract(e, '$.scale') ELSE json_extract(e, '$.translation') END", "value_pos")})"""


_AXIS_NAME = f"CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') ELSE {_member('e', 'name')} END"
_NESTED = _nested_sql("rec_id")


def _in_note(text: str, group: int) -> str:
    """Of the first number with a unit in a text the number (1) or the unit (2); 0: the first unit alone."""
    names = units._names("length")
    pattern = rf"(?i)(?:^|[^\p{{L}}0-9.,])({units.NUMBER})\s*({names})(?:$|[^\p{{L}}])" if group else rf"(?i)(?:^|[^\p{{L}}])({names})(?:$|[^\p{{L}}])"
    return f"regexp_extract({text}, '{pattern}', {group or 1})"


_RECORDED = f"""{_NESTED}, alias AS (SELECT * FROM (VALUES {", ".join(f"('{a}', CAST({f!r} AS DOUBLE))" for a, f, _ in units.aliases("length"))}) AS t(alias, factor)),
z2 AS (SELECT DISTINCT layer_id, mip, lower(trim(axis_name)) AS axis_name, nullif(trim(unit), '') AS stated, CASE WHEN NOT isnan(scale_value) THEN scale_value END AS v, note FROM zarr2_axes),
r2 AS (SELECT layer_id, mip, axis_name, CASE WHEN v IS NULL AND stated IS NULL THEN TRY_CAST(replace({_in_note("note", 1)}, ',', '.') AS DOUBLE) ELSE v END AS value,
  coalesce(stated, nullif(CASE WHEN v IS NULL THEN {_in_note("note", 2)} ELSE {_in_note("note", 0)} END, ''), 'nm') AS unit, 'zarr2' AS origin FROM z2),
doc AS (SELECT DISTINCT rec_id, layer_id FROM zarr3_metadata),
axis3 AS (SELECT rec_id, item_pos AS i, lower(trim(CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') ELSE {_member("e", "name", "NULL")} END)) AS axis_name, {_member("e", "unit", "NULL")} AS unit FROM ax WHERE multiscale_pos = 0),
step3 AS (SELECT rec_id, item_pos AS mip, arg_min(CAST(json_extract(e, '$.scale') AS VARCHAR), transform_pos) AS s FROM tr WHERE multiscale_pos = 0 AND item_pos >= 0 AND json_extract_string(e, '$.type') = 'scale' GROUP BY 1, 2),
r3 AS (SELECT layer_id, mip, axis_name, TRY_CAST(json_extract_string(s, concat('$[', i, ']')) AS DOUBLE) AS value, coalesce(nullif(trim(unit), ''), 'nm') AS unit, 'zarr3' AS origin FROM step3 JOIN axis3 USING (rec_id) JOIN doc USING (rec_id)),
sh AS (SELECT DISTINCT layer_id, mip, coalesce(resolution, CASE WHEN len(string_split(scale_key, '_')) = 3 THEN list_transform(string_split(scale_key, '_'), lambda t: TRY_CAST(t AS DOUBLE)) END) AS r, description FROM sharded_info),
rs AS (SELECT layer_id, mip, unnest(['x', 'y', 'z']) AS axis_name, unnest([r[1], r[2], r[3]]) AS value, coalesce(nullif({_in_note("description", 0)}, ''), 'nm') AS unit, 'sharded' AS origin FROM sh),
every AS (SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM rs),
recorded AS (SELECT layer_id, mip, axis_name, value * factor AS nm, origin FROM every JOIN alias ON translate(lower(regexp_replace(unit, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')), '\u03bc\u212b', '\u00b5\u00e5') = alias
  WHERE axis_name IN ('x', 'y', 'z') AND value > 0 AND NOT isnan(value) AND value < CAST('infinity' AS DOUBLE) AND layer_id IS NOT NULL AND mip IS NOT NULL)"""

_TEXTS = "texts AS (SELECT DISTINCT file_id, layer_id, version_no, attributes, field_path, tag, CASE WHEN tag = 'string' THEN json_extract_string(value, '$') ELSE value END AS txt FROM tagged)"

ORACLE = {
    "p3_found": rf"""WITH {_LEAVES}, plain AS (SELECT DISTINCT layer_id, version_no, field_path, tag, CASE WHEN tag IN ('integer', 'double') THEN CAST(CAST(value AS DOUBLE) AS VARCHAR) WHEN starts_with(tag, 'array') THEN regexp_replace(value, '\.0+([,\]])', '\1', 'g') ELSE value END AS value FROM tagged WHERE layer_id IS NOT NULL AND version_no IS NOT NULL),
version AS (SELECT layer_id, version_no, lag(version_no) OVER (PARTITION BY layer_id ORDER BY version_no) AS before FROM (SELECT DISTINCT layer_id, version_no FROM read WHERE layer_id IS NOT NULL AND version_no IS NOT NULL)),
now AS (SELECT layer_id, version_no, field_path, tag, value FROM version JOIN plain USING (layer_id, version_no) WHERE before IS NOT NULL),
was AS (SELECT v.layer_id, v.version_no, p.field_path, p.tag, p.value FROM version v JOIN plain p ON p.layer_id = v.layer_id AND p.version_no = v.before),
new AS (SELECT * FROM now ANTI JOIN was USING (layer_id, version_no, field_path)), gone AS (SELECT * FROM was ANTI JOIN now USING (layer_id, version_no, field_path)),
moved AS (SELECT DISTINCT layer_id, version_no, new.field_path AS to_path, gone.field_path AS from_path FROM new JOIN gone USING (layer_id, version_no, value) WHERE new.tag <> 'null' AND gone.tag <> 'null')
SELECT DISTINCT layer_id, version_no, 'renamed' AS change_kind, to_path AS field_path FROM moved
UNION ALL SELECT layer_id, version_no, 'added', field_path FROM new ANTI JOIN moved ON new.layer_id = moved.layer_id AND new.version_no = moved.version_no AND field_path = to_path
UNION ALL SELECT layer_id, version_no, 'removed', field_path FROM gone ANTI JOIN moved ON gone.layer_id = moved.layer_id AND gone.version_no = moved.version_no AND field_path = from_path
UNION ALL SELECT layer_id, version_no, 'retyped', field_path FROM now JOIN was USING (layer_id, version_no, field_path) WHERE now.tag <> was.tag AND now.tag <> 'null' AND was.tag <> 'null'""",
    "p3_schema": f"""WITH {_LEAVES} SELECT field_path, tag, count(*) AS n_documents, min(version_no) AS first_version FROM tagged GROUP BY 1, 2""",
    "p3_table": rf"""WITH {_LEAVES}, {_TEXTS} SELECT file_id, layer_id, version_no, field_path, tag, CASE WHEN tag = 'boolean' THEN CAST(txt = 'true' AS INTEGER) END AS as_boolean, CASE WHEN tag = 'integer' THEN TRY_CAST(txt AS BIGINT) END AS as_integer, CASE WHEN tag = 'double' THEN TRY_CAST(txt AS DOUBLE) END AS as_double, CASE WHEN tag = 'string' THEN txt END AS as_string,
  CASE WHEN tag NOT IN ('boolean', 'integer', 'double', 'string', 'null') THEN txt END AS as_json FROM texts""",
    "p3_numbers": rf"""WITH {_LEAVES}, {_TEXTS}, bare AS (SELECT *, string_split(regexp_replace(txt, '[\[\]"\s]', '', 'g'), ',') AS parts FROM texts WHERE tag <> 'boolean' AND regexp_matches(regexp_replace(txt, '[\[\]"\s]', '', 'g'), '^[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?(,[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)*$'))
SELECT DISTINCT file_id, layer_id, version_no, field_path, CAST(i - 1 AS INTEGER) AS pos, CAST(parts[i] AS DOUBLE) AS number FROM bare, (SELECT unnest(range(1, 1001)) AS i) WHERE i <= len(parts)""",
    "p3_alternatives": f"""WITH {_LEAVES}, a AS (SELECT layer_id, field_path, tag, min(version_no) AS first_version FROM tagged WHERE layer_id IS NOT NULL AND version_no IS NOT NULL GROUP BY 1, 2, 3)
SELECT layer_id, field_path, tag, first_version, count(*) OVER (PARTITION BY layer_id, field_path) AS n_tags FROM a""",
    "p1_found": f"""WITH {_PAIRS}, n AS (SELECT count(*) AS n FROM pairs)
SELECT 'label' AS key_field, label AS key_value FROM pairs, n GROUP BY label, n.n HAVING count(*) * 1000 >= n.n * 6
UNION ALL SELECT 'fid', fid FROM pairs, n GROUP BY fid, n.n HAVING count(*) * 1000 >= n.n * 6""",
    "p1_label_quantiles": _quantile_sql("label", "fid"),
    "p1_fid_quantiles": _quantile_sql("fid", "label"),
    "p2_found": """WITH p AS (SELECT DISTINCT ids AS id, geometry[1]::DOUBLE x, geometry[2]::DOUBLE y, geometry[3]::DOUBLE z FROM annotations
  WHERE ids IS NOT NULL AND len(geometry) = 3 AND isfinite(geometry[1]) AND isfinite(geometry[2]) AND isfinite(geometry[3])),
g AS (SELECT *, CAST(floor(x / 120) AS BIGINT) gx, CAST(floor(y / 120) AS BIGINT) gy, CAST(floor(z / 120) AS BIGINT) gz FROM p),
d AS (SELECT unnest([-1, 0, 1]) AS o),
s AS (SELECT id, x, y, z, gx + a.o AS gx, gy + b.o AS gy, gz + c.o AS gz FROM g, d a, d b, d c),
r AS (SELECT DISTINCT roi_id, least(x0, x1) x0, greatest(x0, x1) x1, least(y0, y1) y0, greatest(y0, y1) y1, least(z0, z1) z0, greatest(z0, z1) z1 FROM rois WHERE x0 + x1 + y0 + y1 + z0 + z1 IS NOT NULL)
SELECT DISTINCT 'near' AS pair_kind, g.id AS left_id, s.id AS right_id FROM g JOIN s USING (gx, gy, gz) WHERE g.id < s.id AND (g.x - s.x) * (g.x - s.x) + (g.y - s.y) * (g.y - s.y) + (g.z - s.z) * (g.z - s.z) <= 14400
UNION ALL SELECT DISTINCT 'inside', roi_id, id FROM p JOIN r ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1""",
    "p4_found": f"""WITH {_NESTED} SELECT DISTINCT * FROM (SELECT rec_id, 'multiscale' AS node_kind, multiscale_pos, -1 AS item_pos, -1 AS transform_pos, {_member("e", "name")} AS node_name FROM ms
UNION ALL SELECT rec_id, 'axis', multiscale_pos, item_pos, -1, {_AXIS_NAME} FROM ax UNION ALL SELECT rec_id, 'dataset', multiscale_pos, item_pos, -1, {_member("e", "path")} FROM ds
UNION ALL SELECT rec_id, 'transform', multiscale_pos, item_pos, transform_pos, {_member("e", "type")} FROM tr)""",
    "p4_multiscales": f"WITH {_NESTED} SELECT DISTINCT rec_id, multiscale_pos, {_member('e', 'name')} AS name FROM ms",
    "p4_axes": f"WITH {_NESTED} SELECT DISTINCT rec_id, multiscale_pos, item_pos AS axis_pos, {_AXIS_NAME} AS name, {_member('e', 'type', 'NULL')} AS type, {_member('e', 'unit', 'NULL')} AS unit FROM ax",
    "p4_datasets": f"WITH {_NESTED} SELECT DISTINCT rec_id, multiscale_pos, item_pos AS dataset_pos, {_member('e', 'path')} AS path FROM ds",
    "p4_transforms": f"WITH {_NESTED} SELECT DISTINCT rec_id, multiscale_pos, item_pos AS dataset_pos, transform_pos, {_member('e', 'type')} AS type FROM tr",
    "p4_transform_values": f"WITH {_NESTED} SELECT DISTINCT rec_id, multiscale_pos, item_pos AS dataset_pos, transform_pos, value_pos, CAST(e AS DOUBLE) AS value FROM va WHERE json_type(e) IN ('UBIGINT', 'BIGINT', 'DOUBLE')",
    "p5_found": f"WITH {_RECORDED} SELECT layer_id, CAST(mip AS INTEGER) AS mip, axis_name FROM recorded GROUP BY ALL HAVING max(nm) > min(nm) * 1.01",
    "p5_nanometers": f"WITH {_RECORDED} SELECT DISTINCT layer_id, CAST(mip AS INTEGER) AS mip, axis_name, origin, round(nm, 6) AS size_nm FROM recorded",
    "p6_found": _CHUNK_SQL + "SELECT DISTINCT layer_id, mip, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, CAST(gz AS INT) AS gz, shard FROM chunks",
    "p6_shard_contents": _CHUNK_SQL
    + """, kept AS (SELECT layer_id, mip, gx, gy, gz, shard, n_bytes, row_number() OVER (PARTITION BY layer_id, mip, gx, gy, gz ORDER BY written_at DESC NULLS LAST, file_id DESC, n_bytes DESC) AS rn FROM chunks)
SELECT layer_id, mip, shard, count(*) AS n_chunks, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM kept WHERE rn = 1 GROUP BY layer_id, mip, shard""",
}
