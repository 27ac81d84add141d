"""Schemas that drift between JSON documents: tagged-union inference and reports.

Each document is turned into the set of its leaf paths, every one tagged with the
type the value has there: its schema, a tagged union with one alternative per path.
Schemas fuse by path; alternatives of a path are kept side by side instead of being
widened away.  Fusing is associative, so partial schemas of parallel tasks fuse like
one.  From the fused schema of all documents follow a table with one typed branch per
alternative plus a canonical conversion, and the report of alternatives with the
version in which each first appears; from the fused schema of neighbouring versions
follow the changes: a path with alternatives on one side only came or went, one with
different tags on its sides is retyped.

Members may nest to any depth, which no built-in expression walks; so documents are
parsed in Arrow batches, once each, and everything after that is expressions.

Tags: boolean, integer (no fraction or exponent written), double, string, object
(empty), null, array<tag>; integers with doubles in one array make double, other
mixes are joined by '|', a tag of null elements vanishes beside others.

Defined cases: text that is no JSON, or JSON that is no object, is unreadable and
skipped (the next readable version is compared with the last readable one); null
documents, null layers and null version numbers are skipped; repeated deliveries
count once; NaN and Infinity are not JSON; of a member written twice the last holds;
a version number delivered with different contents is ordered by its content; arrays
are not entered; member names that contain dots are taken as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.session import cut

FIELDS = "array<struct<path: string, tag: string, value: string, text: string>>"


def _refuse(name: str) -> Any:
    raise ValueError(name)


def _tag(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "double"
    if isinstance(v, str):
        return "string"
    if isinstance(v, dict):
        return "object"
    return f"array<{_fuse([_tag(x) for x in v])}>"


def _fuse(tags: list[str]) -> str:
    """Tag of the elements of an array: the union of their tags."""
    seen = set(tags) - {"null"}
    if "double" in seen:
        seen.discard("integer")
    inner = [t[6:-1] for t in seen if t.startswith("array<")]
    if len(inner) > 1:
        seen = {t for t in seen if not t.startswith("array<")} | {f"array<{_fuse([x for t in inner for x in t.split('|')])}>"}
    return "|".join(sorted(seen)) if seen else ("null" if tags else "")


def _value(v: Any) -> str:
    """Text that is equal for equal values; numbers count by value."""
    if isinstance(v, bool) or v is None:
        return json.dumps(v)
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, str):
        return json.dumps(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_value(v[k])}" for k in sorted(v)) + "}"
    return "[" + ",".join(map(_value, v)) + "]"


def _leaves(doc: dict) -> Iterator[tuple[str, Any]]:
    stack = [("", doc)]
    while stack:
        prefix, node = stack.pop()
        for k, v in node.items():
            path = f"{prefix}.{k}" if prefix else k
            if isinstance(v, dict) and v:
                stack.append((path, v))
            else:
                yield path, v


def tagged_fields(text: str | None) -> list[tuple[str, str, str, str]] | None:
    """(path, tag, comparable value, text) of each leaf, or None if unreadable."""
    if text is None:
        return None
    try:
        doc = json.loads(text, parse_constant=_refuse)
        if not isinstance(doc, dict):
            return None
        found = {p: (p, _tag(v), _value(v), v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))) for p, v in _leaves(doc)}
    except (ValueError, OverflowError, RecursionError):
        return None
    return sorted(found.values())


def with_fields(docs: DataFrame, text: str, out: str = "fields") -> DataFrame:
    """Adds the tagged leaves of a JSON column as an array; null where unreadable."""

    @F.pandas_udf(FIELDS)
    def parse(texts: pd.Series) -> pd.Series:
        return pd.Series([tagged_fields(t) for t in texts], dtype=object)

    # not to be evaluated again for a filter on its result
    return docs.withColumn(out, parse.asNondeterministic()(F.col(text)))


def previous_version(versions: DataFrame, layer: str, order: str, payload: str, out: str) -> DataFrame:
    """Adds the payload of the layer's previous row, without one task per layer.

    Repeated rows count once.  Rows are range-partitioned by layer, version and content,
    so a layer that holds a third of all rows, whatever its numbers, is spread over many
    tasks.  They are chained within a range; the first of a range takes the last of the
    layer's previous range.
    """
    b = versions.withColumn("_tie", F.xxhash64(payload)).repartitionByRange(layer, order, "_tie").dropDuplicates([layer, order, "_tie"])
    b = cut(b.withColumn("_part", F.spark_partition_id()), "ranges")  # fixes the ranges
    w = Window.partitionBy(layer, "_part").orderBy(order, "_tie")
    chained = b.withColumn("_lag", F.lag(payload).over(w)).withColumn("_rn", F.row_number().over(w))
    # one row per range and layer that begins or ends in it; only layers of several ranges matter
    ends = b.groupBy(layer, "_part").agg(F.max(F.struct(order, "_tie")).alias("_end")).withColumn("_to", F.lead("_part").over(Window.partitionBy(layer).orderBy("_part"))).where("_to is not null")
    last = b.join(ends.select(layer, "_part", F.col(f"_end.{order}").alias(order), "_end._tie", "_to"), [layer, "_part", order, "_tie"])
    last = last.select(layer, F.col("_to").alias("_part"), F.lit(1).alias("_rn"), F.col(payload).alias("_prev"))
    return chained.join(last, [layer, "_part", "_rn"], "left").withColumn(out, F.coalesce("_lag", "_prev")).drop("_part", "_tie", "_lag", "_rn", "_prev")


def _by_path(fields: Column) -> Column:
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(f["path"], f)))


def fused_pair(rows: DataFrame, before: str, after: str, out: str = "fused") -> DataFrame:
    """Adds the fused schema of two documents: ``path`` with its alternative ``was`` in the
    one and ``now`` in the other, null where the path is not there."""
    keep = [c for c in rows.columns if c not in (before, after)]
    paths = F.array_union(F.transform(before, lambda f: f["path"]), F.transform(after, lambda f: f["path"]))
    rows = rows.select(*keep, _by_path(F.col(before)).alias("_was"), _by_path(F.col(after)).alias("_now"), paths.alias("_paths"))
    one = lambda p: F.struct(p.alias("path"), F.try_element_at("_was", p).alias("was"), F.try_element_at("_now", p).alias("now"))
    return rows.select(*keep, F.transform("_paths", one).alias(out))


def changes(docs: DataFrame, layer: str, version: str, text: str) -> DataFrame:
    """``layer, version, change_kind, field_path`` from each readable version to the next.

    Kinds: 'added', 'removed', 'renamed' (a path that is gone and a new one hold an
    equal value that is not null; the new path is named), 'retyped' (another tag in
    the same path, null on neither side).
    """
    rows = docs.select(F.col(layer).alias("layer"), F.col(version).alias("version"), F.col(text).alias("text")).where("layer is not null and version is not null and text is not null").distinct()
    schema = F.transform("fields", lambda f: F.struct(f["path"].alias("path"), f["tag"].alias("tag"), f["value"].alias("value")))
    # read more than once, so parsed once and written
    seen = cut(with_fields(rows, "text").where("fields is not null").select("layer", "version", schema.alias("fields")), "fields")
    both = previous_version(seen, "layer", "version", "fields", "before").where("before is not null")
    both = fused_pair(both, "before", "fields")
    alone = lambda here, there: F.transform(F.filter("fused", lambda f: f[here].isNotNull() & f[there].isNull()), lambda f: f[here])
    both = both.withColumn("gone", alone("was", "now")).withColumn("new", alone("now", "was"))

    def values(col: str) -> Column:
        return F.transform(F.filter(col, lambda f: f["tag"] != "null"), lambda f: f["value"])

    both = both.withColumn("shared", F.array_intersect(values("gone"), values("new")))
    moved = lambda f: (f["tag"] != "null") & F.array_contains("shared", f["value"])
    retyped = F.filter("fused", lambda f: (f["was"]["tag"] != f["now"]["tag"]) & (f["was"]["tag"] != "null") & (f["now"]["tag"] != "null"))

    def kind(name: str, fields: Column) -> Column:
        return F.transform(fields, lambda f: F.struct(F.lit(name).alias("change_kind"), f["path"].alias("field_path")))

    found = F.concat(kind("renamed", F.filter("new", moved)), kind("added", F.filter("new", lambda f: ~moved(f))), kind("removed", F.filter("gone", lambda f: ~moved(f))), kind("retyped", retyped))
    return both.select("layer", "version", F.explode(found).alias("c")).select("layer", "version", "c.*").distinct()


def fused_schema(docs: DataFrame, version: str, text: str, *by: str) -> DataFrame:
    """``field_path, tag, n_documents, first_version``: the fused, tagged schema, of all
    documents or for each value of the columns ``by``.

    Counts merge on the map side, so partial schemas of parallel tasks fuse like one.
    """
    rows = docs.select(*by, F.col(version).alias("version"), F.col(text).alias("text")).where("text is not null")
    one = with_fields(rows, "text").select(*by, "version", F.explode("fields").alias("f"))
    return one.groupBy(*by, F.col("f.path").alias("field_path"), F.col("f.tag").alias("tag")).agg(F.count("*").alias("n_documents"), F.min("version").alias("first_version"))


def appearing(docs: DataFrame, layer: str, version: str, text: str) -> DataFrame:
    """``layer, field_path, tag, first_version, n_tags``: when each alternative of a layer's
    paths first appears, and how many its path has in all."""
    rows = docs.where(F.col(layer).isNotNull() & F.col(version).isNotNull()).select(layer, version, text).distinct()
    schema = fused_schema(rows, version, text, layer)
    tags = schema.groupBy(layer, "field_path").agg(F.count("*").alias("n_tags"))
    return schema.join(tags, [layer, "field_path"]).select(F.col(layer).alias("layer"), "field_path", "tag", "first_version", "n_tags")


#: Kinds of branch: which typed column of the unified table a tag goes to.
BRANCHES = {"boolean": "boolean", "integer": "bigint", "double": "double", "string": "string"}


def typed_branches(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per key and path: the value in the branch of its type, and canonically.

    ``as_boolean, as_integer, as_double, as_string, as_json`` hold the value as it was
    written, in just one of them; ``canonical_numbers`` (array<double>) is the common
    conversion of numbers, arrays of numbers or of numeric texts (nested ones
    flattened) and comma-separated texts, null where there is none.
    """
    rows = docs.select(*keys, F.col(text).alias("_text")).where("_text is not null").distinct()
    one = with_fields(rows, "_text", "_fields").select(*keys, F.explode("_fields").alias("f"))
    tag, txt = F.col("f.tag"), F.col("f.text")
    numeric = r"[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
    plain = F.regexp_replace(txt, r'[\[\]"\s]', "")
    numbers = F.when(plain.rlike(f"^{numeric}(,{numeric})*$"), F.split(plain, ",").cast("array<double>"))
    return one.select(
        *keys,
        F.col("f.path").alias("field_path"),
        tag.alias("tag"),
        F.when(tag == "boolean", txt == "true").alias("as_boolean"),
        F.when(tag == "integer", txt).try_cast("bigint").alias("as_integer"),
        F.when(tag == "double", txt).try_cast("double").alias("as_double"),
        F.when(tag == "string", txt).alias("as_string"),
        F.when(~tag.isin("boolean", "integer", "double", "string", "null"), txt).alias("as_json"),
        F.when(tag != "boolean", numbers).alias("canonical_numbers"),
    )
