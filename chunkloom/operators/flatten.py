"""Flat tables from deeply nested records, by list offsets and parent indices.

The JSON text is first normalised inside the JVM, as a variant, to one nested Arrow
shape (single objects become arrays of one, null entries keep their place).  The
flattening itself never looks at a row: for every level the child array is the flat
values buffer of the list, the parent of each child comes from the list offsets
(``list_parent_indices``), positions are the child's index minus its list's first
offset, and keys of the parents are propagated by a vectorised ``take``.

Defined cases: text that is no JSON or no JSON object gives no rows, nor do groups
without multiscales; of OME members under ``attributes.ome`` and ``attributes`` the
former win; ``attributes`` and ``attributes.ome`` may be JSON in a string; one object
in place of an array is an array of one; null entries keep their position and give no
row; a missing, null or non-scalar name is ''; entries that are no object (axes: no
object and no string) have the name ''; rows with a null key keep it; repeated rows
count once in ``flat_nodes``; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.session import cut


def _shape(full: bool) -> str:
    """The nested shape that documents are normalised to; ``full`` with all columns of TABLES."""
    t = "struct<name: string" + (", values: array<double>>" if full else ">")
    axis = "struct<name: string" + (", type: string, unit: string>" if full else ">")
    return f"array<struct<name: string, axes: array<{axis}>, datasets: array<struct<name: string, transforms: array<{t}>>>, transforms: array<{t}>>>"


def once(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """``keep`` and new columns, each evaluated once per row.

    The generator keeps the optimizer from copying the expressions into every place
    that uses them, which for nested parsing multiplies work and generated code.
    """
    return df.select(*keep, F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_once")).select(*keep, "_once.*")


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _real(v: Column) -> Column:
    """The variant, or SQL null where it is a JSON null."""
    return F.when(v.isNotNull() & ~F.is_variant_null(v), v)


def _list(v: Column) -> Column:
    """array<variant> of an array; an array of one of any other value; null of null."""
    return F.when(_is(v, "ARRAY"), _get(v, "$", "array<variant>")).when(_real(v).isNotNull(), F.array(v))


def _objects_in_text(v: Column) -> Column:
    """A string member is parsed once more."""
    return F.when(_is(v, "STRING"), F.try_parse_json(_get(v, "$", "string"))).otherwise(v)


def _name(v: Column, member: str) -> Column:
    return F.coalesce(_get(v, f"$.{member}", "string"), F.lit(""))


def _entries(v: Column, make) -> Column:
    """Array of structs; null (kept) where the entry is null."""
    return F.transform(_list(v), lambda e: F.when(_real(e).isNotNull(), make(e)))


def _transforms(v: Column, full: bool) -> Column:
    return _entries(_get(v, "$.coordinateTransformations"), lambda t: F.struct(_name(t, "type").alias("name"), *([_numbers(t).alias("values")] if full else [])))


def _numbers(t: Column) -> Column:
    """The numbers of a scale or translation; what is no number is null and keeps its place."""
    of = F.coalesce(_real(_get(t, "$.scale")), _real(_get(t, "$.translation")))
    return F.transform(_list(of), lambda v: F.when(~_is(v, "STRING"), _get(v, "$", "double")))


def multiscales_of(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys`` and the variant ``_m`` of each readable document's multiscales."""
    v = once(docs, keys, _v=F.try_parse_json(F.col(text))).where("_v is not null")
    v = once(v, keys, _a=F.when(_is(F.col("_v"), "OBJECT"), _objects_in_text(_get(F.col("_v"), "$.attributes"))))
    v = once(v, keys, _n=_real(_get(F.col("_a"), "$.multiscales")), _o=_objects_in_text(_get(F.col("_a"), "$.ome")))
    return once(v, keys, _m=F.coalesce(_real(_get(F.col("_o"), "$.multiscales")), F.col("_n"))).where("_m is not null")


def nested_multiscales(docs: DataFrame, text: str, keys: list[str], full: bool = True) -> DataFrame:
    """``keys`` and the normalised multiscales of each readable document."""
    v = multiscales_of(docs, text, keys)
    axis = lambda e: F.struct(F.when(_is(e, "STRING"), _get(e, "$", "string")).otherwise(_name(e, "name")).alias("name"), *[_get(e, f"$.{m}", "string").alias(m) for m in ("type", "unit") if full])
    one = lambda m: F.struct(
        _name(m, "name").alias("name"),
        _entries(_get(m, "$.axes"), axis).alias("axes"),
        _entries(_get(m, "$.datasets"), lambda d: F.struct(_name(d, "path").alias("name"), _transforms(d, full).alias("transforms"))).alias("datasets"),
        _transforms(m, full).alias("transforms"),
    )
    return v.select(*keys, _entries(F.col("_m"), one).cast(_shape(full)).alias("multiscales"))


class Level:
    """The entries of one nesting level with the columns inherited from above."""

    def __init__(self, values: pa.Array, inherited: dict[str, pa.Array]) -> None:
        self.values, self.inherited = values, inherited

    def child(self, lists: pa.ListArray, position: str) -> Level:
        """Entries of a list column: its flat buffer, with keys taken by parent index."""
        parent = pc.list_parent_indices(lists)
        # offsets of the entries' own lists; null and empty lists have no entries
        starts = pc.cast(pc.subtract(pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)), pc.fill_null(pc.list_value_length(lists), 0)), pa.int64())
        flat = pc.list_flatten(lists)
        index = pa.array(range(0), pa.int64()) if not len(flat) else pa.array(_arange(len(flat)))
        pos = pc.cast(pc.subtract(index, pc.take(starts, parent)), pa.int32())
        inherited = {k: pc.take(c, parent) for k, c in self.inherited.items()}
        valid = pc.is_valid(flat)
        return Level(flat.filter(valid), {k: c.filter(valid) for k, c in (inherited | {position: pos}).items()})

    def field(self, name: str) -> pa.Array:
        return pc.struct_field(self.values, name)


def _arange(n: int):
    import numpy as np

    return np.arange(n, dtype=np.int64)


def _plain(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _levels(batch: pa.RecordBatch, keys: list[str]) -> dict[str, list[Level]]:
    """The levels of a batch by table; transforms hang on multiscales and on datasets."""
    at = {n: _plain(batch.column(i)) for i, n in enumerate(batch.schema.names)}
    top = Level(at["multiscales"], {k: at[k] for k in keys})
    m = top.child(at["multiscales"], "multiscale_pos")
    axes, sets = m.child(m.field("axes"), "item_pos"), m.child(m.field("datasets"), "item_pos")
    steps = [m.child(m.field("transforms"), "transform_pos"), sets.child(sets.field("transforms"), "transform_pos")]
    return {"multiscale": [m], "axis": [axes], "dataset": [sets], "transform": steps}


def _flatten_batch(batch: pa.RecordBatch, keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for kind, levels in _levels(batch, keys).items():
        for level in levels:
            n = len(level.values)
            if n:
                minus = pa.array(_arange(n) * 0 - 1).cast(pa.int32())
                cols = level.inherited | {"node_kind": pa.array([kind]).take(pa.array(_arange(n) * 0)), "node_name": level.field("name")}
                yield pa.RecordBatch.from_arrays([cols.get(f.name, minus).cast(f.type) for f in schema], schema=schema)


#: The related tables: level, then column -> (where it comes from, type).  Positions lead
#: from a row to its parents.
TABLES: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "multiscales": ("multiscale", {"multiscale_pos": ("multiscale_pos", "int"), "name": ("name", "string")}),
    "axes": ("axis", {"multiscale_pos": ("multiscale_pos", "int"), "axis_pos": ("item_pos", "int"), "name": ("name", "string"), "type": ("type", "string"), "unit": ("unit", "string")}),
    "datasets": ("dataset", {"multiscale_pos": ("multiscale_pos", "int"), "dataset_pos": ("item_pos", "int"), "path": ("name", "string")}),
    "transforms": ("transform", {"multiscale_pos": ("multiscale_pos", "int"), "dataset_pos": ("item_pos", "int"), "transform_pos": ("transform_pos", "int"), "type": ("name", "string")}),
    "transform_values": ("transform", {"multiscale_pos": ("multiscale_pos", "int"), "dataset_pos": ("item_pos", "int"), "transform_pos": ("transform_pos", "int"), "value_pos": ("value_pos", "int"), "value": ("", "double")}),
}


def flat_tables(docs: DataFrame, text: str, key: str) -> dict[str, DataFrame]:
    """The related tables of TABLES, each with ``key`` and the positions of its parents;
    ``dataset_pos`` is -1 in a transform of the multiscale itself.

    Documents are normalised once and written; every table is flattened from that.
    """
    nested = nested_multiscales(docs.select(key, text).distinct(), text, [key])
    nested = cut(nested.select(F.col(key).cast("bigint").alias(key), "multiscales"), "nested")
    return {name: _flat_table(nested, key, *TABLES[name]) for name in TABLES}


def _flat_table(nested: DataFrame, key: str, level_name: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(key, pa.int64()), *[(n, kinds[t]) for n, (_, t) in columns.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level in _levels(batch, [key])[level_name]:
                if "value_pos" in columns:
                    level = level.child(level.field("values"), "value_pos")
                n = len(level.values)
                if n:
                    minus = pa.array(_arange(n) * 0 - 1).cast(pa.int32())
                    source = lambda name: level.values if not name else level.inherited.get(name, minus) if name.endswith("_pos") else level.field(name)
                    cols = [level.inherited[key], *[source(name) for name, _ in columns.values()]]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return nested.mapInArrow(run, f"`{key}` bigint, " + ", ".join(f"{n} {t}" for n, (_, t) in columns.items())).distinct()


def flat_nodes(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``key, node_kind, multiscale_pos, item_pos, transform_pos, node_name``."""
    nested = nested_multiscales(docs.select(key, text).distinct(), text, [key], full=False)
    schema = pa.schema([(key, pa.int64()), ("node_kind", pa.string()), ("multiscale_pos", pa.int32()), ("item_pos", pa.int32()), ("transform_pos", pa.int32()), ("node_name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _flatten_batch(batch, [key], schema)

    nested = nested.select(F.col(key).cast("bigint").alias(key), "multiscales")
    return nested.mapInArrow(run, f"`{key}` bigint, node_kind string, multiscale_pos int, item_pos int, transform_pos int, node_name string").distinct()
