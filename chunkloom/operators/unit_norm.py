"""Quantities recorded in different units, brought to one.

Plain relational steps: number and unit are taken from texts by ``regexp_extract``,
the unit's spelling is normalised by a join with the alias table, the unit field, the
unit in the text and the source's default are coalesced, then factor and offset are
applied.

Defined cases: a stated unit of another quantity, or none that is known, gives no
recording; blank units count as not stated; null, NaN, infinite, zero and negative
values give no recording; null keys give no recording; repeated rows count once;
empty tables give an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions import units
from chunkloom.operators.flatten import _get, _is, _list, multiscales_of, once


def to_common_units(df: DataFrame, keys: list[str], value: Column, unit: Column, text: Column, default: str, quantity: str = "length") -> DataFrame:
    """``keys, common_value`` of the rows with a positive value in a known unit.

    ``unit``: the stated unit, null if the field is missing; then the unit that
    ``text`` names holds, then ``default``.  Where value and unit are both missing,
    the first number with a unit in ``text`` gives both.
    """
    stated = F.nullif(F.trim(unit), F.lit(""))
    rows = df.select(*keys, value.cast("double").alias("_value"), stated.alias("_unit"), text.alias("_text"))
    neither = F.col("_value").isNull() & F.col("_unit").isNull()
    text_unit = F.when(F.col("_unit").isNull(), F.when(neither, units.value_in_text(F.col("_text"), quantity, 2)).otherwise(units.unit_in_text(F.col("_text"), quantity)))
    made = {"_value": F.when(neither, units.number(units.value_in_text(F.col("_text"), quantity, 1))).otherwise(F.col("_value")), "_unit": F.coalesce(F.col("_unit"), F.nullif(text_unit, F.lit("")), F.lit(default))}
    rows = once(rows, keys, **made)
    rows = rows.where("_value > 0 and _value < double('infinity')").dropna(subset=keys)
    known = F.broadcast(units.alias_table(df.sparkSession, quantity))  # a fixed list of names
    return rows.join(known, units.normal_alias(F.col("_unit")) == F.col("alias")).select(*keys, (F.col("_value") * F.col("factor") + F.col("offset")).alias("common_value"))


KEYS = ["layer_id", "mip", "axis_name"]


def axis_recordings(axes: DataFrame) -> DataFrame:
    """Voxel sizes of the zarr2 axes in nm."""
    rows = axes.select("layer_id", "mip", F.lower(F.trim("axis_name")).alias("axis_name"), "unit", "scale_value", "note").where("axis_name in ('x', 'y', 'z')").distinct()
    value = F.when(~F.isnan("scale_value"), F.col("scale_value"))
    return to_common_units(rows, KEYS, value, F.col("unit"), F.col("note"), "nm")


def document_recordings(docs: DataFrame) -> DataFrame:
    """Voxel sizes of the first multiscale of each zarr3 document in nm."""
    v = docs.select("layer_id", "zinfo").where("layer_id is not null and zinfo is not null").distinct()
    v = once(multiscales_of(v, "zinfo", ["layer_id"]), ["layer_id"], _f=F.get(_list(F.col("_m")), F.lit(0)))
    v = once(v, ["layer_id"], _x=_list(_get(F.col("_f"), "$.axes")), _ds=_list(_get(F.col("_f"), "$.datasets")))
    sets = v.select("layer_id", "_x", F.posexplode("_ds").alias("mip", "_d"))
    sets = once(sets, ["layer_id", "mip", "_x"], _t=_list(_get(F.col("_d"), "$.coordinateTransformations")))
    first = F.get(F.filter("_t", lambda t: _get(t, "$.type", "string") == "scale"), F.lit(0))
    sets = once(sets, ["layer_id", "mip", "_x"], _s=_list(_get(first, "$.scale")))
    each = sets.select("layer_id", "mip", "_s", F.posexplode("_x").alias("_i", "_e"))
    name = F.lower(F.trim(F.when(_is(F.col("_e"), "STRING"), _get(F.col("_e"), "$", "string")).otherwise(_get(F.col("_e"), "$.name", "string"))))
    rows = once(each, ["layer_id", "mip"], axis_name=name, _scale=_get(F.get("_s", F.col("_i")), "$", "double"), _axis_unit=F.when(_is(F.col("_e"), "OBJECT"), _get(F.col("_e"), "$.unit", "string")))
    rows = rows.where("axis_name in ('x', 'y', 'z') and _scale is not null")
    return to_common_units(rows, KEYS, F.col("_scale"), F.col("_axis_unit"), F.lit(None).cast("string"), "nm")


def scale_recordings(scales: DataFrame) -> DataFrame:
    """Voxel sizes of the sharded scales in nm: the resolution, or else the scale key."""
    rows = scales.select("layer_id", "mip", "resolution", "scale_key", "description").distinct()
    keyed = F.when(F.size(F.split("scale_key", "_")) == 3, F.transform(F.split("scale_key", "_"), lambda t: t.try_cast("double")))
    whole = F.when(F.col("resolution").isNotNull(), F.col("resolution")).when(F.forall(keyed, lambda x: x.isNotNull()), keyed)
    rows = rows.select("layer_id", "mip", "description", F.posexplode(whole).alias("_i", "_r"))
    rows = rows.where("_i < 3").withColumn("axis_name", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("_i") + 1))
    return to_common_units(rows.where("not isnan(_r)"), KEYS, F.col("_r"), F.lit(None).cast("string"), F.col("description"), "nm")


def recordings(axes: DataFrame, docs: DataFrame, scales: DataFrame) -> DataFrame:
    """``layer_id, mip, axis_name, common_value, origin`` of all three tables."""
    parts = [(axis_recordings(axes), "zarr2"), (document_recordings(docs), "zarr3"), (scale_recordings(scales), "sharded")]
    out = [p.select(F.col("layer_id").cast("bigint").alias("layer_id"), F.col("mip").cast("int").alias("mip"), "axis_name", "common_value", F.lit(o).alias("origin")) for p, o in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def disagreements(recorded: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Axes with two recordings whose larger is more than ``tolerance`` above the smaller."""
    span = recorded.groupBy(*KEYS).agg(F.min("common_value").alias("least_nm"), F.max("common_value").alias("most_nm"), F.count("*").alias("n_recordings"))
    return span.where(F.col("most_nm") > F.col("least_nm") * (1 + tolerance))
