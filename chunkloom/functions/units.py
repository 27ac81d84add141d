"""Units of measure: the alias table and its lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (quantity, aliases, factor to the common unit, offset).  The common
# units are nanometer and second.
UNITS: list[tuple[str, str, float, float]] = [
    ("length", "fm femtometer femtometers femtometre femtometres", 1e-6, 0.0),
    ("length", "pm picometer picometers picometre picometres", 1e-3, 0.0),
    ("length", "å angstrom angstroms ångström ångstrom", 0.1, 0.0),
    ("length", "nm nanometer nanometers nanometre nanometres", 1.0, 0.0),
    ("length", "um µm micrometer micrometers micrometre micrometres micron microns", 1e3, 0.0),
    ("length", "mm millimeter millimeters millimetre millimetres", 1e6, 0.0),
    ("length", "cm centimeter centimeters centimetre centimetres", 1e7, 0.0),
    ("length", "inch inches", 2.54e7, 0.0),
    ("length", "foot feet", 3.048e8, 0.0),
    ("length", "yard yards", 9.144e8, 0.0),
    ("length", "m meter meters metre metres", 1e9, 0.0),
    ("length", "km kilometer kilometers kilometre kilometres", 1e12, 0.0),
    ("time", "ns", 1e-9, 0.0),
    ("time", "us µs", 1e-6, 0.0),
    ("time", "ms", 1e-3, 0.0),
    ("time", "s sec second seconds", 1.0, 0.0),
    ("time", "min minute minutes", 60.0, 0.0),
    ("time", "h hour hours", 3600.0, 0.0),
    ("time", "d day days", 86400.0, 0.0),
]
#: Decimal prefixes and their powers of ten; seconds come with all of them.
PREFIXES = {"yotta": 24, "zetta": 21, "exa": 18, "peta": 15, "tera": 12, "giga": 9, "mega": 6, "kilo": 3, "hecto": 2, "deca": 1, "deci": -1, "centi": -2, "milli": -3, "micro": -6, "nano": -9, "pico": -12, "femto": -15, "atto": -18, "zepto": -21, "yocto": -24}
UNITS += [("time", f"{p}second {p}seconds", float(f"1e{e}"), 0.0) for p, e in PREFIXES.items()]
NUMBER = r"[-+]?[0-9]+(?:[.,][0-9]+)?(?:[eE][-+]?[0-9]+)?"


def aliases(quantity: str) -> list[tuple[str, float, float]]:
    return [(a, f, o) for q, names, f, o in UNITS if q == quantity for a in names.split()]


def alias_table(spark: SparkSession, quantity: str) -> DataFrame:
    """``alias, factor, offset``; as many rows as the fixed list has names."""
    return spark.createDataFrame(aliases(quantity), "alias string, factor double, offset double")


def normal_alias(unit: Column) -> Column:
    """Trimmed, in lower case, with one spelling of the micro and Angstrom signs."""
    return F.translate(F.lower(F.regexp_replace(unit, r"^[\s ]+|[\s ]+$", "")), "μÅ", "µå")


def _names(quantity: str) -> str:
    names = sorted((a for a, _, _ in aliases(quantity)), key=lambda a: (-len(a), a))
    return "|".join(names).replace("µ", "[µμ]").replace("å", "[åÅÅ]")


def unit_in_text(text: Column, quantity: str) -> Column:
    """First unit that a text names as a word of its own (a number may touch it); '' if none."""
    return F.regexp_extract(text, rf"(?iu)(?<![\p{{L}}])({_names(quantity)})(?![\p{{L}}])", 1)


def value_in_text(text: Column, quantity: str, group: int) -> Column:
    """Of the first number with a unit in a text: the number (1) or the unit (2); '' if none."""
    return F.regexp_extract(text, rf"(?iu)(?<![\p{{L}}0-9.,])({NUMBER})\s*({_names(quantity)})(?![\p{{L}}])", group)


def number(text: Column) -> Column:
    """A number in a text, where a comma may be the decimal mark."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
