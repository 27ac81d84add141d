"""Distributed exact selection over keys of very uneven size.

Order statistics per key are found without ever bringing one key's values
together.  A round counts values into a grid of cells per key; the counts, minima
and maxima of the cells merge associatively, so they are combined on the map side
and a hot key contributes at most ``cells`` rows per task to the shuffle.  Running
counts over the cells tell which cell holds each wanted rank.  Cells whose minimum
and maximum agree resolve their ranks; the others are refined with a finer grid
laid over the cell's own value range in the next round, until no rank is open.

Defined cases: rows with a null key or value are ignored; a key without rows gives
no result; ties are one value, whose ``n_equal`` counts them all; ranks outside
1..n are ignored; an empty table gives an empty result; extra columns of the input
are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.session import cut

#: A node that holds more than 1/HOT_SHARE of the rows counts as hot; as nodes are
#: disjoint there are at most HOT_SHARE of them, which bounds what is broadcast.
HOT_SHARE = 2000
#: States of at most this many rows are broadcast whole.
BROADCAST_ROWS = 100_000


def _floor_to(v: Column, width: Column) -> Column:
    """Lower bound of the grid cell of ``v``, also below zero; the lowest cell is cut at the lowest bigint."""
    return F.coalesce(F.try_subtract(v, F.pmod(v, width)), F.lit(-(2**63)).cast("bigint"))


def _width(lo: Column, hi: Column, cells: int) -> Column:
    m = F.lit(cells).cast("bigint")
    return (_floor_div(hi, m) - _floor_div(lo, m) + F.lit(1).cast("bigint"))


def _floor_div(v: Column, m: Column) -> Column:
    return F.call_function("div", v - F.pmod(v, m), m)


def hot_split_join(rows: DataFrame, nodes: DataFrame, on: list[str], count_col: str, total: int, size: int) -> DataFrame:
    """Inner join of rows with the nodes they belong to, safe for hot nodes.

    Up to BROADCAST_ROWS nodes are broadcast.  Beyond that, the at most HOT_SHARE
    nodes with more than ``total / HOT_SHARE`` rows each are broadcast and the
    rest is joined by a shuffle in which no key exceeds that share.
    """
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(nodes), on)
    limit = max(1, total // HOT_SHARE)
    hot = nodes.where(F.col(count_col) > limit)
    cold = nodes.where(F.col(count_col) <= limit)
    warm = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(warm.join(cold, on))


def select_ranks(rows: DataFrame, key: str, value: str, wanted: Callable[[Column], Column], cells: int = 4096) -> DataFrame:
    """Exact order statistics of ``value`` within each ``key``.

    ``wanted`` maps the column with a key's row count to an array<bigint> of ranks
    (from 1).  Returns ``key, rank, value, n_equal, n_below, n``: the value at the
    rank, how many rows of the key equal it, how many lie below, and the key's rows.
    """
    base = rows.select(F.col(key).alias("k"), F.col(value).cast("bigint").alias("v")).where("k is not null and v is not null")
    lo, hi, total = base.agg(F.min("v"), F.max("v"), F.count("*")).first()
    lo, hi = lo or 0, hi or 0
    cell = base.withColumn("c", _floor_to(F.col("v"), F.lit(hi // cells - lo // cells + 1).cast("bigint")))
    hist = cell.groupBy("k", "c").agg(F.count("*").alias("n_cell"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    w = Window.partitionBy("k")
    hist = hist.withColumn("n", F.sum("n_cell").over(w)).withColumn("below", F.coalesce(F.sum("n_cell").over(w.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    held = _holding(hist.withColumn("ranks", wanted(F.col("n"))))
    done: list[DataFrame] = []
    for depth in range(70):  # every round narrows a cell, so 64 bits are through long before
        held = cut(held, "ranks")
        done.append(held.where("lo = hi"))
        open_ = held.where("lo < hi").select("k", "c", F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"), F.col("below").alias("s_below"), F.col("n").alias("s_n"), F.col("n_cell").alias("s_cell"), "ranks")
        size = open_.count()
        if not size:
            break
        joined = hot_split_join(cell, open_, ["k", "c"], "s_cell", total, size)
        joined = joined.withColumn("d", _floor_to(F.col("v"), _width(F.col("s_lo"), F.col("s_hi"), cells)))
        if size > BROADCAST_ROWS or depth:  # rows of open cells only; later rounds start from them
            joined = cut(joined, "open")
        hist = joined.groupBy("k", "c", "d").agg(F.count("*").alias("n_cell"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("s_below").alias("s_below"), F.first("s_n").alias("n"), F.first("ranks").alias("ranks"))
        w = Window.partitionBy("k", "c").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
        held = _holding(hist.withColumn("below", F.col("s_below") + F.coalesce(F.sum("n_cell").over(w), F.lit(0))).drop("c").withColumnRenamed("d", "c"))
        cell = joined.select("k", "v", F.col("d").alias("c"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(F.col("k").alias("key"), F.explode("ranks").alias("rank"), F.col("lo").alias("value"), F.col("n_cell").alias("n_equal"), F.col("below").alias("n_below"), "n")


def _holding(hist: DataFrame) -> DataFrame:
    """Cells that hold at least one wanted rank, with just those ranks."""
    inside = F.filter("ranks", lambda r: (r > F.col("below")) & (r <= F.col("below") + F.col("n_cell")))
    return hist.withColumn("ranks", inside).where(F.size("ranks") > 0).select("k", "c", "lo", "hi", "n_cell", "below", "n", "ranks")


def quantile_ranks(probs: list[float]) -> Callable[[Column], Column]:
    """Ranks of the discrete quantiles: the smallest rank of at least p * n, 1 at least."""
    return lambda n: F.array_distinct(F.array(*[F.greatest(F.lit(1).cast("bigint"), F.ceil(n * F.lit(p)).cast("bigint")) for p in probs]))


def key_quantiles(rows: DataFrame, key: str, value: str, probs: list[float]) -> DataFrame:
    """``key, n, q0, q1, ...``: exact discrete quantiles of each key's values."""
    found = select_ranks(rows, key, value, quantile_ranks(probs))
    pick = [F.max(F.when(F.col("rank") == F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("n") * F.lit(p)).cast("bigint")), F.col("value"))).alias(f"q{i}") for i, p in enumerate(probs)]
    return found.groupBy("key").agg(F.max("n").alias("n"), *pick)


def heavy_keys(pairs: DataFrame, fields: list[str], num: int, den: int) -> DataFrame:
    """Values of each field that are in at least num/den of the rows, by selection.

    With t the smallest count that qualifies, sorting the rows by the field puts a
    qualifying value on t or more neighbouring ranks, hence on a multiple of t.  So
    the ranks t, 2t, ... are selected exactly (at most den/num of them per field) and
    the resolved values keep the exact count that the last histogram gives them.
    Returns ``field, value, n_rows``.
    """
    tall = pairs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("value")) for f in fields])).alias("x")).select("x.*")

    def ranks(n: Column) -> Column:
        t = F.greatest(F.lit(1).cast("bigint"), F.ceil(n * F.lit(num) / F.lit(den)).cast("bigint"))
        return F.sequence(t, n, t)

    found = select_ranks(tall, "field", "value", ranks)
    hit = found.where(F.col("n_equal") * F.lit(den) >= F.col("n") * F.lit(num))
    return hit.select(F.col("key").alias("field"), "value", F.col("n_equal").alias("n_rows")).distinct()
