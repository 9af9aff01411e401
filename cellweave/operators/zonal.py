"""Zonal aggregates, block reduction, mosaics and ranking."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.core import materialize


def blocks(cells: DataFrame, k: int) -> DataFrame:
    """cells with block keys br, bc: k by k cells each, snapped to the origin so that tiling never changes the answer."""
    return cells.withColumn("br", F.expr(f"cast(floor(r / {k}) as int)")).withColumn("bc", F.expr(f"cast(floor(c / {k}) as int)"))


def signed_peak(v: Column) -> Column:
    """Of the largest and the smallest the one with the larger magnitude, the largest on ties."""
    hi, lo = F.max(v), F.min(v)
    return F.when(F.abs(hi) >= F.abs(lo), hi).otherwise(lo)


def first_valid(parts: Sequence[str]) -> Column:
    """Mosaic: the first layer that covers the cell."""
    return F.coalesce(*[F.col(p) for p in parts])


def zonal(cells: DataFrame, zone: str, v: str) -> DataFrame:
    """Count, sum, mean, extremes, median and 90th percentile of what is there."""
    x = F.col(v)
    return cells.groupBy(zone).agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.median(x).alias("median"), F.percentile(x, F.lit(0.9)).alias("p90"),
    )


def exact_mean(x: Column) -> Column:
    """The mean of doubles as written in decimals: sums of tenths are whole, so that a mean at a threshold or half way between two is
    not moved by the order of its addends. Values that twelve decimals and 28 digits do not hold are averaged as doubles."""
    d = x.try_cast("decimal(28,12)")
    return F.when(F.count(F.when(d.cast("double") == x, 1)) == F.count(x), F.sum(d).cast("double") / F.count(x)).otherwise(F.avg(x))


def ordered_means(cells: DataFrame, zone: str, values: Sequence[str], order: Sequence[str], also: Sequence[Column] = ()) -> DataFrame:
    """(zone, values): means of doubles added one after the other in an order without ties, so that reruns and other engines that read in this order give the same last bit. A zone's rows stream through one window, none is held. also are further aggregates of a zone."""
    w = Window.partitionBy(zone).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto = cells.select("*", F.struct(*order).alias("_at"), *[f(v).over(w).alias(f"{p}{v}") for v in values for p, f in (("_s", F.sum), ("_n", F.count))])
    return upto.groupBy(zone).agg(*[(F.max_by(f"_s{v}", "_at") / F.when(F.max(f"_n{v}") > 0, F.max(f"_n{v}"))).alias(v) for v in values], *also)


def _fused(batches):
    for b in batches:
        lo, hi, d = (b.column(x).to_pylist() for x in ("_lo", "_hi", "_d"))
        out = pa.array([math.fma(x, 1 - t, y * t) for x, y, t in zip(lo, hi, d)], pa.float64())
        yield pa.RecordBatch.from_arrays([*b.columns[:-3], out], [*b.schema.names[:-3], "_q"])


def quantile(cells: DataFrame, keys: Sequence[str], v: str, q: float, out: str) -> DataFrame:
    """(keys, out): the q-quantile of what is there, lo * (1 - d) + hi * d between the values around it, the sum rounded once (fused). Equal values are counted, none collected."""
    counts = cells.where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy(v).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"_upto": upto, "_at": (F.sum("_n").over(w) - 1) * F.lit(q)})
    lo, hi = (F.min(F.when(F.col("_upto") > f("_at"), F.col(v))) for f in (F.floor, F.ceil))
    ends = placed.groupBy(*keys).agg(lo.alias("_lo"), hi.alias("_hi"), F.first("_at").alias("_at"))
    ends = ends.select(*keys, "_lo", "_hi", (F.col("_at") - F.floor("_at")).alias("_d"))
    named = ", ".join(f"`{k}` {kind}" for k, kind in ends.select(*keys).dtypes)
    return ends.mapInArrow(_fused, f"{named}, _q double").withColumnRenamed("_q", out)


def mode_share(cells: DataFrame, zone: str, cls: str) -> DataFrame:
    """(zone, top, share, n): the most frequent class, ties to the smaller, and its share."""
    counts = cells.where(F.col(cls).isNotNull()).groupBy(zone, cls).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(zone).agg(F.max_by(cls, F.struct("n", -F.col(cls))).alias("top"), (F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("n"))


def topk(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k of each group; Spark keeps k rows a task and group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("int")).where(F.col(name) <= k)


def rerank(df: DataFrame, group: Sequence[str], excluded: Column, rank: str, to: str = "new_rank") -> DataFrame:
    """Dense ranks again: what is allowed first, in the old order."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*group).orderBy(excluded, rank)).cast("int"))


def _ranged(df: DataFrame, order: Sequence[Column | str], size: Column) -> DataFrame:
    """df dealt into ranges (_p) of an order, each row with the size of all ranges before its own (_before).

    The ranges are written down first, since dealt again they could differ. What is broadcast is one row a range.
    """
    at = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = at.groupBy("_p").agg(size.alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    return at.join(F.broadcast(sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))), "_p")


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """df with out: positions from 1 in an order over all rows, numbered within ranges. An order with ties leaves them to chance."""
    here = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return _ranged(df, order, F.count(F.lit(1))).withColumn(out, here + F.col("_before")).drop("_p", "_before")


def running_sum(df: DataFrame, v: str, order: Sequence[Column | str], out: str) -> DataFrame:
    """df with out: the sum of v over all rows up to this one in an order without ties, added up within ranges."""
    here = F.sum(v).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _ranged(df, order, F.coalesce(F.sum(v), F.lit(0))).withColumn(out, F.coalesce(here, F.lit(0)) + F.col("_before")).drop("_p", "_before")


#: Rows that one task and the driver may hold in order, and buckets of one histogram.
IN_ORDER, BUCKETS = 1 << 16, 4096


def nth_value(df: DataFrame, v: str, n: int) -> tuple[float, int]:
    """(value, rows below it) of the n-th smallest of a numeric column without nulls, from 1: a histogram is refined until few values are left in its bucket. No row is ranked or moved."""
    low, high = df.agg(F.min(v), F.max(v)).head()
    below, x = 0, F.col(v)
    while True:
        left = df.where((x >= F.lit(low)) & (x <= F.lit(high)))
        step = (float(high) - float(low)) / BUCKETS
        if low == high or step == 0.0 or not math.isfinite(step):
            values = left.groupBy(v).count()
        else:
            bucket = F.least(F.lit(BUCKETS - 1), F.floor((x.cast("double") - F.lit(float(low))) / F.lit(step)))
            counts = left.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("b").collect()  # BUCKETS rows
            for row in counts:
                if below + row.n >= n:
                    break
                below += row.n
            if row.low == row.high:
                return row.low, below
            if row.n > IN_ORDER and (row.low, row.high) != (low, high):
                low, high = row.low, row.high
                continue
            values = left.where((x >= F.lit(row.low)) & (x <= F.lit(row.high))).groupBy(v).count()
        for value, count in values.orderBy(v).toLocalIterator():
            if below + count >= n:
                return value, below
            below += count


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of df in an order of columns (ascending, without nulls, no ties over all of them), in no order themselves.

    Up to IN_ORDER rows each task keeps its own first n and they are merged. Beyond, the n-th row's values are found column by column
    by refining histograms, and the rows up to them are filtered where they are.
    """
    if n <= 0:
        return df.where("false")
    if n <= IN_ORDER:
        return df.orderBy(*order).limit(n)
    kinds = dict(df.dtypes)
    order = [f"{c}.{f.name}" if kinds[c].startswith("struct") else c for c in order for f in (df.schema[c].dataType.fields if kinds[c].startswith("struct") else [None])]
    flat = df.select("*", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)])
    total = df.count()
    if n >= total:
        return df
    rest, keep, equal = n, F.lit(False), F.lit(True)
    for i in range(len(order)):
        value, below = nth_value(flat.where(equal), f"_k{i}", rest)
        keep = keep | (equal & (F.col(f"_k{i}") < F.lit(value)))
        equal, rest = equal & (F.col(f"_k{i}") == F.lit(value)), rest - below
    return flat.where(keep | equal).drop(*[f"_k{i}" for i in range(len(order))])


def spearman(df: DataFrame, a: str, b: str, tie: Sequence[str]) -> DataFrame:
    """(rho, n): rank correlation with ties broken by position."""
    ranked = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b, *tie)
    ranked = global_rank(global_rank(ranked, [a, *tie], "ra"), [b, *tie], "rb")
    return ranked.agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def area_fractions(cells: DataFrame, cls: str, ratio: float, row0: float = 0.0, col0: float = 0.0, least: float = 0.01) -> DataFrame:
    """(r, c, cls, fraction, covered) on a grid whose cells are ratio source cells wide and begin at (row0, col0), for any ratio.

    A source cell gives to each target cell the part of its area that lies there, so the answer does not depend on how the source is
    partitioned. Fractions are of the area that is covered; target cells covered by `least` of their area or less have none.
    """

    def spans(x: Column, start: float) -> Column:
        first, last = F.floor((x - start) / ratio), F.ceil((x + 1 - start) / ratio) - 1
        part = lambda t: F.least(x + 1, start + (t + 1) * ratio) - F.greatest(x.cast("double"), start + t * ratio)
        return F.transform(F.sequence(first, last), lambda t: F.struct(t.cast("int").alias("i"), part(t).alias("w")))

    at = cells.select(F.col(cls), F.explode(spans(F.col("r"), row0)).alias("a"), F.col("c")).select(cls, "a", F.explode(spans(F.col("c"), col0)).alias("b"))
    sums = at.groupBy(F.col("a.i").alias("r"), F.col("b.i").alias("c"), cls).agg((F.sum(F.col("a.w") * F.col("b.w")) / ratio**2).alias("part"))
    covered = F.sum("part").over(Window.partitionBy("r", "c"))
    return sums.withColumn("covered", covered).where(F.col("covered") > least).select("r", "c", cls, (F.col("part") / F.col("covered")).alias("fraction"), "covered")


def latest_values(pages: DataFrame, keys: Sequence[str], seq: str, last: Sequence[str], high: Sequence[str]) -> DataFrame:
    """One row a key out of overlapping pages: of `last` the latest value above zero, of `high` the largest; 0 where there is none. seq orders the rows of a key without ties."""
    aggs = [F.coalesce(F.max_by(v, F.when(F.col(v) > 0, F.col(seq))), F.lit(0)).alias(v) for v in last] + [F.coalesce(F.greatest(F.max(v), F.lit(0)), F.lit(0)).alias(v) for v in high]
    return pages.groupBy(*keys).agg(*aggs)


def member_point(cells: DataFrame, by: str) -> DataFrame:
    """(by, r, c): the cell of each label nearest to its mean position, ties to the smaller (r, c), so that it always lies inside."""
    mid = cells.groupBy(by).agg(F.avg("r").alias("_mr"), F.avg("c").alias("_mc"))
    d = F.round((F.col("r") - F.col("_mr")) ** 2 + (F.col("c") - F.col("_mc")) ** 2, 9)
    return cells.join(mid, by).groupBy(by).agg(F.min(F.struct(d.alias("d"), F.col("r"), F.col("c"))).alias("m")).select(by, "m.r", "m.c")
