"""Running values along ordered tracks, by ranges: no task holds more of a track than one range, however long the track is.

Rows are dealt by range of (group, order) and written once. A function that rows apply one after the other composes
associatively: what a range does to the value that comes in is one row a range and group, these rows are composed in order, and each
range then runs on from what comes into it. Tracks that lie in one range (most of them) never wait for others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.core import Steps


class Tracks:
    """df dealt by ranges of (group, order). The order has no ties within a group. Methods add columns; close() deletes the tables in between."""

    def __init__(self, df: DataFrame, group: Sequence[str], order: Sequence[str]):
        self.group, self.order, self.steps, self.n = list(group), list(order), Steps(df.sparkSession, "tracks"), 0
        self._keep(df.repartitionByRange(*self.group, *self.order).withColumn("_p", F.spark_partition_id()))

    def _keep(self, df: DataFrame) -> None:
        self.rows, self.n = self.steps.table(df, f"rows-{self.n}"), self.n + 1

    @property
    def here(self):
        """The rows of a track within a range."""
        return Window.partitionBy("_p", *self.group).orderBy(*self.order)

    @property
    def ranges(self):
        """The ranges of a track."""
        return Window.partitionBy(*self.group).orderBy("_p")

    def _with(self, **of_range: Column) -> DataFrame:
        """A row for each range and track."""
        return self.rows.groupBy("_p", *self.group).agg(*[c.alias(k) for k, c in of_range.items()])

    def with_columns(self, **columns: Column) -> Tracks:
        """Columns that need no other row; nothing is written for them."""
        self.rows = self.rows.withColumns(columns)
        return self

    def _joined(self, per: DataFrame, names: Sequence[str]) -> DataFrame:
        keys = ["_p", *self.group]
        return self.rows.join(per.select(*keys, *names), keys)

    def beside(self, **columns: tuple[str, int]) -> Tracks:
        """name=(column, -1 or 1): the value of the row before or after in the track, null at its ends."""
        at = F.struct(*self.order)
        per = self._with(**{f"_of_{k}": (F.max_by if step < 0 else F.min_by)(v, at) for k, (v, step) in columns.items()})
        for k, (_, step) in columns.items():
            per = per.withColumn(f"_of_{k}", (F.lag if step < 0 else F.lead)(f"_of_{k}").over(self.ranges))
        df = self._joined(per, [f"_of_{k}" for k in columns])
        for k, (v, step) in columns.items():
            inner = (F.lag if step < 0 else F.lead)(F.struct(F.col(v).alias("v"))).over(self.here)  # in a struct, so that a null value is no end
            df = df.withColumn(k, F.when(inner.isNotNull(), inner["v"]).otherwise(F.col(f"_of_{k}")))
        self._keep(df.drop(*[f"_of_{k}" for k in columns]))
        return self

    def last_known(self, v: str, out: str) -> Tracks:
        """out: the last value of v that is not null, up to this row. (A row maps what comes in to v, or leaves it: maps to constants and identities compose to the last constant.)"""
        at = F.struct(*self.order)
        per = self._with(_last=F.max_by(v, F.when(F.col(v).isNotNull(), at)))
        per = per.withColumn("_in", F.last("_last", True).over(self.ranges.rowsBetween(Window.unboundedPreceding, -1)))
        df = self._joined(per, ["_in"]).withColumn(out, F.coalesce(F.last(v, True).over(self.here), F.col("_in")))
        self._keep(df.drop("_in"))
        return self

    def running(self, v: Column, out: str) -> Tracks:
        """out: the sum of v up to this row."""
        per = self._with(_sum=F.sum(v))
        per = per.withColumn("_in", F.coalesce(F.sum("_sum").over(self.ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        df = self._joined(per, ["_in"]).withColumn(out, F.sum(v).over(self.here) + F.col("_in"))
        self._keep(df.drop("_in"))
        return self

    def close(self) -> None:
        self.steps.close()


def smoothed(tracks: Tracks, on: str, out: str) -> Tracks:
    """out: the states of a track with flicker of one row taken out from front to back.

    A row between two equal states takes theirs; the state before it counts as smoothed already. For two states that is: a row whose
    successor has the same state, the first and the last keep their own, and every other row goes on with what comes in.
    """
    tracks.beside(_after=(on, 1)).running(F.lit(1), "_i")
    own = F.when((F.col("_i") == 1) | F.col("_after").isNull() | (F.col("_after") == F.col(on)), F.col(on))
    return tracks.with_columns(_own=own).last_known("_own", out)
