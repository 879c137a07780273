"""Running values over a table's order without a task that holds the whole table or a whole group.

Rows are range-partitioned by the order, so equal keys of a hot group spread over several ranges; each range is scanned
by itself, and one row per range carries what the ranges before it add up to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.scratch import Scratch

PART = "__part"


class Ordered:
    """A table cut into ranges of ``order``, written to the shared folder. ``order`` holds ascending plain columns for
    ``last_before`` and ``last_where`` and should be unique, or ties are in any order."""

    def __init__(self, df: DataFrame, order: list[Column]):
        if PART in df.columns:
            raise ValueError(f"{PART} is a column already")
        self.order = order
        ranged = df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id())
        self.df = Scratch(df.sparkSession).keep(ranged)
        self._own = Window.partitionBy(PART).orderBy(*order)

    def position(self, name: str) -> Ordered:
        """Adds the position from 1."""
        return self.running_sum(F.lit(1).cast("long"), name)

    def running_sum(self, value: Column, name: str) -> Ordered:
        """Adds the sum of ``value`` over this row and all rows before it; nulls add nothing."""
        v = F.coalesce(value, F.lit(0))
        before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        totals = self.df.groupBy(PART).agg(F.sum(v).alias("__t"))  # one row per range
        totals = totals.select(PART, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__b"))
        out = self.df.withColumn(name, F.sum(v).over(self._own.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.join(F.broadcast(totals), PART).withColumn(name, F.col(name) + F.col("__b")).drop("__b")
        return self._with(out)

    def last_before(self, value: Column, name: str) -> Ordered:
        """Adds ``value`` of the row before this one (lag); null on the first row."""
        last = self.df.groupBy(PART).agg(F.max_by(F.struct(value.alias("v")), F.struct(*self._keys())).alias("__l"))
        carry = Window.orderBy(PART)
        last = last.select(PART, F.lag("__l").over(carry).alias("__l"))  # one row per range
        first = F.row_number().over(self._own) == 1
        out = self.df.join(F.broadcast(last), PART, "left")
        out = out.withColumn(name, F.when(first, F.col("__l.v")).otherwise(F.lag(value).over(self._own))).drop("__l")
        return self._with(out)

    def last_where(self, flag: Column, value: Column, name: str) -> Ordered:
        """Adds ``value`` of the nearest row, this one included, whose ``flag`` holds; null before the first such row."""
        held = F.when(flag, F.struct(value.alias("v")))
        run = self._own.rowsBetween(Window.unboundedPreceding, 0)
        ends = self.df.where(flag).groupBy(PART).agg(F.max_by(F.struct(value.alias("v")), F.struct(*self._keys())).alias("__l"))
        every = self.df.select(PART).distinct().join(ends, PART, "left")  # one row per range
        before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        carried = every.select(PART, F.last("__l", ignorenulls=True).over(before).alias("__l"))
        out = self.df.join(F.broadcast(carried), PART, "left")
        out = out.withColumn(name, F.coalesce(F.last(held, ignorenulls=True).over(run), F.col("__l")).getField("v")).drop("__l")
        return self._with(out)

    def with_column(self, name: str, value: Column) -> Ordered:
        return self._with(self.df.withColumn(name, value))

    def done(self) -> DataFrame:
        return self.df.drop(PART)

    def _keys(self) -> list[Column]:
        return [c.alias(f"k{i}") for i, c in enumerate(self.order)]

    def _with(self, df: DataFrame) -> Ordered:
        new = object.__new__(Ordered)
        new.order, new.df, new._own = self.order, df, self._own
        return new
