"""Long series in slices: tasks finish ordered ranges of rows on their own, with what comes in from the ranges before.

A slice is summarised, the summaries before it are combined, and the slice is finished with the outcome. A range is a
task of its own whatever its keys, so that no series, however long, is one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronovec.sources.shared import written

#: Rows of a slice, on average. Where no key has more, a key is one slice.
SLICE = 1_000_000


class Slices:
    """rows in order of `order` within each `by`, with the number of their slice in `part`."""

    def __init__(self, rows: DataFrame, by: str, order: list[str], size: int | None = None):
        size = size or SLICE
        held = written(rows, "series")
        sizes = held.groupBy(by).count().agg(F.max("count").alias("most"), F.sum("count").alias("total")).first()
        self.cut = (sizes["most"] or 0) > size
        if self.cut:
            ranges = held.repartitionByRange(-(-sizes["total"] // size), by, *order)
            held = written(ranges.withColumn("part", F.spark_partition_id()), "slices")
        else:
            held = held.withColumn("part", F.lit(0))
        self.rows, self.by, self.order = held, by, order

    def along(self, preceding: bool = False) -> "Window":
        """The rows of a slice up to each row, or those before it."""
        own = Window.partitionBy("part", self.by).orderBy(*self.order)
        return own.rowsBetween(Window.unboundedPreceding, -1) if preceding else own

    def carry(self, name: str, summary: Column, combine: Callable[[Column], Column]) -> None:
        """Adds what comes into a slice: the summaries of the slices of its key before it, combined; null without any."""
        if not self.cut:
            first = self.rows.select(summary.alias("s")).schema["s"].dataType
            self.rows = self.rows.withColumn(name, F.lit(None).cast(first))
            return
        earlier = Window.partitionBy("of").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
        own = self.rows.groupBy(F.col("part").alias("of_part"), F.col(self.by).alias("of")).agg(summary.alias(name))
        own = own.withColumn(name, combine(F.col(name)).over(earlier)).where(F.col(name).isNotNull())
        # a range has one key at most that began before it, so there are no more rows than ranges
        self.rows = self.rows.join(F.broadcast(own), (F.col("part") == F.col("of_part")) & F.col(self.by).eqNullSafe(F.col("of")), "left").drop("of_part", "of")


def latest(column: Column) -> Column:
    """The last value that isn't null."""
    return F.last(column, ignorenulls=True)


def composed(rows: DataFrame, by: list[str], order: list[str], factor: str, term: str) -> DataFrame:
    """The maps x -> factor * x + term of each group, applied one after the other, as one map.

    A term counts with the product of the factors behind it, a sum of logarithms; behind a factor of 0 nothing before it counts.
    """
    behind = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    log = F.when(F.col(factor) > 0, F.log(factor))
    kept = rows.withColumn("_logs", F.coalesce(F.sum(log).over(behind), F.lit(0.0))).withColumn("_zeros", F.coalesce(F.sum((F.col(factor) == 0).cast("int")).over(behind), F.lit(0)))
    counted = F.when(F.col("_zeros") == 0, F.col(term) * F.exp("_logs")).otherwise(0.0)
    product = F.when(F.max((F.col(factor) == 0).cast("int")) == 1, 0.0).otherwise(F.exp(F.coalesce(F.sum(log), F.lit(0.0))))
    others = [c for c in rows.columns if c not in (*by, *order, factor, term)]
    return kept.groupBy(*by).agg(product.alias(factor), F.sum(counted).alias(term), *(F.expr(f"{how}({c})").alias(c) for c, how in KEEP.items() if c in others))


#: How a segment's other columns are put together.
KEEP = {"start": "min", "end": "max", "peak": "max"}
