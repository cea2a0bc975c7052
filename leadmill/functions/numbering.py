"""Numbers of rows in the order of their group, without a group's rows in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions.lineage import stored

#: Rows up to which the table of ranges' segments is broadcast (some 60 bytes each with a short key, and as much for their hash table).
BROADCAST = 1 << 19
_ROW = (1 << 33) - 1


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Adds `name`: 1, 2, ... in each group, by `order`; null is a group like any other, and rows equal in `order` get their numbers in any order.

    Rows are dealt by ranges of (group, order), so a group of a third of all rows spreads over a third of all ranges. Each range counts its rows by
    their places, and a group that began in ranges before starts at the sum of these ranges' counts: one row per range and group. The result is written once.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(c) for c in group], *order]
    # Spark's ids hold the partition's number and the row's place in it.
    placed = stored(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()))
    segments = placed.groupBy(*group, F.shiftright("__id", 33).alias("__range")).agg(F.count(F.lit(1)).alias("__n"), F.min(F.col("__id").bitwiseAND(F.lit(_ROW))).alias("__first"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    theirs = [F.col(c).alias(f"__g{i}") for i, c in enumerate(group)]
    starts = stored(segments.select(*theirs, F.col("__range").alias("__of"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__start")))
    starts = F.broadcast(starts) if starts.count() <= BROADCAST else starts
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    out = placed.withColumn("__range", F.shiftright("__id", 33)).join(starts, reduce(Column.__and__, same, F.col("__range") == F.col("__of")))
    return out.select(*rows.columns, (F.col("__id").bitwiseAND(F.lit(_ROW)) + F.col("__start") + 1).alias(name))
