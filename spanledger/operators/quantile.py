"""Exact percentiles without gathering a group.

Values are first counted (map-side combine). The distinct values are range-partitioned
over group and value, so that ranges hold about equal numbers of them however the
values lie; the range holding each wanted rank is found on the small table of range
totals, and only the values of those ranges are then ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut


def ranged_values(df: DataFrame, groups: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """Distinct values `_v` of each group with their count `_n` and a `_range` that rises with the value.

    `ranges` is the number of ranges over all groups, the shuffle partitions unless given.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    # the range is a column of a stored table: it stays the same when a task runs again
    return cut(counted.repartitionByRange(n, *groups, "_v").withColumn("_range", F.spark_partition_id()))


def exact_quantiles(df: DataFrame, groups: list[str], value: str, qs: list[float], ranges: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles as rows (groups..., q, value, n). NULL values are left out."""
    counted = ranged_values(df, groups, value, ranges)
    ranges = counted.groupBy(*groups, "_range").agg(F.sum("_n").alias("_rn"))
    by = [F.col(g) for g in groups] or [F.lit(0)]
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranges.select(
        *groups, "_range", "_rn",
        (F.sum("_rn").over(upto) - F.col("_rn")).alias("_before"),
        F.sum("_rn").over(Window.partitionBy(*by)).alias("_total"),
    )
    wanted = (
        ranked.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
        .withColumn("_pos", (F.col("_total") - 1) * F.col("q"))
        .withColumn("_side", F.explode(F.array(F.lit("lo"), F.lit("hi"))))
        .withColumn("_rank", F.when(F.col("_side") == "lo", F.floor("_pos")).otherwise(F.ceil("_pos")))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_rn")))
    )
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"w.{g}")) for g in groups] + [F.col("c._range") == F.col("w._range")]
    narrowed = (
        counted.alias("c").join(wanted.alias("w"), same)
        .select(*[F.col(f"c.{g}").alias(g) for g in groups], "c._v", "c._n", "w.q", "w._pos", "w._side", "w._rank", "w._before", "w._total")
    )
    within = Window.partitionBy(*groups, "q", "_side").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("_rank") - F.col("_before")
    hits = narrowed.withColumn("_upto", F.sum("_n").over(within)).where((F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at))
    lo = F.max(F.when(F.col("_side") == "lo", F.col("_v")))
    hi = F.max(F.when(F.col("_side") == "hi", F.col("_v")))
    return hits.groupBy(*groups, "q").agg(
        (lo + (hi - lo) * (F.max("_pos") - F.floor(F.max("_pos")))).alias("value"), F.max("_total").alias("n")
    )
