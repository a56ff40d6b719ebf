"""Ordered prefix scans that survive a hot key.

A small job counts rows per key (map-side combined). Rows of keys above
`hot_rows` are range-partitioned over key and full order, so that slices hold
about equal numbers of rows whatever the order values look like; rows that are
equal in key and order stay together. Each slice is scanned on its own, slices
are summarised with partial aggregates, and the running summary of earlier
slices is joined back. A key that is not hot is one slice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

HOT_ROWS = 2_000_000


@dataclass(frozen=True)
class Prefix:
    """One running value: `fn` is sum, max, min or last (last non-NULL)."""

    fn: str
    expr: Column
    inclusive: bool = True


def _fold(fn: str, expr: Column) -> Column:
    return F.last(expr, ignorenulls=True) if fn == "last" else getattr(F, fn)(expr)


def _merge(fn: str, earlier: Column, local: Column) -> Column:
    if fn == "last":
        return F.coalesce(local, earlier)
    if fn == "sum":
        return F.when(earlier.isNull(), local).when(local.isNull(), earlier).otherwise(earlier + local)
    # greatest / least skip NULL
    return F.greatest(earlier, local) if fn == "max" else F.least(earlier, local)


class SlicedScan:
    """Slices fixed once for `keys` (never NULL) along `order`, columns of any ordered type.

    `rows` is the input with `_slice`. Later scans may run over a filtered or
    widened `rows`: they keep the same partitioning, so Spark shuffles once.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS, reverse: bool = False):
        self.keys, self.order, self.reverse = keys, order, reverse
        hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
        found = hot.agg(F.sum("_n").alias("rows")).first()["rows"]
        self.hot = bool(found)
        whole = df.withColumn("_slice", F.lit(0))
        if not found:
            self.rows = whole
            return
        # the list of hot keys grows with the rows, so the optimiser chooses the join by its size
        listed = cut(hot.select(*keys))
        ranges = -(-int(found) // hot_rows) + 1
        # the slice is a column of a stored table: it stays the same when a task runs again
        sliced = df.join(listed, keys, "left_semi").repartitionByRange(ranges, *keys, *order).withColumn("_slice", F.spark_partition_id() + 1)
        self.rows = whole.join(listed, keys, "left_anti").unionByName(cut(sliced))

    def run(self, rows: DataFrame, specs: dict[str, Prefix]) -> DataFrame:
        keys, order = self.keys, self.order
        turn = F.desc if self.reverse else F.asc
        cells = keys if not self.hot else [*keys, "_slice"]
        base = Window.partitionBy(*cells).orderBy(*[turn(c) for c in order])

        def running(spec: Prefix) -> Column:
            return _fold(spec.fn, spec.expr).over(base.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1))

        def total(spec: Prefix) -> Column:
            if spec.fn != "last":
                return getattr(F, spec.fn)(spec.expr)
            place = F.when(spec.expr.isNotNull(), F.struct(*order))
            return F.min_by(spec.expr, place) if self.reverse else F.max_by(spec.expr, place)

        if not self.hot:
            return rows.select("*", *[running(s).alias(n) for n, s in specs.items()])
        scanned = rows.select("*", *[running(s).alias(f"_w_{n}") for n, s in specs.items()])
        slices = (
            rows.where(F.col("_slice") > 0).groupBy(*keys, "_slice")
            .agg(*[total(s).alias(f"_t_{n}") for n, s in specs.items()])
        )
        across = Window.partitionBy(*keys).orderBy(turn("_slice")).rowsBetween(Window.unboundedPreceding, -1)
        carry = slices.select(
            *keys, "_slice", *[_fold(s.fn, F.col(f"_t_{n}")).over(across).alias(f"_c_{n}") for n, s in specs.items()]
        )
        return scanned.join(carry, [*keys, "_slice"], "left").select(
            *rows.columns, *[_merge(s.fn, F.col(f"_c_{n}"), F.col(f"_w_{n}")).alias(n) for n, s in specs.items()]
        )


def prefix_scan(
    df: DataFrame, keys: list[str], order: list[str], specs: dict[str, Prefix],
    hot_rows: int = HOT_ROWS, reverse: bool = False,
) -> DataFrame:
    """Append one running column per spec, by `keys` along `order`; `reverse` runs from the end."""
    scan = SlicedScan(df, keys, order, hot_rows, reverse)
    return scan.run(scan.rows, specs).drop("_slice")
