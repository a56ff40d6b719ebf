"""Packing by optimal length buckets.

A histogram of all lengths goes to a dynamic programme that places at most
`buckets` upper bounds so that the padding of all rows to their bound is least.
Up to `grid` lengths are exact; longer ones are counted on steps of a 256th of
their size, which bounds the histogram whatever the table. Inside a bucket rows
form batches of as many rows as fit the token budget at the bucket's bound;
batches are numbered from counts by hashed cells, so no bucket meets in one task.

Defined results: a NULL or empty text has length 0 and pads to its bucket's
bound; a text longer than the budget is a batch of its own; equal lengths are
ordered by id and text hash; repeated rows are packed each; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import id_text, settle

GRID = 1024


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def step(length: str = "n_tokens", grid: int = GRID) -> Column:
    """The histogram cell of a length: itself, or beyond `grid` the upper end of a step of a 256th."""
    return F.expr(f"CASE WHEN {length} <= {grid} THEN {length} ELSE bigint(ceil({length} / pow(2D, floor(log2(double({length}))) - 8)) * pow(2D, floor(log2(double({length}))) - 8)) END")


def boundaries(lengths: np.ndarray, rows: np.ndarray, buckets: int) -> list[int]:
    """Bounds with the least sum of rows * (bound - length). `lengths` rise; the last is always a bound."""
    n = len(lengths)
    if not n:
        return []
    upto, weight = np.concatenate([[0], np.cumsum(rows)]), np.concatenate([[0], np.cumsum(rows * lengths)])
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        after, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            # a bucket over lengths[i:j], padded to lengths[j - 1]
            total = cost[:j] + lengths[j - 1] * (upto[j] - upto[:j]) - (weight[j] - weight[:j])
            cut[j] = int(np.argmin(total))
            after[j] = total[cut[j]]
        cuts.append(cut)
        cost = np.minimum(after, np.inf)
        cost[0] = 0
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = cut[j]
    return sorted(bounds)


def pack(docs: DataFrame, budget: int = 16384, buckets: int = 16, cell_rows: int = 20000) -> DataFrame:
    """doc_id, n_tokens, bucket_len, batch_id (within the bucket), place (within the batch), batch_capacity and padding, a row for each row of `docs`."""
    rows = settle(id_text(docs).select("doc_id", token_count(F.col("text")).alias("n_tokens"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")))
    found = rows.groupBy(step().alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("most")).orderBy("cell").toArrow()
    count = found.column("n").to_numpy().astype(np.int64)
    bounds = boundaries(np.maximum(found.column("most").to_numpy().astype(np.int64), 1), count, buckets)
    if not bounds:
        return rows.selectExpr("doc_id", "n_tokens", "0L AS bucket_len", "0L AS batch_id", "0L AS place", "0L AS batch_capacity", "0L AS padding")
    cells = -(-int(count.sum()) // cell_rows)
    bound = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bound = F.when(F.col("n_tokens") <= b, b).otherwise(bound)
    dealt = rows.withColumn("bucket_len", bound.cast("bigint")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "h"), F.lit(cells)))
    within = Window.partitionBy("bucket_len", "cell").orderBy("n_tokens", "doc_id", "h")
    before = Window.partitionBy("bucket_len").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("bucket_len", "cell").agg(F.count(F.lit(1)).alias("n")).select("bucket_len", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    placed = dealt.withColumn("at", F.row_number().over(within) - 1).join(totals, ["bucket_len", "cell"])
    capacity = f"greatest(1L, bigint(floor({budget}D / bucket_len)))"
    return placed.selectExpr(
        "doc_id", "n_tokens", "bucket_len", f"(earlier + at) DIV {capacity} AS batch_id", f"(earlier + at) % {capacity} AS place",
        f"{capacity} AS batch_capacity", "bucket_len - n_tokens AS padding",
    )
