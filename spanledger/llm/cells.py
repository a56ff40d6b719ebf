"""A stated set of query rows against all rows, in cells of bounded packs and bins.

Rows are dealt by a hash of their number into packs, query rows into bins. A cell
is one pack and one bin: pack rows are copied once for each bin and query rows
once for each pack, and the two sides meet by key. A cell holds a bounded number
of rows whatever the ids, labels or values are, so nothing is broadcast and no
key is hot. Each cell returns a few rows a query, and a ranking merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Components from here on count as not finite, so that squares and sums of them stay finite.
HUGE = "1e120D"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(column: str) -> Column:
    """True for vectors without NULL or non-finite components."""
    return F.expr(f"`{column}` IS NOT NULL AND NOT exists(`{column}`, x -> x IS NULL OR isnan(x) OR abs(x) >= {HUGE})")


def hashed(row: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("cell"), row), F.lit(n)).cast("int")


def every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def parts(rows: int, most: int) -> int:
    return max(1, -(-rows // most))


def meet(rows: DataFrame, packs: int, queries: DataFrame, bins: int, search: Callable[[pa.Table, pa.Table], pa.Table], kind: str) -> DataFrame:
    """`search(pack, bin)` for every cell; `rows` and `queries` carry `row`, `rows` may carry `pack`; `kind` names int and bigint columns."""
    if "pack" not in rows.columns:
        rows = rows.withColumn("pack", hashed("row", packs))
    left = rows.withColumn("bin", every(bins)).groupBy("pack", "bin")
    right = queries.withColumn("bin", hashed("row", bins)).withColumn("pack", every(packs)).groupBy("pack", "bin")
    fields = [field.split() for field in kind.split(", ")]
    nothing = pa.schema([(name, pa.int32() if of == "int" else pa.int64()) for name, of in fields]).empty_table()

    def run(pack: pa.Table, asked: pa.Table) -> pa.Table:
        # a side without rows comes without columns
        return search(pack, asked) if pack.num_rows and asked.num_rows else nothing

    return left.cogroup(right).applyInArrow(run, kind)


def integers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 x) of all components in one array, and the number of components of each row."""
    lists = pa.chunked_array(column.chunks, column.type).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * 256.0), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def largest(values: np.ndarray) -> float:
    return float(np.abs(values).max()) if len(values) else 0.0


def held(scores: np.ndarray) -> np.ndarray:
    """Python integers beyond a long, held at its ends."""
    return np.array([max(LEAST, min(MOST, s)) for s in scores.ravel().tolist()], object).reshape(scores.shape)


def as_long(scores: np.ndarray) -> pa.Array:
    return pa.array(scores.astype(np.int64), pa.int64())
