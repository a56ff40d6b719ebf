"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A component of a vector is a term, its integer value floor(256 x) a weight; zero
weights are not stored. In each cell (`cells`) the pack's rows are inverted into
postings, one list of (row, weight) a term. Query rows, as sparse term lists,
take one term after another and scatter the products of weights into dense score
arrays, one a query. A partition of each score array selects the k best of the
pack, with all rows that tie with the last, and a ranking merges the packs.

Sums are exact: arrays are single or double floats where every partial sum fits
their integers, and Python integers beyond.

Defined results: rows without an id, NULL vectors and vectors with NULL or
non-finite components (1e120 or more counts so) take no part; an empty vector has
no terms and scores 0; vectors of different lengths share their first terms;
repeated rows are rows of their own, so a query's copy is one of its candidates;
ties go to the smaller id; a score beyond a long is held at its end
before rows are ranked; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import cells
from .common import settle

KIND = "query bigint, query_id bigint, vec_id bigint, score bigint"


class Postings:
    """Per term, the rows that hold it and their weights; `rows` may be a slice of a table's rows."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        row = np.repeat(np.arange(len(lengths)), lengths)
        first = np.cumsum(lengths) - lengths
        term = np.arange(len(values)) - np.repeat(first, lengths)
        held = np.flatnonzero(values)
        held = held[np.argsort(term[held], kind="stable")]
        self.n, self.row, self.weight = len(lengths), row[held], values[held]
        self.terms, start = np.unique(term[held], return_index=True)
        self.bounds = np.append(start, len(held))
        self.longest = int(lengths.max()) if len(lengths) else 0

    def lists(self, dtype: type) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
        """(rows, weights) by term; rows None: all of them."""
        weight = np.array([int(w) for w in self.weight], object) if dtype is object else self.weight.astype(dtype)
        out = {}
        for t, a, b in zip(self.terms.tolist(), self.bounds, self.bounds[1:]):
            rows, held = self.row[a:b], weight[a:b]
            if 4 * len(rows) > self.n:
                # a term that many rows hold: a weight for every row, so that sums run straight through
                full = np.zeros(self.n, dtype) if dtype is not object else np.full(self.n, 0, object)
                full[rows] = held
                rows, held = None, full
            out[t] = (rows, held)
        return out


def accumulate(index: dict, n: int, queries: dict, m: int, dtype: type) -> np.ndarray:
    """Dense scores (m queries x n rows), one term after another."""
    scores = np.zeros((m, n), dtype) if dtype is not object else np.full((m, n), 0, object)
    room = np.empty_like(scores)
    for term, (asked, weight) in queries.items():
        if term not in index:
            continue
        rows, weights = index[term]
        if asked is None and rows is None:
            scores += np.multiply.outer(weight, weights, out=room)
        elif rows is None:
            scores[asked] += np.multiply.outer(weight, weights)
        elif asked is None:
            scores[:, rows] += np.multiply.outer(weight, weights)
        else:
            scores[np.ix_(asked, rows)] += np.multiply.outer(weight, weights)
    return cells.held(scores) if dtype is object else scores


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of each query's k best rows, its own (-1: not here) left out; ties by id."""
    m, n = scores.shape
    here = np.flatnonzero(own >= 0)
    low = -np.inf if scores.dtype != object else -(1 << 4096)
    scores[here, own[here]] = low
    k = min(k, n)
    bar = np.partition(scores, n - k, axis=1)[:, n - k]
    asked, row = np.nonzero((scores >= bar[:, None]) & (scores != low))
    # decreasing scores within a query, then increasing ids
    by_id = np.argsort(ids[row], kind="stable")
    asked, row = asked[by_id], row[by_id]
    by_score = np.argsort(-scores[asked, row], kind="stable")
    asked, row = asked[by_score], row[by_score]
    by_query = np.argsort(asked, kind="stable")
    asked, row = asked[by_query], row[by_query]
    rank = np.arange(len(asked)) - np.searchsorted(asked, asked)
    return asked[rank < k], row[rank < k]


def search(k: int, block: int = 16):
    def run(pack: pa.Table, asked: pa.Table) -> pa.Table:
        values, lengths = cells.integers(pack.column("vec"))
        wanted, sizes = cells.integers(asked.column("vec"))
        index = Postings(values, lengths)
        bound = cells.largest(values) * cells.largest(wanted) * max(1, min(index.longest, int(sizes.max())))
        dtype = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
        lists, n = index.lists(dtype), pack.num_rows
        ids, numbers = pack.column("vec_id").to_numpy(), pack.column("row").to_numpy()
        query, query_id = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
        order = np.argsort(numbers)
        at = np.searchsorted(numbers, query, sorter=order)
        own = order[np.minimum(at, n - 1)]
        own = np.where(numbers[own] == query, own, -1)
        ends = np.append(0, np.cumsum(sizes))
        out = []
        for a in range(0, len(query), block):
            b = min(a + block, len(query))
            queries = Postings(wanted[ends[a]:ends[b]], sizes[a:b]).lists(dtype)
            scores = accumulate(lists, n, queries, b - a, dtype)
            q, r = select(scores, ids, own[a:b], k)
            out.append(pa.table([pa.array(query[a + q]), pa.array(query_id[a + q]), pa.array(ids[r]), cells.as_long(scores[q, r])], ["query", "query_id", "vec_id", "score"]))
        return pa.concat_tables(out)

    return run


def top_k(vectors: DataFrame, asked: Column, k: int, id: str = "vec_id", vector: str = "embedding", pack: int = 16384, bin: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows of every row for which `asked` (over `vec_id`) holds."""
    named = vectors.select(F.col(f"`{id}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    rows = settle(named.where(F.col("vec_id").isNotNull() & cells.usable("vec")).withColumn("row", F.monotonically_increasing_id()))
    queries = rows.where(asked)
    found = cells.meet(rows, cells.parts(rows.count(), pack), queries, cells.parts(queries.count(), bin), search(k), KIND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
