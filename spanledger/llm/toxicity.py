"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

P(grade <= k) = sigmoid(cut_k - w.x) with one weight vector for all ordered cuts;
the expected grade is the severity. Features are the distinct words of a whole
text and their leading 4 and 6 bytes, so that inflected forms share weight.

The model is fitted on a bounded sample of labelled rows (`per_class` each, the
smallest hashes of the id, of texts up to `max_bytes`); every row is scored.
Grades beyond 0/1 come from the labels themselves: labelled toxic rows above the
median number of distinct marked features form grade 2.

Defined results: a NULL or empty text has no features and gets the severity of
the cuts alone; NULL labels and labels without a document teach nothing; without
labelled rows of both kinds every severity is 0; repeated rows are scored each;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, Rolling, fitted, id_text, pieces, utf8, words

SCHEMA = "doc_id bigint, severity double, grade int, p_toxic double, toxic boolean"


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and feature hashes of a text column, repeats included."""
    data, bounds = utf8(column)
    data = LOWER[data]
    row, start, end = words(data, bounds)
    if not len(row):
        return row, np.zeros(0, np.uint64)
    rolling = Rolling(data)
    rows, hashes = [row], [rolling.spans(start, end)]
    for n in (4, 6):
        long = end - start > n
        rows.append(row[long])
        hashes.append(rolling.spans(start[long], start[long] + n, n))
    return np.concatenate(rows), np.concatenate(hashes)


def distinct(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, rows))
    rows, ids = rows[order], ids[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    return rows[new], ids[new]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """Weights by feature hash (sorted), the ordered cuts and the least probability that flags a row; without cuts every row is grade 0."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    threshold: float = 0.5

    def grades(self, column: pa.Array) -> np.ndarray:
        """Probability of each grade, a row per text."""
        sums = np.zeros(len(column))
        rows, hashes = features(column)
        if len(rows) and len(self.keys):
            maybe = np.zeros(1 << 16, bool)
            maybe[self.keys & np.uint64(0xFFFF)] = True
            near = maybe[hashes & np.uint64(0xFFFF)]
            rows, hashes = rows[near], hashes[near]
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            rows, at = distinct(rows[hit], at[hit])
            sums = np.bincount(rows, self.weights[at], len(column))
        upto = np.hstack([_sigmoid(self.cuts[None, :] - sums[:, None]), np.ones((len(column), 1))])
        return np.diff(upto, axis=1, prepend=0.0)


def fit_ordinal(x_rows: np.ndarray, x_cols: np.ndarray, n_cols: int, grade: np.ndarray, l1: float, l2: float, steps: int, row_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts by accelerated proximal gradient; `x` holds the ones of a sparse matrix."""
    k = int(grade.max())
    w = np.zeros(n_cols)
    share = np.array([row_weight[grade <= i].sum() for i in range(k)]) / row_weight.sum()
    cuts = np.log(share / (1 - share))
    total, seen = row_weight.sum(), np.zeros(n_cols)
    g2w, g2c = np.full(n_cols, 1e-8), np.full(k, 1e-8)
    low, high = np.maximum(grade - 1, 0), np.minimum(grade, k - 1)
    for _ in range(steps):
        s = np.bincount(x_rows, w[x_cols], len(grade))
        up = np.where(grade < k, _sigmoid(cuts[high] - s), 1.0)
        down = np.where(grade > 0, _sigmoid(cuts[low] - s), 0.0)
        p = np.maximum(up - down, 1e-9)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        # d(-log p)/ds, and by cut: raising the upper cut raises p, raising the lower one lowers it
        gs = row_weight * (d_up - d_down)
        gw = np.bincount(x_cols, gs[x_rows], n_cols) / total + l2 * w
        gc = (np.bincount(low[grade > 0], (row_weight * d_down)[grade > 0], k) - np.bincount(high[grade < k], (row_weight * d_up)[grade < k], k)) / total
        g2w, g2c = g2w + gw**2, g2c + gc**2
        rate = 0.5 / np.sqrt(g2w)
        w = w - rate * gw
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        cuts = np.maximum.accumulate(cuts - 0.5 / np.sqrt(g2c) * gc)
        seen += w != 0
    return w, cuts


def copy_weights(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """One over the number of rows with the same two least feature hashes: copies of a text count about once together."""
    sketch = np.full((n, 2), np.iinfo(np.uint64).max, np.uint64)
    for i, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        np.minimum.at(sketch[:, i], rows, hashes * np.uint64(odd))
    _, group, size = np.unique(sketch, axis=0, return_inverse=True, return_counts=True)
    return 1 / size[group.ravel()]


def fit(sample: pa.Table, columns: int = 4096, min_rows: int = 10, l1: float = 3e-3, l2: float = 1e-4, steps: int = 300) -> Ordinal:
    """`sample`: text and toxic (0/1)."""
    toxic = sample.column("toxic").to_numpy().astype(int)
    if not len(toxic) or toxic.min() == toxic.max():
        return Ordinal()
    rows, hashes = [], []
    at = 0
    for batch in sample.combine_chunks().to_batches():
        for piece in pieces(batch):
            r, h = distinct(*features(piece.column(piece.schema.get_field_index("text"))))
            rows.append((r + at).astype(np.int32))
            hashes.append(h)
            at += piece.num_rows
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    weight = copy_weights(rows, hashes, len(toxic))
    keys, cols = np.unique(hashes, return_inverse=True)
    count = np.bincount(cols, weight[rows], len(keys))
    # keep the features that tell most: difference of the shares of rows, in standard errors
    in_toxic = np.bincount(cols, (toxic * weight)[rows], len(keys))
    n1, n0 = (toxic * weight).sum(), ((1 - toxic) * weight).sum()
    p = np.minimum(count / weight.sum(), 1)
    z = np.abs(in_toxic / n1 - (count - in_toxic) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    able = (count >= min(min_rows, max(2, len(toxic) // 50))) & (z > 2)
    chosen = np.flatnonzero(able)[np.argsort(-z[able], kind="stable")[:columns]]
    place = np.full(len(keys), -1)
    chosen.sort()
    place[chosen] = np.arange(len(chosen))
    used = place[cols] >= 0
    rows, cols = rows[used], place[cols[used]]
    # the L1 penalty chooses the features; what is chosen is fitted again without it, so that scores lie apart
    w, _ = fit_ordinal(rows, cols, len(chosen), toxic, l1, l2, steps, weight)
    chosen, used = chosen[w != 0], (w != 0)[cols]
    rows, cols = rows[used], (np.cumsum(w != 0) - 1)[cols[used]]
    w, cuts = fit_ordinal(rows, cols, len(chosen), toxic, 0.0, l2, steps, weight)
    marked = np.bincount(rows, (w > 0.1)[cols], len(toxic))
    grade = toxic + ((toxic == 1) & (marked > np.median(marked[toxic == 1])))
    if grade.max() == 2 and (grade == 1).any():
        w, cuts = fit_ordinal(rows, cols, len(chosen), grade, 0.0, l2, steps, weight)
    kept = w != 0
    # between a quarter and a half: as low as 99.8 % of the sample's clean rows allow
    over = 1 - _sigmoid(cuts[0] - np.bincount(rows, w[cols], len(toxic)))
    threshold = float(np.clip(np.quantile(over[toxic == 0], 0.998), 0.25, 0.5))
    return Ordinal(keys[chosen][kept], w[kept], cuts, threshold)


def labelled(docs: DataFrame, labels: DataFrame, per_class: int, max_bytes: int) -> DataFrame:
    """The bounded sample: for each label the rows with the smallest id hashes."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    # twice as many ids as rows wanted, since some have no text or a long one
    picked = [known.where(F.col("toxic") == c).orderBy(order).limit(2 * per_class) for c in (0, 1)]
    near = id_text(docs).where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    both = near.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    of = [both.where(F.col("toxic") == c).select("text", "toxic", "doc_id", order.alias("h"), F.xxhash64("text").alias("th")).orderBy("h", "doc_id", "th").limit(per_class) for c in (0, 1)]
    return of[0].unionByName(of[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_bytes: int = 32768) -> Ordinal:
    """The model of a bounded sample, fitted by one executor."""
    def run(sample: pa.Table) -> Ordinal:
        return fit(sample.sort_by([(c, "ascending") for c in ("toxic", "h", "doc_id", "th")]).select(["text", "toxic"]))

    return fitted(labelled(docs, labels, per_class, max_bytes), run) or Ordinal()


def score(docs: DataFrame, model: Ordinal, threshold: float | None = None) -> DataFrame:
    """doc_id, severity (expected grade), grade (most probable), p_toxic and toxic for every row."""
    least = model.threshold if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                p = model.grades(piece.column(1))
                over = 1 - p[:, 0]
                yield pa.RecordBatch.from_arrays([
                    piece.column(0).cast(pa.int64()), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1).astype(np.int32)),
                    pa.array(over), pa.array(over >= least),
                ], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return id_text(docs).mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, model: Ordinal, threshold: float | None = None) -> DataFrame:
    """The rows of `docs`, columns as they are, that the model does not reject."""
    at = docs.columns.index("text")
    least = model.threshold if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield piece.filter(pa.array(1 - model.grades(piece.column(at))[:, 0] < least))

    return docs.mapInArrow(run, docs.schema)
