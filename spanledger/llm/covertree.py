"""Hard negatives by best-first search of cover trees over norm-augmented vectors.

Every vector x of a tree gets the further component sqrt(M^2 - |x|^2), M being
the tree's largest norm, so that all lie on one sphere and the inner product with
a query (whose further component is 0) falls as the angle to it grows. Rows are
dealt into packs (`cells`), and each pack holds one cover tree a label. A node is
a row. Its children stand at levels: a level halves the radius, children of one
level are further than the level's radius from each other, and every row below a
child lies within that radius of it. A node keeps the angle that covers all below
it, which bounds their inner products with a query from both sides.

A query's search starts at the roots of the labels it asks for, takes the node
with the highest bound first and scores all its children exactly, in integers. A
node is skipped if its bounds lie outside of all windows that are asked for, or
do not reach the last of the k best rows found in each.

Two searches use this: positives (own label, one open window), then negatives
(other labels, one window for each positive).

Defined results: rows without id or label, NULL vectors and vectors with NULL or
non-finite components (1e120 or more counts so) take no part; missing components
count as 0; repeated rows are rows of their own, a repeated anchor is an anchor
each time, and its copies are its positives; ties go to the smaller id; scores
beyond a long are held at its ends first; an anchor without positives, and a positive
without negatives in its window, give no rows; an empty table gives none; further
columns are not read.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import cells
from .common import settle

#: Added to every covering angle: well above the rounding of cosines and angles.
SLACK = 1e-6
#: Angles up to this one are taken for equal directions.
SAME = 1e-7


def augmented(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Rows as unit vectors with the further component, and M."""
    norms = np.sqrt((x * x).sum(1))
    most = float(norms.max()) if len(norms) else 0.0
    if not most:
        return np.hstack([np.zeros_like(x), np.ones((len(x), 1))]), 0.0
    share = x / most
    return np.hstack([share, np.sqrt(np.maximum(0.0, 1.0 - (share * share).sum(1)))[:, None]]), most


def grow(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in breadth-first order; for each node in that order its covering angle, first child and number of children."""
    angle = lambda rows, p: np.arccos(np.clip(unit[rows] @ unit[p], -1.0, 1.0))
    everything = np.arange(1, len(unit))
    order, below = [0], [(everything, angle(everything, 0))]
    radius, first, count = [], [], []
    at = 0
    while at < len(order):
        p = order[at]
        rows, far = below[at]
        below[at] = None
        radius.append(float(far.max()) + SLACK if len(rows) else 0.0)
        first.append(len(order))
        while len(rows):
            level = far.max() / 2
            if level <= SAME:
                order.extend(rows.tolist())
                below.extend([(rows[:0], far[:0])] * len(rows))
                break
            out = rows[far > level]
            near = far <= level
            rows, far = rows[near], far[near]
            while len(out):
                child, others = out[0], out[1:]
                apart = angle(others, child)
                own = apart <= level
                order.append(int(child))
                below.append((others[own], apart[own]))
                out = others[~own]
        count.append(len(order) - first[-1])
        at += 1
    return np.array(order), np.array(radius), np.array(first), np.array(count)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Integer components as floats, one row a vector, missing ones 0."""
    values, lengths = cells.integers(column)
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


TREE = "pack int, row bigint, vec_id bigint, label bigint, vec array<double>, node int, root boolean, norm double, radius double, first int, children int"


def plant(rows: pa.Table) -> pa.Table:
    """The rows of one pack as nodes of its trees, one tree a label."""
    rows = rows.take(np.lexsort((rows.column("row").to_numpy(), rows.column("label").to_numpy())))
    x, label = matrix(rows.column("vec")), rows.column("label").to_numpy()
    cuts = np.flatnonzero(np.diff(label, prepend=label[0] - 1, append=label[-1] + 1)) if len(label) else np.zeros(1, int)
    order, root, norm, radius, first, children = [], [], [], [], [], []
    for a, b in zip(cuts, cuts[1:]):
        unit, most = augmented(x[a:b])
        kept, angle, child, count = grow(unit)
        order.append(a + kept)
        root.append(np.arange(b - a) == 0)
        norm.append(np.full(b - a, most))
        radius.append(angle)
        first.append(a + child)
        children.append(count)
    join = lambda p, t: pa.array(np.concatenate(p) if p else [], t)
    rows = rows.take(np.concatenate(order)) if order else rows
    rows = rows.select(["pack", "row", "vec_id", "label", "vec"])
    for name, values in [
        ("node", pa.array(np.arange(len(label)), pa.int32())), ("root", join(root, pa.bool_())), ("norm", join(norm, pa.float64())), ("radius", join(radius, pa.float64())),
        ("first", join(first, pa.int32())), ("children", join(children, pa.int32())),
    ]:
        rows = rows.append_column(name, values)
    return rows


class Forest:
    """The trees of one pack, searched by one query at a time."""

    def __init__(self, nodes: pa.Table, widest: int, exact: bool):
        nodes = nodes.take(np.argsort(nodes.column("node").to_numpy()))
        self.ids, self.rows, self.label = (nodes.column(c).to_numpy() for c in ("vec_id", "row", "label"))
        self.norm, self.radius, self.first, self.children = (nodes.column(c).to_numpy() for c in ("norm", "radius", "first", "children"))
        self.roots = np.flatnonzero(nodes.column("root").to_numpy(zero_copy_only=False))
        self.x = fit(matrix(nodes.column("vec")), widest, exact)

    def bounds(self, at: np.ndarray, scores: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of any row below the nodes `at`."""
        size = length * self.norm[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip(np.where(size > 0, scores.astype(np.float64) / size, 0.0), -1.0, 1.0))
        room = self.radius[at] + SLACK
        spare = size * SLACK
        least, most = size * np.cos(np.minimum(np.pi, angle + room)) - spare, size * np.cos(np.maximum(0.0, angle - room)) + spare
        return np.clip(least, cells.LEAST, cells.MOST), np.clip(most, cells.LEAST, cells.MOST)

    def search(self, q: np.ndarray, roots: np.ndarray, windows: list[tuple], k: int, own: int = -1) -> list[list[tuple[int, int]]]:
        """Per window (lowest, highest; None is open) the k best (score, id) of the rows under `roots`, ties by id."""
        length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        # bounds are compared as floats, which may round: a little wider than the scores
        low = np.array([-np.inf if a is None else np.nextafter(float(a), -np.inf) for a, _ in windows])
        high = np.array([np.inf if b is None else np.nextafter(float(b), np.inf) for _, b in windows])
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        bar = low.copy()
        queue: list[tuple[float, float, int]] = []

        def visit(at: np.ndarray) -> None:
            scores = self.x[at] @ q
            if scores.dtype == object:
                scores = cells.held(scores)
            seen = self.rows[at] != own
            for w, (a, b) in enumerate(windows):
                # equal to the last of the best is kept: its id decides
                good = seen & (scores >= best[w][-1][0]) if len(best[w]) == k else seen.copy()
                if a is not None:
                    good &= scores >= a
                if b is not None:
                    good &= scores <= b
                good = np.flatnonzero(good)
                if len(good):
                    found, ids = scores[good], self.ids[at[good]]
                    if len(good) > k:
                        cut = np.partition(found, len(good) - k)[len(good) - k]
                        keep = found >= cut
                        found, ids = found[keep], ids[keep]
                        # of rows that tie with the last, only the smallest ids can be among the best
                        first = np.array(sorted(range(len(ids)), key=lambda n: (-found[n], ids[n]))[:k]) if found.dtype == object else np.lexsort((ids, -found))[:k]
                        found, ids = found[first], ids[first]
                    merged = sorted([*((-s, i) for s, i in best[w]), *zip((-found).tolist(), ids.tolist())])[:k]
                    best[w] = [(-s, i) for s, i in merged]
                    if len(merged) == k:
                        bar[w] = np.nextafter(float(best[w][-1][0]), -np.inf)
            inner = self.children[at] > 0
            if inner.any():
                nodes = at[inner]
                least, most = self.bounds(nodes, scores[inner], length)
                for node, lo, hi in zip(nodes.tolist(), least.tolist(), most.tolist()):
                    if ((hi >= bar) & (lo <= high)).any():
                        heappush(queue, (-hi, lo, node))

        if len(roots) and windows:
            visit(roots)
        while queue:
            hi, lo, node = heappop(queue)
            if ((-hi >= bar) & (lo <= high)).any():
                a = self.first[node]
                visit(np.arange(a, a + self.children[node]))
        return best


def fit(x: np.ndarray, widest: int, exact: bool) -> np.ndarray:
    """As many columns as the widest vector; Python integers where doubles could round a score."""
    x = np.pad(x, ((0, 0), (0, widest - x.shape[1])))
    return x if exact else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


FOUND = "anchor bigint, anchor_id bigint, place int, positive_id bigint, positive_score bigint, found_id bigint, found_score bigint"


def searcher(k: int, negatives: bool, least: int, most: int):
    """Search of one cell: positives have one open window, negatives those of `positives` (score, id)."""

    def run(nodes: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        q = matrix(anchors.column("vec"))
        x = matrix(nodes.column("vec"))
        widest = max(q.shape[1], x.shape[1])
        # a hundred times a score must be exact as well
        exact = 100 * cells.largest(q.ravel()) * cells.largest(x.ravel()) * max(1, widest) < 1 << 53
        forest, q = Forest(nodes, widest, exact), fit(q, widest, exact)
        given = anchors.column("positives").to_pylist() if negatives else [None] * len(q)
        numbers, ids, labels = (anchors.column(c).to_pylist() for c in ("row", "vec_id", "label"))
        for i, row in enumerate(numbers):
            same = forest.label[forest.roots] == labels[i]
            if negatives:
                # floor and ceiling of the window in whole scores
                places = [p for p in given[i] if least * p["score"] <= most * p["score"]]
                windows = [(-(-least * p["score"] // 100), most * p["score"] // 100) for p in places]
                best = forest.search(q[i], forest.roots[~same], windows, k)
                out += [(row, ids[i], p["place"], p["id"], p["score"], found, int(score)) for p, rows in zip(places, best) for score, found in rows]
            else:
                out += [(row, ids[i], 0, None, None, found, int(score)) for score, found in forest.search(q[i], forest.roots[same], [(None, None)], k, row)[0]]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*out)) if out else [()] * 7
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def hard_negatives(
    vectors: DataFrame, asked: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
    id: str = "vec_id", label: str = "label", vector: str = "embedding", pack: int = 8192, bin: int = 256,
) -> DataFrame:
    """For each anchor (`asked` holds, over `vec_id`) and each of its best `positives` rows of its label, the best
    `negatives` rows of other labels whose score is `least` to `most` percent of the positive's."""
    named = vectors.select(F.col(f"`{id}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    rows = settle(named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & cells.usable("vec")).withColumn("row", F.monotonically_increasing_id()))
    packs = cells.parts(rows.count(), pack)
    trees = settle(rows.withColumn("pack", cells.hashed("row", packs)).groupBy("pack").applyInArrow(plant, TREE))
    anchors = rows.where(asked)
    bins = cells.parts(anchors.count(), bin)
    near = cells.meet(trees, packs, anchors, bins, searcher(positives, False, least, most), FOUND)
    first = Window.partitionBy("anchor").orderBy(F.desc("found_score"), "found_id")
    chosen = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives).groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("place", F.col("found_id").alias("id"), F.col("found_score").alias("score")))).alias("positives")
    )
    paired = settle(anchors.join(chosen, F.col("row") == F.col("anchor")).select("row", "vec_id", "label", "vec", "positives"))
    found = cells.meet(trees, packs, paired, bins, searcher(negatives, True, least, most), FOUND)
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("found_score"), "found_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("found_score").alias("negative_score"))
