"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Principal axes and a rotation that balances the binary codes are learned on a
bounded sample of distinct vectors (`sample`); every distinct vector is coded
and indexed. Codes are cut into 16-bit substrings, one table each; a vector
probes its own substring and those that differ in one bit. Whether that is enough depends on
how vectors lie: about a common direction, centring stretches the angle of a pair at the
threshold. So pairs at exactly the threshold are made around the sample's vectors, and further
rotations are learned, each with its tables, until `recall` of these pairs meet (32 rotations at most).
The same pairs give the largest number of differing bits that is looked at. Pairs that meet
are ranked by cosine of the original vectors in double precision.

A key that many codes share, as those of a dense cluster do, is dealt into chunks on
both sides, so that a task holds one pair of chunks.

Links are kept between distinct vectors only; copies count through class sizes.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite
parts link with nothing (component: their own id); vectors of other lengths than
most have are compared among their own length only; vectors whose norm is too large or too
small for a double are scaled first; ties keep the smaller id; repeated rows
are each other's copies; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import settle
from .graph import components

BITS = 64
SUB = 16
TABLES = BITS // SUB


def learn(sample: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (d x bits): principal axes, then a rotation that brings the codes near the corners."""
    centre = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
    x = sample - centre
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    rng = np.random.default_rng(seed)
    if axes.shape[1] < bits:
        # fewer dimensions than bits: further random directions
        axes = np.hstack([axes, rng.normal(size=(len(axes), bits - axes.shape[1]))])
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    y = x @ axes
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(y.T @ np.where(y @ turn > 0, 1.0, -1.0))
        turn = u @ vt
    return centre, axes @ turn


def at_threshold(x: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector another with a cosine of `threshold`: half of them off in any direction, half towards other vectors."""
    off = rng.normal(size=x.shape)
    off[::2] = x[rng.permutation(len(x))][::2] - x[::2]
    off -= (off * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(off, axis=1, keepdims=True)
    off = np.divide(off, size, out=np.zeros_like(off), where=size > 1e-9)
    y = threshold * x + (1 - threshold**2) ** 0.5 * off
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def rotations(sample: np.ndarray, threshold: float, recall: float, most: int = 32) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int], float]:
    """(centre, projection) and largest distance of each rotation, and the recall of the made pairs: the lower one of their halves."""
    rng = np.random.default_rng(5)
    x = sample[:4096]
    y = at_threshold(x, threshold, rng)
    met, learned, radii = np.zeros(len(x), bool), [], []
    reached = lambda: float(min(part.mean() for part in (met[::2], met[1::2]) if len(part)))
    while len(learned) < most and reached() < recall:
        centre, plane = learn(sample, seed=11 + len(learned))
        differ = ((x - centre) @ plane > 0) != ((y - centre) @ plane > 0)
        far = differ.sum(1)
        radii.append(int(np.quantile(far, 0.995)) + 1)
        met |= (differ.reshape(len(x), TABLES, SUB).sum(2).min(1) <= 1) & (far <= radii[-1])
        learned.append((centre, plane))
    return learned, radii, reached()


def links(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.98, sample: int = 8192, chunk: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Settled classes (id, vec, n, len) of `vectors` (vec_id, vec) and settled pairs (a, b) of class ids with cosine >= threshold."""
    good = "size(vec) > 0 AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(vec, x -> x != 0)"
    clean = vectors.where(good).select("vec_id", F.expr("transform(vec, x -> if(x = 0, 0D, x))").alias("vec"))
    norm = "sqrt(aggregate(vec, 0D, (s, x) -> s + (x / scale) * (x / scale)))"
    classes = settle(
        clean.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.xxhash64(F.first("vec")).alias("h")).withColumn("scale", F.lit(1.0)).withColumn("norm", F.expr(norm))
        .withColumn("scale", F.expr("if(norm > 1e-140D AND norm < 1e140D, 1D, array_max(transform(vec, x -> abs(x))))")).withColumn("norm", F.expr(norm)).withColumn("len", F.size("vec"))
    )
    spark = vectors.sparkSession
    scaled = classes.withColumn("vec", F.expr("if(scale = 1D, vec, transform(vec, x -> x / scale))"))
    pairs = None
    lengths = [r["len"] for r in classes.groupBy("len").count().orderBy(F.desc("count"), "len").collect()]
    for width in lengths:
        own = scaled.where(F.col("len") == width)
        rows = own.orderBy("h", "id").limit(sample).select("vec").toArrow().column("vec").combine_chunks()
        seen = rows.flatten().to_numpy().reshape(-1, width)
        learned, radii, _ = rotations(seen / np.linalg.norm(seen, axis=1, keepdims=True), threshold, recall)
        found = _pairs(own, width, learned, radii, threshold, chunk)
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        pairs = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    return classes, settle(pairs)


def _pairs(classes: DataFrame, width: int, learned: list[tuple[np.ndarray, np.ndarray]], radii: list[int], threshold: float, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, width)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            codes = [np.packbits((x - centre) @ plane > 0, axis=1, bitorder="little").view(np.int64)[:, 0] for centre, plane in learned]
            each = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(codes, 1).ravel()), len(learned)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), each], ["id", "codes"])

    codes = settle(classes.select("id", "vec").mapInArrow(run, "id bigint, codes array<bigint>"))
    # a row for each rotation and table: the code of the rotation and its substring there
    cut = codes.selectExpr("id", "posexplode(codes) AS (turn, code)").selectExpr(
        "id", "turn", "code", f"posexplode(transform(sequence(0, {TABLES - 1}), t -> shiftrightunsigned(code, {SUB} * t) & {(1 << SUB) - 1}L)) AS (part, own)"
    ).selectExpr("id", "code", "turn", f"turn * {TABLES} + part AS tab", "own")
    flips = ", ".join(f"{v}L" for v in [0, *(1 << i for i in range(SUB))])
    large = settle(cut.groupBy("tab", F.col("own").alias("key")).count().where(F.col("count") > chunk).select("tab", "key", F.expr(f"ceil(count / {chunk})").alias("k")))

    def dealt(side: DataFrame, mine: str, theirs: str) -> DataFrame:
        """Rows with their own chunk, once for each chunk of the other side; keys that are not large have one."""
        k = F.coalesce("k", F.lit(1)).cast("bigint")
        return side.join(large, ["tab", "key"], "left").withColumn(mine, F.pmod(F.xxhash64("id"), k)).withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1))).drop("k")

    probe = dealt(cut.selectExpr("id", "code", "turn", "tab", f"explode(transform(array({flips}), f -> own ^ f)) AS key"), "p", "q").withColumnsRenamed({"id": "a", "code": "code_a"})
    index = dealt(cut.selectExpr("id", "code", "tab", "own AS key"), "q", "p").withColumnsRenamed({"id": "b", "code": "code_b"})
    radius = F.element_at(F.array(*[F.lit(r) for r in radii]), F.col("turn") + 1)
    near = probe.join(index, ["tab", "key", "p", "q"]).where(F.expr("a < b")).where(F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= radius).select("a", "b").distinct()
    left = classes.select(F.col("id").alias("a"), F.col("vec").alias("va"), F.col("norm").alias("na"))
    right = classes.select(F.col("id").alias("b"), F.col("vec").alias("vb"), F.col("norm").alias("nb"))
    cosine = "aggregate(zip_with(va, vb, (x, y) -> x * y), 0D, (s, x) -> s + x) / (na * nb)"
    return near.join(left, "a").join(right, "b").where(f"{cosine} >= {threshold}D").select("a", "b")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, recall: float = 0.98, sample: int = 8192, chunk: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `embeddings` (vec_id, embedding)."""
    vectors = embeddings.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    classes, pairs = links(vectors, threshold, recall, sample, chunk)
    found = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    size = classes.select(F.col("id").alias("other"), "n")
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    linked = both.join(size, "other").groupBy("id").agg(F.sum("n").alias("linked"))
    named = classes.select("id", "vec", "n").join(linked, "id", "left").join(found, "id", "left").select(
        F.col("vec").alias("class_vec"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component")
    )
    zeroed = vectors.withColumn("vec", F.expr("transform(vec, x -> if(x = 0, 0D, x))"))
    out = zeroed.join(named, F.col("vec") == F.col("class_vec"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
