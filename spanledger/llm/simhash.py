"""Near duplicates by 64-bit SimHash and a binary-trie self-join.

A fingerprint bit is set if more than half of a text's 3-word shingles (repeats
included) have it set in their XXH64. Fingerprints within `bits` differing bits
link; a component is the smallest doc_id that links reach.

Of four 16-bit blocks (or six, of which three, for very many fingerprints) a
linked pair shares at least one, so pairs of trie nodes only start from equal
blocks: a key is a chosen block and its value. Groups of one key above `most`
rows are dealt into chunks, and every pair of chunks is a task of its own, so no
task holds more than two chunks. In a task the sorted fingerprints are a binary
trie; node pairs go down together, adding up differing bits, and are dropped
when the sum exceeds the budget. Tasks return star links of their local
components, never all pairs, and stars are joined into components at the end.

Defined results: a NULL, empty or blank text has fingerprint 0, linked like any
other; texts of one or two words have one shingle; rows with equal fingerprints
are one vertex; a NULL doc_id gets the component of its fingerprint, NULL if that
holds no id; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import forget, id_text, pieces, settle
from .graph import components

SEED = 42
#: Distinct fingerprints from which on 32 shared bits (three blocks of six) make a key.
MANY = 1 << 27


def shingles(text: bytes, size: int) -> list[bytes]:
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return [joined[a:b - 1] for a, b in zip(starts, starts[size:])]


def fingerprint_batch(texts: list[bytes | None], size: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = [digest(s, SEED) for s in shingles(text or b"", size)]
        if not hashes:
            continue
        ones = np.zeros(64, np.int64)
        values = np.array(hashes, np.uint64)
        for at in range(0, len(values), 1 << 16):
            bits = np.unpackbits(values[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int32)
        out[i] = np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, size: int = 3, also: list[str] | None = None) -> DataFrame:
    """doc_id, the fingerprint `fp` as a signed 64-bit integer and the bigint columns `also`, for every row."""
    names = [*(also or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                fp = fingerprint_batch(piece.column(1).cast(pa.binary()).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(fp.view(np.int64)), *piece.columns[2:]], ["doc_id", "fp", *names])

    given = docs.select("doc_id", "text", *names) if names else id_text(docs)
    return given.mapInArrow(run, "doc_id bigint, fp bigint" + "".join(f", {c} bigint" for c in names))


def trie_pairs(groups: np.ndarray, fps: np.ndarray, bits: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one group with at most `bits` differing bits. Rows are sorted by (group, fp as unsigned).

    Nodes are ranges of rows. A work list holds arrays of node pairs (a, b, differing
    bits, depth); arrays that grow too long are halved, so memory stays bounded.
    """
    n = len(fps)
    if n < 2:
        return
    new = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    ends = np.append(new[1:], n)
    several = ends - new > 1
    lo, hi = new[several], ends[several]
    work = [(lo, hi, lo, hi, np.zeros(len(lo), np.int64), 0)]
    ones: dict[int, np.ndarray] = {}
    while work:
        a0, a1, b0, b1, off, depth = work.pop()
        if not len(a0):
            continue
        if len(a0) > most:
            half = len(a0) // 2
            work += [tuple(x[:half] for x in (a0, a1, b0, b1, off)) + (depth,), tuple(x[half:] for x in (a0, a1, b0, b1, off)) + (depth,)]
            continue
        # small pairs of nodes: compare rows directly
        few = ((a1 - a0) * (b1 - b0) <= 64) | (depth == 64)
        if few.any():
            na, nb = (a1 - a0)[few], (b1 - b0)[few]
            sizes = na * nb
            for part in _parts(sizes, 4 << 20):
                size = sizes[part]
                which = np.repeat(np.arange(len(size)), size)
                k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                i = a0[few][part][which] + k // nb[part][which]
                j = b0[few][part][which] + k % nb[part][which]
                near = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= bits)
                if near.any():
                    yield i[near], j[near]
        more = ~few
        if not more.any():
            continue
        a0, a1, b0, b1, off = a0[more], a1[more], b0[more], b1[more], off[more]
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int64)
        c = ones[depth]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = a0 == b0
        parts = [(a0, am, b0, bm, off), (am, a1, bm, b1, off), (a0, am, bm, b1, off + 1)]
        other = ~same
        parts.append(tuple(x[other] for x in (am, a1, b0, bm, off + 1)))
        child = [np.concatenate([p[i] for p in parts]) for i in range(5)]
        alive = (child[0] < child[1]) & (child[2] < child[3]) & (child[4] <= bits) & ~((child[0] == child[2]) & (child[1] - child[0] < 2))
        work.append(tuple(x[alive] for x in child) + (depth + 1,))


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, upto)
        at = upto


def local_stars(groups: np.ndarray, fps: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of every linked row to the least row index of its local component."""
    label = np.arange(len(fps))
    for i, j in trie_pairs(groups, fps, bits):
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return ids[moved], ids[label[moved]]


def _keys(fp: str, many: bool) -> list[str]:
    """Bit strings that a linked pair shares one of, each with its own tag."""
    if not many:
        return [f"struct({i} AS rule, (shiftrightunsigned({fp}, {16 * i}) & 65535L) AS value)" for i in range(4)]
    blocks = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
    keys = []
    for rule, chosen in enumerate(combinations(blocks, 3)):
        mask = sum(((1 << width) - 1) << at for at, width in chosen)
        keys.append(f"struct({rule} AS rule, ({fp} & {mask - (1 << 64) if mask >> 63 else mask}L) AS value)")
    return keys


def links(rows: DataFrame, bits: int = 3, most: int = 8192, many: int = MANY) -> DataFrame:
    """Star links (u, v) between `id`s of distinct `fp`s that are within `bits` of each other, over rules and chunks."""
    spark = rows.sparkSession
    wide = rows.count() > many
    if bits > 3:
        raise ValueError("four blocks find pairs of at most three differing bits")
    keyed = rows.selectExpr("id", "fp", f"explode(array({', '.join(_keys('fp', wide))})) AS k").selectExpr("id", "fp", "k.rule AS rule", "k.value AS value")
    large = settle(keyed.groupBy("rule", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).selectExpr("rule", "value", f"ceil(n / {most}D) AS chunks"))
    if large.isEmpty():
        tasks = keyed.selectExpr("rule", "value", "0L AS pair", "id", "fp")
    else:
        # a row of chunk i belongs to the pairs (i, j) for all j; the list of large groups holds at most 4 * rows / most rows
        tasks = keyed.join(large, ["rule", "value"], "left").selectExpr("*", "pmod(xxhash64(fp), coalesce(chunks, 1L)) AS i").selectExpr(
            "rule", "value", "id", "fp", "i", "coalesce(chunks, 1L) AS chunks", "explode(sequence(0L, coalesce(chunks, 1L) - 1)) AS j"
        ).selectExpr("rule", "value", "least(i, j) * chunks + greatest(i, j) AS pair", "id", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def stars(rows: np.ndarray) -> pa.RecordBatch:
            fps = rows[:, 4].view(np.uint64)
            new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])
            group = np.cumsum(new)
            order = np.lexsort((fps, group))
            u, v = local_stars(group[order], fps[order], rows[order, 3], bits)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        count = 0
        for batch in batches:
            held.append(np.column_stack([c.cast(pa.int64()).to_numpy() for c in batch.columns]))
            count += batch.num_rows
            if count < 1 << 16:
                continue
            rows = np.concatenate(held)
            # whole groups only; the last one may go on in the next batch
            same = (rows[:, :3] == rows[-1, :3]).all(1)
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if last:
                yield stars(np.ascontiguousarray(rows[:last]))
            held, count = [rows[last:]], len(rows) - last
        if held:
            rows = np.concatenate(held)
            if len(rows):
                yield stars(np.ascontiguousarray(rows))

    found = tasks.repartition("rule", "value", "pair").sortWithinPartitions("rule", "value", "pair").mapInArrow(run, "u bigint, v bigint")
    return found


def grouped(prints: DataFrame, bits: int = 3) -> tuple[DataFrame, DataFrame]:
    """The settled distinct fingerprints (fp, id), and for each of them (fp, component, id); components without any id are negative."""
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    # fingerprints without any id still link others: they take part under negative numbers of their own
    spare = F.coalesce("id", -1 - F.pmod(F.xxhash64("fp"), F.lit(1 << 62)))
    found = components(links(classes.select(spare.alias("id"), "fp"), bits))
    return classes, classes.select("fp", spare.alias("id")).join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component"), "id")


def near_duplicates(prints: DataFrame, bits: int = 3) -> DataFrame:
    """doc_id, fp and component_id for every row of settled `prints` (doc_id, fp)."""
    classes, named = grouped(prints, bits)
    if classes.where("id IS NULL").isEmpty():
        out = named.select("fp", F.col("component").alias("component_id"))
    else:
        least = named.where("id >= 0 OR id IS NULL").groupBy("component").agg(F.min("id").alias("component_id"))
        out = named.join(least, "component", "left").select("fp", "component_id")
    return prints.join(out, "fp")


def deduplicate(docs: DataFrame, bits: int = 3) -> DataFrame:
    """The rows of `docs`, columns as they are, with one row of each component: the one with the smallest doc_id.

    Rows count by (doc_id, text): of several texts under one doc_id each is a member of its own component, and rows
    without a doc_id are members like any other, kept only where no member has one. Of rows that repeat both, one stays.
    """
    keyed = id_text(docs).withColumn("th", F.xxhash64("text"))
    prints = settle(fingerprints(keyed, also=["th"]))
    member = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("th").alias("th"))
    _, named = grouped(prints, bits)
    best = prints.groupBy("fp").agg(F.min(member).alias("best")).join(named.select("fp", "component"), "fp").groupBy("component").agg(F.min("best").alias("best"))
    times = prints.groupBy(member.alias("best")).agg(F.count(F.lit(1)).alias("times"))
    kept = settle(best.select("best").join(times, "best").select("best.*", "times"))
    key = ["unnamed", "id", "th"]
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row.doc_id").isNull().alias("unnamed"), F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(0)).alias("id"), F.xxhash64("row.text").alias("th"))
    # the list of kept rows grows with the documents, so it is never broadcast
    rows = inside.join(kept.where("times = 1").hint("merge"), key, "left_semi").select("row")
    again = kept.where("times > 1")
    if not again.isEmpty():
        rows = rows.unionByName(inside.join(again, key, "left_semi").groupBy(*key).agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row"))
    forget(prints)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
