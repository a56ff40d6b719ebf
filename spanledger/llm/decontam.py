"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is `size` consecutive words of a benchmark item (a shorter item is one
window). Fingerprints are the least hash of the k-grams inside each window: equal
windows have equal fingerprints, so every shared span of `size` words or more is
found by joining the fingerprint sets. Hits extend to exact word windows, which
are compared as text, and hit windows to the spans that they cover.

Defined results: a NULL or wordless text has no words, no hit and the digest of
the empty list; items without words match nothing; an item without an id marks
words but is not listed; repeated items or ids count once; repeated documents
are reported each; an empty benchmark leaves all clean; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import id_text, settle

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts of ASCII alone take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column behind a generator: computed once a row, since the optimiser does not copy it into the lambdas that read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_words(df: DataFrame) -> DataFrame:
    return _once(df, "words", F.coalesce(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>")))


def grams(n: int) -> str:
    """Hashes of all n-grams of `words`, in order."""
    inside = ", ".join(f"get(words, i + {k})" for k in range(1, n))
    return f"transform(slice(words, 1, greatest(0, size(words) - {n - 1})), (x, i) -> xxhash64({n}, x{', ' + inside if inside else ''}))"


def with_marks(df: DataFrame, lengths: list[int], size: int, k: int) -> DataFrame:
    """Column `marks{n}` for each length: a fingerprint for each window of n words."""
    for n in lengths:
        if n < size:
            df = _once(df, f"marks{n}", F.expr(grams(n)))
        else:
            wide = size - k + 1
            least = ", ".join(f"get(grams, i + {j})" for j in range(1, wide))
            df = _once(df, "grams", F.expr(grams(k)))
            df = _once(df, f"marks{n}", F.expr(f"transform(slice(grams, 1, greatest(0, size(words) - {size - 1})), (x, i) -> least(x, {least}))")).drop("grams")
    return df


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, k: int = 5) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items = with_words(id_text(benchmark, "item_id").withColumnRenamed("doc_id", "item_id")).where("size(words) > 0").withColumn("n", F.least(F.size("words"), F.lit(size)))
    # at most `size` different lengths, whatever the benchmark
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())
    base = id_text(docs).withColumn("h", F.xxhash64("text"))
    if not lengths:
        empty = with_words(base)
        return empty.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    marked_items = with_marks(items, lengths, size, k)
    windows = settle(reduce(DataFrame.unionByName, [
        marked_items.where(F.col("n") == n).select("item_id", F.lit(n).alias("n"), F.posexplode(f"marks{n}").alias("i", "mark"), "words")
        .select("item_id", "n", "mark", F.array_join(F.slice("words", F.col("i") + 1, F.lit(n)), " ").alias("span")) for n in lengths
    ]).distinct())
    prints = windows.select(F.struct("n", "mark").alias("f")).distinct()
    every = F.expr("concat(" + ", ".join(f"transform(array_distinct(marks{n}), m -> named_struct('n', {n}, 'mark', m))" for n in lengths) + ")")
    # texts are cut into words once: counts and distinct fingerprints of all rows settle
    marked = settle(with_marks(with_words(base), lengths, size, k).select("doc_id", "h", F.size("words").cast("bigint").alias("n_words"), every.alias("fs")))
    found = marked.select("doc_id", "h", F.explode("fs").alias("f")).join(prints, "f", "left_semi")
    # the fingerprints of a document that some item has
    hits = settle(found.groupBy("doc_id", "h").agg(F.collect_set("f").alias("fs")))
    same = base["doc_id"].eqNullSafe(hits["doc_id"]) & (base["h"] == hits["h"])
    near = with_words(base.join(hits, same, "left_semi").dropDuplicates(["doc_id", "h"]))
    near = with_marks(near, lengths, size, k).join(hits.withColumnsRenamed({"doc_id": "hit_id", "h": "hit_h"}), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")))
    shared = reduce(DataFrame.unionByName, [
        near.select("doc_id", "h", F.lit(n).alias("n"), "words", F.expr(f"transform(filter(fs, f -> f.n = {n}), f -> f.mark) AS own"), f"marks{n}")
        .select("doc_id", "h", "n", "words", F.explode(F.expr(f"filter(transform(marks{n}, (m, i) -> if(array_contains(own, m), i, -1)), i -> i >= 0)")).alias("i"))
        .select("doc_id", "h", "n", "i", F.array_join(F.slice("words", F.col("i") + 1, F.lit(n)), " ").alias("span")) for n in lengths
    ])
    exact = settle(shared.join(windows.select("n", "span").distinct(), ["n", "span"]))
    # words covered: starts in order, each window adds what the one before has not covered
    covered = exact.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("i", "n"))).alias("at")).select(
        F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"),
        F.expr("aggregate(at, named_struct('upto', 0, 'hit', 0L), (s, w) -> named_struct('upto', greatest(s.upto, w.i + w.n), 'hit', s.hit + greatest(0, w.i + w.n - greatest(s.upto, w.i))), s -> s.hit)").alias("n_hit"),
    )
    listed = (
        exact.select("doc_id", "h", "n", "span").distinct().join(windows.select("n", "span", F.col("item_id").cast("string").alias("item")), ["n", "span"])
        .select("doc_id", "h", "item").distinct().groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("item")).alias("items"))
        .select(F.col("doc_id").alias("i_id"), F.col("h").alias("i_h"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    )
    sizes = marked.select("doc_id", "h", "n_words")
    return (
        sizes.join(covered, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left")
        .join(listed, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("h") == F.col("i_h")), "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, k: int = 5) -> DataFrame:
    """The rows of `docs`, columns as they are, without those that share a window with the benchmark.

    A row without doc_id goes if any such row is contaminated only when its own text is: texts are compared by hash.
    """
    keyed = docs.select(F.col("doc_id"), F.col("text"))
    bad = settle(contamination(keyed.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text"), benchmark, size, k).where("contaminated").select("doc_id.doc_id", "doc_id.h").distinct())
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = inside.join(bad, F.col("row.doc_id").eqNullSafe(bad["doc_id"]) & (F.xxhash64("row.text") == bad["h"]), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
