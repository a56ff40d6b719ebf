"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 2 to 4 characters of the lower-cased whole text, with
logarithmic counts, inverse document frequencies over all training rows, and
unit length. Weights come from follow-the-regularised-leader with L1 and L2
penalties on a sample of every language: `per_lang` texts each (fewer if there are
so many languages that the sample would exceed `most` texts, but at least `least`),
smallest id hashes; longer texts than `max_bytes` are cut into several. Hashes are
compared with a bound that the language's number of rows gives, so the rows that are
ranked do not grow with the table. A temperature is fitted on a fifth of the sample.
One executor fits the model; weights travel sparse.

Defined results: a NULL text or one without a letter is `und` with score 0;
without any labelled row every text is `und`; of equally probable languages the first
by name is taken; a NULL language teaches nothing;
a NULL id is never held out and never learned from; repeated rows count each; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LOWER, Rolling, fitted, id_text, pieces, settle, utf8

DIM = 1 << 15
ORDERS = (2, 3, 4)
SCHEMA = "doc_id bigint, lang_pred string, score double"


def counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Counts by n-gram bucket, text after text."""
    data, bounds = utf8(column)
    rolling = Rolling(LOWER[data])
    # bytes that start a character, and the end of the last one
    start = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
    bounds = np.searchsorted(start, bounds)
    n = len(start) - 1
    buckets = [(rolling.spans(start[:max(0, n - k + 1)], start[k:max(k, n + 1)], k) & np.uint64(DIM - 1)).astype(np.int32) for k in ORDERS]
    for a, b in zip(bounds[:-1], bounds[1:]):
        total = np.zeros(DIM, np.int64)
        for k, of in zip(ORDERS, buckets):
            if b - a >= k:
                total += np.bincount(of[a:b - k + 1], minlength=DIM)
        yield total


def vectors(column: pa.Array, idf: np.ndarray) -> np.ndarray:
    rows = np.empty((len(column), DIM), np.float32)
    for i, c in enumerate(counts(column)):
        x = np.log1p(c, dtype=np.float32) * idf
        rows[i] = x / max(np.sqrt(x @ x), 1e-9)
    return rows


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Rows holding each bucket, over all rows of `docs`, and the rows themselves (bucket -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for piece in pieces(batch):
                for c in counts(piece.column(0)):
                    df += c > 0
                n += piece.num_rows
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(df[held], n))], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = found.column(0).to_numpy(), found.column(1).to_numpy()
    df = np.zeros(DIM, np.int64)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return df, int(n[bucket < 0].sum())


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def __getstate__(self) -> dict:
        at = np.flatnonzero(self.weights)
        return self.__dict__ | {"weights": (self.weights.shape, at, self.weights.ravel()[at])}

    def __setstate__(self, state: dict) -> None:
        shape, at, value = state["weights"]
        weights = np.zeros(shape, np.float32)
        weights.ravel()[at] = value
        self.__dict__.update(state | {"weights": weights})

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax((x @ self.weights + self.bias) / self.temperature)

    def predict(self, column: pa.Array, letter: np.ndarray) -> tuple[list[str], np.ndarray]:
        pred, score = np.full(len(column), "und", object), np.zeros(len(column))
        if not self.langs or not len(column):
            return pred.tolist(), score
        for at in range(0, len(column), 64):
            p = self.probabilities(vectors(column.slice(at, 64), self.idf))
            part = slice(at, at + len(p))
            pred[part] = np.array(self.langs, object)[p.argmax(1)]
            score[part] = p.max(1)
        pred[~letter], score[~letter] = "und", 0.0
        return pred.tolist(), np.clip(score, 0, 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


Sparse = list[tuple[np.ndarray, np.ndarray]]


def dense(rows: Sparse) -> np.ndarray:
    out = np.zeros((len(rows), DIM), np.float32)
    for i, (at, value) in enumerate(rows):
        out[i, at] = value
    return out


def ftrl(x: Sparse, y: np.ndarray, n_langs: int, epochs: int = 4, batch: int = 32, alpha: float = 1.0, l1: float = 0.05, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal steps on small batches; the bias has no penalty."""
    z, n = np.zeros((DIM, n_langs), np.float32), np.zeros((DIM, n_langs), np.float32)
    w, bias = np.zeros((DIM, n_langs), np.float32), np.zeros(n_langs, np.float32)
    rng, one = np.random.default_rng(7), np.eye(n_langs, dtype=np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at:at + batch]
            some = dense([x[i] for i in rows])
            wrong = softmax(some @ w + bias) - one[y[rows]]
            for k in range(0, DIM, 4096):  # parts, so that with many languages no further full tables are held
                part = slice(k, k + 4096)
                g = some[:, part].T @ wrong
                sigma = (np.sqrt(n[part] + g * g) - np.sqrt(n[part])) / alpha
                z[part] += g - sigma * w[part]
                n[part] += g * g
                w[part] = np.where(np.abs(z[part]) <= l1, 0, -(z[part] - np.sign(z[part]) * l1) / ((1 + np.sqrt(n[part])) / alpha + l2))
            bias -= 0.05 * wrong.sum(0)
    return w, bias


def fit(texts: pa.Array, langs: list[str], idf: np.ndarray) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], idf, np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32))
    x: Sparse = []
    for at in range(0, len(texts), 64):
        x += [(np.flatnonzero(row).astype(np.int32), row[row != 0]) for row in vectors(texts.slice(at, 64), idf)]
    y = np.array([names.index(v) for v in langs])
    order = np.random.default_rng(3).permutation(len(y))
    aside, rest = order[: len(y) // 5], order[len(y) // 5:]
    w, bias = ftrl([x[i] for i in rest], y[rest], len(names))
    model = Model(names, idf, w, bias)
    if len(aside):
        logits = np.concatenate([dense([x[i] for i in aside[at:at + 64]]) @ w + bias for at in range(0, len(aside), 64)])
        grid = np.geomspace(0.05, 20, 120)
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(aside)), y[aside]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, learn: Column, per_lang: int = 500, most: int = 32000, least: int = 20, max_bytes: int = 32768) -> Model:
    """Learn every language of the rows of `docs` (text, lang) where `learn` holds and neither is NULL."""
    rows = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id"), F.col("text"), F.col("lang"))
    df, n = frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # texts up to `max_bytes` are one sample; longer ones are cut after so many characters that no part exceeds it
    chars = max(1, max_bytes // 4)
    last = F.when(F.octet_length("text") <= max_bytes, 0).otherwise(F.expr(f"(char_length(text) - 1) div {chars}"))
    cut = rows.where(F.octet_length("text") > 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("k"))
    # rows without an id are told apart by their texts
    id = F.coalesce("doc_id", F.xxhash64("text"))
    cut = cut.withColumn("h", F.when(F.col("k") == 0, F.xxhash64(F.lit("language"), id)).otherwise(F.xxhash64(F.lit("language"), id, "k")))
    per = settle(cut.groupBy("lang").agg(F.count(F.lit(1)).alias("parts")))
    n_langs = per.count()
    each = max(least, min(per_lang, most // max(1, n_langs)))
    keyed = cut.select("lang", "h")
    wide = 4.0
    while True:
        # a share of the range of hashes that holds `wide` times the rows wanted; more where copies share hashes
        share = F.least(F.lit(1.0), F.lit(wide * each) / F.col("parts"))
        upto = per.select("lang", "parts", F.when(share == 1.0, F.lit((1 << 63) - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("bigint")).alias("upto"))
        near = keyed.join(upto, "lang").where(F.col("h") <= F.col("upto"))
        short = upto.join(near.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "left").where(F.coalesce("n", F.lit(0)) < F.least(F.lit(each), F.col("parts")))
        if short.isEmpty():
            break
        wide *= 8
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # the bounds come from hashes alone, so that only the texts of one sample move
    several = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(each).cast("bigint"), F.col("n"))))
    ranked = near.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")).select("lang", "h", several.alias("copy"))
    # stored, so that the size of a row for each language is known and no text moves to meet them
    bounds = settle(ranked.withColumn("place", place).where(F.col("place") <= each).groupBy("lang").agg(F.max("h").alias("bound")))
    own = cut.join(bounds, "lang").where(F.col("h") <= F.col("bound")).withColumn("th", F.xxhash64("text"))
    part = F.when(F.octet_length("text") <= max_bytes, F.col("text")).otherwise(F.expr(f"substring(text, int(k * {chars} + 1), {chars})"))
    own = own.select("lang", "h", "doc_id", "th", "k", part.alias("text"))
    # copies meet before they are ranked, so that a text that a third of all rows repeat is a few rows here
    own = own.groupBy("lang", "h", "doc_id", "th", "k").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("n")).select("*", several.alias("copy"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "th", "k", "copy"))

    def run(sample: pa.Table) -> Model:
        sample = sample.sort_by([("lang", "ascending"), ("place", "ascending")])
        return fit(sample.column("text").combine_chunks(), sample.column("lang").to_pylist(), idf)

    return fitted(own.withColumn("place", place).where(F.col("place") <= each).select("lang", "place", "text"), run) or fit(pa.array([], pa.string()), [], idf)


def _with_letter(docs: DataFrame) -> DataFrame:
    return id_text(docs).withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every row of `docs`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                pred, score = model.predict(piece.column(1), piece.column(2).to_numpy(zero_copy_only=False).astype(bool))
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return _with_letter(docs).mapInArrow(run, SCHEMA)


def identified(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows of `docs`, columns as they are, whose language is known with a score of `least` or more."""
    names = list(docs.columns)
    at = names.index("text")
    flagged = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, f"c{at}"):
                letter = piece.column(piece.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                pred, score = model.predict(piece.column(at), letter)
                keep = letter & (score >= least)
                cols = [piece.column(i) for i in range(piece.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep))

    return flagged.mapInArrow(run, docs.schema)
