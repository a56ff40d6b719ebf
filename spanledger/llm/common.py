"""Reading the given tables, settled intermediate results, and byte-level text helpers."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: ASCII letters and digits and every byte of a non-ASCII character.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write once to the folder that all executors share and read it back: short lineage, computed once."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    path = f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled = path
    return back


def forget(*frames: DataFrame) -> None:
    """Delete settled results that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_settled", None):
            sc = df.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object | None:
    """`fit` over all rows of a bounded sample, in one task of an executor; None without rows. Only the model comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(held)))], pa.binary())], ["model"])

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(rows[0]["model"])) if rows else None


def crc_of_id(doc_id: Column) -> Column:
    """The CRC32 of the id's decimal text; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def id_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text, so that no further column of the input can clash."""
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` text bytes each, or a single longer row."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (NULL counts as empty) and the n + 1 row bounds within them."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _table(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        # a whole number of MiB, so that it seldom has to grow
        size = -(-n // (1 << 20)) << 20
        row = np.full(size, base, np.uint64)
        row[0] = 1
        _powers[base] = np.multiply.accumulate(row)
    return _powers[base][:n] if n else np.zeros(0, np.uint64)


class Rolling:
    """64-bit hashes of any spans of one byte buffer, each from two prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table(_ODD, len(data)), out=self.sums[1:])
        self.unshift = _table(_INVERSE, len(data) + 1)

    def spans(self, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.unshift[start] + np.uint64(kind * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every word of lower-cased bytes; no word crosses a row bound."""
    inside = WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(bounds, start, "right") - 1, start, end
