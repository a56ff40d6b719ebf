"""State of a stream as a table beside it: one step per micro-batch, folded now and then.

A step holds the keys that a micro-batch touched. The state before a batch is the
newest fold below it and the steps after that fold, merged by key. A batch that
runs again reads the same earlier steps and replaces its own, so results do not
depend on restarts, and no state has to fit a Python worker.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Carried:
    spark: SparkSession
    path: str
    schema: str
    keys: list[str]
    merge: dict[str, Column] = field(hash=False)  # aggregate over the steps of a key, by column
    every: int = 16  # batches from fold to fold

    def __post_init__(self) -> None:
        # an empty step, so that the table can be read before the first batch
        self.spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self.path}/kind=step/batch=-1")

    def before(self, batch_id: int | None = None) -> DataFrame:
        """Merged state of all batches below `batch_id` (of all batches without one)."""
        stored = self.spark.read.schema(f"{self.schema}, kind STRING, batch BIGINT").parquet(self.path)
        if batch_id is not None:
            stored = stored.where(F.col("batch") < batch_id)
        # folds hold a row at least, so the newest one is found in a scan of that column alone
        fold = stored.where("kind = 'fold'").agg(F.max("batch").alias("at")).first()["at"]
        if fold is not None:
            stored = stored.where(((F.col("kind") == "fold") & (F.col("batch") == fold)) | ((F.col("kind") == "step") & (F.col("batch") > fold)))
        return stored.groupBy(*self.keys).agg(*[how.alias(name) for name, how in self.merge.items()])

    def step(self, batch_id: int, rows: DataFrame, at: str | None = None, span: int = 0) -> DataFrame:
        """Write the rows of a batch and read them back; a fold keeps what is within `span` of the newest `at`."""
        path = f"{self.path}/kind=step/batch={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        if batch_id % self.every == self.every - 1:
            merged = self.before(batch_id + 1)
            if at:
                newest = merged.agg(F.max(at).alias("t")).first()["t"]
                merged = merged.where(F.col(at) >= F.lit(newest) - span)
            merged.write.mode("overwrite").parquet(f"{self.path}/kind=fold/batch={batch_id}")
        return self.spark.read.schema(rows.schema).parquet(path)
