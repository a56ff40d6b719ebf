"""Session helpers: local sessions for tests and bench, and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "spanledger") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPANLEDGER_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's `spark.checkpoint.dir`.

    Only where that is unset: a temporary folder on a local master, and the
    warehouse (shared by definition) anywhere else.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if sc.master.startswith("local"):
        return tempfile.mkdtemp(prefix="spanledger-")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_spanledger_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Materialise on reliable shared storage, so a loop's plan and lineage stay short."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
