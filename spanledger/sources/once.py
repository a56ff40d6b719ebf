"""Compute costly columns once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Append `columns` behind a one-element explode.

    The optimizer pushes filters through a projection and repeats its
    expressions there, which would parse the same JSON dozens of times. It
    cannot push them through a generator.
    """
    cell = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select(*df.columns, cell).select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in columns])
