"""What the corpus operators share: typed input columns and tables written to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop, shared_dir


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns only, cast; other columns, whatever they are called, stay out of the operator."""
    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()))


def sliced(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `most` bytes, a row each at least, as Spark fills a batch by its number of
    rows: what a task makes of a slice is gone before the next, however long the texts are."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


class Scratch:
    """Tables written to the shared folder to cut lineage; drop() deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}", set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df once and returns it as read back, so that a lost executor never redoes what made it."""
        self.names.add(name)
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def only(self, df: DataFrame) -> DataFrame:
        """Writes df as the result and deletes all else."""
        others = set(self.names)
        out = self.save(df, "result")
        self.drop(*others)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            drop(self.spark, f"{self.root}/{name}")
            self.names.discard(name)
