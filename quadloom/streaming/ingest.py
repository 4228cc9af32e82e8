"""Streams of N-Triples or N-Quads files into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rdf_io import document_label, parse_lines
from ..store import COLUMNS, Store


def quad_stream(spark: SparkSession, path: str, quads: bool = False, strict: bool = False) -> DataFrame:
    """Quads of the files that come into a folder, as a stream."""
    lines = spark.readStream.text(path).select(F.col("value").alias("line"), document_label())
    return parse_lines(lines, quads, strict)


def into_store(stream: DataFrame, store: Store, checkpoint: str, volatile: bool = False, **trigger):
    """Write a quad stream to a store: each batch is one version that adds what is new, and a batch run twice changes nothing.

    The store must have a path, since the stream's checkpoint remembers what the store was given; `volatile` allows one in memory.
    """
    if not store.path and not volatile:
        raise ValueError("a stream's store must be kept in files")

    def commit(batch: DataFrame, _: int) -> None:
        store.insert(batch.select(*COLUMNS))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
