"""Incremental cycles with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from skyplate.plans.rollover import rollover


def follow_cycles(catalog_stream: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], columns: list[str]) -> DataStreamWriter:
    """A writer that rolls the stored results over to each micro-batch's charts. load gives the current results, store replaces them; the batch number makes a repeated batch recognisable."""

    def step(batch: DataFrame, number: int) -> None:
        fresh = batch.select("pdf_name").distinct()
        current = load()
        blank = fresh.select("pdf_name", *(F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns if c != "pdf_name")).select(*current.columns)
        store(rollover(blank, current, batch, columns), number)

    return catalog_stream.writeStream.foreachBatch(step)


def status_counts(stream: DataFrame, time: str, delay: str, width: str) -> DataFrame:
    """Counts of events by type and tumbling window; later events than the delay are dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
