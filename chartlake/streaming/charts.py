"""Rank observations as a stream: late deliveries, repeats, and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StreamingQuery

from chartlake.runtime import materialize
from chartlake.sources.store import write_partitions


def read_stream(spark, path: str, schema: str, files: int = 50) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_deliveries(stream: DataFrame, keys: Sequence[str], at: str, late: str = "7 days") -> DataFrame:
    """Each key once, the first time it comes; what is later than the watermark
    is dropped and its state forgotten."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, by: Sequence[str], at: str, width: str = "1 day", late: str = "7 days", slide: str | None = None) -> DataFrame:
    """Rows and best rank per tumbling (or sliding) window and group."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width, slide or width), *by).agg(F.count("*").alias("rows"), F.min("rank_order").alias("best"))


def sessions(stream: DataFrame, by: Sequence[str], at: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Bursts of deliveries: sessions that end after a gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("rows"))


def write_snapshots(stream: DataFrame, path: str, partition: Sequence[str], delivered: str, checkpoint: str) -> StreamingQuery:
    """Writes snapshots so that a period that comes again replaces itself: of
    each batch the latest delivery of a partition, as a whole, and only if what
    is stored is not newer. So the result does not depend on the batches."""

    def batch(df: DataFrame, _: int) -> None:
        last = df.groupBy(*partition).agg(F.max(delivered).alias("__d"))
        try:
            stored = df.sparkSession.read.schema(df.schema).parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = None
        if stored is not None:
            there = stored.groupBy(*partition).agg(F.max(delivered).alias("__t"))
            same = [last[c].eqNullSafe(there[c]) for c in partition] + [last["__d"] < there["__t"]]
            last = last.join(there, same, "left_anti")
        last = materialize(last, "latest")
        cond = [df[c].eqNullSafe(last[c]) for c in partition] + [df[delivered].eqNullSafe(last["__d"])]
        write_partitions(df.join(last, cond, "left_semi"), path, partition)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what there is into a table in memory (tests)."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
