"""Streams: lineage of arriving scripts, event-time windows, temporal joins and change capture."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lineage import lineage


def read_stream(spark: SparkSession, format: str, schema: str | None = None, path: str | None = None, **options) -> DataFrame:
    """STREAM(t), connector DDL and ROUTINE LOAD: any structured-streaming source."""
    reader = spark.readStream.format(format).options(**options)
    reader = reader.schema(schema) if schema else reader
    return reader.load(path) if path else reader.load()


def run_to_files(stream: DataFrame, root: str, mode: str) -> DataFrame:
    """The stream, read to its end, as files under `root`: executors write them, and the driver holds no rows.
    Each batch has a folder of its own; in complete mode the last one is the result."""
    out = f"{root}/{uuid4().hex}"
    last: list[int] = []

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={epoch}")  # a batch that is tried again replaces itself
        last.append(epoch)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={last[-1]}" if mode == "complete" else f"{out}/batch=*")


def lineage_stream(scripts: DataFrame, dialect: str | None = None) -> DataFrame:
    """Lineage of a stream of scripts. Context lives inside a script, so no state is kept."""
    return lineage(scripts, dialect=dialect)


def tumble(events: DataFrame, ts: str, size: str, late: str, keys: list[str], *aggs: Column) -> DataFrame:
    return hop(events, ts, size, size, late, keys, *aggs)


def hop(events: DataFrame, ts: str, size: str, slide: str, late: str, keys: list[str], *aggs: Column) -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *keys).agg(*aggs)
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in w.columns if c != "window"])


def session(events: DataFrame, ts: str, gap: str, late: str, keys: list[str], *aggs: Column) -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(*aggs)
    return w.select(F.col("session_window.start").alias("window_start"), F.col("session_window.end").alias("window_end"), *[c for c in w.columns if c != "session_window"])


def distinct_within(events: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """One row for each key as long as the watermark remembers it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def lookup_join(events: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Temporal join against the table's content as each batch sees it."""
    return events.join(table, on, how)


def interval_join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, late: str, within: str) -> DataFrame:
    """Stream-stream join of rows with one key whose times lie within an interval after the left one."""
    a, b = left.withWatermark(left_ts, late).alias("a"), right.withWatermark(right_ts, late).alias("b")
    return a.join(b, F.expr(f"a.{on} = b.{on} and b.{right_ts} >= a.{left_ts} and b.{right_ts} <= a.{left_ts} + interval {within}"))


def auto_cdc(changes: DataFrame, keys: list[str], sequence: str, apply: Callable[[DataFrame, int], None], checkpoint: str, deletes: Column | None = None) -> StreamingQuery:
    """AUTO CDC: each batch is reduced to the latest change of a key (by sequence) and handed to `apply`,
    which merges it; `deleted` says which keys go."""

    def batch(df: DataFrame, epoch: int) -> None:
        flagged = df.withColumn("deleted", F.coalesce(deletes, F.lit(False)) if deletes is not None else F.lit(False))
        latest = flagged.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in flagged.columns if c not in keys]), sequence).alias("__r")).select(*keys, "__r.*")
        apply(latest, epoch)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
