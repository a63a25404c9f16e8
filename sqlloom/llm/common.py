"""Helpers shared by the training-data operators: durable cuts, row keys, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one is made only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sqlloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a
    lost executor costs no recomputation. Values made by monotonically_increasing_id or rand
    are fixed by it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    _made.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables materialize() has written and release() not deleted."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables of materialize() from number `since` on, but for the last `keep`; call it when no
    frame made from them is needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _made[since : len(_made) - keep]
    del _made[since : len(_made) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


#: Rows, and array elements in them, that may be broadcast.
SMALL_ROWS, SMALL_ITEMS = 300_000, 500_000


def sized(df: DataFrame, items: Column | None = None) -> DataFrame:
    """df, marked for broadcast if a count shows at most SMALL_ROWS narrow rows, with at most SMALL_ITEMS
    in their arrays (items: how many a row has); else left to a shuffle."""
    n, m = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if items is None else items), F.lit(0))).first()
    return F.broadcast(df) if n <= SMALL_ROWS and m <= SMALL_ITEMS else df


def lookup(df: DataFrame, items: Column | None = None) -> DataFrame:
    """df, written and then sized: the narrow side of a join whose other side is wide."""
    return sized(materialize(df), items)


def joined_ranges(rows: DataFrame, first: str, last: str, gap: int = 0) -> DataFrame:
    """rid and `ranges`: an array of (first, last) in order, joined where one begins within `gap` of
    another's end, from rows(rid, first, last). A text's ranges are sorted once and joined in one pass."""
    grouped = rows.groupBy("rid").agg(F.collect_list(F.struct(F.col(first).cast("long").alias("a"), F.col(last).cast("long").alias("b"))).alias("found"))
    span = pa.struct([(first, pa.int32()), (last, pa.int32())])
    schema = pa.schema([("rid", pa.int64()), ("ranges", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, offsets = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [0]
            for found in batch["found"]:
                a, b = found.values.field("a").to_numpy(), found.values.field("b").to_numpy()
                order = np.argsort(a, kind="stable")
                a, reach = a[order], np.maximum.accumulate(b[order])
                new = np.flatnonzero(np.r_[True, a[1:] > reach[:-1] + gap])
                starts.append(a[new])
                ends.append(reach[np.r_[new[1:], len(a)] - 1])
                offsets.append(offsets[-1] + len(new))
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ends)], fields=list(span))
            yield pa.record_batch([batch["rid"], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], schema=schema)

    return grouped.select(F.col("rid").cast("long"), "found").mapInArrow(run, f"rid long, ranges array<struct<{first}:int,{last}:int>>")


#: Bytes of rows that a Python worker is handed at once.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches end by bytes too, so that long texts do not fill a worker's memory.
    A bound that the session has already is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, BATCH_BYTES)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """`rid` long plus the named columns (doc_id and text by default).

    rid is doc_id where that is unique and never null, which a count over the one column shows;
    else the rows are written once with a row number, so that repeated or null ids stay apart.
    """
    bounded_batches(docs.sparkSession)
    columns = columns or ("doc_id", "text")
    rows = docs.select(*columns)
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.filter((F.col("n") > 1) | F.col("doc_id").isNull()).isEmpty():
        return rows.withColumn("rid", F.col("doc_id").cast("long"))
    return materialize(rows.withColumn("rid", F.monotonically_increasing_id()))


def blob(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges(a, b): label is the least node it can reach.

    Each round maps a node to the least of itself and its neighbours, follows that map to its end by
    doubling, and contracts the edges; self loops vanish. What is left are nodes that were least among
    their neighbours, at most half of them. Minima are pre-aggregated, so a star with a third of all
    nodes costs one value a task.
    """
    empty = edges.filter(F.lit(False)).select(F.col("a").alias("node"), F.col("a").alias("label"))
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    labels = None
    for _ in range(rounds):
        if edges.isEmpty():
            return empty if labels is None else labels
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).select(F.col("a").alias("node"), "to"))
        step = least.withColumn("moved", F.lit(True))
        while not step.filter("moved").isEmpty():
            up = step.select(F.col("node").alias("to"), F.col("to").alias("top"))
            step = materialize(step.join(up, "to", "left").select("node", F.coalesce("top", "to").alias("to"), F.coalesce(F.col("top") != F.col("to"), F.lit(False)).alias("moved")))
        step = step.drop("moved")
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            old = labels.withColumnRenamed("label", "was")
            labels = materialize(old.join(step.withColumnRenamed("node", "was"), "was", "left").select("node", F.coalesce("to", "was").alias("label")))
        a = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(a, "a").join(b, "b").filter("x <> y")
        edges = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
