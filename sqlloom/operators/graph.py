"""Questions on the column graph: what depends on a column, where it comes from, how it is used."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import column_edges, column_usage

# Classes of statements whose columns are not followed and what must be found in the
# lower-case text; the first match wins. None stands for a text without " from ".
NO_COLUMN_CLASSES = (
    ("SELECT_STAR", r"(?s)select\s+\*"),
    ("COUNT_STAR_OR_AGG", r"(?s)select\s+[^;]*(^|[^a-z_])count\s*\(\s*\*"),
    ("NO_FROM_OR_METADATA", None),
    ("CONSTANT_PROJECTION", r"(?s)select\s+('[^']*'|[0-9]+|null|true|false)(\s+as\s+[`a-z_].*)?\s+from\s+"),
    ("LATERAL_OR_EXPLODE", r" lateral view | explode\("),
    ("CTE", r"^with "),
    ("UNION", r" union "),
    ("EXPRESSION", r"(?s)select\s+[^;]*(case\s+when|if\s*\(|coalesce\s*\(|nvl\s*\(|regexp_|get_json_object|concat\s*\()"),
)


def column_graph(found: DataFrame) -> DataFrame:
    """Distinct (src, dst) of fully named columns over all statements."""
    e = column_edges(found).filter("source_table is not null and target_table is not null")
    return e.select(F.concat_ws(".", "source_table", "source_column").alias("src"), F.concat_ws(".", "target_table", "target_column").alias("dst")).distinct()


#: Rounds after which the parts of a growing result are written as one.
FOLD = 16


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, depth): every node that edges(src, dst) reach from seeds(node), at its least depth.

    Breadth first, until a round finds nothing new, however deep that is; each round joins only the new
    frontier and writes it with a checkpoint. Frontiers are appended; the nodes seen are their union, which
    is written anew every FOLD rounds so that the plan stays short. A seed is its own node at depth 0."""
    edges = cut(edges.select("src", "dst").distinct())
    frontier = cut(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct())
    parts, depth = [frontier], 0
    while True:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, parts)
        frontier = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        parts.append(frontier)
        if len(parts) == FOLD:
            parts = [cut(reduce(DataFrame.unionByName, parts))]


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _own[app] = _own.get(app) or f"file://{tempfile.mkdtemp(prefix='sqlloom-')}"
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder: computed once, and safe when executors go."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def downstream(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return closure(edges, seeds)


def upstream(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds)


def impact(found: DataFrame) -> DataFrame:
    """For each source column: statements, target columns and target tables that read it directly."""
    e = column_edges(found).filter("source_table is not null")
    return e.groupBy("source_table", "source_column").agg(
        F.count_distinct("script_id", "stmt_idx").alias("n_statements"),
        F.count_distinct("target_table", "target_column").alias("n_targets"),
        F.count_distinct("target_table").alias("n_tables"),
    )


def usage_heatmap(found: DataFrame) -> DataFrame:
    u = column_usage(found)
    return u.groupBy("table_name", "column_name").pivot("usage_type", ["WHERE", "JOIN_ON", "GROUP_BY", "HAVING", "ORDER_BY"]).agg(F.count(F.lit(1))).na.fill(0)


def corpus_coverage(found: DataFrame) -> DataFrame:
    """Per dialect: statements, recognised, with tables, with columns, partial, failed."""
    error = F.exists("diagnostics", lambda d: d["severity"] == "ERROR")
    partial = F.exists("diagnostics", lambda d: d["code"] == "COLUMN_LINEAGE_PARTIAL")
    return found.groupBy("dialect").agg(
        F.count("*").alias("n_statements"),
        F.count_if(F.col("statement_type") != "UNKNOWN").alias("n_recognized"),
        F.count_if((F.size("inputs") > 0) | (F.size("outputs") > 0)).alias("n_with_tables"),
        F.count_if(F.size("edges") > 0).alias("n_with_columns"),
        F.count_if(partial).alias("n_partial"),
        F.count_if(error).alias("n_failed"),
    )


def statement_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("dialect", "statement_type").agg(F.count("*").alias("n"))


def no_column_class(sql: Column) -> Column:
    text, out = F.lower(sql), None
    for label, pattern in NO_COLUMN_CLASSES:
        hit = text.rlike(pattern) if pattern else ~text.contains(" from ")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("OTHER")
