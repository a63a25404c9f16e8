"""Reading scripts and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, lineage as L

#: A line of an evaluation corpus: task row, place of the script in it, its text in base64.
CORPUS_SCHEMA = "taskRow string, scriptIndex string, sqlBase64 string"
MANIFEST_SCHEMA = (
    "dialect string, cases array<struct<id:string,file:string,statementType:string,inputTables:array<string>,outputTables:array<string>,"
    "columnLineage:array<struct<target:string,sources:array<string>>>,columnUsages:array<struct<type:string,column:string>>,expectedDiagnostics:array<string>,description:string>>"
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """script_id, task_row, script_index, sql of a tab-separated corpus with a header; bad rows are left out."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=CORPUS_SCHEMA, mode="PERMISSIVE", quote="")
    n = lambda c: F.col(c).try_cast("int")
    rows = raw.select(n("taskRow").alias("task_row"), n("scriptIndex").alias("script_index"), F.try_to_binary("sqlBase64", F.lit("base64")).cast("string").alias("sql"))
    good = rows.filter("task_row is not null and script_index is not null and sql is not null")
    return good.select((F.col("task_row").cast("long") * 1_000_000 + F.col("script_index")).alias("script_id"), "task_row", "script_index", "sql")


def read_sql_files(spark: SparkSession, path: str) -> DataFrame:
    """script_id, path, sql of whole files; Spark's reader lists and reads them."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("sql"))
    return files.select(F.xxhash64("path").alias("script_id"), "path", "sql")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each golden case."""
    return spark.read.json(path, schema=MANIFEST_SCHEMA, multiLine=True).select("dialect", F.explode("cases").alias("c")).select("dialect", "c.*")


def evaluate(scripts: DataFrame, dialect: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(coverage by dialect, failures) of scripts(script_id, sql)."""
    found = L.lineage(scripts, dialect=dialect)
    failed = found.filter(F.exists("diagnostics", lambda d: d["severity"] == "ERROR"))
    return graph.corpus_coverage(found), failed.select("script_id", "stmt_idx", F.element_at("diagnostics", 1)["message"].alias("error"), F.substring("sql", 1, 200).alias("snippet"))


def write_results(found: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """The five result tables under one folder, from one parse: the nested rows are written first."""
    spark = found.sparkSession
    found.write.mode(mode).format(format).save(f"{path}/nested")
    nested = spark.read.format(format).schema(found.schema).load(f"{path}/nested")
    for name in ("statements", "stmt_tables", "column_edges", "column_usage", "diagnostics"):
        getattr(L, name)(nested).write.mode(mode).format(format).save(f"{path}/{name}")


# --- table sources and sinks of the recognised statements ---------------------------------------


def load_data(spark: SparkSession, path: str, schema: str, table_path: str, format: str = "csv", **options) -> None:
    """LOAD DATA / COPY FROM / LOAD LABEL: append files to a table folder."""
    spark.read.format(format).schema(schema).options(**options).load(path).write.mode("append").parquet(table_path)


def copy_to(df: DataFrame, path: str, format: str = "csv", **options) -> None:
    """COPY TO / EXPORT / INTO OUTFILE / INSERT DIRECTORY."""
    df.write.mode("overwrite").format(format).options(**options).save(path)


def insert(df: DataFrame, table: str, overwrite: bool = False, by_name: bool = True) -> None:
    """INSERT INTO / OVERWRITE of a catalog table, by name or by place; overwriting replaces the
    partitions that df has."""
    spark = df.sparkSession
    columns = spark.table(table).columns
    df = df.select(*columns) if by_name else df
    if overwrite:
        key = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(key)
        spark.conf.set(key, "dynamic")
        try:
            df.write.insertInto(table, overwrite=True)
        finally:
            spark.conf.set(key, before)
    else:
        df.write.insertInto(table)


def create_table_as(df: DataFrame, table: str, replace: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """CTAS / RTAS / SELECT INTO."""
    writer = df.write.mode("overwrite" if replace else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
