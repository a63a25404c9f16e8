"""Lineage of a DataFrame of scripts.

A script is the unit of work: its statements share temporary relations, so it is read in one place and
scripts spread over partitions. The reader runs once per script in Arrow batches; everything after it
is DataFrame code on the nested result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_statements
from ..plans.statements import parse_script

VERSION = "0.1"
_TABLE = "struct<catalog:string,schema:string,name:string>"
_COLUMN = f"struct<table:{_TABLE},name:string>"
RESULT = (
    "script_id long, stmt_idx int, sql string, version string, dialect string, dialect_confidence double, statement_type string, "
    f"inputs array<{_TABLE}>, outputs array<{_TABLE}>, edges array<struct<target:{_COLUMN},sources:array<{_COLUMN}>,expression:string>>, "
    f"usages array<struct<type:string,column:{_COLUMN}>>, diagnostics array<struct<severity:string,code:string,message:string>>"
)


def _table(parts: tuple[str, ...] | None) -> dict | None:
    return None if parts is None else dict(zip(("catalog", "schema", "name"), (None, None, None, *parts)[-3:], strict=True))


def _column(column: tuple) -> dict:
    return {"table": _table(column[0]), "name": column[1]}


def record(script_id: int | None, index: int, sql: str, confidence: float, r) -> dict:
    return {
        "script_id": script_id, "stmt_idx": index, "sql": sql, "version": VERSION, "dialect": r.dialect, "dialect_confidence": confidence, "statement_type": r.statement_type,
        "inputs": [_table(t) for t in r.inputs], "outputs": [_table(t) for t in r.outputs],
        "edges": [{"target": _column((e.target, e.name)), "sources": [_column(s) for s in e.sources], "expression": e.expression} for e in r.edges],
        "usages": [{"type": k, "column": _column(c)} for k, c in r.usages],
        "diagnostics": [dict(zip(("severity", "code", "message"), d, strict=True)) for d in r.diagnostics],
    }


def _arrow_schema() -> pa.Schema:
    table = pa.struct([(n, pa.string()) for n in ("catalog", "schema", "name")])
    column = pa.struct([("table", table), ("name", pa.string())])
    edge = pa.struct([("target", column), ("sources", pa.list_(column)), ("expression", pa.string())])
    said = pa.struct([(n, pa.string()) for n in ("severity", "code", "message")])
    return pa.schema([
        ("script_id", pa.int64()), ("stmt_idx", pa.int32()), ("sql", pa.string()), ("version", pa.string()), ("dialect", pa.string()), ("dialect_confidence", pa.float64()), ("statement_type", pa.string()),
        ("inputs", pa.list_(table)), ("outputs", pa.list_(table)), ("edges", pa.list_(edge)), ("usages", pa.list_(pa.struct([("type", pa.string()), ("column", column)]))), ("diagnostics", pa.list_(said)),
    ])


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """df over enough partitions for work that is heavy for its bytes: a few for each core. Text is
    small beside the time it takes to read it as SQL, so the exchange pays. Streams are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(per_core * cores)


#: Readers of further dialects: name -> function of (statement, dialect, temporary relations) to a result.
PLUGINS: dict[str, Callable] = {}
#: Statements after which an Arrow batch ends.
STATEMENTS = 2000


def plugged(parser: Callable, dialect: str | None) -> Callable:
    """parser, or the registered reader of the dialect as a script parser. It travels with the query, so what
    is registered when lineage() is called is what workers use."""
    own = PLUGINS.get((dialect or "").upper())
    return parser if own is None else lambda text, name: [(s, 1.0, own(s, name.upper(), {})) for s in split_statements(text)]


def lineage(scripts: DataFrame, sql: str = "sql", script_id: str = "script_id", dialect: str | None = None, parser: Callable = parse_script) -> DataFrame:
    """One row for each statement of scripts(script_id, sql), batch or streaming.

    dialect fixes the dialect (confidence 1); else each statement's is detected. parser may be another
    function from (script, dialect) to (statement, confidence, result) rows; a dialect of PLUGINS has its own."""
    schema = _arrow_schema()
    read = plugged(parser, dialect)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                out += [record(i, k, *s) for k, s in enumerate(read(text or "", dialect))]
                if len(out) >= STATEMENTS:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return spread(scripts.select(F.col(script_id).cast("long"), F.col(sql).cast("string"))).mapInArrow(run, RESULT)


def split(scripts: DataFrame, sql: str = "sql", script_id: str = "script_id") -> DataFrame:
    """script_id, stmt_idx, statement of each script; null scripts have none."""
    schema = pa.schema([("script_id", pa.int64()), ("stmt_idx", pa.int32()), ("statement", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, s) for i, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True) for k, s in enumerate(split_statements(text or ""))]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return scripts.select(F.col(script_id).cast("long"), F.col(sql).cast("string")).mapInArrow(run, "script_id long, stmt_idx int, statement string")


def full_name(table: Column) -> Column:
    return F.concat_ws(".", table["catalog"], table["schema"], table["name"])


_KEY = ("script_id", "stmt_idx")


def statements(found: DataFrame) -> DataFrame:
    return found.select(*_KEY, "sql", "dialect", "dialect_confidence", "statement_type", "version")


def stmt_tables(found: DataFrame) -> DataFrame:
    role = lambda name, label: found.select(*_KEY, F.lit(label).alias("role"), F.posexplode(name).alias("ord", "t"))
    both = role("inputs", "input").unionByName(role("outputs", "output"))
    return both.select(*_KEY, "role", "ord", "t.*", full_name(F.col("t")).alias("full_name"))


def typed_tables(found: DataFrame) -> DataFrame:
    """A row for each table of a statement with the statement's type, from one reading of the scripts."""
    role = lambda name, label: F.transform(name, lambda t, i: F.struct(F.lit(label).alias("role"), i.alias("ord"), t.alias("t")))
    each = found.select(*_KEY, "statement_type", F.explode(F.concat(role("inputs", "input"), role("outputs", "output"))).alias("r"))
    return each.select(*_KEY, "statement_type", "r.role", "r.ord", full_name(F.col("r.t")).alias("full_name"))


def column_edges(found: DataFrame) -> DataFrame:
    """A row for each source of each edge; edges without sources keep one row."""
    e = found.select(*_KEY, F.posexplode("edges").alias("edge_ord", "e"))
    s = e.select(*_KEY, "edge_ord", "e", F.posexplode_outer("e.sources").alias("source_ord", "s"))
    name = lambda t: F.when(t.isNotNull(), full_name(t))
    return s.select(
        *_KEY, "edge_ord", name(F.col("e.target.table")).alias("target_table"), F.col("e.target.name").alias("target_column"), "source_ord",
        name(F.col("s.table")).alias("source_table"), F.col("s.name").alias("source_column"), F.col("e.expression").alias("expression"),
    )


def column_usage(found: DataFrame) -> DataFrame:
    u = found.select(*_KEY, F.posexplode("usages").alias("ord", "u"))
    return u.select(*_KEY, "ord", F.col("u.type").alias("usage_type"), full_name(F.col("u.column.table")).alias("table_name"), F.col("u.column.name").alias("column_name"))


def diagnostics(found: DataFrame) -> DataFrame:
    return found.select(*_KEY, F.posexplode("diagnostics").alias("ord", "d")).select(*_KEY, "ord", "d.*")


# --- edges, rewritten as DataFrames -------------------------------------------------------------


def retarget(edges: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """column_edges with another target table and the first targets renamed by place."""
    names = F.array(*map(F.lit, columns)) if columns else F.array().cast("array<string>")
    renamed = F.coalesce(F.try_element_at(names, F.col("edge_ord") + 1), F.col("target_column"))
    return edges.withColumn("target_table", F.lit(table)).withColumn("target_column", renamed)


def merge_set_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges of a set operation: by place to the shorter side, left names, sources of both."""
    key = [*_KEY, "edge_ord"]
    heads = left.select(*key, "target_table", "target_column", "expression").distinct().join(right.select(*key).distinct(), key)
    sources = left.select(*key, "source_table", "source_column", F.lit(0).alias("side"), "source_ord").unionByName(right.select(*key, "source_table", "source_column", F.lit(1).alias("side"), "source_ord"))
    first = sources.groupBy(*key, "source_table", "source_column").agg(F.min(F.struct("side", "source_ord")).alias("at"))
    return heads.join(first, key).drop("at")
