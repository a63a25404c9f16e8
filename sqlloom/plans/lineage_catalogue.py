"""Lineage and graph queries over scripts written from the rows of the test tables.

A script is a template with {k} for a row's key; what is expected is a list of templates too, so the
SQL side can build the expected rows from the same keys without reading any SQL.
"""

from __future__ import annotations

import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import api, cli
from ..functions import detect
from ..operators import graph, lineage as L
from ..operators import relational as R
from .catalogue import ORACLE, QUERIES, C, Tables, long, query
from .lineage import Result


def _text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def scripts(t: Tables, table: str, key: str, template: str, where: str = "true") -> DataFrame:
    k = C(key).cast("string")
    return getattr(t, table).filter(where).select(long(key).alias("script_id"), F.replace(F.lit(template), F.lit("{k}"), k).alias("sql"))


def _expected(table: str, key: str, where: str, columns: list[str], rows: list[tuple], order: str = "") -> str:
    values = ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) or v is None else str(v) for v in r) + ")" for r in rows)
    named = ", ".join(f"replace({c}, '{{k}}', CAST({key} AS VARCHAR)) AS {c}" if any(isinstance(r[i], str) for r in rows) else f"CAST({c} AS {'VARCHAR' if all(r[i] is None for r in rows) else 'BIGINT'}) AS {c}" for i, c in enumerate(columns))
    return f"SELECT CAST({key} AS BIGINT) AS script_id, {named} FROM {table} CROSS JOIN (VALUES {values}) v({', '.join(columns)}) WHERE {where} {order}"


def edges(name: str, template: str, rows: list[tuple], table: str = "nation", key: str = "n_nationkey", where: str = "true", dialect: str | None = "SPARK", stmt: int | None = None) -> None:
    """rows: (target table, target column, source table, source column)"""
    columns = ["target_table", "target_column", "source_table", "source_column"]

    def make(t: Tables) -> DataFrame:
        found = L.column_edges(L.lineage(scripts(t, table, key, template, where), dialect=dialect))
        return (found if stmt is None else found.filter(C("stmt_idx") == stmt)).select("script_id", *columns)

    query(_expected(table, key, where, columns, rows), name)(make)


def usages(name: str, template: str, rows: list[tuple], dialect: str | None = "SPARK", table: str = "nation", key: str = "n_nationkey") -> None:
    """rows: (ord, usage type, table, column)"""
    columns = ["ord", "usage_type", "table_name", "column_name"]
    query(_expected(table, key, "true", columns, rows), name)(
        lambda t: L.column_usage(L.lineage(scripts(t, table, key, template), dialect=dialect)).select("script_id", long("ord").alias("ord"), *columns[1:])
    )


def tables(name: str, template: str, rows: list[tuple], dialect: str | None = "SPARK", table: str = "nation", key: str = "n_nationkey") -> None:
    """rows: (statement index, type, role, full name)"""
    columns = ["stmt_idx", "statement_type", "role", "full_name"]

    def make(t: Tables) -> DataFrame:
        found = L.lineage(scripts(t, table, key, template), dialect=dialect)
        return L.typed_tables(found).select("script_id", long("stmt_idx").alias("stmt_idx"), *columns[1:])

    query(_expected(table, key, "true", columns, rows), name)(make)


M, O = "mart.n_{k}", "ods.n_{k}"  # noqa: E741
edges("column_lineage_direct", f"insert into {M}(k, nm) select n_nationkey, n_name from {O} where n_regionkey = {{k}}", [(M, "k", O, "n_nationkey"), (M, "nm", O, "n_name")])
edges("column_lineage_at_scale", f"insert into {M}(k, nm) select a, upper(b) as u from {O} where c = {{k}}", [(M, "k", O, "a"), (M, "nm", O, "b")], "orders", "o_orderkey")
edges("column_lineage_expr", f"create table {M} as select a + b as s, case when c > 1 then d else 0 end as x, count(*) as n from {O} group by a, b, c, d", [(M, "s", O, "a"), (M, "s", O, "b"), (M, "x", O, "c"), (M, "x", O, "d"), (M, "n", None, None)])
edges("column_lineage_join", f"insert into {M} select u.a as a, o.b as b from {O} u join dwd.o_{{k}} o on u.id = o.id", [(M, "a", O, "a"), (M, "b", "dwd.o_{k}", "b")])
edges("column_lineage_cte", f"with q as (select a as x, b from {O}), r as (select x as y from q) insert into {M}(p, q) select r.y, q.b from r join q on r.y = q.x", [(M, "p", O, "a"), (M, "q", O, "b")])
edges("column_lineage_derived", f"insert into {M} select d.x from (select s.a as x from (select a from {O}) s) d", [(M, "x", O, "a")])
edges("column_lineage_union", f"insert into {M}(p) select a from {O} union all select b from dwd.o_{{k}} union select c from ods.z", [(M, "p", O, "a"), (M, "p", "dwd.o_{k}", "b"), (M, "p", "ods.z", "c")])
edges("column_lineage_insert_cols", f"insert overwrite table {M} partition (dt = '1') (x, y) select a, b from {O}", [(M, "x", O, "a"), (M, "y", O, "b")])
edges("column_lineage_view", f"create or replace view {M} (x, y) as select a, max(b) from {O} group by a", [(M, "x", O, "a"), (M, "y", O, "b")])
edges("column_lineage_update", f"update {M} t set v = s.w, u = s.x from {O} s where t.id = s.id", [(M, "v", O, "w"), (M, "u", O, "x")], dialect="POSTGRESQL")
edges("column_lineage_update_join", f"update {M} t join {O} s on t.id = s.id set t.v = s.w", [(M, "v", O, "w")], dialect="MYSQL")
edges("column_lineage_merge", f"merge into {M} t using {O} s on t.id = s.id when matched then update set v = s.w when not matched then insert (id, v) values (s.id, s.w)", [(M, "v", O, "w"), (M, "id", O, "id"), (M, "v", O, "w")])
edges("column_lineage_star", f"create table {M} as select * from {O}", [(M, "*", O, "*")])
edges("column_lineage_star_derived", f"insert into {M} select u.* from (select a, b as c from {O}) u", [(M, "a", O, "a"), (M, "c", O, "b")])
edges("column_lineage_lateral_view", f"insert into {M} select id, x from {O} lateral view explode(xs) e as x", [(M, "id", O, "id"), (M, "x", O, "xs")])
edges("column_lineage_pivot", f"select p, q from {O} pivot (sum(v) for k in ('p', 'q'))", [(None, "p", O, "v"), (None, "q", O, "v")])
edges("column_lineage_unpivot", f"select n, v from {O} unpivot (v for n in (a, b))", [(None, "n", O, "a"), (None, "n", O, "b"), (None, "v", O, "a"), (None, "v", O, "b")])
edges("column_lineage_window", f"select row_number() over (partition by g order by d) as rn, sum(v) over (partition by g) as s from {O}", [(None, "rn", O, "g"), (None, "rn", O, "d"), (None, "s", O, "v"), (None, "s", O, "g")])
edges("column_lineage_pipe", f"from {O} |> where a > 1 |> extend upper(b) as ub |> select a as x, ub", [(None, "x", O, "a"), (None, "ub", O, "b")])
edges("column_lineage_scalar_subquery", f"select (select max(v) from {O}) as m, d.a from dwd.d d", [(None, "m", O, "v"), (None, "a", "dwd.d", "a")])
edges("column_lineage_upsert", f"insert into {M}(a, b) select x, y from {O} on duplicate key update b = values(b)", [(M, "a", O, "x"), (M, "b", O, "y"), (M, "b", O, "y")], dialect="MYSQL")
edges("column_lineage_insert_all", f"insert all into {M} (p) values (a) into mart.z (q) values (b) select a, b from {O}", [(M, "p", O, "a"), ("mart.z", "q", O, "b")], dialect="ORACLE")
edges("column_lineage_load", f"copy {M} (a, b) from '/x.csv' with (format csv)", [(M, "a", None, None), (M, "b", None, None)], dialect="POSTGRESQL")
edges("column_lineage_copy_to", f"copy {O} (a, b) to '/x.csv'", [(None, "a", O, "a"), (None, "b", O, "b")], dialect="POSTGRESQL")
edges("column_lineage_nested_field", f"select v.p as p from (select from_json(c, 'p string') as v from {O}) s", [(None, "p", O, "c")])
edges("column_lineage_multi_alias", f"select f(a, b) as (x, y) from {O}", [(None, "x", O, "a"), (None, "x", O, "b"), (None, "y", O, "a"), (None, "y", O, "b")])
edges("column_lineage_named_window", f"select rank() over w as r from {O} window w as (partition by g order by d)", [(None, "r", O, "g"), (None, "r", O, "d")], dialect="MYSQL")
edges("script_temp_view", f"create temporary view v_{{k}} as select id as x, nm from {O}; insert into {M} select x, nm from v_{{k}}", [(M, "x", O, "id"), (M, "nm", O, "nm")], stmt=1)
edges("script_cache_table", f"cache table c_{{k}} as select id from {O}; insert into {M} select id as y from c_{{k}}; uncache table c_{{k}}; select id from c_{{k}}", [(None, "id", "c_{k}", "id")], stmt=3)
for d in ("SPARK", "HIVE", "FLINK", "STARROCKS", "MYSQL", "ORACLE", "SQLSERVER", "POSTGRESQL", "OCEANBASE"):
    edges(f"dialect_{d.lower()}", f"insert into {M}(x, y) select u.a, o.b from {O} u left join dwd.o o on u.id = o.id where u.z > 0", [(M, "x", O, "a"), (M, "y", "dwd.o", "b")], dialect=d)

usages("column_usage_where", f"select a from {O} where b > 1 and c in (1, 2)", [(0, "WHERE", O, "b"), (1, "WHERE", O, "c")])
usages("column_usage_join", f"select u.a from {O} u join dwd.o o on u.id = o.uid and o.k = 1", [(0, "JOIN_ON", O, "id"), (1, "JOIN_ON", "dwd.o", "uid"), (2, "JOIN_ON", "dwd.o", "k")])
usages("column_usage_using", f"select a from {O} u join dwd.o o using (id)", [(0, "JOIN_ON", O, "id"), (1, "JOIN_ON", "dwd.o", "id")])
usages("column_usage_group", f"select a, count(*) as n from {O} group by a, b", [(0, "GROUP_BY", O, "a"), (1, "GROUP_BY", O, "b")])
usages("column_usage_grouping_sets", f"select a, b, count(*) as n from {O} group by grouping sets ((a), (b))", [(0, "GROUP_BY", O, "a"), (1, "GROUP_BY", O, "b")])
usages("column_usage_having", f"select a from {O} group by a having max(b) > 1", [(0, "GROUP_BY", O, "a"), (1, "HAVING", O, "b")])
usages("column_usage_order", f"select a as x from {O} order by b desc, x", [(0, "ORDER_BY", O, "b"), (1, "ORDER_BY", O, "a")], dialect="HIVE")
usages("column_usage_window", f"select sum(v) over (partition by g order by d) as s from {O}", [(0, "WINDOW_PARTITION_BY", O, "g"), (1, "WINDOW_ORDER_BY", O, "d")], dialect="FLINK")
usages("column_usage_merge", f"merge into {M} t using {O} s on t.id = s.id when matched and s.op = 'D' then delete", [(0, "MERGE_ON", M, "id"), (1, "MERGE_ON", O, "id"), (2, "MERGE_WHEN", O, "op")], dialect="ORACLE")
usages("column_usage_asof", f"select u.a from {O} u asof join dwd.o o match_condition (u.ts >= o.ts) on u.id = o.id", [(0, "JOIN_ON", O, "ts"), (1, "JOIN_ON", "dwd.o", "ts"), (2, "JOIN_ON", O, "id"), (3, "JOIN_ON", "dwd.o", "id")])

tables("table_lineage", f"insert into {M} select a from {O} u join dwd.o o on u.i = o.i where u.j in (select j from dim.j)", [(0, "INSERT", "input", O), (0, "INSERT", "input", "dwd.o"), (0, "INSERT", "input", "dim.j"), (0, "INSERT", "output", M)])
tables("table_lineage_update_delete", f"update {M} set a = 1 where b = 2; delete from {O} where c = 3", [(0, "UPDATE", "input", M), (0, "UPDATE", "output", M), (1, "DELETE", "input", O), (1, "DELETE", "output", O)], dialect="HIVE")
tables("table_lineage_multi_insert", f"from {O} insert into mart.a select x insert into mart.b select y", [(0, "INSERT", "input", O), (0, "INSERT", "output", "mart.a"), (0, "INSERT", "output", "mart.b")])
tables("classify_statement", f"create table {M} (a int); drop table if exists {M}; truncate table {M}; alter table {M} add column b int; alter table {M} rename to mart.z; create table {M} like {O}; create view mart.v as select a from {O}; refresh table {M}; cache table c as select a from {O}; load data inpath '/x' into table {M}",
       [(0, "CREATE_TABLE", "output", M), (1, "DROP_TABLE", "output", M), (2, "TRUNCATE_TABLE", "output", M), (3, "ALTER_TABLE", "output", M), (4, "RENAME_TABLE", "input", M), (4, "RENAME_TABLE", "output", "mart.z"), (5, "CREATE_TABLE_LIKE", "input", O), (5, "CREATE_TABLE_LIKE", "output", M),
        (6, "CREATE_VIEW", "input", O), (6, "CREATE_VIEW", "output", "mart.v"), (7, "READ_METADATA", "input", M), (8, "CACHE_TABLE", "input", O), (8, "CACHE_TABLE", "output", "c"), (9, "LOAD_DATA", "output", M)])
tables("statement_set", f"execute statement set begin insert into {M} select a from {O}; insert into mart.z select b from ods.z; end; select 1 as k from ods.y", [(0, "INSERT", "input", O), (0, "INSERT", "input", "ods.z"), (0, "INSERT", "output", M), (0, "INSERT", "output", "mart.z"), (1, "SELECT", "input", "ods.y")], dialect="FLINK")
tables("update_of_cte", f"with c as (select a from {O}) update c set a = 1", [(0, "UPDATE", "input", O), (0, "UPDATE", "input", "c"), (0, "UPDATE", "output", "c")], dialect="SQLSERVER")
tables("placeholder_normalised", f"insert overwrite table {M} select a from {O} where dt = '${{x}}' and h > {{{{ y }}}}", [(0, "INSERT", "input", O), (0, "INSERT", "output", M)])
tables("partial_on_error", f"insert into {M} select a, from {O} where b = and", [(0, "INSERT", "input", O), (0, "INSERT", "output", M)])
tables("dual_filtered", f"insert into {M} select 1 from dual", [(0, "INSERT", "output", M)], dialect="ORACLE")


@query(_expected("supplier", "s_suppkey", "true", ["stmt_idx", "severity", "code"], [(1, "ERROR", "SPARK_PARSE_ERROR")]))
def bad_sql_isolation(t: Tables) -> DataFrame:
    found = L.lineage(scripts(t, "supplier", "s_suppkey", "select a from ods.r_{k}; selec @@ from; select b from ods.s_{k}"), dialect="SPARK")
    return L.diagnostics(found).select("script_id", long("stmt_idx").alias("stmt_idx"), "severity", "code")


@query(_expected("nation", "n_nationkey", "true", ["stmt_idx", "statement"], [(0, "select ';' from t_{k}"), (1, "-- a;b\n select 2"), (2, "select `;` /* ; */ from u")]))
def split_script(t: Tables) -> DataFrame:
    made = scripts(t, "nation", "n_nationkey", "select ';' from t_{k} ;\n-- a;b\n select 2;;  -- only\n; select `;` /* ; */ from u")
    return L.split(made).select("script_id", long("stmt_idx").alias("stmt_idx"), "statement")


_ANCHORED = [
    ("select a from t", "SPARK", 0.5), ("select a from t where b ilike 'x'", "POSTGRESQL", 0.92), ("create table t (a int) with ('connector' = 'kafka')", "FLINK", 0.93), ("select top 5 a from t", "SQLSERVER", 0.91), ("select 1 from dual", "ORACLE", 0.9),
    ("create table t (a int) stored as orc", "HIVE", 0.9), ("replace into t select 1", "MYSQL", 0.92), ("create routine load d.j on t", "STARROCKS", 0.93), ("insert overwrite t select a from b", "SPARK", 0.93), ("select `a` from t", "SPARK", 0.96),
    ("select a from t where x = 'ob_read_consistency'", "OCEANBASE", 0.94), ("select a from t limit 5, 10", "MYSQL", 0.92),
    ("select cast(a as int), (select b as string) from t", "SPARK", 0.5), ("select rows from t where stored as2", "SPARK", 0.5), ("select a[0] from t", "SPARK", 0.96), ("select [a] from [t]", "SQLSERVER", 0.91), ("select t.[a] from t", "SPARK", 0.5),
    ("select top (5) a from t", "SPARK", 0.5), ("select a from t\nusing x", "SPARK", 0.5), ("select a from t using x", "SPARK", 0.93), ("insert  overwrite t select 1", "SPARK", 0.5), ("insert into t values (1) on conflict do nothing", "POSTGRESQL", 0.92),
    ("select a::int from t", "POSTGRESQL", 0.92), ("select a from t with (nolock)", "SQLSERVER", 0.91), ("create table t (a int) distributed by hash(a)", "STARROCKS", 0.93), ("create table t (ts int, watermark for ts as ts)", "FLINK", 0.93),
    ("update t join u on a = b set c = 1", "MYSQL", 0.92), ("delete from t using u", "SPARK", 0.93), ("select a from t connect by prior b = c", "ORACLE", 0.9), ("select a div b from t", "MYSQL", 0.92), ("select 1 from t where x rlike 'a' and y ilike 'b'", "SPARK", 0.96),
]


@query(f"SELECT o_orderkey AS script_id, CASE o_orderkey % {len(_ANCHORED)} " + " ".join(f"WHEN {i} THEN '{d}'" for i, (_, d, _) in enumerate(_ANCHORED)) + f" END AS dialect, CAST(CASE o_orderkey % {len(_ANCHORED)} " + " ".join(f"WHEN {i} THEN {c}" for i, (_, _, c) in enumerate(_ANCHORED)) + " END AS DOUBLE) AS confidence FROM orders")
def detect_dialect(t: Tables) -> DataFrame:
    sql = F.element_at(F.array(*[F.lit(s) for s, _, _ in _ANCHORED]), (C("o_orderkey") % len(_ANCHORED) + 1).cast("int"))
    made = t.orders.select(C("o_orderkey").alias("script_id"), F.concat(F.lit("/* c "), C("o_orderkey"), F.lit(" ilike */ "), sql).alias("sql"))
    return detect.detected(L.spread(made), "sql").select("script_id", "dialect", "confidence")


# --- graph --------------------------------------------------------------------------------------

def _chain(t: Tables) -> DataFrame:
    """t_k is read from t_(k - 1), in chains of seven."""
    made = t.part.filter("p_partkey % 7 <> 0").select(C("p_partkey").alias("script_id"), F.format_string("insert into c.t_%d(v) select v from c.t_%d", "p_partkey", C("p_partkey") - 1).alias("sql"))
    return L.lineage(made, dialect="SPARK")


_LINKS = "SELECT p_partkey - 1 AS a, p_partkey AS b FROM part WHERE p_partkey % 7 <> 0"


@query(f"WITH RECURSIVE e AS ({_LINKS}), r(seed, node, depth) AS (SELECT a, a, 0 FROM e WHERE a % 7 = 0 UNION ALL SELECT seed, b, depth + 1 FROM r JOIN e ON a = node) SELECT 'c.t_' || seed || '.v' AS seed, 'c.t_' || node || '.v' AS node, CAST(depth AS BIGINT) AS depth FROM r")
def downstream_closure(t: Tables) -> DataFrame:
    e = graph.cut(graph.column_graph(_chain(t)))
    seeds = e.filter(C("src").rlike(r"_\d+\.v$") & (F.regexp_extract("src", r"_(\d+)\.v", 1).cast("long") % 7 == 0)).select(C("src").alias("node")).distinct()
    return graph.downstream(e, seeds).select("seed", "node", long("depth").alias("depth"))


@query(f"WITH RECURSIVE e AS ({_LINKS}), r(seed, node, depth) AS (SELECT b, b, 0 FROM e WHERE b % 7 = 6 UNION ALL SELECT seed, a, depth + 1 FROM r JOIN e ON b = node) SELECT 'c.t_' || seed || '.v' AS seed, 'c.t_' || node || '.v' AS node, CAST(depth AS BIGINT) AS depth FROM r")
def upstream_closure(t: Tables) -> DataFrame:
    e = graph.cut(graph.column_graph(_chain(t)))
    seeds = e.filter(F.regexp_extract("dst", r"_(\d+)\.v", 1).cast("long") % 7 == 6).select(C("dst").alias("node")).distinct()
    return graph.upstream(e, seeds).select("seed", "node", long("depth").alias("depth"))


_HUB = "insert into mart.h_{k} select a, b from ods.hub where c = {k} and a > 0 order by b"


@query("SELECT 'ods.hub' AS source_table, c AS source_column, count(*) AS n_statements, count(*) AS n_targets, count(*) AS n_tables FROM nation, (VALUES ('a'), ('b')) v(c) GROUP BY c")
def impact_by_column(t: Tables) -> DataFrame:
    return graph.impact(L.lineage(scripts(t, "nation", "n_nationkey", _HUB), dialect="SPARK"))


@query('SELECT \'ods.hub\' AS table_name, c AS column_name, CASE WHEN c <> \'b\' THEN n ELSE 0 END AS "WHERE", CAST(0 AS BIGINT) AS JOIN_ON, CAST(0 AS BIGINT) AS GROUP_BY, CAST(0 AS BIGINT) AS HAVING, CASE WHEN c = \'b\' THEN n ELSE 0 END AS ORDER_BY FROM (SELECT count(*) AS n FROM nation), (VALUES (\'a\'), (\'b\'), (\'c\')) v(c)')
def usage_heatmap(t: Tables) -> DataFrame:
    return graph.usage_heatmap(L.lineage(scripts(t, "nation", "n_nationkey", _HUB), dialect="SPARK"))


@query("SELECT 'SPARK' AS dialect, 3 * count(*) AS n_statements, 2 * count(*) AS n_recognized, 2 * count(*) AS n_with_tables, 2 * count(*) AS n_with_columns, CAST(0 AS BIGINT) AS n_partial, count(*) AS n_failed FROM supplier")
def corpus_coverage(t: Tables) -> DataFrame:
    return graph.corpus_coverage(L.lineage(scripts(t, "supplier", "s_suppkey", "select a from ods.r_{k}; selec @@; select b from ods.s_{k}"), dialect="SPARK"))


@query("SELECT 'SPARK' AS dialect, s AS statement_type, n FROM (SELECT count(*) AS n FROM nation), (VALUES ('SELECT'), ('DROP_TABLE'), ('USE_SCHEMA')) v(s)")
def statement_histogram(t: Tables) -> DataFrame:
    return graph.statement_histogram(L.lineage(scripts(t, "nation", "n_nationkey", "select 1 as k; drop table t_{k}; use d"), dialect="SPARK"))


_NOCOL = [("select * from t", "SELECT_STAR"), ("select count(*) from t", "OTHER"), ("select  count(*) from t", "COUNT_STAR_OR_AGG"), ("show tables", "NO_FROM_OR_METADATA"), ("select 'x' from t", "CONSTANT_PROJECTION"), ("select x from t lateral view explode(y) e as x", "LATERAL_OR_EXPLODE"), ("with q as (select a from t) select a from q", "CTE"), ("select a from t union select b from u", "UNION"), ("select a - b from t", "OTHER"), ("select a from t", "OTHER"),
          ("select max(x) from t", "OTHER"), ("select t.* from t", "OTHER"), ("select null as x from t", "CONSTANT_PROJECTION"), ("select true from t", "CONSTANT_PROJECTION"), ("select coalesce(a, 1) from t", "EXPRESSION"),
          ("select case when a then b end from t", "EXPRESSION"), ("select a, count( * ) from t", "COUNT_STAR_OR_AGG"), ("select x from t where explode(y)", "LATERAL_OR_EXPLODE"), ("insert into t select 1", "NO_FROM_OR_METADATA")]


@query(f"SELECT o_orderkey AS script_id, CASE o_orderkey % {len(_NOCOL)} " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_NOCOL)) + " END AS class FROM orders")
def no_column_classes(t: Tables) -> DataFrame:
    sql = F.element_at(F.array(*[F.lit(s) for s, _ in _NOCOL]), (C("o_orderkey") % len(_NOCOL) + 1).cast("int"))
    return t.orders.select(C("o_orderkey").alias("script_id"), graph.no_column_class(sql).alias("class"))


@query("SELECT n_nationkey AS script_id, 'x.t' AS target_table, CASE i WHEN 0 THEN 'p' ELSE 'b' END AS target_column, 'ods.n_' || n_nationkey AS source_table, CASE i WHEN 0 THEN 'a' ELSE 'b' END AS source_column FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation), range(2) r(i)")
def retarget_edges(t: Tables) -> DataFrame:
    e = L.column_edges(L.lineage(scripts(t, "nation", "n_nationkey", f"select a, b from {O}"), dialect="SPARK"))
    return L.retarget(e, "x.t", ["p"]).select("script_id", "target_table", "target_column", "source_table", "source_column")


@query("SELECT CAST(n_nationkey AS BIGINT) AS script_id, 'a' AS target_column, s AS source_table, c AS source_column FROM nation, (VALUES ('ods.x', 'a'), ('ods.y', 'c')) v(s, c)")
def merge_edges(t: Tables) -> DataFrame:
    one = lambda sql: L.column_edges(L.lineage(scripts(t, "nation", "n_nationkey", sql), dialect="SPARK"))
    return L.merge_set_edges(one("select a, b from ods.x"), one("select c from ods.y")).select("script_id", "target_column", "source_table", "source_column")


# --- the plain Python face ----------------------------------------------------------------------


@query("SELECT 0::BIGINT AS stmt_idx, 'SELECT' AS statement_type, 'HIVE' AS dialect, 's' AS schema, 't' AS name")
def parse_one(t: Tables) -> DataFrame:
    r = api.parse("select a from s.t; drop table x", "hive")
    return t.spark.createDataFrame([(r["stmt_idx"], r["statement_type"], r["dialect"], r["inputs"][0]["schema"], r["inputs"][0]["name"])], "stmt_idx long, statement_type string, dialect string, schema string, name string")


@query("SELECT * FROM (VALUES (0, 'POSTGRESQL', 1.0::DOUBLE), (1, 'UNKNOWN', 0.0::DOUBLE), (2, 'POSTGRESQL', 0.92::DOUBLE), (3, 'SPARK', 0.5::DOUBLE)) v(i, dialect, confidence)")
def select_dialect(t: Tables) -> DataFrame:
    sql = "select a::int from t"
    made = [api.select_dialect(sql, ["postgresql"]), api.select_dialect(sql, detection=False), api.select_dialect(sql), api.select_dialect("select 1")]
    return t.spark.createDataFrame([(i, *x) for i, x in enumerate(made)], "i int, dialect string, confidence double")


def _counting(script: str, dialect: str | None) -> list:
    return [(s, 0.25, Result("OWN", f"WORDS_{len(s.split())}")) for s in script.split(";")]


@query("SELECT * FROM (VALUES (0::BIGINT, 'WORDS_2', 0.25::DOUBLE), (1, 'WORDS_3', 0.25)) v(stmt_idx, statement_type, confidence)")
def replaced_engine(t: Tables) -> DataFrame:
    api.configure(_counting)
    try:
        made = api.parse_script("select a; drop table x")
    finally:
        api.configure(None)
    return t.spark.createDataFrame([(r["stmt_idx"], r["statement_type"], r["dialect_confidence"]) for r in made], "stmt_idx long, statement_type string, confidence double")


def _toy(sql: str, dialect: str, temps: dict) -> Result:
    return Result(dialect, "SELECT", inputs=[tuple(sql.split()[-1].split("."))])


@query("SELECT CAST(n_nationkey AS BIGINT) AS script_id, i AS stmt_idx, 'TOY' AS dialect, 'SELECT' AS statement_type, 'ods.' || c || '_' || n_nationkey AS full_name FROM nation, (VALUES (0::BIGINT, 'a'), (1, 'b')) v(i, c)")
def dialect_plugin(t: Tables) -> DataFrame:
    """A dialect registered at run time, read by the workers of a DataFrame query."""
    api.register("toy", _toy)
    found = L.lineage(scripts(t, "nation", "n_nationkey", "show ods.a_{k}; show ods.b_{k}"), dialect="TOY")
    return L.typed_tables(found).join(L.statements(found).select("script_id", "stmt_idx", "dialect"), ["script_id", "stmt_idx"]).select("script_id", long("stmt_idx").alias("stmt_idx"), "dialect", "statement_type", "full_name")


@query("SELECT * FROM (VALUES (0, 'SELECT', 'MYSQL'), (1, 'DROP_TABLE', 'MYSQL')) v(i, statement_type, dialect)")
def command_line(t: Tables) -> DataFrame:
    out = io.StringIO()
    cli.run(["--dialect=mysql", "select a from s.t; drop table x"], io.StringIO(), out, io.StringIO())
    return t.spark.createDataFrame([(i, r["statement_type"], r["dialect"]) for i, r in enumerate(json.loads(out.getvalue()))], "i int, statement_type string, dialect string")


@query("WITH RECURSIVE h AS (SELECT p_partkey, 1::BIGINT AS level FROM part WHERE p_partkey <= 25 UNION ALL SELECT p.p_partkey, h.level + 1 FROM part p JOIN h ON p.p_partkey - 25 = h.p_partkey) SELECT p_partkey, level FROM h")
def connect_by_deep(t: Tables) -> DataFrame:
    """Chains through the whole table, as deep as its size makes them."""
    rows = t.part.select("p_partkey", (C("p_partkey") - 25).alias("up"))
    return R.connect_by(rows, "p_partkey", "up", C("p_partkey") <= 25).select("p_partkey", long("level").alias("level"))


edges("column_lineage_hinted", f"insert into {M} select x from {O} u join dwd.o o on u.x = o.id", [(M, "x", O, "x")])
tables("table_lineage_merged", f"select a from {O} union all select b from {O} where c in (select d from {O})", [(0, "SELECT", "input", O)])

__all__ = ["ORACLE", "QUERIES"]
