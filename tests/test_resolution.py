"""Resolution rules, statement by statement. Expected values are derived from the documented rules."""

import pytest

from sqlloom.functions.detect import candidates
from sqlloom.functions.text import split_statements
from sqlloom.plans.statements import parse_script, parse_statement


def edges(sql, dialect="SPARK"):
    r = parse_statement(sql, dialect)
    assert not [d for d in r.diagnostics if d[0] == "ERROR"], r.diagnostics
    return [(".".join([*(e.target or ()), e.name]), [".".join([*(s[0] or ()), s[1]]) for s in e.sources]) for e in r.edges]


def tables(r):
    return [".".join(t) for t in r.inputs], [".".join(t) for t in r.outputs]


CASES = [
    ("select * from a.t", [("*", ["a.t.*"])]),
    ("select u.* from (select id as k, nm from a.t) u", [("k", ["a.t.id"]), ("nm", ["a.t.nm"])]),
    ("with u as (select id as K from a.t) select k from u", [("k", ["a.t.id"])]),
    ("select x from a.t lateral view explode(xs) e as X", [("x", ["a.t.xs"])]),
    ("select k, v from (select id as k from a.t) u join (select v from b.t) o on u.k = o.v", [("k", ["a.t.id"]), ("v", ["b.t.v"])]),
    ("select id from a.t u join (select o from b.t) o on u.id = o.o", [("id", ["a.t.id"])]),
    ("select id from a.t u join (select id from b.t) o on u.id = o.id", []),
    ("select id from (select id from a.t) u join (select id from b.t) o on u.id = o.id", []),
    ("select s from (select * from a.t) e left join (select v as w from b.t) v on e.v = v.w", [("s", ["a.t.s"])]),
    ("select v from (select * from a.t) u join (select * from b.t) o on u.id = o.id", []),
    ("select * from a.t union all select * from b.t", [("*", ["a.t.*", "b.t.*"])]),
    ("select d, count(*) as n from a.t group by d", [("d", ["a.t.d"]), ("n", [])]),
    ("select max(v) from a.t", [("max(v)", ["a.t.v"])]),
    ("select cast(v as string) from a.t", [("v", ["a.t.v"])]),
    ("select lower(v) from a.t", []),
    ("select b - a from s.t", []),
    ("select 'x', 1 from a.t", [("'x'", []), ("1", [])]),
    ("select f(a, b) as (x, y) from s.t", [("x", ["s.t.a", "s.t.b"]), ("y", ["s.t.a", "s.t.b"])]),
    ("select s.t.a as a from s.t", [("a", ["s.t.a"])]),
    ("select count(case when k = 6 then 1 end) as n from a.t l join b.t d on l.k = d.id", [("n", ["a.t.k"])]),
    ("select (select max(v) from q) as m from b.t", [("m", ["q.v"])]),
    ("select v.p, v.q as r from (select from_json(c, 'p string') as v from a.t) s", [("p", ["a.t.c"]), ("r", ["a.t.c"])]),
    ("insert into m.t(x, y) select a, b from s.t", [("m.t.x", ["s.t.a"]), ("m.t.y", ["s.t.b"])]),
    ("insert into m.t(x) select a from s.t union all select b from s.u", [("m.t.x", ["s.t.a", "s.u.b"])]),
    ("create view m.v (x) as select a from s.t", [("m.v.x", ["s.t.a"])]),
    ("from s.t |> where a > 0 |> select a as k |> extend k as j", [("k", ["s.t.a"]), ("j", ["s.t.a"])]),
    ("from s.t |> aggregate count(b) as n group by a |> select a, n", [("a", ["s.t.a"]), ("n", ["s.t.b"])]),
    ("create table m.t as (select a from s.t)", [("m.t.a", ["s.t.a"])]),
]


@pytest.mark.parametrize("sql,expected", CASES, ids=range(len(CASES)))
def test_edges(sql, expected):
    assert edges(sql) == expected


def test_scripts_share_temporary_relations():
    rs = [r for _, _, r in parse_script("create or replace temporary view v as select id as k from o.u; insert into a.s select k from v; drop view v; select k from v")]
    assert [r.statement_type for r in rs] == ["CREATE_VIEW", "INSERT", "DROP_VIEW", "SELECT"]
    assert tables(rs[1]) == (["o.u"], ["a.s"]) and tables(rs[3])[0] == ["v"]
    assert rs[1].edges[0].sources == [(("o", "u"), "id")]


def test_bad_sql_is_a_diagnostic_and_does_not_stop_a_script():
    rs = [r for _, _, r in parse_script("select @; select id from o.u")]
    assert rs[0].diagnostics[0][1] == "SPARK_PARSE_ERROR" and tables(rs[1])[0] == ["o.u"]
    r = parse_statement("select id from o.u where d = '${x}' and", "SPARK")
    assert (r.statement_type, tables(r)[0], r.diagnostics[0][1]) == ("SELECT", ["o.u"], "SPARK_PARSE_ERROR")
    r = parse_statement("select id from where", "HIVE")
    assert r.statement_type == "UNKNOWN" and r.diagnostics[0][1] == "HIVE_PARSE_ERROR" and not r.inputs
    assert parse_statement("select 1", "TRINO").diagnostics[0][1] == "DIALECT_NOT_REGISTERED"


def test_dialect_families_differ():
    sql = "update m.t t set v = s.v from d.s s where t.id = s.id"
    assert tables(parse_statement(sql, "POSTGRESQL"))[0] == ["m.t", "d.s"]
    merge = "merge into m.t t using d.s s on t.id = s.id when matched and s.op = 'U' then update set v = s.v when not matched then insert (id, v) values (s.id, s.v)"
    for dialect, inputs in (("SPARK", ["d.s"]), ("ORACLE", ["m.t", "d.s"])):
        r = parse_statement(merge, dialect)
        assert tables(r) == (inputs, ["m.t"])
        assert [e.name for e in r.edges] == ["v", "id", "v"]
        assert [u[0] for u in r.usages] == ["MERGE_ON", "MERGE_ON", "MERGE_WHEN"]
    assert parse_statement("select * from a.t", "HIVE").edges == []
    r = parse_statement("select sum(v) over (partition by k order by d) as s from a.t", "HIVE")
    assert [u[0] for u in r.usages] == ["WINDOW_PARTITION_BY", "WINDOW_ORDER_BY"]
    assert parse_statement("select sysdate from dual", "ORACLE").inputs == []
    r = parse_statement("insert all into x.a (p) values (k) into x.b select k from s.t", "ORACLE")
    assert tables(r) == (["s.t"], ["x.a", "x.b"]) and len(r.edges) == 2
    r = parse_statement("insert into m.t(a) select b from s.t on duplicate key update a = values(a)", "MYSQL")
    assert [e.sources for e in r.edges] == [[(("s", "t"), "b")]] * 2
    r = parse_statement("select 1", "OCEANBASE")
    assert r.dialect == "OCEANBASE" and r.diagnostics[0][1] == "OCEANBASE_COMPATIBILITY_MODE_INFERRED"


def test_splitting():
    assert split_statements("select ';' ; -- a;b\n select 2 /* ; */;;  -- only") == ["select ';'", "-- a;b\n select 2 /* ; */"]
    assert split_statements("select 1\\nfrom\\tt; ") == ["select 1\nfrom t"]
    assert split_statements("") == [] and split_statements("  -- x\n;") == []


@pytest.mark.parametrize(
    "sql,dialect,confidence",
    [
        ("select 1", "SPARK", 0.50), ("select a from t where b ilike 'x'", "POSTGRESQL", 0.92), ("create table t (a int) with ('connector' = 'kafka')", "FLINK", 0.93),
        ("select top 5 a from t", "SQLSERVER", 0.91), ("select 1 from dual", "ORACLE", 0.90), ("create table t (a int) stored as orc", "HIVE", 0.90),
        ("replace into t select 1", "MYSQL", 0.92), ("create routine load d.j on t", "STARROCKS", 0.93), ("insert overwrite t select `a` from b", "SPARK", 0.96),
        ("select /*+ oceanbase */ 1", "SPARK", 0.50), ("select 'oceanbase'", "OCEANBASE", 0.94), ("insert overwrite t select a from b", "SPARK", 0.93),
    ],
)
def test_detection(sql, dialect, confidence):
    assert candidates(sql)[0] == (dialect, confidence)


def test_detection_columns_agree_with_python(spark):
    from pyspark.sql import functions as F

    from sqlloom.functions import detect

    texts = [c[0] for c in CASES] + ["select a from t where b ilike 'x'", "select top 5 a from [t]", "update a join b set c = 1", "select '_ob_' from dual", "delete from t using u", "select x -- ilike\n from t", "select /* oceanbase */ `a` from t", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, sql string")
    rows = detect.detected(df).withColumn("all", detect.candidate_columns(detect.stripped(F.coalesce("sql", F.lit(""))))).collect()
    for r in rows:
        want = candidates(texts[r.i] or "")
        assert [(c.dialect, c.confidence) for c in r.all] == want
        assert (r.dialect, r.confidence) == want[0]
