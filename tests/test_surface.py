"""CLI, facade, sources, streams."""

import base64
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from sqlloom import api
from sqlloom.cli import run
from sqlloom.operators import graph, lineage as L
from sqlloom.operators import relational as R
from sqlloom.sources import corpus
from sqlloom.streaming import streams


def cli(*args, text=""):
    out, err = io.StringIO(), io.StringIO()
    return run(list(args), io.StringIO(text), out, err), out.getvalue(), err.getvalue()


def test_cli():
    code, out, _ = cli("select a from s.t; drop table x")
    found = json.loads(out)
    assert code == 0 and [r["statement_type"] for r in found] == ["SELECT", "DROP_TABLE"]
    code, out, _ = cli("--dialect=pg", text="select a::int as b from s.t")
    assert code == 0 and json.loads(out)[0]["dialect"] == "POSTGRESQL" and json.loads(out)[0]["dialect_confidence"] == 1.0
    assert cli("--dialect", "mssql", "select 1")[0] == 0
    assert cli("-h")[0] == 0
    for bad in (("--dialect",), ("--dialect=zzz", "select 1"), ("--what",), ()):
        assert cli(*bad)[0] == 2


def test_facade():
    assert api.parse("")["diagnostics"][0]["code"] == "EMPTY_SQL" and api.parse("")["dialect"] == "UNKNOWN"
    assert api.parse("select a from s.t", "hive")["dialect"] == "HIVE"
    assert api.parse("select 1", detection=False)["diagnostics"][0]["code"] == "DIALECT_NOT_REGISTERED"
    assert api.select_dialect("select 1", ["x"]) == ("X", 1.0) and api.select_dialect("select 1", detection=False) == ("UNKNOWN", 0.0)
    api.configure(lambda sql, dialect: [])
    assert api.parse("select 1")["diagnostics"][0]["code"] == "EMPTY_SQL"
    api.configure(None)
    from sqlloom.plans.lineage import Result

    api.register("trino", lambda sql, dialect, temps: Result(dialect, "SELECT"))
    assert api.parse("select 1", "trino")["statement_type"] == "SELECT"


def test_corpus(spark, tmp_path):
    enc = lambda s: base64.b64encode(s.encode()).decode()
    lines = ["taskRow\tscriptIndex\tsqlBase64", f"1\t0\t{enc('select a from s.t')}", f"2\t0\t{enc('selec @@')}", f"x\t0\t{enc('select 1')}", "3\t1\t***"]
    (tmp_path / "c.tsv").write_text("\n".join(lines))
    scripts = corpus.read_corpus(spark, str(tmp_path / "c.tsv"))
    assert sorted(r.script_id for r in scripts.collect()) == [1_000_000, 2_000_000]
    coverage, failures = corpus.evaluate(scripts)
    r = coverage.collect()[0]
    assert (r.n_statements, r.n_failed, r.n_with_columns) == (2, 1, 1) and failures.count() == 1
    corpus.write_results(L.lineage(scripts), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/column_edges")).count() == 1
    (tmp_path / "q.sql").write_text("select a from s.t;\nselect b from s.u")
    files = corpus.read_sql_files(spark, str(tmp_path / "q.sql"))
    assert L.lineage(files).count() == 2


def test_lineage_of_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (None, "select a from t"), (2, ""), (3, "x" * 100_000)], "script_id long, sql string")
    found = {r.script_id: r.statement_type for r in L.lineage(rows).collect()}
    assert found == {None: "SELECT", 3: "UNKNOWN"}
    assert L.lineage(rows.limit(0)).count() == 0
    assert graph.closure(spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([("a",)], "node string")).count() == 1


def test_cycles_end(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    found = {(r.node, r.depth) for r in graph.downstream(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert found == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_dml_with_nulls(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    s = spark.createDataFrame([(2, "x"), (3, None), (4, "y")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(R.delete_where(t, F.col("v") == "a")) == [(2, None), (3, "c")]
    assert rows(R.update_where(t, F.col("v") == "a", {"v": F.lit("z")})) == [(1, "z"), (2, None), (3, "c")]
    assert rows(R.upsert(t, s, ["k"])) == [(1, "a"), (2, "x"), (3, None), (4, "y")]
    assert rows(R.merge(t, s, "k", update={"v": F.col("s_v")}, insert={"v": F.col("s_v")}, delete_missing=F.lit(True))) == [(2, "x"), (3, None), (4, "y")]
    assert rows(R.merge(t, s, "k", update={"v": F.col("s_v")}, update_if=F.col("v").isNull())) == [(1, "a"), (2, "x"), (3, "c")]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "select a from s.t"), (2, "insert into m.t select a from s.t; drop table q")], "script_id long, sql string").write.parquet(str(src))
    scripts = streams.read_stream(spark, "parquet", "script_id long, sql string", str(src))
    q = streams.lineage_stream(scripts).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("found").count() == 3
    ev = tmp_path / "ev"
    spark.sql("select timestamp '2024-01-01' + make_interval(0,0,0,0,0,id * 10) as ts, cast(id % 2 as int) as k, id as v from range(24)").write.parquet(str(ev))
    events = streams.read_stream(spark, "parquet", "ts timestamp, k int, v long", str(ev))
    q = streams.tumble(events, "ts", "1 hour", "10 minutes", ["k"], F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.n) for r in spark.table("w").collect()) == [(0, 3)] * 4 + [(1, 3)] * 4
    got = []
    q = streams.auto_cdc(events, ["k"], "v", lambda df, _: got.extend(df.select("k", "v").collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(map(tuple, got)) == [(0, 22), (1, 23)]


def test_closure_and_connect_by_have_no_depth_limit(spark):
    n = 104
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(n)], "src string, dst string").coalesce(1)
    found = graph.closure(e, spark.createDataFrame([("0",)], "node string")).collect()
    assert {int(r.node): r.depth for r in found} == {i: i for i in range(n + 1)}
    n = 70
    rows = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)] + [(500, 501), (501, 500)], "k int, up int").coalesce(1)
    found = R.connect_by(rows, "k", "up", (F.col("k") == 0) | (F.col("k") == 500)).collect()
    assert {r.k: r.level for r in found} == {i: i + 1 for i in range(n)} | {500: 1, 501: 2}


def test_joins_by_ranges_against_all_pairs(spark):
    own = random.Random(4)
    some = lambda n, most: [(i, own.randrange(3), own.choice([None, *range(most)])) for i in range(n)]
    a, b = some(150, 60), some(60, 60)
    left, right = spark.createDataFrame(a, "i int, k int, x int"), spark.createDataFrame([(k, x, i) for i, k, x in b], "k int, x int, v int")
    for by in ([], ["k"]):
        same = [(lambda r, s: r[1] == s[1]) if by else (lambda r, s: True)][0]
        rows = left if by else left.drop("k")
        table = right if by else right.drop("k")
        for spread in (False, True):
            found = {r.i: (r.r_x, r.r_v) for r in R.asof_join(rows, table, "x", "x", by, ["v"], spread=spread).collect()}
            want = {r[0]: max(((s[2], s[0]) for s in b if same(r, s) and s[2] is not None and r[2] is not None and s[2] <= r[2]), default=(None, None)) for r in a}
            assert found == want
            found = {r.i: (r.near_x, r.near_v) for r in R.nearest(rows, table, "x", "x", by, "v", spread=spread).collect()}
            near = {r[0]: min(((abs(s[2] - r[2]), s[2], s[0]) for s in b if same(r, s) and s[2] is not None and r[2] is not None), default=None) for r in a}
            assert found == {i: (x and float(x[1]) if x else None, x[2] if x else None) if x else (None, None) for i, x in near.items()}
    spans = [(i, float(lo), float(lo + own.choice([0, 1, 7, 90, 5000, -1]))) for i, lo in enumerate(own.sample(range(-300, 300), 60))]
    points = [(i, float(own.randrange(-400, 6000))) for i in range(300)]
    found = R.range_join(spark.createDataFrame(points, "p int, at double"), spark.createDataFrame(spans, "s int, lo double, hi double"), "at", "lo", "hi", 1.0)
    assert sorted((r.p, r.s) for r in found.collect()) == sorted((p, s) for p, at in points for s, lo, hi in spans if lo <= at <= hi)
    assert R.range_join(spark.createDataFrame(points, "p int, at double"), spark.createDataFrame([], "s int, lo double, hi double"), "at", "lo", "hi", 1.0).count() == 0


def test_repeated_source_keys_are_errors(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(2, "x"), (2, "y"), (None, "z"), (None, "w")], "k int, v string")
    new = twice.filter("k is null")
    for make in (
        lambda s: R.merge(t, s, "k", update={"v": F.col("s_v")}, insert={"v": F.col("s_v")}), lambda s: R.upsert(t, s, ["k"]), lambda s: R.update_from(t, s, "k", {"v": "v"}),
    ):
        with pytest.raises(Exception, match="several source rows"):
            make(twice).collect()
        assert make(new).filter("k is not null").count() == 2
    assert sorted(R.returning(R.updated(t, F.col("k") == 1, {"v": F.lit("a")}), "k", "v").collect()) == [(1, "a")]


def test_blocks_stay_whole():
    from sqlloom.functions.text import split_statements

    assert len(split_statements("execute statement set begin insert into a select 1; insert into b select 2; end; select 3")) == 2
    assert len(split_statements("create or replace procedure p as begin insert into t select 1 from dual; if x then y; end if; begin z; end; end; select 1 from dual")) == 2
    assert len(split_statements("create procedure p as begin select 1; select 2")) == 2
    assert len(split_statements("begin; select 1; end")) == 3
    assert api.parse("create or replace procedure p as begin insert into t select 1 from dual; end", "oracle")["diagnostics"] == []


def test_loads_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    corpus.copy_to(rows, str(tmp_path / "csv"), header="true")
    corpus.load_data(spark, str(tmp_path / "csv"), "k int, v string", str(tmp_path / "t"), header="true")
    corpus.load_data(spark, str(tmp_path / "csv"), "k int, v string", str(tmp_path / "t"), header="true")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    spark.sql("drop table if exists made")
    corpus.create_table_as(rows, "made", partition_by=("k",))
    corpus.insert(spark.createDataFrame([("z", 2), ("y", 3)], "v string, k int"), "made", overwrite=True)
    assert sorted(map(tuple, spark.table("made").select("k", "v").collect())) == [(1, "a"), (2, "z"), (3, "y")]
    corpus.insert(rows, "made")
    assert spark.table("made").count() == 5
    spark.sql("drop table made")
