"""Named queries over the test tables, each with the same query in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators.graph import shared_dir
from ..sources import corpus
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
C = F.col


class Tables:
    """Tables of one folder, read when they are named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None, name: str | None = None):
    def register(make: Callable[[Tables], DataFrame]):
        key = name or make.__name__
        QUERIES[key] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            ORACLE[key] = sql
        return make

    return register


def long(c) -> F.Column:
    return (C(c) if isinstance(c, str) else c).cast("long")


def money(c, alias: str):
    return F.round(F.sum(c), 2).alias(alias)


def _sampled(whole: DataFrame, sample: DataFrame, share: float) -> DataFrame:
    """Rows of the table, whether the sample's number is near its share (five deviations, for rows of any size
    a fifth), and whether all its rows are the table's own."""
    key = whole.columns[0]
    n, m = whole.agg(F.count("*").alias("n")), sample.agg(F.count("*").alias("m"))
    own = sample.select(key).distinct().join(whole.select(key), key, "left_anti").agg(F.count("*").alias("strange"))
    bound = F.greatest(5 * F.sqrt(C("n") * share * (1 - share)), F.lit(0.2 * share) * C("n")) + 1
    return n.crossJoin(m).crossJoin(own).select("n", (F.abs(C("m") - share * C("n")) <= bound).alias("near"), (C("strange") == 0).alias("own"))


# --- scans, projections, filters ----------------------------------------------------------------

query("SELECT o_orderkey, o_totalprice FROM orders", "scan_project")(lambda t: t.orders.select("o_orderkey", "o_totalprice"))
query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "select_distinct")(lambda t: t.orders.select("o_orderstatus", "o_orderpriority").distinct())
query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'F') OR NOT (o_orderpriority <> '1-URGENT')", "filter_and_or_not")(
    lambda t: t.orders.filter(((C("o_totalprice") > 100000) & (C("o_orderstatus") == "F")) | ~(C("o_orderpriority") != "1-URGENT")).select("o_orderkey")
)
query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')", "between_in")(
    lambda t: t.part.filter(C("p_size").between(5, 15) & C("p_brand").isin("Brand#11", "Brand#12", "Brand#23")).select("p_partkey")
)
query("SELECT p_partkey FROM part WHERE p_name LIKE '%a%' OR p_type ILIKE '%STEEL' OR regexp_matches(p_brand, '#[12]\\d$')", "like_ilike_rlike")(
    lambda t: t.part.filter(C("p_name").like("%a%") | C("p_type").ilike("%STEEL") | C("p_brand").rlike(r"#[12]\d$")).select("p_partkey")
)
query("SELECT a.n_nationkey AS k FROM nation a JOIN nation b ON nullif(a.n_regionkey, 1) IS NOT DISTINCT FROM nullif(b.n_regionkey, 1)", "null_safe_eq")(
    lambda t: t.nation.select("n_nationkey", F.nullif("n_regionkey", F.lit(1)).alias("x")).alias("a").join(t.nation.select(F.nullif("n_regionkey", F.lit(1)).alias("y")), C("x").eqNullSafe(C("y"))).select(C("n_nationkey").alias("k"))
)
query("SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 1) IS DISTINCT FROM 2", "is_distinct_from")(lambda t: t.nation.filter(~F.nullif("n_regionkey", F.lit(1)).eqNullSafe(F.lit(2))).select("n_nationkey"))
query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS done FROM orders", "case_when")(
    lambda t: t.orders.select("o_orderkey", F.when(C("o_totalprice") > 200000, "big").when(C("o_totalprice") > 100000, "mid").otherwise("small").alias("size"), F.when(C("o_orderstatus") == "F", 1).otherwise(0).alias("done"))
)
query("SELECT o_orderkey, TRY_CAST(o_orderstatus AS INTEGER) AS n, CAST(o_orderkey AS VARCHAR) AS k, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders", "cast_try_cast")(
    lambda t: t.orders.select("o_orderkey", C("o_orderstatus").try_cast("int").alias("n"), C("o_orderkey").cast("string").alias("k"), F.floor("o_totalprice").cast("long").alias("p"))
)
query("SELECT * EXCLUDE (s_acctbal) FROM supplier", "star_except")(lambda t: t.supplier.drop("s_acctbal"))
query("SELECT count(*) AS n, true AS near, true AS own FROM orders", "sample_seeded")(lambda t: _sampled(t.orders, R.sample_percent(t.orders, 10, 7), 0.1))
query("SELECT least(count(*), 100) AS n FROM orders", "sample_rows")(lambda t: R.sample_rows(t.orders, 100).agg(F.count("*").alias("n")))
query("SELECT count(*) AS n, true AS near, true AS own FROM documents", "sample_bytes")(lambda t: _sampled(t.documents, R.sample_bytes(t.documents, t.documents.agg(F.sum(F.octet_length("text"))).first()[0] // 4, F.octet_length("text")), 0.25))
query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3", "sample_bucket")(lambda t: t.orders.filter(F.pmod("o_orderkey", F.lit(10)) == 3).select("o_orderkey"))
query("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(k, s)", "inline_values")(lambda t: t.spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string"))
query("SELECT range AS id FROM range(5, 25, 4)", "tvf_range")(lambda t: t.spark.range(5, 25, 4))
query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2", "parameterized")(lambda t: t.spark.sql("select n_nationkey, n_name from {n} where n_regionkey = :r", args={"r": 2}, n=t.nation))

# --- joins --------------------------------------------------------------------------------------

_CO = "customer JOIN orders ON c_custkey = o_custkey"
query(f"SELECT c_custkey, o_orderkey FROM {_CO}", "inner_join")(lambda t: t.customer.join(t.orders, C("c_custkey") == C("o_custkey")).select("c_custkey", "o_orderkey"))
for how, sql in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    query(f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c {sql} JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') o ON c_custkey = o_custkey", f"{how}_join")(
        lambda t, how=how: t.customer.filter("c_mktsegment <> 'BUILDING'").join(t.orders.filter("o_orderstatus <> 'F'"), C("c_custkey") == C("o_custkey"), how).select("c_custkey", "o_orderkey")
    )
query("SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation", "cross_join")(lambda t: t.region.crossJoin(t.nation).select("r_regionkey", "n_nationkey"))
query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "left_semi_join")(
    lambda t: t.customer.join(t.orders.filter("o_totalprice > 300000"), C("c_custkey") == C("o_custkey"), "left_semi").select("c_custkey")
)
query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "left_anti_join")(
    lambda t: t.customer.join(t.orders, C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey")
)
query("SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)", "natural_join")(
    lambda t: (lambda a, b: a.join(b, [c for c in a.columns if c in b.columns]))(t.nation.select(C("n_regionkey").alias("k"), "n_name"), t.region.select(C("r_regionkey").alias("k"), "r_name"))
)
query("SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) JOIN (SELECT s_nationkey AS k, s_name FROM supplier) USING (k)", "using_join")(
    lambda t: t.nation.select(C("n_nationkey").alias("k"), "n_name").join(t.supplier.select(C("s_nationkey").alias("k"), "s_name"), "k")
)
query("SELECT s_suppkey, b FROM supplier JOIN (VALUES (1, -1000.0, 2500.0), (2, 2500.0, 6000.0), (3, 6000.0, 20000.0)) v(b, lo, hi) ON s_acctbal BETWEEN lo AND hi", "theta_range_join")(
    lambda t: R.range_join(t.supplier, t.spark.createDataFrame([(1, -1000.0, 2500.0), (2, 2500.0, 6000.0), (3, 6000.0, 20000.0)], "b int, lo double, hi double"), "s_acctbal", "lo", "hi", 500.0).select("s_suppkey", "b")
)
query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "self_join")(
    lambda t: t.nation.alias("a").join(t.nation.alias("b"), F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(C("a.n_name").alias("a"), C("b.n_name").alias("b"))
)
query("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) x", "lateral_join")(
    lambda t: t.customer.lateralJoin(t.orders.where(C("o_custkey") == C("c_custkey").outer()).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey")).select("c_custkey", "o_orderkey")
)
_CLICK = "(SELECT user_id, event_id, ts FROM events WHERE event_type = 'click')"
query(f"SELECT a.event_id, b.ts AS r_ts, b.value AS r_value FROM {_CLICK} a ASOF LEFT JOIN (SELECT ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ts) b ON a.ts >= b.ts", "asof_backward")(
    lambda t: R.asof_join(
        t.events.filter("event_type = 'click'").select("event_id", "ts"), t.events.filter("event_type = 'purchase'").groupBy("ts").agg(F.max("value").alias("value")), "ts", "ts", [], ["value"]
    ).select("event_id", "r_ts", "r_value")
)
query(f"SELECT a.event_id, b.ts AS r_ts, b.value AS r_value FROM {_CLICK} a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts", "asof_by_key")(
    lambda t: R.asof_join(t.events.filter("event_type = 'click'").select("user_id", "event_id", "ts"), t.events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value")), "ts", "ts", ["user_id"], ["value"]).select("event_id", "r_ts", "r_value")
)
query(
    f"""SELECT event_id, CASE WHEN ok THEN r_ts END AS r_ts, CASE WHEN ok THEN r_value END AS r_value FROM (
    SELECT a.event_id, b.ts AS r_ts, b.value AS r_value, a.ts - b.ts <= INTERVAL 1 HOUR AS ok FROM {_CLICK} a ASOF LEFT JOIN
    (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts)""",
    "temporal_join",
)(lambda t: R.asof_within(t.events.filter("event_type = 'click'").select("user_id", "event_id", "ts"), t.events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value")), "ts", "ts", ["user_id"], ["value"], 3600).select("event_id", "r_ts", "r_value"))
query(
    """SELECT c_custkey, near_s_suppkey, near_s_acctbal FROM (SELECT c_custkey, s_suppkey AS near_s_suppkey, s_acctbal AS near_s_acctbal,
    row_number() OVER (PARTITION BY c_custkey ORDER BY abs(s_acctbal - c_acctbal), s_acctbal, s_suppkey) AS rn FROM customer JOIN supplier ON c_nationkey = s_nationkey) WHERE rn = 1""",
    "nearest_by",
)(lambda t: R.nearest(t.customer.select(C("c_nationkey").alias("n"), "c_custkey", "c_acctbal"), t.supplier.withColumnRenamed("s_nationkey", "n"), "c_acctbal", "s_acctbal", ["n"], "s_suppkey").filter("near_s_suppkey is not null").select("c_custkey", "near_s_suppkey", "near_s_acctbal"))
query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "in_subquery")(
    lambda t: t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'").select(C("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")
)
query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)", "exists_subquery")(
    lambda t: t.supplier.where(t.lineitem.where((C("l_suppkey") == C("s_suppkey").outer()) & (C("l_quantity") > 49)).exists()).select("s_suppkey")
)
query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')", "not_exists")(
    lambda t: t.part.join(t.lineitem.filter("l_returnflag = 'R'"), C("l_partkey") == C("p_partkey"), "left_anti").select("p_partkey")
)
query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", "scalar_subquery")(
    lambda t: t.orders.where(C("o_totalprice") > t.orders.agg(F.avg("o_totalprice") * 1.5).scalar()).select("o_orderkey")
)
query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer", "correlated_scalar")(
    lambda t: t.customer.join(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")), C("c_custkey") == C("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))
)

# --- aggregation --------------------------------------------------------------------------------

def _revenue():
    return C("l_extendedprice") * (1 - C("l_discount"))


query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    "group_by",
)(lambda t: t.lineitem.filter("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity", "sum_qty"), money("l_extendedprice", "sum_base"), money(_revenue(), "sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n")))
query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12", "having")(lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12"))
query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY 1", "distinct_agg")(
    lambda t: t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("s"), F.count_distinct("l_partkey").alias("p"))
)
query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o FROM orders GROUP BY 1", "filter_agg")(
    lambda t: t.orders.groupBy("o_orderpriority").agg(F.count_if(C("o_orderstatus") == "F").alias("f"), money(F.when(C("o_orderstatus") == "O", C("o_totalprice")), "o"))
)
for kind in ("rollup", "cube"):
    query(f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY {kind.upper()} (o_orderstatus, o_orderpriority)", kind)(lambda t, kind=kind: getattr(t.orders, kind)("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")))
query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "grouping_sets")(
    lambda t: t.orders.groupingSets([[C("o_orderstatus")], [C("o_orderpriority")], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
)
query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "grouping_id")(
    lambda t: t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("long").alias("g"), F.count("*").alias("n"))
)
query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1", "pivot")(
    lambda t: t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)
)
query("SELECT s_suppkey, 'bal' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nat', CAST(s_nationkey AS DOUBLE) FROM supplier", "unpivot")(
    lambda t: t.supplier.select("s_suppkey", C("s_acctbal").alias("bal"), C("s_nationkey").cast("double").alias("nat")).unpivot("s_suppkey", ["bal", "nat"], "name", "value")
)
query("SELECT l_orderkey, l_linenumber, 'price' AS name, l_extendedprice AS a, l_discount AS b FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'qty', l_quantity, l_tax FROM lineitem", "unpivot_multi")(
    lambda t: R.unpivot_multi(t.lineitem, ["l_orderkey", "l_linenumber"], {"price": ["l_extendedprice", "l_discount"], "qty": ["l_quantity", "l_tax"]}, ["a", "b"])
)
query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY 1", "string_agg_ordered")(
    lambda t: t.spark.sql("select n_regionkey, listagg(n_name, ';') within group (order by n_name) as names from {n} group by 1", n=t.nation)
)
query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50 FROM lineitem GROUP BY 1", "percentile")(
    lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(F.percentile("l_extendedprice", 0.9), 4).alias("p90"), F.round(F.percentile("l_extendedprice", 0.5), 4).alias("p50"))
)
query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n, true AS near, true AS middle FROM lineitem GROUP BY 1", "approx_count_distinct")(
    # The estimates stand beside the exact values and must be within their error bounds.
    lambda t: t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"), F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.percentile_approx("l_quantity", 0.5, 1000).alias("q"), F.percentile("l_quantity", 0.5).alias("e")).select("l_returnflag", "n", (F.abs(C("a") - C("n")) <= 0.1 * C("n")).alias("near"), (F.abs(C("q") - C("e")) <= 1).alias("middle"))
)
query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1", "bitmap_distinct")(
    lambda t: t.lineitem.groupBy("l_returnflag", F.bitmap_bucket_number("l_suppkey").alias("b")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("l_suppkey"))).alias("c")).groupBy("l_returnflag").agg(F.sum("c").alias("n"))
)
query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n, true AS near FROM lineitem GROUP BY 1", "hll_distinct")(
    lambda t: t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 14)).alias("a")).select("l_returnflag", "n", (F.abs(C("a") - C("n")) <= 0.05 * C("n")).alias("near"))
)
query("SELECT o_orderpriority, min(o_orderkey) AS lo, max(o_orderkey) AS hi, round(stddev_samp(o_totalprice), 4) AS sd, round(var_pop(o_totalprice), 2) AS vp, round(corr(o_totalprice, o_custkey), 8) AS r FROM orders GROUP BY 1", "statistical_agg")(
    lambda t: t.orders.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"), F.round(F.var_pop("o_totalprice"), 2).alias("vp"), F.round(F.corr("o_totalprice", "o_custkey"), 8).alias("r"))
)
query("SELECT l_suppkey, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS k FROM lineitem GROUP BY 1", "max_by")(lambda t: t.lineitem.groupBy("l_suppkey").agg(F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("k")))
query("SELECT width AS bin, count(*) AS n FROM (SELECT CASE WHEN s_acctbal < -1000 THEN 0 WHEN s_acctbal >= 10000 THEN 12 ELSE 1 + CAST(floor((s_acctbal + 1000) / 1000) AS BIGINT) END AS width FROM supplier) GROUP BY 1", "bin_by")(
    lambda t: R.bin_by(t.supplier, "s_acctbal", -1000.0, 10000.0, 11).groupBy("bin").agg(F.count("*").alias("n"))
)

# --- windows ------------------------------------------------------------------------------------

def _by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
for fn in ("row_number", "percent_rank", "cume_dist"):
    cast = (lambda c: F.round(c, 9)) if fn != "row_number" else (lambda c: c.cast("long"))
    query(f"SELECT o_orderkey, {'round(' if fn != 'row_number' else ''}{fn}() {_OVER}{', 9)' if fn != 'row_number' else ''} AS v FROM orders", fn)(lambda t, fn=fn, cast=cast: t.orders.select("o_orderkey", cast(getattr(F, fn)().over(_by_customer())).alias("v")))
for fn in ("rank", "dense_rank"):
    query(f"SELECT l_orderkey, l_quantity, {fn}() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS v FROM lineitem", fn)(
        lambda t, fn=fn: t.lineitem.select("l_orderkey", "l_quantity", getattr(F, fn)().over(Window.partitionBy("l_orderkey").orderBy("l_quantity")).cast("long").alias("v"))
    )
query(f"SELECT o_orderkey, ntile(4) {_OVER} AS v FROM orders", "ntile")(lambda t: t.orders.select("o_orderkey", F.ntile(4).over(_by_customer()).cast("long").alias("v")))
query(f"SELECT o_orderkey, lag(o_totalprice, 1) {_OVER} AS p, lead(o_orderkey, 2, -1) {_OVER} AS n FROM orders", "lag_lead")(
    lambda t: t.orders.select("o_orderkey", F.lag("o_totalprice", 1).over(_by_customer()).alias("p"), F.lead("o_orderkey", 2, -1).over(_by_customer()).alias("n"))
)
_RUN = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
query(f"SELECT o_orderkey, last_value(nullif(o_orderstatus, 'F') IGNORE NULLS) {_RUN} AS l, first_value(nullif(o_orderstatus, 'F') IGNORE NULLS) {_RUN} AS f FROM orders", "first_last_ignore_nulls")(
    lambda t: (lambda w, x: t.orders.select("o_orderkey", F.last(x, True).over(w).alias("l"), F.first(x, True).over(w).alias("f")))(_by_customer().rowsBetween(Window.unboundedPreceding, 0), F.nullif("o_orderstatus", F.lit("F")))
)
query(f"SELECT o_orderkey, nth_value(o_orderkey, 2) {_RUN} AS v FROM orders", "nth_value")(lambda t: t.orders.select("o_orderkey", F.nth_value("o_orderkey", 2).over(_by_customer().rowsBetween(Window.unboundedPreceding, 0)).alias("v")))
query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS v FROM orders", "rows_frame")(
    lambda t: t.orders.select("o_orderkey", F.round(F.avg("o_totalprice").over(_by_customer().rowsBetween(-2, 1)), 4).alias("v"))
)
query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM part", "range_frame")(
    lambda t: t.part.select("p_partkey", F.count("*").over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-3, 3)).alias("v"))
)
query("SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)", "named_window")(
    lambda t: t.spark.sql("select o_orderkey, cast(row_number() over w as bigint) as rn, count(*) over w as n from {o} window w as (partition by o_orderpriority order by o_orderkey)", o=t.orders)
)
query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2", "qualify_topk")(
    lambda t: R.qualify(t.orders, F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")) <= 2).select("o_custkey", "o_orderkey")
)

# --- sort, limit, sets --------------------------------------------------------------------------

query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", "order_limit_offset")(lambda t: t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20).select("o_orderkey", "o_totalprice"))
query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 7", "mysql_limit_pair")(lambda t: t.orders.orderBy("o_orderkey").offset(7).limit(10).select("o_orderkey"))
query("SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10", "top_n")(lambda t: t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey"))
query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 3 OFFSET 2", "fetch_first")(lambda t: t.customer.orderBy("c_acctbal", "c_custkey").offset(2).limit(3).select("c_custkey"))
query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) rn FROM customer) WHERE rn <= 3", "top_k_per_group")(
    lambda t: R.top_k(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), C("c_custkey")], 3).select("c_nationkey", "c_custkey")
)
query("SELECT o_orderkey FROM orders", "sort_within_partitions")(lambda t: t.orders.repartition("o_custkey").sortWithinPartitions("o_custkey", "o_orderkey").select("o_orderkey"))
_SA = "SELECT c_nationkey AS k FROM customer"
_SB = "SELECT s_nationkey AS k FROM supplier"
for key, op, call in (
    ("union_all", "UNION ALL", lambda a, b: a.union(b)), ("union_distinct", "UNION", lambda a, b: a.union(b).distinct()), ("intersect", "INTERSECT", lambda a, b: a.intersect(b)), ("intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b)),
    ("except", "EXCEPT", lambda a, b: a.subtract(b)), ("except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b)),
):
    query(f"{_SA} {op} {_SB}", key)(lambda t, call=call: call(t.customer.select(C("c_nationkey").alias("k")), t.supplier.select(C("s_nationkey").alias("k"))))
query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey > 10)", "set_precedence")(
    lambda t: t.nation.filter("n_nationkey < 5").select(C("n_nationkey").alias("k")).union(t.customer.select("c_nationkey").intersect(t.supplier.filter("s_nationkey > 10").select("s_nationkey"))).distinct()
)
query("SELECT s_suppkey, s_name, NULL::INTEGER AS x FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer", "union_by_name")(
    lambda t: t.supplier.select("s_suppkey", "s_name").unionByName(t.customer.select(C("c_custkey").alias("s_suppkey"), C("c_nationkey").alias("x"), C("c_name").alias("s_name")), allowMissingColumns=True)
)

# --- recursion ----------------------------------------------------------------------------------

query("WITH RECURSIVE r(n, f) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r", "recursive_cte")(
    lambda t: t.spark.sql("with recursive r(n, f) as (select 1L, 1L union all select n + 1, f * (n + 1) from r where n < 12) select n, f from r")
)
query("WITH RECURSIVE h AS (SELECT p_partkey, 1::BIGINT AS level FROM part WHERE p_partkey <= 3 UNION ALL SELECT p.p_partkey, h.level + 1 FROM part p JOIN h ON p.p_partkey // 4 = h.p_partkey AND p.p_partkey > 3) SELECT p_partkey, level FROM h", "connect_by")(
    lambda t: R.connect_by(t.part.select("p_partkey", F.when(C("p_partkey") > 3, F.floor(C("p_partkey") / 4).cast("long")).alias("up")), "p_partkey", "up", C("p_partkey") <= 3).select("p_partkey", long("level").alias("level"))
)

# --- scalar functions ---------------------------------------------------------------------------

query(
    """SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, substring(p_name, 2, 3) AS s, p_brand || '/' || p_type AS c, replace(p_name, 'a', 'o') AS r, trim('  x ') AS t,
    CAST(strpos(p_name, 'e') AS INTEGER) AS pos, lpad(CAST(p_size AS VARCHAR), 4, '0') AS pad, reverse(p_brand) AS rev, split_part(p_brand, '#', 2) AS part, concat_ws('-', p_brand, p_name) AS ws, regexp_replace(p_name, '[aeiou]', '', 'g') AS rx FROM part""",
    "string_fns",
)(
    lambda t: t.part.select(
        "p_partkey", F.upper("p_name").alias("u"), F.lower("p_brand").alias("l"), F.length("p_name").cast("long").alias("n"), F.substring("p_name", 2, 3).alias("s"), F.concat("p_brand", F.lit("/"), "p_type").alias("c"), F.regexp_replace("p_name", "a", "o").alias("r"), F.trim(F.lit("  x ")).alias("t"),
        F.locate("e", "p_name").alias("pos"), F.lpad(C("p_size").cast("string"), 4, "0").alias("pad"), F.reverse("p_brand").alias("rev"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("part"), F.concat_ws("-", "p_brand", "p_name").alias("ws"), F.regexp_replace("p_name", "[aeiou]", "").alias("rx"),
    )
)
query(
    """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, date_trunc('month', o_orderdate)::TIMESTAMP AS mo, o_orderdate + INTERVAL 10 DAY AS plus, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days, strftime(o_orderdate, '%Y%m%d') AS f FROM orders""",
    "date_fns",
)(
    lambda t: t.orders.select(
        "o_orderkey", long(F.year("o_orderdate")).alias("y"), long(F.month("o_orderdate")).alias("m"), long(F.day("o_orderdate")).alias("d"), long(F.quarter("o_orderdate")).alias("q"), F.date_trunc("month", "o_orderdate").cast(t.orders.schema["o_orderdate"].dataType).alias("mo"), F.expr("o_orderdate + interval 10 days").alias("plus"),
        long(F.datediff("o_orderdate", F.lit("1992-01-01"))).alias("days"), F.date_format("o_orderdate", "yyyyMMdd").alias("f"),
    )
)
query("SELECT p_partkey, p_size % 7 AS m, p_size // 3 AS d, p_size & 6 AS a, p_size | 9 AS o, xor(p_size, 5) AS x, p_size << 2 AS l, p_size >> 1 AS r, abs(-p_size) AS ab, round(sqrt(p_size), 6) AS sq, round(power(p_size, 2), 2) AS pw, CAST(ceil(p_retailprice) AS BIGINT) AS ce, round(p_retailprice, 1) AS ro, greatest(p_size, 20) AS g FROM part", "math_bit_fns")(
    lambda t: t.part.select(
        "p_partkey", (C("p_size") % 7).alias("m"), F.expr("cast(p_size div 3 as int)").alias("d"), C("p_size").bitwiseAND(6).alias("a"), C("p_size").bitwiseOR(9).alias("o"), C("p_size").bitwiseXOR(5).alias("x"), F.shiftleft("p_size", 2).alias("l"), F.shiftright("p_size", 1).alias("r"), F.abs(-C("p_size")).alias("ab"),
        F.round(F.sqrt("p_size"), 6).alias("sq"), F.round(F.pow("p_size", F.lit(2)), 2).alias("pw"), F.ceil("p_retailprice").alias("ce"), F.round("p_retailprice", 1).alias("ro"), F.greatest("p_size", F.lit(20)).alias("g"),
    )
)
query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events", "json_value")(
    lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").alias("none"))
)
query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "variant_path")(lambda t: t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k")))
query("SELECT event_id, x, y FROM (SELECT event_id, unnest([{'x': CAST(json_extract(props, '$.k') AS BIGINT), 'y': event_type}, {'x': event_id, 'y': 'b'}], recursive := true) FROM events)", "json_table")(
    lambda t: R.json_table(t.events.select("event_id", F.format_string('{"r":[{"x":%s,"y":"%s"},{"x":%d,"y":"b"}]}', F.get_json_object("props", "$.k"), "event_type", "event_id").alias("j")), "j", "$.r", {"x": "bigint", "y": "string"}).select("event_id", "x", "y")
)
query("SELECT vec_id, len(embedding) AS n, round(embedding[1], 6) AS first, round(list_max(embedding), 6) AS hi, list_contains(embedding, 2.0::FLOAT) AS has FROM embeddings", "array_fns")(
    lambda t: t.embeddings.select("vec_id", long(F.size("embedding")).alias("n"), F.round(C("embedding")[0], 6).alias("first"), F.round(F.array_max("embedding"), 6).alias("hi"), F.array_contains("embedding", 2.0).alias("has"))
)
query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2)), 6) AS s, len(list_filter(embedding, lambda x: x > 0)) AS pos FROM embeddings", "lambda_transform")(
    lambda t: t.embeddings.select("vec_id", F.round(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * 2), F.lit(0.0), lambda a, x: a + x), 6).alias("s"), long(F.size(F.filter("embedding", lambda x: x > 0))).alias("pos"))
)
query("SELECT vec_id, round(unnest(embedding), 6) AS v FROM embeddings", "explode")(lambda t: t.embeddings.select("vec_id", F.explode("embedding").alias("v")).select("vec_id", F.round("v", 6).alias("v")))
query("SELECT vec_id, CAST(unnest(range(len(embedding))) AS BIGINT) AS pos, round(unnest(embedding), 6) AS v FROM embeddings", "posexplode")(
    lambda t: t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", long("pos").alias("pos"), F.round("v", 6).alias("v"))
)
query("SELECT vec_id, CAST(o AS BIGINT) AS o, round(v, 6) AS v FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS o, unnest(embedding) AS v FROM embeddings)", "unnest_with_ordinality")(
    lambda t: t.embeddings.select("vec_id", F.posexplode("embedding").alias("o", "v")).select("vec_id", long(C("o") + 1).alias("o"), F.round("v", 6).alias("v"))
)
query("SELECT n_nationkey, n_name AS a, n_regionkey AS b, n_name AS v FROM nation", "map_struct_fns")(
    lambda t: t.nation.select("n_nationkey", F.struct("n_name", "n_regionkey").alias("s"), F.create_map(F.lit("k"), "n_name").alias("m")).select("n_nationkey", C("s.n_name").alias("a"), C("s.n_regionkey").alias("b"), C("m")["k"].alias("v"))
)
query("SELECT n_nationkey, name, value FROM (SELECT n_nationkey, unnest(['a', 'b']) AS name, unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS value FROM nation)", "multi_alias_stack")(
    lambda t: t.nation.select("n_nationkey", F.stack(F.lit(2), F.lit("a"), C("n_name"), F.lit("b"), C("n_regionkey").cast("string")).alias("name", "value"))
)

# --- time windows -------------------------------------------------------------------------------

query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1", "tumble")(
    lambda t: t.events.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"), money("value", "v")).select(C("window.start").alias("w"), "n", "v")
)
query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - CAST(o AS INTEGER) * INTERVAL 30 MINUTE AS w, count(*) AS n FROM events, range(2) r(o) GROUP BY 1", "hop")(
    lambda t: t.events.groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n")).select(C("window.start").alias("w"), "n")
)
query(
    """SELECT user_id, min(ts) AS s, count(*) AS n FROM (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM
    (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events)) GROUP BY user_id, g""",
    "session",
)(lambda t: R.sessions(t.events.select("user_id", C("ts").cast("timestamp").alias("ts")), "user_id", "ts", 7200).groupBy("user_id", "session").agg(F.min("ts").alias("s"), F.count("*").alias("n")).select("user_id", "s", "n"))
ORACLE["session_window"] = ORACLE["session"].replace("> INTERVAL 2 HOUR", ">= INTERVAL 2 HOUR")
query(ORACLE["session_window"], "session_window")(lambda t: t.events.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n")).select("user_id", C("session_window.start").alias("s"), "n"))

# --- DML as rewrites ----------------------------------------------------------------------------

query("SELECT s_suppkey, s_name, CASE WHEN s_nationkey = 3 THEN 0 ELSE s_nationkey END AS s_nationkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier", "update_set")(
    lambda t: R.update_where(t.supplier, C("s_nationkey") == 3, {"s_nationkey": F.lit(0), "s_acctbal": C("s_acctbal") + 1})
)
query("SELECT c_custkey, coalesce(o.p, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS p FROM orders GROUP BY 1) o ON c_custkey = o_custkey", "update_from_join")(
    lambda t: R.update_from(t.customer.select("c_custkey", "c_acctbal"), t.orders.groupBy(C("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("p")), "c_custkey", {"c_acctbal": "p"})
)
query("SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)", "delete_where")(lambda t: R.delete_where(t.orders, F.nullif("o_orderstatus", F.lit("P")) == "F").select("o_orderkey"))
query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)", "delete_using")(
    lambda t: R.delete_using(t.customer, t.orders.filter("o_totalprice > 250000").select(C("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")
)
_SRC = "SELECT s_suppkey + 50 AS s_suppkey, s_name || '!' AS s_name, s_nationkey, s_acctbal * 2 AS s_acctbal FROM supplier"
_src = lambda t: t.supplier.select((C("s_suppkey") + 50).alias("s_suppkey"), F.concat("s_name", F.lit("!")).alias("s_name"), "s_nationkey", (C("s_acctbal") * 2).alias("s_acctbal"))
query(
    f"""SELECT coalesce(t.s_suppkey, s.s_suppkey) AS s_suppkey, CASE WHEN t.s_suppkey IS NULL THEN s.s_name WHEN s.s_suppkey IS NULL OR s.s_acctbal < 0 THEN t.s_name ELSE s.s_name END AS s_name
    FROM supplier t FULL JOIN ({_SRC}) s ON t.s_suppkey = s.s_suppkey WHERE NOT coalesce(t.s_suppkey IS NOT NULL AND s.s_suppkey IS NOT NULL AND s.s_nationkey = 7, false)""",
    "merge_full",
)(lambda t: R.merge(t.supplier.select("s_suppkey", "s_name"), _src(t), "s_suppkey", update={"s_name": C("s_s_name")}, update_if=C("s_s_acctbal") >= 0, delete_if=C("s_s_nationkey") == 7, insert={"s_name": C("s_s_name")}))
query(f"SELECT s_suppkey, coalesce(s.s_name, t.s_name) AS s_name, CASE WHEN t.s_suppkey IS NULL THEN s.s_acctbal ELSE t.s_acctbal END AS s_acctbal FROM (SELECT * FROM supplier) t FULL JOIN ({_SRC}) s USING (s_suppkey)", "upsert_on_conflict")(
    lambda t: R.upsert(t.supplier, _src(t), ["s_suppkey"], ["s_name"]).select("s_suppkey", "s_name", "s_acctbal")
)
query(f"SELECT * FROM ({_SRC}) UNION ALL SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ({_SRC}))", "replace_into")(lambda t: R.upsert(t.supplier, _src(t), ["s_suppkey"]))
query("SELECT 'big' AS target, o_orderkey AS k FROM orders WHERE o_totalprice > 150000 UNION ALL SELECT 'open', o_orderkey FROM orders WHERE o_orderstatus = 'O'", "insert_all_multi")(
    lambda t: R.multi_insert(t.orders, {"big": (C("o_totalprice") > 150000, {"k": C("o_orderkey")}), "open": (C("o_orderstatus") == "O", {"k": C("o_orderkey")})})
)
query("SELECT CASE WHEN o_totalprice > 150000 THEN 'big' ELSE 'open' END AS target, o_orderkey AS k FROM orders WHERE o_totalprice > 150000 OR o_orderstatus = 'O'", "insert_first")(
    lambda t: R.multi_insert(t.orders, {"big": (C("o_totalprice") > 150000, {"k": C("o_orderkey")}), "open": (C("o_orderstatus") == "O", {"k": C("o_orderkey")})}, first=True)
)
query("SELECT 'ids' AS target, CAST(n_nationkey AS VARCHAR) AS v FROM nation UNION ALL SELECT 'names', n_name FROM nation", "multi_insert")(
    lambda t: R.multi_insert(t.nation, {"ids": (F.lit(True), {"v": C("n_nationkey").cast("string")}), "names": (F.lit(True), {"v": C("n_name")})})
)
query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey NOT IN (1, 2) UNION ALL SELECT n_nationkey + 100, n_regionkey FROM nation WHERE n_regionkey IN (1, 2)", "insert_overwrite_partition")(
    lambda t: R.overwrite_partitions(t.nation.select("n_nationkey", "n_regionkey"), t.nation.filter("n_regionkey in (1, 2)").select((C("n_nationkey") + 100).alias("n_nationkey"), "n_regionkey"), ["n_regionkey"])
)
query("SELECT n_nationkey, 'delete' AS change FROM nation WHERE n_regionkey = 4 UNION ALL SELECT n_nationkey + 1000, 'insert' FROM nation WHERE n_regionkey = 4", "changes_feed")(
    lambda t: R.changes(t.nation.select("n_nationkey"), t.nation.select(F.when(C("n_regionkey") == 4, C("n_nationkey") + 1000).otherwise(C("n_nationkey")).alias("n_nationkey")))
)
query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 25)", "delete_order_limit")(
    lambda t: R.delete_using(t.orders, t.orders.filter("o_orderstatus = 'F'").orderBy("o_totalprice", "o_orderkey").limit(25), "o_orderkey").select("o_orderkey")
)

query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", "join_hint")(lambda t: t.customer.join(t.nation.hint("broadcast"), C("c_nationkey") == C("n_nationkey")).select("c_custkey", "n_name"))  # 25 rows at any scale
query("SELECT * FROM (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 2) UNION ALL SELECT n_nationkey + 500, n_regionkey FROM nation WHERE n_regionkey = 3", "insert_replace_where")(
    lambda t: R.replace_where(t.nation.select("n_nationkey", "n_regionkey"), C("n_regionkey") == 2, t.nation.filter("n_regionkey = 3").select((C("n_nationkey") + 500).alias("n_nationkey"), "n_regionkey"))
)
query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey % 5 = 0", "insert_replace_using")(
    lambda t: R.replace_using(t.supplier.select("s_suppkey", "s_name"), t.supplier.filter("s_suppkey % 5 = 0").select("s_suppkey", F.lit("new").alias("s_name")), ["s_suppkey"])
)
query("SELECT n_nationkey, 'x' AS n_name FROM nation WHERE n_regionkey = 1", "returning")(lambda t: R.returning(R.updated(t.nation, C("n_regionkey") == 1, {"n_name": F.lit("x")}), "n_nationkey", "n_name"))
query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 2", "time_travel")(lambda t: R.snapshot(t.nation.select("n_nationkey", "n_regionkey"), "n_regionkey", 2).select("n_nationkey", "n_regionkey"))
query("SELECT o_orderstatus, CAST(o_orderkey AS BIGINT) AS k FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= ceil((SELECT count(*) FROM orders) * 0.015)", "top_percent_rows")(lambda t: R.top_percent(t.orders, [C("o_orderkey")], 1.5).select("o_orderstatus", C("o_orderkey").alias("k")))
query("SELECT o_orderkey, k FROM (SELECT o_orderkey, o_custkey // 100 AS k FROM orders) WHERE k IN (1, 3)", "lateral_alias")(lambda t: t.spark.sql("select o_orderkey, o_custkey div 100 as k from {o} where o_custkey div 100 in (1, 3)", o=t.orders))
query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, any_value(c_mktsegment) AS a, bool_and(c_acctbal > -2000) AS every, bit_or(c_nationkey) AS bits FROM customer GROUP BY 1", "any_every_bits")(
    lambda t: t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.any_value("c_mktsegment").alias("a"), F.every(C("c_acctbal") > -2000).alias("every"), F.bit_or("c_nationkey").alias("bits"))
)
query("SELECT o_orderkey, overlay AS o, pos AS p FROM (SELECT o_orderkey, substr(o_orderpriority, 1, 2) || 'XX' || substr(o_orderpriority, 5) AS overlay, CAST(strpos(o_orderpriority, '-') AS INTEGER) AS pos FROM orders)", "overlay_position")(
    lambda t: t.spark.sql("select o_orderkey, overlay(o_orderpriority placing 'XX' from 3 for 2) as o, position('-' in o_orderpriority) as p from {o}", o=t.orders)
)
query("SELECT o_orderkey, date_diff('month', TIMESTAMP '1992-01-01', o_orderdate) - 0 AS m, CAST(extract(dow FROM o_orderdate) AS BIGINT) AS d FROM (SELECT o_orderkey, date_trunc('month', o_orderdate) AS o_orderdate FROM orders)", "timestamp_diff")(
    lambda t: t.orders.select("o_orderkey", F.date_trunc("month", "o_orderdate").alias("x")).select("o_orderkey", F.timestamp_diff("MONTH", F.expr("timestamp '1992-01-01'"), "x").alias("m"), (F.dayofweek("x") - 1).cast("long").alias("d"))
)


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1")
def streaming_aggregate(t: Tables) -> DataFrame:
    """The events as a stream, read to its end; the last state of the aggregate is the result."""
    stream = _events_stream(t).groupBy("user_id").agg(F.count("*").alias("n"), money("value", "v"))
    return streams.run_to_files(stream, shared_dir(t.spark), "complete")


def _events_stream(t: Tables) -> DataFrame:
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)


# --- pipes and user functions -------------------------------------------------------------------

query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1", "pipe_chain")(lambda t: t.spark.sql("from {n} |> where n_nationkey > 3 |> aggregate count(*) as n group by n_regionkey", n=t.nation))


@query("SELECT s_suppkey, s_acctbal * 2 + 1 AS v FROM supplier")
def udf_scalar(t: Tables) -> DataFrame:
    @F.arrow_udf("double")
    def twice(x: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        return pc.add(pc.multiply(x, 2.0), 1.0)

    return t.supplier.select("s_suppkey", twice("s_acctbal").alias("v"))


@query("SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) AS spread FROM customer GROUP BY 1")
def udaf(t: Tables) -> DataFrame:
    import pandas as pd

    spread = F.pandas_udf(_spread(pd), "double")
    return t.customer.groupBy("c_nationkey").agg(F.round(spread("c_acctbal"), 4).alias("spread"))


def _spread(pd):
    def f(x):
        return float(x.max() - x.min())

    f.__annotations__ = {"x": pd.Series, "return": float}  # as objects, which the type check reads
    return f


@query("SELECT n_nationkey, CAST(unnest(range(n_regionkey)) AS INTEGER) AS i FROM nation")
def udtf(t: Tables) -> DataFrame:
    @F.udtf(returnType="i int")
    class Count:
        def eval(self, n: int) -> Iterator[tuple[int]]:
            for i in range(n):
                yield (i,)

    t.spark.udtf.register("count_up", Count)
    return t.spark.sql("select n_nationkey, i from {n}, lateral count_up(n_regionkey)", n=t.nation)


@query("SELECT n_nationkey, upper(n_name) AS name FROM nation")
def transform_script(t: Tables) -> DataFrame:
    def shout(frames):
        for f in frames:
            f["name"] = f["n_name"].str.upper()
            yield f[["n_nationkey", "name"]]

    return t.nation.select("n_nationkey", "n_name").mapInPandas(shout, "n_nationkey int, name string")


# --- written and read back ----------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def insert_directory(t: Tables) -> DataFrame:
    path = f"{shared_dir(t.spark)}/{uuid4().hex}"
    corpus.copy_to(t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice")), path, "parquet")
    return t.spark.read.parquet(path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def load_data(t: Tables) -> DataFrame:
    """COPY TO a file, then LOAD DATA of it into a table, twice: loading appends."""
    root = f"{shared_dir(t.spark)}/{uuid4().hex}"
    corpus.copy_to(t.nation, f"{root}/csv", header="true")
    for _ in range(2):
        corpus.load_data(t.spark, f"{root}/csv", "n_nationkey int, n_name string, n_regionkey int", f"{root}/table", header="true")
    return t.spark.read.parquet(f"{root}/table")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def copy_round_trip(t: Tables) -> DataFrame:
    path = f"{shared_dir(t.spark)}/{uuid4().hex}"
    corpus.copy_to(t.customer.select("c_custkey", "c_name", "c_mktsegment"), path, "json")
    return t.spark.read.schema("c_custkey long, c_name string, c_mktsegment string").json(path)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def create_table_as(t: Tables) -> DataFrame:
    name = f"made_{uuid4().hex}"
    corpus.create_table_as(t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")), name, partition_by=("o_orderstatus",))
    return t.spark.table(name).select("o_orderpriority", "o_orderstatus", "n")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'new' ELSE s_name END AS s_name, s_nationkey FROM supplier")
def insert_overwrite_table(t: Tables) -> DataFrame:
    """SELECT INTO a partitioned table, then INSERT OVERWRITE of one partition, by name."""
    name = f"made_{uuid4().hex}"
    corpus.create_table_as(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), name, partition_by=("s_nationkey",))
    corpus.insert(t.supplier.filter("s_nationkey = 3").select("s_nationkey", F.lit("new").alias("s_name"), "s_suppkey"), name, overwrite=True)
    return t.spark.table(name).select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT max(o_orderkey) AS hi FROM orders")
def select_into_variable(t: Tables) -> DataFrame:
    """SELECT ... INTO @var: a session variable of the query's one value."""
    name = f"v_{uuid4().hex}"
    t.orders.createOrReplaceTempView(name)
    t.spark.sql(f"declare or replace variable {name} bigint")
    t.spark.sql(f"set var {name} = (select max(o_orderkey) from {name})")
    return t.spark.sql(f"select {name} as hi")


@query("SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_watermark_window(t: Tables) -> DataFrame:
    w = streams.tumble(_events_stream(t).withColumn("ts", C("ts").cast("timestamp")), "ts", "1 hour", "40 days", ["user_id"], F.count("*").alias("n"))
    return streams.run_to_files(w, shared_dir(t.spark), "complete").select("user_id", C("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def auto_cdc(t: Tables) -> DataFrame:
    """The latest change of each key, written by every batch."""
    root = f"{shared_dir(t.spark)}/{uuid4().hex}"
    stream = _events_stream(t).select("user_id", "event_id", "event_type")
    streams.auto_cdc(stream, ["user_id"], "event_id", lambda df, epoch: df.write.mode("append").parquet(f"{root}/out"), f"{root}/state").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("user_id", "event_id", "event_type")


@query("SELECT event_id, c_name FROM events LEFT JOIN customer ON c_custkey = user_id")
def stream_lookup_join(t: Tables) -> DataFrame:
    """Temporal join of a stream with the table as each batch sees it."""
    joined = streams.lookup_join(_events_stream(t), t.customer.select(C("c_custkey").alias("user_id"), "c_name"), ["user_id"])
    return streams.run_to_files(joined.select("event_id", "c_name"), shared_dir(t.spark), "append")


@query("SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_interval_join(t: Tables) -> DataFrame:
    a = _events_stream(t).filter("event_type = 'click'").select("user_id", "event_id", C("ts").cast("timestamp").alias("lt"))
    b = _events_stream(t).filter("event_type = 'purchase'").select("user_id", "event_id", C("ts").cast("timestamp").alias("rt"))
    both = streams.interval_join(a, b, "user_id", "lt", "rt", "40 days", "1 hour").select(C("a.event_id").alias("click"), C("b.event_id").alias("purchase"))
    return streams.run_to_files(both, shared_dir(t.spark), "append")


@query("SELECT DISTINCT user_id FROM events")
def stream_distinct(t: Tables) -> DataFrame:
    rows = _events_stream(t).select("user_id", C("ts").cast("timestamp").alias("ts"))
    return streams.run_to_files(streams.distinct_within(rows, "ts", "40 days", ["user_id"]).select("user_id"), shared_dir(t.spark), "append")
