"""Relational operators that have no single DataFrame call: as-of and nearest joins, QUALIFY, DML on
plain tables, hierarchical queries, change feeds and table functions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import FOLD, cut


#: Ranges of a sorted number that a key's rows are dealt to, for each shuffle partition.
RANGES = 2


def ranges(column: str, *frames: DataFrame, n: int | None = None) -> list:
    """At most n - 1 bounds (as doubles) that cut the column's values of all frames into ranges of like size."""
    n = n or RANGES * int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = reduce(DataFrame.unionByName, [f.select(_number(f, column).alias("x")) for f in frames])
    at = both.agg(F.percentile_approx("x", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(10 * n))).first()[0] if n > 1 else None
    return sorted({x for x in at or [] if x is not None})


def _number(df: DataFrame, column: str) -> Column:
    """Dates and times as seconds."""
    kind = dict(df.dtypes)[column]
    c = F.unix_micros(F.col(column).cast("timestamp")) / 1e6 if kind.startswith(("timestamp", "date")) else F.col(column)
    return c.cast("double")


def _range_of(number: Column, bounds: list) -> Column:
    """Number of the range a number falls into; nulls fall into the first."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= number)), F.lit(0))


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str], values: Sequence[str], prefix: str = "r_", spread: bool | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its `by` key at or before it.

    One union and one running window: both sides are shuffled once and no pairs are made. A left row without
    a match keeps nulls; of right rows at one time the greatest values win. With `spread` (by default where
    `by` is empty) a key's rows are dealt to ranges of time, so that no task has a whole key: the last right
    row of each range, one small row for a range and key, is carried over to the ranges after it."""
    n = "__asof"
    spread = not by if spread is None else spread
    bounds = ranges("x", left.select(F.col(left_on).alias("x")), right.select(F.col(right_on).alias("x"))) if spread else []
    cols = left.columns
    a = left.select(*by, F.col(left_on).alias(f"{n}_t"), _range_of(_number(left, left_on), bounds).alias(f"{n}_g"), F.lit(1).alias(f"{n}_s"), F.struct(*cols).alias(f"{n}_l"), F.lit(None).cast(right.select(F.struct(right_on, *values).alias("v")).schema["v"].dataType).alias(f"{n}_r"))
    b = right.filter(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias(f"{n}_t"), _range_of(_number(right, right_on), bounds).alias(f"{n}_g"), F.lit(0).alias(f"{n}_s"), F.lit(None).cast(a.schema[f"{n}_l"].dataType).alias(f"{n}_l"), F.struct(right_on, *values).alias(f"{n}_r"))
    w = Window.partitionBy(*by, f"{n}_g").orderBy(f"{n}_t", f"{n}_s", F.col(f"{n}_r")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(f"{n}_m", F.last(f"{n}_r", ignorenulls=True).over(w)).filter(F.col(f"{n}_s") == 1)
    if bounds:
        lasts = b.groupBy(*by, f"{n}_g").agg(F.max(f"{n}_r").alias(f"{n}_r"))
        every = lasts.select(*by).distinct().withColumn(f"{n}_g", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))))
        order = Window.partitionBy(*by).orderBy(f"{n}_g").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.join(lasts, [*by, f"{n}_g"], "left").withColumn(f"{n}_c", F.last(f"{n}_r", ignorenulls=True).over(order)).drop(f"{n}_r")
        both = both.join(carried, [*by, f"{n}_g"], "left").withColumn(f"{n}_m", F.when(F.col(f"{n}_t").isNotNull(), F.coalesce(f"{n}_m", f"{n}_c")))
    return both.select(f"{n}_l.*", *[F.col(f"{n}_m.{c}").alias(prefix + c) for c in (right_on, *values)])


def asof_within(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str], values: Sequence[str], seconds: int) -> DataFrame:
    """asof_join, with nulls where the match is older than `seconds`."""
    out = asof_join(left, right, left_on, right_on, by, values)
    fresh = F.unix_micros(F.col(left_on).cast("timestamp")) - F.unix_micros(F.col(f"r_{right_on}").cast("timestamp")) <= seconds * 1_000_000
    return out.withColumns({f"r_{c}": F.when(fresh, F.col(f"r_{c}")) for c in (right_on, *values)})


def nearest(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str], key: str, spread: bool = True) -> DataFrame:
    """NEAREST BY: for each left row the right row of its key that is nearest on one number; ties go to
    the lower right value. The candidates are the neighbours on either side in one sorted union. With `spread`
    a key's rows are dealt to ranges of the number; the nearest right rows of other ranges come from a table
    with the least and greatest right row of each range and key."""
    n = "__near"
    bounds = ranges("x", left.select(F.col(left_on).alias("x")), right.select(F.col(right_on).alias("x"))) if spread else []
    g = _range_of(F.col(f"{n}_x"), bounds).alias(f"{n}_g")
    a = left.select(*by, F.col(left_on).cast("double").alias(f"{n}_x"), F.struct(*left.columns).alias(f"{n}_l"), F.lit(None).cast("double").alias(f"{n}_v"), F.lit(None).cast(right.schema[key].dataType).alias(f"{n}_k"), F.lit(1).alias(f"{n}_s"))
    b = right.filter(F.col(right_on).isNotNull()).groupBy(*by, F.col(right_on).cast("double").alias(f"{n}_v")).agg(F.min(key).alias(f"{n}_k"))
    b = b.select(*by, F.col(f"{n}_v").alias(f"{n}_x"), F.lit(None).cast(a.schema[f"{n}_l"].dataType).alias(f"{n}_l"), f"{n}_v", f"{n}_k", F.lit(0).alias(f"{n}_s"))
    order = Window.partitionBy(*by, f"{n}_g").orderBy(f"{n}_x", f"{n}_s")
    pair = F.when(F.col(f"{n}_s") == 0, F.struct(f"{n}_v", f"{n}_k"))
    below = F.last(pair, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(pair, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    out = a.unionByName(b).withColumn(f"{n}_g", g).withColumns({f"{n}_b": below, f"{n}_a": above}).filter(F.col(f"{n}_s") == 1)
    if bounds:
        ends = b.withColumn(f"{n}_g", g).groupBy(*by, f"{n}_g").agg(F.max(F.struct(f"{n}_v", f"{n}_k")).alias("hi"), F.min(F.struct(f"{n}_v", f"{n}_k")).alias("lo"))
        every = ends.select(*by).distinct().withColumn(f"{n}_g", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))))
        w = Window.partitionBy(*by).orderBy(f"{n}_g")
        carried = every.join(ends, [*by, f"{n}_g"], "left").select(
            *by, f"{n}_g", F.last("hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{n}_cb"), F.first("lo", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias(f"{n}_ca")
        )
        out = out.join(carried, [*by, f"{n}_g"], "left").withColumns({f"{n}_b": F.coalesce(f"{n}_b", f"{n}_cb"), f"{n}_a": F.coalesce(f"{n}_a", f"{n}_ca")})
    gap = lambda c: F.abs(F.col(f"{c}.{n}_v") - F.col(f"{n}_x"))
    low = F.col(f"{n}_a").isNull() | (gap(f"{n}_b") <= gap(f"{n}_a"))
    best = F.when(F.col(f"{n}_b").isNotNull() & low, F.col(f"{n}_b")).otherwise(F.col(f"{n}_a"))
    best = F.when(F.col(f"{n}_x").isNotNull(), best)
    return out.withColumn(f"{n}_m", best).select(f"{n}_l.*", F.col(f"{n}_m.{n}_k").alias(f"near_{key}"), F.col(f"{n}_m.{n}_v").alias(f"near_{right_on}"))


#: Buckets that an interval covers at most, less one.
WIDE = 8


def range_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """left rows whose `at` lies in [low, high] of a right row. Intervals are dealt to buckets, which turns
    the range condition into an equi join plus a filter. Buckets are `width` wide at level 0 and WIDE times
    wider at each level after it; an interval takes the least level at which it covers few of them, and a left
    row looks into its bucket of each level that occurs."""
    span = F.col(high) - F.col(low)
    level = F.greatest(F.lit(0), F.ceil(F.log(float(WIDE), F.greatest(span / width, F.lit(1.0)) / WIDE))).cast("int")
    bucket = lambda c, lv: F.floor(F.col(c) / (F.lit(width) * F.pow(F.lit(float(WIDE)), lv))).cast("long")
    sized = right.filter(F.col(low) <= F.col(high)).withColumn("__v", level)
    levels = sorted(r[0] for r in sized.select("__v").distinct().collect())  # the logarithm of the widest interval
    dealt = sized.withColumn("__b", F.explode(F.sequence(bucket(low, F.col("__v")), bucket(high, F.col("__v")))))
    looking = left.withColumn("__v", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__b", bucket(at, F.col("__v")))
    return looking.join(dealt, ["__v", "__b"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("__v", "__b")


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """QUALIFY: filter on a window expression, which does not stay in the result."""
    return df.withColumn("__q", condition).filter("__q").drop("__q")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return qualify(df, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= k)


def unpivot_multi(df: DataFrame, keys: Sequence[str], sets: dict[str, Sequence[str]], names: Sequence[str], label: str = "name", nulls: bool = False) -> DataFrame:
    """UNPIVOT of column sets: {label value: columns} become rows with the columns `names`."""
    rows = F.array(*[F.struct(F.lit(k).alias(label), *[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)]) for k, cols in sets.items()])
    out = df.select(*keys, F.explode(rows).alias("__r")).select(*keys, "__r.*")
    return out if nulls else out.filter(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names]))


# --- DML on plain tables: each returns the table's new content ----------------------------------


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(t).alias(c) if c in values else F.col(c) for c, t in table.dtypes])


def _counted(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """source with __n, the rows that share its keys; the window takes the join's own exchange."""
    return source.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))


def _once(n: Column, value: Column) -> Column:
    """value, or an error where a target row meets several source rows: which one wins would be chance."""
    return F.when(n > 1, F.raise_error(F.lit("several source rows for one target row"))).otherwise(value)


def update_from(table: DataFrame, source: DataFrame, on: str, values: dict[str, str]) -> DataFrame:
    """UPDATE ... FROM: values of matching source rows. A target row that several source rows match is an error."""
    s = _counted(source.select(F.col(on), *[F.col(v).alias(f"__{c}") for c, v in values.items()]), [on])
    out = table.join(s, on, "left")
    return out.select(*[F.when(F.col("__n").isNotNull(), _once(F.col("__n"), F.col(f"__{c}"))).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def updated(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """The rows that update_where() writes, as they are after it, whether or not a value changes."""
    return update_where(table.filter(F.coalesce(condition, F.lit(False))), F.lit(True), values)


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.filter(~F.coalesce(condition, F.lit(False)))


def delete_using(table: DataFrame, source: DataFrame, on: str) -> DataFrame:
    return table.join(source.select(on), on, "left_anti")


def upsert(table: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """ON CONFLICT DO UPDATE, or REPLACE INTO with update=None (every column from the source). Source rows that
    share a key that is not null are an error."""
    cols = table.columns
    update = [c for c in cols if c not in keys] if update is None else update
    t = table.select(*keys, F.struct(*cols).alias("__t"))
    s = _counted(source.select(*keys, F.struct(*cols).alias("__s")), keys)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    s = s.select(*keys, _once(F.when(known, F.col("__n")), F.col("__s")).alias("__s"))
    both = t.join(s, list(keys), "full_outer")
    pick = lambda c: F.when(F.col("__t").isNull(), F.col(f"__s.{c}")).when(F.col("__s").isNull() | F.lit(c not in update), F.col(f"__t.{c}")).otherwise(F.col(f"__s.{c}"))
    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in cols])


def merge(table: DataFrame, source: DataFrame, on: str, *, update: dict[str, Column] | None = None, update_if: Column | None = None, delete_if: Column | None = None, insert: dict[str, Column] | None = None, delete_missing: Column | None = None) -> DataFrame:
    """MERGE as one full outer join. Conditions and values may use columns of the table as they are and
    those of the source as s_<name>; delete_missing applies to rows without a source row. A target row that
    several source rows match is an error."""
    s = _counted(source.select(F.col(on), *[F.col(c).alias(f"s_{c}") for c in source.columns]), [on])
    s = s.withColumn("__s", F.lit(True))
    t = table.withColumn("__t", F.lit(True))
    both = t.join(s, on, "full_outer")
    matched, new, only = F.col("__t").isNotNull() & F.col("__s").isNotNull(), F.col("__t").isNull(), F.col("__s").isNull()
    matched = matched & _once(F.when(matched, F.col("__n")), F.lit(True))
    yes = lambda c, default: F.coalesce(c, F.lit(False)) if c is not None else F.lit(default)
    gone = (matched & yes(delete_if, False)) | (only & yes(delete_missing, False)) | (new & F.lit(insert is None))
    change = matched & yes(update_if, True)
    value = lambda c: F.when(new, (insert or {}).get(c, F.lit(None))).when(change, (update or {}).get(c, F.col(c))).otherwise(F.col(c))
    return both.filter(~gone).select(*[F.col(c) if c == on else value(c).cast(k).alias(c) for c, k in table.dtypes])


def multi_insert(source: DataFrame, branches: dict[str, tuple[Column, dict[str, Column]]], first: bool = False) -> DataFrame:
    """INSERT ALL / FIRST: (target, ...) rows of every branch whose condition holds, in one pass; with
    first, of the first such branch only."""
    made, before = [], F.lit(False)
    for target, (condition, values) in branches.items():
        hit = F.coalesce(condition, F.lit(False)) & (~before if first else F.lit(True))
        made.append(F.when(hit, F.struct(F.lit(target).alias("target"), *[v.alias(n) for n, v in values.items()])))
        before = before | F.coalesce(condition, F.lit(False))
    return source.select(F.explode(F.array_compact(F.array(*made))).alias("r")).select("r.*")


def overwrite_partitions(table: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """INSERT OVERWRITE with dynamic partitions: partitions present in new are replaced."""
    return table.join(new.select(*by).distinct(), list(by), "left_anti").select(*table.columns).unionByName(new)


def replace_where(table: DataFrame, condition: Column, new: DataFrame) -> DataFrame:
    """INSERT REPLACE WHERE: rows that meet the condition give way to new."""
    return delete_where(table, condition).unionByName(new)


def replace_using(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT REPLACE USING: rows whose keys occur in new (nulls match nulls) give way to it."""
    hit = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return table.join(hit, on, "left_anti").unionByName(new)


def returning(written: DataFrame, *columns: str) -> DataFrame:
    """RETURNING: the rows that a statement wrote (inserted rows, updated() or the deleted ones), projected."""
    return written.select(*columns)


def top_percent(df: DataFrame, order: Sequence[Column], percent: float) -> DataFrame:
    """TOP n PERCENT, FETCH FIRST n PERCENT ROWS: that share of the rows, rounded up, in order."""
    return df.orderBy(*order).limit(math.ceil(df.count() * percent / 100 - 1e-9))


def sample_rows(df: DataFrame, rows: int) -> DataFrame:
    """TABLESAMPLE (n ROWS)."""
    return df.limit(rows)


def sample_percent(df: DataFrame, percent: float, seed: int) -> DataFrame:
    """TABLESAMPLE (p PERCENT) REPEATABLE (seed): each row with that chance."""
    return df.sample(percent / 100, seed)


def sample_bytes(df: DataFrame, most: int, size: Column) -> DataFrame:
    """TABLESAMPLE by bytes: rows until their sizes fill `most` bytes; at least one row of a table that has any.
    The number of rows is planned from their mean size, in one aggregate."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return df.limit(max(1, int(n * most / total)) if total else n)


def snapshot(table: DataFrame, version: str, at) -> DataFrame:
    """VERSION / TIMESTAMP AS OF on a table that keeps its versions as rows: the last version up to `at`."""
    seen = table.filter(F.col(version) <= F.lit(at))
    return seen.join(seen.agg(F.max(version).alias(version)), version, "left_semi")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """CHANGES: rows removed and added between two snapshots, with multiplicity."""
    removed = before.exceptAll(after).withColumn("change", F.lit("delete"))
    return removed.unionByName(after.exceptAll(before).withColumn("change", F.lit("insert")))


def connect_by(df: DataFrame, key: str, parent: str, start: Column) -> DataFrame:
    """START WITH / CONNECT BY PRIOR: rows with level and path, down to the last level, however deep. One join
    for each level, whose result is written with a checkpoint, so that no level is computed twice; a node
    that is already on its path is not followed (NOCYCLE)."""
    level = cut(df.filter(start).select("*", F.lit(1).alias("level"), F.array(F.col(key)).alias("path")))
    parts, depth = [level], 1
    while True:
        depth += 1
        up = level.select(F.col(key).alias("__p"), F.col("path").alias("__path"))
        step = df.join(up, df[parent] == up["__p"]).filter(~F.array_contains("__path", df[key]))
        level = cut(step.select(*[df[c] for c in df.columns], F.lit(depth).alias("level"), F.array_append("__path", df[key]).alias("path")))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(level)
        if len(parts) == FOLD:
            parts = [cut(reduce(DataFrame.unionByName, parts))]


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """df with `session`, 0.. within a key: a new one after more than gap_seconds of silence."""
    w = Window.partitionBy(key).orderBy(ts)
    quiet = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w)) > gap_seconds * 1_000_000
    return df.withColumn("__new", F.coalesce(quiet.cast("int"), F.lit(0))).withColumn("session", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def bin_by(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """BIN BY: equal-width bins 1..bins; 0 and bins + 1 lie outside."""
    return df.withColumn("bin", F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).cast("long"))


def json_table(df: DataFrame, column: str, path: str, columns: dict[str, str]) -> DataFrame:
    """JSON_TABLE over an array of objects at a path: a row for each element; missing paths give none."""
    schema = "array<struct<" + ",".join(f"`{n}`:{t}" for n, t in columns.items()) + ">>"
    items = F.from_json(F.get_json_object(F.col(column), path), schema)
    return df.select("*", F.explode(items).alias("__j")).select(*df.columns, "__j.*")
