"""Dialect detection: anchors as Catalyst columns, and the same in Python for the parser's workers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip_comments

# Dialect, confidence, and the patterns of which one must be found in the lower-case
# text without comments. Dialects are tried in this order; equal confidence keeps it.
ANCHORS = (
    ("MYSQL", 0.92, (
        r"\bupdate\b.+\bjoin\b.+\bset\b", r"\bdelete\b.+\busing\b", r"\bdelete\b.+\bfrom\b.+\bjoin\b", r"^\s*replace\s+into\b",
        r"^\s*rename\s+table\b", r"^\s*lock\s+tables\b", r"^\s*unlock\s+tables\b", r"^\s*update\s+(low_priority|ignore)\b",
        r"^\s*delete\s+.*\b(low_priority|quick|ignore)\b", r"^\s*alter\s+algorithm\b.*\bview\b", r"\binto\s+(out|dump)file\b",
        r" on duplicate key ", r"->", r"\bdiv\b", r"\bmod\b", r"\blimit\s+\d+\s*,\s*\d+")),
    ("OCEANBASE", 0.94, (r"oceanbase", r"ob_read_consistency")),
    ("OCEANBASE", 0.45, (r"_ob_",)),
    ("POSTGRESQL", 0.92, (r" on conflict ", r"\breturning\b", r"::\s*[a-zA-Z_][a-zA-Z0-9_]*", r"\bilike\b")),
    ("HIVE", 0.90, (r"\brow\s+format\b", r"\bstored\s+as\b", r"\bserdeproperties\b", r"\bclustered\s+by\b")),
    ("FLINK", 0.93, (r"'connector'", r"\"connector\"", r"\bwatermark\s+for\b", r"\bwith\s+connector\b")),
    ("STARROCKS", 0.93, (
        r"\bcreate\s+table\b.+\bduplicate\s+key\b", r"\bcreate\s+table\b.+\baggregate\s+key\b", r"\bcreate\s+table\b.+\bdistributed\s+by\s+hash\b",
        r"\bcreate\s+routine\s+load\b", r"\bload\s+label\b", r"\brefresh\s+materialized\s+view\b", r" properties \(\"replication_num\"")),
    ("ORACLE", 0.90, (r"\bfrom\s+dual\b", r"\bconnect\s+by\b", r"\bstart\s+with\b")),
    # A bracket opens an identifier unless a name, a dot, a closing parenthesis or a back quote is right before it;
    # characters beyond ASCII count as letters.
    ("SQLSERVER", 0.91, (r"\bselect\s+top\s+\d+\b", r"(^|[^a-z0-9\u0080-\uffff_.)`])\[[a-z\u0080-\uffff_@#][^\]]*\]", r"\bwith\s*\(\s*nolock\s*\)")),
)
# The anchors of the Spark dialect, strong and general, and the confidence without any.
SPARK_STRONG = (
    r"\$\{", r"#day#", r"`", r"\bcast\s*\([^)]*\bas\s+string\s*\)",
    r"\b(get_json_object|regexp_replace|regexp_extract|date_format|date_sub|from_unixtime|unix_timestamp|collect_list|collect_set|named_struct|posexplode|explode|if|ifnull|nvl)\s*\(",
    r"\brlike\b", r"[a-z0-9\u0080-\uffff_)`]\[",
)
SPARK_GENERAL = (r"insert overwrite", r"lateral view", r"create temporary view", r"\bqualify\b", r"\b(distribute|cluster|sort)\s+by\b", r" using ")
SPARK = (0.96, 0.93, 0.50)


def _any(patterns: tuple[str, ...]) -> str:
    return "(?s)" + "|".join(f"(?:{p})" for p in patterns)


_PYTHON = [(d, c, re.compile(_any(ps), re.A)) for d, c, ps in ANCHORS]
_STRONG, _GENERAL = re.compile(_any(SPARK_STRONG), re.A), re.compile(_any(SPARK_GENERAL), re.A)


def candidates(sql: str) -> list[tuple[str, float]]:
    """(dialect, confidence), best first."""
    text = strip_comments(sql).lower()
    found = [(d, c) for d, c, p in _PYTHON if p.search(text)]
    found.append(("SPARK", SPARK[0] if _STRONG.search(text) else SPARK[1] if _GENERAL.search(text) else SPARK[2]))
    return sorted(found, key=lambda x: -x[1])


def stripped(sql: Column) -> Column:
    """Lower-case text without comments, as a column."""
    quoted = r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)"""
    return F.lower(F.regexp_replace(sql, F.lit(rf"(?s){quoted}|--[^\n]*|/\*.*?(?:\*/|\z)"), F.lit("$1 ")))


def candidate_columns(text: Column) -> Column:
    """array<struct<dialect, confidence>> of a text from stripped(), best first."""
    made = lambda d, c: F.struct(F.lit(d).alias("dialect"), c.alias("confidence"))
    spark = F.when(text.rlike(_any(SPARK_STRONG)), SPARK[0]).when(text.rlike(_any(SPARK_GENERAL)), SPARK[1]).otherwise(SPARK[2])
    each = [F.when(text.rlike(_any(ps)), made(d, F.lit(c))) for d, c, ps in ANCHORS] + [made("SPARK", spark)]
    ranked = F.array(*[F.when(x.isNotNull(), F.struct((-x["confidence"]).alias("rank"), F.lit(i).alias("place"), x.alias("c"))) for i, x in enumerate(each)])
    return F.transform(F.array_sort(F.array_compact(ranked)), lambda r: r["c"])


def best(text: Column) -> Column:
    """dialect and confidence of a text from stripped(): the first of the highest confidence.

    Anchors are tried from the most confident down, so most texts stop after a few patterns."""
    tries = [(c, i, d, _any(ps)) for i, (d, c, ps) in enumerate(ANCHORS)]
    tries += [(SPARK[0], len(ANCHORS), "SPARK", _any(SPARK_STRONG)), (SPARK[1], len(ANCHORS), "SPARK", _any(SPARK_GENERAL)), (SPARK[2], len(ANCHORS), "SPARK", None)]
    made = lambda d, c: F.struct(F.lit(d).alias("dialect"), F.lit(c).alias("confidence"))
    out = None
    for c, _, d, pattern in sorted(tries, key=lambda x: (-x[0], x[1])):
        if pattern is None:
            return out.otherwise(made(d, c))
        out = F.when(text.rlike(pattern), made(d, c)) if out is None else out.when(text.rlike(pattern), made(d, c))
    return out


def detected(df: DataFrame, sql: str = "sql") -> DataFrame:
    """df with dialect and confidence. The text is stripped in a step of its own, once a row."""
    return df.withColumn("__text", stripped(F.col(sql))).withColumn("__best", best(F.col("__text"))).select(*df.columns, "__best.*")
