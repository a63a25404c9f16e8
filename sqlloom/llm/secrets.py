"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base patterns find assignments, access keys and hex runs. Further candidates are long mixed tokens
outside base spans. Every candidate's hash is counted over the corpus by distinct repositories and
distinct owners: one that more than OWNERS owners hold, or more than REPOSITORIES repositories of any
owners, is a copied example; one in fewer hands is live-looking. Live-looking mixed tokens become spans
of kind `mixed`; base spans stay in either case. What overlaps is found by windows over one text's
spans, and masks are written chunk by chunk, so the work grows with a text's length and its spans.

Nulls are empty texts without spans; repeated rows and repeated or null ids give a row each, and
count as one repository; a null source is an owner of its own; an empty table gives no rows; other
columns are ignored by scan() and kept by redact(), whatever their names. Spans of one kind never overlap;
where kinds do, all are reported, and redact() masks them together under the kind that starts first (of
equal starts, the one listed first). Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, lookup, materialize

KINDS = ("assign", "access", "hex", "mixed")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIXED = r"[A-Za-z0-9+/_-]{20,}"
LEAST_VALUE = 12
#: A candidate in the hands of more owners than this, or in more repositories, is a copied example.
OWNERS, REPOSITORIES = 2, 8
_CHUNK = 256
#: Code points of a text that are masked at once.
PIECE = 4096
# What a text must have for a kind to be looked for: without it there is no match.
_HINTS = {0: ("passw", "secret", "token", "api"), 1: ("AKIA",)}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda an expression would be computed anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(lengths: Column) -> Column:
    """Running sums of an array, in chunks, so that appending stays cheap on long arrays."""
    none = F.array().cast("array<int>")
    own = lambda a: F.aggregate(a, none, lambda s, x: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x))
    chunks = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _CHUNK).cast("int")), lambda i: own(F.slice(n, i * _CHUNK + 1, _CHUNK)))
    bases = lambda c: F.array_prepend(own(F.transform(c, lambda x: F.element_at(x, -1))), F.lit(0))
    shifted = lambda c: F.zip_with(c, F.slice(bases(c), 1, F.size(c)), lambda x, base: F.transform(x, lambda y: y + base))
    return F.flatten(_let(_let(lengths, chunks), shifted))


_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _found(text: Column, kind: int, pattern: str, value_group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost, non-overlapping matches, in code points; values under `least` are dropped.

    A text is cut at its matches once; gaps and matches in turn give the places."""
    cut = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"),
        F.split(text, pattern, -1).alias("g"),
        *[F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("v")] * bool(value_group),
    )
    ends = lambda z: _running(F.zip_with(F.slice(z["g"], 1, F.size(z["h"])), z["h"], lambda g, h: F.length(g) + F.length(h)))
    make = lambda z: F.struct((z["e"] - F.length(z["h"])).alias("start"), F.lit(kind).alias("kind"), z["e"].alias("end"), z["v"].alias("value"))
    spans = _let(cut, lambda z: F.transform(F.arrays_zip(ends(z).alias("e"), z["h"].alias("h"), z["v" if value_group else "h"].alias("v")), make))
    kept = F.filter(spans, lambda s: F.length(s["value"]) >= least) if least else spans
    # Most texts have no match: they are read once, not three times.
    hint = text if kind else F.lower(text)
    some = reduce(or_, (hint.contains(h) for h in _HINTS.get(kind, ()))) if kind in _HINTS else F.lit(True)
    return F.when(some & text.rlike(pattern), kept).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def spans_of(text: Column) -> tuple[Column, Column]:
    """(base spans, mixed candidates), each by start, then kind."""
    base = F.array_sort(F.concat(_found(text, 0, ASSIGN, 1, LEAST_VALUE), _found(text, 1, ACCESS), _found(text, 2, HEX)))
    mixed = F.filter(
        _found(text, 3, MIXED),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"),
    )
    return base, mixed


def candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows(row, doc_id, owner, repository, text), both written once: row, doc_id and base spans of each
    row; and row, owner, repository, s and hash of each candidate, less the mixed ones that a base span
    touches. A mixed one is touched if, of the base spans that begin before its end, the farthest reaches
    past its start."""
    base, mixed = spans_of(F.col("t"))
    texts = rows.select("row", "doc_id", "owner", "repository", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    found = materialize(texts.select("row", "doc_id", "owner", "repository", base.alias("base"), mixed.alias("mixed")))
    each = found.select("row", "owner", "repository", F.explode(F.concat("base", "mixed")).alias("s"))
    is_mixed = F.col("s.kind") == 3
    order = Window.partitionBy("row").orderBy(F.when(is_mixed, F.col("s.end")).otherwise(F.col("s.start")), F.when(is_mixed, 0).otherwise(1))
    reach = F.max(F.when(~is_mixed, F.col("s.end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("reach", reach).filter(~is_mixed | F.col("reach").isNull() | (F.col("reach") <= F.col("s.start"))).drop("reach")
    return found.select("row", "doc_id", "base"), materialize(each.withColumn("hash", F.xxhash64("s.value")))


def ownership(each: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners of each candidate value. Every step combines before it shuffles."""
    owned = each.select("owner", "repository", "hash").distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owned.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def judged(each: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """row, s, n_owners, n_repositories and `live` of each candidate. A hash that a third of all rows hold is
    one row on the right; adaptive execution splits the left."""
    live = (F.col("n_owners") <= owners) & (F.col("n_repositories") <= repositories)
    return each.select("row", "s", "hash").join(materialize(ownership(each)), "hash").withColumn("live", live).drop("hash")


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end, value), n_live and n_example (candidates by
    verdict), most_owners and most_repositories (of the row's candidates) for each row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), "text")
    found, each = candidates(rows)
    verdicts = judged(each, owners, repositories).groupBy("row").agg(
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"), F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"),
        F.collect_list(F.when(F.col("live") & (F.col("s.kind") == 3), F.col("s"))).alias("added"),
    )
    added = F.coalesce("added", F.array().cast(_SPAN))
    counts = ("n_live", "n_example", "most_owners", "most_repositories")
    return found.join(verdicts, "row", "left").select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from scan()."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    found = scan(docs)
    return found.select("doc_id", *[count(k) for k in range(3)], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), *found.columns[3:])


def masks(verdicts: DataFrame) -> DataFrame:
    """row and `marks` (start, end, kind): spans that are masked, joined where they overlap; the first
    gives the kind."""
    own = verdicts.filter(F.col("live") | (F.col("s.kind") < 3)).select("row", "s.start", "s.end", "s.kind")
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = own.withColumn("new", (F.col("start") >= F.coalesce(before, F.lit(0))).cast("int"))
    grouped = first.withColumn("mark", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = grouped.groupBy("row", "mark").agg(F.min(F.struct("start", "kind")).alias("f"), F.max("end").alias("end"))
    return joined.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("f.start", "end", "f.kind"))).alias("marks"))


def masked(text: Column, marks: Column) -> Column:
    """text with each of the disjoint, ordered marks replaced by <kind>. The text is cut into pieces of PIECE
    code points; each is folded over its own marks."""
    labels = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def piece(chunk: Column, number: Column) -> Column:
        base = number * PIECE
        own = F.filter(marks, lambda m: (m["start"] < base + PIECE) & (m["end"] > base))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(s: Column, m: Column) -> Column:
            a = m["start"] - base
            label = F.when(a >= 0, F.element_at(labels, m["kind"] + 1)).otherwise("")
            kept = F.when(a > s["at"], chunk.substr(s["at"] + 1, a - s["at"])).otherwise("")
            return F.struct((m["end"] - base).alias("at"), F.concat(s["parts"], F.array(kept, label)).alias("parts"))

        return F.aggregate(own, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.when(s["at"] < PIECE, chunk.substr(s["at"] + 1, F.lit(PIECE))).otherwise("")))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.array_join(F.transform(chunks, piece), "")


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """docs, all columns, with every span's text replaced by <kind>; overlapping spans are masked together.
    Texts without spans are untouched."""
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("whole")
    own = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.col("text").cast("string").alias("text"), whole)
    rows = keyed(own, *own.columns)
    _, each = candidates(rows.select(F.col("rid").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "owner", "repository", "text"))
    marks = lookup(masks(judged(each, owners, repositories)).withColumnRenamed("row", "rid"), F.size("marks"))
    out = rows.select("rid", "text", "whole").join(marks, "rid", "left")
    text = F.when(F.col("marks").isNotNull(), masked(F.col("text"), F.col("marks"))).otherwise(F.col("text"))
    return out.select(*[text.alias("text") if c == "text" else F.col("whole")[c].alias(c) for c in docs.columns])


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), p(kind, name, pat, grp, least) AS (
  VALUES (0, 'assign', '{ASSIGN.replace("'", "''")}', 1, {LEAST_VALUE}), (1, 'access', '{ACCESS}', 0, 0),
         (2, 'hex', '{HEX}', 0, 0), (3, 'mixed', '{MIXED}', 0, 20)
), hits AS (
  SELECT rid, doc_id, source, 0 AS kind, regexp_extract_all(t, '{ASSIGN.replace("'", "''")}', 0) AS h,
         regexp_extract_all(t, '{ASSIGN.replace("'", "''")}', 1) AS v, string_split_regex(t, '{ASSIGN.replace("'", "''")}') AS g FROM d
  UNION ALL SELECT rid, doc_id, source, 1, regexp_extract_all(t, '{ACCESS}'), regexp_extract_all(t, '{ACCESS}'), string_split_regex(t, '{ACCESS}') FROM d
  UNION ALL SELECT rid, doc_id, source, 2, regexp_extract_all(t, '{HEX}'), regexp_extract_all(t, '{HEX}'), string_split_regex(t, '{HEX}') FROM d
  UNION ALL SELECT rid, doc_id, source, 3, regexp_extract_all(t, '{MIXED}'), regexp_extract_all(t, '{MIXED}'), string_split_regex(t, '{MIXED}') FROM d
), each AS (
  SELECT rid, doc_id, source, kind, unnest(h) AS h, unnest(v) AS v, unnest(g[1:len(h)]) AS g, unnest(range(len(h))) AS i FROM hits WHERE len(h) > 0
), placed AS (
  SELECT rid, doc_id, source, kind, v, length(h) AS n, sum(length(g) + length(h)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM each
), spans AS (
  SELECT rid, doc_id, source, kind, v, (e - n)::BIGINT AS s, e::BIGINT AS e FROM placed
  WHERE CASE kind WHEN 0 THEN length(v) >= {LEAST_VALUE} WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') ELSE true END
), base AS (SELECT * FROM spans WHERE kind < 3
), mixed AS (
  SELECT * FROM spans m WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = m.rid AND m.s < b.e AND b.s < m.e)
), cand AS (SELECT * FROM base UNION ALL SELECT * FROM mixed
), held AS (SELECT v, source, count(*) AS n FROM (SELECT DISTINCT v, source, doc_id FROM cand) GROUP BY v, source
), owned AS (SELECT v, count(*) AS owners, sum(n) AS repositories FROM held GROUP BY v
), verdict AS (SELECT c.*, o.owners, o.repositories, o.owners <= {OWNERS} AND o.repositories <= {REPOSITORIES} AS live FROM cand c JOIN owned o USING (v)
), texts AS (
  SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
    string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS bs,
    string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3 OR live) AS sp,
    count(*) FILTER (live) AS nl, count(*) FILTER (NOT live) AS ne, max(owners) AS mo, max(repositories) AS mr
  FROM verdict JOIN (SELECT kind, name FROM p) USING (kind) GROUP BY rid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans, coalesce(nl, 0) AS n_live, coalesce(ne, 0) AS n_example,
  coalesce(mo, 0)::BIGINT AS most_owners, coalesce(mr, 0)::BIGINT AS most_repositories
FROM d LEFT JOIN texts USING (rid)
"""
