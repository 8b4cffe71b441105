"""Cross-site boilerplate lines, by DataFrame functions only.

How many sites (``source``) have a line is first estimated: a HyperLogLog sketch of the sites per line hash, built
on the map side and merged by the aggregation, so a line that a third of all documents have costs one small row per
task. Lines whose estimate is near the threshold get an exact distinct count. Lines that at least ``MIN_SITES``
sites have are boilerplate: all their occurrences but the first (by ``doc_id``, then position) are removed.

A line's key is two 64-bit hashes of the line without white space at its ends. Only keys, positions and ids are
shuffled for the counts; texts move once, to be joined with the few positions to remove.

Defined cases: blank lines count for nothing and stay; a very long text is read whole; a null text stays null, an empty one empty; a null ``source``
is a site of its own; repeated rows (equal ``doc_id`` and text) are one document and are changed alike; an empty
table gives an empty result; other columns are kept by ``remove_boilerplate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.common import broadcast_small, fresh_name, materialize, release, table

MIN_SITES = 10
#: Estimates within this share of the threshold are counted exactly: over six standard errors of a sketch with
#: 2**12 registers (1.6 %).
NEAR, LOG_REGISTERS = 0.12, 12
#: Boilerplate keys that may be broadcast; beyond it the join is shuffled.
BROADCAST_KEYS = 300_000
_BLANKS = " \t\r\x0b\x0c"


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.lit(31), F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("rid"),
        F.coalesce(F.col("source").cast("string"), F.lit("\0none")).alias("site"),
        F.col("text").cast("string").alias("text"),
    )


def lines_of(documents: DataFrame) -> DataFrame:
    """``doc_id, rid, site, pos, h1, h2`` of every line that isn't blank."""
    each = _rows(documents).select("doc_id", "rid", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = each.withColumn("line", F.trim(F.col("line"), F.lit(_BLANKS))).where("line <> ''")
    return bare.select("doc_id", "rid", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(77), "line").alias("h2"))


def line_spread(lines: DataFrame) -> DataFrame:
    """Per line: its count, the estimated number of sites, and its first occurrence."""
    return (
        lines.groupBy("h1", "h2")
        .agg(
            F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"),
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("doc_id", "rid", "pos")).alias("first"),
        )
        .select("h1", "h2", "n", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``h1, h2, first`` of the lines that at least ``min_sites`` sites have."""
    low, high = min_sites * (1 - NEAR), min_sites * (1 + NEAR)
    wide = materialize(line_spread(lines).where(F.col("sites") >= F.lit(int(low))), "wide-lines")
    close = wide.where(F.col("sites") <= F.lit(high)).select("h1", "h2")
    exact = lines.join(broadcast_small(close, BROADCAST_KEYS), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
    sites = F.when(F.col("sites") <= F.lit(high), F.coalesce("exact", F.lit(0))).otherwise(F.col("sites"))
    found = materialize(wide.join(exact, ["h1", "h2"], "left").where(sites >= min_sites).select("h1", "h2", "first"), "boilerplate")
    release(wide)
    return found


def removals(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``doc_id, rid, gone``: the positions (sorted) of the lines to remove from a document."""
    lines = lines_of(documents)
    found = lines.join(broadcast_small(boilerplate(lines, min_sites), BROADCAST_KEYS), ["h1", "h2"])
    again = found.where(~F.struct("doc_id", "rid", "pos").eqNullSafe(F.struct("first.doc_id", "first.rid", "first.pos")))
    return again.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def without(text: Column, gone: Column) -> Column:
    """The text without the lines at the sorted positions ``gone``: the stretches between them, joined."""
    lines = F.split(text, "\n", -1)
    before = lambda j: F.coalesce(F.get(gone, j - 1), F.lit(-1))
    after = lambda j: F.coalesce(F.get(gone, j), F.size(lines))
    stretches = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: F.slice(lines, before(j) + 2, after(j) - before(j) - 1))
    return F.array_join(F.flatten(stretches), "\n")


def remove_boilerplate(documents: DataFrame, min_sites: int = MIN_SITES, removed: str | None = None) -> DataFrame:
    """The documents with boilerplate lines removed and ``n_chars``, where there is one, brought up to date.

    ``removed`` names a further column for the number of lines that went.
    """
    rid, key, row, gone, new = (fresh_name(documents.columns, x) for x in ("line_rid", "line_doc", "line_row", "line_gone", "line_text"))
    out = removals(documents, min_sites).select(F.col("doc_id").alias(key), F.col("rid").alias(row), F.col("gone").alias(gone))
    text = F.col("text").cast("string")
    marked = documents.withColumn(rid, F.xxhash64(F.lit(31), F.col("doc_id").cast("long"), text))
    joined = marked.join(out, (F.col(rid) == F.col(row)) & F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left")
    # One expression makes the text; what depends on it reads the column.
    changed = joined.withColumn(new, F.when(F.col(gone).isNull(), text).otherwise(without(text, F.col(gone))))
    columns = []
    for c in documents.columns:
        if c.lower() == "text":
            columns.append(F.col(new).alias(c))
        elif c.lower() == "n_chars":
            columns.append(F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(new)).cast(documents.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    if removed:
        columns.append(F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed))
    return changed.select(*columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: how many lines they had, how many of them were removed, and the text that is left."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
    return remove_boilerplate(documents, removed="n_removed").select("doc_id", "n_lines", "n_removed", "text")


OP2_SQL = f"""
WITH lines AS (
  SELECT d.doc_id, d.source, t.pos, t.line, trim(t.line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare
  FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS t(line, pos)
), wide AS (
  SELECT bare FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce(source, chr(1) || 'none')) >= {MIN_SITES}
), numbered AS (
  SELECT l.doc_id, l.pos, l.line, w.bare IS NOT NULL AND row_number() OVER (PARTITION BY l.bare ORDER BY l.doc_id, l.pos) > 1 AS gone
  FROM lines l LEFT JOIN wide w ON l.bare = w.bare
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM numbered GROUP BY doc_id
"""
