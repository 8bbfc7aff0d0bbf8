"""Line dedup across sites: boilerplate lines are those that many sites share.

Each site is one value of ``site_col``.  Per hash of a line (white space
normalised) a HyperLogLog sketch of its sites is merged by aggregation, so a
line that a third of all documents hold costs one small sketch a task.  Where
the estimate is within ``BAND`` standard errors (one site at least) of the
threshold, the distinct sites are counted exactly; all other lines are settled
by their estimate.  Lines on ``MIN_SITES`` sites or more are removed everywhere.

Removal marks positions by (line hash) in a join and joins the marks to the
documents by the hashes of identifier and text: rows equal in both lose the
same lines, so repeated rows and null identifiers need no row number.

Edge cases: a null text stays null with no lines; blank lines are never
counted nor removed; a null site is no site; a text may become empty; other
columns come back untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.llm.common import WHITE, stash, table, whole_row

MIN_SITES = 8
#: Registers (a power of two) of a sketch, and standard errors around the threshold that are counted exactly.
LOG_REGISTERS = 10
BAND = 4.0
#: Hashes of boilerplate lines (8 bytes each) that may be broadcast.
BROADCAST_LINES = 1_000_000


def _line_hash(line: Column) -> Column:
    """Null for a blank line."""
    plain = F.trim(F.regexp_replace(line, WHITE, " "))
    return F.when(plain != "", F.xxhash64(plain))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``_line``: hashes of lines on ``min_sites`` sites or more; ``lines`` has ``_line, _site``."""
    margin = max(1.0, BAND * 1.04 / 2 ** (LOG_REGISTERS / 2) * min_sites)
    spread = stash(
        lines.groupBy("_line")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(LOG_REGISTERS))).alias("_sites"))
        .where(F.col("_sites") >= min_sites - margin), "line-spread")
    near = spread.where(F.col("_sites") <= min_sites + margin).select("_line")
    counted = (
        lines.where("_site is not null").join(near, "_line", "left_semi")
        .groupBy("_line", "_site").agg(F.lit(1).alias("_one"))
        .groupBy("_line").agg(F.count(F.lit(1)).alias("_sites"))
        .where(F.col("_sites") >= min_sites)
    )
    sure = spread.where(F.col("_sites") > min_sites + margin)
    return sure.select("_line").unionByName(counted.select("_line"))


def dedup_lines(docs: DataFrame, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                min_sites: int = MIN_SITES, n_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """``docs`` with boilerplate lines out of ``text_col``, the lines before, and those removed."""
    rest = docs.drop(n_col, removed_col)
    rows = rest.select(
        F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("_id"), F.xxhash64(f"`{text_col}`").alias("_key"),
        F.col(f"`{site_col}`").cast("string").alias("_site"), F.split(f"`{text_col}`", "\n", -1).alias("_lines"),
        whole_row(rest.drop(text_col)).alias("_row"))
    # Hashes only, written once: the texts are not split again for the counts and the marks.
    lines = stash(
        rows.select("_id", "_key", "_site", F.posexplode("_lines").alias("_at", "_text"))
        .select("_id", "_key", "_site", "_at", _line_hash(F.col("_text")).alias("_line")).where("_line is not null"),
        "line-hashes")
    gone = stash(boilerplate(lines.select("_line", "_site"), min_sites), "boilerplate-lines")
    if gone.count() <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    marks = (lines.join(gone, "_line").groupBy("_id", "_key")
             .agg(F.collect_set("_at").alias("_gone")))  # positions of one text
    marked = rows.join(marks, ["_id", "_key"], "left")
    kept = F.filter("_lines", lambda x, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i))
    return marked.select(
        *[F.when(F.col("_gone").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(kept, "\n")).alias(c)
          if c == text_col else F.col("_row").getField(c).alias(c) for c in rest.columns],
        F.coalesce(F.size("_lines"), F.lit(0)).alias(n_col), F.coalesce(F.size("_gone"), F.lit(0)).alias(removed_col))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS plain FROM lines),
gone AS (SELECT plain FROM keyed WHERE plain <> '' GROUP BY plain HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT k.*, g.plain IS NOT NULL AS is_gone FROM keyed k LEFT JOIN gone g USING (plain)),
cleaned AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT is_gone), '') AS text,
                   count(*)::INT AS n_lines, (count(*) FILTER (WHERE is_gone))::INT AS n_removed
            FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, c.text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {"op2_line_dedup": ORACLE}
