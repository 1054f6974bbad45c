"""Lines that are boilerplate of their site are dropped.

For each site and line, the pages with the line are divided by the site's pages; a
line above ``RATIO`` is boilerplate there and is dropped from the site's pages.  A
line on a single page is no repetition, however few pages its site has
(``MIN_PAGES``).  With ``distinct``, pages of the same whole text count as one, above
and below the line, so that a page that was copied often does not become
boilerplate of its site.  Everything is column expressions; texts are never
collected in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATIO = 0.02
MIN_PAGES = 2
#: So many boilerplate lines (16 bytes each) are broadcast at most; beyond, texts meet them by a shuffled join.
BROADCAST_LINES = 100_000

_HAS_WORD = "[^\\x20\\x09-\\x0D]"


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _site(docs: DataFrame, site: str):
    return F.xxhash64(F.col(f"c{common.place(docs, site)}")).alias("_site")


def boilerplate(docs: DataFrame, site: str, ratio: float, min_pages: int, distinct: bool) -> DataFrame:
    """(_site, _line): hashes of the lines that are boilerplate, by hash of the site.

    A site has at most (lines a page) / ratio of them.  Counts are combined before
    each shuffle, so a line of a third of all pages is one number a task.
    """
    text = F.col(f"c{common.place(docs, 'text')}")
    pages = common.numbered(docs).select(_site(docs, site), F.xxhash64(text).alias("_page"), text.alias("_text"))
    own = F.explode(F.array_distinct(F.filter(_lines(F.col("_text")), lambda x: x.rlike(_HAS_WORD)))).alias("_l")
    lines = pages.select("_site", "_page", own).select("_site", F.xxhash64("_l").alias("_line"), "_page")
    pages = pages.select("_site", "_page")
    if distinct:
        lines, pages = lines.distinct(), pages.distinct()
    lines = lines.groupBy("_site", "_line").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_pages)
    total = pages.groupBy("_site").agg(F.count(F.lit(1)).alias("_total"))
    return lines.join(total, "_site").filter(F.col("_n") > ratio * F.col("_total")).select("_site", "_line")


def drop_boilerplate(docs: DataFrame, *, site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False, counts: bool = False) -> DataFrame:
    """docs without the boilerplate lines of their sites; ``n_chars``, if there is one, follows the text.

    With ``counts``, the lines of each page (``n_lines``) and those dropped
    (``n_dropped``) are added.  All rows and columns stay; other lines keep their
    order and line ends.

    Null text: stays null, counts as a page without lines.  Null site: a site of
    its own.  A page all of whose lines go has empty text.  Lines without a word
    are never counted nor dropped.  Ties: a share equal to ``ratio`` stays.  Repeated
    rows: each is a page and stays.  Empty table: no rows.  Very long texts are
    split where they lie.  Extra columns pass through whatever their names.
    """
    bad = common.materialize(boilerplate(docs, site, ratio, min_pages, distinct), "boilerplate")
    n = bad.limit(BROADCAST_LINES + 1).count()
    by_site = bad.groupBy("_site").agg(F.collect_list("_line").alias("_bad"))
    rows = common.numbered(docs).select(F.struct("*").alias("_row"), _site(docs, site))
    if n <= BROADCAST_LINES:
        met = rows.join(F.broadcast(by_site), "_site", "left")
    else:
        # A site may hold a third of the pages: its rows meet its lines in many places, dealt by all that can be hashed.
        spread = [F.col(f"_row.c{k}") for k, f in enumerate(docs.schema.fields) if "map<" not in f.dataType.simpleString()]
        met = common.attach(rows.withColumn("_spread", F.xxhash64(*spread)), "_site", "_spread", by_site, how="left")
    at = common.place(docs, "text")
    own_text = F.col(f"_row.c{at}")
    lines = _lines(own_text)
    # One set of hashes a page, not a search of the site's lines for each line; bound to a name, so it is made once.
    gone = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), F.col("_bad"))
    without = F.element_at(F.transform(F.array(gone), lambda h: F.filter(lines, lambda x: ~(F.array_contains(h, F.xxhash64(x)) & x.rlike(_HAS_WORD)))), 1)
    kept = F.when(F.col("_bad").isNull(), lines).otherwise(without)
    text = F.when(own_text.isNotNull(), F.array_join(kept, "\n"))
    met = met.select("_row", text.alias("_text"), *([lines.alias("_lines"), kept.alias("_kept")] if counts else []))
    out = []
    for k, f in enumerate(docs.schema.fields):
        own = F.col(f"_row.c{k}")
        if k == at:
            own = F.col("_text")
        elif f.name == "n_chars":
            own = F.length("_text").cast(f.dataType)
        out.append(own.alias(f.name))
    if counts:
        had = F.when(F.coalesce(own_text, F.lit("")) == "", F.lit(0)).otherwise(F.size("_lines"))
        out += [had.cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped")]
    return met.select(*out)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; their source is their site."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_boilerplate(docs, counts=True).select("doc_id", "text", "n_chars", "n_lines", "n_dropped")


ORACLE_SQL = f"""
WITH lines AS (SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
counted AS (SELECT source, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (SELECT c.source, c.line FROM counted c JOIN totals t ON c.source = t.source WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * t.total),
numbered AS (
  SELECT d.doc_id, d.source, unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS k, d.text = '' AS nothing
  FROM documents d),
judged AS (SELECT n.*, b.line IS NOT NULL AS gone FROM numbered n LEFT JOIN bad b ON n.source = b.source AND n.line = b.line),
joined AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text,
         CAST(sum(CASE WHEN nothing THEN 0 ELSE 1 END) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped
  FROM judged GROUP BY doc_id)
SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars, n_lines, n_dropped FROM joined
"""
