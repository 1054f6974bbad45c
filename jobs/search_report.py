"""How often do patterns occur, by collection and by way of searching?

A batch report for those who compare searches: the most frequent words of a table of
patterns are looked for in all texts in three ways (overlapping, non-overlapping,
with mismatches), and counted by language, source, pattern and way.  Rows with no
hits are there too, so that tables of two runs have the same rows.

``output/lang=V``: (source, pattern, length, size, way, texts, texts_with, hits, per_million, ratio).

Run again, it gives the same rows: a full run replaces the table; a run for named
languages replaces their partitions alone and leaves the others as they are.

    python -m jobs.search_report --texts TABLE --patterns TABLE --output OUT [--config FILE]
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from jobs.common import LOG
from stringmill.operators import approx, exact, report as reports
from stringmill.sources.readers import spread

SCHEMA = "words int, shortest int, longest int, mismatches int, languages array<string>"
ROW = "source string, pattern string, length int, size string, way string, texts long, texts_with long, hits long, per_million double, ratio double, lang string"
#: The way that others are set against.
BASELINE = "overlapping"


def most_frequent(patterns: DataFrame, words: int, shortest: int, longest: int) -> DataFrame:
    """(pattern): the ``words`` most frequent runs of a-z in the patterns of these lengths; ties in code-point order."""
    runs = patterns.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("pattern"))
    counted = runs.filter(F.length("pattern").between(shortest, longest)).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "pattern").limit(words).select("pattern")


def report(spark: SparkSession, texts: str, patterns: str, output: str, *, words: int = 6, shortest: int = 5, longest: int = 12, mismatches: int = 1, languages: list[str] | None = None) -> None:
    """Count the hits of the most frequent words of ``patterns`` in ``texts``, and write the table below ``output``.

    Null and empty texts count as texts without hits.  A null language or source is a
    group of its own; an empty language is written as null, as partitions can't tell
    them apart.  ``languages``: only these, each replacing its partition; a language
    that has no texts any more keeps its old rows until a full run.
    """
    rows = spark.read.parquet(texts).select("doc_id", F.nullif("lang", F.lit("")).alias("lang"), "source", "text")
    if languages:
        rows = rows.filter(F.col("lang").isin(languages))
    wanted = most_frequent(spark.read.parquet(patterns), words, shortest, longest)
    # A few words: the same for all that follows, and no second pass over the patterns.
    wanted = spark.createDataFrame(wanted.collect(), "pattern string")
    group = spread(rows).select(F.struct("doc_id", "lang", "source").alias("text_id"), F.coalesce("text", F.lit("")).alias("text"))
    LOG.info("reading texts from %s (languages: %s), %d words of %s", texts, languages or "all", wanted.count(), patterns)

    none = lambda df: df.select("text_id", "pattern", F.lit(1).alias("n"))
    ways = {BASELINE: exact.count_overlapping(group, wanted).filter("n > 0"), "apart": none(exact.non_overlapping(group, wanted)), "mismatches": none(approx.hamming_search(group, wanted, mismatches))}
    # By text first, in the tasks that found the hits; then by group, however large one is.
    per_text = lambda df: df.groupBy("text_id", "pattern").agg(F.sum("n").alias("n"))
    found = reduce(DataFrame.union, [per_text(df).select("text_id.lang", "text_id.source", "pattern", F.lit(way).alias("way"), "n") for way, df in ways.items()])
    hits = found.groupBy("lang", "source", "pattern", "way").agg(F.count(F.lit(1)).alias("texts_with"), F.sum("n").alias("hits"))
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
    grid = sizes.crossJoin(F.broadcast(wanted)).withColumn("way", F.explode(F.array(*map(F.lit, ways))))
    same = grid["lang"].eqNullSafe(hits["lang"]) & grid["source"].eqNullSafe(hits["source"]) & (grid["pattern"] == hits["pattern"]) & (grid["way"] == hits["way"])
    zero = lambda c: F.coalesce(hits[c], F.lit(0)).cast("long").alias(c)
    all_rows = grid.join(hits, same, "left").select(grid["lang"], grid["source"], grid["pattern"], grid["way"], "texts", "characters", zero("texts_with"), zero("hits"))
    # The ways of one group and pattern are three rows, so the baseline's is a window's maximum.
    base = F.expr(f"max(CASE WHEN way = '{BASELINE}' THEN hits END) OVER (PARTITION BY lang, source, pattern)")
    out = all_rows.withColumn("base", base).select(
        "source", "pattern", F.length("pattern").alias("length"), reports.size_bucket(F.length("pattern")).alias("size"), "way", "texts", "texts_with", "hits",
        F.round(F.col("hits") * 1e6 / F.nullif("characters", F.lit(0)), 6).alias("per_million"), F.round(F.col("hits") / F.nullif("base", F.lit(0)), 6).alias("ratio"), "lang",
    )
    # One sorted file a language; the report's size is that of its groups, not of the texts.
    out = out.repartition("lang").sortWithinPartitions("lang", "source", "pattern", "way")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if languages else "static").partitionBy("lang").parquet(output)
    written = report_of(spark, output)
    if languages:
        written = written.filter(F.col("lang").isin(languages))
    total = written.agg(F.count(F.lit(1)), F.sum("hits")).first()
    read = sizes.agg(F.sum("texts"), F.sum("characters")).first()
    LOG.info("read %s texts of %s characters; wrote %s rows with %s hits to %s", *read, *total, output)


def report_of(spark: SparkSession, output: str) -> DataFrame:
    """The table that has been written."""
    return spark.read.schema(ROW).parquet(output)


if __name__ == "__main__":
    common.main(report, ("texts", "patterns", "output"), SCHEMA, f"{__file__.removesuffix('.py')}.json")
