"""Where do known patterns stand in the texts that have arrived since the last run?

An incremental search: files that are new below ``texts`` are read once, all patterns
are found in one pass, and the places are written below ``output``.

* ``output/hits/batch=N/<partition>=V``: (text_id, pattern_id, pos), a row a place.
* ``output/read/batch=N``: what the batch read, by partition: texts, characters, hits.
* ``checkpoint``: Spark's own, and the patterns that the output is of.

Run again, it takes only new files.  A batch is written to its own folder, which
replaces what an earlier attempt left there; so a run that was stopped anywhere goes
on with the batch that it lacks, and no place is there twice.

    python -m jobs.scan_new_texts --texts IN --patterns TABLE --output OUT --checkpoint STATE [--config FILE]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from jobs.common import LOG
from stringmill.operators import multi

SCHEMA = "id_column string, text_column string, pattern_id_column string, pattern_column string, partition_column string, files_per_batch int"
READ = "texts long, characters long, hits long"


def scan(
    spark: SparkSession, texts: str, patterns: str, output: str, checkpoint: str, *,
    id_column: str = "doc_id", text_column: str = "text", pattern_id_column: str = "item_id", pattern_column: str = "text", partition_column: str = "lang", files_per_batch: int = 64,
) -> None:
    """Find the places of all patterns in the texts that are new since the last run.

    Null and empty texts and patterns have no places.  Texts whose partition column is
    null or empty stand under null.  Overlapping places count.  Files are new by name:
    one that is rewritten under its old name is not read again.  The output is of one
    table of patterns; another one is an error, since texts read before were not
    searched for it.
    """
    wanted = spark.read.parquet(patterns).select(F.col(pattern_id_column).alias("pattern_id"), F.col(pattern_column).alias("pattern"))
    known = _patterns(spark, wanted, checkpoint)
    table = spark.read.parquet(texts)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch).parquet(_source(texts, table))
    rows = stream.select(F.struct(F.col(id_column).alias("text_id"), F.col(partition_column).cast("string").alias("part")).alias("text_id"), F.col(text_column).alias("text"))

    def one(batch: DataFrame, n: int) -> None:
        hits = multi.search(batch, known).select("text_id.text_id", "text_id.part", "pattern_id", "pos").withColumnRenamed("part", partition_column)
        at = f"{output}/hits/batch={n}"
        hits.write.mode("overwrite").partitionBy(partition_column).parquet(at)
        written = spark.read.schema(hits.schema).parquet(at)
        own = batch.groupBy(F.col("text_id.part").alias("part")).agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.lit(0).cast("long").alias("hits"))
        found = written.groupBy(F.nullif(F.col(partition_column), F.lit("")).alias("part")).agg(F.lit(0).cast("long").alias("texts"), F.lit(0).cast("long").alias("characters"), F.count(F.lit(1)).alias("hits"))
        both = own.withColumn("part", F.nullif("part", F.lit(""))).union(found).groupBy(F.col("part").alias(partition_column)).agg(*[F.sum(c).alias(c) for c in ("texts", "characters", "hits")])
        both.coalesce(1).write.mode("overwrite").parquet(f"{output}/read/batch={n}")
        total = spark.read.parquet(f"{output}/read/batch={n}").agg(F.sum("texts"), F.sum("characters"), F.sum("hits")).first()
        LOG.info("batch %d: read %s texts of %s characters, wrote %s places to %s", n, *total, at)

    LOG.info("reading what is new below %s; patterns from %s", texts, patterns)
    run = rows.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    run.awaitTermination()
    LOG.info("all read: %d batches this time", sum(1 for p in run.recentProgress if p.numInputRows))


def _source(path: str, table: DataFrame) -> str:
    """The path, for a stream: a table that is one file needs a glob, here one that only its own name matches."""
    path = path.rstrip("/")
    files = table.inputFiles()
    return f"{path[:-1]}[{path[-1]}]" if len(files) == 1 and files[0].rpartition("/")[2] == path.rpartition("/")[2] else path


def _patterns(spark: SparkSession, wanted: DataFrame, checkpoint: str) -> DataFrame:
    """The patterns of the first run, which have to be those wanted now.

    They are one file, so they are there as a whole or not at all.
    """
    path = f"{checkpoint}/patterns"
    if common.existing(spark, path) is None:
        wanted.repartition(1).write.mode("overwrite").parquet(path)
    known = spark.read.parquet(path)
    count = lambda df: df.groupBy("pattern_id", "pattern").count()
    if not count(known).exceptAll(count(wanted)).isEmpty() or not count(wanted).exceptAll(count(known)).isEmpty():
        raise ValueError(f"the patterns are not those of {path}: take another output and checkpoint")
    return known


def hits_of(spark: SparkSession, output: str, text_id: str = "long", pattern_id: str = "long", partition_column: str = "lang") -> DataFrame:
    """All places that have been written: (text_id, pattern_id, pos, partition column, batch)."""
    return spark.read.schema(f"text_id {text_id}, pattern_id {pattern_id}, pos long, `{partition_column}` string, batch long").parquet(f"{output}/hits")


def read_of(spark: SparkSession, output: str, partition_column: str = "lang") -> DataFrame:
    """What each batch has read: (partition column, texts, characters, hits, batch)."""
    return spark.read.schema(f"`{partition_column}` string, {READ}, batch long").parquet(f"{output}/read")


if __name__ == "__main__":
    common.main(scan, ("texts", "patterns", "output", "checkpoint"), SCHEMA, f"{__file__.removesuffix('.py')}.json")
