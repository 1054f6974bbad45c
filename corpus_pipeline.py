"""A training corpus from ``documents``: five stages, each over all that the one before kept.

A stage is ``f(spark, docs, sf_dir)``; its result is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringmill.llm import common, decontaminate, line_dedup, neardup, packing, toxicity

#: No SQL expresses the toxicity, near-duplicate, tokenizing and packing stages.
ORACLE_SQL = None

#: At most so many ids of dropped documents are broadcast; beyond, documents meet them by a shuffled join.
BROADCAST_IDS = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; null and empty texts stay (``toxicity.keep_clean``)."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; ``n_chars`` follows.

    Pages of one text count once here: copies are the next stage's work, and a page
    that was copied often is no boilerplate.  Null texts and sources, empty texts,
    repeated rows and extra columns: as in ``line_dedup.drop_boilerplate``.
    """
    return line_dedup.drop_boilerplate(docs, distinct=True)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Rows that repeat a doc_id are one document; if it stays, they stay.  A null
    doc_id is in no group and stays, as do null and empty texts.  Empty table: no
    rows.  Extra columns pass through, whatever their names.
    """
    gone = common.materialize(neardup.group(docs).filter(~F.col("kept")).select("doc_id").distinct(), "duplicates")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own, key = common.numbered(docs), f"c{common.place(docs, 'doc_id')}"
    gone = gone.toDF(key)
    return own.join(F.broadcast(gone) if few else gone, key, "left_anti").select(*own.columns).toDF(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none (``decontaminate.drop_contaminated``)."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences; a null or empty text is its end id alone (``packing.pack``)."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.materialize(docs, f"stage-{name}")
            if name != STAGES[0][0]:
                common.discard(before)
    return docs
