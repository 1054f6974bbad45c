"""Searches over streams: texts are searched as they arrive, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exact


def texts_of(spark: SparkSession, path: str, schema: str, id_column: str, text_column: str) -> DataFrame:
    """(text_id, text) of the Parquet files that arrive below a path."""
    return spark.readStream.schema(schema).parquet(path).select(F.col(id_column).alias("text_id"), F.col(text_column).alias("text"))


def hits(stream: DataFrame, patterns: list[str]) -> DataFrame:
    """(text_id, pattern, pos) of each overlapping hit, piece by piece as in a batch: in proportion to the texts, whatever the number of hits."""
    p = F.explode(F.array(*map(F.lit, patterns)))
    rows = stream.select("text_id", "text", p.alias("pattern")).filter((F.length("pattern") > 0) & F.contains(F.col("text"), F.col("pattern")))
    return exact.hits_by_pieces(rows)


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Search all that has arrived, append the hits as Parquet, and stop; a later run goes on from there."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
