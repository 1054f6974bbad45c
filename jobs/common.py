"""What the command lines of the jobs share."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.errors import AnalysisException

LOG = logging.getLogger("jobs")


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at a path; None where there is no such path, or no file yet to take a schema from."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def config(spark: SparkSession, path: str, schema: str) -> dict:
    """A JSON object as keyword arguments; what it does not name is left out, what the schema does not name is an error."""
    found = spark.read.option("multiLine", True).json(path)
    if unknown := set(found.columns) - set(spark.createDataFrame([], schema).columns):
        raise ValueError(f"no such settings: {sorted(unknown)}")
    row: Row = spark.read.schema(schema).option("multiLine", True).json(path).first()
    return {k: v for k, v in row.asDict().items() if v is not None}


def main(job: Callable, paths: tuple[str, ...], schema: str, default: str) -> None:
    """Take the paths and the config from the command line, make a session, run the job, stop the session."""
    parser = argparse.ArgumentParser(description=job.__doc__)
    for name in paths:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=default, help="a JSON file, anywhere that Spark reads")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(job.__module__).getOrCreate()
    try:
        job(spark, *(getattr(args, name) for name in paths), **config(spark, args.config, schema))
    finally:
        spark.stop()
