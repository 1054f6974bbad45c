"""Readers: FASTA, genomes, pattern corpora, uploads, benchmark rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import exact
from . import fasta

#: Columns of the two benchmark files.  Fixed values.
EXACT_ROWS = "pattern_name string, category string, algorithm string, pattern_length int, preprocessing_time_ms double, search_time_ms double, cpu_time_ms double, total_time_ms double, total_time_with_preprocessing_ms double, matches_count bigint, comparisons bigint, hash_verifications bigint, peak_memory_kb double, throughput_bp_per_ms double"
APPROX_ROWS = "file string, header string, seq_len int, query_len int, edits int, re_time double, re_mem double, shiftor_time double, shiftor_mem double, levenshtein_time double, levenshtein_mem double"
#: Kinds of file an upload may have, and the characters kept of it.  Fixed values.
UPLOAD_KINDS = ("txt", "fasta", "fa", "seq", "fastq", "dat")
UPLOAD_CHARS = 100_000


def _whole(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    reader = spark.read.option("ignoreCorruptFiles", skip_unreadable).option("ignoreMissingFiles", skip_unreadable)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def spread(df: DataFrame) -> DataFrame:
    """Over at least as many partitions with rows as there are cores: a small file is one partition, and searching it is much work.

    A file may be cut into more splits than it has row groups, and then most are empty:
    where there are few splits, those with rows are counted, which reads no column.
    A table with enough splits of its own is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= 8 * cores or splits >= cores and df.select(F.spark_partition_id().alias("_p")).distinct().count() >= cores:
        return df
    return df.repartition(cores)


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def read_fasta(spark: SparkSession, path: str, range_bytes: int = fasta.RANGE_BYTES) -> DataFrame:
    """(file, rec, header, seq) of each record of the files of a path or glob, read in byte ranges (``fasta.records``).

    ``rec`` counts a file's records from 0; only their places meet in a window.
    """
    found = fasta.records(spark, path, range_bytes)
    places = found.select("file", "at").withColumn("rec", (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).cast("int"))
    return found.join(places, ["file", "at"]).select("file", "rec", "header", "seq")


def header_fields(header: Column) -> Column:
    """kind, type, len, inst of a header like ``dna|random|len100|i0``."""
    part = lambda k: F.get(F.split(header, "\\|"), k)
    number = lambda k: F.try_to_number(F.regexp_extract(part(k), "(\\d+)", 1), F.lit("999999999")).cast("int")
    return F.struct(part(0).alias("kind"), part(1).alias("type"), number(2).alias("len"), number(3).alias("inst"))


def genome_text(text: Column) -> Column:
    """One upper-case sequence: header lines and all white space go, records join."""
    return F.upper(F.regexp_replace(F.regexp_replace(text, "(?m)^>.*$", ""), "\\s", ""))


def load_genome(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, text) of each file."""
    return _whole(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("text_id"), genome_text(F.col("value")).alias("text"))


def trim_genome(df: DataFrame, start: Column, length: int = 500_000, width: int = 80) -> DataFrame:
    """A slice of each text, and the same in lines of ``width``."""
    part = F.substring(F.regexp_replace(F.upper("text"), "\\s", ""), start + 1, F.lit(length))
    return df.withColumn("text", part).withColumn("wrapped", wrapped(F.col("text"), width))


def wrapped(text: Column, width: int = 80) -> Column:
    """In lines of ``width`` characters, without a line end at the end."""
    return F.regexp_replace(F.regexp_replace(text, f"(.{{{width}}})", "$1\n"), "\\n$", "")


def read_patterns(spark: SparkSession, root: str, categories: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(category, name, pattern, length) of root/category/name.txt, without files that can't be read; at most ``limit`` a category, the first by name."""
    parts = F.split("path", "/")
    df = _whole(spark, f"{root.rstrip('/')}/*/*.txt", skip_unreadable=True).select(F.element_at(parts, -2).alias("category"), F.regexp_replace(F.element_at(parts, -1), "\\.txt$", "").alias("name"), stripped(F.col("value")).alias("pattern"))
    df = df.withColumn("length", F.length("pattern"))
    if categories:
        df = df.filter(F.col("category").isin(categories))
    return exact.first_of_each(df, "category", "name", limit)


def count_patterns(patterns: DataFrame, categories: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Number of patterns by category, of the categories named, at most ``limit`` counted in each."""
    if categories:
        patterns = patterns.filter(F.col("category").isin(categories))
    if limit is not None:
        return patterns.groupBy("category").agg(F.least(F.count(F.lit(1)), F.lit(limit)).cast("long").alias("n"))
    return patterns.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def accepted_uploads(files: DataFrame, most: int = UPLOAD_CHARS) -> DataFrame:
    """(name, content) files of an accepted kind: content cut to ``most`` characters, its full size, whether it was cut."""
    kind = F.lower(F.substring_index("name", ".", -1))
    size = F.length("content")
    return files.filter(F.contains(F.col("name"), F.lit(".")) & kind.isin(*UPLOAD_KINDS)).select("name", F.substring("content", 1, most).alias("content"), size.cast("long").alias("size"), (size > most).alias("truncated"))


def read_uploads(spark: SparkSession, path: str, most: int = UPLOAD_CHARS) -> DataFrame:
    """Files of a path or glob as uploads; bytes that are no UTF-8 are dropped by the decoder's replacement."""
    files = spark.read.format("binaryFile").load(path)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return accepted_uploads(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), text.alias("content")), most)


def read_exact_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXACT_ROWS).option("header", True).csv(path)


def read_approx_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(APPROX_ROWS).option("header", True).csv(path)
