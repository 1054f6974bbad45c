"""Sinks: benchmark rows, FASTA, pattern files, fixed-width and markdown reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report
from .readers import wrapped


def write_rows(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Benchmark rows as Parquet, or as CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def write_fasta(records: DataFrame, path: str, width: int = 80) -> None:
    """(header, seq) records as FASTA text, one file a partition."""
    records.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), wrapped(F.col("seq"), width)).alias("value")).write.mode("overwrite").text(path)


def write_patterns(patterns: DataFrame, path: str) -> None:
    """(category, name, pattern) as text below a folder a category and name."""
    patterns.select("category", "name", F.col("pattern").alias("value")).write.mode("overwrite").partitionBy("category", "name").text(path)


def write_table(df: DataFrame, path: str, widths: dict[str, int]) -> None:
    """Fixed-width lines of the named columns."""
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in widths.items()]
    df.select(F.rtrim(F.concat(*cells)).alias("value")).write.mode("overwrite").text(path)


#: Title, column and format of the approximate benchmark's two text reports.
DETAILED = (("File", "file", "%-25.25s"), ("Seq_Len", "seq_len", "%-8d"), ("Query", "query_len", "%-8d"), ("Edits", "edits", "%-6d")) + tuple(
    (f"{title}_{unit}", f"{name}_{kind}", form) for kind, unit, form in (("time", "Time(s)", "%-20.9f"), ("mem", "Mem(MB)", "%-20.2f")) for title, name in (("Regex", "re"), ("Shiftor", "shiftor"), ("Levenshtein", "levenshtein"))
)
SUMMARY = (("Sequence Type", "sequence_type", "%-18.18s"), ("Length(bp)", "sequence_length", "%-12d")) + tuple((f"{t}_Time(s)", f"{n}_avg_time", "%-22.9f") for t, n in (("Regex", "re"), ("Shiftor", "shiftor"), ("Levenshtein", "levenshtein"))) + (("Shiftor/Regex", "shiftor_vs_regex", "%-18s"), ("Levenshtein/Regex", "levenshtein_vs_regex", "%-18s"))


def report_lines(rows: DataFrame, columns: tuple[tuple[str, str, str], ...], title: str, before: list[str], after: list[str], order: list[str]) -> DataFrame:
    """(value): a report's lines in order: title, what comes before the table, the table, what comes after.

    Rows are put in order by ranges; so a report of any length is written by many
    tasks, and its files one behind the other are the report.
    """
    spark, rule = rows.sparkSession, "=" * 140
    shown = [F.format_string(form, F.concat(F.round(c, 2).cast("string"), F.lit("x")) if name.endswith("_vs_regex") else c / 1e6 if name.endswith("_mem") else c) for _, name, form in columns for c in (F.col(name),)]
    width = lambda form: int("".join(c for c in form.partition(".")[0] if c.isdigit()))
    head = [rule, title, rule, "", *before, "", " ".join(f"{t:<{width(f)}}" for t, _, f in columns).rstrip(), "-" * 140]
    part = lambda n, lines: spark.createDataFrame([(n, k, line) for k, line in enumerate(lines)], "part int, k long, value string").select("part", "k", *[F.lit(None).cast(rows.schema[o].dataType).alias(o) for o in order], "value")
    table = rows.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("k"), *order, F.rtrim(F.concat_ws(" ", *shown)).alias("value"))
    return part(0, head).union(table).union(part(2, ["", *after])).orderBy("part", "k", *order, "value").select("value")


def write_detailed(rows: DataFrame, path: str) -> None:
    """The approximate benchmark's rows as a text report."""
    lines = report_lines(rows, DETAILED, "BENCHMARK RESULTS, ALL MEASUREMENTS", [f"Records: {rows.count()}"], [], ["file", "seq_len", "query_len", "edits"])
    lines.write.mode("overwrite").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The approximate benchmark's summary as a text report, with the means of its ratios."""
    m = report.mean_of_ratios(summary).first()
    found = [] if m.quotient is None else [f"Shift-Or is on average {m.shiftor_vs_regex:.1f}x slower than Regex", f"Levenshtein is on average {m.levenshtein_vs_regex:.1f}x slower than Regex", f"Shift-Or is on average {m.quotient:.1f}x faster than Levenshtein"]
    report_lines(summary, SUMMARY, "BENCHMARK SUMMARY", [], ["KEY FINDINGS", *found], ["sequence_type", "sequence_length"]).write.mode("overwrite").text(path)


def append_missing(wanted: DataFrame, key: list[str], make: Callable[[DataFrame], DataFrame], path: str, batches: int = 16) -> int:
    """Write ``make(part)`` for each part of ``wanted`` that has none yet; returns how many were written.

    ``wanted`` is dealt to ``batches`` parts by a hash of ``key``.  A part's rows go to
    ``path/rows/batch=N``, replacing what a stopped run left there, and then N is
    written to ``path/done``.  So a run that is started again goes on with the parts
    it lacks, and no row is there twice.  ``wanted`` and ``batches`` have to be those
    of the first run.
    """
    spark = wanted.sparkSession
    try:
        done = {r[0] for r in spark.read.schema("n int, batch int").parquet(f"{path}/done").select("batch").collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = set()
    written = 0
    for n in range(batches):
        if n not in done:
            part = wanted.filter(F.pmod(F.xxhash64(*key), F.lit(batches)) == n)
            make(part).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
            spark.createDataFrame([(n,)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{path}/done/batch={n}")
            written += 1
    return written


def markdown(df: DataFrame, title: str, most: int | None = 1000) -> str:
    """A small aggregate as a markdown table; of more than ``most`` rows the rest is left out, and the last line says so."""
    rows = df.collect() if most is None else df.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("-" if v is None else str(v) for v in r) + " |" for r in rows[:most]]
    if most is not None and len(rows) > most:
        lines += ["", f"Only the first {most} rows are shown."]
    return "\n".join(lines) + "\n"
