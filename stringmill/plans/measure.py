"""What a run costs: wall and CPU time, memory, and results of each algorithm side by side."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..sources import datagen
from . import registry

MEASURED = "wall_ms double, cpu_ms double, peak_kb double, rows long"
RESULTS = "algorithm string, title string, success boolean, error string, matches long, seconds double, milliseconds double"


def measure(df: DataFrame, repeats: int = 1) -> dict[str, float]:
    """Means over runs of a frame to its end: wall and CPU milliseconds of the driver's JVM (all of Spark in local mode), its heap's peak, rows.

    Python workers are processes of their own, whose CPU time isn't in it.
    """
    spark = df.sparkSession
    beans = spark._jvm.java.lang.management.ManagementFactory
    pools = [p for p in beans.getMemoryPoolMXBeans() if str(p.getType().name()) == "HEAP"]
    own = {"wall_ms": 0.0, "cpu_ms": 0.0, "peak_kb": 0.0, "rows": 0}
    for _ in range(max(1, repeats)):
        spark._jvm.java.lang.System.gc()
        for p in pools:
            p.resetPeakUsage()
        cpu, began = _cpu_ms(spark), time.perf_counter()
        own["rows"] = df.count()
        own["wall_ms"] += 1000 * (time.perf_counter() - began)
        own["cpu_ms"] += _cpu_ms(spark) - cpu
        own["peak_kb"] += sum(p.getPeakUsage().getUsed() for p in pools) / 1024
    return {k: v if k == "rows" else v / max(1, repeats) for k, v in own.items()}


def _cpu_ms(spark: SparkSession) -> float:
    return float(spark._jvm.java.lang.ProcessHandle.current().info().totalCpuDuration().get().toMillis())


def rolling_hash_kb(pattern_length: int) -> float:
    """Estimate of the rolling-hash search's memory: two bytes a character of the pattern and 64 for its numbers."""
    return (2 * pattern_length + 64) / 1024


def amortised(preprocessing_ms: float, patterns: int) -> float:
    """Each pattern's share of what one index for all of them cost."""
    return preprocessing_ms / patterns if patterns else 0.0


def results(texts: DataFrame, patterns: DataFrame, names: list[str] | None = None, most: int = 1) -> DataFrame:
    """A row an algorithm: its hits over all pairs, seconds, or why it failed; an unknown name is such a failure."""
    titles = {f[0]: f[1] for f in registry.FACTS}
    rows = []
    for name in names or list(registry.ALL):
        began = time.perf_counter()
        try:
            if name not in registry.ALL:
                raise ValueError(f"no algorithm {name!r}")
            n, error = registry.search(texts, patterns, [name], most).count(), None
        except Exception as e:  # the failure is the result
            n, error = None, f"{type(e).__name__}: {e}".splitlines()[0]
        took = time.perf_counter() - began
        rows.append((name, titles.get(name), error is None, error, n, took, 1000 * took))
    return texts.sparkSession.createDataFrame(rows, RESULTS)


def exact_runs(texts: DataFrame, patterns: DataFrame, names: list[str] | None = None, repeats: int = 1) -> DataFrame:
    """Measured runs of patterns (category, name, pattern) in the form that ``operators.report`` takes, a row a pattern and algorithm.

    The suffix search's order of suffixes is made once; each pattern bears its share.
    """
    from ..operators import exact

    spark, out = texts.sparkSession, []
    listed = patterns.select("category", "name", "pattern").collect()  # a benchmark's list
    indexed, built = None, 0.0
    if names is None or "suffix_tree" in names:
        built = measure(exact.suffix_index(texts))["wall_ms"]
        indexed = exact.suffix_index(texts)
    for category, name, pattern in listed:
        p = spark.createDataFrame([(pattern,)], "pattern string")
        for algorithm in names or list(registry.EXACT):
            prebuilt = algorithm == "suffix_tree"
            got = measure(exact.by_index(indexed, p) if prebuilt else registry.search(texts, p, [algorithm]), repeats)
            kb = rolling_hash_kb(len(pattern)) if algorithm == "rabin_karp" else got["peak_kb"]
            out.append((name, category, algorithm, len(pattern), amortised(built, len(listed)) if prebuilt else 0.0, got["wall_ms"], got["cpu_ms"], kb, got["rows"]))
    return spark.createDataFrame(out, "pattern_name string, category string, algorithm string, pattern_length int, preprocessing_ms double, search_ms double, cpu_ms double, memory_kb double, matches_count long")


def edit_grid(spark: SparkSession, kinds: list[str], lengths: list[int], query_lengths: tuple[int, ...] = (20, 50), samples: int = 3, edits: tuple[int, ...] = (0, 1, 2), seed: int = 1) -> DataFrame:
    """Hits of every algorithm for each record, sampled query and number of edits.

    (header, type, seq_len, query_len, sample, edits, query, algorithm, hits).  A
    record's queries are substrings of it, changed in so many places; the exact
    search looks for the changed query, the others allow as many errors.
    """
    import random

    made = datagen.sequences(datagen.sequence_grid(spark, kinds, lengths, 1), seed)
    records = [(r.header, r.seq) for r in made.select("header", "seq").collect()]  # a benchmark's own
    queries = []
    for header, seq in records:
        rnd = random.Random(f"{seed}-{header}")
        for q in (q for q in query_lengths if q <= len(seq)):
            for s in range(samples):
                at = rnd.randint(0, len(seq) - q)
                for k in edits:
                    letters = list(seq[at : at + q])
                    for place in rnd.sample(range(q), min(k, q)):
                        letters[place] = rnd.choice([c for c in "ACGT" if c != letters[place]])
                    queries.append((header, q, s, k, "".join(letters)))
    asked = spark.createDataFrame(queries, "header string, query_len int, sample int, edits int, query string")
    out = None
    for name, of in (("regex", lambda t, p, k: registry.EXACT["boyer_moore"](t, p, k)), ("shift_or", registry.APPROXIMATE["shift_or"]), ("levenshtein", registry.APPROXIMATE["levenshtein"])):
        for header, seq in records:
            t = spark.createDataFrame([(header, seq)], "text_id string, text string")
            for k in edits:
                own = asked.filter((F.col("header") == header) & (F.col("edits") == k))
                hits = of(t, own.select(F.col("query").alias("pattern")).distinct(), k).groupBy("pattern").agg(F.count(F.lit(1)).alias("hits"))
                rows = own.join(F.broadcast(hits), own["query"] == hits["pattern"], "left").select("header", F.split("header", "\\|")[1].alias("type"), F.lit(len(seq)).alias("seq_len"), "query_len", "sample", "edits", "query", F.lit(name).alias("algorithm"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))
                out = rows if out is None else out.union(rows)
    return out


def findings(runs: DataFrame) -> str:
    """Markdown: the algorithms' summary, which is fastest and leanest, and mean times by length."""
    from ..sources import writers

    best = report.best(runs).first()
    lengths = runs.groupBy("pattern_length", "algorithm").agg(F.round(F.avg("search_ms"), 6).alias("mean_ms")).orderBy("pattern_length", "algorithm")
    totals = runs.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("category")).alias("c"), F.sort_array(F.collect_set("pattern_length")).alias("l")).first()
    lines = [writers.markdown(report.by_algorithm(runs).orderBy("algorithm"), "Benchmark report", None), "## Findings", ""]
    lines += [f"- Fastest: {best.fastest}, {best.fastest_ms} ms on average", f"- Least memory: {best.leanest}, {best.leanest_kb} kB on average", "", writers.markdown(lengths, "Mean times by pattern length", None).replace("# ", "## ", 1)]
    lines += ["## Data", "", f"- Runs: {totals.n}", f"- Categories: {', '.join(map(str, totals.c))}", f"- Pattern lengths: {', '.join(map(str, totals.l))}", ""]
    return "\n".join(lines)
