"""Aggregates over benchmark rows: summaries, speed-ups, buckets, pivots, ranks.

``runs`` has (pattern_name, category, algorithm, pattern_length, preprocessing_ms,
search_ms, memory_kb, matches_count), one row a pattern and algorithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the length buckets, in order.  Fixed values.
BUCKETS = (("small", 10), ("medium", 50), ("large", 200))
#: Category left out of length statistics and plots.  Fixed value.
MANY = "many-query"


def r6(c: Column) -> Column:
    return F.round(c, 6)


def size_bucket(length: Column) -> Column:
    out = F.lit("vlarge")
    for name, most in reversed(BUCKETS):
        out = F.when(length <= most, name).otherwise(out)
    return out


def bucket_order(bucket: Column) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n, _ in BUCKETS], F.lit("vlarge")), bucket).cast("long")


def kept_runs(runs: DataFrame, *, naive_longest: int = 100, tree_longest: int = 1000, skip: dict[str, list[str]] | None = None) -> DataFrame:
    """Without the runs that the skip policy leaves out; a bound of 0 or less is none."""
    gone = F.lit(False)
    for algorithm, most in (("naive", naive_longest), ("suffix_tree", tree_longest)):
        own = F.col("algorithm") == algorithm
        if most > 0:
            gone = gone | (own & (F.col("pattern_length") > most))
        if skip and skip.get(algorithm):
            gone = gone | (own & F.col("category").isin(skip[algorithm]))
    return runs.filter(~gone)


def with_throughput(runs: DataFrame, text_length: int) -> DataFrame:
    """Adds total times and characters a millisecond (null where no time was measured)."""
    search = F.greatest(F.lit(0.0), F.col("search_ms"))
    return runs.withColumn("total_ms", search + F.col("preprocessing_ms")).withColumn("throughput", F.round(F.lit(text_length) / F.when(search != 0, search), 4))


def median(column: str, approximate: bool) -> Column:
    """Exact, which holds all of a group's values in one task, or within a ten-thousandth of the ranks, in little memory."""
    return F.percentile_approx(column, 0.5, 10_000) if approximate else F.median(column)


def by_algorithm(runs: DataFrame, approximate: bool = False) -> DataFrame:
    """Mean, median, deviation, range of search times, mean preprocessing and memory, runs, and the derived total."""
    a = runs.groupBy("algorithm").agg(
        F.avg("search_ms").alias("mean_ms"), median("search_ms", approximate).alias("median_ms"), F.stddev_samp("search_ms").alias("std_ms"), F.min("search_ms").alias("min_ms"), F.max("search_ms").alias("max_ms"),
        F.avg("preprocessing_ms").alias("mean_pre"), F.avg("memory_kb").alias("mean_kb"), F.count(F.lit(1)).alias("runs"),
    )
    return a.select("algorithm", *[r6(F.col(c)).alias(c) for c in ("mean_ms", "median_ms", "std_ms", "min_ms", "max_ms", "mean_pre", "mean_kb")], "runs", r6(F.col("median_ms") * F.col("runs") + F.col("mean_pre")).alias("total_ms"))


def by_category(runs: DataFrame) -> DataFrame:
    a = runs.groupBy("category", "algorithm").agg(F.avg("search_ms").alias("mean_ms"), F.stddev_samp("search_ms").alias("std_ms"), F.avg("preprocessing_ms").alias("mean_pre"), F.avg("memory_kb").alias("mean_kb"), F.count(F.lit(1)).alias("runs"))
    return a.select("category", "algorithm", *[r6(F.col(c)).alias(c) for c in ("mean_ms", "std_ms", "mean_pre", "mean_kb")], "runs", r6(F.col("mean_ms") * F.col("runs") + F.col("mean_pre")).alias("total_ms"))


def by_bucket(runs: DataFrame) -> DataFrame:
    """Shortest, longest, runs and mean time a length bucket, with the bucket's place in order."""
    b = size_bucket(F.col("pattern_length"))
    a = runs.filter(F.col("category") != MANY).groupBy(b.alias("bucket")).agg(F.min("pattern_length").alias("shortest"), F.max("pattern_length").alias("longest"), F.count(F.lit(1)).alias("runs"), r6(F.avg("search_ms")).alias("mean_ms"))
    return a.withColumn("place", bucket_order(F.col("bucket")))


def band(speedup: Column) -> Column:
    return F.when(speedup >= 2, "much faster").when(speedup >= 1, "faster").when(speedup >= 0.5, "slower").when(speedup >= 0.1, "much slower").otherwise("far slower")


def speedup(runs: DataFrame, baseline: str) -> DataFrame:
    """Each run's time against the baseline algorithm's on the same pattern; 1 where there is none."""
    base = runs.filter(F.col("algorithm") == baseline).groupBy("category", "pattern_name").agg(F.min("search_ms").alias("base_ms"))
    s = F.coalesce(F.col("base_ms") / F.when(F.col("search_ms") != 0, F.col("search_ms")), F.lit(1.0))
    return runs.join(base, ["category", "pattern_name"], "left").select("category", "pattern_name", "algorithm", r6(s).alias("speedup"), band(s).alias("band"))


def speedup_rows(runs: DataFrame, baseline: str, missing_ms: float = 1.0) -> DataFrame:
    """Each run's whole time, preprocessing too, against the baseline's on the same pattern, with its band.

    The baseline's own is 1; where the baseline was not run, its time is taken as
    ``missing_ms``; a run that took no time has 0.
    """
    total = F.col("search_ms") + F.col("preprocessing_ms")
    base = runs.filter(F.col("algorithm") == baseline).groupBy("category", "pattern_name").agg(F.max(total).alias("base_ms"))
    s = F.when(F.col("algorithm") == baseline, F.lit(1.0)).when(total > 0, F.coalesce("base_ms", F.lit(missing_ms)) / total).otherwise(F.lit(0.0))
    both = runs.join(base, ["category", "pattern_name"], "left")
    return both.select("category", "pattern_name", "algorithm", r6(total).alias("total_ms"), F.col("base_ms").isNotNull().alias("has_baseline"), r6(s).alias("speedup"), band(s).alias("band"))


def in_words(speedup: Column) -> Column:
    """``2.0000x faster``, ``4.0000x slower``; null where there is no ratio or no time was taken."""
    return F.when(speedup >= 1, F.format_string("%.4fx faster", speedup)).when(speedup > 0, F.format_string("%.4fx slower", 1 / speedup))


def speedup_by_algorithm(runs: DataFrame, baseline: str) -> DataFrame:
    """Each algorithm against the baseline: by its derived total (median times runs, and preprocessing), and by its mean run.

    Without runs of the baseline there are no ratios, words or bands.
    """
    a = runs.groupBy("algorithm").agg(F.median("search_ms").alias("median"), F.avg("search_ms").alias("mean"), F.avg("preprocessing_ms").alias("pre"), F.count(F.lit(1)).alias("runs"))
    a = a.withColumn("total", F.col("median") * F.col("runs") + F.col("pre"))
    # One row, or none.
    base = a.filter(F.col("algorithm") == baseline).select(F.col("total").alias("base_total"), F.col("mean").alias("base_mean"))
    both = a.join(F.broadcast(base), F.lit(True), "left")
    ratio = lambda own, to: F.when(F.col(own) > 0, F.col(to) / F.col(own)).when(F.col(to).isNotNull(), F.lit(0.0))
    out = ["algorithm", "runs"]
    for name, own, to in (("total", "total", "base_total"), ("run", "mean", "base_mean")):
        s = ratio(own, to)
        out += [r6(F.col(own)).alias(f"{name}_ms"), r6(s).alias(f"{name}_speedup"), in_words(s).alias(f"{name}_words"), F.when(s.isNotNull(), band(s)).alias(f"{name}_band")]
    return both.select(*out)


def ordered_listing(runs: DataFrame, widest: int = 20) -> DataFrame:
    """The listing by category, with the place of each run among its pattern's: the fastest first, ties by name."""
    place = F.row_number().over(Window.partitionBy("category", "pattern_name").orderBy("search_ms", "algorithm"))
    return runs.select("category", "pattern_name", shortened("pattern_name", widest).alias("shown"), place.alias("place"), "algorithm", r6(F.col("search_ms")).alias("search_ms"), "matches_count", r6(F.col("memory_kb")).alias("memory_kb"))


def by_mean(runs: DataFrame) -> DataFrame:
    """(place, algorithm, mean_ms): algorithms from the fastest by mean time on; ties by name."""
    a = runs.groupBy("algorithm").agg(r6(F.avg("search_ms")).alias("mean_ms"))
    return a.select(F.row_number().over(Window.orderBy("mean_ms", "algorithm")).alias("place"), "algorithm", "mean_ms")


def values_of(runs: DataFrame, *columns: str) -> DataFrame:
    """(name, value): the distinct values of each column, written as strings; null is none.

    In long form, so that a column of many values is no long list.
    """
    long = runs.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])))
    return long.filter(F.col("value").isNotNull()).distinct()


def every_pair(runs: DataFrame, rows: list[str], value: Column, name: str, filled: bool = True) -> DataFrame:
    """A value by row and algorithm in long form, a row for each pair of those that occur, 0 where there is none.

    The pairs are as many as rows times algorithms; for large inputs, without ``filled``,
    only pairs that have runs are given.
    """
    own = runs.groupBy(*rows, "algorithm").agg(value.alias(name))
    if not filled:
        return own.select(*rows, "algorithm", r6(F.coalesce(F.col(name), F.lit(0.0))).alias(name))
    grid = own.select(*rows).distinct().crossJoin(F.broadcast(own.select("algorithm").distinct()))
    # Not a join, which would lose null names.
    both = own.union(grid.select(*rows, "algorithm", F.lit(None).cast(own.schema[name].dataType).alias(name)))
    return both.groupBy(*rows, "algorithm").agg(r6(F.coalesce(F.max(name), F.lit(0.0))).alias(name))


def log_by_bucket(runs: DataFrame) -> DataFrame:
    """log10(1 + mean time) by category, bucket and algorithm."""
    b = size_bucket(F.col("pattern_length"))
    return runs.filter(F.col("category") != MANY).groupBy("category", b.alias("bucket"), "algorithm").agg(r6(F.log10(F.avg("search_ms") + 1)).alias("log_ms"))


def scatter(runs: DataFrame) -> DataFrame:
    """Length against time, a row a run."""
    return runs.filter(F.col("category") != MANY).select("pattern_length", "algorithm", r6(F.col("search_ms")).alias("search_ms"))


def preprocessing(runs: DataFrame) -> DataFrame:
    """Mean preprocessing against mean search of the algorithms that preprocess."""
    return runs.filter(F.col("preprocessing_ms") > 0).groupBy("algorithm").agg(r6(F.avg("preprocessing_ms")).alias("mean_pre"), r6(F.avg("search_ms")).alias("mean_ms"), F.count(F.lit(1)).alias("runs"))


def bucket_by_algorithm(runs: DataFrame) -> DataFrame:
    b = size_bucket(F.col("pattern_length"))
    return runs.filter(F.col("category") != MANY).groupBy(b.alias("bucket"), "algorithm").agg(r6(F.avg("search_ms")).alias("mean_ms"))


def unpivoted(runs: DataFrame, approximate: bool = False) -> DataFrame:
    """Mean, median and deviation of each measure, long form."""
    long = runs.select("algorithm", F.expr("stack(3, 'search_ms', search_ms, 'preprocessing_ms', preprocessing_ms, 'memory_kb', memory_kb) AS (measure, value)"))
    return long.groupBy("algorithm", "measure").agg(r6(F.avg("value")).alias("mean"), r6(median("value", approximate)).alias("median"), r6(F.stddev_samp("value")).alias("std"))


def best(runs: DataFrame) -> DataFrame:
    """Fastest algorithm and the one with least memory, by mean; ties: the first by name."""
    a = runs.groupBy("algorithm").agg(r6(F.avg("search_ms")).alias("t"), r6(F.avg("memory_kb")).alias("m"))
    return a.agg(F.min(F.struct("t", "algorithm")).alias("f"), F.min(F.struct("m", "algorithm")).alias("l")).select(F.col("f.algorithm").alias("fastest"), F.col("f.t").alias("fastest_ms"), F.col("l.algorithm").alias("leanest"), F.col("l.m").alias("leanest_kb"))


def memory_quartiles(runs: DataFrame, approximate: bool = False) -> DataFrame:
    at = F.array(*map(F.lit, (0.25, 0.5, 0.75)))
    p = F.percentile_approx("memory_kb", at, 10_000) if approximate else F.percentile("memory_kb", at)
    return runs.groupBy("algorithm").agg(F.min("memory_kb").alias("low"), p.alias("q"), F.max("memory_kb").alias("high")).select("algorithm", r6(F.col("low")).alias("low"), *[r6(F.col("q")[k]).alias(f"q{k + 1}") for k in range(3)], r6(F.col("high")).alias("high"))


def pattern_places(runs: DataFrame, parts: int = 64) -> DataFrame:
    """Place of each pattern in its category by name, from 0.

    Names are cut into about ``parts`` ranges at bounds from a sample by hash; places
    are counted within a range and the ranges before it are added, so no category
    goes through one task.
    """
    names = runs.filter(F.col("category") != MANY).select("category", "pattern_name").distinct()
    h, most = F.pmod(F.xxhash64("pattern_name"), F.lit(1 << 20)), 50 * parts
    share = min(1.0, most / max(1, names.count()))
    # About ``most`` names, whatever the size of the table.
    drawn = sorted(r[0] for r in names.filter(h < int(share * (1 << 20)) + 1).select("pattern_name").collect() if r[0] is not None)
    bounds = drawn[:: max(1, len(drawn) // parts)]
    of = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("pattern_name"))) if bounds else F.lit(0)
    dealt = names.withColumn("_range", of)
    sizes = dealt.groupBy("category", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("category").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("category", "_range").orderBy("pattern_name")) - 1
    placed = dealt.withColumn("_k", inside).join(F.broadcast(sizes.withColumn("_before", before).drop("_n")), ["category", "_range"])
    return placed.select("category", "pattern_name", (F.col("_before") + F.col("_k")).cast("long").alias("place"))


def next_of_each(ids: DataFrame, key: str, per: int = 100_000) -> DataFrame:
    """(key, next): each distinct number and the next larger one, null for the largest.

    Numbers are dealt to ranges of their values, about ``per`` each if they lie evenly;
    a range's last number looks to the first of the next range that has any.
    """
    ids = ids.select(key).distinct().filter(F.col(key).isNotNull())
    n, low, high = ids.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    wide = max(1, (high - low + 1) * per // max(n, 1)) if n else 1
    dealt = ids.withColumn("_range", F.floor((F.col(key) - F.lit(low or 0)) / wide))
    firsts = dealt.groupBy("_range").agg(F.min(key).alias("_first"))
    # A row a range that has any, so one window over them is small.
    after = firsts.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_after"))
    inside = F.lead(key).over(Window.partitionBy("_range").orderBy(key))
    return dealt.withColumn("_inside", inside).join(F.broadcast(after), "_range").select(key, F.coalesce("_inside", "_after").alias("next"))


def totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.countDistinct("pattern_name").alias("patterns"), F.countDistinct("category").alias("categories"), F.countDistinct("algorithm").alias("algorithms"), F.count(F.lit(1)).alias("runs"), F.sum("matches_count").cast("long").alias("matches"))


def ratio_of_means(runs: DataFrame, baseline: str) -> DataFrame:
    """Mean time by algorithm and its ratio to the baseline's mean."""
    a = runs.groupBy("algorithm").agg(F.avg("search_ms").alias("t"))
    base = a.filter(F.col("algorithm") == baseline).select(F.col("t").alias("b"))
    return a.crossJoin(base).select("algorithm", r6(F.col("t")).alias("mean_ms"), r6(F.col("t") / F.col("b")).alias("ratio"))


def shortened(name: str, widest: int) -> Column:
    """A name cut to ``widest`` for printing."""
    return F.when(F.length(name) > widest, F.concat(F.substring(name, 1, widest - 3), F.lit("..."))).otherwise(F.col(name))


def listing(runs: DataFrame, widest: int = 20) -> DataFrame:
    """Names cut to ``widest`` for printing."""
    return runs.select(shortened("pattern_name", widest).alias("shown"), "category", "algorithm", r6(F.col("search_ms")).alias("search_ms"))


def approx_summary(rows: DataFrame) -> DataFrame:
    """Means by parsed type and length of the approximate benchmark's rows, and the ratios of means to the regular expression's."""
    kind = F.element_at(F.split("header", "\\|"), 2)
    a = rows.groupBy(kind.alias("sequence_type"), F.col("seq_len").alias("sequence_length")).agg(*[F.avg(f"{n}_{m}").alias(f"{n}_{m}") for n in ("re", "shiftor", "levenshtein") for m in ("time", "mem")])
    ratio = lambda n: r6(F.col(f"{n}_time") / F.when(F.col("re_time") != 0, F.col("re_time"))).alias(f"{n}_vs_regex")
    return a.select("sequence_type", "sequence_length", *[r6(F.col(f"{n}_{m}")).alias(f"{n}_avg_{m}") for n in ("re", "shiftor", "levenshtein") for m in ("time", "mem")], ratio("shiftor"), ratio("levenshtein"))


def means_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean times of the approximate benchmark by query length, edits, or any keys."""
    return rows.groupBy(*keys).agg(*[r6(F.avg(f"{n}_time")).alias(f"{n}_time") for n in ("re", "shiftor", "levenshtein")])


def mean_of_ratios(summary: DataFrame) -> DataFrame:
    """Means of the rows' ratios, and their quotient."""
    a = summary.agg(F.avg("shiftor_vs_regex").alias("s"), F.avg("levenshtein_vs_regex").alias("l"))
    return a.select(r6(F.col("s")).alias("shiftor_vs_regex"), r6(F.col("l")).alias("levenshtein_vs_regex"), r6(F.col("l") / F.when(F.col("s") != 0, F.col("s"))).alias("quotient"))
