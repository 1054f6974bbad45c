"""Seeded generators of sequences and patterns; the same seed gives the same rows.

Randomness is a hash of (seed, row, place), so it depends on no partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"
#: Categories of the pattern corpus and their sizes.  Fixed values.
CORPUS = {"average": 55, "repetitive": 9, "rare": 10, "zero-occurrence": 35, "rabin-karp-adversarial": 10, "many-query": 100}
#: Motifs and lengths of the repetitive category.  Fixed values.
MOTIFS, MOTIF_LENGTHS = ("A", "AC", "AT"), (20, 50, 100)
#: Kinds of generated sequence.  Fixed values.
KINDS = ("random", "high_gc", "repetitive", "low_complexity", "mutated")


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


def whole(seed: int, below: Column, *parts: Column) -> Column:
    """A whole number from 0 to below - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), below).cast("int")


def random_sequence(length: Column, key: Column, seed: int, gc: float = 0.5) -> Column:
    """A sequence whose characters are G or C with probability ``gc``."""
    place = F.when(length > 0, F.sequence(F.lit(1), length.cast("int"))).otherwise(F.array().cast("array<int>"))

    def base(k: Column) -> Column:
        side, which = draw(seed, key, k) < gc, draw(seed + 1, key, k) < 0.5
        return F.when(side, F.when(which, "G").otherwise("C")).otherwise(F.when(which, "A").otherwise("T"))

    return F.array_join(F.transform(place, base), "")


def repetitive(motif: Column, length: Column) -> Column:
    return F.substring(F.repeat(motif, (length / F.length(motif) + 1).cast("int")), F.lit(1), length)


def low_complexity(length: Column, key: Column, seed: int, longest: int = 200) -> Column:
    """Runs of one base, each of 1 to ``longest`` characters."""
    runs = F.transform(F.sequence(F.lit(1), length.cast("int")), lambda k: F.repeat(F.substring(F.lit(BASES), whole(seed, F.lit(4), key, k) + 1, F.lit(1)), whole(seed + 1, F.lit(longest), key, k) + 1))
    return F.when(length > 0, F.substring(F.array_join(runs, ""), F.lit(1), length)).otherwise("")


def mutated(text: Column, key: Column, seed: int, rate: float) -> Column:
    """Each character replaced by another base with probability ``rate``."""
    def change(c: Column, k: Column) -> Column:
        others = F.replace(F.lit(BASES), c, F.lit(""))
        return F.when(draw(seed, key, k) < rate, F.substring(others, whole(seed + 1, F.length(others), key, k) + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), change), "")


def with_substitutions(text: Column, key: Column, seed: int, count: int) -> Column:
    """Exactly ``count`` different places (all, if there are fewer) get another base."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    order = F.slice(F.array_sort(F.transform(letters, lambda c, k: F.struct(F.xxhash64(F.lit(seed), key, k).alias("h"), k.alias("k")))), 1, max(count, 0)) if count else F.array().cast("array<struct<h:bigint,k:int>>")
    chosen = F.transform(order, lambda x: x["k"])

    def change(c: Column, k: Column) -> Column:
        others = F.replace(F.lit(BASES), c, F.lit(""))
        return F.when(F.array_contains(chosen, k), F.substring(others, whole(seed + 1, F.length(others), key, k) + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(letters, change), "")


def sequence_grid(spark: SparkSession, kinds: list[str], lengths: list[int], count: int) -> DataFrame:
    """(type, len, inst, header) of every kind, length and instance."""
    rows = [(k,) for k in kinds]
    grid = spark.createDataFrame(rows, "type string").crossJoin(spark.createDataFrame([(n,) for n in lengths], "len int")).crossJoin(spark.range(count).select(F.col("id").cast("int").alias("inst")))
    return grid.withColumn("header", F.format_string("dna|%s|len%d|i%d", "type", "len", "inst"))


def sequences(grid: DataFrame, seed: int = 0, gc: float = 0.7, motif: str = "ATGC", rate: float = 0.05) -> DataFrame:
    """The grid with a sequence of each row's kind."""
    n, key = F.col("len"), F.col("header")
    plain = random_sequence(n, key, seed)
    seq = (
        F.when(F.col("type") == "high_gc", random_sequence(n, key, seed, gc))
        .when(F.col("type") == "repetitive", repetitive(F.lit(motif), n))
        .when(F.col("type") == "low_complexity", low_complexity(n, key, seed))
        .when(F.col("type") == "mutated", mutated(repetitive(F.lit(motif), n), key, seed, rate))
        .otherwise(plain)
    )
    return grid.withColumn("seq", seq)


def parse_lengths(spec: Column) -> Column:
    """Sorted different lengths of ``1,5-9:2,20-30``: a range with a step has its ends and what lies between, one without has its ends."""
    def numbers(part: Column) -> Column:
        a = F.regexp_extract(part, "^\\s*(\\d+)", 1).cast("int")
        b = F.regexp_extract(part, "-\\s*(\\d+)", 1)
        step = F.regexp_extract(part, ":\\s*(\\d+)", 1)
        return F.when(b == "", F.array(a)).when(step == "", F.array(a, b.cast("int"))).otherwise(F.sequence(a, F.greatest(F.when(b != "", b.cast("int")).otherwise(a), a), F.greatest(F.when(step != "", step.cast("int")).otherwise(F.lit(1)), F.lit(1))))

    parts = F.filter(F.split(spec, ","), lambda p: F.trim(p) != "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def samples(texts: DataFrame, lengths: list[int], each: int, seed: int = 0) -> DataFrame:
    """(text_id, length, turn, start, query): ``each`` substrings of each length; texts that are too short give none."""
    wanted = texts.sparkSession.createDataFrame([(n, t) for n in lengths for t in range(each)], "length int, turn int")
    both = texts.crossJoin(F.broadcast(wanted)).filter(F.length("text") >= F.col("length"))
    start = whole(seed, F.length("text") - F.col("length") + 1, F.col("text_id"), F.col("length"), F.col("turn"))
    return both.withColumn("start", start).select("text_id", "length", "turn", "start", F.substring(F.col("text"), F.col("start") + 1, F.col("length")).alias("query"))


def rare_patterns(candidates: DataFrame, texts: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    """Candidates (pattern) with so many overlapping hits over all texts."""
    from ..operators import exact

    return exact.pattern_counts(texts, candidates).filter(F.col("n").between(low, high)).select("pattern", "n")


def absent_patterns(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (pattern) that no text holds."""
    from ..operators import exact

    return exact.pattern_counts(texts, candidates).filter(F.col("n") == 0).select("pattern")


def repetitive_patterns(spark: SparkSession) -> DataFrame:
    """(name, pattern) of each motif and length."""
    rows = [(m, n, f"rep_{'allA' if m == 'A' else m}_{n}") for m in MOTIFS for n in MOTIF_LENGTHS]
    return spark.createDataFrame(rows, "motif string, length int, name string").select("name", repetitive(F.col("motif"), F.col("length")).alias("pattern"))


def adversarial_patterns(spark: SparkSession, seed: int = 0) -> DataFrame:
    """(name, pattern): runs that differ in the last base, and runs that differ in one place."""
    n = spark.range(5).select(F.col("id").cast("int").alias("i"))
    last = n.select(F.concat(F.lit("rk_collision_"), "i").alias("name"), F.concat(F.repeat(F.lit("A"), 29), F.substring(F.lit(BASES), F.pmod("i", F.lit(4)) + 1, F.lit(1))).alias("pattern"))
    at = whole(seed, F.lit(40), F.col("i"))
    one = n.select(F.concat(F.lit("rk_similar_"), "i").alias("name"), F.overlay(F.repeat(F.lit("A"), 40), F.substring(F.lit("CGT"), whole(seed + 1, F.lit(3), F.col("i")) + 1, F.lit(1)), at + 1).alias("pattern"))
    return last.union(one)


def planted_text(spark: SparkSession, length: int, pattern: str, every: int, seed: int = 0) -> DataFrame:
    """(text_id, text): a random text with the pattern at each multiple of ``every``, as far as it fits."""
    base = random_sequence(F.lit(length), F.lit(0), seed)
    places = F.sequence(F.lit(0), F.lit(max(0, length - len(pattern))), F.lit(max(every, len(pattern))))
    text = F.aggregate(places, base, lambda t, p: F.overlay(t, F.lit(pattern), p + 1))
    return spark.range(1).select(F.lit(0).alias("text_id"), text.alias("text"))


def pattern_corpus(texts: DataFrame, seed: int = 0) -> DataFrame:
    """(category, name, pattern, length) of all six categories, drawn from the texts.

    Candidates for the rare and absent categories are many more than are needed, and
    as many are kept as ``CORPUS`` says, or all if there are fewer.
    """
    spark = texts.sparkSession

    def named(df: DataFrame, category: str, prefix: str, most: int) -> DataFrame:
        from pyspark.sql import Window

        n = F.row_number().over(Window.orderBy("pattern")) - 1
        return df.select("pattern").withColumn("_n", n).filter(F.col("_n") < most).select(F.lit(category).alias("category"), F.concat(F.lit(prefix), F.col("_n").cast("string")).alias("name"), "pattern")

    groups = [("average", "avg_short_", [5, 8, 10], 20), ("average", "avg_medium_", [20, 35, 50], 20), ("average", "avg_long_", [200, 500], 10), ("average", "avg_vlong_", [1000, 2000], 5), ("many-query", "query_", [5, 8, 11, 15], 100)]
    out = [named(samples(texts, lengths, most, seed + k).select(F.col("query").alias("pattern")).distinct(), c, p, most) for k, (c, p, lengths, most) in enumerate(groups)]
    out += [df.select(F.lit(c).alias("category"), "name", "pattern") for c, df in (("repetitive", repetitive_patterns(spark)), ("rabin-karp-adversarial", adversarial_patterns(spark, seed)))]
    out.append(named(rare_patterns(samples(texts, [20, 40, 70], 20, seed + 9).select(F.col("query").alias("pattern")).distinct(), texts), "rare", "rare_", CORPUS["rare"]))
    strangers = spark.range(60).select(random_sequence(F.element_at(F.array(*map(F.lit, (25, 90, 300))), F.pmod("id", F.lit(3)).cast("int") + 1), F.col("id"), seed + 17).alias("pattern"))
    out.append(named(absent_patterns(strangers, texts), "zero-occurrence", "zero_", CORPUS["zero-occurrence"]))
    df = out[0]
    for other in out[1:]:
        df = df.union(other)
    return df.withColumn("length", F.length("pattern"))
