"""The seven search algorithms by name, what is known of them, sample data, and one search call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import approx, exact
from ..sources.readers import stripped

Builder = Callable[[DataFrame, DataFrame, int], DataFrame]

EXACT: dict[str, Builder] = {
    "naive": lambda t, p, k: exact.by_windows(t, p),
    "kmp": lambda t, p, k: exact.by_split(t, p),
    "boyer_moore": lambda t, p, k: exact.by_find(t, p),
    "suffix_tree": lambda t, p, k: exact.by_suffixes(t, p),
    "rabin_karp": lambda t, p, k: exact.by_hash(t, p),
}
APPROXIMATE: dict[str, Builder] = {
    "levenshtein": lambda t, p, k: approx.edit_search_greedy(t, p, k),
    "shift_or": lambda t, p, k: approx.hamming_search(t, p, k),
}
ALL = EXACT | APPROXIMATE

#: (name, title, kind, time, space) of each algorithm.  Fixed values.
FACTS = (
    ("naive", "Naive String Matching", "Exact Matching", "O(nm)", "O(1)"),
    ("kmp", "Knuth-Morris-Pratt (KMP)", "Exact Matching", "O(n+m)", "O(m)"),
    ("boyer_moore", "Boyer-Moore", "Exact Matching", "O(nm) worst, O(n/m) average", "O(σ) where σ is alphabet size"),
    ("suffix_tree", "Suffix Tree", "Exact Matching", "O(m) search, O(n) preprocessing", "O(n)"),
    ("levenshtein", "Levenshtein Distance", "Approximate Matching", "O(nm)", "O(nm)"),
    ("shift_or", "Shift-Or Algorithm", "Approximate Matching", "O(nm/w) where w is word size", "O(σ)"),
    ("rabin_karp", "Rabin-Karp", "Exact Matching", "O(n+m) average, O(nm) worst", "O(1)"),
)
#: How this engine runs each of them.
PLANS = {
    "naive": "all windows of a text are compared at once, character by character of the pattern",
    "kmp": "a look-ahead split of each piece of a text, in the JVM",
    "boyer_moore": "Python's substring search over Arrow batches",
    "suffix_tree": "suffixes put in order once a text, two binary searches a pattern",
    "levenshtein": "distances of all near lengths at all starts at once, then a greedy pass",
    "shift_or": "vector comparison of windows over Arrow batches",
    "rabin_karp": "hashes of all windows at once, characters decide",
}
#: Sample data.  Fixed values.
SAMPLES = (
    ("dna_simple", "Simple DNA Sequence", "ATCGATCGATCGATCGTAGCTAGCTAGCTAGC", "ATCG"),
    ("dna_ecoli", "E. coli Gene Fragment", "ATGGCAATTCAGGGTATCGACAATGAAGCGACCCCGCTGGCCGAAGAGCTGGCAAAAGATGCCGATGAACTGGTACACGCCTGGGCGAAATTCTGGGTGCCCGCACCCACACCGTCGA", "ATG"),
    ("dna_mutation", "Mutation Detection", "ATCGATCGXTCGATCG", "ATCGATCG"),
    ("english", "English Text", "The quick brown fox jumps over the lazy dog. The fox was very quick.", "quick"),
    ("repetitive", "Highly Repetitive", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", "AAA"),
)


def algorithms(spark: SparkSession, name: str | None = None) -> DataFrame:
    rows = [(*f, PLANS[f[0]]) for f in FACTS if name in (None, f[0])]
    return spark.createDataFrame(rows, "algorithm string, title string, category string, time string, space string, plan string")


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SAMPLES), "key string, name string, text string, pattern string")


def health(spark: SparkSession) -> DataFrame:
    return algorithms(spark).groupBy("category").agg(F.count(F.lit(1)).alias("algorithms"))


def search(texts: DataFrame, patterns: DataFrame, names: list[str] | None = None, most: int = 1) -> DataFrame:
    """(algorithm, text_id, pattern, pos) of each algorithm named; distances fall away.

    Texts and patterns are stripped of white space at both ends first; an empty
    pattern has no hits.  An unknown name is an error; ``measure.results`` gives a row for it.
    """
    if unknown := [n for n in names or () if n not in ALL]:
        raise ValueError(f"no such algorithms: {unknown}")
    t, p = (df.withColumn(c, stripped(F.col(c))) for df, c in ((texts, "text"), (patterns, "pattern")))
    p, out = p.filter("pattern != ''"), None
    for name in names or list(ALL):
        hits = ALL[name](t, p, most).select(F.lit(name).alias("algorithm"), "text_id", "pattern", F.col("pos").cast("long").alias("pos"))
        out = hits if out is None else out.union(hits)
    return out


def benchmark_counts(spark: SparkSession, sizes: tuple[int, ...] = (100, 1000, 10_000), pattern_length: int = 10) -> DataFrame:
    """(algorithm, size, matches) on repeated ``ATCG`` texts of the sizes; a pattern of no whole repeat has no hits."""
    texts = spark.createDataFrame([(n, "ATCG" * (n // 4)) for n in sizes], "text_id int, text string")
    patterns = spark.createDataFrame([("ATCG" * (pattern_length // 4),)], "pattern string").filter("pattern != ''")
    hits = search(texts, patterns).groupBy("algorithm", "text_id").agg(F.count(F.lit(1)).alias("n"))
    grid = algorithms(spark).select("algorithm").crossJoin(texts.select("text_id"))
    return grid.join(hits, ["algorithm", "text_id"], "left").select("algorithm", F.col("text_id").cast("long").alias("size"), F.coalesce("n", F.lit(0)).cast("long").alias("matches"))


def timed(df: DataFrame, repeats: int = 1) -> float:
    """Mean wall seconds of running a frame to its end, nothing kept."""
    import time

    began = time.perf_counter()
    for _ in range(repeats):
        df.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) / max(1, repeats)
