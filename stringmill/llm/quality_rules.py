"""Quality rules whose cutoffs carry a guarantee, stratum by stratum.

A rule rejects a document whose statistic exceeds a cutoff.  On labelled documents
of good quality, the number of false rejections at a cutoff is binomial; an exact
test (the Clopper-Pearson bound turned round) tells whether the true share is at
most ``risk``.  For each rule and stratum the cutoffs are tested from the loosest
to the strictest and the last one before the first failure is kept: this fixed
order needs no correction over cutoffs.  The chance of an error is split evenly over
strata and by ``WEIGHTS`` over rules (Bonferroni), the risk by ``SHARES`` over rules.  With
probability 1 - ``delta`` then, in every stratum at once, the rules together reject at
most ``risk`` of the good documents.

A stratum with too few labels for any cutoff to pass is merged with the next larger
one, again until there are enough; the guarantee then is that of the merged stratum.
``labels_needed`` gives the number: 304 good labels with one stratum, 429 with four,
for the rule with the largest share of the risk, and 1764 or 2225 for the others.  If
all strata together have fewer, there are no rules beyond the base.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textstats

RISK = 0.02
DELTA = 0.05
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Cutoffs of each rule, loosest first; fixed before any label is seen.
_SHARE = tuple(round(1 - k / 40, 3) for k in range(1, 38)) + (0.06, 0.045, 0.03, 0.02, 0.015, 0.01, 0.0075, 0.005)
GRIDS: dict[str, tuple[float, ...]] = {"symbol_share": _SHARE, "repeat_share": _SHARE, "dup_line_share": _SHARE, "upper_share": _SHARE}
#: Part of the risk that each rule may use; a larger part needs fewer labels.
SHARES = {"symbol_share": 0.55, "repeat_share": 0.15, "dup_line_share": 0.15, "upper_share": 0.15}
#: Part of the chance of an error that each rule may use.
WEIGHTS = {"symbol_share": 0.7, "repeat_share": 0.1, "dup_line_share": 0.1, "upper_share": 0.1}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n), exact."""
    if k >= n:
        return 1.0
    total, log_p, log_q = 0.0, math.log(p), math.log1p(-p)
    for i in range(k + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q)
    return min(1.0, total)


def pick_cutoff(grid: tuple[float, ...], rejected: list[int], n: int, risk: float, level: float) -> float | None:
    """The strictest cutoff before the first one whose share of false rejections isn't shown to be at most ``risk``."""
    best = None
    for cutoff, k in zip(grid, rejected):
        if n == 0 or k > n * risk or binomial_tail(k, n, risk) > level:
            break
        best = cutoff
    return best


def labels_needed(rule: str, strata: int, *, risk: float = RISK, delta: float = DELTA) -> int:
    """The fewest good labels of a stratum with which a cutoff that rejects none of them passes."""
    return math.ceil(math.log(delta * WEIGHTS[rule] / strata) / math.log1p(-risk * SHARES[rule]))


def merge_strata(sizes: dict[str, int], need: Callable[[int], int]) -> list[list[str]]:
    """Groups of strata, each with ``need(number of groups)`` labels or more, or one group of all.

    The two smallest are merged as long as the smallest has too few (ties: by name).
    Only numbers of labels decide, so the tests stay exact.
    """
    groups = sorted((n, [s]) for s, n in sizes.items())
    while len(groups) > 1 and groups[0][0] < need(len(groups)):
        (a, x), (b, y), *rest = groups
        groups = sorted([(a + b, sorted(x + y)), *rest])
    return [names for _, names in groups]


def calibrate(good: DataFrame, stratum: str, *, risk: float = RISK, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule, from the statistics of all good labelled documents.

    Only counts are collected: a row a stratum, with one number a rule and cutoff.
    """
    sums = [F.sum((F.col(rule) > cutoff).cast("long")).alias(f"{rule}_{k}") for rule, grid in GRIDS.items() for k, cutoff in enumerate(grid)]
    rows = {r[stratum]: r for r in good.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    groups = merge_strata({s: r["n"] for s, r in rows.items()}, lambda strata: min(labels_needed(rule, strata, risk=risk, delta=delta) for rule in GRIDS))
    out: dict[str, dict[str, float]] = {}
    for names in groups:
        own = [rows[s] for s in names]
        n = sum(r["n"] for r in own)
        found = {}
        for rule, grid in GRIDS.items():
            rejected = [sum(r[f"{rule}_{k}"] for r in own) for k in range(len(grid))]
            found[rule] = pick_cutoff(grid, rejected, n, risk * SHARES[rule], delta * WEIGHTS[rule] / len(groups))
        out |= dict.fromkeys(names, {rule: c for rule, c in found.items() if c is not None})
    return out


def passes(cutoffs: dict[str, dict[str, float]], stratum: Column) -> Column:
    """True unless a rule of the row's stratum rejects it."""
    tests = []
    for rule in GRIDS:
        own = [(s, c[rule]) for s, c in cutoffs.items() if rule in c]
        if own:
            of = F.create_map(*[F.lit(x) for pair in own for x in pair])
            tests.append(F.coalesce(F.col(rule) <= F.try_element_at(of, stratum), F.lit(True)))
    return reduce(Column.__and__, tests, F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``docs`` has doc_id, text and ``stratum``; ``labels`` has doc_id and quality.
    Null text: no words, so it fails the base.  Null stratum: a stratum of its own,
    apart from that of the empty string.  A stratum without labels: no rules.  Very
    long texts are counted whole.  Ties: a statistic equal to its cutoff passes.
    Null doc_id: judged, never labelled.  Repeated rows: each is judged.  Several
    labels of one document: the lowest counts; null labels count for nothing.
    Empty tables: no rows, or no rules beyond the base.  Other columns are ignored.
    """
    of = F.col("stratum").cast("string")
    rows = common.only(docs, "doc_id", stratum, "text").toDF("doc_id", "stratum", "text")
    # A mark before each name, none for null.
    rows = rows.withColumn("stratum", F.when(of.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), of)))
    stats = common.materialize(textstats.statistics(rows, "doc_id", "stratum").withColumns(textstats.shares()), "statistics")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    quality = common.only(labels, "doc_id", "quality").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    # Documents that the base rejects are no longer the rules' to reject.
    good = stats.filter(~failed).join(quality, "doc_id")
    cutoffs = calibrate(good, "stratum", risk=risk, delta=delta)
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & passes(cutoffs, F.col("stratum"))).alias("kept"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged by the base and by rules calibrated on their labels."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
