"""Counters of a search's steps; ``payload`` has the steps themselves.

``texts`` has (text_id, text), ``patterns`` (pattern).  A pair with an empty text or
pattern, or a pattern longer than the text, has no trace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from . import approx, exact
from .index import borders


def pairs(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    return exact.pair(texts, patterns).filter((F.length("pattern") > 0) & (F.length("text") >= F.length("pattern")))


def _counted(texts: DataFrame, patterns: DataFrame, schema: str, count: Callable[[str, str], tuple]) -> DataFrame:
    """text_id, pattern and the columns of ``schema``, of which ``count`` gives one row for each pair (none: no row)."""
    both = pairs(texts, patterns).select("text_id", "pattern", "text")
    whole = f"text_id {texts.schema['text_id'].dataType.simpleString()}, pattern string, {schema}"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *row) for k, (p, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) if (row := count(t, p)) is not None]
            columns = list(zip(*found)) or [()] * (1 + len(names))
            own = pa.array(columns[0], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *map(pa.array, columns[1:], kinds)], ["text_id", "pattern", *names])

    return both.mapInArrow(run, whole)


def percent(part: int, whole: int) -> str:
    return f"{100 * part / whole:.1f}%" if whole else "N/A"


def naive(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Comparisons of the naive search by outcome, hits, worst case, average and efficiency in percent."""
    c = exact.window_counts(texts, patterns).filter((F.col("n") >= F.col("m")) & (F.col("m") > 0))
    # Every window but a hit ends in one failed comparison.
    failed = F.col("positions") - F.col("matches")
    return c.select(
        "text_id", "pattern", F.col("comparisons").alias("total_comparisons"), (F.col("comparisons") - failed).alias("successful_comparisons"), failed.alias("failed_comparisons"),
        F.col("positions").alias("positions_checked"), F.col("matches").alias("matches_found"), (F.col("n") * F.col("m")).alias("worst_case_comparisons"),
        F.round(F.col("comparisons") / F.col("positions"), 6).alias("average_comparisons"), F.round(100 * F.col("matches") / F.col("comparisons"), 6).alias("efficiency"),
    )


def _kmp(text: str, pattern: str) -> tuple:
    """The state behind a character is the longest prefix that ends there; a fall passes each shorter one that ended before it and does not go on."""
    n, m = len(text), len(pattern)
    ends = A.ending_prefixes(text, pattern)
    state = (ends * np.arange(1, m + 1)[:, None]).max(axis=0)
    falls = 0
    if m > 1:
        went_on = np.maximum(state[1:] - 1, 0)
        falls = int((ends[: m - 1, :-1] & (np.arange(1, m)[:, None] > went_on)).sum())
    same, hits = int((state > 0).sum()), int((state == m).sum())
    return n, same, n - same, falls, hits, percent(n - falls, n), borders(pattern)


def kmp(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Failure-function search: one comparison a character counted, falls back counted apart; share of characters without a fall; the failure function."""
    names = ("total_comparisons", "successful_comparisons", "failed_comparisons", "backtrack_count", "matches_found")
    return _counted(texts, patterns, ", ".join(f"{n} long" for n in names) + ", efficiency string, failure_function array<int>", _kmp)


def shifts(text: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """At each place where the pattern may lie: characters that agree from its end, and the bad-character rule's shift.

    Behind a hit the rule looks at the character after it, and its shift may be 0.
    """
    n, m = len(text), len(pattern)
    same = A.suffix_lengths(text, pattern)
    letters = A.codes(text)
    last = np.full(n, -1, np.int64)
    for k, c in enumerate(A.codes(pattern)):
        last[letters == c] = k
    at = np.arange(len(same))
    wrong = m - 1 - same
    rule = np.maximum(1, wrong - last[np.minimum(at + np.maximum(wrong, 0), n - 1)])
    after = np.where(at + m < n, m - 1 - last[np.minimum(at + m, n - 1)], 1)
    return same, np.where(same == m, after, rule)


def visited(shift: np.ndarray) -> list[int]:
    """The places at which a search looks that moves on by the shift, by one at least."""
    following, at, out = (np.arange(len(shift)) + np.maximum(shift, 1)).tolist(), 0, []
    while at < len(following):
        out.append(at)
        at = following[at]
    return out


def _bad_character(text: str, pattern: str) -> tuple:
    m = len(pattern)
    same, shift = shifts(text, pattern)
    own = np.array(visited(shift))
    agreed, hits, shifted = int(same[own].sum()), int((same[own] == m).sum()), int(shift[own].sum())
    different, count = len(own) - hits, len(own)
    return agreed + different, agreed, different, count, shifted, shifted - count, hits, percent(shifted - count, len(text))


def boyer_moore(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Right-to-left search with the bad-character rule; shifts are counted as the rule gives them, even where 0; share of characters skipped."""
    names = ("total_comparisons", "successful_comparisons", "failed_comparisons", "alignments_checked", "total_shifts", "characters_skipped", "matches_found")
    return _counted(texts, patterns, ", ".join(f"{n} long" for n in names) + ", skip_efficiency string", _bad_character)


def suffix_trie(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Walk of a pattern down the trie of suffixes: nodes_visited, pattern_found, matches_found."""
    both = pairs(texts, patterns)
    m = F.length("pattern")
    prefixes = F.transform(F.sequence(F.lit(1), m), lambda k: F.substring(F.col("pattern"), F.lit(1), k))
    known = F.size(F.filter(prefixes, lambda x: F.contains(F.col("text"), x)))
    found = known == m
    n = F.regexp_count("text", T.lookahead(F.col("pattern")))
    # The step at which a character is missing is visited as well.
    return both.select("text_id", "pattern", F.when(found, m).otherwise(known + 1).cast("long").alias("nodes_visited"), found.alias("pattern_found"), F.when(found, n).otherwise(F.lit(0)).cast("long").alias("matches_found"))


def rolling_hash(texts: DataFrame, patterns: DataFrame, base: int = 256, prime: int = 101) -> DataFrame:
    """Windows whose hash is compared, characters then compared, hash hits that are no hits."""

    def count(text: str, pattern: str) -> tuple:
        m, same = len(pattern), A.prefix_lengths(text, pattern)
        agree = A.window_hashes(text, m, base, prime) == exact.rolled(pattern, base, prime)
        hits = int((same[agree] == m).sum())
        return len(same), int(np.minimum(same[agree] + 1, m).sum()), int(agree.sum()) - hits, hits

    return _counted(texts, patterns, "hash_comparisons long, character_comparisons long, spurious_hits long, matches_found long", count)


def levenshtein_cells(texts: DataFrame, patterns: DataFrame, most: int = 1) -> DataFrame:
    """Cells of the distance tables filled, start by start, until the first length within ``most``."""
    names = ("total_cells_computed", "positions_checked", "matches_found")
    both = exact.pair(texts, patterns).filter((F.length("pattern") > 0) & (F.length("text") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = [], []
            for k, (p, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                m, starts = len(p), min(len(t), len(t) - len(p) + most + 1)
                if starts <= 0:
                    continue
                lengths, dist = approx.start_distances(t, p, most)
                fits = np.arange(starts) + lengths[:, None] <= len(t)
                good = (dist[:, :starts] <= most) & fits
                stop = np.where(good.any(axis=0), lengths[good.argmax(axis=0)], m + most)
                cells = (lengths[:, None] * m * (fits & (lengths[:, None] <= stop))).sum()
                checked = int(fits.any(axis=0).sum())
                if checked:
                    rows.append((int(cells), checked, int(good.any(axis=0).sum())))
                    kept.append(k)
            own = pa.array(kept, pa.int32())
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(c, pa.int64()) for c in columns)], ["text_id", "pattern", *names])

    kind = texts.schema["text_id"].dataType.simpleString()
    return both.select("text_id", "pattern", "text").mapInArrow(run, f"text_id {kind}, pattern string, " + ", ".join(f"{n} long" for n in names))


def shift_or_counters(texts: DataFrame, patterns: DataFrame, most: int = 1) -> DataFrame:
    """Shifts and unions of the bit states; at one error level or more the trace reports every window as a match."""
    n, m = F.length("text").cast("long"), F.length("pattern")
    hits = (n - m + 1).cast("long") if most else F.regexp_count("text", T.lookahead(F.col("pattern"))).cast("long")
    return pairs(texts, patterns).select("text_id", "pattern", (n * (1 + 3 * most)).alias("total_shifts"), (n * (1 + most)).alias("total_or_operations"), hits.alias("matches_found"))
