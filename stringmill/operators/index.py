"""Index tables derived from patterns (pattern) and texts (text_id, text)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from . import exact


def letters(patterns: DataFrame) -> DataFrame:
    """(pattern, i, ch) of each character."""
    own = F.filter(F.split("pattern", ""), lambda c: c != "")
    return patterns.select("pattern").distinct().select("pattern", F.posexplode(own).alias("i", "ch"))


def borders(pattern: str) -> list[int]:
    """Length of the longest proper border of each prefix."""
    out = [0] * len(pattern)
    for i in range(1, len(pattern)):
        k = out[i - 1]
        while k and pattern[k] != pattern[i]:
            k = out[k - 1]
        out[i] = k + (pattern[k] == pattern[i])
    return out


def failure_function(patterns: DataFrame) -> DataFrame:
    """(pattern, i, failure): length of the longest proper border of the prefix that ends at i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                if p:
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(p), pa.string()), pa.array(range(len(p)), pa.int64()), pa.array(borders(p), pa.int64())], ["pattern", "i", "failure"])

    return patterns.select("pattern").distinct().mapInArrow(run, "pattern string, i long, failure long")


def bad_characters(patterns: DataFrame, seeded: str = "") -> DataFrame:
    """(pattern, ch, last_pos): rightmost place of each character; ``seeded`` characters get -1 where absent."""
    last = letters(patterns).groupBy("pattern", "ch").agg(F.max("i").cast("long").alias("last_pos"))
    if not seeded:
        return last
    more = patterns.select("pattern").distinct().select("pattern", F.explode(F.array(*map(F.lit, seeded))).alias("ch"), F.lit(-1).cast("long").alias("last_pos"))
    return last.union(more).groupBy("pattern", "ch").agg(F.max("last_pos").alias("last_pos"))


def good_suffix_shifts(pattern: str) -> list[int]:
    """Shift of a right-to-left search after a mismatch at each place, by definition.

    The least shift that puts the suffix after the place on an equal part of the
    pattern, with another character before it; if there is none, the start of the
    widest border that begins at the place or later.
    """
    m = len(pattern)

    def inner(i: int) -> int | None:
        tail = pattern[i + 1 :]
        return next((s for s in range(1, i + 1) if pattern[i - s] != pattern[i] and pattern.startswith(tail, i + 1 - s)), None)

    borders = [b for b in range(1, m + 1) if pattern.startswith(pattern[b:])]
    return [inner(i) or next(b for b in borders if b >= i) for i in range(m)]


def good_suffixes(patterns: DataFrame) -> DataFrame:
    """(pattern, i, shift)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, s) for p in batch.column(0).to_pylist() if p for i, s in enumerate(good_suffix_shifts(p))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["pattern", "i", "shift"])

    return patterns.select("pattern").distinct().mapInArrow(run, "pattern string, i long, shift long")


def character_masks(patterns: DataFrame) -> DataFrame:
    """(pattern, ch, present, shift_or): set bits where the character is, and their complement within the pattern.

    For patterns of up to 62 characters; longer ones do not fit one word, see ``character_mask_words``.
    """
    own = letters(patterns.filter(F.length("pattern") <= 62))
    bits = own.groupBy("pattern", "ch").agg(F.sum(F.pow(F.lit(2.0), F.col("i")).cast("long")).alias("present"))
    return bits.select("pattern", "ch", "present", (F.pow(F.lit(2.0), F.length("pattern")).cast("long") - 1 - F.col("present")).alias("shift_or"))


def character_mask_words(patterns: DataFrame) -> DataFrame:
    """(pattern, ch, word, present, shift_or): the masks of patterns of any length, in words of 62 characters from the first."""
    own = letters(patterns)
    word = F.floor(F.col("i") / 62).cast("int")
    bits = own.groupBy("pattern", "ch", word.alias("word")).agg(F.sum(F.pow(F.lit(2.0), F.col("i") % 62).cast("long")).alias("present"))
    # A word without the character has a row as well.
    words = own.select("pattern", "ch").distinct().withColumn("word", F.explode(F.sequence(F.lit(0), F.floor((F.length("pattern") - 1) / 62).cast("int"))))
    size = F.least(F.lit(62), F.length("pattern") - F.col("word") * 62)
    both = words.join(bits, ["pattern", "ch", "word"], "left").withColumn("present", F.coalesce("present", F.lit(0).cast("long")))
    return both.select("pattern", "ch", "word", "present", (F.pow(F.lit(2.0), size).cast("long") - 1 - F.col("present")).alias("shift_or"))


def window_hashes(texts: DataFrame, length: int, base: int = 256, prime: int = 101) -> DataFrame:
    """(text_id, pos, hash) of each window of ``length``."""
    kind = texts.schema["text_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                h = A.window_hashes(text or "", length, base, prime)
                if len(h):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(h), k, np.int32))), pa.array(np.arange(len(h))), pa.array(h)], ["text_id", "pos", "hash"])

    return texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, pos long, hash long")


def leading_power(length: int, base: int = 256, prime: int = 101) -> int:
    """The factor of a window's first character in its hash."""
    return pow(base, length - 1, prime)


def suffix_counts(texts: DataFrame, length: int = exact.SUFFIX_LENGTH) -> DataFrame:
    """How often each cut suffix occurs: (suffix, n)."""
    return exact.suffixes(texts, length).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))


def trie_sizes(texts: DataFrame) -> DataFrame:
    """(text_id, nodes, depth) of the trie of all suffixes of each text.

    Nodes are 1 + the number of different substrings, which the order of the suffixes
    tells; the depth is the text's length.
    """
    kind = texts.schema["text_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in A.runs_of_texts(own):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_substrings_of_each(own[a:b]) + 1), pa.array([len(t) for t in own[a:b]], pa.int64())], ["text_id", "nodes", "depth"])

    return texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, nodes long, depth long")


def _substrings_of_each(texts: list[str]) -> np.ndarray:
    """Number of different substrings of each text: all, less those that a suffix shares with the one before it in the order."""
    _, shared, ends = A.suffix_orders_of(texts)
    starts = np.append(0, ends[:-1] + 1)
    n = ends - starts
    return n * (n + 1) // 2 - np.add.reduceat(shared, starts)


def _substrings(text: str) -> int:
    return int(_substrings_of_each([text])[0])
