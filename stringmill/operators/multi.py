"""Many patterns at once: one pass over each text finds all places of all patterns.

``texts`` has (text_id, text), ``patterns`` (pattern_id, pattern).  The patterns are
put into an Aho-Corasick automaton, which moves one state a character, whatever
their number.  An automaton holds at most ``BLOCK_LETTERS`` characters of patterns and
is broadcast.  A larger table of patterns stays where it is: the windows of the texts
that may be a pattern, by a bit table of the patterns' hashes, are joined to it.  So
the texts are passed over once in both cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact

#: Characters of patterns in one automaton; a state takes some 50 bytes, so this bounds what is broadcast.
BLOCK_LETTERS = 1_000_000
#: Hits that leave a worker at once.
HIT_ROWS = 100_000
#: Places in which the hits of one pattern meet its ids.
SALTS = 16
#: Patterns of this length or longer are looked for by their beginning; bits of the bit table a pattern, and at most; bits of a part of it.
LONG, PATTERN_BITS, MOST_BITS, PART_BITS = 32, 64, 1 << 28, 1 << 15


def automaton(words: list[str]):
    """The automaton of distinct non-empty words; it gives the end of a hit and the number of its word."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, w in enumerate(words):
        out.add_word(w, k)
    out.make_automaton()
    return out


def _hits(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """(text_id, pattern, pos) of patterns that go into one automaton."""
    words = [r[0] for r in distinct.collect()]
    if not words:
        return texts.sparkSession.createDataFrame([], _schema(texts))
    shared = texts.sparkSession.sparkContext.broadcast((automaton(words), words))
    del words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, words = shared.value
        names = pa.array(words, pa.string())

        def out(batch, rows, which, at):
            which = pa.array(which, pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), names.take(which), pa.array(at, pa.int64())], ["text_id", "pattern", "pos"])

        for batch in batches:
            rows, which, at = [], [], []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                for end, w in machine.iter(text) if text else ():
                    rows.append(k)
                    which.append(w)
                    at.append(end - len(words[w]) + 1)
                    if len(rows) >= HIT_ROWS:
                        yield out(batch, rows, which, at)
                        rows, which, at = [], [], []
            if rows:
                yield out(batch, rows, which, at)

    return texts.select("text_id", "text").mapInArrow(run, _schema(texts))


def _schema(texts: DataFrame) -> str:
    return f"text_id {texts.schema['text_id'].dataType.simpleString()}, pattern string, pos long"


def _keys(text: str, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each length a number for each window: of its first and last letters, as many as the largest power of two that fits in; of ``LONG`` or more, which have to be powers, of the first alone."""
    by_power = {}
    for m in lengths:
        by_power.setdefault(1 << (m.bit_length() - 1), []).append(m)
    for n, h in exact._run_hashes(text, max(by_power, default=0)):
        for m in by_power.get(n, ()):
            if len(text) >= m:
                count = len(text) - m + 1
                yield m, (h[:count] * np.uint64(0xD6E8FEB86659FD93 + 2 * m) ^ h[m - n : m - n + count]) * np.uint64(0x9E3779B97F4A7C15)


def _first_bit(keys: np.ndarray, shift: int) -> np.ndarray:
    """The place of each key in the bit table."""
    return keys >> np.uint64(shift)


def _second_bit(keys: np.ndarray, shift: int) -> np.ndarray:
    """Its other place."""
    return (keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(shift)


def _looked_for(m: int) -> int:
    """Letters by which a pattern of ``m`` is looked for."""
    return m if m < LONG else 1 << (m.bit_length() - 1)


def _may_be(texts: DataFrame, distinct: DataFrame, n: int) -> DataFrame:
    """(text_id, size, window, pos) of the windows that are patterns of fewer than ``LONG`` letters, or begin as a longer one, and of few others.

    ``window`` has the ``size`` letters looked for, of longer ones up to twice as many.
    The bit table is put together from the tasks' parts of it, so that its size
    is all that the driver sees of the patterns.
    """
    bits = min(MOST_BITS, max(PART_BITS, 1 << (n * PATTERN_BITS - 1).bit_length()))
    shift = 65 - bits.bit_length()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.zeros(0, np.uint64)]
            for p in batch.column(0).to_pylist():
                size = _looked_for(len(p))
                ((_, key),) = _keys(p[:size], [size])
                places += _first_bit(key, shift), _second_bit(key, shift)
            at = np.concatenate(places).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // PART_BITS), pa.array(at % PART_BITS)], ["part", "bit"])

    table = np.zeros((bits // PART_BITS, PART_BITS // 8), np.uint8)
    for part, own in distinct.mapInArrow(mark, "part long, bit long").groupBy("part").agg(F.bitmap_construct_agg("bit")).toLocalIterator():
        table[part] = np.frombuffer(own, np.uint8)
    sizes = distinct.select(F.length("pattern").alias("m")).select(F.when(F.col("m") < LONG, F.col("m")).otherwise(F.pow(F.lit(2), F.floor(F.log2("m") + 1e-9)).cast("int"))).distinct()
    shared = texts.sparkSession.sparkContext.broadcast((table.ravel(), sorted(r[0] for r in sizes.collect())))

    def held(table, places):
        return table[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lengths = shared.value

        def out(batch, rows, sizes, windows, at):
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(sizes, pa.int32()), pa.array(windows, pa.string()), pa.array(at, pa.int64())], ["text_id", "size", "window", "pos"])

        for batch in batches:
            found, letters = ([], [], [], []), 0
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or ""
                for m, keys in _keys(text, lengths):
                    at = np.flatnonzero(held(table, _first_bit(keys, shift)))
                    at = at[held(table, _second_bit(keys[at], shift)) == 1]
                    reach = m if m < LONG else 2 * m - 1
                    for i in at.tolist():
                        for column, value in zip(found, (k, m, text[i : i + reach], i)):
                            column.append(value)
                        letters += reach
                        if len(found[0]) >= HIT_ROWS or letters > 64 * HIT_ROWS:
                            yield out(batch, *found)
                            found, letters = ([], [], [], []), 0
            if found[0]:
                yield out(batch, *found)

    kind = texts.schema["text_id"].dataType.simpleString()
    return texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, size int, window string, pos long")


def _salt():
    return F.pmod(F.xxhash64("text_id", "pos"), F.lit(SALTS)).cast("int").alias("_salt")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def search(texts: DataFrame, patterns: DataFrame, *, letters: int = BLOCK_LETTERS) -> DataFrame:
    """(text_id, pattern_id, pos): every place of every pattern, overlapping ones too.

    Patterns with one text share its places, each under its own id.  Null and empty
    patterns and texts have no places.  Patterns of more than ``letters`` in all are
    joined to the windows that may be one.
    """
    named = patterns.select("pattern_id", "pattern").filter("pattern != ''")
    distinct = named.select("pattern").distinct()
    n, total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("pattern").cast("long")), F.lit(0))).first()
    # A pattern may have a third of all hits; its ids are copied to as many places as there are salts.
    salted = _salted(named)
    if total <= letters:
        hits = _hits(texts, distinct).withColumn("_salt", _salt())
        return hits.join(salted, ["pattern", "_salt"]).select("text_id", "pattern_id", "pos")
    windows = _may_be(texts, distinct, n).withColumn("_salt", _salt())
    short = windows.filter(F.col("size") < LONG).withColumnRenamed("window", "pattern").join(salted, ["pattern", "_salt"]).select("text_id", "pattern_id", "pos")
    long = salted.filter(F.length("pattern") >= LONG)
    if long.isEmpty():
        return short
    size = F.pow(F.lit(2), F.floor(F.log2(F.length("pattern")) + 1e-9)).cast("int")
    long = long.withColumn("size", size).withColumn("head", F.xxhash64(F.substring("pattern", F.lit(1), F.col("size"))))
    begun = windows.filter(F.col("size") >= LONG).withColumn("head", F.xxhash64(F.substring("window", F.lit(1), F.col("size"))))
    return short.union(begun.join(long, ["size", "head", "_salt"]).filter(F.startswith("window", "pattern")).select("text_id", "pattern_id", "pos"))


def counts(texts: DataFrame, patterns: DataFrame, *, letters: int = BLOCK_LETTERS) -> DataFrame:
    """(pattern_id, n, texts): places of each pattern and texts that have one, patterns without any too.

    Counts are combined by text before they are shuffled to their patterns.
    """
    own = search(texts, patterns, letters=letters).groupBy("pattern_id", "text_id").agg(F.count(F.lit(1)).alias("k")).groupBy("pattern_id").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("texts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return patterns.select("pattern_id").join(own, "pattern_id", "left").select("pattern_id", zero("n"), zero("texts"))
