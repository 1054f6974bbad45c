"""Exact search: overlapping hits (six ways), non-overlapping hits, wildcards, counts, comparisons.

Every search takes ``texts`` (text_id, text) and ``patterns`` (pattern), and gives
(text_id, pattern, pos) with 0-based starts, one row a hit.  Empty patterns and
patterns longer than the text have no hits.  The pattern table is the small side by
its nature; it is broadcast in blocks of at most ``BROADCAST_PATTERNS`` rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import arrays as A
from ..functions import text as T

BROADCAST_PATTERNS, BROADCAST_BYTES = 10_000, 32 << 20
#: Characters of the pieces that hits are found in, so that arrays of hits stay short; hits that leave a worker at once.
SPLIT_SIZE, HIT_ROWS = 2048, 100_000
SUFFIX_LENGTH, SUFFIX_PIECE = 32, 32


def blocks(patterns: DataFrame, key: str = "pattern") -> list[DataFrame]:
    """``patterns`` in parts, each under ``BROADCAST_PATTERNS`` rows and about ``BROADCAST_BYTES``, to be broadcast one by one."""
    length = F.octet_length(key) if key in patterns.columns else F.lit(8)
    n, size = patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    parts = max(math.ceil(n / BROADCAST_PATTERNS), math.ceil(size / BROADCAST_BYTES))
    if parts <= 1:
        return [patterns]
    # Hashing deals unevenly; half as many again keeps each part under the bound.
    parts = parts + parts // 2 + 1
    return [patterns.filter(F.pmod(F.xxhash64(*patterns.columns), F.lit(parts)) == k) for k in range(parts)]


def pair(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each text with each pattern; a table of patterns beyond the bounds is broadcast in blocks."""
    return reduce(DataFrame.union, [texts.crossJoin(F.broadcast(p)) for p in blocks(patterns)])


def _searchable(df: DataFrame) -> DataFrame:
    return df.filter((F.length("pattern") > 0) & F.contains(F.col("text"), F.col("pattern")))


def by_split(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Failure-function search's contract, by look-ahead splitting: one pass over each text, piece by piece."""
    return chunked(texts, patterns, SPLIT_SIZE)


def find_all(text: str, pattern: str, step: int = 1) -> list[int]:
    out, at = [], text.find(pattern) if pattern else -1
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + step)
    return out


def _native(texts: DataFrame, patterns: DataFrame, starts, place: str = "pos", *, prepare=None, extra: str | None = None) -> DataFrame:
    """Hits that ``starts`` finds for each text and pattern, and for what ``prepare`` makes of each of the texts or column ``extra`` holds."""
    schema = texts.select("text_id").schema
    kind = f"text_id {schema[0].dataType.simpleString()}, pattern string, {place} long"

    def search(words: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found, at = [], [], []
                own = [t or "" for t in batch.column(1).to_pylist()]
                prepared = prepare(own) if prepare else None
                for k, text in enumerate(own):
                    more = (next(prepared),) if prepare else (batch.column(2)[k].values.to_numpy(),) if extra else ()
                    for w in words:
                        hits = starts(text, w, *more)
                        at += hits
                        ids += [k] * len(hits)
                        found += [w] * len(hits)
                    if len(at) > HIT_ROWS:
                        yield out(batch, ids, found, at)
                        ids, found, at = [], [], []
                yield out(batch, ids, found, at)

        return run

    def out(batch, ids, found, at):
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), pa.array(found, pa.string()), pa.array(at, pa.int64())], ["text_id", "pattern", place])

    parts = [[r[0] for r in p.collect()] for p in blocks(patterns.select("pattern").distinct().filter("pattern != ''"))]
    return reduce(DataFrame.union, [texts.select("text_id", "text", *([extra] if extra else [])).mapInArrow(search(words), kind) for words in parts])


def by_find(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Skip search's contract, by the native substring search over Arrow batches."""
    return _native(texts, patterns, find_all)


def by_windows(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Naive search: every window is compared with the pattern, character by character until they differ."""
    return _native(texts, patterns, window_hits)


def window_hits(text: str, pattern: str) -> list[int]:
    """Starts of the windows that are the pattern; those that differ at a character are left out of all that follow."""
    count = len(text) - len(pattern) + 1
    if count <= 0 or not pattern:
        return []
    letters, (first, *rest) = A.codes(text), A.codes(pattern)
    at = np.flatnonzero(letters[:count] == first)
    for j, c in enumerate(rest, 1):
        at = at[letters[at + j] == c]
    return at.tolist()


def hash_hits(text: str, pattern: str, base: int = 256, prime: int = 101) -> list[int]:
    """Starts of the windows whose hash is the pattern's, and which are the pattern."""
    near = A.window_hashes(text, len(pattern), base, prime) == rolled(pattern, base, prime)
    return [at for at in np.flatnonzero(near).tolist() if text.startswith(pattern, at)]


def by_hash(texts: DataFrame, patterns: DataFrame, base: int = 256, prime: int = 101) -> DataFrame:
    """Rolling-hash search: windows whose hash is the pattern's; characters decide."""
    return _native(texts, patterns, lambda t, p: hash_hits(t, p, base, prime))


def rolled(pattern: str, base: int = 256, prime: int = 101) -> int:
    """The rolling hash of a whole pattern."""
    h = 0
    for c in pattern:
        h = (h * base + ord(c)) % prime
    return h


def suffixes(texts: DataFrame, length: int = SUFFIX_LENGTH) -> DataFrame:
    """The suffix table: text_id, pos and the suffix that starts there, cut to ``length`` characters."""
    # A place in a piece is found by counting from its start, so pieces are short.
    size = max(SUFFIX_PIECE, length)
    pieces = T.chunks(texts.filter(F.length("text") > 0), "text", length - 1, size)
    inside = F.explode(F.sequence(F.lit(0), F.least(F.length("chunk"), F.lit(size)).cast("int") - 1))
    # The overlap of a piece starts no suffix of its own.
    rows = pieces.withColumn("_k", inside)
    return rows.select("text_id", (F.col("start") + F.col("_k")).cast("long").alias("pos"), F.substring("chunk", F.col("_k") + 1, F.lit(length)).alias("suffix"))


def suffix_index(texts: DataFrame) -> DataFrame:
    """(text_id, text, suffixes): each text with the starts of its suffixes in their order.

    Built once, written if wanted, and searched for any patterns by ``by_index``.
    """
    kind = texts.schema["text_id"].dataType.simpleString()
    return texts.select("text_id", "text").mapInArrow(_indexed, f"text_id {kind}, text string, suffixes array<int>")


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch for each run of texts: a batch a text takes nearly as long as the orders."""
    for batch in batches:
        own = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in A.runs_of_texts(own):
            orders = list(A.suffix_orders_each(own[a:b]))
            offsets = np.cumsum([0, *map(len, orders)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(orders)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], ["text_id", "text", "suffixes"])


def by_index(indexed: DataFrame, patterns: DataFrame) -> DataFrame:
    """Suffix search of texts that ``suffix_index`` has prepared: two binary searches a pattern."""
    return _native(indexed, patterns, lambda t, p, order: A.find_in_order(t, order, p), extra="suffixes")


def by_suffixes(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Suffix search: each text's suffixes are put in order once, then searched for all patterns."""
    return _native(texts, patterns, lambda t, p, order: A.find_in_order(t, order, p), prepare=A.suffix_orders_each)


def by_bits(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Shift-or search by masks of characters: a pattern of any length, all places of a text moved on together."""
    return _native(texts, patterns, bit_hits)


def bit_hits(text: str, pattern: str) -> list[int]:
    """Starts of the pattern: the mask of its j-th character, moved back by j, has to be set for every j."""
    count = len(text) - len(pattern) + 1
    if count <= 0:
        return []
    letters, state, masks = np.frombuffer(text.encode("utf-32-le"), "<u4"), np.ones(count, bool), {}
    for j, c in enumerate(pattern):
        if c not in masks:
            masks[c] = letters == ord(c)
        state &= masks[c][j : j + count]
    return np.flatnonzero(state).tolist()


def count_overlapping(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern, n), zero counts too."""
    # Most texts do not hold a pattern, and a plain search is much faster than a look-ahead at every place.
    n = F.when((F.length("pattern") > 0) & F.contains("text", "pattern"), F.regexp_count("text", T.lookahead(F.col("pattern")))).otherwise(F.lit(0))
    return pair(texts, patterns).select("text_id", "pattern", F.coalesce(n, F.lit(0)).cast("long").alias("n"))


def non_overlapping(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Leftmost non-overlapping hits of the escaped pattern: (text_id, pattern, end_pos), ends inclusive."""
    return _native(texts, patterns, lambda t, p: [at + len(p) - 1 for at in find_all(t, p, len(p))], "end_pos")


def regex_matches(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """What an unescaped pattern matches, leftmost and non-overlapping: (text_id, pattern, turn, matched)."""
    found = F.posexplode(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    return pair(texts, patterns).select("text_id", "pattern", found.alias("turn", "matched")).withColumn("turn", F.col("turn").cast("long"))


def regex_starts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Starts of what an unescaped pattern matches, leftmost and non-overlapping: (text_id, pattern, pos, length); empty matches too.

    Patterns are Python's regular expressions; an invalid one is an error.
    """
    for p in blocks(patterns.select("pattern")):
        for r in p.collect():
            re.compile(r[0] or "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, m.start(), m.end() - m.start()) for k, (t, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) if t is not None and p for m in re.finditer(p, t)]
            k, at, n = zip(*found) if found else ((), (), ())
            rows = pa.array(k, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["text_id", "pattern", "pos", "length"])

    both = pair(texts.select("text_id", "text"), patterns.select("pattern"))
    return both.mapInArrow(run, f"text_id {texts.schema['text_id'].dataType.simpleString()}, pattern string, pos long, length long")


def wildcard_search(texts: DataFrame, patterns: DataFrame, any_one: str = "?") -> DataFrame:
    """Overlapping hits of patterns with a one-character wildcard; all else, line ends too, is literal."""
    look = T.wildcard(F.col("pattern"), any_one)
    both = pair(texts, patterns).filter((F.length("pattern") > 0) & (F.length("text") >= F.length("pattern")))
    return _piecewise(both, look, lambda chunk: F.rlike(chunk, F.concat(F.lit("^"), look)), SPLIT_SIZE)


def window_counts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern, n, m, comparisons, matches, positions) of the naive search, a row a pair, zero rows too."""
    both = pair(texts.select("text_id", "text"), patterns.select("pattern")).filter(F.length("pattern") > 0)
    kind = texts.schema["text_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                same = A.prefix_lengths(t or "", p)
                rows.append((None if t is None else len(t), len(p), int(np.minimum(same + 1, len(p)).sum()), int((same == len(p)).sum()), len(same)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5))], ["text_id", "pattern", "n", "m", "comparisons", "matches", "positions"])

    return both.mapInArrow(run, f"text_id {kind}, pattern string, n long, m long, comparisons long, matches long, positions long")


def comparisons(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Characters the naive search compares: (text_id, pattern, comparisons, matches, positions), zero rows too."""
    return window_counts(texts, patterns).drop("n", "m")


def complexity(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Naive search against its worst case; efficiency is null where the worst case is 0."""
    worst = F.greatest(F.col("n") - F.col("m") + 1, F.lit(0)) * F.col("m")
    return window_counts(texts, patterns).select("text_id", "pattern", "n", "m", "matches", "comparisons", worst.alias("worst"), F.round(100 * F.col("comparisons") / F.when(worst > 0, worst), 6).alias("efficiency"))


def chunked(texts: DataFrame, patterns: DataFrame, size: int = 4096) -> DataFrame:
    """Search of texts of any length: pieces with an overlap, a hit owned by the piece in which it starts."""
    return hits_by_pieces(_searchable(pair(texts, patterns)), size)


def hits_by_pieces(pairs: DataFrame, size: int = SPLIT_SIZE) -> DataFrame:
    """The hits of rows (text_id, text, pattern), each pattern not empty; without state, so a stream may be such rows."""
    return _piecewise(pairs, T.lookahead(F.col("pattern")), lambda chunk: F.startswith(chunk, F.col("pattern")), size, F.contains(F.col("chunk"), F.col("pattern")))


def in_pieces(pieces: DataFrame, patterns: DataFrame, search=by_find) -> DataFrame:
    """Hits in sequences that come in pieces (text_id, start, own, text), by places in the whole sequence.

    A hit belongs to the piece whose own letters it starts in; the overlap has to be
    at least as long as the longest pattern but one letter.
    """
    own = pieces.select(F.struct("text_id", "start", "own").alias("text_id"), "text")
    return search(own, patterns).filter("pos < text_id.own").select("text_id.text_id", "pattern", (F.col("text_id.start") + F.col("pos")).alias("pos"))


def _piecewise(both: DataFrame, look: Column, at_start, size: int, holds: Column | None = None) -> DataFrame:
    """Places of a look-ahead in each (text, pattern), piece by piece: time is in proportion to the text, whatever the number of hits."""
    pieces = T.chunks(both, "text", F.length("pattern") - 1, size)
    if holds is not None:
        pieces = pieces.filter(holds)
    hits = T.split_positions(F.col("chunk"), look, at_start(F.col("chunk")))
    return pieces.select("text_id", "pattern", "start", F.explode(hits).alias("k")).filter(F.col("k") < size).select("text_id", "pattern", (F.col("start") + F.col("k")).cast("long").alias("pos"))


def longest_common_substring(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Longest substring of each pair's ``text1`` and ``text2``; ties: the one that starts first in text2; '' if none.

    ``left`` has the key and text1, ``right`` the key and text2.  The suffixes of both
    texts are put in one order; the longest prefix that two neighbours of different
    texts share is the length.  Time is nearly linear in the lengths.
    """
    both = left.join(right, on)
    # Comparing is much work for few bytes, so tasks are not to be merged for their size.
    both = both.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*on).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [common_substring(a or "", b or "") for a, b in zip(*(batch.column(len(on) + k).to_pylist() for k in (0, 1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(on)], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [*on, "common", "length"])

    return both.select(*on, "text1", "text2").mapInArrow(run, ", ".join([*keys, "common string", "length long"]))


def common_substring(a: str, b: str) -> str:
    if not a or not b:
        return ""
    # A letter that neither text has parts them, so no shared prefix reaches over the end of the first.
    first, then = A.codes(a), A.codes(b)
    order, shared = A.suffix_order_and_shared(np.concatenate([first, [max(first.max(), then.max()) + 1], then]))
    second = order > len(a)
    meet = np.append(False, second[1:] != second[:-1])
    # The suffix of the part's own letter shares nothing.
    longest = int(shared[meet].max())
    if not longest:
        return ""
    # Runs of suffixes that share that much; those with suffixes of both texts hold it.
    run = np.cumsum(shared < longest)
    of_first, of_second = np.zeros((2, len(run) + 1), bool)
    of_first[run[~second]] = of_second[run[second]] = True
    start = int(order[second & (of_first & of_second)[run]].min()) - len(a) - 1
    return b[start : start + longest]


def pattern_counts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Hits of each pattern over all texts, patterns without hits too: (pattern, n, texts)."""
    c = count_overlapping(texts, patterns)
    return c.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("texts"))


def text_counts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Hits of all patterns in each text, texts without hits too: (text_id, n)."""
    return count_overlapping(texts, patterns).groupBy("text_id").agg(F.sum("n").alias("n"))


def first_places(hits: DataFrame, most: int = 10) -> DataFrame:
    """(text_id, pattern, n, places): the number of hits (text_id, pattern, pos) of each pair, and the first ``most`` of them, ascending.

    Hits beyond ``most`` are only counted, before they are shuffled.
    """
    key = ["text_id", "pattern"]
    n = hits.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    few = hits.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).filter(F.col("_k") <= most)
    return n.join(few.groupBy(*key).agg(F.sort_array(F.collect_list("pos")).alias("places")), key)


def in_pieces_and_whole(texts: DataFrame, patterns: DataFrame, size: int = 4096) -> DataFrame:
    """(text_id, pattern, whole, pieces, results_match): hits of the search of whole texts and of the search in pieces, and whether they are at the same places."""
    key, side = ["text_id", "pattern"], lambda df, k: df.select("text_id", "pattern", "pos", F.lit(k).alias("side"))
    # A place is in both, or it is a difference; equal counts would not tell.
    both = side(by_find(texts, patterns), 0).union(side(chunked(texts, patterns, size), 1)).groupBy(*key, "pos").agg(F.sum(1 - F.col("side")).alias("w"), F.sum("side").alias("p"))
    found = both.groupBy(*key).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.bool_and(F.col("w") == F.col("p")).alias("same"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return pair(texts.select("text_id"), patterns.select("pattern")).join(found, key, "left").select(*key, zero("w").alias("whole"), zero("p").alias("pieces"), F.coalesce("same", F.lit(True)).alias("results_match"))


class Passages:
    """Patterns by a hash of their beginning: of the largest power of two of characters they have.

    A text's runs of 1, 2, 4, ... characters are hashed by doubling, all at once, so a
    text is passed over a few times, however many patterns there are.
    """

    def __init__(self, rows: list[tuple]):
        self.always = [k for k, p in rows if p == ""]
        self.by_size: dict[int, tuple] = {}
        own: dict[int, dict[int, list]] = {}
        for key, p in rows:
            if p:
                n = 1 << (len(p).bit_length() - 1)
                (hashed,) = (h for size, h in _run_hashes(p[:n], n) if size == n)
                own.setdefault(n, {}).setdefault(int(hashed[0]), []).append((key, p))
        for n, table in own.items():
            bits = max(12, (len(table) * 32).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[np.fromiter(table, np.uint64, len(table)) >> np.uint64(64 - bits)] = True
            self.by_size[n] = (bits, seen, table)
        self.longest = max(own, default=0)

    def held(self, text: str) -> list:
        """Keys of the patterns that the text holds."""
        out = list(self.always)
        for n, h in _run_hashes(text, self.longest):
            if n in self.by_size:
                bits, seen, table = self.by_size[n]
                found = {}
                for at in np.flatnonzero(seen[h >> np.uint64(64 - bits)]).tolist():
                    for key, p in table.get(int(h[at]), ()):
                        if (key, p) not in found and text.startswith(p, at):
                            found[key, p] = None
                out += [key for key, _ in found]
        return out


def _run_hashes(text: str, longest: int):
    """(length, hashes of the runs of that length at each place) for the powers of two up to ``longest``."""
    h, n, odd = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64), 1, np.uint64(0x9E3779B97F4A7C15)
    h = h * odd ^ h * odd >> np.uint64(29)
    while n <= longest and len(h):
        h = h * odd
        yield n, h
        h = (h[: len(h) - n] ^ h[: len(h) - n] >> np.uint64(32)) * odd + h[n:] if len(h) > n else h[:0]
        n *= 2


def holding(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs of text and pattern (pattern_id, pattern) where the text holds the pattern: (text_id, pattern_id)."""
    kinds = texts.schema["text_id"].dataType.simpleString(), patterns.schema["pattern_id"].dataType

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, keys = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    own = [] if text is None else shared.value.held(text)
                    rows += [k] * len(own)
                    keys += own
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(keys, to_arrow_type(kinds[1]))], ["text_id", "pattern_id"])

        return run

    parts = []
    for p in blocks(patterns.select("pattern_id", "pattern").filter(F.col("pattern").isNotNull())):
        shared = texts.sparkSession.sparkContext.broadcast(Passages([tuple(r) for r in p.collect()]))
        parts.append(texts.select("text_id", "text").mapInArrow(search(shared), f"text_id {kinds[0]}, pattern_id {kinds[1].simpleString()}"))
    return reduce(DataFrame.union, parts)


def present(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns that some text holds."""
    return patterns.join(holding(texts, patterns).select("pattern_id").distinct(), "pattern_id", "left_semi").select("pattern_id")


def absent(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns that no text holds."""
    return patterns.join(holding(texts, patterns).select("pattern_id").distinct(), "pattern_id", "left_anti").select("pattern_id")


def first_of_each(df: DataFrame, key: str, order: str, limit: int | None) -> DataFrame:
    """The first ``limit`` rows of each key; all if it is None."""
    if limit is None:
        return df
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= limit).drop("_n")
