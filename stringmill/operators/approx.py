"""Approximate search: mismatches, edits, and the two scores kept for compatibility.

``texts`` has (text_id, text), ``patterns`` (pattern).  Starts and ends are 0-based,
ends inclusive.  Recurrences without a column form run in Arrow batches, one text
at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import codes as _codes
from . import exact

Hits = list[tuple[int, int]]
#: Letters of a pattern's pieces from which on they are looked for.
SHORT_PIECE = 5
#: Hits that leave a worker at once, but for those of one text.
HIT_ROWS = 100_000


def _search(texts: DataFrame, patterns: DataFrame, hits: Callable[[str, str], list[tuple]], *names: str) -> DataFrame:
    """text_id, pattern and the columns that ``hits`` gives for each text and pattern: ``names``, dist unless there are more.

    The patterns go to the tasks in blocks, so that a text is handed to Python once a block.
    """
    names = names if len(names) > 1 else (*names, "dist")
    kind = texts.schema["text_id"].dataType.simpleString()

    def search(words: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, which, found = [], [], []
                for k in range(batch.num_rows):
                    text = batch.column(1)[k].as_py() or ""
                    for w in words:
                        own = hits(text, w)
                        found += own
                        rows += [k] * len(own)
                        which += [w] * len(own)
                    if len(rows) > HIT_ROWS:
                        yield out(batch, rows, which, found)
                        rows, which, found = [], [], []
                yield out(batch, rows, which, found)

        return run

    def out(batch: pa.RecordBatch, rows: list[int], which: list[str], found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found) if found else [()] * len(names)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(which, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["text_id", "pattern", *names])

    schema = f"text_id {kind}, pattern string, " + ", ".join(f"{n} long" for n in names)
    parts = [[r[0] or "" for r in p.collect()] for p in exact.blocks(patterns.select("pattern"))]
    return reduce(DataFrame.union, [texts.select("text_id", "text").mapInArrow(search(words), schema) for words in parts])


def mismatches(text: str, pattern: str, most: int) -> Hits:
    """(start, mismatches) of the windows with at most ``most``."""
    n, m = len(text), len(pattern)
    if not m or n < m:
        return []
    # Narrow sums, as long as they hold the pattern's length.
    t, total = _codes(text), np.zeros(n - m + 1, np.uint8 if m < 256 else np.int64)
    for j, c in enumerate(_codes(pattern)):
        total += t[j : n - m + 1 + j] != c
    at = np.flatnonzero(total <= most)
    return list(zip(at.tolist(), total[at].tolist()))


def hamming_search(texts: DataFrame, patterns: DataFrame, most: int = 1) -> DataFrame:
    """(text_id, pattern, pos, dist): overlapping windows with at most ``most`` mismatches."""
    return _search(texts, patterns, lambda t, p: mismatches(t, p, most), "pos")


def _rows(text: np.ndarray, pattern: np.ndarray, first: np.ndarray, left: Callable[[int], int]) -> Iterator[np.ndarray]:
    """Rows of the edit-distance table, pattern down and text across, below the row ``first``.

    ``left`` gives a row's first cell.  A row is computed as a whole: what comes from
    the row above cell by cell, what comes from the left as a running minimum, since
    each step to the right costs one.
    """
    across, row = np.arange(len(text) + 1), first
    for j, c in enumerate(pattern, 1):
        new = np.empty(len(text) + 1, np.int64)
        new[0] = left(j)
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - across) + across
        yield row


def pieces_of(pattern: str, most: int) -> list[tuple[int, str]]:
    """(place, piece): the pattern in ``most`` + 1 parts of about one length; one at least stands whole in whatever is within ``most`` edits."""
    cuts = [len(pattern) * k // (most + 1) for k in range(most + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:])]


def candidate_starts(text: str, pattern: str, most: int) -> np.ndarray:
    """Places at which a substring within ``most`` edits may begin, ascending: near those of a whole piece.

    All places, if the pieces would be so short that they stand everywhere.
    """
    n = len(text)
    if len(pattern) < SHORT_PIECE * (most + 1):
        return np.arange(n)
    found = np.concatenate([np.array(exact.find_all(text, piece), np.int64) - at for at, piece in pieces_of(pattern, most)])
    begin, end = (np.bincount(np.clip(x, 0, n), minlength=n + 1) for x in (found - most, found + most + 1))
    return np.flatnonzero(np.cumsum(begin - end)[:n] > 0)


def edit_ends(text: str, pattern: str, most: int) -> Hits:
    """(end, edits) of the ends at which some substring is within ``most`` edits, the fewest of them.

    Only the neighbourhoods of whole pieces of the pattern go to the distance table,
    one behind the other, parted by letters that no text has; the whole text does if
    they are most of it.
    """
    if not pattern or not text:
        return []
    starts, reach = candidate_starts(text, pattern, most), len(pattern) + most
    if not len(starts):
        return []
    letters, places = _codes(text), None
    first = np.flatnonzero(np.append(True, np.diff(starts) > 1))
    lengths = np.minimum(starts[np.append(first[1:], len(starts)) - 1] + reach, len(text)) - starts[first]
    if (lengths + most + 1).sum() < len(text):
        # Places of each stretch, and behind it as many as no hit can span.
        places = np.concatenate([np.append(np.arange(a, a + n), np.full(most + 1, -1)) for a, n in zip(starts[first].tolist(), lengths.tolist())])
        letters = np.where(places < 0, 0xFFFFFFFF, letters[places])
    row = np.zeros(len(letters) + 1, np.int64)  # a substring may begin anywhere
    for row in _rows(letters, _codes(pattern), row, lambda j: j):
        pass
    at = np.flatnonzero(row[1:] <= most)
    if places is None:
        return list(zip(at.tolist(), row[1 + at].tolist()))
    at = at[places[at] >= 0]
    # Stretches may overlap; each end has its fewest edits in one of them.
    order = np.lexsort((row[1 + at], places[at]))
    ends, edits = places[at][order], row[1 + at][order]
    once = np.append(True, np.diff(ends) > 0)[: len(ends)]
    return list(zip(ends[once].tolist(), edits[once].tolist()))


def edit_search(texts: DataFrame, patterns: DataFrame, most: int = 1) -> DataFrame:
    """(text_id, pattern, end_pos, dist): true semi-global edit distance at each end."""
    return _search(texts, patterns, lambda t, p: edit_ends(t, p, most), "end_pos")


def start_distances(text: str, pattern: str, most: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lengths within ``most`` of the pattern's, and a row a length: the edits of the substring of that length at each of ``starts`` (all, if None).

    All starts go through the table at once, and of a row only the cells near the
    diagonal are kept.  Cells farther than ``most`` from it cost more than that; they,
    and substrings past the text's end, are ``most`` + 1.
    """
    starts = np.arange(len(text)) if starts is None else starts
    n, m, far = len(starts), len(pattern), most + 1
    lengths = np.arange(max(1, m - most), m + most + 1)
    letters = np.append(_codes(text), np.full(m + most, 0xFFFFFFFF, np.uint32))
    beyond = np.full(n, far, np.int32)
    table = {j: np.full(n, j, np.int32) for j in range(most + 1)}
    for i, c in enumerate(_codes(pattern), 1):
        above, table = table, {0: np.full(n, min(i, far), np.int32)} if i <= most else {}
        for j in range(max(1, i - most), i + most + 1):
            step = np.minimum(table.get(j - 1, beyond), above.get(j, beyond)) + 1
            table[j] = np.minimum(np.minimum(step, above.get(j - 1, beyond) + (letters[starts + j - 1] != c)), far)
    return lengths, np.stack([np.where(starts + j <= len(text), table.get(j, beyond), far) for j in lengths.tolist()])


def greedy_hits(text: str, pattern: str, most: int) -> Hits:
    """(start, edits) of the best length at each start; then, from the left, none within a pattern's length of the one before."""
    if not text or not pattern:
        return []
    starts = candidate_starts(text, pattern, most)
    best = start_distances(text, pattern, most, starts)[1].min(axis=0)
    at, best, out, k = starts[best <= most], best[best <= most], [], 0
    while k < len(at):
        out.append((int(at[k]), int(best[k])))
        k = int(np.searchsorted(at, at[k] + len(pattern)))
    return out


def edit_search_greedy(texts: DataFrame, patterns: DataFrame, most: int = 1) -> DataFrame:
    """(text_id, pattern, pos, dist): the best length at each start, then from the left no start within a pattern's length of the one before."""
    return _search(texts, patterns, lambda t, p: greedy_hits(t, p, most), "pos")


def first_lengths(text: str, pattern: str, most: int) -> list[tuple[int, int, int]]:
    """(start, length, edits) of the shortest length within ``most`` at each start."""
    if not text or not pattern:
        return []
    starts = candidate_starts(text, pattern, most)
    lengths, found = start_distances(text, pattern, most, starts)
    at = np.flatnonzero((found <= most).any(axis=0))
    first = (found[:, at] <= most).argmax(axis=0)
    return list(zip(starts[at].tolist(), lengths[first].tolist(), found[first, at].tolist()))


def edit_search_first_length(texts: DataFrame, patterns: DataFrame, most: int = 1) -> DataFrame:
    """(text_id, pattern, pos, len, dist): at each start the shortest length within ``most``; overlaps stay."""
    return _search(texts, patterns, lambda t, p: first_lengths(t, p, most), "pos", "len", "dist")


def banded_hits(text: str, pattern: str, most: int) -> Hits:
    """(end, score): what the pattern costs against the ``most`` + its length characters up to each end.

    Two cases by the window.  One that the text's start cuts short is a prefix of the
    text: its cost is the edit distance, except that no letter of the pattern may
    go before the window's first is used.  A whole window is ``most`` longer than
    the pattern, so within ``most`` all edits are its extra letters: it is a hit, of
    score ``most``, if it holds the pattern's letters in order.
    """
    m, n = len(pattern), len(text)
    if not m:
        return [(i, 0) for i in range(n)]
    letters, wanted = _codes(text), _codes(pattern)
    short = letters[: m + most - 1]
    row = np.arange(len(short) + 1)
    for row in _rows(short, wanted, row, lambda j: m + n + most):
        pass
    at = np.flatnonzero(row[1:] <= most)
    out = list(zip(at.tolist(), row[1 + at].tolist()))
    if n < m + most:
        return out
    # Behind the first of each letter in turn, from every start at once.
    reached = np.arange(n - m - most + 1)
    for c in wanted:
        places = np.append(np.flatnonzero(letters == c), n)
        reached = np.minimum(places[np.searchsorted(places, np.minimum(reached, n))] + 1, n + 1)
    starts = np.flatnonzero(reached <= np.arange(len(reached)) + m + most)
    return out + [(s + m + most - 1, most) for s in starts.tolist()]


def levenshtein_banded_compat(texts: DataFrame, patterns: DataFrame, most: int = 1) -> DataFrame:
    """(text_id, pattern, end_pos, dist): distance of the pattern to the one window of most + its length that ends there.

    Kept for compatibility; ``edit_search`` is edit-distance search.
    """
    return _search(texts, patterns, lambda t, p: banded_hits(t, p, most), "end_pos")


def difference_scores(text: str, pattern: str, most: int) -> Hits:
    """(end, score) of the ends whose score is at most ``most``.

    Take the edit distances of the pattern's prefixes to the text up to the end, and
    the differences of each to the next shorter one.  If the last difference is +1,
    the score is the number of differences that are not; else, of those that are -1.
    """
    m, n = len(pattern), len(text)
    if not m:
        return [(i, 0) for i in range(n)]
    above = np.arange(n + 1)
    rises, falls, last = np.zeros(n, np.int64), np.zeros(n, np.int64), None
    for row in _rows(_codes(text), _codes(pattern), above, lambda j: j):
        last = (row - above)[1:]
        rises += last == 1
        falls += last == -1
        above = row
    score = np.where(last == 1, m - rises, falls)
    at = np.flatnonzero(score <= most)
    return list(zip(at.tolist(), score[at].tolist()))


def bitvector_score_compat(texts: DataFrame, patterns: DataFrame, most: int = 1) -> DataFrame:
    """(text_id, pattern, end_pos, score): kept for compatibility; the score is no edit distance."""
    return _search(texts, patterns, lambda t, p: difference_scores(t, p, most), "end_pos", "score")


def align(pattern: str, text: str) -> tuple[str, str, list[str]]:
    """An alignment of least cost, read back from the end: equal characters match; else substitute, delete, insert, whichever is first among the cheapest.

    Rows of the table are computed whole and forgotten; two bits a cell say where it
    came from.
    """
    m, n = len(pattern), len(text)
    letters, above = _codes(text), np.arange(n + 1)
    ups, lefts = [], []
    for row, c in zip(_rows(letters, _codes(pattern), above, lambda j: j), _codes(pattern)):
        other = letters != c
        straight, up, left = above[:-1], above[1:], row[:-1]
        ups.append(np.packbits(other & (up < straight) & (up <= left)))
        lefts.append(np.packbits(other & (left < straight) & (left < up)))
        above = row
    bit = lambda rows, i, j: rows[i][j >> 3] >> (7 - (j & 7)) & 1
    steps: list[tuple[str, str, str]] = []
    while m or n:
        if not m or n and bit(lefts, m - 1, n - 1):
            kind = "insert"
        elif not n or bit(ups, m - 1, n - 1):
            kind = "delete"
        else:
            kind = "match" if pattern[m - 1] == text[n - 1] else "substitute"
        up, left = kind != "insert", kind != "delete"
        steps.append((pattern[m - 1] if up else "-", text[n - 1] if left else "-", kind))
        m, n = m - up, n - left
    steps.reverse()
    return "".join(s[0] for s in steps), "".join(s[1] for s in steps), [s[2] for s in steps]


def alignments(pairs: DataFrame) -> DataFrame:
    """pairs (pattern, text) with pattern_aligned, text_aligned, operations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [align(p or "", t or "") for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            a, b, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.list_(pa.string()))], ["pattern", "text", "pattern_aligned", "text_aligned", "operations"])

    return pairs.select("pattern", "text").mapInArrow(run, "pattern string, text string, pattern_aligned string, text_aligned string, operations array<string>")


def distances(left: DataFrame, right: DataFrame, most: int | None = None) -> DataFrame:
    """Levenshtein distance of every (a, b), a row a pair of rows; of those within ``most``, if given, a row a pair of different values, found by their segments."""
    if most is None:
        return left.crossJoin(right).select("a", "b", F.levenshtein("a", "b").cast("long").alias("dist"))
    own = lambda df, c: df.select(F.col(c).alias("s")).filter("s IS NOT NULL")
    return _verified(_meeting(own(left, "a"), own(right, "b"), most), most)


# Bits: the steps between neighbouring cells of a column of the distance table, 64 to a word.

#: Letters of a piece that moves on with others in step.
BIT_PIECE = 1024


def bit_ends(texts: list[str], pattern: str, most: int) -> list[Hits]:
    """For each text what ``edit_ends`` gives, by bits, all texts in step.

    A column of the table is kept as the places where it rises or falls by one from
    cell to cell.  A letter of the text makes a column of the last one by a few
    operations on words; what leaves a word at its top, a carry or a step, enters the
    next.  The last cell's steps to the right add up to the edits.  Texts are cut into
    pieces that begin as far before their own letters as a hit can reach, so that all
    pieces have about one length.
    """
    m = len(pattern)
    if not m:
        return [[] for _ in texts]
    back, words = m + most, -(-m // 64)
    own = [(k, a) for k, t in enumerate(texts) for a in range(0, len(t), max(BIT_PIECE, back))]
    if not own:
        return [[] for _ in texts]
    letters = np.array(sorted({ord(c) for c in pattern}), np.uint32)
    # A row a letter, and one without bits for all others.
    masks = np.zeros((len(letters) + 1, words), np.uint64)
    for j, c in enumerate(pattern):
        masks[np.searchsorted(letters, ord(c)), j // 64] |= np.uint64(1 << j % 64)
    codes = [_codes(t) for t in texts]
    cut = [codes[k][max(0, a - back) : a + max(BIT_PIECE, back)] for k, a in own]
    longest = max(map(len, cut))
    symbols = np.full((longest, len(cut)), len(letters), np.int64)
    for row, c in enumerate(cut):
        at = np.minimum(np.searchsorted(letters, c), len(letters) - 1)
        symbols[: len(c), row] = np.where(letters[at] == c, at, len(letters))
    one, top, last = np.uint64(1), np.uint64(63), np.uint64((m - 1) % 64)
    rises, falls = np.full((words, len(cut)), np.uint64(2**64 - 1)), np.zeros((words, len(cut)), np.uint64)
    edits, table = np.full(len(cut), m, np.int64), np.empty((longest, len(cut)), np.int32)
    for j, symbol in enumerate(symbols):
        same = masks[symbol].T
        # Above the first cell a hit may begin anywhere: no step.
        plus, minus = np.zeros(len(cut), np.uint64), np.zeros(len(cut), np.uint64)
        for w in range(words):
            up, down, eq = rises[w], falls[w], same[w]
            straight = eq | minus
            # Adding carries an equal letter along a run of rises.
            level = (((straight & up) + up) ^ up) | straight
            right, left = down | ~(level | up), up & level
            out = last if w == words - 1 else top
            new_plus, new_minus = right >> out & one, left >> out & one
            right, left = right << one | plus, left << one | minus
            rises[w], falls[w] = left | ~(eq | down | right), right & (eq | down)
            plus, minus = new_plus, new_minus
        edits += plus.astype(np.int64) - minus.astype(np.int64)
        table[j] = edits
    found: list[Hits] = [[] for _ in texts]
    for row, ((k, a), c) in enumerate(zip(own, cut)):
        skipped = min(a, back)
        column = table[skipped : len(c), row]
        at = np.flatnonzero(column <= most)
        found[k] += zip((at + a).tolist(), column[at].tolist())
    return found


def edit_search_bits(texts: DataFrame, patterns: DataFrame, most: int = 1, together: int = 256) -> DataFrame:
    """(text_id, pattern, end_pos, dist): what ``edit_search`` gives, by bits; ``together`` texts move on in step."""
    kind = texts.schema["text_id"].dataType.simpleString()
    names = ["text_id", "pattern", "end_pos", "dist"]

    def search(words: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, together):
                    part = batch.slice(at, together)
                    own = [t or "" for t in part.column(1).to_pylist()]
                    for w in words:
                        rows, ends, edits = [], [], []
                        for k, hits in enumerate(bit_ends(own, w, most)):
                            rows += [k] * len(hits)
                            ends += [h[0] for h in hits]
                            edits += [h[1] for h in hits]
                        if rows:
                            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array([w] * len(rows), pa.string()), pa.array(ends, pa.int64()), pa.array(edits, pa.int64())], names)

        return run

    parts = [[r[0] for r in p.collect()] for p in exact.blocks(patterns.select("pattern").filter("pattern != ''"))]
    return reduce(DataFrame.union, [texts.select("text_id", "text").mapInArrow(search(words), f"text_id {kind}, pattern string, end_pos long, dist long") for words in parts])


# Joins of strings within an edit distance.

#: Letters of strings whose segments make one task of a join of many strings.
TASK_LETTERS = 16_000_000
#: Leading bits of a length that strings share whose segments meet.
LENGTH_BITS = 4
#: Letters that are counted in each string; any will do.
COUNTED = "aeinorst"
#: Codes of the numbers modulo 8, 4 bits each from the last: as many bits differ as the numbers are apart.
CODES = 0x8CEF7310
#: Strings of candidate pairs whose hashes are broadcast to fetch them; more are fetched by a shuffle of all strings.
FEW_STRINGS = 2_000_000


def _base(length: str) -> str:
    """SQL of a length with all but its leading bits 0."""
    return f"({length}) - ({length}) % shiftleft(1, greatest(0, length(bin({length})) - {LENGTH_BITS}))"


def _windows(most: int) -> list[tuple[int, int]]:
    """(segment, letters moved) of a string's windows, those not moved first."""
    return [(i, 0) for i in range(most + 1)] + [(i, d) for i in range(most + 1) for d in range(1, min(i, most - i) + 1)]


def _window(i: int, moved: int, most: int) -> str:
    """SQL of the hash of a window of a string."""
    cut, end = (f"CAST(floor(base * {k} / {most + 1}) AS INT)" for k in (i, i + 1))
    start = f"{cut} + length - base" if 2 * i > most else cut
    return f"xxhash64(base, {i}, substring(s, {start} + {moved + 1}, {end} - {cut}))"


def _about() -> str:
    """SQL of the codes of a string's length and counts of some letters and of all others, below bits of a second hash."""
    counts = [f"(length(s) - length(replace(s, '{x}', '')))" for x in COUNTED]
    counts += [f"(length(s) - {' - '.join(counts)})", "length(s)"]
    codes = [f"shiftright({CODES}, ({c} & 7) * 4) & 15" for c in counts]
    return " | ".join(f"shiftleft({c}, {4 * k})" for k, c in enumerate([*codes, "xxhash64(1, s)"]))


def _near(x: Column, y: Column, most: int) -> Column:
    """Whether two strings' counts can be those of strings within ``most`` edits.

    Each edit adds 1 to one count at most, and takes 1 from one.  So what is added and
    what is taken are ``most`` each at most; they and the difference of the
    lengths, which is theirs, are together twice the larger of them.
    """
    return F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit((1 << 4 * len(COUNTED) + 8) - 1))) <= 2 * most


def _parts(strings: DataFrame, name: str) -> int | None:
    """Parts for tasks of about ``TASK_LETTERS`` letters; None if Spark's own number is enough."""
    letters = strings.agg(F.sum(F.length(name).cast("long"))).first()[0] or 0
    parts = math.ceil(letters / TASK_LETTERS)
    return parts if parts > int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return df.repartition(parts, *keys) if parts else df


def _segments(strings: DataFrame, most: int, parts: int | None) -> DataFrame:
    """(id, about, place, h): hashes of the windows of each different string (column ``s``) that stand for it where strings meet.

    Of two strings within ``most`` edits, cut into ``most`` + 1 segments from 0, one
    segment i is whole behind at most i edits and before at most ``most`` - i.  So it
    is moved by no more than that, from the beginning or from the end, whichever is
    less.  Segments have the same lengths for all strings of about the same length,
    cut from its leading bits, and longer strings also have those of the lengths up
    to ``most`` below their own.  Then a window of one string, not moved, is equal
    to one of the other, and one of both has them for its own length: ``place`` tells.
    """
    windows = _windows(most)
    bases = ", ".join(_base(f"greatest(0, length - {k})") for k in range(most + 1))
    rows = strings.selectExpr("s", "xxhash64(s) AS id", f"{_about()} AS about", "length(s) AS length").selectExpr("*", f"explode(array_distinct(array({bases}))) AS base")
    # Strings are told apart by their hashes, so that no string is shuffled.
    rows = rows.selectExpr("id", "about", f"base = {_base('length')} AS own", f"array({', '.join(_window(i, d, most) for i, d in windows)}) AS hashes").distinct()
    rows = rows.selectExpr("id", "about", "own", "posexplode_outer(hashes) AS (place, h)")
    return _dealt(rows.selectExpr("id", "about", f"if(own, place, place + {len(windows)}) AS place", "h"), parts, "h")


def _meeting(left: DataFrame, right: DataFrame | None, most: int, parts: int | None = None) -> DataFrame:
    """(a, b) of the strings (column ``s``) of two tables, or each pair of different strings of one, that share a segment where the edits allow it and have letters that they allow.

    Only hashes of the strings meet, and whoever meets has to be verified.  This runs
    at once, and the strings of the pairs found are fetched by their hashes.
    """
    a = _segments(left, most, parts)
    b = a if right is None else _segments(right, most, parts)
    n = len(_windows(most))
    on = f"a.h = b.h AND (a.place < {n} OR b.place < {n}) AND (a.place % {n} <= {most} OR b.place % {n} <= {most})"
    if right is None:
        on = f"(a.id < b.id OR a.id = b.id AND a.about < b.about) AND {on}"
    met = a.alias("a").join(b.alias("b"), F.expr(on) & _near(F.col("a.about"), F.col("b.about"), most)).selectExpr("a.id AS a_id", "b.id AS b_id")
    # Not persisted: a later call would get it back, though the tables' files may be others by then.
    met = (met.checkpoint() if met.sparkSession.sparkContext.getCheckpointDir() else met.localCheckpoint()).distinct()
    if right is None:
        own = other = _fetched(left, met.selectExpr("explode(array(a_id, b_id)) AS id").distinct(), parts)
    else:
        own, other = (_fetched(df, met.selectExpr(f"{c}_id AS id").distinct(), parts) for df, c in ((left, "a"), (right, "b")))
    return met.join(own.selectExpr("id AS a_id", "s AS a"), "a_id").join(other.selectExpr("id AS b_id", "s AS b"), "b_id").select("a", "b")


def _fetched(strings: DataFrame, ids: DataFrame, parts: int | None) -> DataFrame:
    """(id, s) of the different strings that have one of the ids."""
    strings = strings.selectExpr("xxhash64(s) AS id", "s")
    if ids.count() <= FEW_STRINGS:
        return _dealt(strings.join(F.broadcast(ids), "id", "left_semi").distinct(), parts, "id")
    return _dealt(strings, parts, "id").join(_dealt(ids, parts, "id"), "id", "left_semi").distinct()


def _verified(met: DataFrame, most: int) -> DataFrame:
    return met.select("a", "b", F.levenshtein("a", "b", most).cast("long").alias("dist")).filter("dist >= 0").distinct()


def within(strings: DataFrame, most: int) -> DataFrame:
    """(a, b, dist): the pairs of different strings (column ``s``) within ``most`` edits, each pair once; the shorter is a, of equal lengths the smaller.

    Null strings are in no pair, and repeated strings count once.
    """
    s = strings.select("s").filter(F.col("s").isNotNull())
    met = _meeting(s, None, most, _parts(s, "s")).filter("a != b")
    sized = [F.struct(F.length(c).alias("n"), F.col(c).alias("s")) for c in "ab"]
    return _verified(met.select(F.least(*sized)["s"].alias("a"), F.greatest(*sized)["s"].alias("b")), most)
