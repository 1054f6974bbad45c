"""Documents that hold a benchmark item, within a number of word edits.

An item of L words is held if some run of the document's words is within
``edits(L)`` word insertions, deletions and substitutions of it.

1. CGK.  A random walk over a window's words (Chakraborty, Goldenberg, Koucky)
   repeats or leaves each word by a random bit that depends on walk, step and word;
   the edit distance of windows becomes the Hamming distance of their walks.
2. Bit sampling.  A key of a window is what its walk meets at three steps: the first
   and two drawn from as many as an item-sized window has.  Each of ``WALKS`` walks
   is sampled ``SAMPLES`` times for each class of item lengths.  The index has
   the keys of all items' windows; a window of a document that shares a key is a
   candidate.  As the first step is always sampled, only windows that begin with the first word of
   some item's window can share one, and only those are walked.
   So that edits of its first words lose no item, an item has several windows: from
   each of its ``STARTS`` rarest words (an eighth of them, if that is more) to its end.
3. Candidates are verified by exact edit distance, many at once.

``test_recall_of_the_index`` measures the share of held items that become candidates.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .neardup import mix

RATE = 0.2
#: Items of fewer words are searched for without edits.
MIN_WORDS = 6
#: Walks, and keys of each for a class of lengths; windows of an item.
WALKS, SAMPLES, STARTS = 8, 6, 8
#: Items, and bytes of their texts, searched for at a time; more are searched for in blocks, one after the other.
BLOCK_ITEMS, BLOCK_BYTES = 4_000, 8 << 20
#: Windows walked together, and cells of the edit distances computed together.
WINDOWS, CELLS = 1 << 16, 1 << 19

_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
_C = _U(0xBF58476D1CE4E5B9)
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes, none 0, of the words in lower case; ASCII punctuation and white space part words."""
    import xxhash

    words = (text or "").lower().encode().translate(_TABLE).split()
    return np.maximum(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), _U(1))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    x = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        x = mix(x * _K + h[j : len(h) - n + 1 + j])
    return x


def edits(n: int) -> int:
    return math.floor(RATE * n) if n >= MIN_WORDS else 0


def size_class(n: int) -> int:
    """The largest power of two up to n: the window size whose steps are sampled for an item of n words."""
    return 1 << (n.bit_length() - 1)


def sampled_steps(size: int, walk: int) -> list[tuple[int, int]]:
    """The steps, besides the first, of each key: two of the walk's 2 * size steps over a window of ``size`` words."""
    rng = np.random.default_rng((size, walk, 77))
    return [tuple(sorted(rng.choice(np.arange(1, 2 * size), 2, replace=False).tolist())) for _ in range(SAMPLES)]


def window_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, windows, keys) for each key of each size: the numbers of the windows that have one, and theirs.

    A window reaches from its place in ``starts`` to its place in ``ends``, where
    ``words`` is 0.  A walk that has left its window by a sampled step, or meets one
    word at two of them in a row, has no key there.
    """
    first = words[starts]
    for walk in range(WALKS):
        plans = {size: sampled_steps(size, walk) for size in sizes}
        wanted = {s for pairs in plans.values() for pair in pairs for s in pair}
        flips = np.random.default_rng((walk, 78)).integers(0, 1 << 63, max(wanted) + 1, dtype=np.int64).astype(np.uint64)
        at, met = starts.copy(), {}
        for step in range(max(wanted) + 1):
            word = words[at]
            if step in wanted:
                met[step] = word
            at = np.minimum(at + (((word ^ flips[step]) * _C) >> _U(63)).astype(np.int64), ends)
        for size, pairs in plans.items():
            for k, (a, b) in enumerate(pairs):
                # Met at steps of one place, a word says the same twice.
                inside = np.flatnonzero((met[b] != 0) & (met[a] != first) & (met[b] != met[a]))
                salt = _U((size * WALKS + walk) * SAMPLES + k)
                yield size, inside, mix(mix(first[inside] * _K + met[a][inside] + salt) * _K + met[b][inside])


class _Places:
    """Where 64-bit keys lie in a sorted table; a bit map turns most others away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = _U(64 - max(12, math.ceil(math.log2(len(keys) * 32 + 1))))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[keys >> self.shift] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the elements of x that are in the table."""
        k = np.flatnonzero(self.bits[x >> self.shift])
        at = np.minimum(np.searchsorted(self.keys, x[k]), len(self.keys) - 1)
        return k[self.keys[at] == x[k]]


class Items:
    """Benchmark items with the index of their windows' keys."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        by_words: dict[bytes, set] = defaultdict(set)
        for item_id, text in items:
            if len(h := word_hashes(text)):
                by_words[h.tobytes()].add(item_id)
        self.words = [np.frombuffer(w, np.uint64) for w in by_words]
        #: Ids of the items with these words.
        self.ids = [sorted(own, key=lambda x: (x is not None, x)) for own in by_words.values()]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        often = Counter(w for own in self.words for w in own.tolist())
        starts, ends, owners, flat, at = [], [], [], [], 0
        exact: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, own in enumerate(self.words):
            n = len(own)
            if not edits(n):
                exact[n].append((int(run_hashes(own, n)[0]), k))
                continue
            rare = set(sorted(set(own.tolist()), key=lambda w: (often[w], w))[: max(STARTS, n // 8)])
            for j, w in enumerate(own.tolist()):
                if w in rare:
                    starts.append(at + j)
                    ends.append(at + n)
                    owners.append((k, j))
            flat += [own, np.zeros(1, np.uint64)]
            at += n + 1
        self.short = {n: (_Places(np.array([x for x, _ in sorted(own)], np.uint64)), np.array([k for _, k in sorted(own)])) for n, own in exact.items()}
        self.sizes = sorted({size_class(len(w)) for w in self.words if edits(len(w))})
        self.firsts = None
        if not owners:
            return
        words, starts, ends, owners = np.concatenate(flat), np.array(starts), np.array(ends), np.array(owners)
        self.firsts = _Places(np.unique(words[starts]))
        own_size = np.array([size_class(int(n)) for n in self.lengths])[owners[:, 0]]
        keys, who = [], []
        for size in self.sizes:
            own = np.flatnonzero(own_size == size)
            for _, k, x in window_keys(words, starts[own], ends[own], [size]):
                keys.append(x)
                who.append(own[k])
        keys, who = np.concatenate(keys), np.concatenate(who)
        order = np.argsort(keys, kind="stable")
        self.owners = owners[who[order]]
        table, self.first_at = np.unique(keys[order], return_index=True)
        self.count = np.diff(np.append(self.first_at, len(keys)))
        self.keys = _Places(table)

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (item, place of its first word), each once, of the windows that share a key with an item.

        ``words`` has texts one after the other, a 0 behind each; ``bounds`` has the places of those.
        """
        pad = int(self.lengths.max()) if len(self.lengths) else 0
        span = len(words) + 2 * pad
        found = [np.zeros(0, np.int64)]  # item and place as one number

        def add(item: np.ndarray, place: np.ndarray) -> None:
            found.append(np.unique(item * span + place + pad))

        all_starts = self.firsts.find(words) if self.firsts else found[0]
        for low in range(0, len(all_starts), WINDOWS):
            starts = all_starts[low : low + WINDOWS]
            ends = bounds[np.searchsorted(bounds, starts)]
            for _, k, x in window_keys(words, starts, ends, self.sizes):
                hit = self.keys.find(x)
                at, place = np.searchsorted(self.keys.keys, x[hit]), starts[k[hit]]
                # One row an item with that key; many items may share one, so some at a time.
                cut = np.flatnonzero(np.diff(np.cumsum(self.count[at]) // (16 * WINDOWS))) + 1
                for a, p in zip(np.split(at, cut), np.split(place, cut)):
                    n = self.count[a]
                    own = np.repeat(self.first_at[a] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    item, offset = self.owners[own].T
                    add(item, np.repeat(p, n) - offset)
            found = [np.unique(np.concatenate(found))]
        for n, (places, own) in self.short.items():
            x = run_hashes(words, n)
            at = places.find(x)
            add(own[np.searchsorted(places.keys, x[at])], at)
        item, place = np.divmod(np.unique(np.concatenate(found)), span)
        return np.column_stack([item, place - pad])

    def verify(self, words: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, edits, place of the first word) of the candidates that are held, some at a time."""
        for n in np.unique(self.lengths[rows[:, 0]]).tolist():
            own = rows[self.lengths[rows[:, 0]] == n]
            d = edits(n)
            width = n + 4 * d
            padded = np.concatenate([np.zeros(2 * d + n, np.uint64), words, np.zeros(width, np.uint64)])
            step = max(1, CELLS // (width + 1))
            for low in range(0, len(own), step):
                item, start = own[low : low + step].T
                # The text is that of the window's middle; a window never reaches into another.
                text = np.searchsorted(bounds, np.maximum(start, 0) + n // 2)
                text = np.minimum(text, len(bounds) - 1)
                low_end, high_end = np.where(text > 0, bounds[text - 1], -1), bounds[text]
                place = (start - 2 * d)[:, None] + np.arange(width)
                window = np.where((place > low_end[:, None]) & (place < high_end[:, None]), padded[place + 2 * d + n], _U(0))
                cost, first = nearest_runs(np.stack([self.words[k] for k in item]), window)
                held = np.flatnonzero(cost <= d)
                if len(held):
                    yield text[held], item[held], cost[held], (start - 2 * d + first)[held]

    def held(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, edits, first word of the run) of the items that texts hold; an item may come more than once."""
        hashed = [word_hashes(t) for t in texts]
        if not self.words or not any(map(len, hashed)):
            return
        zero = np.zeros(1, np.uint64)
        words = np.concatenate([x for h in hashed for x in (h, zero)])
        bounds = np.cumsum([len(h) + 1 for h in hashed]) - 1
        for text, item, cost, first in self.verify(words, bounds, self.candidates(words, bounds)):
            yield text, item, cost, first - np.where(text > 0, bounds[text - 1] + 1, 0)


def nearest_runs(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, the fewest edits from the item to a run of the window, and where that run starts (ties: first).

    Each cell holds edits and start as one number, so that the least cell is the
    nearest run and, among those, the one that starts first.
    """
    rows, width = windows.shape
    unit = 1 << (width + 1).bit_length()
    kind = np.int32 if (items.shape[1] + width + 2) * unit < 1 << 31 else np.int64
    across = np.arange(width + 1, dtype=kind) * kind(unit)
    best = np.broadcast_to(np.arange(width + 1, dtype=kind), (rows, width + 1))
    for j in range(items.shape[1]):
        new = best + kind(unit)  # the item's word is left out
        np.minimum(new[:, 1:], best[:, :-1] + (windows != items[:, j : j + 1]) * kind(unit), out=new[:, 1:])
        # Words of the window between: each costs one.
        best = np.minimum.accumulate(new - across, axis=1) + across
    least = best.min(axis=1)
    return least // unit, least % unit


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items, so many at a time that their index has a bounded size, whatever the size of the benchmark."""
    items = common.only(benchmark, "item_id", "text").filter("text IS NOT NULL")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(max(n / BLOCK_ITEMS, size / BLOCK_BYTES)))
    for k in range(blocks):
        yield Items([tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()])


FOUND = "doc_id long, item_id long, distance int, item_words int, first_word long"


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, item_words, first_word: the nearest copy of each item a document holds.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.  Every document is
    searched for every item, a block of items at a time.

    Null or empty texts hold nothing and are no items.  Items of fewer than
    ``MIN_WORDS`` words are found without edits only.  Null ids are carried on.
    Repeated documents: each gives its rows.  Repeated items: one row an id.  Ties:
    the first copy.  Empty tables: no rows.  Very long texts are searched whole, a
    bounded number of windows at a time.  Other columns are ignored.
    """
    texts, out = common.only(docs, "doc_id", "text"), None
    for items in _blocks(benchmark):
        part = texts.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(items)), FOUND)
        out = part if out is None else out.union(part)
    return out


def _searcher(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in common.batches(batches):
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for found in items.held(batch.column(1).to_pylist()):
                for text, item, *row in zip(*(c.tolist() for c in found)):
                    best[text, item] = min(best.get((text, item), (1 << 62,)), tuple(row))
            doc_ids = batch.column(0).to_pylist()
            rows = [(doc_ids[text], item_id, cost, len(items.words[item]), first) for (text, item), (cost, first) in best.items() for item_id in items.ids[item]]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "item_id", "distance", "item_words", "first_word"])

    return search


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item; all their columns, none added.

    What is held is as in ``find_items``.  Null or empty texts hold nothing and stay.
    Repeated rows: each is judged.  Empty benchmark: all rows.  Empty table: no rows.
    Extra columns pass through, whatever their names.
    """
    at, out = common.place(docs, "text"), common.numbered(docs)
    common.bound_batches(docs.sparkSession)
    for items in _blocks(benchmark):
        out = out.mapInArrow(_dropper(docs.sparkSession.sparkContext.broadcast(items), at), out.schema)
    return out.toDF(*docs.columns)


def _dropper(shared, at: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(batches):
            keep = np.ones(batch.num_rows, bool)
            for text, *_ in shared.value.held(batch.column(at).to_pylist()):
                keep[text] = False
            yield batch.filter(pa.array(keep))

    return drop


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
