"""Best-fit packing of documents into sequences, after Martello-Toth reduction.

Lengths are whole numbers of at most ``capacity`` tokens, so the instance of a whole
corpus is its histogram of lengths: at most ``capacity`` rows, whatever the number of
documents.  The reduction and the best fit work on that histogram, with counts; the
outcome is a short list of layouts ("so many sequences of these lengths"), from
which every document's sequence and offset follow by its rank among the documents
of its length.  No document list ever reaches the driver.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordbpe

CAPACITY = 4096
END_ID = 1

Layout = tuple[int, tuple[tuple[int, int], ...]]
"""Number of sequences, and (length, how many of it) in each."""


class Sizes:
    """A multiset of lengths that answers the reduction's questions."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {int(w): int(c) for w, c in histogram.items() if c > 0}
        self.order = sorted(self.count)

    def take(self, w: int, n: int) -> None:
        self.count[w] -= n
        if not self.count[w]:
            del self.count[w]
            self.order.pop(bisect.bisect_left(self.order, w))

    def largest_upto(self, w: int) -> int | None:
        k = bisect.bisect_right(self.order, w)
        return self.order[k - 1] if k else None

    def smallest_sum(self, n: int, above: int = 0) -> int | None:
        """Sum of the n smallest items larger than ``above``; None if there are fewer."""
        total = 0
        for w in self.order[bisect.bisect_right(self.order, above) :]:
            k = min(n, self.count[w])
            total, n = total + k * w, n - k
            if not n:
                return total
        return None

    def best_pair(self, room: int) -> int:
        """The largest sum up to ``room`` of two items, 0 if no two fit."""
        order, best = self.order, 0
        i, j = 0, bisect.bisect_right(order, room) - 1
        while i <= j:
            if i == j and self.count[order[i]] < 2:
                break
            total = order[i] + order[j]
            if total <= room:
                best = max(best, total)
                if best == room:
                    break
                i += 1
            else:
                j -= 1
        return best


def reduce_by_dominance(histogram: dict[int, int], capacity: int) -> tuple[list[Layout], dict[int, int]]:
    """Fix sequences that some best packing has; what remains is the smaller instance.

    For the largest item j and the room r beside it, a set {j} + S that fits is
    dominated by another if its other items can be shared out among groups none of
    which is larger than the item that stands for the group.  Fixed are

    * {j}, if nothing fits beside it;
    * {j, k}, if k fills r exactly, or k is the largest item that fits and no two
      items fit, or no three fit and no two together exceed k;
    * {j, k, b}, with k the largest item that fits and b the largest beside both,
      if they fill r exactly, no three items fit in r, and no two items larger
      than b do.

    Each of these dominates every other set that holds j.
    """
    sizes, fixed = Sizes(histogram), []

    def fix(*items: int) -> None:
        own = Counter(items)
        n = min(sizes.count[w] // k for w, k in own.items())
        for w, k in own.items():
            sizes.take(w, n * k)
        fixed.append((n, tuple(sorted(own.items(), reverse=True))))

    at = len(sizes.order)
    bound = capacity + 1
    while at:
        at = bisect.bisect_left(sizes.order, bound)
        if not at:
            break
        j = sizes.order[at - 1]
        # Item j itself is taken out while its partners are looked for.
        room, whole = capacity - j, sizes.count[j]
        if whole == 1:
            sizes.count.pop(j)
            sizes.order.pop(at - 1)
        else:
            sizes.count[j] -= 1
        k = sizes.largest_upto(room)
        chosen: tuple[int, ...] | None = None
        if k is None:
            chosen = (j,)
        else:
            two, three = sizes.smallest_sum(2), sizes.smallest_sum(3)
            if k == room or two is None or two > room:
                chosen = (j, k)
            elif three is None or three > room:
                if sizes.best_pair(room) <= k:
                    chosen = (j, k)
                else:
                    rest = Sizes(sizes.count)
                    rest.take(k, 1)
                    b = rest.largest_upto(room - k)
                    if b is not None and k + b == room:
                        wide = sizes.smallest_sum(2, above=b)
                        if wide is None or wide > room:
                            chosen = (j, k, b)
        if whole == 1:
            sizes.count[j] = 1
            sizes.order.insert(at - 1, j)
        else:
            sizes.count[j] += 1
        if chosen is None:
            bound = j
        else:
            fix(*chosen)
            bound = max(bound if j not in sizes.count else j + 1, j + 1)
    return fixed, dict(sizes.count)


def best_fit(histogram: dict[int, int], capacity: int) -> list[Layout]:
    """Best fit, longest first: each item goes where it leaves least room.

    Sequences with the same content are kept as one group with a count, so the work
    depends on the number of different lengths, not of items.
    """
    groups: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    rooms: list[int] = []
    done: list[Layout] = []

    def put(room: int, n: int, content) -> None:
        if not n:
            return
        if room == 0:
            done.append((n, content))
            return
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((n, content))

    for w in sorted(histogram, reverse=True):
        left = int(histogram[w])
        while left:
            k = bisect.bisect_left(rooms, w)
            if k == len(rooms):
                each = capacity // w
                full, over = divmod(left, each)
                put(capacity - each * w, full, ((w, each),))
                put(capacity - over * w, int(over > 0), ((w, over),))
                break
            room = rooms[k]
            n, content = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(k)
            each = room // w
            full = min(n, left // each)
            put(room - each * w, full, (*content, (w, each)))
            left -= full * each
            if full < n:
                over = min(left, each)
                put(room - over * w, int(over > 0), (*content, (w, over)))
                put(room, n - full - int(over > 0), content)
                left -= over
    return done + [g for same in groups.values() for g in same]


def lay_out(histogram: dict[int, int], capacity: int) -> list[Layout]:
    """Layouts that hold each item of the histogram once."""
    fixed, rest = reduce_by_dominance(histogram, capacity)
    return fixed + best_fit(rest, capacity)


def ranges(layouts: list[Layout]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, sequences, first sequence, offset of the first such item), by rank.

    The item of rank r in a row lies in sequence ``first + (r - rank) % n`` at
    ``offset + (r - rank) // n * length``.
    """
    rank, out, sequence = Counter(), {}, 0
    for n, content in layouts:
        offset = 0
        for w, k in content:
            out.setdefault(w, []).append((rank[w], n, sequence, offset))
            rank[w] += n * k
            offset += w * k
        sequence += n
    return {w: np.array(rows, np.int64) for w, rows in out.items()}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, turn long"


def cut_documents(docs: DataFrame, capacity: int, vocabulary: str | None, end_id: int) -> DataFrame:
    """Pieces of each document, with the task that made them and their turn among its pieces of that length."""
    path = vocabulary or wordbpe.default_path()

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokenizer, turns = TaskContext.get().partitionId(), wordbpe.load(path), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in common.batches(rows):
            out: list[tuple] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), tokenizer.encode_all(batch.column(1).to_pylist())):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    n = len(own) // 4
                    out.append((doc_id, piece, at // 4, n, zlib.crc32(own), part, turns[n]))
                    turns[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "turn"])

    return common.only(docs, "doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pack the token ids of ``docs`` (doc_id, text) into sequences of at most ``capacity``.

    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Documents longer than ``capacity`` are cut; nothing else is, and nothing is lost.

    Null or empty text: a piece that is ``end_id`` alone.  Null doc_id: packed like
    any other.  Repeated rows: each is packed.  Empty table: no rows.  Ties (pieces
    of one length) are told apart by the task that read them and the order in it.
    Other columns are ignored.

    Only rows of numbers are shuffled.  A hot length is no hot key: ranks come from
    counts by (task, length), and rows meet their counts on both.
    """
    spark = docs.sparkSession
    pieces = common.materialize(cut_documents(docs, capacity, vocabulary, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # At most `capacity` rows, whatever the size of the corpus.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # The ranges are as bounded: a few rows a length.
    table = spark.sparkContext.broadcast(ranges(lay_out(histogram, capacity)))
    before = common.running_sum(counts, "length", "part", "n")
    ranked = pieces.join(before, ["part", "length"])

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = table.value
        for batch in rows:
            if not batch.num_rows:
                continue
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy() + batch.column(6).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                w = int(length[own[0]])
                t = by_length[w]
                row = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                inside = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + inside % row[:, 1]
                offset[own] = row[:, 3] + inside // row[:, 1] * w
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "turn", "before").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
