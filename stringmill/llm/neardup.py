"""Near-duplicate groups by SuperMinHash: signatures, banding, verification, union-find.

1. A document's set is that of its five-word shingles, as 64-bit hashes.  Documents
   with one set form a class at once; its smallest doc_id stands for it.
2. SuperMinHash gives each class a signature of ``BANDS * ROWS`` slots.  In round j
   every element offers rank j plus a fraction to the slot that its own random
   permutation visits j-th; slots keep the least offer.  No later round can improve
   a signature whose slots are all below j + 1, so the rounds end early, after one
   or two for all but very small sets.
3. Classes that agree in all rows of a band share a bucket.  Each bucket's members
   are compared with its smallest doc_id, on full sets; links are grouped.
4. Buckets that still hold more than one group are unresolved.  Members outside a
   bucket's largest group are compared with all others of the bucket, block against
   block, by counting shared shingles of whole blocks at once; no pairs are made,
   only links come out.  So a bucket of n near copies costs n comparisons and what
   lies outside it, and no link is given up.
5. Grouping is union-find inside partitions, then distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
BANDS, ROWS = 24, 5
#: Two sets are linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles of a block of an unresolved bucket: of the members outside its largest group, and of all.
BLOCK_OUTSIDE, BLOCK_ALL = 100_000, 400_000
#: Comparisons that share one copy of a centre's text.
PER_CENTRE = 48
#: Rows of one key that meet in one place: of ids and numbers, and of needs for one text.
PER_PLACE, PER_TEXT = 10_000, 64
#: At most so many ids are broadcast to pick their texts; beyond, texts are shuffled.
BROADCAST_IDS = 100_000

_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
_A, _B = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (public splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    A-Z in lower case; words are runs of anything but the six ASCII white-space
    characters.  Fewer words than ``width``: the whole sequence as one shingle.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    own = min(n, width)
    x = np.full(n - own + 1, own, np.uint64)
    for j in range(own):
        x = mix(x * _K + h[j : n - own + 1 + j])
    return np.unique(x)


def superminhash(elements: np.ndarray, slots: int) -> np.ndarray:
    """Signature of a non-empty set of 64-bit hashes: 32 bits of rank, 32 of fraction a slot."""
    n = len(elements)
    out = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    perm = first = None
    rows = np.arange(n)
    for j in range(slots):
        r = mix(elements + _U((j + 1) * int(_K) % (1 << 64)))
        k = j + (((r & _U(0xFFFFFFFF)) * _U(slots - j)) >> _U(32)).astype(np.int64)
        if j == 0:
            slot = first = k
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.int16), (n, 1))
                perm[rows, first], perm[:, 0] = 0, first
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(out, slot, _U(j << 32) | (r >> _U(32)))
        if int(out.max()) < (j + 1) << 32:
            break
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = np.arange(1, bands + 1, dtype=np.uint64)
    for column in signature.reshape(bands, rows).T:
        x = mix(x * _K + column)
    return x


SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"


def sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, size of the set, two hashes of the set, and its band keys (none for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(batches):
            sizes, k1, k2, keys, offsets = [], [], [], [], [0]
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                sizes.append(len(s))
                k1.append(mix(s).sum(dtype=np.uint64))
                k2.append(mix(s ^ _K).sum(dtype=np.uint64))
                if len(s):
                    keys.append(band_keys(superminhash(s, bands * rows), bands, rows))
                offsets.append(offsets[-1] + (bands if len(s) else 0))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            longs = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), longs(k1), longs(k2), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                ["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return common.only(docs, "doc_id", "text").mapInArrow(run, SIGNED)


def similar_sizes(a: str, b: str):
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _with_texts(needs: DataFrame, docs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``needs`` with the text of each doc_id, dealt out by ``keys`` and sorted in each partition.

    A text that is needed in many places is copied where the needs for it are dealt to.
    """
    sizes = needs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    ids = sizes.select("doc_id")
    texts = common.only(docs, "doc_id", "text")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    met = common.meet(needs, "doc_id", F.struct(*keys), texts, sizes, PER_TEXT).select(*keys, *order, "text")
    return met.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, *order)


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Each b travels to its centre a once a pair; a's text is copied once for
    ``PER_CENTRE`` of them.  A centre of a third of the corpus is no hot key: neither
    its pairs nor the copies of its text meet in one task.  A task holds one centre's
    set and one other at a time.
    """
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    copies = degree.select("a", F.ceil(F.col("n") / PER_CENTRE).alias("copies"))
    dealt = common.meet(pairs, "a", F.col("b"), copies, degree, PER_PLACE)
    dealt = common.materialize(dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).alias("copy")), "pairs")
    needs = dealt.select(F.col("b").alias("doc_id"), "a", "copy", F.lit(1).alias("turn")).union(dealt.select(F.col("a").alias("doc_id"), "a", "copy", F.lit(0).alias("turn")).distinct())
    dealt_out = _with_texts(needs, docs, ["a", "copy"], ["turn", "doc_id"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centres = None, []
        for batch in common.batches(batches):
            out_a, out_b = [], []
            for a, copy, turn, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, copy) != key:
                    key, centres = (a, copy), []
                own = shingles(text)
                if turn == 0:
                    centres.append(own)
                    continue
                for centre in centres:
                    both = len(np.intersect1d(centre, own, assume_unique=True))
                    if both and 100 * both >= PERCENT * (len(centre) + len(own) - both):
                        out_a.append(a)
                        out_b.append(doc_id)
                        break
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return dealt_out.mapInArrow(compare, "a long, b long")


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links: a link from each node to its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    own = [(x, root(x)) for x in list(parent) if parent[x] != x]
    if own:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*own)], ["node", "up"])


def components(links: DataFrame) -> DataFrame:
    """(node, up): each node of a link except the smallest of its component, and that smallest one.

    ``links`` has (a, b).  Partitions are contracted by union-find; then every node
    hands its neighbours its least neighbour, first to larger ones, then to
    smaller, until nothing changes (alternating star contraction).  Each round
    combines minima before its shuffle and is written out.
    """
    forest = common.materialize(links.select("a", "b").mapInArrow(_local_forest, "node long, up long"), "forest")
    before = None
    while True:
        state = forest.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "up").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return forest
        before = state
        both = forest.union(forest.select(F.col("up").alias("node"), F.col("node").alias("up")))
        least = both.groupBy("node").agg(F.min("up").alias("m")).select("node", F.least("node", "m").alias("m"))
        # A hub may have a third of all nodes for neighbours: they meet its least one in many places.
        large = common.attach(both.filter("up > node"), "node", "up", least).select(F.col("up").alias("node"), F.col("m").alias("up")).filter("node != up").distinct()
        large = common.materialize(large, "large-star")
        least = large.groupBy("node").agg(F.min("up").alias("m"), F.count(F.lit(1)).alias("n"))
        small = common.meet(large, "node", F.col("up"), least.select("node", "m"), least, PER_PLACE).filter("up != m").select(F.col("up").alias("node"), F.col("m").alias("up")).union(least.select("node", F.col("m").alias("up"))).distinct()
        old, forest = forest, common.materialize(small, "small-star")
        common.discard(old, large)


def group(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Two documents are linked if 100 * intersection >= 75 * union of their shingle
    sets; component_id is the smallest doc_id that links lead to, kept marks it.

    Null text or one without words: empty set, linked with nothing.  Null doc_id:
    linked with nothing, its component null, kept.  Rows that repeat a doc_id are one
    document: the links of each are those of all, and each row is returned.  Ties
    don't arise: all choices are by smallest doc_id.  Empty table: no rows.  Other
    columns are ignored.
    """
    signed = common.materialize(sign(docs, bands, rows), "signed")
    nameless = signed.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    empty = signed.filter("doc_id IS NOT NULL AND n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))
    full = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    full = full.withColumn("set", F.struct("k1", "k2", "n_shingles"))
    same = full.groupBy("set").agg(F.min("doc_id").alias("rep"))
    # A class may hold a third of all rows, so its rows meet its smallest doc_id in many places.
    classed = common.attach(full, "set", "doc_id", same).select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands"))
    classed = common.materialize(classed, "classes")
    # Rows of one doc_id but different sets are linked.
    again = classed.filter("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    buckets = classed.filter("bands IS NOT NULL").select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    first = buckets.groupBy("bucket").agg(F.min(F.struct("doc", "n")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    first = common.materialize(first, "first")
    # A bucket of near copies may hold a third of all classes.
    met = common.meet(buckets, "bucket", F.col("doc"), first.select("bucket", "first"), first.select("bucket", F.col("size").alias("n")), PER_PLACE)
    buckets = common.materialize(met.select("bucket", "doc", "n", F.col("first.doc").alias("a"), F.col("first.n").alias("a_n")), "buckets")

    pairs = buckets.filter("doc != a").filter(similar_sizes("n", "a_n")).select("a", F.col("doc").alias("b")).distinct()
    pairs = common.materialize(pairs, "candidates")
    repeated = common.materialize(again.join(classed.filter("doc_id = rep").select(F.col("doc_id").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "repeated-ids")
    links = common.materialize(verify(pairs, docs), "links")
    forest = components(links.union(repeated))
    common.discard(pairs, links, repeated)
    found = common.materialize(verify_blocks(buckets.select("bucket", "doc", "n"), forest, docs), "links")
    if not found.isEmpty():
        old, forest = forest, components(forest.select(F.col("up").alias("a"), F.col("node").alias("b")).union(found))
        common.discard(old)
    common.discard(buckets, first, found)

    rows_in = classed.select("doc_id", "n_shingles", "rep")
    found = common.attach(rows_in, "rep", "doc_id", forest.withColumnRenamed("node", "rep"), how="left").select("doc_id", "n_shingles", F.coalesce("up", "rep").alias("component_id"))
    found = found.union(empty)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id")).union(nameless)


def verify_blocks(members: DataFrame, forest: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between members of one bucket but different components.

    Every member outside the bucket's largest component meets every other member.
    A bucket's rows go to as many tasks as it has pairs of blocks; a block's shingles
    are bounded, so a task's memory is.
    """
    own = members.join(forest.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", "n", F.coalesce("up", "doc").alias("component"))
    groups = own.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    many = groups.groupBy("bucket").agg(F.sum("k").alias("size"), F.sum("w").alias("weight"), F.max(F.struct("k", "component", "w")).alias("most")).filter("size > most.k")
    blocks = many.select("bucket", F.col("most.component").alias("main"), F.ceil((F.col("weight") - F.col("most.w")) / BLOCK_OUTSIDE).alias("outside"), F.ceil(F.col("weight") / BLOCK_ALL).alias("all"))
    met = common.materialize(common.meet(own, "bucket", F.col("doc"), blocks, many.select("bucket", F.col("size").alias("n")), PER_PLACE), "unresolved")
    part = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = met.filter("component != main").select("bucket", part("outside").alias("x"), each("all").alias("y"), F.lit(0).alias("side"), F.col("doc").alias("doc_id"), "component")
    y = met.select("bucket", each("outside").alias("x"), part("all").alias("y"), F.lit(1).alias("side"), F.col("doc").alias("doc_id"), "component")
    dealt = _with_texts(x.union(y), docs, ["bucket", "x", "y"], ["side", "doc_id", "component"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])
        for batch in common.batches(batches):
            for *new, side, doc_id, component, text in zip(*(c.to_pylist() for c in batch.columns)):
                if new != key:
                    yield from _links(*sides)
                    key, sides = new, ([], [])
                sides[side].append((doc_id, component, shingles(text)))
        yield from _links(*sides)

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, by products of 0-1 matrices over the shingles that both have."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    both = np.intersect1d(np.unique(np.concatenate(xs)), np.unique(np.concatenate(ys)), assume_unique=True)
    step = 2048
    if not len(both):
        return out
    at = lambda s: (k := np.minimum(np.searchsorted(both, s), len(both) - 1))[both[k] == s]
    places = [[at(s) for s in side] for side in (xs, ys)]
    for at in range(0, len(both), step):
        m = []
        for side in places:
            one = np.zeros((len(side), min(step, len(both) - at)), np.float32)
            for row, p in zip(one, side):
                row[p[np.searchsorted(p, at) : np.searchsorted(p, at + step)] - at] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out


def _links(xs: list, ys: list) -> Iterator[pa.RecordBatch]:
    if not xs or not ys:
        return
    both = shared_counts([s for _, _, s in xs], [s for _, _, s in ys])
    total = np.add.outer([len(s) for _, _, s in xs], [len(s) for _, _, s in ys])
    i, j = np.nonzero((both > 0) & (100 * both >= PERCENT * (total - both)))
    rows = {(min(xs[a][0], ys[b][0]), max(xs[a][0], ys[b][0])) for a, b in zip(i.tolist(), j.tolist()) if xs[a][1] != ys[b][1]}
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b"])


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, grouped."""
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"))
