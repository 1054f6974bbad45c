"""Nearest neighbours by inner product: balanced posting lists behind a graph of centroids.

1. Rows of one vector are one class; its smallest ids stand for it, since no more of
   them can be among a query's nearest.
2. A component is added, sqrt(M^2 - |x|^2) for candidates (M: the largest norm) and 0
   for queries, which are scaled to M.  The nearest by distance are then those with
   the largest inner product.
3. Centroids are the leaves of a balanced tree over a bounded sample: each split deals
   its vectors to branches of one size.  There are about sqrt(rows) of them.
4. A graph joins centroids to close ones in different directions; searches walk it
   from a few entries, best first, all vectors of a batch in step.
5. Every class goes to its nearest list, and near a boundary to others as well, up to
   ``REPLICAS``.  Long lists are dealt to parts of bounded size.
6. A query reads the lists whose centroids are at most ``1 + reach`` times as far as
   its nearest.  ``reach`` is measured on the sample: the least that leads
   ``TARGET`` of the sample's true neighbours to their queries.
7. Each part of a list meets the queries that chose it; scores are computed again on
   the original vectors, term by term, for those that can be among the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NEAREST, EVERY = 20, 20
#: Vectors of the sample, and numbers in it, at most; vectors of the sample a list, at least.
SAMPLE, SAMPLE_NUMBERS, PER_LIST = 50_000, 4_000_000, 8
#: Lists a vector stands in, at most, and how much farther than its nearest they may be.
REPLICAS, BOUNDARY = 4, 0.12
#: Share of the sample's true neighbours that the reach has to lead to, and queries of the sample it is measured with.
TARGET, TRIED = 0.96, 400
#: Links of a centroid before they are made mutual, centroids that each search looks at, and where it begins.
LINKS, LOOKED_AT, ENTRIES = 16, 24, 8
#: Classes of a part of a list; queries that one task takes of those that chose it.
PART, QUERIES = 2048, 2048
#: Numbers of a table of distances or scores in a worker.
CELLS = 1_000_000


# The index: centroids, graph, reach.


def split_evenly(x: np.ndarray, branches: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Branch of each vector: means that move, each with room for its share; who has no room goes to the next nearest."""
    n, room = len(x), -(-len(x) // branches)
    means = x[rng.choice(n, branches, replace=False)]
    of = np.zeros(n, np.int64)
    for _ in range(rounds):
        far = (means * means).sum(1) - 2 * x @ means.T
        of, left = np.full(n, -1), np.full(branches, room)
        while len(rest := np.flatnonzero(of < 0)):
            open_ = np.where(left > 0, far[rest], np.inf)
            to = open_.argmin(1)
            # Who would lose most elsewhere comes first.
            second = np.partition(open_, 1, axis=1)[:, 1] if branches > 1 else open_[:, 0]
            order = np.lexsort((open_[np.arange(len(rest)), to] - second, to))
            turn = np.arange(len(rest)) - np.searchsorted(to[order], to[order])
            placed = order[turn < left[to[order]]]
            of[rest[placed]] = to[placed]
            left -= np.bincount(to[placed], minlength=branches)
        means = np.stack([x[of == k].mean(0) if (of == k).any() else means[k] for k in range(branches)])
    return of


def centroids_of(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """About ``lists`` centroids of groups of about one size."""
    rng, leaf, todo, out = np.random.default_rng(seed), max(1, len(x) // max(1, lists)), [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        branches = min(8, round(len(own) / leaf))
        if branches < 2:
            out.append(x[own].mean(0))
            continue
        of = split_evenly(x[own], branches, rng)
        todo += [own[of == k] for k in range(branches) if (of == k).any()]
    return np.unique(np.array(out), axis=0)


class Lists:
    """Centroids and the graph over them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.norms = centroids, (centroids * centroids).sum(1)
        links = [set(own) for own in self._directions()]
        for a, own in enumerate(list(map(tuple, links))):
            for b in own:
                links[b].add(a)
        self._connect(links)
        self.links = np.full((len(links), max(map(len, links), default=0)), -1)
        for a, own in enumerate(links):
            self.links[a, : len(own)] = sorted(own)
        self.entries = np.unique(np.linspace(0, len(links) - 1, min(ENTRIES, len(links))).astype(int))

    def far(self, x: np.ndarray, to: np.ndarray | None = None) -> np.ndarray:
        """Squared distances of each vector to all centroids, or to its own row of them."""
        own = (x * x).sum(1)[:, None]
        if to is None:
            return np.maximum(own + self.norms - 2 * x @ self.centroids.T, 0)
        return np.maximum(own + self.norms[to] - 2 * np.matmul(self.centroids[to], x[:, :, None])[:, :, 0], 0)

    def _directions(self) -> Iterator[list[int]]:
        """Close centroids of each one, without those that are closer to one taken before."""
        k = len(self.centroids)
        for at in range(0, k, step := max(1, CELLS // max(1, k))):
            far = self.far(self.centroids[at : at + step])
            far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
            for row in far:
                taken: list[int] = []
                for b in np.argsort(row, kind="stable")[: min(k - 1, 3 * LINKS)].tolist():
                    if all(row[b] <= d for d in self.far(self.centroids[b : b + 1], np.array([taken]))[0]) if taken else True:
                        taken.append(b)
                    if len(taken) == LINKS:
                        break
                yield taken

    def _connect(self, links: list[set[int]]) -> None:
        """Join what the links leave apart, each island by its shortest way out."""
        while True:
            island = np.full(len(links), -1)
            for a in range(len(links)):
                todo = [a] if island[a] < 0 else []
                while todo:
                    if island[b := todo.pop()] < 0:
                        island[b] = a
                        todo += links[b]
            names = np.unique(island)
            if len(names) < 2:
                return
            for name in names:
                best = (np.inf, 0, 0)
                own, others = np.flatnonzero(island == name), np.flatnonzero(island != name)
                for at in range(0, len(own), step := max(1, CELLS // len(others))):
                    far = self.far(self.centroids[own[at : at + step]])[:, others]
                    a, b = np.unravel_index(far.argmin(), far.shape)
                    best = min(best, (far[a, b], own[at + a], others[b]))
                links[best[1]].add(int(best[2]))
                links[best[2]].add(int(best[1]))

    def search(self, x: np.ndarray, reach: float) -> np.ndarray:
        """Distance of each vector to the centroids found within ``1 + reach`` of its nearest; infinite elsewhere.

        Each step goes on from every vector's closest centroid not yet left, until it is
        out of reach and enough were looked at.
        """
        rows, k = np.arange(len(x)), len(self.centroids)
        far, waiting = np.full((len(x), k + 1), np.inf), np.full((len(x), k), np.inf)
        far[:, self.entries] = waiting[:, self.entries] = self.far(x, np.broadcast_to(self.entries, (len(x), len(self.entries))))
        bound = (1 + reach) ** 2
        for turn in range(k):
            at = waiting[rows].argmin(1)
            near = waiting[rows, at]
            go = np.isfinite(near) & ((near <= bound * far[rows].min(1)) | (turn < LOOKED_AT))
            rows, at = rows[go], at[go]
            if not len(rows):
                break
            waiting[rows, at] = np.inf
            to = self.links[at]
            new = (to >= 0) & np.isinf(far[rows[:, None], to])
            r, c = np.nonzero(new)
            d = np.maximum((x[rows[r]] ** 2).sum(1) + self.norms[to[r, c]] - 2 * np.einsum("ij,ij->i", x[rows[r]], self.centroids[to[r, c]]), 0)
            far[rows[r], to[r, c]] = waiting[rows[r], to[r, c]] = d
        far = far[:, :k]
        return np.sqrt(np.where(far <= bound * far.min(1, keepdims=True), far, np.inf))

    def searches(self, x: np.ndarray, reach: float) -> Iterator[np.ndarray]:
        for at in range(0, len(x), step := max(1, CELLS // len(self.centroids))):
            yield self.search(x[at : at + step], reach)

    def posted(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists of each candidate: the nearest, and others at the boundary."""
        out = []
        for far in self.searches(x, BOUNDARY):
            order = np.argsort(far, axis=1, kind="stable")[:, :REPLICAS]
            out += [o[np.isfinite(f[o])] for o, f in zip(order, far)]
        return out

    def chosen(self, x: np.ndarray, reach: float) -> list[np.ndarray]:
        """Lists that each query reads."""
        return [np.flatnonzero(np.isfinite(f)) for far in self.searches(x, reach) for f in far]


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Candidates with the component that makes all norms ``most``, in its units."""
    x = x / most
    return np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(1, keepdims=True), 0))])


def levelled(x: np.ndarray) -> np.ndarray:
    """Queries of norm 1, and 0."""
    x = x / np.abs(x).max(1, keepdims=True)
    return np.hstack([x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros((len(x), 1))])


def reach_of(lists: Lists, sample: np.ndarray, most: float, nearest: int, target: float) -> float:
    """Least reach that leads ``target`` of the true neighbours within the sample to their queries."""
    tried = sample[:: max(1, len(sample) // TRIED)]
    far, k = np.sqrt(lists.far(levelled(tried))), min(nearest + 1, len(sample))
    true = np.argpartition(-(tried @ sample.T), k - 1, axis=1)[:, :k]
    own, at = np.unique(true, return_inverse=True)
    posted = lists.posted(lifted(sample[own], most))
    needed = [f[posted[j]].min() / f.min() - 1 if f.min() else 0.0 for f, js in zip(far, at.reshape(true.shape)) for j in js]
    return float(np.quantile(needed, target, method="higher")) + 1e-9


def fit(vectors: DataFrame, rows: int, dims: int, most: float, *, nearest: int = NEAREST, target: float = TARGET) -> tuple[Lists, float]:
    """The lists and the reach, from at most ``SAMPLE`` of the vectors (h1, embedding).

    What is brought together, fitted and broadcast is bounded by ``SAMPLE`` and
    ``SAMPLE_NUMBERS``, whatever the table's size.
    """
    sample = common.sample_by_hash(vectors, "h1", max(1, min(SAMPLE, SAMPLE_NUMBERS // dims)))
    x = np.array([r[0] for r in sample.select("embedding").collect()], float)
    lists = Lists(centroids_of(lifted(x, most), max(1, min(round(rows**0.5), len(x) // PER_LIST))))
    return lists, reach_of(lists, x, most, nearest, target)


# The search.


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding in doubles) of the rows that take part."""
    own = common.only(embeddings, "vec_id", "embedding")
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return own.filter(F.col("vec_id").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists_of(vectors: DataFrame, shared, queries: bool) -> DataFrame:
    """``vectors`` with the lists each goes to, or reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, reach, most = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"))
                own = lists.chosen(levelled(x), reach) if queries else lists.posted(lifted(x, most))
                offsets = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(own), pa.int32()))], [*batch.schema.names, "lists"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{kinds}, lists array<int>")


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The ``most`` best rows of each query: largest score, ties the smaller id; an id once, with its best score."""
    order = np.lexsort((-score, ids, query))
    query, score, ids = query[order], score[order], ids[order]
    once = np.append(True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]))[: len(query)]
    query, score, ids = query[once], score[once], ids[once]
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < most
    return query[keep], score[keep], ids[keep]


def met(queries: np.ndarray, x: np.ndarray, ids: list[np.ndarray], most: int) -> tuple[np.ndarray, ...]:
    """(query, score, id) of the ``most`` best candidates of each query among the classes of vectors ``x``.

    A table of products shows which can be among the best; their scores are summed
    term by term, so that a pair has one score wherever it meets.
    """
    out = []
    for at in range(0, len(queries), step := max(1, CELLS // max(1, len(x)))):
        own = queries[at : at + step]
        near = own @ x.T
        if len(x) > most:
            # Sums in another order differ by less than this.
            slack = 1e-13 * np.linalg.norm(own, axis=1) * np.linalg.norm(x, axis=1).max() * own.shape[1]
            q, c = np.nonzero(near >= (np.partition(near, len(x) - most, axis=1)[:, len(x) - most] - slack)[:, None])
        else:
            q, c = (i.ravel() for i in np.indices(near.shape))
        score = np.add.accumulate(own[q] * x[c], axis=1)[:, -1]
        many = np.array([len(ids[k]) for k in c], np.int64)
        out.append(best(np.repeat(q + at, many), np.repeat(score, many), np.concatenate([ids[k] for k in c]) if len(c) else np.zeros(0, np.int64), most))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))


def _scores(dealt: DataFrame, most: int) -> DataFrame:
    """(h1, h2, score, vec_id): in each part, the best of each query that reads it.

    Rows come sorted: a part's classes before its queries.  Both are bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in common.batches(batches):
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(starts, starts[1:]):
                if keys[a] != key:
                    yield from _meet(rows, most)
                    key, rows = keys[a], []
                rows.append(batch.slice(a, b - a))
        yield from _meet(rows, most)

    return dealt.mapInArrow(run, "h1 long, h2 long, score double, vec_id long")


def _meet(rows: list[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    if not rows:
        return
    table = pa.Table.from_batches(rows).combine_chunks()
    turn = table["turn"].to_numpy()
    n = int((turn == 0).sum())
    if n == 0 or n == len(turn):
        return
    x = _matrix(table["embedding"].combine_chunks())
    query, score, ids = met(x[n:], x[:n], [np.array(v, np.int64) for v in table["ids"].slice(0, n).to_pylist()], most)
    at = pa.array(n + query)
    yield pa.RecordBatch.from_arrays([table["h1"].combine_chunks().take(at), table["h2"].combine_chunks().take(at), pa.array(score), pa.array(ids)], ["h1", "h2", "score", "vec_id"])


KEY = ["h1", "h2"]


def search(embeddings: DataFrame, *, nearest: int = NEAREST, every: int = EVERY, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found of each row whose vec_id ``every`` divides.

    Nearness is the inner product in doubles of the original vectors; ties go to the
    smaller vec_id.  Rows without an id and vectors that are null, empty, zero, or
    hold a null or a number that is not finite take no part; nor do those whose length
    is not the most common one (ties: the longest), as they have no inner product with
    the others.  Rows that repeat an id are that one item: a query's own rows are no
    candidates of it, and a candidate has the best score of its vectors.  Empty table:
    no rows.  Fewer candidates than ``nearest``: all that are found.  Other columns
    are ignored, whatever their names.  Two 64-bit hashes stand for a vector where
    copies are counted as one class.
    """
    spark = embeddings.sparkSession
    points = usable(embeddings).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    length = points.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).alias("most"))
    common_length = length.orderBy(F.desc("n"), F.desc("dims")).first()
    if not common_length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, rows, norm = common_length
    points = points.filter(F.size("embedding") == dims)

    # One row more than wanted: the query itself may be among them.  The window's limit works before its shuffle, so a vector that a third of the rows share stays small.
    most = nearest + 1
    once = points.groupBy(*KEY, "vec_id").agg(F.first("embedding").alias("embedding"))
    few = once.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy("vec_id"))).filter(F.col("k") <= most)
    classes = common.materialize(few.groupBy(*KEY).agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    shared = spark.sparkContext.broadcast((*fit(classes, rows, dims, norm, nearest=nearest, target=target), norm))

    posts = common.materialize(_lists_of(classes.select(*KEY, "embedding", "ids"), shared, False), "posts")
    asking = points.filter(F.pmod("vec_id", F.lit(every)) == 0)
    asked = asking.select(*KEY).distinct()
    reads = common.materialize(_lists_of(classes.join(asked, KEY, "left_semi").select(*KEY, "embedding"), shared, True), "reads")

    # As many lists as centroids, so their sizes are few.
    size = lambda df, per: df.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("parts"))
    sizes = size(posts, PART).join(size(reads, QUERIES).withColumnRenamed("parts", "turns"), "list")
    dealt_by = lambda n: F.pmod(F.xxhash64("h2"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda df, part, copy, turn, ids: df.withColumn("list", F.explode("lists")).join(F.broadcast(sizes), "list").select("list", part.alias("part"), copy.alias("copy"), F.lit(turn).alias("turn"), *KEY, "embedding", ids.alias("ids"))
    members = at(posts, dealt_by("parts"), each("turns"), 0, F.col("ids"))
    questions = at(reads, each("parts"), dealt_by("turns"), 1, F.array().cast("array<bigint>"))
    dealt = members.union(questions)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "list", "part", "copy").sortWithinPartitions("list", "part", "copy", "turn")
    found = _scores(dealt, most).groupBy(*KEY, "vec_id").agg(F.max("score").alias("score"))

    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), "vec_id")
    of_class = found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).groupBy(*KEY).agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))
    # A vector that many queries share meets its answer in many places.
    own = common.attach(asking.select(*KEY, F.col("vec_id").alias("query_id")).distinct().withColumn("key", F.struct(*KEY)).drop(*KEY), "key", "query_id", of_class.select(F.struct(*KEY).alias("key"), "found"))
    pairs = own.select("query_id", F.inline("found")).filter(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op11_balanced_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; the queries are the rows whose id 20 divides."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
