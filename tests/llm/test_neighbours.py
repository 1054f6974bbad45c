"""Posting lists against brute force: recall, scores, ties, copies and odd rows."""

import math

import numpy as np
import pytest

from stringmill.llm import common, neighbours

SCHEMA = "VEC_ID string, vec_id long, embedding array<float>, score string, Embedding string"


def frame(spark, rows):
    return spark.createDataFrame([("w", i, None if v is None else [None if c is None else float(c) for c in v], "s", "e") for i, v in rows], SCHEMA)


def brute(rows, nearest=20, every=20):
    """All pairs, sums in doubles from the first component on; rows of one id are one item."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    lengths = [len(v) for _, v in good]
    dims = max(set(lengths), key=lambda d: (lengths.count(d), d), default=0)
    good = [(i, v) for i, v in good if len(v) == dims]
    out = {}
    for q in sorted({i for i, _ in good if i % every == 0}):
        best = {}
        for i, x in good:
            if i != q:
                s = max(float(np.add.accumulate(x * y)[-1]) for j, y in good if j == q)
                best[i] = max(s, best.get(i, -math.inf))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:nearest]
    return {(q, k, i, -s) for q, own in out.items() for k, (s, i) in enumerate(own, 1)}


def rows_of(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def recall(got, want):
    pairs = lambda s: {(q, i) for q, _, i, _ in s}
    return len(pairs(got) & pairs(want)) / len(pairs(want))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(12, size=700)] + 0.2 * rng.normal(size=(700, 16)), rng.normal(size=(300, 16))])
    return list(enumerate((x * rng.uniform(0.2, 3, size=(1000, 1))).astype(np.float32).tolist()))


def test_norms_that_differ(spark, clustered):
    got, want = rows_of(neighbours.search(frame(spark, clustered))), brute(clustered)
    assert recall(got, want) >= 0.9
    score = {(q, i): s for q, _, i, s in brute(clustered, nearest=1000)}
    assert all(score[q, i] == s for q, _, i, s in got)
    for q in {q for q, *_ in got}:
        own = sorted((k, i, s) for p, k, i, s in got if p == q)
        assert [k for k, *_ in own] == list(range(1, 21)) and own == [(k, i, s) for k, (_, i, s) in enumerate(sorted((-s, i, s) for _, i, s in own), 1)]


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert recall(rows_of(neighbours.op11_balanced_lists(spark, sf_dir)), brute(rows)) >= 0.9


def test_copies_ties_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    some = rng.integers(-3, 4, size=(200, 6)).astype(float)
    # A third of all rows is one vector; many others tie.
    rows = [(k, v) for k, v in enumerate(some.tolist()) if any(v)] + [(1000 + k, [1, 2, 0, 0, 1, -1]) for k in range(100)]
    rows += [(40, [3, 3, 3, 3, 3, 3]), (40, [3, 3, 3, 3, 3, 3]), (7, [-9, 9, 9, 9, -9, 9]), (1020, [1, 2, 0, 0, 1, -1]), (-20, [0, 0, 0, 0, 0, 1])]
    assert rows_of(neighbours.search(frame(spark, rows), target=1.0)) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1, 2]), (1, [2, 1]), (2, None), (3, []), (4, [0, 0]), (5, [1, None]), (6, [math.nan, 1]), (7, [math.inf, 1]), (None, [1, 1]), (20, [1, 2, 3]), (40, [-1, -1]), (60, None)]
    assert rows_of(neighbours.search(frame(spark, rows))) == brute(rows) != set()
    assert neighbours.search(frame(spark, rows[2:5])).collect() == [] == neighbours.search(frame(spark, [])).collect()
    assert neighbours.search(frame(spark, [(20, [1, 1])])).collect() == []
    assert rows_of(neighbours.search(frame(spark, [(0, [1, 1]), (1, [-1, 1])]))) == {(0, 1, 1, 0.0)}


def test_parts_of_a_list(spark, clustered, monkeypatch):
    whole = rows_of(neighbours.search(frame(spark, clustered), every=3))
    monkeypatch.setattr(neighbours, "PART", 7)
    monkeypatch.setattr(neighbours, "QUERIES", 5)
    assert rows_of(neighbours.search(frame(spark, clustered), every=3)) == whole


def test_balanced_centroids_and_graph():
    rng = np.random.default_rng(7)
    # Ten far islands: the graph has to lead from one to the next.
    x = np.concatenate([rng.normal(size=(150, 8)) * 0.1 + 50 * rng.normal(size=8) for _ in range(10)])
    sizes = np.bincount(neighbours.split_evenly(x, 6, rng))
    assert sizes.max() <= 250 and sizes.sum() == len(x)
    lists = neighbours.Lists(neighbours.centroids_of(x, 150))
    assert 100 <= len(lists.centroids) <= 200
    q = np.concatenate([x[::11], 60 * rng.normal(size=(100, 8))])
    far = np.sqrt(lists.far(q))
    found = lists.search(q, 0.2)
    want = far <= 1.2 * far.min(1, keepdims=True)
    assert (np.isfinite(found) & want).sum() >= 0.98 * want.sum()
    assert np.allclose(found[np.isfinite(found)], far[np.isfinite(found)])


def test_sample_is_bounded(spark, clustered, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 200)
    sizes = []
    fit = neighbours.centroids_of
    monkeypatch.setattr(neighbours, "centroids_of", lambda x, *a: sizes.append(len(x)) or fit(x, *a))
    got = rows_of(neighbours.search(frame(spark, clustered)))
    assert sizes == [200] and recall(got, brute(clustered)) >= 0.9
    common.remove_scratch(spark)
