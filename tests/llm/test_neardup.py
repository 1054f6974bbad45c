import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringmill.llm import common
from stringmill.llm import neardup as N

ODD = "doc_id long, text string, n_shingles string, rep string, bands string"


def sets(rows):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    """(doc_id, n, component, kept) by comparing all pairs that share a shingle."""
    own = sets(rows)
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    index, by_id = {}, {}
    for k, s in enumerate(own):
        for x in s:
            index.setdefault(x, []).append(k)
        by_id.setdefault(rows[k][0], []).append(k)
    for k, s in enumerate(own):
        if rows[k][0] is None:
            continue
        near = {}
        for x in s:
            for j in index[x]:
                if j < k and rows[j][0] is not None:
                    near[j] = near.get(j, 0) + 1
        for j, both in near.items():
            if 100 * both >= 75 * (len(s) + len(own[j]) - both):
                up[root(k)] = root(j)
    for d, ks in by_id.items():
        if d is not None:
            for k in ks[1:]:
                if own[k] and own[ks[0]]:
                    up[root(k)] = root(ks[0])
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    return sorted(((d, len(own[k]), None if d is None else least[root(k)], d is None or d == least[root(k)]) for k, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "", "", "") for r in rows], ODD).repartition(4)
    return sorted((tuple(r) for r in N.group(docs, **kw).collect()), key=str)


def prose(rnd, n):
    return [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.75, 0.95):
        errors = []
        for _ in range(40):
            u = rng.integers(0, 1 << 63, 400).astype(np.uint64)
            k = int(round(200 * 2 * share / (1 + share)))
            a, b = u[:200], u[200 - k : 400 - k]
            errors.append((N.superminhash(a, 120) == N.superminhash(b, 120)).mean() - len(set(a) & set(b)) / len(set(a) | set(b)))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 1.2 * (share * (1 - share) / 120) ** 0.5


def test_signature_is_that_of_the_plain_definition():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 900):
        u = rng.integers(0, 1 << 63, n).astype(np.uint64)
        m = 24
        want = [None] * m
        for x in u:
            p = list(range(m))
            for j in range(m):
                r = int(N.mix(np.array([x + np.uint64((j + 1) * int(N._K) % (1 << 64))], np.uint64))[0])
                k = j + (((r & 0xFFFFFFFF) * (m - j)) >> 32)
                p[j], p[k] = p[k], p[j]
                offer = (j << 32) | (r >> 32)
                want[p[j]] = offer if want[p[j]] is None else min(want[p[j]], offer)
        assert N.superminhash(u, m).tolist() == want


def test_odd_rows(spark):
    long = " ".join(prose(random.Random(1), 60_000))
    rows = [(5, "A b c d e f"), (5, "A b c d e f"), (6, "a  B\nc d e f"), (7, None), (8, ""), (9, " \n"), (None, "a b c d e f"), (10, "one two"), (11, "ONE two"), (12, "two one"), (13, long), (14, long + " x"), (15, "z y x w v u t"), (15, "other text of the same id here")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows, shared = [], prose(rnd, 60)
    for _ in range(40):
        base = prose(rnd, rnd.randint(3, 120))
        for _ in range(rnd.choice([1, 1, 2, 5, 30])):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 10**6)}"
            if rnd.random() < 0.2:
                w += shared
            rows.append((len(rows) * 7 % 10_007, " ".join(w)))
    got, want = run(spark, rows), brute(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    wrong = sum(a != b for a, b in zip(got, want))
    assert wrong <= len(rows) // 100  # banding finds 99.8 % of the links at the very threshold


@pytest.mark.parametrize("block", [300, 100_000])
def test_large_group_in_blocks(spark, monkeypatch, block):
    """Near copies that are often no copies of their bucket's first document."""
    monkeypatch.setattr(N, "BLOCK_OUTSIDE", block)
    monkeypatch.setattr(N, "BLOCK_ALL", block)
    rnd = random.Random(9)
    base, rows = prose(rnd, 80), []
    for k in range(120):
        w = list(base)
        for p in range(0, 3):
            w[(k * 3 + p * 29) % 80] = f"y{k}-{p}"
        rows.append((k, " ".join(w)))
    assert run(spark, rows) == brute(rows)


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 6000, rng.integers(1, 5000)).astype(np.uint64)) for _ in range(12)]
    got = N.shared_counts(sets[:5], sets[5:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]).all()


def test_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 200)] + [(500, 501), (501, 503), (502, 503)], "a long, b long").repartition(8)
    got = {r.node: r.up for r in N.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 501: 500, 502: 500, 503: 500}


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in N.op8_superminhash(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)


def test_a_hub_of_a_third_of_all_nodes(spark):
    """A star, a chain and pairs: each component by its smallest node."""
    links = [(0, k) for k in range(1, 2000)] + [(k, k + 1) for k in range(3000, 3060)] + [(2 * k, 2 * k + 1) for k in range(2500, 2600)]
    links = [(b, a) if k % 2 else (a, b) for k, (a, b) in enumerate(links)]
    got = {r.node: r.up for r in N.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == dict.fromkeys(range(1, 2000), 0) | dict.fromkeys(range(3001, 3061), 3000) | {2 * k + 1: 2 * k for k in range(2500, 2600)}


def shares_of_tasks(df):
    """(largest, median) of the rows that a frame's partitions hold, of those that hold any."""
    n = sorted(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())
    return n[-1], n[len(n) // 2]


def test_no_task_gets_a_hub(spark):
    """A centre of a third of all rows: neither its rows nor the copies of its one row meet in a few tasks."""
    n, parts = 60_000, 16
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 0L ELSE id END AS key", "id AS other")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        met = common.meet(rows, "key", F.col("other"), sizes.select("key", (F.col("key") * 2).alias("twice")), sizes, 64)
        assert met.count() == n and met.filter("twice != key * 2").isEmpty()
        most, middle = shares_of_tasks(met)
        assert most <= 3 * middle, (most, middle)
        # Keys too many to broadcast go the other way, with the same result.
        many = common.BROADCAST_KEYS
        common.BROADCAST_KEYS = 0
        again = common.meet(rows, "key", F.col("other"), sizes.select("key", (F.col("key") * 2).alias("twice")), sizes, 64)
        common.BROADCAST_KEYS = many
        assert sorted(map(tuple, again.select("key", "other", "twice").collect())) == sorted(map(tuple, met.select("key", "other", "twice").collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ids_of_narrower_types(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(5, text), (3, text), (4, "else")], "doc_id int, text string")
    assert sorted((r.doc_id, r.component_id) for r in N.group(docs).collect()) == [(3, 3), (4, 4), (5, 3)]
