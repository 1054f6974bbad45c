import random

import numpy as np

from stringmill.llm import decontaminate as D

ODD = "doc_id long, text string, distance string, item_id string, first_word int"


def words(text):
    table = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
    return (text or "").lower().translate(table).split()


def nearest(item, doc):
    """Fewest edits between the item and a run of the document."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in doc:
        new = [0]
        for k in range(1, len(item) + 1):
            new.append(min(row[k - 1] + (item[k - 1] != w), row[k] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def brute(docs, items):
    out = set()
    for item_id, t in items:
        w = words(t)
        if w:
            for d, text in docs:
                e = nearest(w, words(text))
                if e <= D.edits(len(w)):
                    out.add((d, item_id, e, len(w)))
    return out


def spoil(rnd, w, n):
    w = list(w)
    for _ in range(n):
        k = rnd.randrange(len(w))
        kind = rnd.randrange(3)
        if kind == 0:
            w[k] = f"s{rnd.randint(0, 9999)}"
        elif kind == 1:
            del w[k]
        else:
            w.insert(k, f"i{rnd.randint(0, 9999)}")
    return w


def test_recall_of_the_index():
    """Copies with the most allowed edits become candidates, whatever the length; unrelated texts rarely do."""
    rnd = random.Random(1)
    vocabulary = [f"v{k}" for k in range(3000)]
    for n in (6, 8, 10, 15, 37, 60, 100, 250, 600):
        trials = 150 if n < 100 else 40
        own = [[rnd.choice(vocabulary) for _ in range(n)] for _ in range(trials)]
        items = D.Items([(k, " ".join(w)) for k, w in enumerate(own)])
        hit = 0
        for k, w in enumerate(own):
            around = [rnd.choice(vocabulary) for _ in range(20)]
            h = D.word_hashes(" ".join(around + spoil(rnd, w, D.edits(n)) + around))
            found = items.candidates(np.append(h, np.uint64(0)), np.array([len(h)]))
            which = {items.ids[i][0] for i in found[:, 0]}
            hit += k in which
        print("recall at", n, "words", hit / trials)
        assert hit >= 0.95 * trials, (n, hit)
        noise = D.word_hashes(" ".join(rnd.choice(vocabulary) for _ in range(20_000)))
        assert len(items.candidates(np.append(noise, np.uint64(0)), np.array([len(noise)]))) < 2_000


def test_recall_in_documents(spark):
    """Items of sf0.01 with the most allowed edits, put into documents of sf0.01: the whole search finds them."""
    rnd = random.Random(8)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    index, found = D.Items(items), 0
    for text in docs:
        item_id, own = rnd.choice(items)
        w, put = words(text), spoil(rnd, words(own), D.edits(len(words(own))))
        at = rnd.randint(0, len(w))
        found += any(item_id in index.ids[i] for _, item, *_ in index.held([" ".join(w[:at] + put + w[at:])]) for i in item.tolist())
    print("recall in documents", found / len(docs))
    assert found >= 0.95 * len(docs)


def test_nearest_runs():
    def one(item, window):
        cost, first = D.nearest_runs(np.array([item], np.uint64), np.array([window], np.uint64).reshape(1, -1))
        return int(cost[0]), int(first[0])

    assert one([1, 2, 3], [9, 1, 2, 3, 9]) == (0, 1)
    assert one([1, 2, 3], [9, 1, 3]) == (1, 1)
    assert one([1, 2, 3], [1, 2, 3, 1, 2, 3]) == (0, 0)
    assert one([1, 2], []) == (2, 0)
    rnd = random.Random(4)
    for _ in range(300):
        a, b = [rnd.randint(1, 4) for _ in range(rnd.randint(1, 9))], [rnd.randint(1, 4) for _ in range(rnd.randint(0, 15))]
        assert one(a, b)[0] == nearest(a, b)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "", "", 0) for d in docs], ODD).repartition(3), spark.createDataFrame([(i, t, "") for i, t in items], "item_id long, text string, doc_id string")


def test_planted_copies_and_odd_rows(spark, monkeypatch):
    rnd = random.Random(3)
    items = [(k, " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(5, 45)))) for k in range(40)]
    items += [(50, "w7 w8"), (51, "W9"), (52, "w1 w2 w3 w4"), (53, items[5][1]), (40, None), (41, ""), (None, "this item has no number at all"), (3, items[3][1])]
    docs = [(None, None), (0, ""), (1, "x " * 60_000)]
    for k in range(2, 120):
        w = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.choice([0, 1, 2])):
            own = rnd.choice(items[:40])[1].split()
            at = rnd.randint(0, len(w))
            w[at:at] = spoil(rnd, own, rnd.randint(0, int(D.RATE * len(own)) + 1))
        docs.append((k, rnd.choice([" ", "\n", ", "]).join(w).title()))
    docs += [(201, "w1 w2 w3"), (202, "x w1 w2 w3 w4 y"), (203, "w7"), (204, "w8 w7 w8"), (205, "a rare w9")]
    docs.append((200, "so: This item, has no NUMBER at all!"))
    want = brute(docs, items)
    assert len(want) > 40
    for block in (D.BLOCK_ITEMS, 10):
        monkeypatch.setattr(D, "BLOCK_ITEMS", block)
        d, b = frames(spark, docs, items)
        rows = D.find_items(d, b).collect()
        assert {(r.doc_id, r.item_id, r.distance, r.item_words) for r in rows} == want
        assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
        left = D.drop_contaminated(d, b)
        assert left.columns == d.columns
        assert sorted((r.doc_id for r in left.collect()), key=str) == sorted({k for k, _ in docs} - {w[0] for w in want}, key=str)


def test_empty_tables(spark):
    d, b = frames(spark, [], [])
    assert D.find_items(d, b).collect() == [] and D.drop_contaminated(d, b).collect() == []


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id, r.distance, r.item_words) for r in D.op6_cgk_decontamination(spark, sf_dir).collect()}
    common = {(i, w) for i, t in items for w in words(t)}
    near = [(d, t) for d, t in docs if any(len({w for j, w in common if j == i} & set(words(t))) > 4 for i, _ in items)]
    assert got == brute(near, items) and got
