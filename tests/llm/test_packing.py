import itertools
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from stringmill.llm import packing

from .test_token_ids import brute_ids, crc

ODD = "doc_id long, text string, length string, part int"


def bins_needed(items, capacity):
    """Smallest number of bins, by trying all ways."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= items[k]:
                go(k + 1, rooms[:i] + [rooms[i] - items[k]] + rooms[i + 1 :])
        go(k + 1, rooms + [capacity - items[k]])

    if items:
        go(0, [])
    return best[0] if items else 0


def held(layouts):
    out = Counter()
    for n, content in layouts:
        for w, k in content:
            out[w] += n * k
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_the_best_number_of_bins(items):
    fixed, rest = packing.reduce_by_dominance(Counter(items), 20)
    assert held(fixed) + Counter(rest) == Counter(items)
    assert all(sum(w * k for w, k in c) <= 20 for _, c in fixed)
    left = list(itertools.chain.from_iterable([w] * n for w, n in rest.items()))
    assert sum(n for n, _ in fixed) + bins_needed(left, 20) == bins_needed(items, 20)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 300), max_size=30))
def test_layouts_hold_every_item_once(histogram):
    layouts = packing.lay_out(histogram, 50)
    assert held(layouts) == Counter(histogram)
    assert all(sum(w * k for w, k in c) <= 50 for _, c in layouts)


def check(got, rows, capacity):
    by_doc = defaultdict(list)
    places = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for (doc_id, text), ids in zip(rows, brute_ids([t for _, t in rows])):
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[doc_id].append((piece, at, len(own), crc(own)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_odd_rows(spark):
    rows = [(1, "one two three " * 40), (1, "one two three " * 40), (None, "x"), (2, None), (3, ""), (4, "word " * 333), (5, "same"), (6, "same")]
    docs = spark.createDataFrame([(*r, "z", 0) for r in rows], ODD)
    check(packing.pack(docs, capacity=64).collect(), rows, 64)
    assert packing.pack(docs.limit(0)).collect() == []


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = packing.op1_best_fit_packing(spark, sf_dir).collect()
    n = check(got, rows, packing.CAPACITY)
    total = sum(r.length for r in got)
    assert n <= -(-total // packing.CAPACITY) + 1
