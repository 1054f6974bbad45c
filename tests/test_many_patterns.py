"""Many patterns in one pass, the stored suffix table, suffix trees and long texts, against brute force."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from stringmill.functions import arrays as A
from stringmill.operators import exact, index, multi, report, suffixes
from stringmill.plans import catalogue


def frames(spark, texts, patterns):
    return spark.createDataFrame(list(enumerate(texts)), "text_id int, text string").repartition(3), spark.createDataFrame(list(enumerate(patterns)), "pattern_id int, pattern string")


TEXTS = ["", None, "a", "abababab", "é\U0001f600é\U0001f600é", "x\ny", "ab" * 3000, "abc"]
PATTERNS = ["ab", "aba", "b", "ab", "", None, "é\U0001f600", "\n", "zz", "ab" * 200, "abababab"]


def places(texts, patterns):
    return sorted((k, j, i) for k, t in enumerate(texts) for j, p in enumerate(patterns) if t and p for i in range(len(t)) if t.startswith(p, i))


@pytest.mark.parametrize("letters", [1_000_000, 60])
def test_places_of_all_patterns(spark, letters, monkeypatch):
    monkeypatch.setattr(multi, "HIT_ROWS", 700)
    t, p = frames(spark, TEXTS, PATTERNS)
    assert sorted(tuple(r) for r in multi.search(t, p, letters=letters).collect()) == places(TEXTS, PATTERNS)
    got = {r.pattern_id: (r.n, r.texts) for r in multi.counts(t, p, letters=letters).collect()}
    want = places(TEXTS, PATTERNS)
    assert got == {j: (sum(x[1] == j for x in want), len({x[0] for x in want if x[1] == j})) for j in range(len(PATTERNS))}


def test_more_patterns_than_an_automaton_takes_pass_over_the_texts_once(spark):
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice("ab é") for _ in range(300)) for _ in range(20)]
    patterns = PATTERNS + [x[a : a + n] for x in texts[8:] for a, n in ((3, 31), (5, 32), (9, 33), (1, 64), (0, 100), (7, 1), (2, 16), (50, 20))]
    t, p = frames(spark, texts, patterns)
    # Only patterns of fewer letters than are looked for by their beginning: one table of texts is read, once.
    short = p.filter(F.length("pattern") < multi.LONG)
    plan = multi.search(t, short, letters=60)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted(tuple(r) for r in multi.search(t, p, letters=60).collect()) == places(texts, patterns)


def test_no_patterns(spark):
    t, p = frames(spark, TEXTS, [None, ""])
    out = multi.search(t, p)
    assert out.collect() == [] and out.columns == ["text_id", "pattern_id", "pos"]
    assert sorted(tuple(r) for r in multi.counts(t, p).collect()) == [(0, 0, 0), (1, 0, 0)]


def test_time_does_not_follow_the_number_of_patterns():
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(150_000))
    took = []
    for n in (50, 5000):
        words = sorted({text[(at := rnd.randrange(len(text) - 40)) : at + 40] for _ in range(n)})
        machine = multi.automaton(words)
        took.append(min(_timed(lambda m=machine: sum(1 for _ in m.iter(text))) for _ in range(5)))
    assert took[1] <= 3 * took[0]


def _timed(f):
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def rows_read(df):
    """Rows that the scans of a frame gave, by their metrics."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    leaves = plan.collectLeaves() if not plan.getClass().getSimpleName().startswith("Adaptive") else plan.executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()) if leaves.apply(k).metrics().contains("numOutputRows"))


def test_suffix_table(spark, tmp_path):
    texts = [t for t in TEXTS if t is not None] + ["".join(random.Random(k).choice("abcdefgh") for _ in range(3000)) for k in range(12)]
    t, _ = frames(spark, texts, [])
    path = f"{tmp_path}/table"
    suffixes.write_table(t, path, files=6)
    table = spark.read.parquet(path)
    assert sorted(tuple(r) for r in table.collect()) == sorted((t[i : i + 32], k, i) for k, t in enumerate(texts) for i in range(len(t)))
    words = ["ab", "abc", "h", "é\U0001f600", "zz", "\U0001f600", texts[8][5:45], "ab" * 20, texts[-1][100:104]]
    p = spark.createDataFrame([(w,) for w in words], "pattern string")
    got = suffixes.find(spark, path, p, t)
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, w, i) for k, t in enumerate(texts) for w in words for i in range(len(t)) if t.startswith(w, i))
    with pytest.raises(ValueError, match="texts"):
        suffixes.find(spark, path, p)
    # A second search sorts nothing, and reads little of the table.
    one = suffixes.find(spark, path, spark.createDataFrame([(texts[-1][100:106],)], "pattern string"))
    plan = one._jdf.queryExecution().toString()
    assert "Sort" not in plan and "PushedFilters" in plan and "GreaterThanOrEqual(suffix" in plan
    scan = suffixes.in_intervals(table, [texts[-1][100:106]])
    assert 0 < rows_read(scan) < table.count() / 4
    assert suffixes.behind("a") == "b" and suffixes.behind("퟿") == "" and suffixes.behind("a\U0010ffff") == "b" and suffixes.behind("\U0010ffff") is None


def test_suffix_table_is_small_and_shuffles_texts_only(spark, tmp_path, monkeypatch):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(("the", "there", "ere", "on", "station", "banana")) for _ in range(400)) for _ in range(40)] + ["ab" * 3000, "\U0001f600é"]
    t, _ = frames(spark, texts, [])
    # Texts are cut where a file would have too many letters, here in the middle of one.
    monkeypatch.setattr(suffixes, "FILE_LETTERS", 2500)
    suffixes.write_table(t, f"{tmp_path}/t", kept=8, files=3)
    table = spark.read.parquet(f"{tmp_path}/t")
    assert sorted(tuple(r) for r in table.collect()) == sorted((x[i : i + 8], k, i) for k, x in enumerate(texts) for i in range(len(x)))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert size < 10 * sum(map(len, texts))
    p = spark.createDataFrame([(w,) for w in ("a", "babab", "ab" * 6, texts[3][7:30])], "pattern string")
    got = suffixes.find(spark, f"{tmp_path}/t", p, t, kept=8)
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, w, i) for k, x in enumerate(texts) for w in (r[0] for r in p.collect()) for i in range(len(x)) if x.startswith(w, i))


def test_order_and_shared_letters_of_suffixes():
    rnd = random.Random(7)
    for n in (0, 1, 2, 30, 200):
        for letters in ("a", "ab", "aé\U0001f600", "".join(map(chr, range(40, 400)))):
            text = "".join(rnd.choice(letters) for _ in range(n)) * rnd.choice((1, 3))
            order, shared = A.suffix_order_and_shared(A.codes(text))
            assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
            assert shared.tolist() == [0 if k == 0 else len(os.path.commonprefix([text[order[k - 1] :], text[order[k] :]])) for k in range(len(text))]


def tree(text):
    """Nodes by all substrings: (letters, parent's, first place, places, link's)."""
    at = {"": list(range(len(text)))}
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            at.setdefault(text[i:j], []).append(i)
    ways = {w: {text[i + len(w) : i + len(w) + 1] for i in own} for w, own in at.items()}
    inner = {w for w in at if w == "" or len(ways[w]) > 1}
    leaves = {w for w in at if w not in inner and ways[w] == {""}}
    return {(w, max((v for v in inner if v != w and w.startswith(v)), key=len, default=None), min(at[w], default=0), len(at[w]), w[1:] if w in inner and w else None) for w in inner | leaves}


def test_suffix_trees(spark):
    rnd = random.Random(2)
    texts = ["", "a", "aa", "banana", "mississippi", "é\U0001f600é"] + ["".join(rnd.choice("ab" if k % 2 else "abcd") for _ in range(rnd.randint(1, 40))) for k in range(40)]
    t, _ = frames(spark, texts, [])
    rows = suffixes.suffix_tree(t).collect()
    for k, text in enumerate(texts):
        own = {r.node: r for r in rows if r.text_id == k}
        letters = lambda n: None if n is None else text[own[n].start : own[n].start + own[n].depth]  # noqa: B023, E731
        assert {(letters(n), letters(r.parent), r.start, r.leaves, letters(r.link)) for n, r in own.items()} == tree(text)
    sizes = {r.text_id: r for r in suffixes.tree_sizes(t).collect()}
    nodes = {r.text_id: r.nodes for r in index.trie_sizes(t).collect()}
    assert all(sizes[k].letters + 1 == nodes[k] for k in range(len(texts)))


def test_long_texts_take_linear_time():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("acgt") for _ in range(n)) for n in (125_000, 500_000)]
    short, long = (min(_timed(lambda t=t: suffixes.tree_nodes(t)) for _ in range(2)) for t in texts)
    assert long < 8 * short
    assert _timed(lambda: A.window_hashes(texts[1], 2943)) < 1


def test_sizes_take_no_nodes(spark, monkeypatch):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("acgt") for _ in range(n)) * k for n, k in ((0, 1), (1, 1), (7, 3), (900, 1), (300, 3))]
    nodes = [suffixes.tree_nodes(t) for t in texts]
    want = [(int((x[5] >= 0).sum()) + 1, len(x[0]) - int((x[5] >= 0).sum()) - 1, int((x[2][1:] - x[2][x[1][1:]]).sum())) for x in nodes]
    monkeypatch.setattr(suffixes, "tree_nodes", None)
    assert [suffixes.sizes_of(t) for t in texts] == want


def _best(f, text):
    return min(_timed(lambda: f(text)) for _ in range(3)) / len(text)


def test_seconds_a_letter():
    """Of texts as documents have them: plain slices sorted take eight times as long, ranks by doubled lengths took five times."""
    rnd = random.Random(9)
    text = " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(4000))
    sort = _best(lambda t: sorted(range(len(t)), key=lambda i: t[i : i + 60]), text)
    assert _best(A.suffix_order, text) < 0.4 * sort
    assert _best(index._substrings, text) < 0.5 * sort
    assert _best(lambda t: exact.common_substring(t[: len(t) // 2], t[len(t) // 2 :]), text) < 0.5 * sort


def _mixed(rnd):
    letters = rnd.choice(("a", "ab", "aé\U0001f600", "\0a", "\0", "".join(map(chr, range(40, 400)))))
    return "".join(rnd.choice(letters) for _ in range(rnd.choice((0, 1, 5, 40)))) * rnd.choice((1, 1, 4))


def test_suffixes_of_several_texts_at_once():
    rnd = random.Random(10)
    for _ in range(60):
        texts = [_mixed(rnd) for _ in range(rnd.randint(1, 6))]
        texts += texts[:1]
        order, shared, ends = A.suffix_orders_of(texts)
        assert A.suffix_orders_of(texts, share=False)[0].tolist() == order.tolist()
        for text, end in zip(texts, ends.tolist()):
            own = slice(end - len(text), end + 1)
            alone = A.suffix_order_and_shared(A.codes(text))
            assert (order[own] - own.start).tolist() == [len(text), *sorted(range(len(text)), key=lambda i: text[i:])] == [len(text), *alone[0].tolist()]
            assert shared[own].tolist() == [0, *alone[1].tolist()]
    few = [_mixed(rnd) for _ in range(200)] + ["x" * 2 * A.RUN_LETTERS, "", "y"]
    runs = list(A.runs_of_texts(few))
    assert [k for a, b in runs for k in range(a, b)] == list(range(len(few))) and len(runs) < 5 and list(A.runs_of_texts([])) == []


def test_sizes_of_several_texts_at_once():
    rnd = random.Random(11)
    texts = [_mixed(rnd) for _ in range(150)] + ["a" * 90, "ab" * 50 + "c" + "ab" * 49]
    inner, leaves, letters = suffixes.sizes_of_each(texts)
    for k, text in enumerate(texts):
        nodes = suffixes.tree_nodes(text)
        assert (inner[k], inner[k] + leaves[k]) == ((nodes[5] >= 0).sum() + 1, len(nodes[0]))
        assert letters[k] == len({text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)})


def test_seconds_of_short_texts():
    """Text by text the sizes took as long as this sort, the order of the suffixes 0.45 of it."""
    rnd = random.Random(12)
    texts = [" ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(150)) for _ in range(80)]
    sort = _best(lambda own: [sorted(range(len(t)), key=lambda i: t[i : i + 60]) for t in own], texts)  # noqa: B023
    assert _best(suffixes.sizes_of_each, texts) < 0.65 * sort
    assert _best(lambda own: list(A.suffix_orders_each(own)), texts) < 0.3 * sort


def test_sizes_of_deep_trees_take_linear_time():
    for deep in ("a" * 200_000, "ab" * 100_000 + "c" + "ab" * 50_000):
        assert _timed(lambda: suffixes.sizes_of(deep)) < 5  # noqa: B023


def test_window_hashes_of_any_base():
    rnd = random.Random(4)
    for base, prime in ((256, 101), (256, 128), (101, 101), (31, 1_000_003), (256, (1 << 31) - 1), (256, (1 << 61) - 1)):
        text = "".join(rnd.choice("abé\U0001f600") for _ in range(50))
        for m in (1, 2, 7, 50):
            if prime < 1 << 40:
                assert A.window_hashes(text, m, base, prime).tolist() == [exact.rolled(text[i : i + m], base, prime) for i in range(51 - m)]
    assert len(A.window_hashes("ab", 3)) == 0 == len(A.window_hashes("ab", 0))


def test_pieces_are_cut_once(spark):
    text = "ab\né\U0001f600" * 100_000
    t = spark.createDataFrame([(1, text)], "text_id int, text string")
    words = ["b\né", "\U0001f600a", "q", "é\U0001f600ab\n" * 1000]
    p = spark.createDataFrame([(w,) for w in words], "pattern string")
    got = sorted((r.pattern, r.pos) for r in exact.chunked(t, p, 1000).collect())
    want = sorted((w, i) for w in words for i in ([*range(1, 500_000, 5)] if w == words[0] else [*range(4, 499_996, 5)] if w == words[1] else [*range(3, 500_000 - 5000 + 3, 5)] if w == words[3] else []) if text.startswith(w, i))
    assert got == want


def test_neighbours_over_gaps(spark):
    t = spark.createDataFrame([(1, "xabcx"), (30, "yabcy"), (7_000_000_000, None), (-5, "bcx")], "text_id long, text string")
    got = {r.text_id: r.common for r in catalogue.neighbours(t).collect()}
    assert got == {-5: "bcx", 1: "abc", 30: "", 7_000_000_000: ""}
    ids = sorted(random.Random(5).sample(range(10**6), 500))
    df = spark.createDataFrame([(i,) for i in ids * 2], "text_id long").withColumn("text", F.lit("x"))
    assert {r.text_id: r.next for r in report.next_of_each(df, "text_id", 7).collect()} == dict(zip(ids, [*ids[1:], None]))


def test_suffix_rows_come_from_short_pieces(spark):
    texts = ["é\U0001f600abc " * 30, "x" * 31, "y" * 32, "z" * 33, "", None]
    t, _ = frames(spark, texts, [])
    for length in (1, 8, 40):
        assert sorted(tuple(r) for r in exact.suffixes(t, length).collect()) == sorted((k, i, x[i : i + length]) for k, x in enumerate(texts) if x for i in range(len(x)))
    assert "{1,32}" in exact.suffixes(t, 8)._jdf.queryExecution().logical().toString()
