"""Searches by filter and by bits, joins within edits, and alignments, against tables computed cell by cell."""

import random
import time
import tracemalloc

import pytest

from stringmill.operators import approx

from .test_operators import distance, frames


def ends(text, pattern, most):
    """The distance table, a row a character of the pattern; a hit may begin anywhere."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        old, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != t)))
    return [(e, d) for e, d in enumerate(row[1:]) if d <= most] if pattern else []


def cases(seed, n=400):
    rnd = random.Random(seed)
    for _ in range(n):
        letters = rnd.choice(["ab", "abcd", "abcdefghé\U0001f600"])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 150)))
        m = rnd.randint(0, 20)
        at = rnd.randrange(len(text) - m) if len(text) > m and rnd.random() < 0.6 else None
        yield text, "".join(rnd.choice(letters) for _ in range(m)) if at is None else text[at : at + m], rnd.randint(0, 4)


def test_filtered_search_gives_what_the_table_gives():
    for text, pattern, most in cases(1):
        assert approx.edit_ends(text, pattern, most) == ends(text, pattern, most), (text, pattern, most)


def test_starts_that_are_left_out_have_no_hit():
    for text, pattern, most in cases(2):
        if pattern and text:
            lengths, all_of = approx.start_distances(text, pattern, most)
            starts = approx.candidate_starts(text, pattern, most)
            assert set((all_of <= most).any(axis=0).nonzero()[0]) <= set(starts)
            assert (approx.start_distances(text, pattern, most, starts)[1] == all_of[:, starts]).all()


@pytest.mark.parametrize("piece", [1, 50, 1024])
def test_bits_give_what_the_table_gives(piece, monkeypatch):
    monkeypatch.setattr(approx, "BIT_PIECE", piece)
    rnd = random.Random(piece)
    for m in (1, 2, 5, 63, 64, 65, 127, 128, 129, 300, 500):
        texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 700))) for _ in range(3)] + ["", "a", "b" * 600]
        pattern = [*texts[0][:m].ljust(m, "c")]
        pattern[rnd.randrange(m)] = "é"
        for most in (0, 1, 7, 40):
            assert approx.bit_ends(texts, "".join(pattern), most) == [ends(t, pattern, most) for t in texts], (m, most)


def test_searches_over_frames(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(20)] + ["", None]
    words = ["abc", "a", "abcabcabcab", "", "cc"]
    t, p = frames(spark, texts, words)
    want = sorted((k, w, e, d) for k, s in enumerate(texts) for w in words for e, d in ends(s or "", w, 1))
    assert sorted(tuple(r) for r in approx.edit_search(t, p, 1).collect()) == want
    assert sorted(tuple(r) for r in approx.edit_search_bits(t, p, 1, together=3).collect()) == want


def test_a_long_pattern_in_a_long_text_takes_little_time_and_memory():
    rnd = random.Random(4)
    text = "".join(rnd.choice("acgt") for _ in range(500_000))
    pattern = text[1000:1100] + "x" + text[1101:1300]
    tracemalloc.start()
    began = time.perf_counter()
    found = approx.edit_ends(text, pattern, 5)
    greedy = approx.greedy_hits(text, pattern, 5)
    took, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (1299, 1) in found and len(greedy) == 1 and 995 <= greedy[0][0] <= 1005 and took < 2 and most < 100e6


def brute_pairs(strings, most):
    own = sorted({s for s in strings if s is not None}, key=lambda s: (len(s), s))
    return {(a, b, d) for i, a in enumerate(own) for b in own[i + 1 :] if abs(len(a) - len(b)) <= most and (d := distance(a, b)) <= most}


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_pairs_within_edits(spark, most):
    rnd = random.Random(most)
    base = ["".join(rnd.choice("ab\U0001f600é") for _ in range(rnd.randint(0, 12))) for _ in range(60)]
    strings = base + [s[: (k := rnd.randint(0, len(s)))] + rnd.choice(["", "a", "zz"]) + s[k + rnd.randint(0, 1) :] for s in base] + [None, "", "", base[0]]
    df = approx.within(spark.createDataFrame([(s,) for s in strings], "s string"), most)
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(strings, most)


def test_segments_do_not_carry_their_strings(spark, monkeypatch):
    rnd = random.Random(4)
    strings = ["".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 9))) for _ in range(150)]
    frame = spark.createDataFrame([(s,) for s in strings], "s string")
    few = approx.within(frame, 2)
    # Where segments meet, hashes alone are joined, whatever the strings' length.
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a_id" in plan and "b_id" in plan and "Aggregate [b#" not in plan
    # More strings than Spark's own number of parts is good for are dealt to more.
    monkeypatch.setattr(approx, "TASK_LETTERS", 100)
    many = approx.within(frame, 2)
    assert "RepartitionByExpression" in many._jdf.queryExecution().logical().toString()
    for df in (few, many):
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(strings, 2)


def edited(rnd, s, letters, edits):
    for _ in range(edits):
        k, kind = rnd.randint(0, len(s)), rnd.randint(0, 2)
        s = s[:k] + (rnd.choice(letters) if kind else "") + s[k + (kind < 2) :]
    return s


def families(seed):
    """Strings of all lengths up to 150, those of the same letters and of periods too, each with some that are near it."""
    rnd = random.Random(seed)
    out = []
    for _ in range(45):
        letters = rnd.choice(["ab", "aeinorstxyz", "x\U0001f600é"])
        n = rnd.choice([rnd.randint(0, 20), 16, 32, 63, 64, rnd.randint(20, 150)])
        base = "".join(rnd.choice(letters) for _ in range(n)) if rnd.random() < 0.8 else (rnd.choice(["a", "xy", "aei"]) * n)[:n]
        out += [base, *(edited(rnd, base, letters, rnd.randint(1, 4)) for _ in range(3))]
    return out


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5])
def test_pairs_of_longer_strings(spark, most):
    strings = families(most)
    got = [tuple(r) for r in approx.within(spark.createDataFrame([(s,) for s in strings], "s string"), most).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(strings, most)


def test_strings_of_many_pairs_are_fetched_by_a_shuffle(spark, monkeypatch):
    strings = families(8)
    frame = spark.createDataFrame([(s,) for s in [*strings, *strings]], "s string")
    monkeypatch.setattr(approx, "FEW_STRINGS", 0)
    for letters in (approx.TASK_LETTERS, 1000):
        monkeypatch.setattr(approx, "TASK_LETTERS", letters)
        got = [tuple(r) for r in approx.within(frame, 2).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(strings, 2)
    half = [spark.createDataFrame([(s,) for s in own], f"{c} string") for own, c in ((strings[::2], "a"), (strings[1::2], "b"))]
    got = [tuple(r) for r in approx.distances(*half, 2).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y, d) for x in strings[::2] for y in strings[1::2] if abs(len(x) - len(y)) <= 2 and (d := distance(x, y)) <= 2}


def shuffled(spark):
    """Bytes that all stages have written for others so far."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_less_is_shuffled_than_the_strings(spark):
    rnd = random.Random(6)
    strings = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(rnd.randint(350, 450))) for _ in range(3000)]
    near = strings[7][:100] + "-" + strings[7][101:300] + strings[7][301:]
    frame = spark.createDataFrame([(s,) for s in [*strings, near, *strings]], "s string")
    before = shuffled(spark)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert [tuple(r) for r in approx.within(frame, 2).collect()] == [(near, strings[7], 2)]
    finally:
        for k in settings:
            spark.conf.unset(k)
    # Nor do a string's segments take more: twenty of 30 bytes each would be 1.5 times its letters.
    assert 0 < shuffled(spark) - before < 0.75 * sum(map(len, strings))


def test_distances_of_two_tables(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 7)))
    a, b = [[word() for _ in range(40)] + [None] for _ in range(2)]
    frame = lambda own, c: spark.createDataFrame([(x,) for x in own], f"{c} string")
    for most in (0, 1, 3):
        got = [tuple(r) for r in approx.distances(frame(a, "a"), frame(b, "b"), most).collect()]
        assert len(got) == len(set(got)) and set(got) == {(x, y, d) for x in a for y in b if x is not None and y is not None and (d := distance(x, y)) <= most}
    assert approx.distances(frame(a, "a"), frame(b, "b")).count() == 41 * 41


def test_lines_of_documents(spark, sf_dir):
    from stringmill.plans import catalogue

    got = {tuple(r) for r in catalogue.edit_join_lines(spark, sf_dir).collect()}
    lines = {x for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() for x in (r.text or "").split("\n") if x}
    # All pairs of short lines, and all pairs of a sample's lengths.
    some = [x for x in lines if len(x) < 40]
    assert {p for p in got if len(p[1]) < 40} == brute_pairs(some, 2)
    assert got and all(distance(a, b) == d <= 2 for a, b, d in list(got)[:20])


def test_alignment_in_little_memory():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30))) for _ in range(2))
        x, y, ops = approx.align(a, b)
        assert x.replace("-", "") == a and y.replace("-", "") == b and sum(o != "match" for o in ops) == distance(a, b)
        assert all((o == "match") == (c == d) and (o == "insert") == (c == "-") and (o == "delete") == (d == "-") for c, d, o in zip(x, y, ops))
    # Ties: substitute before delete before insert, from the end.
    assert approx.align("ab", "b") == ("ab", "-b", ["delete", "match"]) and approx.align("a", "bc") == ("-a", "bc", ["insert", "substitute"])
    a, b = ("".join(rnd.choice("acgt") for _ in range(6000)) for _ in range(2))
    tracemalloc.start()
    approx.align(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 25e6  # 9 MB of bits; the numbers would be 290
