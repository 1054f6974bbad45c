"""Golden cases, agreement between mechanisms, and brute force where SQL has no say."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stringmill.functions import text as T
from stringmill.operators import approx, exact, index, payload, report, trace
from stringmill.plans import catalogue, measure, registry

SEARCHES = {"split": exact.by_split, "find": exact.by_find, "windows": exact.by_windows, "hash": exact.by_hash, "suffixes": exact.by_suffixes, "bits": exact.by_bits, "chunked": lambda t, p: exact.chunked(t, p, 7)}


def frames(spark, texts, patterns):
    return spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")


def overlapping(text, pattern):
    return [i for i in range(len(text or "") - len(pattern) + 1) if pattern and text.startswith(pattern, i)]


GOLDEN = [("ABABDABACDABABCABAB", "ABAB", [0, 10, 15]), ("AABAACAADAABAABA", "AABA", [0, 9, 12]), ("AAAAAAA", "AAA", [0, 1, 2, 3, 4]), ("ATCGATCGXTCGATCG", "ATCGATCG", [0])]


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_agree_with_brute_force(spark, name):
    rnd = random.Random(1)
    texts = [g[0] for g in GOLDEN] + ["", None, "a", "x\ny.x\ny", "é" * 5 + "ß\\E.é", "\U0001f600a\U0001f600a"] + ["".join(rnd.choice("ab\né") for _ in range(rnd.randint(0, 700))) for _ in range(25)]
    patterns = [g[1] for g in GOLDEN] + ["", "a", "ab", "\n", "x\ny", "éé", "\\E", ".", "\U0001f600a", "abab", "ba\na", "b" * 40]
    t, p = frames(spark, texts, patterns)
    got = sorted(tuple(r) for r in SEARCHES[name](t, p).collect())
    want = sorted((k, w, i) for k, text in enumerate(texts) for w in patterns for i in overlapping(text, w))
    assert got == want


@pytest.mark.parametrize("text,pattern,want", GOLDEN)
def test_golden_positions(spark, text, pattern, want):
    t, p = frames(spark, [text], [pattern])
    assert sorted(r.pos for r in exact.by_split(t, p).collect()) == want


def test_wildcards(spark):
    t, p = frames(spark, ["ABCDEFG", "C\nEC?E", "?", "aXbXb"], ["C?E", "?", "X?", "??"])
    got = sorted(tuple(r) for r in exact.wildcard_search(t, p).collect())
    hit = lambda w, s: len(w) == len(s) and all(a in ("?", b) for a, b in zip(w, s))
    want = sorted((k, w, i) for k, s in enumerate(["ABCDEFG", "C\nEC?E", "?", "aXbXb"]) for w in ["C?E", "?", "X?", "??"] for i in range(len(s)) if hit(w, s[i : i + len(w)]))
    assert got == want and (0, "C?E", 2) in got


def test_wildcards_over_documents(spark, sf_dir):
    import re

    rows = {r.text_id: r.text for r in catalogue.documents(spark, sf_dir).collect()}
    want = sorted((d, w, m.start()) for d, t in rows.items() for w in catalogue.WILD for m in re.finditer("(?s)(?=" + re.escape(w).replace("\\?", ".") + ")", t))
    assert sorted(tuple(r) for r in catalogue.wildcard_search(spark, sf_dir).select("doc_id", "pattern", "pos").collect()) == want


def test_counts_and_comparisons(spark):
    t, p = frames(spark, ["AAAA", "", "B"], ["AA", "B"])
    assert {tuple(r) for r in exact.count_overlapping(t, p).collect()} == {(0, "AA", 3), (0, "B", 0), (1, "AA", 0), (1, "B", 0), (2, "AA", 0), (2, "B", 1)}
    c = {(r.text_id, r.pattern): r for r in exact.comparisons(t, p).collect()}
    assert (c[0, "AA"].comparisons, c[0, "AA"].matches) == (6, 3) and c[1, "B"].comparisons == 0
    assert {r.pattern: (r.n, r.texts) for r in exact.pattern_counts(t, p).collect()} == {"AA": (3, 1), "B": (1, 1)}
    z = {(r.text_id, r.pattern): r.efficiency for r in exact.complexity(t, p).collect()}
    assert z[1, "AA"] is None and z[0, "AA"] == 100.0


def test_non_overlapping_and_unescaped(spark):
    t, p = frames(spark, ["hello world hello", "AAAA"], ["hello", "AA", "."])
    assert sorted((r.text_id, r.end_pos) for r in exact.non_overlapping(t, p).collect()) == [(0, 4), (0, 16), (1, 1), (1, 3)]
    assert exact.regex_matches(t, p).filter("pattern = '.'").count() == 21


def test_index_tables(spark):
    p = spark.createDataFrame([("ABABACA",), ("GCAGAGAG",), ("",)], "pattern string")
    f = {(r.pattern, r.i): r.failure for r in index.failure_function(p).collect()}
    assert [f["ABABACA", i] for i in range(7)] == [0, 0, 1, 2, 3, 0, 1] == trace.borders("ABABACA")
    assert index.good_suffix_shifts("GCAGAGAG") == [7, 7, 7, 2, 7, 4, 7, 1]
    assert {(r.ch, r.last_pos) for r in index.bad_characters(p, "ACGT").collect() if r.pattern == "ABABACA"} == {("A", 6), ("B", 3), ("C", 5), ("G", -1), ("T", -1)}
    assert {(r.ch, r.present) for r in index.character_masks(p).collect() if r.pattern == "ABABACA"} == {("A", 0b1010101), ("B", 0b1010), ("C", 0b100000)}
    assert spark.range(1).select(T.polynomial_hash(F.lit("ACGT"))).first()[0] == 39
    assert index.leading_power(4) == 256**3 % 101


def test_good_suffix_shifts_never_skip_a_hit():
    rnd = random.Random(2)
    for _ in range(400):
        p, t = ("".join(rnd.choice("ab") for _ in range(n)) for n in (rnd.randint(1, 6), 30))
        shifts, at, seen = index.good_suffix_shifts(p), 0, []
        while at <= len(t) - len(p):
            j = len(p) - 1
            while j >= 0 and p[j] == t[at + j]:
                j -= 1
            if j < 0:
                seen.append(at)
                at += 1
            else:
                at += max(1, shifts[j])
        assert seen == overlapping(t, p)


def test_trie_sizes(spark):
    texts = ["banana", "aaa", "", "abcab"]
    got = {r.text_id: (r.nodes, r.depth) for r in index.trie_sizes(frames(spark, texts, [])[0]).collect()}
    assert got == {k: (1 + len({t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}), len(t)) for k, t in enumerate(texts)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_approximate_searches_against_brute_force(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(12)]
    patterns = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(6)]
    t, p = frames(spark, texts, sorted(set(patterns)))
    pairs = [(k, s, w) for k, s in enumerate(texts) for w in sorted(set(patterns))]
    for most in (0, 1, 2):
        ends = {(k, w, e, d) for k, s, w in pairs for e in range(len(s)) for d in [min(distance(w, s[i : e + 1]) for i in range(e + 2))] if d <= most}
        assert {tuple(r) for r in approx.edit_search(t, p, most).collect()} == ends
        near = {(k, w, i, d) for k, s, w in pairs for i in range(len(s) - len(w) + 1) for d in [sum(a != b for a, b in zip(w, s[i:]))] if d <= most}
        assert {tuple(r) for r in approx.hamming_search(t, p, most).collect()} == near
        greedy, first = set(), set()
        for k, s, w in pairs:
            last = -len(w)
            for i in range(len(s)):
                own = [(n, distance(w, s[i : i + n])) for n in range(max(1, len(w) - most), len(w) + most + 1) if i + n <= len(s)]
                good = [x for x in own if x[1] <= most]
                if good:
                    first.add((k, w, i, *good[0]))
                    if i >= last + len(w):
                        greedy.add((k, w, i, min(d for _, d in good)))
                        last = i
        assert {tuple(r) for r in approx.edit_search_greedy(t, p, most).collect()} == greedy
        assert {tuple(r) for r in approx.edit_search_first_length(t, p, most).collect()} == first


def test_compatible_scores():
    assert approx.banded_hits("xxab", "ab", 1) == [(3, 1)]
    assert approx.banded_hits("b", "ab", 1) == []
    assert approx.banded_hits("abc", "", 1) == [(0, 0), (1, 0), (2, 0)] == approx.difference_scores("abc", "", 0)
    assert approx.difference_scores("ab", "ab", 0) == [] and approx.difference_scores("ab", "ab", 1) == [(0, 1)]


def test_a_banded_hit_is_a_subsequence_once_the_window_is_full():
    rnd = random.Random(4)
    for _ in range(200):
        w, s, k = "".join(rnd.choice("ab") for _ in range(3)), "".join(rnd.choice("ab") for _ in range(20)), 2
        got = {e for e, _ in approx.banded_hits(s, w, k)}
        for e in range(len(w) + k - 1, len(s)):
            window = iter(s[e + 1 - len(w) - k : e + 1])
            assert (e in got) == all(c in window for c in w)


def test_alignment_costs_its_distance():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 8))) for _ in range(2))
        x, y, ops = approx.align(a, b)
        assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y) == len(ops)
        assert all((o == "match") == (c == d) for c, d, o in zip(x, y, ops))
    assert sum(o != "match" for o in approx.align("kitten", "sitting")[2]) == 3


def test_traces(spark):
    t, p = frames(spark, ["ABABDABACDABABCABAB"], ["ABAB"])
    k = trace.kmp(t, p).first()
    assert k.matches_found == 3 and k.total_comparisons == 19 and k.successful_comparisons + k.failed_comparisons == 19 and k.failure_function == [0, 0, 1, 2]
    assert k.efficiency == f"{100 * (19 - k.backtrack_count) / 19:.1f}%"
    b = trace.boyer_moore(t, p).first()
    assert b.matches_found == 3 and b.characters_skipped == b.total_shifts - b.alignments_checked and b.skip_efficiency == f"{100 * b.characters_skipped / 19:.1f}%"
    r = trace.rolling_hash(t, p).first()
    assert (r.hash_comparisons, r.matches_found) == (16, 3) and r.character_comparisons >= 12
    s = trace.shift_or_counters(t, p, 0).first()
    assert (s.total_shifts, s.total_or_operations, s.matches_found) == (19, 19, 3)


def test_steps_find_what_the_searches_find(spark):
    text, pattern = "ABABDABACDABABCABAB", "ABAB"
    t, p = frames(spark, [text, "AB", ""], [pattern, ""])
    hits = overlapping(text, pattern)
    found = {n: payload.steps(t, p, n).orderBy("step_number").collect() for n in payload.STEPPERS}
    assert all([r.step_number for r in rows] == list(range(n == "naive", len(rows) + (n == "naive"))) and {r.text_id for r in rows} == {0} for n, rows in found.items())
    of = lambda n, kind="search": [r for r in found[n] if r.step_type == kind]
    k, b, r = trace.kmp(t, p).first(), trace.boyer_moore(t, p).first(), trace.rolling_hash(t, p).first()
    naive = found["naive"]
    assert [x.text_position for x in naive if x.is_match] == hits and naive[-1].total_comparisons_so_far == exact.comparisons(t, p).filter("text_id = 0").first().comparisons
    assert all(c.text_char == text[c.text_index] and c.pattern_char == pattern[c.pattern_index] and c.is_match == (c.text_char == c.pattern_char) for x in naive for c in x.comparisons)
    assert found["kmp"][0].failure_function == [0, 0, 1, 2] and [x.match_position for x in of("kmp") if x.is_match] == hits
    assert sum(d.reason.startswith("Mismatch") for x in of("kmp") for d in x.backtrack_details) == k.backtrack_count and len(of("kmp")) == 19
    assert all(x.current_alignment == x.text_index - x.new_pattern_index and x.backtracked == any(d.reason.startswith("Mis") for d in x.backtrack_details) for x in of("kmp"))
    assert found["boyer_moore"][0].bad_char_table == {"A": 2, "B": 3} and [x.match_position for x in of("boyer_moore") if x.is_match] == hits
    assert sum(x.shift for x in of("boyer_moore")) == b.total_shifts and sum(x.comparisons_count for x in of("boyer_moore")) == b.total_comparisons == of("boyer_moore")[-1].total_comparisons_so_far
    assert all(x.mismatch_char == text[x.text_position + x.pattern_index] and x.pattern_index >= 0 for x in of("boyer_moore") if not x.is_match)
    tree = found["suffix_tree"]
    assert [x.suffix for x in tree[:5]] == [text[i:] for i in range(5)] and tree[5].suffix is None and len(tree) == 5 + 1 + 4 + 1
    assert tree[-1].match_positions == hits and [x.num_matches_so_far for x in of("suffix_tree")] == [sum(text[i:].startswith(pattern[:k]) for i in range(19)) for k in range(1, 5)]
    assert found["rabin_karp"][0].h_value == pow(256, 3, 101) and [x.text_position for x in of("rabin_karp") if x.is_match] == hits
    assert sum(x.is_spurious_hit for x in of("rabin_karp")) == r.spurious_hits and of("rabin_karp")[-1].total_comparisons_so_far == r.character_comparisons
    assert all(a.next_hash == z.current_hash for a, z in zip(of("rabin_karp"), of("rabin_karp")[1:]))
    first = approx.edit_search_first_length(t, p, 1).filter("text_id = 0").orderBy("pos").collect()
    assert [(x.start_position, x.substring_length, x.edit_distance) for x in of("levenshtein", "match_found")] == [(x.pos, x["len"], x.dist) for x in first if x.pos < 19 - 4 + 2]
    cells = of("levenshtein", "dp_computation")
    assert all(x.chosen_cost == min(x.deletion_cost, x.insertion_cost, x.substitution_cost) == x.dp_matrix[x.dp_row][x.dp_col] and x.operation in ("match", "substitute", "delete", "insert") for x in cells)
    assert all(x.start_position < 3 or sum(y.step_number < x.step_number for y in of("levenshtein", "match_found")) < 2 for x in cells)
    # The empty table is shown for the longest substring of the first start, if no shorter one matches.
    assert of("levenshtein", "preprocessing") == [] and [x[0] for x in payload._levenshtein("xyzxyzxyz", pattern)].count("preprocessing") == 1
    bits = of("shift_or", "bit_operation")
    assert len(bits) == 19 and all(x.old_states == (y.new_states if y else ["1111"] * 2) for x, y in zip(bits, [None, *bits]))
    assert [m.position for x in bits for m in x.matches_found if m.errors == 0] == hits and found["shift_or"][0].pattern_masks == {"A": "1010", "B": "0101"}


def test_steps_leave_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(payload, "STEP_ROWS", 7)
    t, p = frames(spark, ["there is the station over there"] * 2, ["tion", "there"])
    assert payload.all_steps(t, p).groupBy("algorithm", "text_id", "pattern").agg(F.max("step_number").alias("m"), F.count("*").alias("n")).filter("m + 1 != n AND m != n").count() == 0


def test_documents_against_brute_force(spark, sf_dir):
    rows = {r.text_id: r.text for r in catalogue.documents(spark, sf_dir).collect()}
    got = {}
    for r in catalogue.hamming_documents(spark, sf_dir).filter("doc_id < 20").collect():
        got.setdefault((r.doc_id, r.pattern), []).append((r.pos, r.dist))
    for (d, w), hits in got.items():
        s = rows[d]
        assert sorted(hits) == [(i, m) for i in range(len(s) - len(w) + 1) for m in [sum(a != b for a, b in zip(w, s[i:]))] if m <= 1]


def test_lcs(spark):
    assert exact.common_substring("ABABC", "BABCA") == "BABC" and exact.common_substring("", "a") == "" and exact.common_substring("xyz", "abc") == ""
    rnd = random.Random(6)
    for _ in range(100):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        subs = [(i - j, i, b[i:j]) for i in range(len(b)) for j in range(i + 1, len(b) + 1) if b[i:j] in a]
        assert exact.common_substring(a, b) == (min(subs)[2] if subs else "")


def test_registry(spark):
    t = registry.samples(spark).select(F.col("key").alias("text_id"), "text").filter("text_id = 'repetitive'")
    p = spark.createDataFrame([("AAA",), (" ",)], "pattern string")
    counts = {r.algorithm: r["count"] for r in registry.search(t, p, [*registry.EXACT]).groupBy("algorithm").count().collect()}
    assert counts == {n: 38 for n in registry.EXACT}
    rows = {r.algorithm: r for r in measure.results(t, p, [*registry.EXACT, "nonsense"]).collect()}
    assert all(rows[n].success and rows[n].matches == 38 and rows[n].error is None for n in registry.EXACT)
    assert not rows["nonsense"].success and "nonsense" in rows["nonsense"].error and rows["nonsense"].matches is None
    with pytest.raises(ValueError):
        registry.search(t, p, ["nonsense"])
    assert registry.algorithms(spark, "kmp").count() == 1 and {r.algorithms for r in registry.health(spark).collect()} == {5, 2}
    assert registry.timed(t) > 0


def test_shift_or_of_patterns_over_a_word(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("aé") for _ in range(400)), "a" * 70, "", None]
    patterns = ["a", texts[0][5:67], texts[0][5:68], texts[0][30:200], "a" * 63, "a" * 65, "b" * 90]
    t, p = frames(spark, texts, patterns)
    want = sorted((k, w, i) for k, s in enumerate(texts) for w in patterns for i in overlapping(s, w))
    assert sorted(tuple(r) for r in exact.by_bits(t, p).collect()) == want and any(len(w) > 62 for _, w, _ in want)
    got = {}
    for r in index.character_mask_words(p).collect():
        a = got.setdefault((r.pattern, r.ch), [0, 0])
        a[0] |= r.present << 62 * r.word
        a[1] |= r.shift_or << 62 * r.word
    present = lambda w, c: sum(1 << k for k, x in enumerate(w) if x == c)
    assert got == {(w, c): [present(w, c), (1 << len(w)) - 1 - present(w, c)] for w in patterns for c in set(w)}


def test_time_is_in_proportion_to_the_hits():
    """A single text of so many hits; four times as many may not take much more than four times as long."""
    import time

    seconds = []
    for n in (100_000, 400_000):
        began = time.process_time()
        text = "A" * n
        assert len(exact.bit_hits(text, "AA")) == n - 1 and len(exact.find_all(text, "A")) == n
        assert abs(len(approx.greedy_hits(text, "AAT", 1)) - n / 3) <= 1
        assert len(approx.edit_ends(text, "AT", 1)) == n
        seconds.append(time.process_time() - began)
    assert seconds[1] < 8 * seconds[0] + 1


def test_searches_of_a_text_of_many_hits(spark):
    n = 400_000
    t = spark.createDataFrame([(0, "A" * n)], "text_id long, text string")
    p = spark.createDataFrame([("A",)], "pattern string")
    for search in (exact.by_split, exact.by_find, exact.by_bits, exact.chunked):
        assert search(t, p).agg(F.count("*"), F.min("pos"), F.max("pos")).first() == (n, 0, n - 1)
    assert exact.non_overlapping(t, p).count() == n and exact.regex_starts(t, p).count() == n
    assert exact.wildcard_search(t, spark.createDataFrame([("?A",)], "pattern string")).count() == n - 1


def test_regex_starts(spark):
    import re

    texts, patterns = ["abracadabra", "", None, "a.b\nab"], ["a.", "b|c", "a*", "", "."]
    t, p = frames(spark, texts, patterns)
    want = sorted((k, w, m.start(), m.end() - m.start()) for k, s in enumerate(texts) if s is not None for w in patterns if w for m in re.finditer(w, s))
    assert sorted(tuple(r) for r in exact.regex_starts(t, p).collect()) == want


def test_passages_against_contains(spark, monkeypatch):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abé") for _ in range(rnd.randint(0, 60))) for _ in range(60)] + ["", None, "x" * 5]
    patterns = ["".join(rnd.choice("abé") for _ in range(rnd.randint(1, 9))) for _ in range(40)] + ["", "x", "xxxxx", "xxxxxx", None]
    t = frames(spark, texts, ["a"])[0]
    p = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")
    want = sorted((i, j) for i, s in enumerate(texts) for j, w in enumerate(patterns) if s is not None and w is not None and w in s)
    for most in (exact.BROADCAST_PATTERNS, 7):
        monkeypatch.setattr(exact, "BROADCAST_PATTERNS", most)
        assert sorted(tuple(r) for r in exact.holding(t, p).collect()) == want
        some = p.filter("pattern != ''").select("pattern")
        for search in (exact.by_split, exact.by_find, exact.by_bits):
            assert sorted(tuple(r) for r in search(t, some.distinct()).collect()) == sorted((i, w, at) for i, s in enumerate(texts) for w in {x for x in patterns if x} for at in overlapping(s, w))


def test_measured_runs_and_findings(spark):
    t = spark.createDataFrame([(0, "ATCGATCGTTAG" * 20)], "text_id long, text string")
    p = spark.createDataFrame([("average", "a", "ATCG"), ("rare", "b", "GGGG")], "category string, name string, pattern string")
    runs = measure.exact_runs(t, p, ["boyer_moore", "suffix_tree", "rabin_karp"])
    rows = {(r.pattern_name, r.algorithm): r for r in runs.collect()}
    assert len(rows) == 6 and {rows["a", n].matches_count for n in ("boyer_moore", "suffix_tree", "rabin_karp")} == {len(overlapping("ATCGATCGTTAG" * 20, "ATCG"))}
    assert rows["a", "rabin_karp"].memory_kb == 72 / 1024 and rows["a", "suffix_tree"].preprocessing_ms == rows["b", "suffix_tree"].preprocessing_ms > 0
    assert all(r.search_ms > 0 and r.cpu_ms >= 0 for r in rows.values())
    text = measure.findings(runs)
    assert "## Findings" in text and "- Fastest: " in text and "- Runs: 6" in text and measure.amortised(10, 4) == 2.5


def test_suffix_index_is_reused(spark, tmp_path):
    texts = ["banana", "", None, "aaa", "ananas\U0001f600"]
    t, p = frames(spark, texts, ["ana", "a", "\U0001f600", "x", ""])
    exact.suffix_index(t).write.parquet(str(tmp_path / "index"))
    kept = spark.read.parquet(str(tmp_path / "index"))
    assert {r.text_id: r.suffixes for r in kept.collect()} == {k: sorted(range(len(s or "")), key=lambda i: s[i:]) for k, s in enumerate(texts)}
    assert sorted(map(tuple, exact.by_index(kept, p).collect())) == sorted((k, w, i) for k, s in enumerate(texts) for w in ("ana", "a", "\U0001f600", "x") for i in overlapping(s, w))


def test_suffix_index_leaves_in_few_batches():
    texts = ["banana" * (k % 9) for k in range(500)] + [None, "", "x" * 70_000, "ab"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["text_id", "text"])
    out = list(exact._indexed([batch.slice(0, 0), batch]))
    assert len(out) < 6
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["text_id"], r["text"]) for r in rows] == list(enumerate(texts))
    assert all(r["suffixes"] == sorted(range(len(r["text"] or "")), key=lambda i: r["text"][i : i + 70]) for r in rows if len(r["text"] or "") < 100)
    assert rows[-2]["suffixes"] == list(range(70_000))[::-1]


def test_package_exports():
    import stringmill

    assert all(hasattr(stringmill, n) for n in stringmill.__all__)


def test_places_by_ranges_and_approximate_quantiles(spark):
    rnd = random.Random(2)
    rows = [(f"n{rnd.randint(0, 10**6)}", rnd.choice(["a", "a", "b"]), "x", 5, 0.0, float(k % 100), float(k), 1) for k in range(3000)]
    runs = spark.createDataFrame(rows, "pattern_name string, category string, algorithm string, pattern_length int, preprocessing_ms double, search_ms double, memory_kb double, matches_count long")
    want = {(c, n): k for c in "ab" for k, n in enumerate(sorted({r[0] for r in rows if r[1] == c}))}
    for parts in (1, 8, 64):
        assert {(r.category, r.pattern_name): r.place for r in report.pattern_places(runs, parts).collect()} == want
    assert abs(report.by_algorithm(runs, True).first().median_ms - report.by_algorithm(runs).first().median_ms) <= 1
    assert report.unpivoted(runs, True).count() == 3 and abs(report.memory_quartiles(runs, True).first().q2 - 1500) <= 2
