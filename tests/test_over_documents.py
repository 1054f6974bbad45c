"""The queries over whole documents, against brute force on a small table with long, empty, repeated and non-Latin texts."""

import random
from collections import Counter

import pytest

from stringmill.operators import approx, exact, payload, trace
from stringmill.plans import catalogue

from .test_operators import distance, overlapping

SHORT, NEAR = catalogue.SHORT, catalogue.NEAR


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rnd = random.Random(7)
    word = lambda: rnd.choice(["the", "there", "tion", "thre", "on", "ère", "station", "tiion", "x", "\U0001f600"])
    texts = ["", "t", "on", "there", " ".join(word() for _ in range(400)), "th\nere the"] + [" ".join(word() for _ in range(rnd.randint(1, 30))) for _ in range(6)]
    texts += [texts[4], texts[-1]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, t, "en", "hot", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path, texts


def rows(spark, fixture, name):
    return Counter(tuple(r) for r in catalogue.QUERIES[f"{name}_documents"](spark, fixture[0]).collect())


def compared(t, w):
    """Comparisons and hits of the naive search."""
    same = [next((j for j in range(len(w)) if t[i + j] != w[j]), len(w)) for i in range(len(t) - len(w) + 1)]
    return sum(min(x + 1, len(w)) for x in same), sum(x == len(w) for x in same), len(same)


def test_comparisons(spark, fixture):
    pairs = [(k, w, t, *compared(t, w)) for k, t in enumerate(fixture[1]) for w in SHORT]
    assert rows(spark, fixture, "naive_comparisons") == Counter((k, w, c, h, p) for k, w, _, c, h, p in pairs)
    assert {r[:7] for r in rows(spark, fixture, "complexity_analysis")} == {(k, w, len(t), len(w), h, c, max(0, len(t) - len(w) + 1) * len(w)) for k, w, t, c, h, _ in pairs}
    assert {r[:7] for r in rows(spark, fixture, "trace_naive")} == {(k, w, c, c - (p - h), p - h, p, h) for k, w, _, c, h, p in pairs if p}


def test_index_tables(spark, fixture):
    texts = list(enumerate(fixture[1]))
    rolled = lambda s: sum(b * pow(256, len(s) - 1 - k, 101) for k, b in enumerate(map(ord, s))) % 101
    assert rows(spark, fixture, "suffix_table") == Counter((k, i, t[i : i + 8]) for k, t in texts for i in range(len(t)))
    assert rows(spark, fixture, "suffix_counts") == Counter(dict.fromkeys(Counter(t[i : i + 4] for _, t in texts for i in range(len(t))).items(), 1))
    assert rows(spark, fixture, "rk_window_hash") == Counter((k, i, rolled(t[i : i + 4])) for k, t in texts for i in range(len(t) - 3))
    short = [(k, t) for k, t in texts if len(t) < 300]
    got = {r[0]: r[1:] for r in rows(spark, fixture, "trie_sizes")}
    assert len(got) == len(texts) and all(got[k] == (1 + len({t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}), len(t)) for k, t in short)


def test_traces(spark, fixture):
    texts = list(enumerate(fixture[1]))
    known = lambda t, w: sum(w[:k] in t for k in range(1, len(w) + 1))
    want = {(k, w, min(known(t, w) + 1, len(w)), w in t, len(overlapping(t, w))) for k, t in texts for w in SHORT if len(t) >= len(w)}
    assert set(rows(spark, fixture, "trace_suffix")) == want
    stats = set(rows(spark, fixture, "rk_hash_stats"))
    assert {(r[0], r[1], r[2], r[5]) for r in stats} == {(k, w, len(t) - len(w) + 1, len(overlapping(t, w))) for k, t in texts for w in SHORT if len(t) >= len(w)}
    cells = set()
    for k, t in texts:
        for w in NEAR:
            total = checked = hits = 0
            for i in range(min(len(t), max(0, len(t) - len(w) + 2))):
                lengths = [n for n in range(len(w) - 1, len(w) + 2) if i + n <= len(t)]
                near = [n for n in lengths if distance(w, t[i : i + n]) <= 1]
                total += sum(n * len(w) for n in lengths if not near or n <= near[0])
                checked, hits = checked + bool(lengths), hits + bool(near)
            if checked:
                cells.add((k, w, total, checked, hits))
    assert set(rows(spark, fixture, "trace_lev_cells")) == cells


def test_steps_are_counted(spark, fixture):
    want = Counter()
    for name, run in payload.STEPPERS.items():
        for k, t in enumerate(fixture[1]):
            for w in NEAR:
                if len(t) >= len(w):
                    types = Counter(x[0] or "search" for x in (run(t, w, cells=False) if name == "levenshtein" else run(t, w)))
                    want.update((name, k, w, kind, n) for kind, n in types.items())
    assert rows(spark, fixture, "trace_steps") == want
    rnd = random.Random(4)
    for _ in range(300):
        w, t = ("".join(rnd.choice("ab") for _ in range(rnd.randint(1, n))) for n in (5, 14))
        if len(t) >= len(w):
            own = {name: dict(Counter(x[0] or "search" for x in (run(t, w, cells=False) if name == "levenshtein" else run(t, w)))) for name, run in payload.STEPPERS.items()}
            assert payload.counted(t, w) == own, (t, w)


def plain_kmp(t, w):
    """Counters by the plain search: characters, equal ones, falls, hits."""
    fail, j, same, falls, hits = trace.borders(w), 0, 0, 0, 0
    for c in t:
        while j and w[j] != c:
            j, falls = fail[j - 1], falls + 1
        if w[j] == c:
            same, j = same + 1, j + 1
        if j == len(w):
            hits, j = hits + 1, fail[j - 1]
    return len(t), same, len(t) - same, falls, hits


def plain_bm(t, w):
    """Counters by the plain search from the right with the bad-character rule."""
    n, m, at, same, wrong, moved, hits, seen = len(t), len(w), 0, 0, 0, 0, 0, 0
    while at <= n - m:
        k = next((k for k in range(m) if w[m - 1 - k] != t[at + m - 1 - k]), m)
        if k == m:
            shift = m - 1 - w.rfind(t[at + m]) if at + m < n else 1
        else:
            shift = max(1, m - 1 - k - w.rfind(t[at + m - 1 - k]))
        at, same, wrong, moved, hits, seen = at + max(1, shift), same + k, wrong + (k < m), moved + shift, hits + (k == m), seen + 1
    return same + wrong, same, wrong, seen, moved, moved - seen, hits


def test_search_counters(spark, fixture):
    pairs = [(k, w, t) for k, t in enumerate(fixture[1]) for w in SHORT if len(t) >= len(w)]
    assert {r[:7] for r in rows(spark, fixture, "trace_kmp")} == {(k, w, *plain_kmp(t, w)) for k, w, t in pairs}
    assert {r[:9] for r in rows(spark, fixture, "trace_bm")} == {(k, w, *plain_bm(t, w)) for k, w, t in pairs}
    rnd = random.Random(3)
    for _ in range(2000):
        w, t = ("".join(rnd.choice("ab") for _ in range(rnd.randint(1, n))) for n in (6, 30))
        if len(t) >= len(w):
            assert trace._kmp(t, w)[:5] == plain_kmp(t, w) and trace._bad_character(t, w)[:7] == plain_bm(t, w)


def test_edits(spark, fixture):
    greedy, first = Counter(), Counter()
    for k, t in enumerate(fixture[1]):
        for w in NEAR:
            last = -len(w)
            for i in range(len(t)):
                good = [(n, d) for n in range(len(w) - 1, len(w) + 2) if i + n <= len(t) for d in [distance(w, t[i : i + n])] if d <= 1]
                if good:
                    first[k, w, i, *good[0]] += 1
                    if i >= last + len(w):
                        greedy[k, w, i, min(d for _, d in good)] += 1
                        last = i
    assert rows(spark, fixture, "edit_search_greedy") == greedy and rows(spark, fixture, "edit_search_first_length") == first
    found = rows(spark, fixture, "search_all_algorithms")
    for name in ("naive", "kmp", "boyer_moore", "suffix_tree", "rabin_karp"):
        assert {r[1:] for r in found if r[0] == name} == {(k, w, i) for k, t in enumerate(fixture[1]) for w in NEAR for i in overlapping(t, w)}
    assert {r[1:] for r in found if r[0] == "levenshtein"} == {r[:3] for r in greedy}
    assert {r[1:] for r in found if r[0] == "shift_or"} == {(k, w, i) for k, t in enumerate(fixture[1]) for w in NEAR for i in range(len(t) - len(w) + 1) if sum(a != b for a, b in zip(w, t[i:])) <= 1}


def prefix_table(pattern, text, left):
    """Edit distances of the pattern's prefixes to the text's; ``left`` gives the first of each row."""
    rows = [list(range(len(text) + 1))]
    for i, c in enumerate(pattern, 1):
        row = [left(i)]
        for j, x in enumerate(text, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (c != x)))
        rows.append(row)
    return rows


def window_hits(text, pattern, most):
    """Each end's window of ``most`` + the pattern's length; no letter of the pattern goes before the window's first."""
    out = []
    for e in range(1, len(text) + 1):
        window = text[max(0, e - len(pattern) - most) : e]
        d = prefix_table(pattern, window, lambda i: 10**6)[-1][-1]
        if d <= most:
            out.append((e - 1, d))
    return out


def scored(text, pattern, most):
    """The score from the differences down each column of the table."""
    table, out = prefix_table(pattern, text, lambda i: i), []
    for e in range(1, len(text) + 1):
        steps = [table[i + 1][e] - table[i][e] for i in range(len(pattern))]
        score = sum(x != 1 for x in steps) if steps[-1] == 1 else sum(x == -1 for x in steps)
        if score <= most:
            out.append((e - 1, score))
    return out


def test_compatible_scores(spark, fixture):
    texts = list(enumerate(fixture[1]))
    assert rows(spark, fixture, "levenshtein_banded_compat") == Counter((k, w, e, d) for k, t in texts for w in NEAR for e, d in window_hits(t, w, 1))
    assert rows(spark, fixture, "bitvector_score_compat") == Counter((k, w, e, d) for k, t in texts for w in NEAR for e, d in scored(t, w, 1))


def test_compatible_scores_by_definition():
    rnd = random.Random(8)
    for _ in range(600):
        t, w, most = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 25))), "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))), rnd.randint(0, 4)
        assert approx.banded_hits(t, w, most) == window_hits(t, w, most)
        assert approx.difference_scores(t, w, most) == scored(t, w, most)


def test_common_substrings(spark, fixture):
    texts = fixture[1]
    got = {r[0]: r[1:] for r in rows(spark, fixture, "longest_common_substring")}
    for k, a in enumerate(texts):
        b = texts[k + 1] if k + 1 < len(texts) else ""
        if len(a) * len(b) < 20_000:
            subs = [(i - j, i, b[i:j]) for i in range(len(b)) for j in range(i + 1, len(b) + 1) if b[i:j] in a]
            assert got[k] == ((want := min(subs)[2] if subs else ""), len(want))
        assert exact.common_substring(a, b) == got[k][0]
    assert len(got) == len(texts)
