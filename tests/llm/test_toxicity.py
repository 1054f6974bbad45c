import random
import zlib

import numpy as np

from stringmill.llm import toxicity as T

ODD = "doc_id long, text string, score string, toxic string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    rnd = random.Random(4)
    terms = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 12))) for _ in range(25)]
    auto = T.Automaton(terms)
    for _ in range(3000):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 13)))
        want = min(((distance(t, word), t) for t in sorted(set(terms)) if distance(t, word) <= T.allowed_edits(t)), default=None)
        got = auto.match(word)
        assert (got and (got[1], got[0])) == want, word


def test_quotation_is_apart_from_abuse():
    lex = T.Lexicon({"scumbag": 3.0})
    plain, quoted = lex.features("you scumbag there"), lex.features('he said "you scumbag there" once')
    assert plain[0] > 0 and plain[5] == 0
    assert quoted[0] == 0 and quoted[5] > 0
    assert lex.features("you scumbbag")[3] > 0
    assert lex.features(None) == [0.0] * len(T.FEATURES)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y"), (None, "z", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y"), (4, "long " * 50_000, "x", "y")], ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = T.score(docs, labels).collect()
    assert len(got) == 6 and all(r.score == 0.5 for r in got)
    assert T.score(docs.limit(0), labels).collect() == []


def test_planted_terms_misspellings_and_copies(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    copied = " ".join(f"q{rnd.randint(0, 10**9)}" for _ in range(40))
    for k in range(900):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(40)]
        toxic = k % 5 == 0
        if toxic:
            words[rnd.randint(0, 39)] = rnd.choice(["grumblefink", "snotbucket"])
        if k % 90 == 0:
            words += copied.split()
        rows.append((k, " ".join(words), "", ""))
        labels.append((k, 1, int(toxic)))
    rows += [(10_000, "w1 w2 grumblefimk w3 you", "", ""), (10_001, copied, "", ""), (10_002, "w1 w2 w3", "", "")]
    docs = spark.createDataFrame(rows, ODD).repartition(4)
    got = {r.doc_id: r.predicted for r in T.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[k] == int(k % 5 == 0) for k in range(900))
    assert got[10_001] == 0 and got[10_002] == 0
    kept = {r.doc_id for r in T.keep_clean(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert kept == {k for k, p in got.items() if not p}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in T.op9_toxicity(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for d, r in got.items())
    y = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = sum(a == b for a, b in y) / len(y)
    print("held-out accuracy", right, [(a, b) for a, b in y if a != b])
    assert right > 0.95


def test_sampled_classes_count_as_those_they_stand_for(spark, monkeypatch):
    """A small sample of many clean documents gives the table's prior, precision and harmless words."""
    x, y = np.zeros((300, 2)), np.r_[np.ones(100), np.zeros(200)]
    assert abs(T.fit_logistic(x, y, stands_for=(1.0, 4.0))[0] - np.log(100 / 800)) < 0.02
    rnd = random.Random(6)
    text = lambda *w: " ".join(x for v in w for x in (f"w{rnd.randint(0, 900)}", v, f"w{rnd.randint(0, 900)}"))
    half = [text("halfterm") for _ in range(40)]
    toxic = spark.createDataFrame([(t,) for t in half + [text("grumblefink") for _ in range(40)]], "text string")
    other = spark.createDataFrame([(t,) for t in [text("halfterm") for _ in range(8)] + [text("plain") for _ in range(240)]], "text string")
    assert {"halfterm", "grumblefink"} <= set(T.learn_lexicon(toxic, other).weights)
    got = T.learn_lexicon(toxic, other, (1.0, 8.0)).weights
    assert "grumblefink" in got and "halfterm" not in got
    own = T.Lexicon({"grumblefink": 3.0})
    near = spark.createDataFrame([(text("grumblefimk"),) for _ in range(9)] + [("w1 grumblefink w2",)], "text string")
    clean = spark.createDataFrame([(text("grumblefimk"),) for _ in range(2)] + [("w1 grumblefonk w2",)] * 5 + [(text("grumbleking"),) for _ in range(3)], "text string")
    # Two clean uses among nine toxic ones, and one context copied five times, excuse no misspelling.
    assert T.learn_harmless(near, clean, own).harmless == {"grumbleking"}
    assert T.learn_harmless(near, clean, own, (1.0, 8.0)).harmless == {"grumbleking", "grumblefimk"}
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(100)], "doc_id long, toxic int")
    monkeypatch.setattr(T, "MAX_OTHER", 15)
    _, toxic, other, stands_for = T._training(docs, labels, 5, 9)
    assert toxic.count() == 25 and other.count() == 15 and stands_for == (1.0, 5.0)


def test_quotation_survives_letters_that_lower_case_lengthens():
    lex = T.Lexicon({"scumbag": 3.0})
    assert lex.features("İ" * 30 + ' said "you scumbag" once')[0] == 0
    assert lex.features("İ" * 30 + ' said you "scum" scumbag once')[5] == 0
    assert lex.features('an open "mark scumbag\nno scumbag" here')[5] == 0


def test_many_quoted_hits_take_little_time():
    import time

    lex, began = T.Lexicon({"scumbag": 3.0}), time.process_time()
    assert lex.features('"scumbag" ' * 200_000)[5] > 0
    assert time.process_time() - began < 5


def test_repeated_rows_teach_the_same(spark):
    rnd = random.Random(6)
    rows = [(k % 300, " ".join(rnd.choice(["grumblefink", "apple"] if k % 300 < 100 else ["apple", "pear"]) + f" w{rnd.randint(0, 50)}" for _ in range(30)), "", "") for k in range(900)]
    labels = spark.createDataFrame([(k, 1, int(k < 100)) for k in range(300)], "doc_id long, quality int, toxic int")
    scores = [sorted((r.doc_id, r.score) for r in T.score(spark.createDataFrame(r, ODD).repartition(n), labels).collect()) for r, n in ((rows, 1), (rows[::-1], 7))]
    assert scores[0] == scores[1] and len({s for _, s in scores[0]}) > 1


def plain_score(text, lexicon, w, cache):
    """The score of a text with what was learned: distances to all terms, quotation marks line by line, windows counted one by one."""
    import math
    import re

    def hit(word):
        if word in lexicon.weights:
            return lexicon.weights[word], 0
        if word in lexicon.harmless or len(word) < 4:
            return None
        near = min(((distance(t, word), t) for t in lexicon.weights if abs(len(t) - len(word)) <= T.allowed_edits(t) and distance(t, word) <= T.allowed_edits(t)), default=None)
        return near and (lexicon.weights[near[1]], near[0])

    hits, k = [], 0
    for line in (text or "").lower().split("\n"):
        parts = re.split(f"[{T._QUOTES}]", line)
        for n, part in enumerate(parts):
            # Parts between a mark and the next are quoted; one that no mark closes is not.
            quoted = n % 2 == 1 and n < len(parts) - 1
            for word in re.findall(r"[^\W_]+", part):
                if word not in cache:
                    cache[word] = hit(word)
                if cache[word]:
                    hits.append((k, word, *cache[word], quoted))
                k += 1
    f = dict.fromkeys(T.FEATURES, 0.0)
    for name, exact in (("exact", True), ("near", False)):
        own = [(k, v) for k, _, v, e, q in hits if (e == 0) == exact and not q]
        f[name] = sum(v for _, v in own)
        f[f"{name}_dense"] = max((sum(v for j, v in own if k - 2 * T.WINDOW <= j <= k) for k, _ in own), default=0.0)
        f["quoted" if exact else "quoted_near"] = sum(v for _, _, v, e, q in hits if (e == 0) == exact and q)
    f["exact_kinds"] = len({word for _, word, _, e, q in hits if e == 0 and not q})
    m = w[0] + sum(c * math.log1p(f[name]) for c, name in zip(w[1:], T.FEATURES))
    return 1 / (1 + math.exp(-m))


def test_every_score_against_a_plain_version(spark, monkeypatch):
    sf, kept = "/root/testdata/sf0.01", []
    learn = T.learn
    monkeypatch.setattr(T, "learn", lambda *a: kept.append(learn(*a)) or kept[-1])
    got = {r.doc_id: r.score for r in T.op9_toxicity(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lexicon, w = kept[0]
    assert lexicon.weights and len(got) == len(docs)
    words: dict = {}
    assert max(abs(got[d] - plain_score(t, lexicon, w, words)) for d, t in docs.items()) < 1e-9
    assert {s >= 0.5 for s in got.values()} == {True, False}


def test_ids_of_narrower_types(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    assert sorted((r.doc_id, r.score) for r in T.score(docs, spark.createDataFrame([], "doc_id int, toxic int")).collect()) == [(1, 0.5), (2, 0.5)]
