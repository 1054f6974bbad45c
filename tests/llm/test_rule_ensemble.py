import zlib

import numpy as np

from stringmill.llm import rule_ensemble as R

ODD = "doc_id long, text string, score string, quality string"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    p = y.sum()
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_lasso_finds_the_planted_rule():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(R.FEATURES)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    m = R.fit(x, y)
    assert auc(y, m.margin(x)) > 0.99
    assert 0 < len(m.rules) < 120


def test_constant_labels():
    m = R.fit(np.zeros((50, len(R.FEATURES))), np.ones(50))
    assert not m.rules and m.bias > 0


def test_expression_is_the_model(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(R.FEATURES)))
    m = R.fit(x, (x[:, 0] > 0.5).astype(float))
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k int, " + ", ".join(f"{f} double" for f in R.FEATURES))
    got = {r[0]: r[1] for r in df.select("k", m.expression({f: F.col(f) for f in R.FEATURES})).collect()}
    want = 1 / (1 + np.exp(-m.margin(x)))
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y"), (None, "z", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y")], ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = R.score(docs, labels).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert R.score(docs.limit(0), labels).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in R.op4_rule_ensemble(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(got) == docs
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for d, r in got.items())
    y = [(r.quality, got[r.doc_id].score) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    a = auc(np.array([q for q, _ in y]), np.array([s for _, s in y]))
    print("held-out AUC", a)
    assert a > 0.95


def test_samples_are_bounded_and_repeatable(spark):
    from stringmill.llm import common

    df = spark.range(5000).selectExpr("id AS doc_id")
    a, b = ({r.doc_id for r in common.sample_by_hash(d, "doc_id", 300).collect()} for d in (df, df.repartition(9)))
    assert len(a) == 300 and a == b
    assert common.sample_by_hash(df, "doc_id", 10_000).count() == 5000


def plain_shares(text):
    """The statistics of a text, each by its own words."""
    import math
    import re
    from collections import Counter

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    inside = {j for k, w in enumerate(windows) if times[w] > 1 for j in range(k, k + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, share = sum(map(len, words)), lambda part, whole: part / whole if whole else 0.0
    n = lambda pattern: len(re.findall(pattern, text))
    wide = len(text.encode()) - len(text)
    return {
        "symbol_share": share(n(r"[#*$%&|<>]"), chars), "repeat_share": share(len(inside), len(words)), "dup_line_share": share(len(lines) - len(set(lines)), len(lines)), "upper_share": share(n("[A-Z]"), n("[A-Za-z]")),
        "digit_share": share(n("[0-9]"), chars), "stop_share": share(n("[.,;:!?]"), len(words)), "bang_share": share(n("!"), len(words)), "same_next_share": share(sum(a == b for a, b in zip(words, words[1:])), len(words)),
        "distinct_share": share(len(set(words)), len(words)), "word_length": share(chars, len(words)), "line_words": share(len(words), len(lines)), "letter_share": share(n("[A-Za-z]") + wide, chars),
        "log_words": math.log1p(len(words)), "longest_word": float(max((len(w.encode()) for w in words), default=0)),
    }


def test_every_score_against_a_plain_version(spark, monkeypatch):
    """Statistics, rules and score of all rows again, condition by condition."""
    import math

    sf, kept, fit = "/root/testdata/sf0.01", [], R.fit
    monkeypatch.setattr(R, "fit", lambda *a: kept.append(fit(*a)) or kept[-1])
    got = {r.doc_id: r for r in R.op4_rule_ensemble(spark, sf).collect()}
    model = kept[0]
    assert model.rules or model.linear

    def score(text):
        x = plain_shares(text)
        value = lambda k: x[R.FEATURES[k]]
        m = model.bias
        for rule, w in model.rules:
            m += w * all(value(k) > cut if above else value(k) <= cut for k, above, cut in rule)
        for k, low, high, w in model.linear:
            m += w * min(1.0, max(0.0, (value(k) - low) / (high - low)))
        return 1 / (1 + math.exp(-m))

    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert abs(got[r.doc_id].score - score(r.text)) < 1e-9, r.doc_id
