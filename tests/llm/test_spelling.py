"""Spelling variants against a brute-force version over all pairs, and against the SQL."""

import random
import re
import string
import zlib
from collections import Counter

import duckdb
import pytest

from stringmill.llm import spelling

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, length=6, count=5, ratio=5):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                seen[run] += 1
    n = {w: k for w, k in seen.items() if k >= count}
    forms, out = {}, {}
    for w in n:
        own = [v for v in n if near(w, v)]
        best = min(own, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = len(own)
    def root(w):
        return w if forms[w] is None else root(forms[w])
    return {(w, forms[w], root(w), n[w], out[w], n.get(forms[w])) for w in n}


def made(seed, docs=60):
    rnd = random.Random(seed)
    base = ["needle", "handlé", "Ñandúes", "straße", "aaaaaa", "garden", "wonder", "thunder"]
    def word():
        w = list(rnd.choices(base, [40, 10, 5, 5, 30, 20, 10, 3])[0])
        for _ in range(rnd.choice([0] * 12 + [1, 1, 2])):
            at, kind = rnd.randrange(len(w)), rnd.randrange(3)
            w[at : at + (kind != 2)] = [] if kind == 0 else [rnd.choice("aeéxZ")]
        return "".join(w)
    texts = [rnd.choice([" ", "-", "1", "\n", "\U0001f600"]).join(word() for _ in range(rnd.randint(0, 120))) for _ in range(docs)]
    rows = list(enumerate(texts))
    rows += [(None, texts[0]), (3, texts[3]), (3, None), (900, ""), (901, None), (902, ("Needles wonders " * 20_000))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(d, "wrong", t, "x", "y") for d, t in rows], "doc_id long, TEXT string, text string, word string, n string")
    got = [tuple(r) for r in spelling.group(docs).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(f for _, f, *_ in want) and any(w != r != f for w, f, r, *_ in want if f) and max(k for *_, k, _ in want) > 2


def test_small_counts_and_chains(spark):
    # The chain leads over more steps than one pointer jump; ties go to the first word.
    n = {"aaaaaa": 1, "aaaaab": 2, "aaaabb": 4, "aaabbb": 8, "aabbbb": 16, "abbbbb": 32, "zzzzzy": 7, "zzzzzx": 7, "zzzzzw": 2}
    rows = [(k, w) for w, m in n.items() for k in range(m)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {tuple(r) for r in spelling.group(docs, count=1, ratio=2).collect()}
    assert got == brute(rows, count=1, ratio=2)
    assert {(w, f, r) for w, f, r, *_ in got} >= {("aaaaaa", "aaaaab", "abbbbb"), ("zzzzzw", "zzzzzx", "zzzzzx")}
    with pytest.raises(ValueError):
        spelling.group(docs, ratio=1)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group(docs).collect() == [] and spelling.group(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert Counter(map(tuple, spelling.op12_spelling_variants(spark, sf_dir).collect())) == Counter(db.execute(spelling.ORACLE_SQL).fetchall())
