import random
import re
from collections import Counter, defaultdict

import duckdb

from stringmill.llm import line_dedup as L

ODD = "doc_id long, text string, source string, n_chars int, _site string, _row string, _bad int"


def brute(rows, ratio=L.RATIO, least=L.MIN_PAGES, distinct=False):
    pages = [(s, t) for _, t, s in rows]
    if distinct:
        pages = set(pages)
    total = Counter(s for s, _ in pages)
    count = defaultdict(int)
    for s, t in pages:
        for line in {x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)}:
            count[s, line] += 1
    bad = {k for k, n in count.items() if n >= least and n > ratio * total[k[0]]}
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in bad)) for d, t, s in rows]


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    rows = []
    for k in range(400):
        site = rnd.choice(["a", "a", "a", "b", None, "c"])
        lines = [f"line {rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 5))]
        if rnd.random() < 0.3:
            lines.insert(0, "Menu | Home")
        if rnd.random() < 0.1:
            lines += ["", " \t", "Footer ©", ""]
        rows.append((k, "\n".join(lines), site))
    rows += [(1000 + k, "copied page\nof two lines", "a") for k in range(100)]
    rows += [(2000, None, "a"), (2001, None, None), (None, "", "b"), (5, "x", "b"), (5, "x", "b"), (6, "Menu | Home\n" + "long " * 50_000, "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "s", "r", 1) for r in rows], ODD).repartition(4)
    for most, distinct in ((L.BROADCAST_LINES, False), (0, False), (L.BROADCAST_LINES, True)):
        monkeypatch.setattr(L, "BROADCAST_LINES", most)
        got = L.drop_boilerplate(docs, distinct=distinct)
        assert got.schema.names == docs.schema.names
        got = got.collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter(brute(rows, distinct=distinct))
        assert all(r.n_chars == (None if r.text is None else len(r.text)) and (r._site, r._row, r._bad) == ("s", "r", 1) for r in got)
    assert L.drop_boilerplate(docs.limit(0)).collect() == []


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    for t in ("documents",):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = sorted(duckdb.sql(L.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in L.op2_line_dedup(spark, sf_dir).collect())
    assert got == want and any(r[4] for r in got)
