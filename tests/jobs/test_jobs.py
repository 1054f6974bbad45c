"""The jobs on copies of the tables: growing input, stopped runs, reruns, odd rows, and their SQL."""

import json
import random
import shutil
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from jobs import common, queries, scan_new_texts, search_report
from stringmill.operators import multi

DOCS = "doc_id long, text string, lang string, source string, extra string"
ITEMS = [(1, "needle in"), (2, "aa"), (3, "absent"), (4, "aa"), (5, ""), (6, None), (7, "é\U0001f600e")]


def places(rows, items):
    return Counter((d, k, i, lang or None) for d, t, lang, *_ in rows for k, p in items if p and t for i in range(len(t)) if t.startswith(p, i))


def made(n, seed=0):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["needle", " in ", "aaaa", "é\U0001f600e", "x", "\n"])
    return [(seed * 1000 + k, "".join(word() for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de", None, "", "01"]), "s", "e") for k in range(n)] + [(seed * 1000 + 900, None, "en", "s", "e"), (seed * 1000 + 901, "aaa" * 50_000, "en", "s", "e")]


def put(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode(mode).parquet(path)


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/items")
    return tmp_path, lambda: scan_new_texts.scan(spark, f"{tmp_path}/docs", f"{tmp_path}/items", f"{tmp_path}/out", f"{tmp_path}/state", files_per_batch=2)


def found(spark, at):
    return Counter((r.text_id, r.pattern_id, r.pos, r.lang) for r in scan_new_texts.hits_of(spark, f"{at}/out").collect())


def test_growing_input(spark, tables):
    at, scan = tables
    a, b = made(30, 1), made(20, 2)
    put(spark, a, f"{at}/docs")
    scan()
    assert found(spark, at) == places(a, ITEMS)
    first = {p: p.stat().st_mtime_ns for p in (at / "out").rglob("*.parquet")}
    scan()  # nothing new
    assert {p: p.stat().st_mtime_ns for p in (at / "out").rglob("*.parquet")} == first
    for k in range(3):
        put(spark, b[k::3], f"{at}/docs")
    scan()
    assert found(spark, at) == places(a + b, ITEMS)
    assert {p: p.stat().st_mtime_ns for p in first} == first  # what was written before is not written again
    read = scan_new_texts.read_of(spark, f"{at}/out").collect()
    assert {r.batch for r in read} == {0, 1, 2}
    assert sum(r.texts for r in read) == len(a + b) and sum(r.hits for r in read) == sum(places(a + b, ITEMS).values())
    assert {r.lang for r in read} == {"en", "de", "01", None}


def test_a_stopped_run_goes_on(spark, tables, monkeypatch):
    at, scan = tables
    parts = [made(10, k) for k in range(4)]
    for p in parts:
        put(spark, p, f"{at}/docs")
    # Stopped after the second batch was written, before Spark took note of it.
    real, calls = multi.search, []

    def stopping(texts, patterns):
        calls.append(1)
        if len(calls) == 2:
            real(texts, patterns).select("text_id.text_id", "text_id.part", "pattern_id", "pos").withColumnRenamed("part", "lang").write.mode("overwrite").partitionBy("lang").parquet(f"{at}/out/hits/batch=1")
            raise RuntimeError("stopped")
        return real(texts, patterns)

    monkeypatch.setattr(multi, "search", stopping)
    with pytest.raises(Exception, match="stopped"):
        scan()
    monkeypatch.setattr(multi, "search", real)
    scan()
    assert found(spark, at) == places([r for p in parts for r in p], ITEMS)


def test_other_patterns_are_an_error(spark, tables):
    at, scan = tables
    put(spark, made(5, 1), f"{at}/docs")
    scan()
    spark.createDataFrame(ITEMS[:2], "item_id long, text string").write.mode("overwrite").parquet(f"{at}/items")
    with pytest.raises(ValueError, match="patterns"):
        scan()


def test_no_patterns_and_no_hits(spark, tables):
    at, scan = tables
    put(spark, [(1, "nothing", "en", "s", "e")], f"{at}/docs")
    scan()
    assert found(spark, at) == Counter()
    shutil.rmtree(at / "out"), shutil.rmtree(at / "state")
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{at}/items")
    scan()
    assert found(spark, at) == Counter() and [tuple(r) for r in scan_new_texts.read_of(spark, f"{at}/out").collect()] == [("en", 1, 7, 0, 0)]


def test_report_of_some_languages(spark, tmp_path):
    rows = [(k, t, lang, s, "e") for k, (t, lang, s) in enumerate([("house houses mouse", "en", "a"), ("hhouse", "en", "b"), (None, "de", "a"), ("", "de", None), ("house", None, "a"), ("house", "", "a")])]
    put(spark, rows, f"{tmp_path}/docs")
    spark.createDataFrame([(1, "house house mouse Tree"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/items")
    run = lambda **more: search_report.report(spark, f"{tmp_path}/docs", f"{tmp_path}/items", f"{tmp_path}/out", words=2, **more)
    read = lambda: {(r.lang, r.source, r.pattern, r.way): (r.texts, r.texts_with, r.hits, r.ratio) for r in search_report.report_of(spark, f"{tmp_path}/out").collect()}
    run()
    whole = read()
    assert len(whole) == 5 * 2 * 3
    assert whole["en", "a", "house", "overlapping"] == (1, 1, 2, 1.0) and whole["en", "a", "house", "mismatches"] == (1, 1, 3, 1.5)
    assert whole["de", None, "mouse", "apart"] == (1, 0, 0, None) and whole[None, "a", "house", "apart"] == (2, 2, 2, 1.0)
    run()
    assert read() == whole
    put(spark, [(9, "house", "en", "a", "e"), (10, "mouse", "de", "a", "e")], f"{tmp_path}/docs")
    run(languages=["en"])
    part = read()
    assert {k for k in whole if part[k] != whole[k]} == {k for k in whole if k[:2] == ("en", "a")} and len(part) == len(whole)
    run()
    assert read()["de", "a", "mouse", "overlapping"] == (2, 1, 1, 1.0)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_sql(spark, sf_dir, name):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    q = db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in q.description]
    assert sorted(columns) == sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    assert got == Counter(q.fetchall()) and got
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def test_config(spark, tmp_path):
    for job, schema in (("scan_new_texts", scan_new_texts.SCHEMA), ("search_report", search_report.SCHEMA)):
        path = Path(common.__file__).with_name(f"{job}.json")
        assert common.config(spark, str(path), schema) == json.loads(path.read_text())
    (tmp_path / "c.json").write_text('{"wordz": 3}')
    with pytest.raises(ValueError, match="wordz"):
        common.config(spark, str(tmp_path / "c.json"), search_report.SCHEMA)
