"""Speed-ups, skips, listings and text reports in which every branch occurs; sinks that go on; table functions; streams."""

import random
import time

import pytest
from pyspark.sql import functions as F

from stringmill.functions import tables
from stringmill.operators import exact, report
from stringmill.plans import catalogue
from stringmill.sources import readers, writers
from stringmill.streaming import search

BANDS = {"much faster", "faster", "slower", "much slower", "far slower"}


def test_every_branch_of_the_speedups_occurs(spark, sf_dir):
    rows = report.speedup_rows(catalogue.bench_runs(spark, sf_dir), "regex").collect()
    assert {r.band for r in rows if r.algorithm != "regex"} == BANDS
    assert {r.has_baseline for r in rows} == {True, False} and any(r.total_ms == 0 and r.speedup == 0 for r in rows)
    by = {r.algorithm: r for r in catalogue.speedup_by_algorithm(spark, sf_dir).collect()}
    assert by["regex"].total_speedup == by["regex"].run_speedup == 1.0 and len({r.total_band for r in by.values()}) > 1


def test_speedups_by_algorithm(spark):
    times = {"regex": [4.0, 4.0], "two": [2.0, 2.0], "one": [3.0, 5.0], "half": [8.0, 8.0], "tenth": [20.0, 20.0], "less": [100.0, 100.0], "none": [0.0, 0.0]}
    runs = spark.createDataFrame([(a, t, 0.0) for a, own in times.items() for t in own], "algorithm string, search_ms double, preprocessing_ms double")
    got = {r.algorithm: (r.total_speedup, r.total_words, r.run_band) for r in report.speedup_by_algorithm(runs, "regex").collect()}
    assert got == {
        "regex": (1.0, "1.0000x faster", "faster"), "two": (2.0, "2.0000x faster", "much faster"), "one": (1.0, "1.0000x faster", "faster"), "half": (0.5, "2.0000x slower", "slower"),
        "tenth": (0.2, "5.0000x slower", "much slower"), "less": (0.04, "25.0000x slower", "far slower"), "none": (0.0, None, "far slower"),
    }
    assert {(r.run_speedup, r.run_words, r.run_band) for r in report.speedup_by_algorithm(runs, "absent").collect()} == {(None, None, None)}


def test_policy_drops_and_pivot_fills(spark, sf_dir):
    runs = catalogue.bench_runs(spark, sf_dir)
    gone = runs.exceptAll(catalogue.skip_policy_runs(spark, sf_dir)).select("algorithm", "category", (F.col("pattern_length") > 100).alias("long")).distinct().collect()
    assert {r.algorithm for r in gone} == {"naive", "suffix_tree"} and {(r.category == "de", r.long) for r in gone if r.algorithm == "naive"} >= {(True, True), (False, True)}
    zeros = [r for r in catalogue.category_pivot_runs(spark, sf_dir).collect() if r.mean_ms == 0]
    assert [(r.category, r.algorithm) for r in zeros] == [("fr", "kmp")]
    sparse = report.every_pair(runs, ["category"], F.avg("search_ms"), "mean_ms", filled=False)
    assert {tuple(r) for r in catalogue.category_pivot_runs(spark, sf_dir).select(*sparse.columns).collect()} - {tuple(r) for r in sparse.collect()} == {("fr", "kmp", 0.0)}


def test_text_reports(spark, tmp_path):
    rows = [(f"file{k:02d}_with_a_name_that_is_long.fasta", f"dna|{'ab'[k % 2]}|len5|i0", 100 * (k % 3 + 1), 20, k % 6, 1.0, 2e6, 2.0, 3e6, 8.0, 4e6) for k in range(30)]
    df = spark.createDataFrame(rows, readers.APPROX_ROWS).repartition(5)
    writers.write_detailed(df, f"{tmp_path}/d")
    lines = [line for p in sorted((tmp_path / "d").glob("part-*")) for line in p.read_text().splitlines()]
    at = next(k for k, line in enumerate(lines) if line.startswith("File"))
    body = lines[at + 2 : at + 32]
    assert "Records: 30" in lines and [b[:6] for b in body] == [f"file{k:02d}" for k in range(30)]
    assert body[7].split() == ["file07_with_a_name_that_i", "200", "20", "1", "1.000000000", "2.000000000", "8.000000000", "2.00", "3.00", "4.00"]
    writers.write_summary(report.approx_summary(df), f"{tmp_path}/s")
    lines = [line for p in sorted((tmp_path / "s").glob("part-*")) for line in p.read_text().splitlines()]
    assert sum(line.endswith("8.0x") for line in lines) == 6 and "Shift-Or is on average 4.0x faster than Levenshtein" in lines
    assert lines.index("KEY FINDINGS") > max(k for k, line in enumerate(lines) if line.endswith("8.0x"))


def test_a_stopped_sink_goes_on(spark, tmp_path):
    wanted = spark.range(200).withColumnRenamed("id", "pair")
    made = []

    def make(part, stop=None):
        if len(made) == stop:
            raise RuntimeError("stopped")
        made.append(1)
        return part.withColumn("twice", F.col("pair") * 2)

    with pytest.raises(RuntimeError):
        writers.append_missing(wanted, ["pair"], lambda p: make(p, 3), f"{tmp_path}/out", 8)
    # A part that was written but not yet noted is written again, not twice.
    make(wanted.filter(F.pmod(F.xxhash64("pair"), F.lit(8)) == 3)).write.parquet(f"{tmp_path}/out/rows/batch=3")
    del made[:]
    assert writers.append_missing(wanted, ["pair"], make, f"{tmp_path}/out", 8) == 5 == len(made)
    assert writers.append_missing(wanted, ["pair"], make, f"{tmp_path}/out", 8) == 0
    got = sorted((r.pair, r.twice) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect())
    assert got == [(k, 2 * k) for k in range(200)]


def test_table_functions(spark):
    tables.register(spark)
    tables.register_search(spark, "every_end", lambda text, pattern: [len(text) - len(pattern)] if text.endswith(pattern) else [])
    texts = [("a", "abab"), ("b", None), ("c", ""), ("d", "xxabx"), (None, "ab")]
    spark.createDataFrame(texts, "name string, text string").createOrReplaceTempView("some")
    call = lambda q: sorted(((r[0] or "", *r[1:]) for r in spark.sql(q).collect()))
    want = sorted((n or "", p, i, 0) for n, t in texts for p in ("ab", "x") if t for i in range(len(t)) if t.startswith(p, i))
    for name in ("naive", "kmp", "boyer_moore", "suffix_tree", "rabin_karp"):
        assert call(f"SELECT * FROM search(TABLE(some), array('ab', 'x', '', null), '{name}')") == want == call(f"SELECT * FROM search_{name}(TABLE(some), array('ab', 'x'))")
    near = [("a", "aab", 1, 1), ("d", "aab", 1, 1)]
    assert call("SELECT * FROM search(TABLE(some), array('aab'), 'shift_or', 1)") == near == call("SELECT * FROM search_shift_or(TABLE(some), array('aab'), 1)")
    assert {r[0] for r in call("SELECT * FROM search_levenshtein(TABLE(some), array('aab'), 1)")} == {"", "a", "d"}
    assert call("SELECT * FROM every_end(TABLE(some), array('ab'))") == [("", "ab", 0, 0), ("a", "ab", 2, 0)]
    assert spark.sql("SELECT * FROM search_kmp(TABLE(some), array('ab'))").columns == ["name", "pattern", "pos", "dist"]
    for wrong in ("search(TABLE(some), array('ab'), 'none')", "search(TABLE(some), array('ab'))", "search_kmp(TABLE(SELECT name FROM some), array('ab'))"):
        with pytest.raises(Exception, match="algorithm|key and a text"):
            spark.sql(f"SELECT * FROM {wrong}").collect()


def test_streams_take_time_in_proportion_to_hits(spark, tmp_path):
    took = []
    for n in (20_000, 80_000):
        spark.createDataFrame([(1, "ab" * n)], "doc_id long, text string").write.parquet(f"{tmp_path}/in{n}")
        stream = search.texts_of(spark, f"{tmp_path}/in{n}", "doc_id long, text string", "doc_id", "text")
        began = time.perf_counter()
        search.run_once(search.hits(stream, ["ab"]), f"{tmp_path}/out{n}", f"{tmp_path}/state{n}")
        took.append(time.perf_counter() - began)
        assert spark.read.parquet(f"{tmp_path}/out{n}").count() == n
    assert took[1] < 10


def test_long_texts_in_pieces_take_linear_time(spark):
    rnd = random.Random(1)
    p = spark.createDataFrame([("the",)], "pattern string")
    took = []
    for n in (250_000, 1_000_000):
        text = "".join(rnd.choice("the ") for _ in range(n))
        t = spark.createDataFrame([(1, text)], "text_id int, text string")
        began = time.perf_counter()
        assert exact.by_split(t, p).count() == text.count("the")
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 2


def test_first_places_and_pieces(spark):
    texts = ["ab" * 30, "", None, "b", "abab"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    p = spark.createDataFrame([("ab",), ("b",), ("zz",)], "pattern string")
    at = {(k, w): [i for i in range(len(s or "")) if s.startswith(w, i)] for k, s in enumerate(texts) for w in ("ab", "b", "zz")}
    got = {(r.text_id, r.pattern): (r.n, r.places) for r in exact.first_places(exact.by_find(t, p), 4).collect()}
    assert got == {key: (len(own), own[:4]) for key, own in at.items() if own}
    got = {(r.text_id, r.pattern): (r.whole, r.pieces, r.results_match) for r in exact.in_pieces_and_whole(t, p, 7).collect()}
    assert got == {key: (len(own), len(own), True) for key, own in at.items()}


def test_naive_search_leaves_out_what_differs_and_trimming_takes_no_regex(spark):
    from stringmill.operators import exact
    from stringmill.plans import registry

    for text, word in (("ababab", "aba"), ("", "a"), ("a", ""), ("é\U0001f600é\U0001f600", "é\U0001f600"), ("aaaa", "aa"), ("ab", "abc")):
        assert exact.window_hits(text, word) == exact.find_all(text, word)
    t, p = spark.createDataFrame([(0, "\t\x0b\x0c\r\n the  the \n")], "text_id int, text string"), spark.createDataFrame([(" the\n",)], "pattern string")
    found = registry.search(t, p, ["naive", "boyer_moore"])
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.algorithm, r.pattern, r.pos) for r in found.collect()) == [(a, "the", k) for a in ("boyer_moore", "naive") for k in (0, 5)]


def test_counts_look_ahead_only_in_texts_that_hold_the_pattern(spark):
    from stringmill.operators import approx, exact

    t, p = spark.createDataFrame([(0, "aaaa"), (1, "b"), (2, None), (3, "a.a")], "text_id int, text string"), spark.createDataFrame([("aa",), (".",), ("",)], "pattern string")
    counted = exact.count_overlapping(t, p)
    assert "ontains" in counted._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.text_id, r.pattern): r.n for r in counted.collect() if r.n} == {(0, "aa"): 3, (3, "."): 1}
    assert counted.count() == 12
    # Sums of mismatches hold the length of a long pattern too.
    assert approx.mismatches("b" * 300, "a" * 256, 5) == [] and approx.mismatches("b" * 255, "a" * 255, 255) == [(0, 255)]
