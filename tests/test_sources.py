"""Readers, writers, generators, and searches over streams."""

from pyspark.sql import functions as F

from stringmill.operators import exact, report
from stringmill.plans import catalogue
from stringmill.sources import datagen, readers, writers
from stringmill.streaming import search


def put(path, text, newline=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline=newline) as f:
        f.write(text)


def test_fasta(spark, tmp_path):
    put(tmp_path / "a.fasta", "junk\r\n>dna|random|len10|i0\r\nACGT\r\nac>gt\r\n>two \r\n\r\nTT\r\n")
    put(tmp_path / "b.fasta", ">only\n")
    got = [tuple(r) for r in readers.read_fasta(spark, f"{tmp_path}/*.fasta").orderBy("file", "rec").collect()]
    assert got == [("a.fasta", 0, "dna|random|len10|i0", "ACGTac>gt"), ("a.fasta", 1, "two", "TT"), ("b.fasta", 0, "only", "")]
    h = spark.createDataFrame([("dna|random|len10|i0",), ("odd",)], "header string").select(readers.header_fields(F.col("header")).alias("h")).select("h.*").collect()
    assert tuple(h[0]) == ("dna", "random", 10, 0) and h[1].kind == "odd" and h[1].len is None
    records = readers.read_fasta(spark, f"{tmp_path}/a.fasta")
    writers.write_fasta(records.select("header", F.repeat(F.replace("seq", F.lit(">"), F.lit("n")), 40).alias("seq")), f"{tmp_path}/out")
    back = readers.read_fasta(spark, f"{tmp_path}/out/*.txt").orderBy("header").collect()
    assert [(r.header, len(r.seq)) for r in back] == [("dna|random|len10|i0", 360), ("two", 80)]


def test_genome_and_patterns(spark, tmp_path):
    put(tmp_path / "g.txt", ">head\nac gt\n>x\nTT\n")
    assert [tuple(r) for r in readers.load_genome(spark, f"{tmp_path}/g.txt").collect()] == [("g.txt", "ACGTTT")]
    g = readers.load_genome(spark, f"{tmp_path}/g.txt")
    assert readers.trim_genome(g, F.lit(1), 4, 2).first().wrapped == "CG\nTT"
    for c, n, p in (("rare", "b", " ACG\n"), ("rare", "a", "TT"), ("many", "q", "A")):
        put(tmp_path / "p" / c / f"{n}.txt", p)
    rows = [tuple(r) for r in readers.read_patterns(spark, f"{tmp_path}/p").orderBy("category", "name").collect()]
    assert rows == [("many", "q", "A", 1), ("rare", "a", "TT", 2), ("rare", "b", "ACG", 3)]
    assert [r.name for r in readers.read_patterns(spark, f"{tmp_path}/p", ["rare"], 1).collect()] == ["a"]
    assert {tuple(r) for r in readers.count_patterns(readers.read_patterns(spark, f"{tmp_path}/p")).collect()} == {("many", 1), ("rare", 2)}
    writers.write_patterns(readers.read_patterns(spark, f"{tmp_path}/p"), f"{tmp_path}/w")
    assert spark.read.text(f"{tmp_path}/w").count() == 3


def test_uploads(spark, tmp_path):
    put(tmp_path / "a.TXT", "x" * 30)
    put(tmp_path / "b.exe", "x")
    (tmp_path / "c.fa").write_bytes(b"ab\xffc")
    got = {r.name: (r.content, r.size, r.truncated) for r in readers.read_uploads(spark, f"{tmp_path}/*", 10).collect()}
    assert got == {"a.TXT": ("x" * 10, 30, True), "c.fa": ("abc", 3, False)}


def test_rows_and_reports(spark, tmp_path):
    runs = spark.createDataFrame([("p", "c", "regex", 5, 0.0, 1.0, 1.5, 2), ("p", "c", "kmp", 5, 0.5, 2.0, 2.5, 2), ("q" * 30, "c", "kmp", 300, 0.5, 0.0, 2.5, 2)], "pattern_name string, category string, algorithm string, pattern_length int, preprocessing_ms double, search_ms double, memory_kb double, matches_count long")
    assert {(r.pattern_name[0], r.algorithm): (r.speedup, r.band) for r in report.speedup(runs, "regex").collect()} == {("p", "regex"): (1.0, "faster"), ("p", "kmp"): (0.5, "slower"), ("q", "kmp"): (1.0, "faster")}
    assert {r.shown for r in report.listing(runs).collect()} == {"p", "q" * 17 + "..."}
    assert {r.throughput for r in report.with_throughput(runs, 100).collect()} == {100.0, 50.0, None}
    assert report.kept_runs(runs.withColumn("algorithm", F.lit("naive"))).count() == 2
    assert report.kept_runs(runs.withColumn("algorithm", F.lit("naive")), naive_longest=0).count() == 3
    writers.write_rows(runs, f"{tmp_path}/r", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").count() == 3
    writers.write_table(report.by_algorithm(runs), f"{tmp_path}/t", {"algorithm": 10, "runs": 5})
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["kmp       2", "regex     1"]
    assert "| kmp |" in writers.markdown(report.by_algorithm(runs), "Times")
    put(tmp_path / "a.csv", readers.APPROX_ROWS.replace(" string", "").replace(" int", "").replace(" double", "").replace(" ", "") + "\nf,dna|random|len5|i0,5,2,1,1,1,2,1,3,1\n")
    s = report.approx_summary(readers.read_approx_rows(spark, f"{tmp_path}/a.csv")).first()
    assert (s.sequence_type, s.shiftor_vs_regex, s.levenshtein_vs_regex) == ("random", 2.0, 3.0)


def test_generators_are_seeded(spark):
    grid = datagen.sequence_grid(spark, list(datagen.KINDS), [0, 90, 400], 2)
    a, b = ({r.header: r.seq for r in datagen.sequences(g, 7).collect()} for g in (grid, grid.repartition(7)))
    assert a == b and a != {r.header: r.seq for r in datagen.sequences(grid, 8).collect()}
    assert all(len(s) == int(h.split("|")[2][3:]) and set(s) <= set("ACGT") for h, s in a.items())
    high = "".join(s for h, s in a.items() if "high_gc" in h)
    assert 0.6 < sum(c in "GC" for c in high) / len(high) < 0.8
    assert a["dna|repetitive|len90|i0"] == ("ATGC" * 30)[:90]
    texts = spark.createDataFrame([(1, "ACGT" * 30), (2, "AC")], "text_id int, text string")
    s = datagen.samples(texts, [5], 3).collect()
    assert len(s) == 3 and all(("ACGT" * 30)[r.start : r.start + 5] == r.query for r in s)
    m = texts.select("text", datagen.with_substitutions(F.col("text"), F.col("text_id"), 1, 3).alias("x")).collect()
    assert [sum(p != q for p, q in zip(r.text, r.x)) for r in m] == [3, 2]


def test_corpus(spark):
    text = datagen.planted_text(spark, 20_000, "ACGTTGCAACGT", 200, 5)
    rows = datagen.pattern_corpus(text).collect()
    counts = {}
    for r in rows:
        counts[r.category] = counts.get(r.category, 0) + 1
        assert r.length == len(r.pattern)
    assert counts["repetitive"] == 9 and counts["rabin-karp-adversarial"] == 10 and counts["zero-occurrence"] == 35 and counts["rare"] == 10 and counts["many-query"] == 100 and counts["average"] == 55
    full = text.first().text
    assert len(full) == 20_000 and full.count("ACGTTGCAACGT") >= 100
    assert all(r.pattern not in full for r in rows if r.category == "zero-occurrence")
    assert all(r.pattern in full for r in rows if r.category in ("average", "rare", "many-query"))


def test_stream_gives_what_a_batch_gives(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/in")
    stream = search.texts_of(spark, f"{tmp_path}/in", "doc_id long, text string", "doc_id", "text")
    search.run_once(search.hits(stream, list(catalogue.SHORT)), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("text_id", "pattern", "pos").collect())
    assert got == sorted(tuple(r) for r in exact.by_split(catalogue.documents(spark, sf_dir), catalogue.words(spark)).collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "pattern", "pos"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_all_pages_are_uploads_up_to_the_bound(spark, tmp_path):
    most = readers.UPLOAD_CHARS
    pages = [(k, "u", "é" * n) for k, n in enumerate((5, 2001, most, most + 1, 0))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.name: tuple(r)[1:] for r in catalogue.QUERIES["upload_filter"](spark, str(tmp_path)).collect()}
    assert got == {f"{k}.txt": (h[:most], len(h), len(h) > most) for k, _, h in pages}
    files = spark.createDataFrame([(n, "x" * 7) for n in ("a.exe", "txt", "a.txt.exe", "a.FQ", "a.exe.txt", "b.FASTQ")], "name string, content string")
    assert {tuple(r) for r in readers.accepted_uploads(files, 6).collect()} == {(n, "x" * 6, 7, True) for n in ("a.exe.txt", "b.FASTQ")}


def test_pivots_of_all_algorithms_and_categories(spark, tmp_path):
    docs = [(1, "aa", "en", "src0", 16), (2, "b", "fr", "src7", 8), (3, "b", "fr", "src7", 24), (4, "c", None, "new", 80)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    means = {(r.category, r.algorithm): r.mean_ms for r in catalogue.QUERIES["category_pivot"](spark, str(tmp_path)).collect()}
    assert means == {(c, a): 0.0 for c in ("en", "fr", None) for a in ("src0", "src7", "new")} | {("en", "src0"): 2.0, ("fr", "src7"): 2.0, (None, "new"): 10.0}
    rows = [tuple(r) for r in catalogue.QUERIES["category_patterns"](spark, str(tmp_path)).select("category", "pattern_name", "algorithm", "search_ms").collect()]
    want = {(lang, str(d), a): n / 8 if a == s else 0.0 for d, _, lang, s, n in docs for a in ("src0", "src7", "new")}
    assert len(rows) == len(want) and {r[:3]: r[3] for r in rows} == want
