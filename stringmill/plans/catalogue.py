"""Every query of the engine, by name, with its SQL counterpart.

Searches over ``documents`` and ``benchmark`` take whole tables and whole texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import approx, exact, index, multi, payload, report, suffixes, trace
from ..sources import datagen, fasta, folders, readers, writers
from . import measure, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SHORT = ("the", "ere", "on")
#: Patterns with borders, so that a failed comparison falls back.
REPEATED = ("the", "ere", "on", "ana", "oo")
WILD = ("th?re", "a?e", "?on")
REPEATING = ("ABABACA", "AABAACAADAABAABA", "kitten", "AAAA", "GCAGAGAG")
ALPHABET = ("A", "C", "G", "T")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return readers.spread(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("text_id"), "text"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("text_id"), "text")


def words(spark: SparkSession, values: tuple[str, ...] = SHORT) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "pattern string")


def values(names: tuple[str, ...] = SHORT) -> str:
    return "(VALUES " + ", ".join(f"('{v}')" for v in names) + ") p(pattern)"


def rolled(word: str) -> int:
    """The rolling hash of a word, for the SQL."""
    h = 0
    for c in word:
        h = (h * 256 + ord(c)) % 101
    return h


def windows_sql(patterns: tuple[str, ...]) -> str:
    """SQL for doc_id, pattern, pos and ``win``, every window of the patterns' lengths, cut from pieces so that no long text is passed over twice."""
    return f"""WITH pieces AS (SELECT doc_id, pattern, length(pattern) AS m, head, substring(text, head + 1, 255 + length(pattern)) AS piece FROM
      (SELECT doc_id, text, pattern, unnest(range(0, length(text), 256)) AS head FROM documents, {values(patterns)})),
    w AS (SELECT doc_id, pattern, m, CAST(head + i AS BIGINT) AS pos, substring(piece, i + 1, m) AS win FROM (SELECT *, unnest(range(0, least(256, greatest(length(piece) - m + 1, 0)))) AS i FROM pieces))
    """


def as_doc(df: DataFrame, to: str = "doc_id") -> DataFrame:
    return df.withColumnRenamed("text_id", to)


# Each step looks for the next hit one character after the last one.
HITS = f"""
WITH RECURSIVE hits AS (
  SELECT doc_id, pattern, text, CAST(instr(text, pattern) - 1 AS BIGINT) AS pos FROM documents, {values()} WHERE instr(text, pattern) > 0
  UNION ALL
  SELECT doc_id, pattern, substring(text, instr(text, pattern) + 1), pos + instr(substring(text, instr(text, pattern) + 1), pattern)
  FROM hits WHERE instr(substring(text, instr(text, pattern) + 1), pattern) > 0)
"""
ALL_HITS = HITS + "SELECT doc_id, pattern, pos FROM hits"


@query(ALL_HITS)
def kmp_search(spark, sf):
    return as_doc(exact.by_split(documents(spark, sf), words(spark)))


@query(ALL_HITS)
def bm_search(spark, sf):
    return as_doc(exact.by_find(documents(spark, sf), words(spark)))


@query(ALL_HITS)
def naive_search(spark, sf):
    return as_doc(exact.by_windows(documents(spark, sf), words(spark)))


@query(ALL_HITS)
def rk_search(spark, sf):
    return as_doc(exact.by_hash(documents(spark, sf), words(spark)))


@query(ALL_HITS)
def suffix_search(spark, sf):
    return as_doc(exact.by_suffixes(documents(spark, sf), words(spark)))


@query(ALL_HITS)
def suffix_index_search(spark, sf):
    return as_doc(exact.by_index(exact.suffix_index(documents(spark, sf)), words(spark)))


@query(ALL_HITS)
def shiftor_exact(spark, sf):
    return as_doc(exact.by_bits(documents(spark, sf), words(spark)))


@query(ALL_HITS)
def chunked_search(spark, sf):
    return as_doc(exact.chunked(documents(spark, sf), words(spark), 500))


@query(HITS + f"SELECT d.doc_id, p.pattern, CAST(count(h.pos) AS BIGINT) AS n FROM documents d CROSS JOIN {values()} LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.pattern = p.pattern GROUP BY d.doc_id, p.pattern")
def count_overlapping(spark, sf):
    return as_doc(exact.count_overlapping(documents(spark, sf), words(spark)))


@query(HITS + f"SELECT p.pattern, CAST(count(h.pos) AS BIGINT) AS n, CAST(count(DISTINCT h.doc_id) AS BIGINT) AS texts FROM {values()} LEFT JOIN hits h ON h.pattern = p.pattern GROUP BY p.pattern")
def multi_pattern_counts(spark, sf):
    return exact.pattern_counts(documents(spark, sf), words(spark))


@query(HITS + "SELECT d.doc_id, CAST(count(h.pos) AS BIGINT) AS n FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id GROUP BY d.doc_id")
def multi_text_counts(spark, sf):
    return as_doc(exact.text_counts(documents(spark, sf), words(spark)))


@query(
    f"""WITH pieces AS (SELECT doc_id, pattern, unnest(string_split(text, pattern)) AS piece, generate_subscripts(string_split(text, pattern), 1) AS k, length(pattern) AS m FROM documents, {values()}),
    ends AS (SELECT doc_id, pattern, k, sum(length(piece) + m) OVER (PARTITION BY doc_id, pattern ORDER BY k) - 1 AS e, max(k) OVER (PARTITION BY doc_id, pattern) AS last FROM pieces)
    SELECT doc_id, pattern, CAST(e AS BIGINT) AS end_pos FROM ends WHERE k < last"""
)
def regex_nonoverlapping(spark, sf):
    return as_doc(exact.non_overlapping(documents(spark, sf), words(spark)))


@query("SELECT doc_id, p.pattern, CAST(k - 1 AS BIGINT) AS turn, matched FROM (SELECT doc_id, pattern, unnest(regexp_extract_all(text, pattern)) AS matched, generate_subscripts(regexp_extract_all(text, pattern), 1) AS k FROM documents, (VALUES ('th[a-z]re'), ('on{2}')) q(pattern)) p")
def regex_unescaped(spark, sf):
    return as_doc(exact.regex_matches(documents(spark, sf), words(spark, ("th[a-z]re", "on{2}"))))


@query(
    """WITH p AS (SELECT doc_id, pattern, string_split_regex(text, pattern) AS pieces, regexp_extract_all(text, pattern) AS found FROM documents, (VALUES ('th[a-z]re'), ('on{2}')) q(pattern)),
    r AS (SELECT doc_id, pattern, length(unnest(pieces[:len(found)])) AS before, length(unnest(found)) AS n, generate_subscripts(found, 1) AS k FROM p WHERE len(found) > 0)
    SELECT doc_id, pattern, CAST(sum(before + n) OVER (PARTITION BY doc_id, pattern ORDER BY k) - n AS BIGINT) AS pos, n AS length FROM r"""
)
def regex_starts(spark, sf):
    return as_doc(exact.regex_starts(documents(spark, sf), words(spark, ("th[a-z]re", "on{2}"))))


@query(windows_sql(WILD) + "SELECT doc_id, pattern, pos FROM w WHERE len(list_filter(range(1, m + 1), lambda j: substring(pattern, j, 1) <> '?' AND substring(pattern, j, 1) <> substring(win, j, 1))) = 0")
def wildcard_search(spark, sf):
    return as_doc(exact.wildcard_search(documents(spark, sf), words(spark, WILD)))


@query(
    f"""SELECT item_id, pattern, CAST(i AS BIGINT) AS pos FROM (SELECT item_id, text, pattern, unnest(range(0, greatest(length(text) - length(pattern) + 1, 0))) AS i FROM benchmark, {values(WILD)})
    WHERE len(list_filter(range(1, length(pattern) + 1), lambda j: substring(pattern, j, 1) <> '?' AND substring(pattern, j, 1) <> substring(text, i + j, 1))) = 0"""
)
def wildcard_items(spark, sf):
    return as_doc(exact.wildcard_search(items(spark, sf), words(spark, WILD)), "item_id")


WINDOWS = f"""WITH w AS (SELECT item_id, pattern, length(pattern) AS m, i, substring(text, i + 1, length(pattern)) AS win FROM
  (SELECT item_id, text, pattern, unnest(range(0, greatest(length(text) - length(pattern) + 1, 0))) AS i FROM benchmark, {values()})),
c AS (SELECT *, len(list_filter(range(1, m + 1), lambda j: substring(win, 1, j) = substring(pattern, 1, j))) AS lcp FROM w),
s AS (SELECT item_id, pattern, CAST(sum(least(lcp + 1, m)) AS BIGINT) AS comparisons, CAST(sum(CASE WHEN lcp = m THEN 1 ELSE 0 END) AS BIGINT) AS matches, count(*) AS positions FROM c GROUP BY item_id, pattern)
"""


@query(WINDOWS + "SELECT item_id, pattern, comparisons, matches, positions FROM s")
def naive_comparisons(spark, sf):
    return as_doc(exact.comparisons(items(spark, sf), words(spark)), "item_id")


@query(
    WINDOWS
    + """SELECT s.item_id, s.pattern, length(b.text) AS n, length(s.pattern) AS m, matches, comparisons, (length(b.text) - length(s.pattern) + 1) * length(s.pattern) AS worst,
    round(100 * comparisons / ((length(b.text) - length(s.pattern) + 1) * length(s.pattern)), 6) AS efficiency FROM s JOIN benchmark b ON b.item_id = s.item_id"""
)
def complexity_analysis(spark, sf):
    return as_doc(exact.complexity(items(spark, sf), words(spark)), "item_id")


@query(
    WINDOWS
    + """SELECT s.item_id, s.pattern, comparisons AS total_comparisons, comparisons - (positions - matches) AS successful_comparisons, positions - matches AS failed_comparisons, positions AS positions_checked,
    matches AS matches_found, length(b.text) * length(s.pattern) AS worst_case_comparisons, round(comparisons / positions, 6) AS average_comparisons, round(100 * matches / comparisons, 6) AS efficiency
    FROM s JOIN benchmark b ON b.item_id = s.item_id"""
)
def trace_naive(spark, sf):
    return as_doc(trace.naive(items(spark, sf), words(spark)), "item_id")


@query(
    f"""SELECT pattern, CAST(i AS BIGINT) AS i, CAST(list_max(list_filter(range(0, i + 1), lambda k: substring(pattern, 1, k) = substring(pattern, i + 2 - k, k))) AS BIGINT) AS failure
    FROM (SELECT pattern, unnest(range(0, length(pattern))) AS i FROM {values(REPEATING)})"""
)
def kmp_failure(spark, sf):
    return index.failure_function(words(spark, REPEATING))


@query("SELECT text AS pattern, substring(text, i, 1) AS ch, CAST(max(i) - 1 AS BIGINT) AS last_pos FROM (SELECT DISTINCT text, unnest(range(1, length(text) + 1)) AS i FROM benchmark) GROUP BY text, substring(text, i, 1)")
def bm_bad_char(spark, sf):
    return index.bad_characters(items(spark, sf).select(F.col("text").alias("pattern")))


@query(
    f"""WITH seen AS (SELECT pattern, substring(pattern, i, 1) AS ch, i - 1 AS k FROM (SELECT pattern, unnest(range(1, length(pattern) + 1)) AS i FROM {values(REPEATING)})
    UNION ALL SELECT pattern, ch, -1 FROM {values(REPEATING)}, (VALUES ('A'), ('C'), ('G'), ('T')) q(ch))
    SELECT pattern, ch, CAST(max(k) AS BIGINT) AS last_pos FROM seen GROUP BY pattern, ch"""
)
def bm_bad_char_seeded(spark, sf):
    return index.bad_characters(words(spark, REPEATING), "ACGT")


#: The patterns of the shift and mask tables.
TABLED = f"p AS (SELECT DISTINCT text AS pattern FROM benchmark WHERE text <> '' UNION SELECT pattern FROM {values(REPEATING)})"


@query(
    f"""WITH {TABLED}, c AS (SELECT pattern, length(pattern) AS m, unnest(range(0, length(pattern))) AS i FROM p)
    SELECT pattern, CAST(i AS BIGINT) AS i, CAST(coalesce(
      list_min(list_filter(range(1, i + 1), lambda s: substring(pattern, i - s + 1, 1) <> substring(pattern, i + 1, 1) AND substring(pattern, i - s + 2, m - i - 1) = substring(pattern, i + 2, m - i - 1))),
      list_min(list_filter(range(greatest(i, 1), m + 1), lambda b: starts_with(pattern, substring(pattern, b + 1))))) AS BIGINT) AS shift FROM c"""
)
def bm_good_suffix(spark, sf):
    return index.good_suffixes(items(spark, sf).select(F.col("text").alias("pattern")).union(words(spark, REPEATING)))


@query(
    f"""SELECT pattern, ch, CAST(sum(1::BIGINT << (i - 1)) AS BIGINT) AS present, CAST((1::BIGINT << length(pattern)) - 1 - sum(1::BIGINT << (i - 1)) AS BIGINT) AS shift_or
    FROM (SELECT pattern, i, substring(pattern, i, 1) AS ch FROM (SELECT pattern, CAST(unnest(range(1, length(pattern) + 1)) AS INT) AS i FROM {values(REPEATING)})) GROUP BY pattern, ch"""
)
def shiftor_masks(spark, sf):
    return index.character_masks(words(spark, REPEATING))


@query(
    f"""WITH {TABLED}, l AS (SELECT pattern, length(pattern) AS m, i, substring(pattern, i + 1, 1) AS ch FROM (SELECT pattern, unnest(range(0, length(pattern))) AS i FROM p)),
    w AS (SELECT pattern, m, ch, unnest(range(0, (m - 1) // 62 + 1)) AS word FROM (SELECT DISTINCT pattern, m, ch FROM l)),
    b AS (SELECT w.pattern, w.ch, w.word, w.m, coalesce(sum(1::BIGINT << (l.i % 62)::INT), 0) AS present FROM w LEFT JOIN l ON l.pattern = w.pattern AND l.ch = w.ch AND l.i // 62 = w.word GROUP BY ALL)
    SELECT pattern, ch, CAST(word AS INT) AS word, CAST(present AS BIGINT) AS present, CAST((1::BIGINT << least(62, m - 62 * word)::INT) - 1 - present AS BIGINT) AS shift_or FROM b"""
)
def shiftor_mask_words(spark, sf):
    return index.character_mask_words(items(spark, sf).select(F.col("text").alias("pattern")).union(words(spark, REPEATING)))


HASH4 = "((((unicode(substring(text, i + 1, 1)) % 101) * 256 + unicode(substring(text, i + 2, 1))) % 101 * 256 + unicode(substring(text, i + 3, 1))) % 101 * 256 + unicode(substring(text, i + 4, 1))) % 101"


@query(f"SELECT item_id, CAST(i AS BIGINT) AS pos, CAST({HASH4} AS BIGINT) AS hash FROM (SELECT item_id, text, unnest(range(0, greatest(length(text) - 3, 0))) AS i FROM benchmark)")
def rk_window_hash(spark, sf):
    return as_doc(index.window_hashes(items(spark, sf), 4), "item_id")


@query("SELECT doc_id, CAST(i AS BIGINT) AS pos, substring(text, i + 1, 8) AS suffix FROM (SELECT item_id AS doc_id, text, unnest(range(0, length(text))) AS i FROM benchmark)")
def suffix_table(spark, sf):
    return as_doc(exact.suffixes(items(spark, sf), 8))


@query("SELECT suffix, count(*) AS n FROM (SELECT substring(text, i + 1, 4) AS suffix FROM (SELECT text, unnest(range(0, length(text))) AS i FROM benchmark)) GROUP BY suffix")
def suffix_counts(spark, sf):
    return index.suffix_counts(items(spark, sf), 4)


@query(
    """SELECT n_nationkey, 1 + count(DISTINCT sub) AS nodes, max(length(n_name)) AS depth FROM
    (SELECT n_nationkey, n_name, substring(n_name, i, k) AS sub FROM (SELECT n_nationkey, n_name, i, unnest(range(1, length(n_name) - i + 2)) AS k FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) AS i FROM nation))) GROUP BY n_nationkey"""
)
def trie_sizes(spark, sf):
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("text_id"), F.col("n_name").alias("text"))
    return as_doc(index.trie_sizes(nations), "n_nationkey")


@query(
    f"""WITH p AS (SELECT pattern, length(pattern) AS m, CASE pattern {' '.join(f"WHEN '{w}' THEN {rolled(w)}" for w in SHORT)} END AS hash FROM {values()}),
    w AS (SELECT item_id, pattern, m, hash, substring(text, i + 1, m) AS win FROM (SELECT item_id, text, pattern, m, hash, unnest(range(0, greatest(length(text) - m + 1, 0))) AS i FROM benchmark, p)),
    c AS (SELECT *, len(list_filter(range(1, m + 1), lambda j: substring(win, 1, j) = substring(pattern, 1, j))) AS lcp,
      CASE m WHEN 2 THEN (unicode(win) % 101 * 256 + unicode(substring(win, 2, 1))) % 101 ELSE ((unicode(win) % 101 * 256 + unicode(substring(win, 2, 1))) % 101 * 256 + unicode(substring(win, 3, 1))) % 101 END AS h FROM w)
    SELECT item_id, pattern, count(*) AS hash_comparisons, CAST(coalesce(sum(CASE WHEN h = hash THEN least(lcp + 1, m) END), 0) AS BIGINT) AS character_comparisons,
      CAST(sum(CASE WHEN h = hash AND lcp < m THEN 1 ELSE 0 END) AS BIGINT) AS spurious_hits, CAST(sum(CASE WHEN lcp = m THEN 1 ELSE 0 END) AS BIGINT) AS matches_found FROM c GROUP BY item_id, pattern"""
)
def rk_hash_stats(spark, sf):
    return as_doc(trace.rolling_hash(items(spark, sf), words(spark)), "item_id")


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS dist FROM nation a, nation b")
def levenshtein_pairs(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_name")
    return approx.distances(n.select(F.col("n_name").alias("a")), n.select(F.col("n_name").alias("b")))


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS dist FROM nation a, nation b WHERE levenshtein(a.n_name, b.n_name) <= 4")
def levenshtein_within(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_name")
    return approx.distances(n.select(F.col("n_name").alias("a")), n.select(F.col("n_name").alias("b")), 4)


@query(
    """SELECT item_id, pattern, CAST(i AS BIGINT) AS pos, CAST(d AS BIGINT) AS dist FROM (SELECT item_id, pattern, i, len(list_filter(range(1, length(pattern) + 1), lambda j: substring(pattern, j, 1) <> substring(text, i + j, 1))) AS d
    FROM (SELECT item_id, text, pattern, unnest(range(0, greatest(length(text) - length(pattern) + 1, 0))) AS i FROM benchmark, (VALUES ('tion'), ('there')) p(pattern))) WHERE d <= 1"""
)
def hamming_search(spark, sf):
    return as_doc(approx.hamming_search(items(spark, sf), words(spark, ("tion", "there")), 1), "item_id")


@query(windows_sql(("tion", "there")) + "SELECT doc_id, pattern, pos, CAST(d AS BIGINT) AS dist FROM (SELECT *, len(list_filter(range(1, m + 1), lambda j: substring(pattern, j, 1) <> substring(win, j, 1))) AS d FROM w) WHERE d <= 1")
def hamming_documents(spark, sf):
    return as_doc(approx.hamming_search(documents(spark, sf), words(spark, ("tion", "there")), 1))


# DuckDB's distance counts bytes, so other characters are each written as one byte that no pattern has.
# Of every place of every document, the substrings of each length near the pattern's, cut from pieces.
NEAR_DOCUMENTS = """WITH t AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '~', 'g') AS text FROM documents),
h AS (SELECT doc_id, text, length(text) AS n, pattern, length(pattern) AS m, unnest(range(0, length(text), 256)) AS head FROM t, {patterns}),
p AS (SELECT doc_id, pattern, m, n, head, substring(text, head + 1, 256 + m + 1) AS piece FROM h),
i AS (SELECT *, unnest(range(0, least(256, n - head))) AS i FROM p),
k AS (SELECT *, unnest(range(greatest(1, m - 1), least(n - head - i, m + 1) + 1)) AS k FROM i),
c AS (SELECT doc_id, pattern, m, head + i AS pos, k AS len, levenshtein(pattern, substring(piece, i + 1, k)) AS dist FROM k)
"""
APPROX_DOCUMENTS = NEAR_DOCUMENTS.format(patterns=values(("tionth", "thereing"))) + "SELECT doc_id, pattern, CAST(pos + len - 1 AS BIGINT) AS end_pos, CAST(min(dist) AS BIGINT) AS dist FROM c GROUP BY doc_id, pattern, pos + len - 1 HAVING min(dist) <= 1"


@query(APPROX_DOCUMENTS)
def approx_documents(spark, sf):
    return as_doc(approx.edit_search(documents(spark, sf), words(spark, ("tionth", "thereing")), 1))


@query(APPROX_DOCUMENTS)
def bit_parallel_documents(spark, sf):
    return as_doc(approx.edit_search_bits(documents(spark, sf), words(spark, ("tionth", "thereing")), 1))


@query()
def edit_join_lines(spark, sf):
    """The different lines of all documents that are within two edits of each other."""
    lines = documents(spark, sf).select(F.explode(F.split("text", "\n")).alias("s"))
    return approx.within(lines.filter("s != ''"), 2)


CANDIDATES = """WITH RECURSIVE t AS (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g') AS text FROM benchmark),
c AS (SELECT item_id, pattern, length(pattern) AS m, i AS pos, k AS len, levenshtein(pattern, substring(text, i + 1, k)) AS dist FROM
  (SELECT *, unnest(range(greatest(1, length(pattern) - 1), least(length(text) - i, length(pattern) + 1) + 1)) AS k FROM
    (SELECT item_id, text, pattern, unnest(range(0, length(text))) AS i FROM t, (VALUES ('tion'), ('there')) p(pattern))))
"""


@query(
    CANDIDATES
    + """, best AS (SELECT item_id, pattern, m, pos, min(dist) AS dist FROM c GROUP BY ALL HAVING min(dist) <= 1),
    g AS (SELECT item_id, pattern, m, min(pos) AS pos FROM best GROUP BY item_id, pattern, m
      UNION ALL SELECT g.item_id, g.pattern, g.m, (SELECT min(b.pos) FROM best b WHERE b.item_id = g.item_id AND b.pattern = g.pattern AND b.pos >= g.pos + g.m) FROM g WHERE g.pos IS NOT NULL)
    SELECT g.item_id, g.pattern, CAST(g.pos AS BIGINT) AS pos, CAST(b.dist AS BIGINT) AS dist FROM g JOIN best b ON b.item_id = g.item_id AND b.pattern = g.pattern AND b.pos = g.pos"""
)
def edit_search_greedy(spark, sf):
    return as_doc(approx.edit_search_greedy(items(spark, sf), words(spark, ("tion", "there")), 1), "item_id")


@query(CANDIDATES + "SELECT item_id, pattern, CAST(pos AS BIGINT) AS pos, CAST(min(len) AS BIGINT) AS len, CAST(arg_min(dist, len) AS BIGINT) AS dist FROM c WHERE dist <= 1 GROUP BY item_id, pattern, pos")
def edit_search_first_length(spark, sf):
    return as_doc(approx.edit_search_first_length(items(spark, sf), words(spark, ("tion", "there")), 1), "item_id")


@query(CANDIDATES + "SELECT item_id, pattern, CAST(pos + len - 1 AS BIGINT) AS end_pos, CAST(min(dist) AS BIGINT) AS dist FROM c GROUP BY item_id, pattern, pos + len - 1 HAVING min(dist) <= 1")
def approx_search(spark, sf):
    return as_doc(approx.edit_search(items(spark, sf), words(spark, ("tion", "there")), 1), "item_id")


@query()
def levenshtein_banded_compat(spark, sf):
    return as_doc(approx.levenshtein_banded_compat(items(spark, sf), words(spark, ("tion", "there")), 1), "item_id")


@query()
def bitvector_score_compat(spark, sf):
    return as_doc(approx.bitvector_score_compat(items(spark, sf), words(spark, ("tion", "there")), 1), "item_id")


@query("SELECT a.n_name AS pattern, b.n_name AS text, levenshtein(a.n_name, b.n_name) AS edits, true AS whole FROM nation a, nation b")
def alignment_cost(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_name")
    out = approx.alignments(n.select(F.col("n_name").alias("pattern")).crossJoin(n.select(F.col("n_name").alias("text"))))
    whole = (F.regexp_replace("pattern_aligned", "-", "") == F.col("pattern")) & (F.regexp_replace("text_aligned", "-", "") == F.col("text"))
    return out.select("pattern", "text", F.size(F.filter("operations", lambda o: o != "match")).cast("long").alias("edits"), whole.alias("whole"))


@query()
def alignment(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_name")
    out = approx.alignments(n.select(F.col("n_name").alias("pattern")).crossJoin(n.select(F.col("n_name").alias("text"))))
    return out.withColumn("operations", F.array_join("operations", ","))


@query(
    """WITH subs AS (SELECT k, t2, t1, i, substring(t2, i, n) AS sub, n FROM (SELECT k, t1, t2, i, unnest(range(1, length(t2) - i + 2)) AS n FROM
      (SELECT a.n_nationkey AS k, r.r_name AS t1, a.n_name AS t2, unnest(range(1, length(a.n_name) + 1)) AS i FROM nation a JOIN region r ON a.n_regionkey = r.r_regionkey))),
    best AS (SELECT k, sub, n, row_number() OVER (PARTITION BY k ORDER BY n DESC, i) AS place FROM subs WHERE contains(t1, sub))
    SELECT a.n_nationkey, coalesce(b.sub, '') AS common, coalesce(b.n, 0) AS length FROM nation a LEFT JOIN best b ON b.k = a.n_nationkey AND b.place = 1"""
)
def longest_common_substring(spark, sf):
    n, r = spark.read.parquet(f"{sf}/nation.parquet"), spark.read.parquet(f"{sf}/region.parquet")
    left = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("text1"))
    return exact.longest_common_substring(left, n.select("n_nationkey", F.col("n_name").alias("text2")), ["n_nationkey"])


def neighbours(texts: DataFrame) -> DataFrame:
    """Longest common substring of each document and the one with the next larger id, whatever lies between; '' for the last.

    Ids are put in order by ranges; only they meet in a window.
    """
    following = report.next_of_each(texts.select("text_id"), "text_id")
    second = following.join(texts.select(F.col("text_id").alias("next"), F.col("text").alias("text2")), "next", "left").select("text_id", "text2")
    return exact.longest_common_substring(texts.select("text_id", F.col("text").alias("text1")), second, ["text_id"])


SAMPLE_AT = "1 + (doc_id * 7919) % greatest(length(text) - 19, 1)"
#: Occurrences of each pattern (pattern_id, pattern) of a table ``p``.
PLACES = """hits AS (SELECT doc_id, pattern_id, pattern, substring(text, instr(text, pattern) + 1) AS rest, CAST(instr(text, pattern) - 1 AS BIGINT) AS pos FROM documents, p WHERE pattern <> '' AND contains(text, pattern)
  UNION ALL SELECT doc_id, pattern_id, pattern, substring(rest, instr(rest, pattern) + 1), pos + instr(rest, pattern) FROM hits WHERE instr(rest, pattern) > 0)
"""


@query(f"WITH RECURSIVE p AS (SELECT doc_id AS pattern_id, substring(text, CAST({SAMPLE_AT} AS BIGINT), 20) AS pattern FROM documents), {PLACES} SELECT doc_id, pattern_id, pos FROM hits")
def multi_pattern_search(spark, sf):
    """A sample of 20 characters of every document, looked for in all documents in one pass."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    samples = d.select(F.col("doc_id").alias("pattern_id"), F.expr(f"substring(text, cast({SAMPLE_AT} AS int), 20)").alias("pattern"))
    return as_doc(multi.search(documents(spark, sf), samples))


@query(f"WITH RECURSIVE p AS (SELECT item_id AS pattern_id, text AS pattern FROM benchmark), {PLACES} SELECT p.pattern_id AS item_id, CAST(count(h.pos) AS BIGINT) AS n, CAST(count(DISTINCT h.doc_id) AS BIGINT) AS texts FROM p LEFT JOIN hits h ON h.pattern_id = p.pattern_id GROUP BY p.pattern_id")
def multi_pattern_totals(spark, sf):
    return multi.counts(documents(spark, sf), passages(spark, sf)).withColumnRenamed("pattern_id", "item_id")


@query(ALL_HITS)
def suffix_table_search(spark, sf):
    """A table of all suffixes is written, then the patterns' intervals of it are read."""
    at = folders.new_folder(spark, "suffixes")
    d = documents(spark, sf)
    # Few letters make a small table; places of longer patterns would be compared with the texts.
    suffixes.write_table(d, at, kept=8)
    return as_doc(suffixes.find(spark, at, words(spark), d, kept=8))


@query(
    """WITH s AS (SELECT item_id, text, i, unnest(range(0, length(text) - i + 1)) AS depth FROM (SELECT item_id, text, unnest(range(0, length(text))) AS i FROM benchmark)),
    g AS (SELECT item_id, depth, substring(text, i + 1, depth) AS w, min(i) AS start, count(*) AS leaves, count(DISTINCT substring(text, i + depth + 1, 1)) AS ways, max(substring(text, i + depth + 1, 1)) AS way FROM s GROUP BY ALL),
    n AS (SELECT *, depth = 0 OR ways > 1 AS branches FROM g WHERE depth = 0 OR ways > 1 OR way = '')
    SELECT n.item_id, n.start, n.depth, n.leaves, n.branches, (SELECT max(p.depth) FROM n p WHERE p.item_id = n.item_id AND p.branches AND p.depth < n.depth AND starts_with(n.w, p.w)) AS parent_depth, l.start AS link_start
    FROM n LEFT JOIN n l ON n.branches AND n.depth > 0 AND l.branches AND l.item_id = n.item_id AND l.w = substring(n.w, 2)"""
)
def suffix_tree_nodes(spark, sf):
    nodes = suffixes.suffix_tree(items(spark, sf))
    of = lambda key, value, name: nodes.select("text_id", F.col("node").alias(key), F.col(value).alias(name))
    both = nodes.join(of("parent", "depth", "parent_depth"), ["text_id", "parent"], "left").join(of("link", "start", "link_start"), ["text_id", "link"], "left")
    branches = F.col("link").isNotNull() | (F.col("depth") == 0)
    return both.select(F.col("text_id").alias("item_id"), "start", "depth", "leaves", branches.alias("branches"), "parent_depth", "link_start")


@query("SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS seq FROM documents")
def fasta_round_trip(spark, sf):
    """The letters of all documents, written as FASTA and read back in byte ranges."""
    at = folders.new_folder(spark, "fasta")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    writers.write_fasta(d.select(F.col("doc_id").cast("string").alias("header"), letters.alias("seq")), at)
    return fasta.records(spark, at, 1 << 20).select(F.col("header").cast("long").alias("doc_id"), "seq")


NEAR = ("tion", "there")
#: The queries over small tables again, over whole documents and without SQL; tests compare with brute force.
OVER_DOCUMENTS: dict[str, Callable[[SparkSession, DataFrame], DataFrame]] = {
    "naive_comparisons": lambda spark, t: exact.comparisons(t, words(spark)),
    "complexity_analysis": lambda spark, t: exact.complexity(t, words(spark)),
    "trace_naive": lambda spark, t: trace.naive(t, words(spark)),
    "trace_suffix": lambda spark, t: trace.suffix_trie(t, words(spark)),
    "trace_lev_cells": lambda spark, t: trace.levenshtein_cells(t, words(spark, NEAR), 1),
    "trace_kmp": lambda spark, t: trace.kmp(t, words(spark)).withColumn("failure_function", F.array_join("failure_function", ",")),
    "trace_bm": lambda spark, t: trace.boyer_moore(t, words(spark)),
    "trace_steps": lambda spark, t: payload.step_counts(t, words(spark, NEAR)),
    "rk_hash_stats": lambda spark, t: trace.rolling_hash(t, words(spark)),
    "rk_window_hash": lambda spark, t: index.window_hashes(t, 4),
    "suffix_table": lambda spark, t: exact.suffixes(t, 8),
    "suffix_counts": lambda spark, t: index.suffix_counts(t, 4),
    "trie_sizes": lambda spark, t: index.trie_sizes(t),
    "longest_common_substring": lambda spark, t: neighbours(t),
    "suffix_tree_sizes": lambda spark, t: suffixes.tree_sizes(t),
    "edit_search_greedy": lambda spark, t: approx.edit_search_greedy(t, words(spark, NEAR), 1),
    "edit_search_first_length": lambda spark, t: approx.edit_search_first_length(t, words(spark, NEAR), 1),
    "levenshtein_banded_compat": lambda spark, t: approx.levenshtein_banded_compat(t, words(spark, NEAR), 1),
    "bitvector_score_compat": lambda spark, t: approx.bitvector_score_compat(t, words(spark, NEAR), 1),
    "search_all_algorithms": lambda spark, t: registry.search(t, words(spark, NEAR)),
}
ORACLE_SQL["edit_search_first_length_documents"] = NEAR_DOCUMENTS.format(patterns=values(NEAR)) + "SELECT doc_id, pattern, CAST(pos AS BIGINT) AS pos, CAST(min(len) AS BIGINT) AS len, CAST(arg_min(dist, len) AS BIGINT) AS dist FROM c WHERE dist <= 1 GROUP BY doc_id, pattern, pos"
ORACLE_SQL["edit_search_greedy_documents"] = NEAR_DOCUMENTS.replace("WITH ", "WITH RECURSIVE ", 1).format(patterns=values(NEAR)) + """, best AS (SELECT doc_id, pattern, m, pos, min(dist) AS dist FROM c GROUP BY ALL HAVING min(dist) <= 1),
  g AS (SELECT doc_id, pattern, m, min(pos) AS pos FROM best GROUP BY doc_id, pattern, m
    UNION ALL SELECT g.doc_id, g.pattern, g.m, (SELECT min(b.pos) FROM best b WHERE b.doc_id = g.doc_id AND b.pattern = g.pattern AND b.pos >= g.pos + g.m) FROM g WHERE g.pos IS NOT NULL)
  SELECT g.doc_id, g.pattern, CAST(g.pos AS BIGINT) AS pos, CAST(b.dist AS BIGINT) AS dist FROM g JOIN best b ON b.doc_id = g.doc_id AND b.pattern = g.pattern AND b.pos = g.pos"""
ORACLE_SQL["rk_window_hash_documents"] = f"""WITH pieces AS (SELECT doc_id, head, substring(text, head + 1, 259) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 256)) AS head FROM documents))
  SELECT doc_id, CAST(head + i AS BIGINT) AS pos, CAST({HASH4} AS BIGINT) AS hash FROM (SELECT *, unnest(range(0, least(256, greatest(length(text) - 3, 0)))) AS i FROM pieces)"""
ORACLE_SQL["suffix_table_documents"] = "SELECT doc_id, CAST(head + i AS BIGINT) AS pos, substring(piece, i + 1, 8) AS suffix FROM (SELECT *, unnest(range(0, least(256, length(piece)))) AS i FROM (SELECT doc_id, head, substring(text, head + 1, 263) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 256)) AS head FROM documents)))"
ORACLE_SQL["suffix_counts_documents"] = "SELECT suffix, count(*) AS n FROM (SELECT substring(piece, i + 1, 4) AS suffix FROM (SELECT *, unnest(range(0, least(256, length(piece)))) AS i FROM (SELECT substring(text, head + 1, 259) AS piece FROM (SELECT text, unnest(range(0, length(text), 256)) AS head FROM documents)))) GROUP BY suffix"
# Comparisons of every window: those up to the first that fails, or all.
COMPARED = windows_sql(SHORT) + ", l AS (SELECT doc_id, pattern, m, CASE WHEN win = pattern THEN m WHEN m > 2 AND substring(win, 1, 2) = substring(pattern, 1, 2) THEN 2 WHEN substring(win, 1, 1) = substring(pattern, 1, 1) THEN 1 ELSE 0 END AS same FROM w), q AS (SELECT doc_id, pattern, m, sum(least(same + 1, m)) AS comparisons, sum((same = m)::INT) AS matches, count(*) AS positions FROM l GROUP BY ALL)\n"
OF_ALL = f"FROM documents d CROSS JOIN {values()} LEFT JOIN q ON q.doc_id = d.doc_id AND q.pattern = p.pattern"
ORACLE_SQL["naive_comparisons_documents"] = COMPARED + f"SELECT d.doc_id, p.pattern, CAST(coalesce(comparisons, 0) AS BIGINT) AS comparisons, CAST(coalesce(matches, 0) AS BIGINT) AS matches, CAST(coalesce(positions, 0) AS BIGINT) AS positions {OF_ALL}"
WORST = "greatest(length(d.text) - length(p.pattern) + 1, 0) * length(p.pattern)"
ORACLE_SQL["complexity_analysis_documents"] = COMPARED + f"SELECT d.doc_id, p.pattern, length(d.text) AS n, length(p.pattern) AS m, CAST(coalesce(matches, 0) AS BIGINT) AS matches, CAST(coalesce(comparisons, 0) AS BIGINT) AS comparisons, {WORST} AS worst, round(100 * coalesce(comparisons, 0) / nullif({WORST}, 0), 6) AS efficiency {OF_ALL}"
for _name, _build in OVER_DOCUMENTS.items():
    QUERIES[f"{_name}_documents"] = lambda spark, sf, build=_build: as_doc(build(spark, documents(spark, sf)))


def passages(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination_join(spark, sf):
    return exact.holding(documents(spark, sf), passages(spark, sf)).select(F.col("text_id").alias("doc_id"), F.col("pattern_id").alias("item_id"))


@query("SELECT item_id FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def patterns_present_semi(spark, sf):
    return exact.present(documents(spark, sf), passages(spark, sf)).withColumnRenamed("pattern_id", "item_id")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def patterns_absent_anti(spark, sf):
    return exact.absent(documents(spark, sf), passages(spark, sf)).withColumnRenamed("pattern_id", "item_id")


@query("SELECT item_id, pattern, CASE WHEN known = m THEN m ELSE known + 1 END AS nodes_visited, known = m AS pattern_found, CAST(CASE WHEN known = m THEN hits ELSE 0 END AS BIGINT) AS matches_found FROM (SELECT item_id, pattern, length(pattern) AS m, CAST(len(list_filter(range(1, length(pattern) + 1), lambda k: contains(text, substring(pattern, 1, k)))) AS BIGINT) AS known, len(list_filter(range(0, greatest(length(text) - length(pattern) + 1, 0)), lambda i: substring(text, i + 1, length(pattern)) = pattern)) AS hits FROM benchmark, " + values() + ")")
def trace_suffix(spark, sf):
    return as_doc(trace.suffix_trie(items(spark, sf), words(spark)), "item_id")


@query(f"SELECT doc_id, pattern, length(text) * 4 AS total_shifts, length(text) * 2 AS total_or_operations, length(text) - length(pattern) + 1 AS matches_found FROM documents, {values()} WHERE length(text) >= length(pattern)")
def trace_shiftor_counters(spark, sf):
    return as_doc(trace.shift_or_counters(documents(spark, sf), words(spark), 1))


@query(
    CANDIDATES
    + """, f AS (SELECT item_id, pattern, m, pos, min(CASE WHEN dist <= 1 THEN len END) AS stop FROM c GROUP BY ALL),
    s AS (SELECT f.item_id, f.pattern, f.m, f.pos, f.stop, sum(c.len * f.m) FILTER (WHERE f.stop IS NULL OR c.len <= f.stop) AS cells FROM f JOIN c ON c.item_id = f.item_id AND c.pattern = f.pattern AND c.pos = f.pos GROUP BY ALL)
    SELECT s.item_id, s.pattern, CAST(sum(cells) AS BIGINT) AS total_cells_computed, count(*) AS positions_checked, CAST(sum(CASE WHEN stop IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS matches_found
    FROM s JOIN t ON t.item_id = s.item_id WHERE s.pos < length(t.text) - s.m + 2 GROUP BY s.item_id, s.pattern"""
)
def trace_lev_cells(spark, sf):
    return as_doc(trace.levenshtein_cells(items(spark, sf), words(spark, ("tion", "there")), 1), "item_id")


# Prefixes of the pattern (by length) that end at each character; a fall passes one that ended before and does not go on.
@query(
    f"""WITH c AS (SELECT item_id, text, pattern, length(pattern) AS m, length(text) AS n, unnest(range(1, length(text) + 1)) AS i FROM benchmark, {values(REPEATED)} WHERE length(text) >= length(pattern)),
    e AS (SELECT *, list_filter(range(1, m + 1), lambda k: k <= i AND substring(text, CAST(i - k + 1 AS INT), CAST(k AS INT)) = substring(pattern, 1, CAST(k AS INT))) AS now,
      list_filter(range(1, m), lambda k: k < i AND substring(text, CAST(i - k AS INT), CAST(k AS INT)) = substring(pattern, 1, CAST(k AS INT))) AS before FROM c),
    f AS (SELECT item_id, pattern, m, n, coalesce(list_max(now), 0) AS state, before FROM e),
    g AS (SELECT item_id, pattern, n, state = m AS hit, state > 0 AS same, len(list_filter(before, lambda k: k > greatest(state - 1, 0))) AS falls FROM f)
    SELECT item_id, pattern, n AS total_comparisons, CAST(sum(same::INT) AS BIGINT) AS successful_comparisons, CAST(n - sum(same::INT) AS BIGINT) AS failed_comparisons, CAST(sum(falls) AS BIGINT) AS backtrack_count,
      CAST(sum(hit::INT) AS BIGINT) AS matches_found FROM g GROUP BY item_id, pattern, n"""
)
def trace_kmp(spark, sf):
    return as_doc(trace.kmp(items(spark, sf), words(spark, REPEATED)).drop("efficiency", "failure_function"), "item_id")


LAST = "CASE WHEN contains(pattern, {c}) THEN m - strpos(reverse(pattern), {c}) ELSE -1 END"


@query(
    f"""WITH RECURSIVE c AS (SELECT item_id, text, pattern, length(pattern) AS m, length(text) AS n FROM benchmark, {values(REPEATED)} WHERE length(text) >= length(pattern)),
    p AS (SELECT *, unnest(range(0, n - m + 1)) AS spot FROM c),
    q AS (SELECT *, coalesce(list_min(list_filter(range(0, m), lambda r: substring(pattern, CAST(m - r AS INT), 1) <> substring(text, CAST(spot + m - r AS INT), 1))), m) AS same FROM p),
    s AS (SELECT item_id, pattern, m, n, spot, same, CASE WHEN same = m THEN CASE WHEN spot + m < n THEN m - 1 - ({LAST.format(c="substring(text, CAST(spot + m + 1 AS INT), 1)")}) ELSE 1 END
      ELSE greatest(1, m - 1 - same - ({LAST.format(c="substring(text, CAST(spot + m - same AS INT), 1)")})) END AS shift FROM q),
    walk AS (SELECT * FROM s WHERE spot = 0 UNION ALL SELECT s.* FROM walk JOIN s ON s.item_id = walk.item_id AND s.pattern = walk.pattern AND s.spot = walk.spot + greatest(1, walk.shift))
    SELECT item_id, pattern, CAST(sum(same + (same < m)::INT) AS BIGINT) AS total_comparisons, CAST(sum(same) AS BIGINT) AS successful_comparisons, CAST(sum((same < m)::INT) AS BIGINT) AS failed_comparisons,
      count(*) AS alignments_checked, CAST(sum(shift) AS BIGINT) AS total_shifts, CAST(sum(shift) - count(*) AS BIGINT) AS characters_skipped, CAST(sum((same = m)::INT) AS BIGINT) AS matches_found FROM walk GROUP BY item_id, pattern"""
)
def trace_bm(spark, sf):
    return as_doc(trace.boyer_moore(items(spark, sf), words(spark, REPEATED)).drop("skip_efficiency"), "item_id")


@query()
def trace_steps(spark, sf):
    return as_doc(payload.all_steps(items(spark, sf), words(spark, NEAR)), "item_id")


for _name in payload.STEPPERS:
    QUERIES[f"steps_{_name}"] = lambda spark, sf, name=_name: as_doc(payload.steps(items(spark, sf), words(spark, NEAR), name), "item_id")


# Benchmark rows without clocks: language and source stand for category and algorithm, lengths for times.
RUNS = """WITH runs AS (SELECT CAST(doc_id AS VARCHAR) AS pattern_name, lang AS category, source AS algorithm, CAST(n_chars AS INT) AS pattern_length, CAST((doc_id % 7) * 0.5 AS DOUBLE) AS preprocessing_ms,
  n_chars / 8.0 AS search_ms, n_chars / 4.0 AS memory_kb, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS matches_count FROM documents)
"""
BUCKET = "CASE WHEN pattern_length <= 10 THEN 'small' WHEN pattern_length <= 50 THEN 'medium' WHEN pattern_length <= 200 THEN 'large' ELSE 'vlarge' END"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select(
        F.col("doc_id").cast("string").alias("pattern_name"), F.col("lang").alias("category"), F.col("source").alias("algorithm"), F.col("n_chars").cast("int").alias("pattern_length"), ((F.col("doc_id") % 7) * 0.5).alias("preprocessing_ms"),
        (F.col("n_chars") / 8.0).alias("search_ms"), (F.col("n_chars") / 4.0).alias("memory_kb"), (F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).cast("long").alias("matches_count"),
    )


@query(RUNS + f"SELECT {BUCKET} AS bucket, min(pattern_length) AS shortest, max(pattern_length) AS longest, count(*) AS runs, round(avg(search_ms), 6) AS mean_ms, CAST(list_position(['small', 'medium', 'large', 'vlarge'], {BUCKET}) AS BIGINT) AS place FROM runs GROUP BY {BUCKET}")
def size_buckets(spark, sf):
    return report.by_bucket(runs(spark, sf))


@query(RUNS + "SELECT algorithm, round(avg(search_ms), 6) AS mean_ms, round(median(search_ms), 6) AS median_ms, round(stddev_samp(search_ms), 6) AS std_ms, round(min(search_ms), 6) AS min_ms, round(max(search_ms), 6) AS max_ms, round(avg(preprocessing_ms), 6) AS mean_pre, round(avg(memory_kb), 6) AS mean_kb, count(*) AS runs, round(median(search_ms) * count(*) + avg(preprocessing_ms), 6) AS total_ms FROM runs GROUP BY algorithm")
def algo_summary(spark, sf):
    return report.by_algorithm(runs(spark, sf))


@query(RUNS + "SELECT category, algorithm, round(avg(search_ms), 6) AS mean_ms, round(stddev_samp(search_ms), 6) AS std_ms, round(avg(preprocessing_ms), 6) AS mean_pre, round(avg(memory_kb), 6) AS mean_kb, count(*) AS runs, round(avg(search_ms) * count(*) + avg(preprocessing_ms), 6) AS total_ms FROM runs GROUP BY category, algorithm")
def category_summary(spark, sf):
    return report.by_category(runs(spark, sf))


@query(
    RUNS
    + """, s AS (SELECT r.category, r.pattern_name, r.algorithm, coalesce(b.search_ms / nullif(r.search_ms, 0), 1.0) AS speedup FROM runs r LEFT JOIN runs b ON b.algorithm = 'src0' AND b.category = r.category AND b.pattern_name = r.pattern_name)
    SELECT category, pattern_name, algorithm, round(speedup, 6) AS speedup, CASE WHEN speedup >= 2 THEN 'much faster' WHEN speedup >= 1 THEN 'faster' WHEN speedup >= 0.5 THEN 'slower' WHEN speedup >= 0.1 THEN 'much slower' ELSE 'far slower' END AS band FROM s"""
)
def speedup_vs_baseline(spark, sf):
    return report.speedup(runs(spark, sf), "src0")


@query(RUNS + ", a AS (SELECT DISTINCT algorithm FROM runs), c AS (SELECT DISTINCT category FROM runs) SELECT c.category, a.algorithm, round(coalesce(avg(r.search_ms), 0.0), 6) AS mean_ms FROM c CROSS JOIN a LEFT JOIN runs r ON r.category = c.category AND r.algorithm = a.algorithm GROUP BY c.category, a.algorithm")
def category_pivot(spark, sf):
    return report.every_pair(runs(spark, sf), ["category"], F.avg("search_ms"), "mean_ms")


@query(RUNS + "SELECT pattern_length, algorithm, round(search_ms, 6) AS search_ms FROM runs")
def length_scatter(spark, sf):
    return report.scatter(runs(spark, sf))


@query(RUNS + "SELECT algorithm, round(avg(preprocessing_ms), 6) AS mean_pre, round(avg(search_ms), 6) AS mean_ms, count(*) AS runs FROM runs WHERE preprocessing_ms > 0 GROUP BY algorithm")
def preprocessing_against_search(spark, sf):
    return report.preprocessing(runs(spark, sf))


@query(RUNS + f"SELECT {BUCKET} AS bucket, algorithm, round(avg(search_ms), 6) AS mean_ms FROM runs GROUP BY {BUCKET}, algorithm")
def bucket_by_algorithm(spark, sf):
    return report.bucket_by_algorithm(runs(spark, sf))


@query(RUNS + ", a AS (SELECT DISTINCT algorithm FROM runs), p AS (SELECT DISTINCT category, pattern_name FROM runs) SELECT p.category, p.pattern_name, a.algorithm, round(coalesce(min(r.search_ms), 0.0), 6) AS search_ms FROM p CROSS JOIN a LEFT JOIN runs r ON r.category = p.category AND r.pattern_name = p.pattern_name AND r.algorithm = a.algorithm GROUP BY p.category, p.pattern_name, a.algorithm")
def category_patterns(spark, sf):
    return report.every_pair(runs(spark, sf), ["category", "pattern_name"], F.min("search_ms"), "search_ms")


@query(RUNS + f"SELECT category, {BUCKET} AS bucket, algorithm, round(log10(avg(search_ms) + 1), 6) AS log_ms FROM runs GROUP BY category, {BUCKET}, algorithm")
def log_by_bucket(spark, sf):
    return report.log_by_bucket(runs(spark, sf))


@query(
    RUNS
    + """, long AS (SELECT algorithm, 'search_ms' AS measure, search_ms AS value FROM runs UNION ALL SELECT algorithm, 'preprocessing_ms', preprocessing_ms FROM runs UNION ALL SELECT algorithm, 'memory_kb', memory_kb FROM runs)
    SELECT algorithm, measure, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std FROM long GROUP BY algorithm, measure"""
)
def unpivot_summary(spark, sf):
    return report.unpivoted(runs(spark, sf))


@query(
    RUNS
    + """, a AS (SELECT algorithm, round(avg(search_ms), 6) AS t, round(avg(memory_kb), 6) AS m FROM runs GROUP BY algorithm)
    SELECT (SELECT algorithm FROM a ORDER BY t, algorithm LIMIT 1) AS fastest, (SELECT min(t) FROM a) AS fastest_ms, (SELECT algorithm FROM a ORDER BY m, algorithm LIMIT 1) AS leanest, (SELECT min(m) FROM a) AS leanest_kb"""
)
def fastest_argmin(spark, sf):
    return report.best(runs(spark, sf))


@query(RUNS + "SELECT algorithm, round(min(memory_kb), 6) AS low, round(quantile_cont(memory_kb, 0.25), 6) AS q1, round(quantile_cont(memory_kb, 0.5), 6) AS q2, round(quantile_cont(memory_kb, 0.75), 6) AS q3, round(max(memory_kb), 6) AS high FROM runs GROUP BY algorithm")
def memory_quartiles(spark, sf):
    return report.memory_quartiles(runs(spark, sf))


@query(RUNS + "SELECT category, pattern_name, row_number() OVER (PARTITION BY category ORDER BY pattern_name) - 1 AS place FROM (SELECT DISTINCT category, pattern_name FROM runs)")
def pattern_rank(spark, sf):
    return report.pattern_places(runs(spark, sf))


@query(RUNS + "SELECT count(DISTINCT pattern_name) AS patterns, count(DISTINCT category) AS categories, count(DISTINCT algorithm) AS algorithms, count(*) AS runs, CAST(sum(matches_count) AS BIGINT) AS matches FROM runs")
def report_totals(spark, sf):
    return report.totals(runs(spark, sf))


@query(RUNS + ", a AS (SELECT algorithm, avg(search_ms) AS t FROM runs GROUP BY algorithm) SELECT a.algorithm, round(a.t, 6) AS mean_ms, round(a.t / b.t, 6) AS ratio FROM a, a b WHERE b.algorithm = 'src0'")
def ratio_of_means(spark, sf):
    return report.ratio_of_means(runs(spark, sf), "src0")


@query(RUNS + "SELECT * FROM runs WHERE NOT (algorithm = 'naive' AND pattern_length > 100) AND NOT (algorithm = 'src1' AND category = 'en')")
def skip_policy(spark, sf):
    r = report.kept_runs(runs(spark, sf))
    return r.filter(~((F.col("algorithm") == "src1") & (F.col("category") == "en")))


#: A benchmark's runs made of the documents: five algorithms a document, some times 0, the baseline and other runs missing here and there.
ALGORITHMS = ("naive", "kmp", "boyer_moore", "suffix_tree", "regex")
BENCH = f"""WITH runs AS (SELECT CAST(doc_id AS VARCHAR) AS pattern_name, lang AS category, algorithm, CAST(n_chars AS INT) AS pattern_length, CAST(k * 0.5 AS DOUBLE) AS preprocessing_ms,
  CAST(((doc_id * 31 + k * 17) % 97) * (1 + (doc_id + k) % 13) * 0.25 AS DOUBLE) AS search_ms, n_chars / 4.0 + k AS memory_kb, CAST(doc_id % 5 AS BIGINT) AS matches_count
  FROM documents, (VALUES {", ".join(f"('{a}', {k})" for k, a in enumerate(ALGORITHMS))}) a(algorithm, k) WHERE NOT (algorithm = 'regex' AND doc_id % 7 = 3) AND NOT (algorithm = 'kmp' AND lang = 'fr'))
"""
BANDS = "CASE WHEN {s} >= 2 THEN 'much faster' WHEN {s} >= 1 THEN 'faster' WHEN {s} >= 0.5 THEN 'slower' WHEN {s} >= 0.1 THEN 'much slower' ELSE 'far slower' END"


def bench_runs(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a = F.explode(F.array(*[F.struct(F.lit(n).alias("algorithm"), F.lit(k).alias("k")) for k, n in enumerate(ALGORITHMS)]))
    rows = d.select("doc_id", "lang", "n_chars", a.alias("a")).select("doc_id", "lang", "n_chars", "a.algorithm", "a.k")
    rows = rows.filter(~((F.col("algorithm") == "regex") & (F.col("doc_id") % 7 == 3)) & ~((F.col("algorithm") == "kmp") & (F.col("lang") == "fr")))
    i, k = F.col("doc_id"), F.col("k")
    return rows.select(
        i.cast("string").alias("pattern_name"), F.col("lang").alias("category"), "algorithm", F.col("n_chars").cast("int").alias("pattern_length"), (k * 0.5).alias("preprocessing_ms"),
        (((i * 31 + k * 17) % 97) * (1 + (i + k) % 13) * 0.25).alias("search_ms"), (F.col("n_chars") / 4.0 + k).alias("memory_kb"), (i % 5).alias("matches_count"),
    )


@query(
    BENCH
    + f""", b AS (SELECT category, pattern_name, max(search_ms + preprocessing_ms) AS base_ms FROM runs WHERE algorithm = 'regex' GROUP BY ALL),
    s AS (SELECT r.*, b.base_ms, r.search_ms + r.preprocessing_ms AS total, CASE WHEN algorithm = 'regex' THEN 1.0 WHEN r.search_ms + r.preprocessing_ms > 0 THEN coalesce(base_ms, 1.0) / (r.search_ms + r.preprocessing_ms) ELSE 0.0 END AS s FROM runs r LEFT JOIN b ON b.category = r.category AND b.pattern_name = r.pattern_name)
    SELECT category, pattern_name, algorithm, round(total, 6) AS total_ms, base_ms IS NOT NULL AS has_baseline, round(CAST(s AS DOUBLE), 6) AS speedup, {BANDS.format(s="s")} AS band FROM s"""
)
def speedup_rows(spark, sf):
    return report.speedup_rows(bench_runs(spark, sf), "regex")


WORDS = "CASE WHEN {s} >= 1 THEN printf('%.4fx faster', {s}) WHEN {s} > 0 THEN printf('%.4fx slower', 1 / {s}) END"


@query(
    BENCH
    + f""", a AS (SELECT algorithm, count(*) AS runs, median(search_ms) * count(*) + avg(preprocessing_ms) AS t, avg(search_ms) AS m FROM runs GROUP BY algorithm),
    s AS (SELECT a.*, CASE WHEN a.t > 0 THEN b.t / a.t ELSE 0 END AS x, CASE WHEN a.m > 0 THEN b.m / a.m ELSE 0 END AS y FROM a, a b WHERE b.algorithm = 'regex')
    SELECT algorithm, runs, round(t, 6) AS total_ms, round(x, 6) AS total_speedup, {WORDS.format(s="x")} AS total_words, {BANDS.format(s="x")} AS total_band,
      round(m, 6) AS run_ms, round(y, 6) AS run_speedup, {WORDS.format(s="y")} AS run_words, {BANDS.format(s="y")} AS run_band FROM s"""
)
def speedup_by_algorithm(spark, sf):
    return report.speedup_by_algorithm(bench_runs(spark, sf), "regex")


@query(BENCH + "SELECT * FROM runs WHERE NOT (algorithm = 'naive' AND (pattern_length > 100 OR category = 'de')) AND NOT (algorithm = 'suffix_tree' AND pattern_length > 1000)")
def skip_policy_runs(spark, sf):
    return report.kept_runs(bench_runs(spark, sf), skip={"naive": ["de"]})


@query(BENCH + ", a AS (SELECT DISTINCT algorithm FROM runs), c AS (SELECT DISTINCT category FROM runs) SELECT c.category, a.algorithm, round(coalesce(avg(r.search_ms), 0.0), 6) AS mean_ms FROM c CROSS JOIN a LEFT JOIN runs r ON r.category = c.category AND r.algorithm = a.algorithm GROUP BY c.category, a.algorithm")
def category_pivot_runs(spark, sf):
    return report.every_pair(bench_runs(spark, sf), ["category"], F.avg("search_ms"), "mean_ms")


@query(
    BENCH
    + """SELECT category, pattern_name, CASE WHEN length(pattern_name) > 20 THEN substring(pattern_name, 1, 17) || '...' ELSE pattern_name END AS shown, CAST(row_number() OVER (PARTITION BY category, pattern_name ORDER BY search_ms, algorithm) AS INT) AS place,
    algorithm, round(search_ms, 6) AS search_ms, matches_count, round(memory_kb, 6) AS memory_kb FROM runs"""
)
def ordered_listing(spark, sf):
    return report.ordered_listing(bench_runs(spark, sf))


@query(BENCH + "SELECT DISTINCT name, value FROM (SELECT 'category' AS name, category AS value FROM runs UNION ALL SELECT 'algorithm', algorithm FROM runs UNION ALL SELECT 'pattern_length', CAST(pattern_length AS VARCHAR) FROM runs) WHERE value IS NOT NULL")
def distinct_values(spark, sf):
    return report.values_of(bench_runs(spark, sf), "category", "algorithm", "pattern_length")


@query(BENCH + "SELECT CAST(row_number() OVER (ORDER BY mean_ms, algorithm) AS INT) AS place, algorithm, mean_ms FROM (SELECT algorithm, round(avg(search_ms), 6) AS mean_ms FROM runs GROUP BY algorithm)")
def order_by_mean(spark, sf):
    return report.by_mean(bench_runs(spark, sf))


@query(BENCH + "SELECT category, pattern_name FROM (SELECT category, pattern_name, row_number() OVER (PARTITION BY category ORDER BY pattern_name) AS k FROM (SELECT DISTINCT category, pattern_name FROM runs)) WHERE k <= 3")
def patterns_limit(spark, sf):
    """The first three patterns of each category, by name."""
    return exact.first_of_each(bench_runs(spark, sf).select("category", "pattern_name").distinct(), "category", "pattern_name", 3)


@query(HITS + "SELECT doc_id, pattern, CAST(count(*) AS BIGINT) AS n, array_to_string(list(pos ORDER BY pos)[1:10], ',') AS places FROM hits GROUP BY doc_id, pattern")
def first_places(spark, sf):
    return as_doc(exact.first_places(exact.by_find(documents(spark, sf), words(spark)))).withColumn("places", F.array_join(F.col("places").cast("array<string>"), ","))


@query(HITS + f"SELECT d.doc_id, p.pattern, CAST(count(h.pos) AS BIGINT) AS whole, CAST(count(h.pos) AS BIGINT) AS pieces, true AS results_match FROM documents d CROSS JOIN {values()} LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.pattern = p.pattern GROUP BY d.doc_id, p.pattern")
def pieces_against_whole(spark, sf):
    return as_doc(exact.in_pieces_and_whole(documents(spark, sf), words(spark), 500))


@query(ALL_HITS)
def search_function(spark, sf):
    """The search as a table function of SQL."""
    tables.register(spark)
    view = f"documents_{uuid.uuid4().hex}"
    documents(spark, sf).createOrReplaceTempView(view)
    return as_doc(spark.sql(f"SELECT text_id, pattern, pos FROM search(TABLE(SELECT text_id, text FROM {view}), array{SHORT}, 'rabin_karp')"))


@query(RUNS + "SELECT pattern_name, algorithm, greatest(0, search_ms) + preprocessing_ms AS total_ms, round(500000 / nullif(search_ms, 0), 4) AS throughput FROM runs")
def throughput(spark, sf):
    return report.with_throughput(runs(spark, sf), 500_000).select("pattern_name", "algorithm", "total_ms", "throughput")


@query("SELECT CASE WHEN length(text) > 20 THEN substring(text, 1, 17) || '...' ELSE text END AS shown, lang AS category, source AS algorithm, round(n_chars / 8.0, 6) AS search_ms FROM documents")
def report_listing(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return report.listing(d.select(F.col("text").alias("pattern_name"), F.col("lang").alias("category"), F.col("source").alias("algorithm"), (F.col("n_chars") / 8.0).alias("search_ms")))


APPROX = """WITH r AS (SELECT 'dna|' || lang || '|len' || CAST(doc_id % 3 AS VARCHAR) || '|i0' AS header, CAST(doc_id % 3 AS INT) AS seq_len, CAST(doc_id % 2 AS INT) AS query_len, CAST(doc_id % 6 AS INT) AS edits,
  n_chars / 64.0 AS re_time, n_chars / 16.0 AS re_mem, (n_chars + doc_id % 11) / 8.0 AS shiftor_time, n_chars / 16.0 AS shiftor_mem, (n_chars + doc_id % 5) / 2.0 AS levenshtein_time, n_chars / 8.0 AS levenshtein_mem FROM documents)
"""
APPROX_SUMMARY = APPROX + """, s AS (SELECT string_split(header, '|')[2] AS sequence_type, seq_len AS sequence_length, avg(re_time) AS a, avg(re_mem) AS b, avg(shiftor_time) AS c, avg(shiftor_mem) AS d, avg(levenshtein_time) AS e, avg(levenshtein_mem) AS f FROM r GROUP BY ALL),
z AS (SELECT sequence_type, sequence_length, round(a, 6) AS re_avg_time, round(b, 6) AS re_avg_mem, round(c, 6) AS shiftor_avg_time, round(d, 6) AS shiftor_avg_mem, round(e, 6) AS levenshtein_avg_time, round(f, 6) AS levenshtein_avg_mem,
round(c / a, 6) AS shiftor_vs_regex, round(e / a, 6) AS levenshtein_vs_regex FROM s)
"""


def approx_rows(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    i, n = F.col("doc_id"), F.col("n_chars")
    return d.select(
        F.format_string("dna|%s|len%d|i0", "lang", i % 3).alias("header"), (i % 3).cast("int").alias("seq_len"), (i % 2).cast("int").alias("query_len"), (i % 6).cast("int").alias("edits"), (n / 64.0).alias("re_time"), (n / 16.0).alias("re_mem"),
        ((n + i % 11) / 8.0).alias("shiftor_time"), (n / 16.0).alias("shiftor_mem"), ((n + i % 5) / 2.0).alias("levenshtein_time"), (n / 8.0).alias("levenshtein_mem"),
    )


@query(APPROX_SUMMARY + "SELECT * FROM z")
def approx_summary(spark, sf):
    return report.approx_summary(approx_rows(spark, sf))


@query(APPROX_SUMMARY + "SELECT round(avg(shiftor_vs_regex), 6) AS shiftor_vs_regex, round(avg(levenshtein_vs_regex), 6) AS levenshtein_vs_regex, round(avg(levenshtein_vs_regex) / avg(shiftor_vs_regex), 6) AS quotient FROM z")
def mean_of_ratios(spark, sf):
    return report.mean_of_ratios(report.approx_summary(approx_rows(spark, sf)))


@query(APPROX + "SELECT edits, seq_len, round(avg(re_time), 6) AS re_time, round(avg(shiftor_time), 6) AS shiftor_time, round(avg(levenshtein_time), 6) AS levenshtein_time FROM r GROUP BY edits, seq_len")
def means_by_edits(spark, sf):
    return report.means_by(approx_rows(spark, sf), "edits", "seq_len")


@query(APPROX + "SELECT query_len, round(avg(re_time), 6) AS re_time, round(avg(shiftor_time), 6) AS shiftor_time, round(avg(levenshtein_time), 6) AS levenshtein_time FROM r GROUP BY query_len")
def means_by_query_length(spark, sf):
    return report.means_by(approx_rows(spark, sf), "query_len")


@query("SELECT spec, unnest(lens) AS len FROM (VALUES ('100', [100]), ('5-9:2', [5, 7, 9]), ('20-30', [20, 30]), ('3,1,2-2,1-4:1', [1, 2, 3, 4])) v(spec, lens)")
def parse_lengths(spark, sf):
    specs = spark.createDataFrame([("100",), ("5-9:2",), ("20-30",), ("3,1,2-2,1-4:1",)], "spec string")
    return specs.select("spec", F.explode(datagen.parse_lengths(F.col("spec"))).alias("len"))


@query("SELECT type, len, CAST(inst AS INT) AS inst, 'dna|' || type || '|len' || len || '|i' || inst AS header FROM (VALUES ('random'), ('high_gc'), ('repetitive'), ('low_complexity'), ('mutated')) t(type), (VALUES (100), (500)) l(len), (SELECT unnest(range(0, 3)) AS inst)")
def dataset_grid(spark, sf):
    return datagen.sequence_grid(spark, list(datagen.KINDS), [100, 500], 3)


@query("SELECT 'rep_' || CASE motif WHEN 'A' THEN 'allA' ELSE motif END || '_' || n AS name, substring(repeat(motif, n), 1, n) AS pattern FROM (VALUES ('A'), ('AC'), ('AT')) m(motif), (VALUES (20), (50), (100)) l(n)")
def repetitive_sequences(spark, sf):
    return datagen.repetitive_patterns(spark)


@query()
def generated_sequences(spark, sf):
    return datagen.sequences(datagen.sequence_grid(spark, list(datagen.KINDS), [100, 500], 3))


@query()
def generated_corpus(spark, sf):
    genome = datagen.planted_text(spark, 20_000, "ACGTTGCAACGT", 200, 5)
    return datagen.pattern_corpus(genome)


@query()
def sampled_queries(spark, sf):
    s = datagen.samples(items(spark, sf), [20, 50], 3)
    return s.select("text_id", "length", "turn", "start", "query", datagen.with_substitutions(F.col("query"), F.concat_ws(":", "text_id", "length", "turn"), 3, 2).alias("changed"))


@query("SELECT algorithm, CAST(size AS BIGINT) AS size, CAST(CASE WHEN algorithm = 'levenshtein' THEN size // 8 ELSE size // 4 - 1 END AS BIGINT) AS matches FROM (VALUES ('naive'), ('kmp'), ('boyer_moore'), ('suffix_tree'), ('levenshtein'), ('shift_or'), ('rabin_karp')) a(algorithm), (VALUES (100), (1000), (10000)) s(size)")
def api_benchmark_counts(spark, sf):
    return registry.benchmark_counts(spark)


@query("SELECT key, pattern, CAST(i AS BIGINT) AS pos FROM (SELECT *, unnest(range(0, length(text) - length(pattern) + 1)) AS i FROM (VALUES " + ", ".join(f"('{k}', '{t}', '{p}')" for k, _, t, p in registry.SAMPLES) + ") s(key, text, pattern)) WHERE substring(text, i + 1, length(pattern)) = pattern")
def sample_searches(spark, sf):
    s = registry.samples(spark)
    hits = exact.by_split(s.select(F.col("key").alias("text_id"), "text"), s.select("pattern"))
    return hits.withColumnRenamed("text_id", "key").join(s.select("key", "pattern"), ["key", "pattern"])


@query()
def search_results(spark, sf):
    return measure.results(items(spark, sf), words(spark, NEAR), [*registry.ALL, "no_such_algorithm"]).drop("seconds", "milliseconds")


@query()
def edit_grid(spark, sf):
    return measure.edit_grid(spark, ["random", "repetitive"], [100, 500], (20, 50), 2, (0, 2))


@query()
def search_all_algorithms(spark, sf):
    return as_doc(registry.search(items(spark, sf), words(spark, ("tion", "there"))), "item_id")


@query(f"SELECT page_id || '.txt' AS name, substring(html, 1, {readers.UPLOAD_CHARS}) AS content, length(html) AS size, length(html) > {readers.UPLOAD_CHARS} AS truncated FROM pages")
def upload_filter(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return readers.accepted_uploads(p.select(F.concat(F.col("page_id").cast("string"), F.lit(".txt")).alias("name"), F.col("html").alias("content")))


@query("SELECT category, count(*) AS n FROM (SELECT lang AS category FROM documents) GROUP BY category")
def count_total_patterns(spark, sf):
    return readers.count_patterns(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("lang").alias("category")))


@query("SELECT algorithm, category FROM (VALUES ('naive', 'Exact Matching'), ('kmp', 'Exact Matching'), ('boyer_moore', 'Exact Matching'), ('suffix_tree', 'Exact Matching'), ('levenshtein', 'Approximate Matching'), ('shift_or', 'Approximate Matching'), ('rabin_karp', 'Exact Matching')) v(algorithm, category)")
def algorithm_info(spark, sf):
    return registry.algorithms(spark).select("algorithm", "category")
