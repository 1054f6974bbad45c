"""Each job as a query: the job's function, twice into one new folder, and what then stands there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stringmill.sources.folders import new_folder

from . import scan_new_texts, search_report


def job1_scan_new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the benchmark's items in all documents; the second run finds nothing new."""
    at = new_folder(spark, "job1")
    for _ in range(2):
        scan_new_texts.scan(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{at}/out", f"{at}/state")
    return scan_new_texts.hits_of(spark, f"{at}/out").selectExpr("text_id AS doc_id", "pattern_id AS item_id", "pos", "lang")


def job2_search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all documents; the second run replaces it by the same."""
    at = new_folder(spark, "job2")
    for _ in range(2):
        search_report.report(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", at)
    return search_report.report_of(spark, at)


QUERIES = {"job1_scan_new_texts": job1_scan_new_texts, "job2_search_report": job2_search_report}

ORACLE_SQL = {
    "job1_scan_new_texts": """WITH RECURSIVE hits AS (
      SELECT doc_id, item_id, lang, b.text AS pattern, substring(d.text, instr(d.text, b.text) + 1) AS rest, CAST(instr(d.text, b.text) - 1 AS BIGINT) AS pos FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)
      UNION ALL SELECT doc_id, item_id, lang, pattern, substring(rest, instr(rest, pattern) + 1), pos + instr(rest, pattern) FROM hits WHERE instr(rest, pattern) > 0)
    SELECT doc_id, item_id, pos, nullif(lang, '') AS lang FROM hits""",
    "job2_search_report": f"""WITH RECURSIVE runs AS (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS pattern FROM benchmark),
    p AS (SELECT pattern, length(pattern) AS m FROM runs WHERE length(pattern) BETWEEN 5 AND 12 GROUP BY pattern ORDER BY count(*) DESC, pattern LIMIT 6),
    d AS (SELECT doc_id, nullif(lang, '') AS lang, source, coalesce(text, '') AS text FROM documents),
    over AS (SELECT doc_id, lang, source, pattern, text, CAST(instr(text, pattern) - 1 AS BIGINT) AS pos FROM d, p WHERE instr(text, pattern) > 0
      UNION ALL SELECT doc_id, lang, source, pattern, substring(text, instr(text, pattern) + 1), pos + instr(substring(text, instr(text, pattern) + 1), pattern) FROM over WHERE instr(substring(text, instr(text, pattern) + 1), pattern) > 0),
    pieces AS (SELECT doc_id, lang, source, pattern, m, substring(text, head + 1, 255 + m) AS piece FROM (SELECT *, unnest(range(0, length(text), 256)) AS head FROM d, p)),
    w AS (SELECT doc_id, lang, source, pattern, m, substring(piece, i + 1, m) AS win FROM (SELECT *, unnest(range(0, least(256, greatest(length(piece) - m + 1, 0)))) AS i FROM pieces)),
    h AS (SELECT doc_id, lang, source, pattern, 'overlapping' AS way, count(*) AS n FROM over GROUP BY ALL
      UNION ALL SELECT doc_id, lang, source, pattern, 'apart', len(string_split(text, pattern)) - 1 FROM d, p WHERE contains(text, pattern)
      UNION ALL SELECT doc_id, lang, source, pattern, 'mismatches', count(*) FROM w WHERE {' + '.join(f"(substring(pattern, {j}, 1) <> substring(win, {j}, 1))::INT" for j in range(1, 13))} <= 1 GROUP BY ALL),
    g AS (SELECT lang, source, pattern, way, count(*) AS texts_with, sum(n) AS hits FROM h GROUP BY ALL),
    s AS (SELECT lang, source, count(*) AS texts, sum(length(text)) AS characters FROM d GROUP BY ALL),
    r AS (SELECT s.lang, s.source, p.pattern, v.way, m, texts, characters, coalesce(texts_with, 0) AS texts_with, coalesce(hits, 0) AS hits FROM s CROSS JOIN p CROSS JOIN (VALUES ('overlapping'), ('apart'), ('mismatches')) v(way)
      LEFT JOIN g ON g.lang IS NOT DISTINCT FROM s.lang AND g.source IS NOT DISTINCT FROM s.source AND g.pattern = p.pattern AND g.way = v.way)
    SELECT source, pattern, CAST(m AS INT) AS length, CASE WHEN m <= 10 THEN 'small' WHEN m <= 50 THEN 'medium' WHEN m <= 200 THEN 'large' ELSE 'vlarge' END AS size, way, texts, CAST(texts_with AS BIGINT) AS texts_with, CAST(hits AS BIGINT) AS hits,
      round(hits * 1e6 / nullif(characters, 0), 6) AS per_million, round(hits / nullif(max(CASE WHEN way = 'overlapping' THEN hits END) OVER (PARTITION BY lang, source, pattern), 0), 6) AS ratio, lang FROM r""",
}
