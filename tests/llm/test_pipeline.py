import re

import corpus_pipeline as P
from stringmill.llm import common, decontaminate, line_dedup, toxicity

from . import test_decontaminate, test_line_dedup, test_neardup, test_packing


def test_stage_by_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]

    def stage(k, rows):
        out = P.STAGES[k][1](spark, spark.createDataFrame(rows, docs.schema), sf_dir)
        assert k == 4 or out.columns == columns
        return [tuple(r) for r in out.collect()]

    scored = {r.doc_id for r in toxicity.score(docs, labels).collect() if r.predicted == 0}
    kept = stage(0, rows)
    assert sorted(kept) == sorted(r for r in rows if r[0] in scored)

    lines = stage(1, kept)
    want = dict(test_line_dedup.brute([(r[0], r[1], r[3]) for r in kept], line_dedup.RATIO, line_dedup.MIN_PAGES, distinct=True))
    assert sorted(lines) == sorted((r[0], want[r[0]], r[2], r[3], len(want[r[0]])) for r in kept)

    single = stage(2, lines)
    groups = test_neardup.brute([r[:2] for r in lines])
    assert sorted(r[0] for r in single) == [d for d, _, _, k in groups if k] or sorted(r[0] for r in single) == sorted(d for d, _, _, k in groups if k)

    clean = stage(3, single)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {x[0] for x in test_decontaminate.brute([(r[0], r[1]) for r in single if re.search(r"\w", r[1])], items)}
    assert sorted(r[0] for r in clean) == sorted(r[0] for r in single if r[0] not in bad)
    assert decontaminate.RATE < 0.5

    packed = P.STAGES[4][1](spark, spark.createDataFrame(clean, docs.schema), sf_dir).collect()
    test_packing.check(packed, [r[:2] for r in clean], 4096)

    whole = P.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string, kept string, TEXT string, Doc_Id string, _row string, `a.b` string"
    rest = ("x", "k", "T", "D", "r", "ab")
    rows = [(1, None, "en", "a", 0, *rest), (1, None, "en", "a", 0, *rest), (None, "one two", None, None, 7, *rest), (3, "one two", "en", "a", 7, *rest), (4, "one two", "en", "a", 7, *rest), (5, "", "en", "a", 0, *rest), (6, "far " * 300_000 + "away", "en", "a", 0, *rest)]
    for rows in (rows, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == spark.createDataFrame([], schema).columns
            docs = common.materialize(docs, "odd")
        assert sorted((r.doc_id for r in P.pack(spark, docs, sf_dir).filter("piece = 0").collect()), key=str) == sorted((r[0] for r in rows if r[0] != 4), key=str)
