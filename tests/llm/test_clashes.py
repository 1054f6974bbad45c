"""Extra columns that differ from those read in case alone, and ones named as results are: every operator reads its own."""

import pytest

from stringmill.llm import common, decontaminate, htmltext, line_dedup, neardup, packing, quality_rules, rule_ensemble, simple8b, toxicity, warc

TEXTS = ["one two three four five six", "one two three four five six", "Menu\nseven eight", None, "", "long " * 30_000]
DOCS = "doc_id long, TEXT string, text string, lang string, LANG string, source string, Source string, DOC_ID string, score string, kept string, `we.ird` string"
LABELS = "DOC_ID string, doc_id long, Quality string, quality int, toxic int, TOXIC string"
PAGES = "HTML string, page_id long, url string, html string, URL int, Page_Id string, n_chars string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, "wrong", t, "en", "xx", "a", "wrong", "w", "s", "k", "w") for k, t in enumerate(TEXTS)], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([("w", k, "w", 1, 0, "w") for k in range(4)], LABELS)


def test_documents(spark, docs, labels):
    items = spark.createDataFrame([("w", 7, "two three four five six", "w")], "TEXT string, item_id long, text string, Item_Id string")
    n = len(TEXTS)
    assert packing.pack(docs).select("doc_id").distinct().count() == n
    assert rule_ensemble.score(docs, labels).count() == n
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, items).collect()} == {(0, 7), (1, 7)}
    assert [r.n_words for r in quality_rules.judge(docs, labels).orderBy("doc_id").collect()] == [6, 6, 3, 0, 0, 30_000]
    assert [r.component_id for r in neardup.group(docs).orderBy("doc_id").collect()] == [0, 0, 2, 3, 4, 5]
    assert toxicity.score(docs, labels).count() == n
    got = simple8b.read_token_ids(simple8b.write_token_ids(docs, common.scratch(spark, "clash"))).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(n)) and got[0].n_tokens == got[1].n_tokens == 7


def test_rows_pass_through(spark, docs, labels):
    items = spark.createDataFrame([(7, "two three four five six")], "item_id long, text string")
    for out, texts in (
        (line_dedup.drop_boilerplate(docs, ratio=0.3), ["", "", *TEXTS[2:]]),
        (decontaminate.drop_contaminated(docs, items), TEXTS[2:]),
        (toxicity.keep_clean(docs, labels), TEXTS),
    ):
        assert out.columns == docs.columns
        rows = sorted(map(tuple, common.materialize(out, "clash").collect()))
        assert [r[2] for r in rows] == texts and all(r[1] == "wrong" and r[3:] == ("en", "xx", "a", "wrong", "w", "s", "k", "w") for r in rows)


def test_pages(spark):
    html = "<article><h1>A title</h1><p>A paragraph of the article, which is long enough.</p></article>"
    pages = spark.createDataFrame([("wrong", k, f"u{k}", html, 0, "w", "n") for k in range(2)], PAGES)
    assert {(r.url, r.text) for r in htmltext.extract(pages, htmltext.default_field()).collect()} == {(f"u{k}", "A title\n\nA paragraph of the article, which is long enough.") for k in range(2)}
    got = warc.read_archives(warc.write_archives(pages, common.scratch(spark, "clash"))).collect()
    assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got} == {(0, len(html), "revisit", 1), (1, len(html), "response", None)}


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(Session())
