import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stringmill.llm import common, simple8b, wordbpe

ODD = "doc_id long, text string, n_tokens string, extra int"


def brute_ids(texts):
    t = Tokenizer.from_file(wordbpe.default_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_cached_tokenizer_is_exact_on_random_unicode():
    rnd = random.Random(1)
    pool = [chr(c) for c in [*range(0x250), *range(0x300, 0x330), *range(0x390, 0x3D0), 0x2003, 0x85, 0x3000, 0xFB01, 0x1E9E, 0x212A, 0x4E00, 0xAC00, 0x1100, 0x1161, 0x200B]]
    pool += [" "] * 60 + ["'s", "'LL", "<|endoftext|>", ".", "word", "Éa."]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    t = wordbpe.load()
    for text, raw in zip(texts, t.encode_all(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, (1 << 64) - 1)), max_size=3000), st.integers(0, 200))
def test_words_round_trip(values, zeros):
    v = np.array(values + [0] * zeros + values[::-1], dtype=np.uint64)
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, len(v)) == v).all()
    for b in range(len(offsets) - 1):  # each block alone
        own = v[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]
        w = words[offsets[b] : offsets[b + 1]]
        assert (simple8b.decode(w, offsets[b : b + 2], len(own)) == own).all()


def test_selectors_pack_as_stated():
    words, _ = simple8b.encode(np.zeros(240, np.uint64))
    assert len(words) == 2
    words, _ = simple8b.encode(np.full(8, 40_000, np.uint64))
    assert len(words) == 3 and int(words[0] >> np.uint64(60)) == 13


def test_files_give_back_every_id(spark, tmp_path):
    rows = [(3, "Thé quick brown. " * 900, "a", 1), (1, None, "b", 2), (2, "", "c", 3), (2, "x y", "d", 4), (None, "no id", "e", 5), (3, "Thé quick brown. " * 900, "a", 1), (9, "<|endoftext|> a\x1cb", "f", 6)]
    docs = spark.createDataFrame(rows, ODD)
    manifest = simple8b.write_token_ids(docs, tmp_path.as_uri())
    got = [tuple(r) for r in simple8b.read_token_ids(manifest).collect()]
    want, at = [], 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, ids in zip(ordered, brute_ids([r[1] for r in ordered])):
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_empty_table(spark, tmp_path):
    manifest = simple8b.write_token_ids(spark.createDataFrame([], ODD), tmp_path.as_uri())
    assert simple8b.read_token_ids(manifest).collect() == []


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in simple8b.op10_simple8b(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    at = 0
    for d, ids in zip(docs, brute_ids([d.text for d in docs])):
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_shared_root_is_read_from_the_session(spark):
    assert common.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_scratch_is_removed(spark):
    df = common.materialize(spark.range(5), "numbers")
    assert df.count() == 5
    inputs = df.inputFiles()
    common.remove(spark, inputs[0].rpartition("/")[0])
    system, path = common.file_system(inputs[0])
    assert system.get_file_info(path).type.name == "NotFound"


def test_other_vocabularies_go_to_the_library(tmp_path):
    """A file without its normaliser, or with another split, gives the library's ids."""
    import json

    file = json.load(open(wordbpe.default_path()))
    assert wordbpe.load().known
    for k, change in enumerate(({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "Lowercase"}})):
        path = str(tmp_path / f"v{k}.json")
        json.dump(file | change, open(path, "w"))
        t, texts = wordbpe.load(path), ["Some Words, it's 42 \n  HERE", "", None, "É<|endoftext|>x"]
        assert not t.known
        assert [np.frombuffer(raw, "<u4").tolist() for raw in t.encode_all(texts)] == [t.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_rows_of_one_id_are_dealt(spark):
    """A third of the rows have one id, a third have none: no shard holds more than thrice the median."""
    rnd = random.Random(12)
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 else 10_000 + k, " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(5)), "", 0) for k in range(6000)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        manifest = simple8b.write_token_ids(spark.createDataFrame(rows, ODD).repartition(6), common.scratch(spark, "hot"))
        sizes = sorted(r.n_docs for r in manifest.collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(sizes) == len(rows) and len(sizes) >= 9 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    got = simple8b.read_token_ids(manifest).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((r[0] is not None, r[0] or 0) for r in rows)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
