import gzip
import zlib

import pytest

from stringmill.llm import common, warc

ODD = "page_id long, url string, html string, shard string, turn int"


def expected(rows, min_bytes=0):
    """page_id, payload_bytes, payload_digest, record_type, refers_to by comparing all payloads."""
    best = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= min_bytes:
            best[h or ""] = max(best.get(h or "", (False, 0)), (p is not None, p or 0))
    out, taken = [], set()
    for p, _, h in rows:
        h = h or ""
        b = h.encode()
        first = best.get(h)
        mine = first is None or (first == (p is not None, p or 0) and h not in taken)
        if mine:
            taken.add(h)
        out.append((p, len(b), warc.digest(b), "response" if mine else "revisit", None if mine or not first[0] else first[1]))
    return sorted(out, key=str)


def run(spark, rows, tmp_path, **kw):
    pages = spark.createDataFrame([(*r, "s", 1) for r in rows], ODD)
    return warc.write_archives(pages, tmp_path.as_uri(), **kw)


ROWS = [(1, "http://a/", "<p>x</p>"), (2, "http://b/ ü\n", "<p>x</p>"), (3, None, None), (4, "http://c/", ""), (None, "http://d/", "<p>only</p>"), (6, "u", "<p>é\r\n\r\nWARC/1.1</p>" * 5000), (7, "u", "twice"), (7, "u", "twice"), (None, "v", "<p>x</p>")]


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_round_trip(spark, tmp_path, min_bytes):
    manifest = run(spark, ROWS, tmp_path, min_bytes=min_bytes)
    got = [tuple(r)[:5] for r in warc.read_archives(manifest).collect()]
    assert sorted(got, key=str) == expected(ROWS, min_bytes)


def test_archives_hold_a_member_a_record(spark, tmp_path):
    manifest = run(spark, ROWS, tmp_path).collect()
    kinds = []
    for path in {r.path for r in manifest}:
        local = common.file_system(path)[1]
        raw = open(local, "rb").read()
        for offset, length in warc.read_index(path):
            z = zlib.decompressobj(31)
            text = z.decompress(raw[offset : offset + length])
            assert z.eof and not z.unused_data and text.startswith(b"WARC/1.1\r\n")
            kinds.append(warc.parse_head(text.partition(b"\r\n\r\n")[0])["WARC-Type"])
        assert gzip.decompress(raw).count(b"WARC-Type: ") == len(warc.read_index(path))
    assert len(kinds) == len(ROWS)
    assert not (tmp_path / "streams").exists()


def test_normaliser_takes_one_stream_or_many(tmp_path):
    parts = [warc.response(k, "http://x/", b"p" * k * 3000) for k in range(5)]
    (tmp_path / "one.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "many.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    for name in ("one.gz", "many.gz"):
        target = (tmp_path / f"out-{name}").as_uri()
        assert warc.normalise_stream((tmp_path / name).as_uri(), target) == 5
        raw = (tmp_path / f"out-{name}").read_bytes()
        assert [sorted(gzip.decompress(raw[o : o + n]).split(b"\r\n")) for o, n in warc.read_index(target)] == [sorted(p.split(b"\r\n")) for p in parts]
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"".join(parts)[:-100]))
    with pytest.raises(ValueError):
        warc.normalise_stream((tmp_path / "cut.gz").as_uri(), (tmp_path / "x").as_uri())


def test_empty_table(spark, tmp_path):
    assert warc.read_archives(run(spark, [], tmp_path)).collect() == []


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [tuple(r) for r in warc.op5_warc(spark, sf_dir).collect()]
    assert sorted(got, key=str) == expected(rows)
