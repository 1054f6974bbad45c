"""The FASTA source: any ranges give what the whole file gives, on every kind of line end."""

import random

import pytest

from stringmill.operators import exact
from stringmill.sources import fasta, readers, writers

KINDS = {"lf": "\n", "crlf": "\r\n", "cr": "\r"}


def made(seed, records=12):
    rnd = random.Random(seed)
    seq = lambda n: "".join(rnd.choice("ACGTacgt") for _ in range(n))
    lengths = [0, 1, 79, 80, 81, 1700] + [rnd.randint(0, 300) for _ in range(records - 6)]
    return [(f"dna|é{k}|len{n}|i0", seq(n)) for k, n in enumerate(lengths)]


def put(path, rows, end, before=""):
    lines = [before] if before else []
    for header, seq in rows:
        lines += [f"> {header} ", *[seq[k : k + 80] for k in range(0, len(seq), 80)], ""]
    path.write_bytes((end.join(lines)).encode())


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("size", [1, 7, 64, 500, 1 << 20])
def test_records_by_ranges(kind, size, tmp_path):
    """Without Spark: each range alone, together the file; a record of 1,700 letters lies over many."""
    rows = made(1)
    put(tmp_path / "a.fasta", rows, KINDS[kind], "ACGT no record")
    reader = fasta.FastaReader({"path": str(tmp_path / "a.fasta"), "rangebytes": str(size)})
    got = [r for part in reader.partitions() for r in reader.read(part)]
    assert [(h, s) for _, _, h, s in got] == rows
    assert len(reader.partitions()) == -(-(tmp_path / "a.fasta").stat().st_size // size)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("size,step", [(3, 16), (50, 64), (333, 1 << 20), (1 << 20, 100)])
def test_pieces_by_ranges(kind, size, step, tmp_path, monkeypatch):
    monkeypatch.setattr(fasta, "STEP", step)
    rows = made(2)
    put(tmp_path / "a.fasta", rows, KINDS[kind])
    whole = "".join(s for _, s in rows)
    reader = fasta.FastaReader({"path": str(tmp_path / "a.fasta"), "rangebytes": str(size), "pieces": "true", "overlap": "9"})
    at, records = 0, 0
    for part in reader.partitions():
        for _, _, _, n, letters, seq in reader.read(part):
            assert seq == whole[at : at + len(seq)] and len(seq) >= min(letters + 9, len(whole) - at)
            at, records = at + letters, records + n
    assert at == len(whole) and records == len(rows)


def test_over_tasks(spark, tmp_path):
    rows = made(3, 400)
    put(tmp_path / "one.fasta", rows, "\r\n")
    put(tmp_path / "two.fa", rows[:3], "\n")
    (tmp_path / "_SUCCESS").write_text(">x\nACGT")
    df = fasta.records(spark, str(tmp_path / "one.fasta"), 4096)
    assert df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert sorted((r.header, r.seq) for r in df.collect()) == sorted(rows)
    got = sorted(tuple(r) for r in readers.read_fasta(spark, str(tmp_path), 1000).collect())
    assert got == sorted([("one.fasta", k, h, s) for k, (h, s) in enumerate(rows)] + [("two.fa", k, h, s) for k, (h, s) in enumerate(rows[:3])])
    assert readers.read_fasta(spark, f"file://{tmp_path}/*.fa").count() == 3
    assert readers.read_fasta(spark, f"{tmp_path}/none*.fa").count() == 0


def test_sequence_of_any_length_is_searched_in_pieces(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(f"r{k}", "".join(rnd.choice("acgt") for _ in range(rnd.randint(0, 4000)))) for k in range(20)]
    put(tmp_path / "g.fasta", rows, "\r\n")
    whole = "".join(s for _, s in rows).upper()
    words = [whole[100:130], whole[len(rows[0][1]) - 5 : len(rows[0][1]) + 5], "ACG", "NN"]
    patterns = spark.createDataFrame([(w,) for w in words], "pattern string")
    pieces = fasta.sequence(spark, str(tmp_path / "g.fasta"), 29, 700)
    got = sorted((r.pattern, r.pos) for r in exact.in_pieces(pieces, patterns).collect())
    assert got == sorted((w, i) for w in words for i in range(len(whole)) if whole.startswith(w, i))
    assert readers.load_genome(spark, str(tmp_path / "g.fasta")).first().text == whole


def test_writer_and_reader(spark, tmp_path):
    rows = made(5)
    writers.write_fasta(spark.createDataFrame(rows, "header string, seq string").repartition(3), f"{tmp_path}/out")
    assert sorted((r.header, r.seq) for r in fasta.records(spark, f"{tmp_path}/out", 100).collect()) == sorted(rows)
