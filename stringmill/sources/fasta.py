"""FASTA files of any size: a data source whose partitions are byte ranges.

A file is cut into ranges without being read.  A record belongs to the range in which
its header line begins, and is read on from there past the end of the range; so one
file is read by as many tasks as it has ranges, and a record that spans several is
read once, by one.  In pieces, letters belong to the range in which they stand, so a
sequence of any length, in one record or many, is spread over tasks; each piece has
the letters that follow it as an overlap.

Line ends may be LF, CRLF or CR.  A header is a line that begins with ``>``.  Bytes that
are no UTF-8 are replaced.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 8 << 20
#: Bytes that are read at once.
STEP = 1 << 20
RECORDS = "file string, at long, header string, seq string"
PIECES = "file string, begin long, turn int, records long, letters long, seq string"


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def files_of(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files of a file, a folder, or a glob in the last part of a path; none that begin with ``_`` or ``.``."""
    from pyarrow import fs

    head, _, last = path.rstrip("/").rpartition("/")
    glob = any(c in last for c in "*?[")
    system, at = _opened((head or "/") if glob else path)
    prefix = path[: len(path) - len(path.partition("://")[2])] if "://" in path else ""
    if not glob and (info := system.get_file_info(at)).type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(at, recursive=not glob))
    keep = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and (not glob or fnmatch.fnmatchcase(f.base_name, last))]
    # The path without its scheme and host, as the file system names it.
    return sorted((f"{prefix}{f.path}" if prefix in ("", "file://") else f"{path.partition('://')[0]}://{f.path}", f.size) for f in keep)


class Lines:
    """The lines of a file from a byte on: (offset, line without its end)."""

    def __init__(self, file, start: int):
        self.file, self.at, self.rest, self.over = file, start, b"", False
        file.seek(start)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while not self.over or self.rest:
            if not self.over:
                more = self.file.read(STEP)
                self.over = not more
                self.rest += more
            # The last byte may be half of a CRLF, and the last line may go on.
            whole = len(self.rest) if self.over else max(self.rest.rfind(b"\n"), self.rest.rfind(b"\r", 0, len(self.rest) - 1)) + 1
            if not whole and not self.over and len(self.rest) < 16 * STEP:
                continue
            block, self.rest = self.rest[: whole or len(self.rest)], self.rest[whole or len(self.rest) :]
            for line in block.splitlines(keepends=True):
                yield self.at, line.rstrip(b"\r\n")
                self.at += len(line)


def _begin(file, start: int) -> int:
    """The first byte at or after ``start`` at which a line begins."""
    if not start:
        return 0
    # The byte before tells whether a line begins here; an LF after a CR ends the same line.
    file.seek(start - 1)
    at, before = start, file.read(1)
    while True:
        block = file.read(STEP)
        both = before + block
        for k in range(1, len(both)):
            if both[k - 1 : k] == b"\n" or both[k - 1 : k] == b"\r" and both[k : k + 1] != b"\n":
                return at + k - 1
            if k % 4096 == 0 and b"\n" not in both[k:] and b"\r" not in both[k:]:
                break
        at += len(block)
        if not block:
            return at
        before = block[-1:]


class Range(InputPartition):
    def __init__(self, uri: str, begin: int, end: int):
        self.uri, self.begin, self.end = uri, begin, end


def _text(parts: list[bytes]) -> str:
    return "".join(b"".join(parts).decode("utf-8", "replace").split())


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.pieces, self.overlap = options.get("pieces", "false").lower() == "true", int(options.get("overlap", 0))
        if self.size <= 0:
            raise ValueError("rangeBytes must be positive")

    def partitions(self) -> list[Range]:
        own = [Range(uri, begin, min(begin + self.size, size)) for uri, size in files_of(self.path) for begin in range(0, size, self.size)]
        return own or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.uri:
            return
        system, path = _opened(part.uri)
        with system.open_input_file(path) as file:
            yield from (self._pieces if self.pieces else self._records)(part, file)

    def _records(self, part: Range, file) -> Iterator[tuple]:
        name, at, header, body = part.uri.rpartition("/")[2], None, b"", []
        for offset, line in Lines(file, _begin(file, part.begin)):
            if line.startswith(b">"):
                if at is not None:
                    yield name, at, header.decode("utf-8", "replace").strip(), _text(body)
                at, header, body = None, line[1:], []
                if offset >= part.end:
                    return
                at = offset
            elif at is not None:
                body.append(line)
            elif offset >= part.end:
                return
        if at is not None:
            yield name, at, header.decode("utf-8", "replace").strip(), _text(body)

    def _pieces(self, part: Range, file) -> Iterator[tuple]:
        """One piece for each STEP of letters: what a range has of its own, and the overlap behind."""
        name, own, waiting, turn, records, size = part.uri.rpartition("/")[2], [], [], 0, 0, 0
        for offset, line in Lines(file, _begin(file, part.begin)):
            if offset >= part.end:
                if sum(map(len, waiting)) >= self.overlap or not self.overlap:
                    break
                waiting.append("" if line.startswith(b">") else _text([line]))
            elif line.startswith(b">"):
                records += 1
            else:
                own.append(_text([line]))
                size += len(own[-1])
                if size >= STEP:
                    text, size = "".join(own), 0
                    # The overlap of a piece within a range is the beginning of the next: keep back as much.
                    keep = min(self.overlap, len(text))
                    yield name, part.begin, turn, records, len(text) - keep, text
                    own, size, turn, records = [text[len(text) - keep :]], keep, turn + 1, 0
        text = "".join(own)
        yield name, part.begin, turn, records, len(text), text + "".join(waiting)[: self.overlap]


class FastaSource(DataSource):
    """``spark.read.format("fasta")``: options path, rangeBytes, pieces, overlap."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return PIECES if self.options.get("pieces", "false").lower() == "true" else RECORDS

    def reader(self, schema) -> FastaReader:
        return FastaReader({k.lower(): v for k, v in self.options.items()})


def _load(spark: SparkSession, path: str, range_bytes: int, **options) -> DataFrame:
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").option("path", path).option("rangeBytes", range_bytes).options(**options).load()


def records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, at, header, seq) of each record; ``at`` is the byte at which it begins.  What comes before the first header is no record."""
    return _load(spark, path, range_bytes)


def sequence(spark: SparkSession, path: str, overlap: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each file as one sequence of letters, headers and white space left out, in pieces: (text_id, start, own, text).

    ``start`` is the piece's place in the whole sequence, ``own`` the number of its own
    letters, and ``text`` these and up to ``overlap`` that follow.  A hit of a pattern
    of at most ``overlap + 1`` letters that starts within ``own`` is whole in ``text``.
    Places come from the sums of the pieces before, a row a piece.
    """
    pieces = _load(spark, path, range_bytes, pieces=True, overlap=overlap)
    slim = pieces.select("file", "begin", "turn", "letters")
    before = F.sum("letters").over(Window.partitionBy("file").orderBy("begin", "turn").rowsBetween(Window.unboundedPreceding, -1))
    places = slim.select("file", "begin", "turn", F.coalesce(before, F.lit(0)).alias("start"))
    return pieces.join(places, ["file", "begin", "turn"]).filter("letters > 0").select(F.col("file").alias("text_id"), "start", F.col("letters").alias("own"), F.upper("seq").alias("text"))
