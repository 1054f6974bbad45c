"""WARC archives: written as whole-file gzip streams, normalised to a member a record.

``write_streams`` writes pages as archives whose whole content is one gzip stream,
as careless tools leave them: such a file can only be read from its start.
``normalise_stream`` inflates such a file once, rewrites every record as a gzip
member of its own and writes a sidecar index of (offset, length) a record, so any
record can be read alone.  On its way it turns records whose payload another
record holds into revisits.  ``read_archives`` reads by the index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: An archive ends after so many records or so many bytes of payload.
SHARD_RECORDS = 4000
SHARD_BYTES = 256 << 20
#: Records that one row of the reading plan stands for.
READ_RECORDS = 500
CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

Headers = dict[str, str]


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: Headers, block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _uri(url: str | None, page_id: int | None) -> str:
    return quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else f"urn:page:{page_id}"


def response(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """A response record; the id of the page is that of the record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(
        {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": DATE, "WARC-Target-URI": _uri(url, page_id), "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http; msgtype=response"},
        http + payload,
    )


def as_revisit(headers: Headers, block: bytes, refers_to: int | None) -> bytes:
    """The revisit that stands for a response: its HTTP headers without the payload."""
    http = block[: block.index(b"\r\n\r\n") + 4]
    own = {k: v for k, v in headers.items() if k not in ("Content-Length", "WARC-Type")}
    return record({"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>", **own}, http)


def parse_head(head: bytes) -> Headers:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record begins here: {lines[0][:60]!r}")
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(file) -> Iterator[bytes]:
    """The content of a gzip file, of one stream or many, in pieces of bounded size."""
    z, rest = zlib.decompressobj(31), b""
    while True:
        data = rest or file.read(CHUNK)
        if not data:
            return
        if z.eof:
            z = zlib.decompressobj(31)
        out = z.decompress(data, CHUNK)
        rest = z.unused_data if z.eof else z.unconsumed_tail
        if out:
            yield out


def records(pieces: Iterator[bytes]) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each record of an inflated archive; memory is one record."""
    have = bytearray()

    def fill(n: int) -> None:
        while len(have) < n:
            have.extend(next(pieces))

    while True:
        end = have.find(b"\r\n\r\n")
        while end < 0:
            more = next(pieces, None)
            if more is None:
                if have.strip():
                    raise ValueError("the archive ends inside a record's headers")
                return
            have.extend(more)
            end = have.find(b"\r\n\r\n")
        headers = parse_head(bytes(have[:end]))
        n = int(headers["Content-Length"])
        try:
            fill(end + 4 + n + 4)
        except StopIteration:
            raise ValueError("the archive ends inside a record's block") from None
        yield headers, bytes(have[end + 4 : end + 4 + n])
        del have[: end + 8 + n]


def normalise_stream(source: str, target: str, rewrite: Callable[[int, Headers, bytes], bytes | None] = lambda *_: None, level: int = 6) -> int:
    """Rewrite an archive with a member a record, and its index beside it; the number of records.

    The index, ``target`` + ``.idx``, has a line a record: offset and length of its
    member, its type and its id.  ``rewrite`` gets (number, headers, block) and may
    give another record.
    """
    system, path = common.file_system(source)
    out_system, out_path = common.file_system(target)
    out_system.create_dir(out_path.rpartition("/")[0], recursive=True)
    at = n = 0
    with system.open_input_stream(path, compression=None) as file, out_system.open_output_stream(out_path, compression=None) as out, out_system.open_output_stream(out_path + ".idx", compression=None) as index:
        for n, (headers, block) in enumerate(records(inflate(file)), 1):
            raw = rewrite(n - 1, headers, block)
            kind = "revisit" if raw is not None else headers.get("WARC-Type", "")
            if raw is None:
                raw = record({k: v for k, v in headers.items() if k != "Content-Length"}, block)
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = z.compress(raw) + z.flush()
            out.write(member)
            index.write(f"{at}\t{len(member)}\t{kind}\t{headers.get('WARC-Record-ID', '')}\n".encode())
            at += len(member)
    return n


def read_index(target: str) -> list[tuple[int, int]]:
    system, path = common.file_system(target + ".idx")
    with system.open_input_stream(path, compression=None) as file:
        return [tuple(map(int, x.split(b"\t")[:2])) for x in file.read().splitlines()]


def page_number(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


SLIM = "shard string, turn int, page_id long, payload_digest string, payload_bytes long"


def write_streams(pages: DataFrame, out_dir: str) -> DataFrame:
    """Write pages (page_id, url, html) as whole-file gzip archives, in the order they are read.

    Returns a row a page: shard, turn in it, page_id, payload_digest, payload_bytes.
    The rows are written out at once, so the files are made once.
    """

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = z = uri = None
        turn = size = 0
        for batch in common.batches(rows):
            out: list[tuple] = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                if file is None:
                    uri = f"{out_dir}/stream-{uuid.uuid4().hex}.warc.gz"
                    system, path = common.file_system(uri)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    file, z, turn, size = system.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                file.write(z.compress(response(page_id, url, payload)))
                out.append((uri, turn, page_id, digest(payload), len(payload)))
                turn, size = turn + 1, size + len(payload)
                if turn >= SHARD_RECORDS or size >= SHARD_BYTES:
                    file.write(z.flush())
                    file.close()
                    file = None
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["shard", "turn", "page_id", "payload_digest", "payload_bytes"])
        if file is not None:
            file.write(z.flush())
            file.close()

    return common.materialize(common.only(pages, "page_id", "url", "html").mapInArrow(write, SLIM), "streams")


def choose_responses(slim: DataFrame, min_bytes: int) -> DataFrame:
    """slim with is_revisit and refers_to: of equal payloads the largest page_id stays a response."""
    place = F.struct(F.col("page_id"), F.col("shard"), F.col("turn"))
    first = slim.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(place).alias("first"))
    met = common.attach(slim, "payload_digest", "turn", first, how="left")
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("first").eqNullSafe(place)
    return met.select("shard", "turn", F.coalesce(revisit, F.lit(False)).alias("is_revisit"), F.when(revisit, F.col("first.page_id")).alias("refers_to"))


def write_archives(pages: DataFrame, out_dir: str, *, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as normalised archives; the manifest (path, first, last) for reading.

    Only rows without html are shuffled: the decision which records become
    revisits is taken on digests, by a map-side combined maximum, and goes to
    the shard's one normaliser, which meets at most ``SHARD_RECORDS`` of them.

    Null html: empty payload.  Null url: an id stands for it.  Null page_id: an
    own record without a number, before all others among equal payloads.
    Repeated rows: one is the response, the others revisit it.  Empty table: no
    archives.  Other columns are ignored.
    """
    spark = pages.sparkSession
    streams = f"{out_dir}/streams"
    slim = write_streams(pages, streams)
    verdicts = choose_responses(slim, min_bytes)

    def normalise(key, table):
        source = key[0].as_py()
        own = {t: r for t, v, r in zip(*(table.column(c).to_pylist() for c in ("turn", "is_revisit", "refers_to"))) if v}
        target = f"{out_dir}/archives/pages-{uuid.uuid4().hex}.warc.gz"
        n = normalise_stream(source, target, lambda k, headers, block: as_revisit(headers, block, own[k]) if k in own else None)
        firsts = list(range(0, n, READ_RECORDS))
        return pa.table({"path": pa.array([target] * len(firsts)), "first": pa.array(firsts, pa.int32()), "last": pa.array([min(n, f + READ_RECORDS) for f in firsts], pa.int32())})

    # A number of partitions of our own: the rows are few bytes but each shard is much work.
    dealt = verdicts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    done = common.materialize(dealt.groupBy("shard").applyInArrow(normalise, "path string, first int, last int"), "archives")
    common.remove(spark, streams)
    return done


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of each record, by the index."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in batch.to_pylist():
                index = read_index(part["path"])[part["first"] : part["last"]]
                system, path = common.file_system(part["path"])
                out: list[tuple] = []
                with system.open_input_file(path) as file:
                    for offset, length in index:
                        file.seek(offset)
                        headers, block = next(records(iter([zlib.decompress(file.read(length), 31)])))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = headers["WARC-Type"]
                        if kind == "revisit":
                            size, sha1 = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        else:
                            size, sha1 = len(payload), digest(payload)
                        out.append((page_number(headers["WARC-Record-ID"]), size, sha1, kind, page_number(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI")))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], list(names))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    # A round-robin deal: the parts of one archive go to different tasks.
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n).mapInArrow(read, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages to archives and back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages, common.scratch(spark, "warc"))).drop("target_uri")
