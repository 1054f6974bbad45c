"""Token-id output in Simple-8b words, written to shard files and read back.

A shard file holds the ids of whole documents in ascending ``doc_id`` order:

=============  =====================================================================
part           content (all integers little-endian)
=============  =====================================================================
magic          8 bytes ``SMS8B\\0\\0\\1``
words          64-bit words, block after block
doc ids        int64 a document (-2^63 for a null id)
doc lengths    int64 a document, number of ids
block offsets  int64 a block, first word of the block, and one more at the end
tail           int64 documents, int64 blocks, int64 ids, magic again
=============  =====================================================================

A block holds ``BLOCK`` ids (the last one fewer) and begins with a word of its own,
so blocks can be decoded each by itself or all together by array operations.  The
top four bits of a word select how many ids share the other 60 bits; selector 0 is
the escape: the word after it is one id of up to 64 bits, as it is.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordbpe

MAGIC = b"SMS8B\0\0\1"
BLOCK = 1024
#: Blocks coded or decoded at a time.
GROUP = 512
NULL_ID = -(1 << 63)

#: Fixed values of the format: ids a word, and bits an id, by selector from 1 to 15.
COUNTS = (0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

_PAD = 128


def _widths(values: np.ndarray) -> np.ndarray:
    """For each value the least of ``BITS`` and 61 that is not under the bits it needs."""
    out = np.zeros(values.shape, np.uint8)
    for b, wider in zip(sorted({*BITS}), [*sorted({*BITS})[1:], 61]):
        out[values >= np.uint64(1 << b)] = wider
    return out


_SHORT = _widths(np.arange(1 << 16, dtype=np.uint64))


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and the end) of unsigned integers."""
    values = np.asarray(values, dtype=np.uint64)
    words, offsets, total = [], [np.zeros(1, np.int64)], 0
    for at in range(0, len(values), BLOCK * GROUP):
        w, sizes = _encode_group(values[at : at + BLOCK * GROUP])
        words.append(w)
        offsets.append(total + np.cumsum(sizes))
        total += len(w)
    return (np.concatenate(words) if words else np.zeros(0, np.uint64)), np.concatenate(offsets)


def _encode_group(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    blocks = -(-n // BLOCK)
    table = np.zeros((blocks, BLOCK + _PAD), np.uint64)
    lengths = np.full(blocks, BLOCK, np.int64)
    lengths[-1] = n - (blocks - 1) * BLOCK
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = values
    table[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    width = _SHORT[table] if n and values.max() < 1 << 16 else _widths(table)
    # power[k]: the widest of k values in a row.  Longer words need not be tried
    # where no run of k values is narrow enough for any of them.
    power, k = {1: width}, 1
    while 2 * k <= COUNTS[1] and power[k][:, :BLOCK].min() <= max(b for c, b in zip(COUNTS, BITS) if c >= 2 * k):
        p = power[k]
        power[2 * k] = wider = p.copy()
        np.maximum(p[:, :-k], p[:, k:], out=wider[:, :-k])
        k *= 2
    choice = np.zeros((blocks, BLOCK), np.uint8)
    for s in range(15, 0, -1):
        c, b = COUNTS[s], BITS[s]
        k = 1 << (c.bit_length() - 1)
        if k not in power:
            break
        most = power[k][:, :BLOCK]
        if c > k:
            most = np.maximum(most, power[k][:, c - k : c - k + BLOCK])
        choice[most <= b] = s
    counts = np.array(COUNTS, np.int64)
    counts[0] = 1
    rows, at, steps = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(rows):
        sel = choice[rows, at]
        steps.append((rows, at, sel))
        at = at + counts[sel]
        more = at < lengths[rows]
        if not more.all():
            rows, at = rows[more], at[more]
    starts = np.full((blocks, len(steps)), -1, np.int16)
    for k, (rows, at, _) in enumerate(steps):
        starts[rows, k] = at
    rows, k = np.nonzero(starts >= 0)
    at = starts[rows, k].astype(np.int64)
    sel = choice[rows, at]
    size = np.where(sel == 0, 2, 1)
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    for s in range(1, 16):
        own = np.flatnonzero(sel == s)
        if len(own):
            c, b = COUNTS[s], BITS[s]
            word = np.full(len(own), s << 60, np.uint64)
            for j in range(c if b else 0):
                word |= table[rows[own], at[own] + j] << np.uint64(j * b)
            out[place[own]] = word
    own = np.flatnonzero(sel == 0)
    out[place[own] + 1] = table[rows[own], at[own]]
    return out, np.bincount(rows, weights=size, minlength=blocks).astype(np.int64)


def decode(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of consecutive whole blocks; ``offsets`` begins at the first word's number."""
    words = np.asarray(words, dtype=np.uint64)
    starts = np.asarray(offsets[:-1] - offsets[0])
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == 0).any():
        k = 0
        for k in np.flatnonzero(sel == 0).tolist():
            if not raw[k] and k + 1 < len(words):
                raw[k + 1] = True
    counts = np.array(COUNTS, np.int64)[sel]
    counts[sel == 0] = 1
    counts[raw] = 0
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(starts)), np.diff(offsets))
    base = before[starts]
    local = before - base[block]
    lengths = np.full(len(starts), BLOCK, np.int64)
    if len(starts):
        lengths[-1] = n_ids - (len(starts) - 1) * BLOCK
    out = np.zeros(n_ids, np.uint64)
    to = block * BLOCK + local
    room = lengths[block] - local
    for s in range(1, 16):
        own = np.flatnonzero((sel == s) & ~raw)
        if not len(own) or not BITS[s]:
            continue
        c, b = COUNTS[s], BITS[s]
        mask = np.uint64((1 << b) - 1)
        for j in range(c):
            fits = own[room[own] > j] if j else own
            out[to[fits] + j] = (words[fits] >> np.uint64(j * b)) & mask
    own = np.flatnonzero((sel == 0) & ~raw)
    out[to[own]] = words[own + 1]
    return out


class ShardWriter:
    """Writes one shard file block by block; memory is a group of blocks and the document list."""

    def __init__(self, uri: str):
        system, self.path = common.file_system(uri)
        system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.file = system.open_output_stream(self.path)
        self.file.write(MAGIC)
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []
        self.offsets = [np.zeros(1, np.int64)]
        self.words = 0
        self.n_ids = 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK * GROUP:
            self._flush(self.n_waiting - self.n_waiting % (BLOCK * GROUP))

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint64)
        words, offsets = encode(ids[:upto])
        self.file.write(words.astype("<u8").tobytes())
        self.offsets.append(offsets[1:] + self.words)
        self.words += len(words)
        self.waiting = [ids[upto:]]
        self.n_waiting = len(ids) - upto

    def close(self) -> None:
        self._flush(self.n_waiting)
        offsets = np.concatenate(self.offsets)
        for part in (self.doc_ids, self.lengths, offsets):
            self.file.write(np.asarray(part, dtype="<i8").tobytes())
        self.file.write(struct.pack("<3q", len(self.doc_ids), len(offsets) - 1, self.n_ids) + MAGIC)
        self.file.close()


def read_shard(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a shard file, a group of blocks at a time."""
    system, path = common.file_system(uri)
    with system.open_input_file(path) as file:
        size = file.size()
        file.seek(size - 32)
        tail = file.read(32)
        docs, blocks, n_ids = struct.unpack("<3q", tail[:24])
        if tail[24:] != MAGIC:
            raise ValueError(f"{uri} is no whole shard file")
        file.seek(size - 32 - 8 * (2 * docs + blocks + 1))
        table = np.frombuffer(file.read(8 * (2 * docs + blocks + 1)), "<i8")
        doc_ids, lengths, offsets = table[:docs], table[docs : 2 * docs], table[2 * docs :]
        file.seek(len(MAGIC))
        have, at = np.zeros(0, np.uint64), 0
        for doc_id, length in zip(doc_ids.tolist(), lengths.tolist()):
            parts = [have]
            got = len(have)
            while got < length:
                end = min(at + GROUP, blocks)
                own = offsets[at : end + 1]
                words = np.frombuffer(file.read(8 * int(own[-1] - own[0])), "<u8")
                parts.append(decode(words, own, min(end * BLOCK, n_ids) - at * BLOCK))
                got += len(parts[-1])
                at = end
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield (None if doc_id == NULL_ID else doc_id), have[:length]
            have = have[length:]


SHARD_SCHEMA = "task int, path string, n_docs long, n_tokens long"


def write_token_ids(docs: DataFrame, out_dir: str, *, vocabulary: str | None = None, end_id: int | None = 1) -> DataFrame:
    """Write the token ids of ``docs`` (doc_id, text) as shards in ascending doc_id order.

    Returns the manifest, one row a shard in file order: task, path, n_docs,
    n_tokens, start (ids of all shards before it).  Only documents' texts are
    shuffled, once, by range of doc_id; ids go from the task to its file.

    Null or empty text: no ids but ``end_id``.  Null doc_id: before all others.
    Repeated doc_id: all rows are kept, in the order of their texts' hashes.  Empty table:
    no shards.  Other columns of ``docs`` are ignored.  A task that runs again
    writes a new file; the manifest names only the file of the run that counted.
    """
    spark = docs.sparkSession
    path = vocabulary or wordbpe.default_path()

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        tokenizer = wordbpe.load(path)
        end = np.array([] if end_id is None else [end_id], np.uint64)
        out = None
        for batch in common.batches(rows):
            ids = batch.column(0).to_pylist()
            for doc_id, raw in zip(ids, tokenizer.encode_all(batch.column(1).to_pylist())):
                out = out or ShardWriter(f"{out_dir}/ids-{task:06d}-{uuid.uuid4().hex[:12]}.s8b")
                out.add(doc_id, np.concatenate([np.frombuffer(raw, "<u4").astype(np.uint64), end]))
        if out:
            out.close()
            uri = f"{out_dir}/{out.path.rpartition('/')[2]}"
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "path": [uri], "n_docs": [len(out.doc_ids)], "n_tokens": [out.n_ids]})

    # A doc_id may be that of many rows, or null: ranges part its rows by their texts.
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = common.only(docs, "doc_id", "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    # One row a task: the list is as long as the number of shards.
    shards = sorted(ordered.mapInArrow(write, SHARD_SCHEMA).collect(), key=lambda r: r["task"])
    rows, start = [], 0
    for r in shards:
        rows.append((r["task"], r["path"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return common.manifest_frame(spark, rows, SHARD_SCHEMA + ", start long")


def read_token_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards of a manifest."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for shard in batch.to_pylist():
                at, out = shard["start"], ([], [], [], [])
                for doc_id, ids in read_shard(shard["path"]):
                    for column, value in zip(out, (doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        column.append(value)
                    at += len(ids)
                    if len(out[0]) == 10_000:
                        yield _digests(out)
                        out = ([], [], [], [])
                if out[0]:
                    yield _digests(out)

    return manifest.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digests(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op10_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to shard files and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_ids(write_token_ids(docs, common.scratch(spark, "ids")))
