"""What the operators of this subpackage share: the shared folder, files and keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    temporary folder serves a session whose executors are the driver itself; any
    other gets an error, since its executors would write to their own disks.
    """
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_SETTING} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stringmill-")
        spark.conf.set(_SETTING, root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path of this application below the shared folder; nothing is made there yet."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


_marked: set[str] = set()


def _own(spark: SparkSession) -> str:
    """This application's folder; the file system deletes it when the driver's JVM ends."""
    own = f"{shared_root(spark)}/stringmill/{spark.sparkContext.applicationId}"
    if own not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _marked.add(own)
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage: a lost executor later costs a re-read, not a re-run.  Columns
    are written under numbers, so their names may be any, and may clash.
    """
    path = scratch(df.sparkSession, name)
    plain = numbered(df)
    plain.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for frames that nothing will read again."""
    for f in frames:
        remove(f.sparkSession, f.scratch_path)


def remove_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables and files; frames not yet written that read them are lost."""
    remove(spark, _own(spark))
    _marked.clear()


def remove(spark: SparkSession, uri: str) -> None:
    """Delete one path, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str):
    """(file system, path) of a URI or plain path, usable on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def ensure_parent(uri: str) -> None:
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)


#: Most bytes, and most rows, that go to a Python worker in one Arrow batch.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches small for this session: some texts are long, and copies of one lie together."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not (now and 0 < int(now[1]) <= most):
            spark.conf.set(key, str(most))


def place(df: DataFrame, name: str) -> int:
    """Number of the column of this name: the first that has it exactly, else the first but for case."""
    names = list(df.columns)
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def numbered(df: DataFrame) -> DataFrame:
    """The same frame with columns c0, c1, ...: no names that could clash."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def only(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, whatever others there are (TEXT beside text, say).

    Every operator that hands texts to Python begins here, so batches are bounded here.
    Ids of a narrower integer type are taken as long.
    """
    bound_batches(df.sparkSession)
    plain = numbered(df)
    wide = lambda n, c: c.cast("long") if n.endswith("_id") and df.dtypes[place(df, n)][1] in ("tinyint", "smallint", "int") else c
    return plain.select(*[wide(n, F.col(f"c{place(df, n)}")).alias(n) for n in names])


def salt(of: Column, buckets: int) -> Column:
    """A number from 0 to buckets - 1 that spreads the rows of a hot key."""
    return F.pmod(F.xxhash64(of), F.lit(buckets)).cast("int")


def attach(rows: DataFrame, key: str, spread: str, table: DataFrame, *, buckets: int = 256, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``table`` (one row a key) although one key may hold a third of the rows.

    The (key, salt) pairs that occur in ``rows`` are found by a map-side combined
    aggregation; they meet ``table`` on the key, at most ``buckets`` a key; the
    result meets ``rows`` on (key, salt).  No task sees all the rows of a hot key.
    """
    s = rows.withColumn("_salt", salt(F.col(spread), buckets))
    pairs = s.select(key, "_salt").distinct().join(table, key, "inner")
    return s.join(pairs, [key, "_salt"], how).drop("_salt")


#: At most so many keys are broadcast with the number of places that their rows are dealt to.
BROADCAST_KEYS = 100_000


def meet(rows: DataFrame, key: str, spread: Column, table: DataFrame, sizes: DataFrame, per: int) -> DataFrame:
    """Join ``rows`` to ``table`` (one row a key) on ``key``, no place getting more than about ``per`` rows of one key.

    ``sizes`` has (key, n), the rows of each key.  Keys of more than ``per`` rows are
    few, and are broadcast if they are: their rows are dealt by ``spread`` to as many
    places as it takes, each with a copy of the table's row.  All rows are shuffled
    once.  If such keys are too many to broadcast, ``attach`` does it with shuffles.
    """
    hot = sizes.filter(F.col("n") > per).select(key, F.least(F.ceil(F.col("n") / per), F.lit(100_000)).cast("int").alias("_copies"))
    if hot.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        return attach(rows.withColumn("_spread", spread), key, "_spread", table).drop("_spread")
    copies = F.coalesce("_copies", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), copies).cast("int")).drop("_copies")
    right = table.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return left.join(right, [key, "_salt"]).drop("_salt")


def running_sum(counts: DataFrame, key: str, order: str, n: str) -> DataFrame:
    """(order, key, before): sum of ``n`` over the rows of the key with a smaller ``order``.

    ``counts`` has one row for each task and key, so a window holds at most as many
    rows as there were tasks.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(order, key, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("before"))


def batches(rows: Iterator[pa.RecordBatch], most_bytes: int = BATCH_BYTES, most_rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut large record batches so that a worker holds few texts at a time."""
    for batch in rows:
        if not batch.num_rows:
            continue
        step = max(1, min(most_rows, batch.num_rows * most_bytes // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def sample_by_hash(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those whose ``key`` has the smallest hashes; the same rows for the same table.

    Rows are counted first and only about as many as are wanted are put in order, so
    no task hands on more than its share.
    """
    h, whole = F.pmod(F.xxhash64(key), F.lit(1 << 40)), 1 << 40
    n = df.count()
    if n > most:
        # A margin of a fifth and of many standard deviations.
        df = df.filter(h < int(whole * min(1.0, (1.2 * most + 1000) / n)))
    return df.orderBy(h, key).limit(most)


def manifest_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A frame of one row a task, for lists whose length is the number of shards."""
    return spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))
