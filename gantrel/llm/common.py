"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where it is unset, a session whose tasks
    run on this machine gets a temporary one; any other must set it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), f"gantrel-{uuid.uuid4().hex}")
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages survive lost executors and do not recompute it."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._scratch_path = path
    if not _written:
        atexit.register(_discard_all)
    _written[path] = df.sparkSession
    return held


#: What ``materialize`` wrote and nothing has deleted, as lazy results may still read it; deleted when the driver ends.
_written: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _discard_all() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session has ended already, and the folder is its owner's to clear
            return


def discard(*held: DataFrame) -> None:
    """Delete what ``materialize`` wrote for frames that nothing reads any more."""
    for df in held:
        if path := getattr(df, "_scratch_path", None):
            _delete(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver find the shuffles of finished jobs now: executors keep their files until its next collection."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows and stored bytes of a side that is broadcast once it has been measured; a larger side is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20


def broadcast_if_small(held: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised side, marked for broadcast if it has no more than ``limit`` rows in ``BROADCAST_BYTES``."""
    size = int(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(held) if size <= BROADCAST_BYTES and held.count() <= limit else held


#: A key of more rows is dealt over several tasks, unless that would make more than ``HOT_KEYS`` such keys.
HOT_ROWS, HOT_KEYS = 8192, 10_000


def join_split(many: DataFrame, one: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has one row for each key and in ``n`` the number of rows that ``many``
    has of it. The rows of a hot key are dealt over several tasks, each with a copy of its one row. ``rows``, of ``many``,
    bounds the number of hot keys, which are broadcast, by ``HOT_KEYS``."""
    share = max(HOT_ROWS, rows // HOT_KEYS)
    parts = F.ceil(F.col("n") / share).cast("int")
    hot = one.filter(F.col("n") > share).select(*keys, parts.alias("__parts"))
    others = [c for c in many.columns if c not in keys]
    part = F.coalesce(F.pmod(F.xxhash64(*others), F.col("__parts")).cast("int"), F.lit(0))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("__part", part).drop("__parts")
    copied = one.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copied, [*keys, "__part"]).drop("__part")


#: Bytes of rows that Python gets at once: a batch of whole texts stays small however long they are.
BATCH_BYTES = 4 << 20


def bound_memory(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_BYTES``, and read Parquet by plain reads, where it is not set
    otherwise: vectored ones of a local file keep a buffer as large as a column chunk for each of their threads."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    if spark.conf.get("parquet.hadoop.vectored.io.enabled", None) is None:
        spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs run inside, whose rows hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches whose worker, when it has run, hands the memory it has freed back to the system. A worker
    waits for its next task beside those at work and would keep it."""

    @wraps(run)
    def held(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
            trim(0)

    return held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: str, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)


#: Ranks of ``hash_rank`` lie below this.
RANKS = 1 << 40


def hash_rank(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(RANKS))


def hashed_share(rank: Column, wanted: int, total: Column) -> Column:
    """Whether a row can be among the ``wanted`` of lowest ``hash_rank`` out of ``total``: twice the share that is
    expected to be needed passes, all rows of a group no larger than that."""
    return rank < F.lit(RANKS) * F.least(F.lit(1.0), F.lit(2.0 * wanted) / total)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns, compared case-insensitively, that an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def as_bytes(values: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each string or binary value, without decoding; null counts as empty."""
    if pa.types.is_string(values.type):
        values = values.cast(pa.binary())
    elif pa.types.is_large_string(values.type):
        values = values.cast(pa.large_binary())
    for v in values:
        yield v.as_py() or b""


def chunks(values: pa.Array, rows: int = 512) -> Iterator[pa.Array]:
    """Consecutive slices of an Arrow array."""
    for start in range(0, max(1, len(values)), rows):
        yield values.slice(start, rows)
