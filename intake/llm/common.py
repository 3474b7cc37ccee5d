"""What several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; where none is set, one is made on a local master and any other is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later steps survive lost executors and don't repeat it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Words of 64 bits of the bitmaps by which rows are sifted.
SIFT_WORDS = 1 << 18


def sifted(df: DataFrame, key: Column, keys: DataFrame, to: str) -> DataFrame:
    """``df`` with a column that is true for every row whose ``key`` is in the one column of ``keys`` (hashes; long), and for few others.

    A bitmap of bounded size goes to every task, so that a join's wide rows needn't all be shuffled to find a few. Only rows that are false are certain.
    """
    word = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(SIFT_WORDS - 1))
    bit = "shiftleft(1L, cast(_h & 63 as int))"
    bits = keys.toDF("_h").groupBy(word(F.col("_h")).alias("_word")).agg(F.bit_or(F.expr(bit)).alias("_bits"))
    marked = df.withColumn("_h", key).withColumn("_word", word(F.col("_h"))).join(F.broadcast(bits), "_word", "left")
    return marked.withColumn(to, F.expr(f"coalesce(_bits & {bit}, 0L) <> 0")).drop("_h", "_word", "_bits")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text in order; a null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def id_hash(doc_id: Column) -> Column:
    """crc32 of the id as text, from which the folds are cut; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


#: Bytes of rows in an Arrow batch; Spark's own limit is 10,000 rows, however long their texts.
BATCH = "4m"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> str | None:
    """From now on the session's Arrow batches are bounded by bytes too, as the JVM and the worker of each task hold one at once. Gives what was set before, for ``unbound_batches``."""
    before = spark.conf.get(_ARROW_BYTES, None)
    spark.conf.set(_ARROW_BYTES, BATCH)
    return before


def unbound_batches(spark: SparkSession, before: str | None) -> None:
    if before is None:
        spark.conf.unset(_ARROW_BYTES)
    else:
        spark.conf.set(_ARROW_BYTES, before)


_KEPT: dict[str, list] = {}


def worker_cache(kind: str, maxsize: int):
    """A cache that a worker keeps from task to task, until a task begins that doesn't name its kind (``drop_kept``): else it would lie beside the memory of all later stages."""

    def wrap(f):
        _KEPT.setdefault(kind, []).append(found := lru_cache(maxsize=maxsize)(f))
        return found

    return wrap


def drop_kept(but: str | None = None) -> None:
    """Clears this worker's caches of other kinds."""
    full = [f for kind, fs in _KEPT.items() if kind != but for f in fs if f.cache_info().currsize]
    for f in full:
        f.cache_clear()
    if full:
        give_back()


def give_back() -> None:
    """Returns what a task has freed to the system: a worker waits for later tasks and stages, beside whatever runs there meanwhile."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def map_slices(df: DataFrame, schema, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], rows: int = 256, keeps: str | None = None) -> DataFrame:
    """A map over Arrow batches in slices of ``rows`` rows, which bounds what a Python worker holds at once.

    ``make`` is called once per task and gives the function for the slices. ``keeps`` names the caches that the worker keeps for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeps)
        work = make()
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, rows):
                    yield work(batch.slice(start, rows))
        finally:
            del work
            give_back()

    return df.mapInArrow(run, schema)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased, as UTF-8; bytes are split at exactly the white space of ``WORD``."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def list_array(values, lengths, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from its values in a row and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values, kind))


@contextmanager
def new_file(path: str):
    """A stream to a file at a path or URI that executors share: written aside and moved, so that a repeated task leaves one good file."""
    system, place = fs.FileSystem.from_uri(path)
    aside = f"{place}.{uuid.uuid4().hex}"
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(aside, compression=None) as out:
        yield out
    system.move(aside, place)


def put_file(path: str, data: bytes) -> None:
    """A whole file at a path or URI that executors share."""
    with new_file(path) as out:
        out.write(data)


def get_bytes(path: str, start: int, length: int) -> bytes:
    """Part of a file at a path or URI."""
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as f:
        f.seek(start)
        return f.read(length)
