"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that each of a memo's two generations may hold; bounds a Python worker's memory.
MEMO_LIMIT = 120_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, a new temporary one where driver and executors are one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            found = tempfile.mkdtemp(prefix="checkpoints-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and cut its lineage, so that a lost executor costs a re-read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, most: int = 1_000):
    """Hand at most `most` rows at once to Python while queries run inside; texts are long, and both sides buffer whole batches."""
    before = spark.conf.get(ARROW_ROWS)
    if not 0 < int(before) <= most:
        spark.conf.set(ARROW_ROWS, str(most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def hand_back() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


_STATE: dict = {}


def worker_state(key, make):
    """An object that a Python worker keeps between tasks; another key's object is let go first.

    Workers are reused from operator to operator, so at most one operator's memos stay in memory; what the last
    one held is handed back to the system.
    """
    if key not in _STATE:
        _STATE.clear()
        hand_back()
        _STATE[key] = make()
    return _STATE[key]


#: Rows of ids that may be broadcast.
BROADCAST_IDS = 200_000


def small_or_not(ids: DataFrame) -> DataFrame:
    """The frame, to be broadcast if a count shows that it is small; else it takes part in an ordinary join."""
    ids = checkpointed(ids)
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def hint_if_few(rows: int):
    """A broadcast hint for frames of at most so many (counted) rows of ids, if those are few enough; else nothing."""
    return F.broadcast if rows <= BROADCAST_IDS else lambda frame: frame


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished rounds, which it finds by garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def forget(batches):
    """Pass batches on; before, let go what the Python worker keeps between tasks, and hand its memory back."""
    _STATE.clear()
    hand_back()
    yield from batches


def hand_back_all(spark: SparkSession) -> None:
    """Let executors collect their garbage and idle Python workers forget, so that unused memory goes back to the system.

    A heap that one stage made grow stays large otherwise, beside the Python workers of the next stage.
    Idle cores get a task each, and thus every executor; collections that are asked for at once are one.
    """
    tasks = spark.sparkContext.defaultParallelism
    collected = spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("gc"))
    collected.mapInPandas(forget, "gc string").collect()


class Memo(dict):
    """A dict that computes missing values and holds at most two generations of `limit` entries.

    A full generation becomes the old one; entries that are still asked for return from it, so that
    frequent keys survive while rare ones leave.
    """

    __slots__ = ("make", "limit", "old")

    def __init__(self, make, limit: int = MEMO_LIMIT):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
