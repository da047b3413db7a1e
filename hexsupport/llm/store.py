"""Tables written to the cluster's shared folder, to cut lineage durably.

The folder is ``spark.checkpoint.dir`` of the session. Only where it is unset and
Spark runs on this machine (tests, a laptop) a folder of our own is made.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='hexsupport-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` texts and 8 MB, so that long texts fit a small Python worker.

    Spark's own defaults (10,000 and 64 MB) are lowered; a session that chose a value keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "8m")


def lean() -> None:
    """In a Python worker: large freed arrays go back to the system, so that workers side by side stay small.

    Arrays up to a few MB, as in work done by slices, are reused in place: asking the system anew for each costs more than the work.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name, one like it that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        out.append(own)
    return out


def set_aside(df: DataFrame, inner) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns that are named like ``inner`` ones (in any case) renamed, and their new names."""
    inner = {c.lower() for c in inner}
    clash = [c for c in df.columns if c.lower() in inner]
    names, taken = {}, inner | {c.lower() for c in df.columns}
    for c in clash:
        own = f"{c}_"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        names[c] = own
    return df.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns)), names


def small(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows."""
    return df.count() <= limit


def buckets_for(spark: SparkSession, size: int, each: int = 64 << 20) -> int:
    """Buckets for ``size`` bytes, of ``each`` at most on average."""
    return max(128, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


#: The workspaces made in the innermost open ``temporary`` block.
_MADE: ContextVar[list[Workspace] | None] = ContextVar("made", default=None)


@contextmanager
def temporary() -> Iterator[None]:
    """Frees the intermediate tables of all operators called inside, also where one fails.

    For a caller who writes an operator's result inside the block: what operators
    return is read from these tables, so it must not be used after the block.
    """
    made: list[Workspace] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for ws in made:
            ws.free()


class Workspace:
    """Intermediate tables of one operator run; ``drop`` frees some of them early, ``free`` all (see ``temporary``)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        made = _MADE.get()
        if made is not None:
            made.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        """``df``, written as Parquet and read back: lost executors cannot lose it."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._workspace_path)

    def free(self) -> None:
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
