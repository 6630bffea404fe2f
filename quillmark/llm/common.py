"""What the operators of this subpackage share: the shared folder, table reads, word patterns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of anything but the ASCII blanks space, tab, LF, VT, FF, CR. Python's bytes.split() cuts
#: at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folders of each scratch() that is open.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one machine
    (local mode, as in tests) gets a temporary one; a cluster has none that its executors see, so there it raises."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _own_dir(spark.sparkContext.master, spark.sparkContext.applicationId)).rstrip("/")


@lru_cache(maxsize=None)
def _own_dir(master: str, application: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="quillmark-")


def new_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    held = _scratch.get()
    if held := held[:-1] if keep else held:
        held[-1].append(path)
    return path


def materialise(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputing.

    Unlike Dataset.checkpoint() it computes df once, and the copy is compressed and columnar. Shuffle files of the
    write go when it ends. Inside scratch() the copy goes with it, unless keep is set.
    """
    spark = df.sparkSession
    path, before = new_path(spark, tag, keep), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the folders that new_path() and materialise() made inside, also if it ends by an error."""
    token = _scratch.set((*_scratch.get(), []))
    try:
        yield
    finally:
        held = _scratch.get()[-1]
        _scratch.reset(token)
        for path in held:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Bounds the rows of an Arrow batch, as texts can be long. Never raises a smaller setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that none of columns has (compared without case, as Spark does)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
