"""Helpers that the training-data operators share.

Text rules used everywhere in this subpackage: a null text counts as empty; "lower-case" means A-Z only; a word is a
maximal run of characters other than space, tab, newline, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import atexit
import functools
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"

_OWN_DIRS: dict[str, str] = {}
_CACHE: dict[str, object] = {}
_SCOPES: list[list[tuple[SparkSession, str]]] = []


def worker_cache(name: str, make):
    """A cache of this Python worker that serves one task after another. A worker holds one: asking for another drops it."""
    if name not in _CACHE:
        if _CACHE:
            _CACHE.clear()
            give_back()
        _CACHE[name] = make()
    return _CACHE[name]


def give_back() -> None:
    """Return freed memory to the system, as a worker shares its executor's limit with others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only a session on one machine may leave it unset; it gets a temporary folder."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN_DIRS[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; it is removed when the innermost scope ends, at the latest with this driver."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append((spark, path))
    else:
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone: nothing is left to do on the way out
        pass


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scoped(build):
    """Decorate a function that returns a DataFrame: its result is written to the shared folder, and all it wrote on the way is removed.

    Shuffle files of its jobs go, too, as soon as the driver's collector finds that nothing refers to them.
    """

    @functools.wraps(build)
    def run(*args, **named):
        own: list[tuple[SparkSession, str]] = []
        _SCOPES.append(own)
        try:
            out = build(*args, **named)
        finally:
            _SCOPES.pop()
        kept = stash(out, build.__name__)
        del out
        for spark, path in own:
            _remove(spark, path)
        tidy(kept.sparkSession)
        return kept

    return run


def tidy(spark: SparkSession) -> None:
    """Let the driver's collectors find finished jobs, so that Spark removes their shuffle files now and not in half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
