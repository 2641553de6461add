"""Tables in the shared scratch folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="scratch-")
    atexit.register(shutil.rmtree, folder, True)
    return "file://" + folder


def scratch_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only on a local master without one."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return _own_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


#: While these are set, Spark removes the shuffle files of a query at its end, and hands rows to Python in smaller batches
#: than the default 10,000, so that workers hold a few MB of text at a time.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_lock = threading.Lock()
_writers: dict[int, tuple[int, dict[str, str]]] = {}  # session: writes under way, its settings before the first


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """The settings of a write, until the last of the session's writes under way ends."""
    key = id(spark._jsparkSession)
    with _lock:
        n, before = _writers.get(key, (0, {}))
        if not n:
            before = {k: spark.conf.get(k) for k in _SETTINGS}
            for k, v in _SETTINGS.items():
                spark.conf.set(k, v)
        _writers[key] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _writers.pop(key)
            if n > 1:
                _writers[key] = n - 1, before
            else:
                for k, v in before.items():
                    spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager:
    """The settings of a write, for a plan whose rows go to the driver."""
    return _settings(spark)


_scopes = threading.local()


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables that this thread writes inside go at the end, but for those passed to ``kept``."""
    outer = getattr(_scopes, "tables", None)
    _scopes.tables = own = {}
    try:
        yield
    finally:
        _scopes.tables = outer
        for df in own.values():
            discard(df)


def kept(df: DataFrame) -> DataFrame:
    """``df``, a table of ``written``, outlives the scope it was written in."""
    (getattr(_scopes, "tables", None) or {}).pop(getattr(df, "_scratch_path", None), None)
    return df


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write a table into the scratch folder and read it back. The shuffle files of the write go with it.

    narrow: rows of a few bytes made by many tasks; they are gathered first, so that the table has few files.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if narrow else df
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _settings(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if (own := getattr(_scopes, "tables", None)) is not None:
        own[path] = out
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``written`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
