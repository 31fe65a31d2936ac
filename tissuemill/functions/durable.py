"""Tables in the shared folder, which cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}

class _Scope(threading.local):
    """The open scopes of a thread, each a list of paths, the innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_scopes = _Scope()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="spark-own-")
    return _own_dirs[sc.applicationId]


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it.

    Later stages reread the files, whichever executors are lost.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes.open:
        _scopes.open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete, at the end, the tables that :func:`durable` wrote inside.

    What is given to the yielded function is written, as by :func:`durable`, and stays
    (until the end of the scope around this one, if there is one).
    """
    scope: list[str] = []
    depth = len(_scopes.open)

    def keep(df: DataFrame, label: str) -> DataFrame:
        inside, _scopes.open = _scopes.open[depth:], _scopes.open[:depth]
        try:
            return durable(df, label)
        finally:
            _scopes.open = [*_scopes.open, *inside]

    _scopes.open.append(scope)
    try:
        yield keep
    finally:
        del _scopes.open[depth:]
        for path in scope:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
