"""Intermediate tables in the shared checkpoint folder.

Operators that read the same rows several times store the few columns they need once and scan that. A
stored table cuts the lineage, survives the loss of executors, shows every pass the same rows, is read
column by column, and has a known size: Spark broadcasts it in a join only below
`spark.sql.autoBroadcastJoinThreshold` and shuffles it beyond.
"""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    """A temporary folder of this process, deleted when it ends."""
    folder = tempfile.mkdtemp(prefix="hearthstat-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _is_local(master: str) -> bool:
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; only a local session may do without and gets a temporary one.

    Whether a `file:` folder is shared by all machines of a cluster cannot be seen from here: it is taken at its word.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not _is_local(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}"


#: Paths stored since each open scope began, the innermost last.
_scopes: list[list[str]] = []


def store(df: DataFrame) -> DataFrame:
    """Write the rows to a new stored table and return a scan of it."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[None]:
    """A scope that deletes on its end what was stored inside it, also what failed halfway.

    Results that read stored tables have to be written or collected before the scope ends.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def drop_stored(spark: SparkSession) -> None:
    """Delete all stored tables of this application, once their results have been used."""
    _delete(spark, _folder(spark))
