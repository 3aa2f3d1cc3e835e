"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a null id is while rows are ordered, joined or stored.
NULL_ID = -(2**63)
#: The folders of kept tables.
_KEPT: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def id_of(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def id_back(column: Column) -> Column:
    return F.when(column != NULL_ID, column)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, also set as checkpoint folder, if Spark runs in one process, and else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lexigrove.local.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lexigrove-")
        spark.conf.set("spark.lexigrove.local.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    _KEPT[kept] = path
    return kept


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that keep() returned and that no later plan reads; other tables are left alone."""
    for table in tables:
        if path := _KEPT.pop(table, None):
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(uri))


def make_dir(uri: str) -> None:
    store, path = filesystem(uri)
    store.create_dir(path, recursive=True)


def write_whole(uri: str, writer) -> int:
    """Calls writer(stream) on a file of its own and then renames it, so a task that is run twice leaves one whole file; returns its bytes."""
    store, path = filesystem(uri)
    folder, name = posixpath.split(path)
    attempt = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt, compression=None) as out:
        writer(out)
        size = out.tell()
    store.move(attempt, path)
    return size


def bound_batches(spark: SparkSession, limit: str = "8m") -> None:
    """Lets Arrow batches that go to Python end at so many bytes, not only at a number of rows, unless the session already has a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))) >= 2**31 - 1:
        spark.conf.set(key, limit)
