"""Tables that jobs stage in the folder which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_KNOWN: dict[tuple[str, str], tuple[str, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode alone, a temporary folder of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = known.get() if known.isDefined() else None
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str) -> tuple[object, object]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _at(spark, path)
    return store.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    store, at = _at(spark, path)
    store.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in order; of none, an empty list."""
    store, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []


def empty_files(spark: SparkSession, path: str, parts: int = 1) -> list[str]:
    """Files without content in a folder or under a pattern, by the last parts of their paths. File sources leave them out without a word."""
    store, at = _at(spark, path)
    found = store.listStatus(at) if "*" not in path and store.exists(at) else store.globStatus(at) or []
    return ["/".join(x.getPath().toString().split("/")[-parts:]) for x in found if x.isFile() and x.getLen() == 0 and x.getPath().getName()[0] not in "._"]


def read_text(spark: SparkSession, path: str) -> str:
    store, at = _at(spark, path)
    stream = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with its whole content, unless there is one of that name: of several callers one succeeds, and readers see all of it or nothing.

    The content is written beside it and then linked (local disk) or renamed without overwriting (any store whose rename is atomic)."""
    store, at = _at(spark, path)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    sink = store.create(fresh, False)
    sink.write(bytearray(text, "utf-8"))
    sink.close()
    try:
        if store.getUri().getScheme() == "file":
            local = lambda p: spark._jvm.java.nio.file.Paths.get(store.makeQualified(p).toUri())
            spark._jvm.java.nio.file.Files.createLink(local(at), local(fresh))
        else:
            kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
            options = spark._sc._gateway.new_array(kind, 1)
            options[0] = kind.NONE
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(store.makeQualified(fresh), store.makeQualified(at), options)
        return True
    except Py4JJavaError as failed:
        if "FileAlreadyExists" not in str(failed.java_exception):
            raise
        return False
    finally:
        store.delete(fresh, False)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it again; cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is derived at its first use in an application and read afterwards."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _KNOWN or not exists(spark, _KNOWN[key][0]):
        path = new_path(spark, "table")
        df = build()
        df.write.option("compression", "zstd").parquet(path)
        _KNOWN[key] = (path, df.schema)
    path, schema = _KNOWN[key]
    return spark.read.schema(schema).parquet(path)


def once_path(spark: SparkSession, name: str, write: Callable[[str], object]) -> str:
    """A folder that is filled at its first use in an application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _KNOWN or not exists(spark, _KNOWN[key][0]):
        path = new_path(spark, "folder")
        write(path)
        _KNOWN[key] = (path, None)
    return _KNOWN[key][0]
