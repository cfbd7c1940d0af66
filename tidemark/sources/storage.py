"""Where intermediates and streams go: a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: The folder of the innermost :func:`scratch` of this thread.
_FOLDER: ContextVar[str | None] = ContextVar("tidemark-folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one, removed at exit, only in local mode without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _OWN[key], ignore_errors=True)
    return _OWN[key]


def filesystem(spark: SparkSession, path: str):
    """The Hadoop path and its file system: local, HDFS or object store alike."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = filesystem(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target, fs = filesystem(spark, path)
    fs.delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table: in the folder of the surrounding :func:`scratch`, else in the application's."""
    base = _FOLDER.get() or f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch(spark: SparkSession, name: str = "scratch") -> Iterator[str]:
    """A folder of one's own for the intermediates that are written inside, removed at the end.

    Results that are still to be computed read them, so they must be written
    elsewhere before. Work outside, in other threads too, has other folders.
    """
    folder = new_path(spark, name)
    token = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(token)
        remove(spark, folder)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_file(spark: SparkSession, path: str) -> bytes | None:
    """A small file's bytes, null if it isn't there."""
    target, fs = filesystem(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def replace_file(spark: SparkSession, path: str, data: bytes, new: bool = False) -> None:
    """Write a small file under another name and rename it: readers see all of it
    or the one before. With ``new``, a file that is there already is a FileExistsError."""
    target, fs = filesystem(spark, path)
    fs.mkdirs(target.getParent())
    hadoop = spark._jvm.org.apache.hadoop.fs
    temporary = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(temporary, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    kind = getattr(hadoop, "Options$Rename")
    how = spark._sc._gateway.new_array(kind, 1)
    how[0] = kind.NONE if new else kind.OVERWRITE
    whole = fs.makeQualified(target)
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(temporary), whole, how)
    except Exception as e:
        fs.delete(temporary, False)
        if new and fs.exists(target):
            raise FileExistsError(path) from e
        raise


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it isn't there."""
    target, fs = filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []
