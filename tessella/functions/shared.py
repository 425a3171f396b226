"""Helpers for cutting lineage through storage that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Where none is configured, a local master gets one of its own (tests); on a
    cluster that is an error, as executors would not see the driver's folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any store that Spark reads; None if it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(place):
        return None
    stream = store.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder of any store that Spark reads; none if it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> bool:
    """Writes a small file, whole or not at all: under another name first, then renamed; False where it is there and must not be overwritten."""
    jvm = spark._jvm
    place, hidden = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf)
    store = place.getFileSystem(conf)
    store.mkdirs(place.getParent())
    stream = store.create(hidden)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if overwrite else rename.NONE
    try:
        context.rename(hidden, place, how)
    except Py4JJavaError as e:
        if overwrite or "FileAlreadyExists" not in str(e.java_exception):
            raise
        remove(spark, hidden.toString())
        return False
    return True


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            remove(df.sparkSession, path)
