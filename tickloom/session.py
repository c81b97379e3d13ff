"""Session settings shared by all operators: where cut plans are written, and nothing machine-local on a cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. Where it is unset, a temporary one on a local master (tests);
    on a cluster that would be a machine-local folder, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder at once and go on from the written copy, so a lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    _delete_at_exit(spark, spark.sparkContext.getCheckpointDir())
    return df.checkpoint(eager=True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Scratch of this application is of no use after it: the file system removes the folder when the driver's JVM ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table, under this application's folder in the shared one; it is removed when the driver ends, if not before."""
    root = f"{shared_dir(spark).rstrip('/')}/tickloom-{spark.sparkContext.applicationId}"
    _delete_at_exit(spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written table of ours, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file on whatever file system the path names; None if it isn't there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, whole or not at all: under another name first, then moved."""
    jvm = spark.sparkContext._jvm
    where, part = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.{uuid.uuid4().hex}"))
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.setWriteChecksum(False)  # a small file may be edited by hand, which a checksum beside it wouldn't survive
    try:
        stream = files.create(part, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
    finally:
        files.setWriteChecksum(True)
    files.delete(where, False)
    if not files.rename(part, where):
        raise OSError(f"can't write {path}")


def listing(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, length, time) of the files that a table is read from: two equal listings are the same files. Metadata only, nothing is read."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        files = where.getFileSystem(conf)
        out.append((name, files.getFileStatus(where).getLen(), files.getFileStatus(where).getModificationTime()) if files.exists(where) else (name, -1, -1))
    return out
