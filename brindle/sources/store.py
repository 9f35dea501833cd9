"""Small files in whatever store Spark reaches: paths are URIs, joined as text, and files go through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def join(folder: str, *names: str) -> str:
    """A path below a folder, as text: ``s3://b/x`` stays what it is."""
    return "/".join((folder.rstrip("/"), *(n.strip("/") for n in names)))


def is_absolute(path: str) -> bool:
    return path.startswith("/") or "://" in path or path.startswith("file:")


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none if there is no such folder."""
    fs, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def write_bytes(spark: SparkSession, path: str, value: bytes) -> None:
    """Writes a small file, over an old one."""
    fs, where = _at(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(value))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def publish(spark: SparkSession, path: str, value: bytes) -> bool:
    """Writes a small file under another name and renames it, so that it is there whole or not at all; False if ``path`` is there already."""
    fs, where = _at(spark, path)
    if fs.exists(where):
        return False
    folder, _, name = path.rpartition("/")
    hidden = f"{folder}/_{name}.tmp"
    write_bytes(spark, hidden, value)
    return fs.rename(_at(spark, hidden)[1], where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)
