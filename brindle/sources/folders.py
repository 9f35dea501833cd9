"""The folder that driver and executors share, and tables that end a lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that this process made in the shared folder and hasn't removed.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset a folder is chosen: a temporary one under a plain local master (one
    machine, as in tests), else one in the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local["):
            folder = "file://" + tempfile.mkdtemp(prefix="brindle-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_brindle"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder of this name in the shared folder."""
    folder = f"{shared_folder(spark)}/brindle-{name}-{uuid.uuid4().hex[:12]}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    _made.append(folder)
    return folder


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there and a lost executor costs nothing.

    ``files``: into how many at most, for tables known to be small.
    """
    spark = df.sparkSession
    path = f"{fresh_folder(spark, name)}/table"
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many folders there are so far, for :func:`remove_folders`."""
    return len(_made)


def remove_folders(spark: SparkSession, kept: tuple[DataFrame, ...] = (), since: int = 0) -> None:
    """Removes what this process made in the shared folder from its ``since``-th folder on, but for what ``kept`` reads.

    For results that are consumed: a frame that still reads a removed table fails.
    """
    files = {f for df in kept for f in df.inputFiles()}
    stay = [f for f in _made[since:] if any(_path(f) in x for x in files)]
    for folder in _made[since:]:
        if folder not in stay:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made[since:] = stay


def _path(folder: str) -> str:
    return folder.split(":", 1)[1].lstrip("/")
