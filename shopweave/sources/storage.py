"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that names none, as in tests, gets a new folder.

    A cluster's session must name one: a folder of the driver alone is lost to the executors.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads; none if there is no such folder."""
    system, folder = _folder(spark, path)
    return [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        system, folder = _folder(spark, path)
        system.delete(folder, True)


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Put the folder ``source`` in the place of ``target``, which may not exist."""
    system, folder = _folder(spark, target)
    system.delete(folder, True)
    system.mkdirs(folder.getParent())
    if not system.rename(_folder(spark, source)[1], folder):
        raise OSError(f"{source} could not be moved to {target}")


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; fails if there is one."""
    system, file = _folder(spark, path)
    out = system.create(file, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def mark() -> int:
    """The tables made so far; see :func:`release`."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete what this process has stored in the shared folder since ``mark()``; for when its results are written elsewhere."""
    gone = [p for p in _made[since:] if p not in keep]
    _made[since:] = [p for p in _made[since:] if p in keep]
    remove(spark, *gone)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
