"""Shared scratch space: cuts lineage by writing a table all executors can read again.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset and
the driver is the only machine (tests, a laptop) a local folder is used and set; on
a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session. Raises RuntimeError if none is named and there are executors besides the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir isn't set; with master {master} it must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rillstone-")
        spark.conf.set("spark.checkpoint.dir", base)
        _made[base] = spark
    return base.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder, deleted when the session's process ends."""
    path = f"{shared_dir(spark)}/rillstone/{tag}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path; a failure only leaves the files behind."""
    try:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)
    except Exception:
        pass
    _made.pop(path, None)


class Cut:
    """A written table: ``df`` reads it, ``drop`` removes it once nothing needs it."""

    def __init__(self, df: DataFrame, tag: str, by: tuple[str, ...] = ()):
        self.spark = df.sparkSession
        self.path = new_dir(self.spark, tag)
        (df.write.partitionBy(*by) if by else df.write).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop(self.spark, self.path)


def cut(df: DataFrame, tag: str = "cut", by: tuple[str, ...] = ()) -> Cut:
    """Writes ``df`` to the shared folder, in a folder for each value of ``by``. A lost executor loses nothing of it."""
    return Cut(df, tag, by)


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
        except Exception:
            pass
