"""Partitioned append-only logs: names, writing, and reading from a position."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"(?P<prefix>.*?)(?P<hour>\d{4}-\d\d-\d\d_\d\d)\.(?P<partition>[^-/]+)(?:-(?P<remainder>\d+))?$")


@dataclass(frozen=True, order=True)
class LogFile:
    """A file of a log: hour, then remainder."""

    hour: str
    remainder: int = 0

    def name(self, partition: str, prefix: str = "", suffix: str = "") -> str:
        """``yyyy-MM-dd_HH.partition[-remainder]``; partitions have no dash."""
        if "-" in partition:
            raise ValueError(f"dash in partition {partition!r}")
        return f"{prefix}{self.hour}.{partition}" + (f"-{self.remainder}" if self.remainder else "") + suffix


def parse_name(name: str, suffix: str = "") -> tuple[str, LogFile] | None:
    """Partition and file of a name, None if it is no log's."""
    m = _NAME.match(name.removesuffix(suffix))
    return (m["partition"], LogFile(m["hour"], int(m["remainder"] or 0))) if m else None


def write_log(df: DataFrame, root: str, partition: Column, at: Column) -> None:
    """Appends rows under ``log_partition=.../hour=...``."""
    df.withColumns({"log_partition": partition, "hour": F.date_format(at, "yyyy-MM-dd_HH")}).write.mode("append").partitionBy("log_partition", "hour").parquet(root)


def read_log(spark: SparkSession, root: str, partitions: list[str] | None = None, after: dict[str, str] | None = None, upto: str | None = None, tolerant: bool = False) -> DataFrame:
    """Rows of the log in hours after each partition's position (a partition without one is read whole) up to ``upto``.

    Conditions are on partition columns, so other folders aren't opened.
    ``tolerant`` passes over files that can't be read, such as one cut short.
    """
    df = spark.read.option("ignoreCorruptFiles", str(tolerant).lower()).parquet(root).withColumns({"log_partition": F.col("log_partition").cast("string"), "hour": F.col("hour").cast("string")})
    if partitions is not None:
        df = df.where(F.col("log_partition").isin(partitions))
    for p, hour in (after or {}).items():
        df = df.where((F.col("log_partition") != p) | (F.col("hour") > hour))
    return df.where(F.col("hour") <= upto) if upto else df


def files(spark: SparkSession, root: str) -> dict[str, dict[str, str]]:
    """Partition -> ``hour=.../file`` -> path of the files there are, by listing alone."""
    out: dict[str, dict[str, str]] = {}
    for path in map(unquote, spark.read.parquet(root).inputFiles()):
        part, hour, name = path.rsplit("/", 3)[1:]
        out.setdefault(unquote(part.removeprefix("log_partition=")), {})[f"{hour}/{name}"] = path
    return out


def hour_of(file: str) -> str:
    """The hour of a name in ``files``."""
    return file.split("/")[0].removeprefix("hour=")


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """Rows of exactly these files of the log, whatever else has come meanwhile."""
    schema = spark.read.parquet(root).schema  # the partitions' types don't depend on which files are read
    df = spark.read.schema(schema).option("basePath", root).parquet(*paths)
    return df.withColumns({"log_partition": F.col("log_partition").cast("string"), "hour": F.col("hour").cast("string")})


def positions(spark: SparkSession, root: str) -> dict[str, str]:
    """The last hour of each partition: from folder names and file footers alone."""
    rows = spark.read.parquet(root).groupBy(F.col("log_partition").cast("string").alias("p")).agg(F.max(F.col("hour").cast("string")).alias("h")).collect()  # one row a partition
    return {r["p"]: r["h"] for r in rows}
