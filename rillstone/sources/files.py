"""Files of any Hadoop file system: bytes as rows, and upkeep by glob."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.scratch import filesystem


def read_bytes(spark: SparkSession, root: str, glob: str = "*", offset: int = 0, length: int | None = None) -> DataFrame:
    """``path, size, modified, bytes`` of the files whose name matches; ``bytes`` from ``offset`` on, at most ``length``."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    part = F.col("content") if not offset and length is None else F.substring("content", offset + 1, length if length is not None else (1 << 31) - 1)
    return df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), part.alias("bytes"))


class Files:
    """Listing, copying, moving and deleting below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs, _ = filesystem(spark, self.root)
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _path(self, name: str):
        return self._Path(f"{self.root}/{name}")

    def list(self, glob: str = "*") -> dict[str, int]:
        """Names below ``root`` that match, with their sizes."""
        found = self._fs.globStatus(self._path(glob)) or []
        base = self._fs.makeQualified(self._Path(self.root)).toString()
        return {s.getPath().toString().removeprefix(base + "/"): s.getLen() for s in found if s.isFile()}

    def upload(self, name: str, data: bytes) -> None:
        """Written aside and renamed: a reader sees all of it or nothing."""
        staged = self._path(f".{name.replace('/', '_')}.part")
        out = self._fs.create(staged, True)
        out.write(bytearray(data))
        out.close()
        self._fs.mkdirs(self._path(name).getParent())
        self._fs.delete(self._path(name), False)
        self._fs.rename(staged, self._path(name))

    def copy(self, name: str, to: str) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(name), self._fs, self._path(to), False, conf)

    def move(self, name: str, to: str) -> bool:
        return self._fs.rename(self._path(name), self._path(to))

    def delete(self, glob: str) -> int:
        names = self.list(glob)
        for n in names:
            self._fs.delete(self._path(n), False)
        return len(names)

    def subfolder(self, name: str) -> Files:
        return Files(self.spark, f"{self.root}/{name}")
