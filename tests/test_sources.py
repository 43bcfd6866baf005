"""Files, sorted assertions, observations, placement, grid pages, a broken log."""

import pytest
from pyspark.sql import functions as F

from rillstone.operators import crdt
from rillstone.operators import datasets as D
from rillstone.plans import grid
from rillstone.scratch import filesystem, new_dir
from rillstone.sources import logs
from rillstone.sources.files import Files, read_bytes


def test_files(spark):
    f = Files(spark, new_dir(spark, "files"))
    f.upload("a.log", b"hello")
    f.upload("a.log", b"hello world")
    f.upload("sub/b.log", b"\x00\xff")
    f.copy("a.log", "c.txt")
    assert f.list() == {"a.log": 11, "c.txt": 11} and f.list("*.log") == {"a.log": 11} and f.subfolder("sub").list() == {"b.log": 2}
    assert f.move("c.txt", "d.txt") and f.list("*.txt") == {"d.txt": 11}
    assert bytes(read_bytes(spark, f.root, "a.log", 6, 3).collect()[0]["bytes"]) == b"wor"
    assert {bytes(r["bytes"]) for r in read_bytes(spark, f.root).collect()} == {b"hello world", b"\x00\xff"}
    assert f.delete("*.txt") == 1 and f.list("*.txt") == {}


def test_cast_to_sorted(spark):
    df = D.repartition_sort(spark.range(100), "id", partitions=3)
    assert D.cast_to_sorted(df, "id").count() == 100
    with pytest.raises(Exception, match="isn't sorted"):
        D.cast_to_sorted(spark.range(10).orderBy(F.desc("id")).coalesce(1), "id").collect()


def test_observe(spark):
    df, seen = D.observe(spark.range(10), "numbers", total=F.sum("id"))
    df.collect()
    assert seen.get == {"items": 10, "total": 45}


def test_placed(spark):
    s = crdt.Store({"v": F.max}, D.of(spark, [(str(i), i, 0) for i in range(40)], "key string, v int, ts int"))
    assert s.placed(["a", "b", "c"], 2).count() == 80


def test_grid(spark):
    df = D.of(spark, [(i, f"n{i % 3}", i % 5) for i in range(20)], "id int, name string, v int")
    p = grid.page(df, ["id", "v"], "id", {"name": F.col("name") != "n0"}, {"v": False}, 1, 3, [0, 4])
    got = [tuple(r) for r in p.collect()]
    assert got[:3] == [(14, 4), (19, 4), (8, 3)] and sorted(got[3:]) == [(0, 0), (4, 4)]


def test_broken_log_file(spark):
    root = new_dir(spark, "log")
    logs.write_log(spark.range(5), root, F.lit("p"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    fs, path = filesystem(spark, f"{root}/log_partition=p/hour=2024-01-01_01/part-0.parquet")
    out = fs.create(path)
    out.write(bytearray(b"PAR1 cut short"))
    out.close()
    assert logs.read_log(spark, root, tolerant=True).count() == 5
    with pytest.raises(Exception):
        logs.read_log(spark, root).collect()
