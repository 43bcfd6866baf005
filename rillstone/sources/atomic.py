"""Small files and folders that appear whole or not at all, and never in place of another.

Everything is written aside first. ``publish`` then gives it its name in one step
that fails if the name is taken: a hard link or rename of the operating system for
local paths, elsewhere the file system's rename without overwriting. A writer that
dies leaves either nothing under the name, or all of it; what it left aside is
found by nobody.
"""

from __future__ import annotations

import errno
import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

from rillstone.scratch import filesystem


def _local(fs, path: str) -> str | None:
    """The path as the operating system knows it, None if it isn't local."""
    if fs.getUri().getScheme() != "file":
        return None
    return unquote(urlparse(path).path) if "://" in path or path.startswith("file:") else path


def publish(spark: SparkSession, staged: str, final: str) -> bool:
    """Moves the file or folder ``staged`` to ``final``; False (and ``staged`` is deleted) if ``final`` is there already."""
    fs, src = filesystem(spark, staged)
    _, dst = filesystem(spark, final)
    fs.mkdirs(dst.getParent())
    a, b = _local(fs, staged), _local(fs, final)
    try:
        if a is not None and b is not None:
            if os.path.isdir(a):
                os.rename(a, b)  # fails on a folder that holds something
            else:
                os.link(a, b)
                fs.delete(src, False)
        else:
            jvm = spark.sparkContext._jvm
            none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(src, dst, none)
    except OSError as e:
        if e.errno not in (errno.EEXIST, errno.ENOTEMPTY, errno.ENOTDIR):
            raise
        fs.delete(src, True)
        return False
    except Exception:
        if not fs.exists(dst):
            raise
        fs.delete(src, True)
        return False
    return True


def put(spark: SparkSession, folder: str, name: str, record: dict) -> bool:
    """Creates ``folder/name`` with ``record``, whole; False if it is there already."""
    staged = f"{folder}.tmp/{name}-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, staged)
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(record, default=str).encode()))
    out.close()
    return publish(spark, staged, f"{folder}/{name}")


def get(spark: SparkSession, path: str) -> dict | None:
    """The record at ``path``; None if it can't be read as one. Raises FileNotFoundError if nothing is there."""
    fs, p = filesystem(spark, path)
    try:
        stream = fs.open(p)
    except Exception:
        if fs.exists(p):
            raise
        raise FileNotFoundError(path) from None
    try:
        raw = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
    try:
        return json.loads(raw)
    except ValueError:
        return None


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in ``folder``, in order; none if it isn't there. Hidden files (checksums) are left out."""
    fs, p = filesystem(spark, folder)
    return sorted(n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(p) else []
