"""Small files in shared folders: listing, reading, and publishing so that a second writer notices the first."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, p = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def newest(spark: SparkSession, folder: str) -> int:
    """The highest number N of files N.json in a folder; 0 if there are none."""
    names = (n.removesuffix(".json") for n in listed(spark, folder) if n.endswith(".json"))
    return max((int(n) for n in names if n.isdigit()), default=0)


def numbered(folder: str, number: int) -> str:
    return f"{folder}/{number:012d}.json"


def rename(spark: SparkSession, source, target) -> None:
    """Give a Hadoop path another name, which must not exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.NONE
    hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, how)


def publish(spark: SparkSession, path: str, text: str, move: Callable | None = None) -> bool:
    """Write a file in one step; False, and nothing is changed, if it exists already.

    The text goes to another name first, and a rename that never replaces gives it its own. An object store without such
    a rename needs a single writer.
    """
    fs, made = _fs(spark, f"{path.rsplit('/', 1)[0]}/new-{uuid4().hex}")
    out = fs.create(made)
    out.write(bytearray(text.encode()))
    out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        move(made, target) if move else rename(spark, made, target)
    except Py4JJavaError as error:
        fs.delete(made, False)
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise
    return True
