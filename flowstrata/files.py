"""File metadata operations through the cluster's Hadoop file system.

Only names and sizes pass through the driver, never file contents (except the
small JSON notes written by table jobs).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def qualify(spark: SparkSession, path: str) -> str:
    """The path as Spark reports it in file metadata."""
    return _fs(spark, path).makeQualified(_path(spark, path)).toString()


def children(spark: SparkSession, path: str) -> Iterator[tuple[str, bool]]:
    """Names and is-directory flags of the direct children."""
    if not exists(spark, path):
        return
    entries = _fs(spark, path).listStatusIterator(_path(spark, path))
    while entries.hasNext():
        entry = entries.next()
        yield entry.getPath().getName(), entry.isDirectory()


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a file, or a directory with its contents."""
    return _fs(spark, path).delete(_path(spark, path), True)


def move(spark: SparkSession, source: str, target: str) -> bool:
    fs = _fs(spark, target)
    fs.mkdirs(_path(spark, target).getParent())
    return fs.rename(_path(spark, source), _path(spark, target))


def make_dirs(spark: SparkSession, path: str) -> None:
    _fs(spark, path).mkdirs(_path(spark, path))


# Names the current version below a versioned document.
POINTER = "current.txt"


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file over another in one step; a reader finds the old or the new one."""
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark._sc._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _path(spark, qualify(spark, target)).toUri(), spark._jsc.hadoopConfiguration()
    )
    context.rename(_path(spark, qualify(spark, source)), _path(spark, qualify(spark, target)), options)


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file under a temporary name, then renames it over the old one."""
    fs = _fs(spark, path)
    partial = path + ".tmp"
    stream = fs.create(_path(spark, partial), True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    replace(spark, partial, path)


def read_note(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def listing(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """``path, directory, size`` of all data files below a root, listed by Spark.

    The content column is not selected, so no file is opened.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    return found.select(
        "path",
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory"),
        F.col("length").alias("size"),
    )


def contents(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """``path, directory, content`` of all data files below a root, read by Spark as wholes."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    return found.select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory"), "content")
