"""Small files and listings through Spark's own file systems, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; nothing where there is none."""
    place, fs = _place(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def file_bytes(spark: SparkSession, folder: str) -> dict[str, int]:
    """Path and size of every data file below a folder; hidden files and folders are left out."""
    place, fs = _place(spark, folder)
    found, stack = {}, [place] if fs.exists(place) else []
    while stack:
        for status in fs.listStatus(stack.pop()):
            name = status.getPath().getName()
            if not name.startswith((".", "_success", "_SUCCESS")):
                if status.isDirectory():
                    stack.append(status.getPath())
                else:
                    found[status.getPath().toString()] = status.getLen()
    return found


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str:
    place, fs = _place(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Write a small file; without ``replace`` only where none is, and tell whether it was written."""
    place, fs = _place(spark, path)
    try:
        stream = fs.create(place, replace)
    except Exception:
        if not replace and fs.exists(place):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True
