"""Small records as files of their own that exactly one of several writers can create."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file with this text unless it is there already; whether it was created.

    The text is written under another name first and then moved to ``path`` by a step that fails if that exists: a hard link in a
    local folder, a rename without overwriting elsewhere (atomic in HDFS). A reader sees the whole text or no file."""
    jvm = spark._jvm
    fs, final = _fs(spark, path)
    if fs.exists(final):
        return False
    draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(place(final), place(draft))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, none)
        return True
    except Exception:
        if fs.exists(final):  # another writer was first
            return False
        raise
    finally:
        fs.delete(draft, False)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the records ``<number>.json`` in a folder, ascending."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def unbroken(found: list[int]) -> int:
    """How far the numbers run from 1 without a gap."""
    return next((k for k, n in enumerate(found) if n != k + 1), len(found))


def append_numbered(spark: SparkSession, folder: str, text_of) -> int:
    """Create the record with the next number, its text from ``text_of(number)``; of writers that meet, the others take the next."""
    n = unbroken(numbers(spark, folder)) + 1
    while not publish(spark, f"{folder}/{n:012d}.json", text_of(n)):
        n += 1
    return n
