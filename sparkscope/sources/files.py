"""Small files of the store, in whatever file system Spark keeps its tables in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    system, p = _system(spark, path)
    if not system.exists(p):
        return None
    stream = system.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the old file and put it in its place by one rename."""
    system, new = _system(spark, f"{path}.new")
    stream = system.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(new), system.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path)), how)


def names(spark: SparkSession, path: str) -> list[str]:
    system, p = _system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(p)) if system.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    system, p = _system(spark, path)
    system.delete(p, True)


def make_folder(spark: SparkSession, path: str) -> None:
    system, p = _system(spark, path)
    system.mkdirs(p)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder."""
    system, p = _system(spark, path)
    return system.getContentSummary(p).getLength()
