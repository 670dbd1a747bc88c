"""The parsed index as a Parquet table: files that didn't change aren't parsed again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.sources.python_code import parsed

VERSION = 2


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)


def current(spark: SparkSession, store: str) -> str | None:
    """Where the rows of the store are now, or None if it has none: what the pointer names."""
    fs, path = _fs(spark, store), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(path(f"{store}/CURRENT")):
        return None
    stream = fs.open(path(f"{store}/CURRENT"))
    try:
        name = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
    return f"{store}/{name}" if name.startswith(f"v{VERSION}-") else None


def refreshed(spark: SparkSession, files: DataFrame, store: str | None) -> DataFrame:
    """Parse results of files (repo, path, module, src, mtime, size): those that the store has with equal
    mtime, size and module are read, the others parsed; unparsable files are tried again each time."""
    marks = ["repo", "path", "module", "mtime", "size"]
    at = current(spark, store) if store else None
    if at is None:
        return parsed(files).join(files.select("repo", "path", "mtime", "size"), ["repo", "path"])
    known = spark.read.parquet(at)
    hit = known.filter("error is null").join(files.select(marks), marks, "left_semi")
    miss = files.join(hit.select(marks), marks, "left_anti")
    return hit.unionByName(parsed(miss).join(miss.select("repo", "path", "mtime", "size"), ["repo", "path"]))


def save(rows: DataFrame, store: str) -> None:
    """Makes these rows the store's, without unparsable files; rows may come from the store itself.

    They are written beside the old ones, then a new pointer replaces the old one in one step, and the
    old rows go last: a job that is lost in between leaves either the old store or the new one. A file in
    the directory keeps it out of version control.
    """
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path, old = jvm.org.apache.hadoop.fs.Path, current(spark, store)
    name = f"v{VERSION}-{uuid.uuid4().hex}"
    rows.filter(F.col("error").isNull()).write.parquet(f"{store}/{name}")
    fs = _fs(spark, store)

    def put(file: str, text: str) -> None:
        stream = fs.create(path(f"{store}/{file}"), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    put(".gitignore", "*\n")
    put(f"{name}.pointer", name)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    where = fs.makeQualified(path(store))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(path(where, f"{name}.pointer"), path(where, "CURRENT"), options)
    if old:
        fs.delete(path(old), True)
