"""Cutting lineage by written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task takes of a table that is dealt out by `dealt`.
ROWS = 500_000
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder of our own only where it is unset and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        named = "/tmp/checkpoints/deltaloom"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str = "stage", by: tuple[str, ...] = ()) -> DataFrame:
    """df, written as Parquet (a folder for each value of `by`) and read back: a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/deltaloom-{uuid.uuid4().hex}-{name}"
    if not _written:
        atexit.register(clear)
    _written.append((spark, path))
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dealt(df: DataFrame, rows: int | None, *by: str) -> DataFrame:
    """df in parts of about ROWS rows by the columns `by`, whatever size its rows have in a shuffle.

    Coalescing goes by bytes before a step makes more rows of them; a task's memory would grow with the table.
    """
    return df.repartition(max(1, -(-int(rows or 0) // ROWS)), *by)


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for a while, and are then what they were."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def together(*tables: DataFrame) -> DataFrame:
    """Written tables of one schema as one scan, instead of a union of as many."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t._written_at for t in tables))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unstage(*tables: DataFrame) -> None:
    """Drop written tables that nothing lazy reads any more, so that a driver that lives long fills no disk."""
    for df in tables:
        for item in [x for x in _written if x[1] == getattr(df, "_written_at", None)]:
            _written.remove(item)
            _delete(*item)


def clear() -> None:
    """Drop all written tables; those of a session that has ended stay to the cluster's own clean-up."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001
            return
