"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import gc
import hashlib
import os
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

#: Rows that a Python worker handles at once inside one Arrow batch.
SLICE_ROWS = 256

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of our own only where none is named and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        named = "/tmp/checkpoints/deltaloom"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read, not the stages above. The folder goes when `unstage` is
    called, or with the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/deltaloom-{uuid.uuid4().hex}-{name}"
    if not _staged:
        atexit.register(_clear)
    _staged.append((spark, path))
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files behind earlier tables
    df.write.mode("errorifexists").partitionBy(*partition_by or []).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def scanned(df: DataFrame) -> DataFrame:
    """df if its plan only reads files, selects and filters, so that rows come in one order whenever it is run;
    else df as a written table. For operators that read a table twice and number what they read."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter", "LogicalRelation", "LocalRelation") and not node.nodeName().startswith("Relation"):
            return stage(df, "scanned")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return df


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of the last query too, before a large one that is the last.

    That query is still held by the event queue for a moment, so a second collection follows.
    """
    gc.collect()
    for pause in (0.8, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def unstage(*tables: DataFrame) -> None:
    """Drop staged tables that nothing lazy reads any more."""
    for df in tables:
        for item in [x for x in _staged if x[1] == getattr(df, "_staged_at", None)]:
            _staged.remove(item)
            _delete(*item)


def _clear() -> None:
    while _staged:
        spark, path = _staged.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has gone first; the cluster's own clean-up takes the folder
            return


def text_key(text: Column) -> Column:
    """A 64-bit key of a text (null counts as empty), to tell rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def texts_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text only, whatever other columns docs has."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def shielded(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """docs with neutral column names, so that none clashes with an operator's own; the neutral name of a
    column; and what selects the columns again under their names."""
    names = docs.columns
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    return plain, lambda name: f"_c{names.index(name)}", lambda df: df.select(*(F.col(f"_c{i}").alias(name) for i, name in enumerate(names)))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def listed(column: pa.Array) -> list:
    """The values of an Arrow column as Python objects, by way of numpy where that keeps them as they are."""
    if column.null_count and not (pa.types.is_binary(column.type) or pa.types.is_string(column.type)):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def annotate(docs: DataFrame, text: str, keep: list[str], fields: list[tuple[str, pa.DataType]], make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The columns `keep` of docs, unchanged, and new columns that are made from whole texts.

    A kept column with the name of a new one is a ValueError, also in the operators that are made of this.
    make() is called once a task; its result takes a list of texts (or nulls) and returns one list or
    array for each of `fields`. No shuffle: rows stay in their partitions, and Arrow passes the kept
    columns through.
    """
    clash = [n for n, _ in fields if n in keep]
    if clash:
        raise ValueError(f"columns of the input clash with results: {clash}")
    hidden = text not in keep
    source = docs.select(*keep, *([text] if hidden else []))
    at = source.columns.index(text)
    out = T.StructType([source.schema[c] for c in keep] + [T.StructField(n, from_arrow_type(t)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        work = make()
        for part in slices(batches):
            new = work(part.column(at).cast(pa.string()).to_pylist())
            columns = [part.column(i) for i in range(len(keep))] + [pa.array(x, t) for x, (_, t) in zip(new, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(n for n, _ in fields)])

    return source.mapInArrow(run, out)


def one_core() -> None:
    """Executors count cores themselves: keep native libraries to one thread a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)
