"""Scans texts as they arrive for what a reviewer has to see, and reports each finding once.

A file stream takes the Parquet files that its checkpoint does not know, all that are there (availableNow).
Lines are held against the rules of the config file. Proven findings own their lines and the neighbours;
hints elsewhere stay; of findings alike in place and title the first rule's is kept; what an earlier batch has
reported is left out. Findings are written by batch and severity. A batch that is run again, after a
failure or for lack of its commit, overwrites its own partitions with the same rows. `files_per_batch` bounds
a batch, so that a first run over very many files is taken in steps that a failure can't undo.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import partial, reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.functions.scalars import finding_key, split_lines, token_estimate
from deltaloom.operators.merge import postprocessed, without_neighbours
from jobs.common import counted, earlier, log, main

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "scan_texts.json")
SCHEMA = "file string, line int, ord int, title string, layer string, confidence double, excerpt string, tokens long, batch long, severity string"


def _hit(line: Column, rule: dict, ord_: int, excerpt: int) -> Column:
    """What a rule finds in a line, with the matches themselves left out of the excerpt."""
    shown = F.substring(F.regexp_replace(line, rule["pattern"], "[...]"), 1, excerpt)
    values = {"ord": F.lit(ord_), "title": F.lit(rule["title"]), "layer": F.lit(rule["layer"]), "severity": F.lit(rule["severity"]), "confidence": F.lit(float(rule["confidence"])), "excerpt": shown}
    return F.when(line.rlike(rule["pattern"]), F.struct(*(v.alias(k) for k, v in values.items())))


def _same_in_re2(pattern: str) -> bool:
    """Whether Arrow's RE2 finds a pattern in the same lines as Spark does.

    So it is for literals, classes, groups and repetitions; escapes, flags, lookaround and classes made of classes may differ.
    """
    if re.search(r"\\|\(\?|&&|\[\^?\]|\[[^]]*\[", pattern):
        return False
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return False
    return True


def _any_of(patterns: list[str]) -> Callable[[Column], Column]:
    @F.arrow_udf("boolean")
    def found(lines: pa.Array) -> pa.Array:
        return reduce(pc.or_, (pc.match_substring_regex(lines, p) for p in patterns))

    return found


def _worth(line: Column, settings: dict) -> Column:
    """Whether any rule that reaches the floor finds something in a line.

    Few lines have a hit, and Java's patterns are slow while several take turns in all threads of an executor: RE2 reads a
    line once for all rules that mean the same to it, and only what is left meets the rules one by one.
    """
    patterns = [r["pattern"] for r in settings["rules"] if r["confidence"] >= settings["floor"]]
    same = [p for p in patterns if _same_in_re2(p)]
    one = "|".join(f"({p})" for p in same)
    tests = [line.rlike(p) for p in patterns if p not in same]
    if same:
        tests.append(_any_of([one] if _same_in_re2(one) else same)(F.make_valid_utf8(line)))
    return reduce(or_, tests, F.lit(False))


def hits(documents: DataFrame, settings: dict) -> DataFrame:
    """file, line, tokens, ord, title, layer, severity, confidence, excerpt: all that the rules find in whole texts (null: nothing)."""
    file = F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string"))
    lines = documents.select(file.alias("file"), F.posexplode(split_lines(F.col("text"))).alias("at", "text")).filter(_worth(F.col("text"), settings))
    found = F.array_compact(F.array(*(_hit(F.col("text"), r, i, settings["excerpt"]) for i, r in enumerate(settings["rules"]))))
    rows = lines.select("file", (F.col("at") + 1).alias("line"), token_estimate(F.col("text")).alias("tokens"), F.explode(found).alias("hit"))
    return rows.select("file", "line", "tokens", "hit.*").filter(F.col("confidence") >= settings["floor"])


def findings(found: DataFrame, settings: dict) -> DataFrame:
    """Hits without hints beside proven ones, and the first rule's of those that are alike."""
    proven, hints = found.filter("layer = 'proof'"), found.filter("layer <> 'proof'")
    merged = proven.unionByName(without_neighbours(hints, proven, "file", "line", settings["reach"]))
    return postprocessed(merged, settings["floor"])


def _write(batch: DataFrame, number: int, output: str, settings: dict, counts: list[dict]) -> None:
    spark = batch.sparkSession
    read, rows_read = counted(batch, f"read-{number}")
    # Texts are scanned once, for two layers of findings; what is held is the hits, not the texts.
    found = hits(read, settings).persist()
    key = ["file", "line", finding_key(F.col("title")).alias("key")]
    reported = earlier(spark, output, SCHEMA).filter(F.col("batch") < number).select(*key)
    new = findings(found, settings).withColumn("key", finding_key(F.col("title"))).join(reported, ["file", "line", "key"], "left_anti").drop("key")
    new, rows_written = counted(new.withColumn("batch", F.lit(number).cast("long")), f"written-{number}")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "severity").parquet(output)
    found.unpersist()
    counts.append({"batch": number, "read": rows_read.get["rows"], "written": rows_written.get["rows"]})
    log.info("batch %s: read %s documents, wrote %s findings to %s", number, counts[-1]["read"], counts[-1]["written"], output)


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict) -> dict:
    """Scans the documents that have arrived since the last run; returns counts of the batches that it ran."""
    schema, counts = spark.read.parquet(documents).schema, []
    log.info("reading new files of %s", documents)
    # As a pattern, the path may be one file as well as a folder of files.
    reader = spark.readStream.schema(schema)
    if settings["files_per_batch"]:
        reader = reader.option("maxFilesPerTrigger", settings["files_per_batch"])
    stream = reader.parquet(f"{documents[:-1]}[{documents[-1]}]")
    query = stream.writeStream.foreachBatch(partial(_write, output=output, settings=settings, counts=counts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    total = {"batches": len(counts), "read": sum(c["read"] for c in counts), "written": sum(c["written"] for c in counts)}
    log.info("done: %s", total)
    return total


def read(spark: SparkSession, output: str) -> DataFrame:
    """All findings so far."""
    return earlier(spark, output, SCHEMA)


if __name__ == "__main__":
    main("scan_texts", ["documents", "output", "checkpoint"], CONFIG, run)
