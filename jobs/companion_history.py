"""Keeps the history of files that change together by year, and the companions of each file over all years.

Reads commits (orders) and the files that they touch (lineitem). The years from first_year to last_year of the
config file are counted anew and replace what was there (dynamic partition overwrite); other years stay as
they are. Companions come from the counts of all years, so a nightly run recounts the running year only.
Run again over the same input, it writes the same rows. A year that has lost all its pairs keeps its old
ones: nothing is written for it.

Pairs are by far more than what they come from. So the lists of files are written once, for the time of the
run, and pairs are made from them for a few years at a time; the sums of all years are made for a part of the
pairs at a time. What a part has shuffled is dropped before the next begins. The lists are staged, so on a
cluster spark.checkpoint.dir has to be set.
"""

from __future__ import annotations

import os
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.operators.history import both_ways, companions, listed, paired
from deltaloom.operators.staging import dealt, held, stage, together, unstage
from jobs.common import counted, earlier, log, main

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "companion_history.json")
#: For a run: a query's shuffle files go when it ends, not when the driver happens to collect its garbage; lists are made of rows
#: that are sorted already; a join keeps to the parts that its sides are dealt out in, as it would take this number if that were larger.
HELD = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.replaceHashWithSortAgg": "true", "spark.sql.shuffle.partitions": "1"}
#: Years are counted together up to so many pairs (two files are one), larger ones alone; sums of more pairs are made in PARTS.
AT_ONCE, PARTS = 8_000_000, 2
PAIRS, COMPANIONS = "a long, b long, n long, year int", "a long, b long, n long, rank int"


def touched(orders: DataFrame, lineitem: DataFrame, first_year: int | None, last_year: int | None) -> DataFrame:
    """commit, path, year of the years asked for, dealt out by commit; the range reaches the scan as a filter on dates."""
    commits = orders.select(F.col("o_orderkey").alias("commit"), "o_orderdate")
    if first_year is not None:
        commits = commits.filter(F.col("o_orderdate") >= F.lit(f"{first_year:04}-01-01").cast("date"))
    if last_year is not None:
        commits = commits.filter(F.col("o_orderdate") < F.lit(f"{last_year + 1:04}-01-01").cast("date"))
    files = lineitem.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"))
    rows = lineitem.count() + orders.count()  # from the files' footers
    files, commits = dealt(files, rows, "commit"), dealt(commits, rows, "commit")
    return files.join(commits.hint("shuffle_hash"), "commit").select("commit", "path", F.year("o_orderdate").alias("year"))


def batches(pairs: dict[int | None, int]) -> list[list[int | None]]:
    """Years in turn, together as long as they have no more than AT_ONCE pairs; without any, a batch of none, which still makes the folder."""
    out, n = [], AT_ONCE
    for year in sorted(pairs, key=lambda y: (y is not None, y)):
        if not out or n + pairs[year] > AT_ONCE:
            out, n = [*out, []], 0
        out[-1].append(year)
        n += pairs[year]
    return out or [[]]


def recount(spark: SparkSession, files: DataFrame, output: str, settings: dict) -> int:
    """Counts the pairs of the years that files have, and replaces these years under output/pairs; returns how many there are."""
    lists = stage(listed(files, "commit", "path", settings["least"], settings["most"], by=("year",)), "lists", by=("year",))
    k = F.size("files").cast("long")
    likely = {r.year: r.n for r in lists.groupBy("year").agg(F.sum(k * (k - 1) / 2).cast("long").alias("n")).collect() if r.n}
    rows = 0
    for years in batches(likely):
        asked = lists.filter(reduce(or_, (F.col("year").eqNullSafe(F.lit(y)) for y in years), F.lit(False)))
        by = () if len(years) == 1 else ("year",)
        made = dealt(paired(asked, by), 2 * sum(likely[y] for y in years), "a", "b").groupBy("a", "b", *by).agg(F.count(F.lit(1)).alias("n"))
        # The year of one is a constant, so that rows need not be sorted by it to be written.
        pairs = both_ways(made, by).select("a", "b", "n", "year" if by else F.lit(years[0]).cast("int").alias("year"))
        pairs, seen = counted(pairs, "pairs")
        pairs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year").parquet(f"{output}/pairs")
        rows += seen.get["rows"]
    unstage(lists)
    return rows


def frequent(pairs: DataFrame, least: int) -> list[DataFrame]:
    """a, b, n of the pairs that all years together have `least` times; written in parts."""
    rows = pairs.count() // 2  # from the files' footers
    parts = PARTS if rows > AT_ONCE else 1
    once, out = pairs.filter("a < b"), []
    for i in range(parts):
        part = once.filter(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i)
        sums = dealt(part, rows // parts, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))
        out.append(stage(sums.filter(F.col("n") >= least), "frequent"))
    return out


def run(spark: SparkSession, orders: str, lineitem: str, output: str, settings: dict) -> dict:
    """Recounts the years asked for under output/pairs and then output/companions; returns counts of rows."""
    log.info("reading %s and %s, years %s to %s", orders, lineitem, settings["first_year"], settings["last_year"])
    with held(spark, HELD):
        files, rows_read = counted(touched(spark.read.parquet(orders), spark.read.parquet(lineitem), settings["first_year"], settings["last_year"]), "read")
        rows_paired = recount(spark, files, output, settings)
        often = frequent(earlier(spark, f"{output}/pairs", PAIRS), settings["together"])
        whole = together(*often)
        ranked = companions(dealt(both_ways(whole), 2 * whole.count(), "a"), top=settings["top"], least=settings["together"], share=settings["share"])
        best, rows_kept = counted(ranked.select("a", "b", "n", "rank"), "companions")
        best.write.mode("overwrite").partitionBy("rank").parquet(f"{output}/companions")
        unstage(*often)
    counts = {"read": rows_read.get["rows"], "pairs": rows_paired, "companions": rows_kept.get["rows"]}
    log.info("read %(read)s touched files, wrote %(pairs)s pairs and %(companions)s companions", counts)
    return counts


def read(spark: SparkSession, output: str) -> DataFrame:
    """The companions of all files."""
    return earlier(spark, f"{output}/companions", COMPANIONS)


if __name__ == "__main__":
    main("companion_history", ["orders", "lineitem", "output"], CONFIG, run)
