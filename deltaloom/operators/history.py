"""What commits change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.operators.staging import dealt


def co_changes(commit_files: DataFrame, commit: str, path: str, least: int = 2, most: int = 30, by: tuple[str, ...] = (), sparse: bool = False) -> DataFrame:
    """a, b, n: how often two files are in one commit of `least` to `most` files, for each value of the
    columns `by` (which are a commit's own, such as its year).

    Larger commits are gone before pairs are made: at most `most` rows for each row. A task takes the
    commits of about ROWS pairs, which are counted first (from above: repeated rows count), and not what is a
    handy number of bytes before they are paired. Two files are one pair until it is counted, and two rows
    then. sparse: most pairs come once, so they are dealt to tasks of bounded size as they are; else they are
    combined before the shuffle.
    """
    rows = commit_files.select(F.col(commit).alias("_c"), F.col(path).alias("_p"), *by).filter("_c is not null")
    k = F.least(F.col("k"), F.lit(most))
    likely = rows.groupBy("_c").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(k * (k - 1)).alias("n")).first()["n"]
    pairs = paired(listed(dealt(rows, likely, "_c"), "_c", "_p", least, most, by), by)
    pairs = dealt(pairs, likely, "a", "b") if sparse else pairs
    return both_ways(pairs.groupBy("a", "b", *by).agg(F.count(F.lit(1)).alias("n")), by)


def listed(commit_files: DataFrame, commit: str, path: str, least: int = 2, most: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """files, by: the files of each commit of `least` to `most`, sorted and each once. A null counts as a file and is in no list.

    Of a larger commit no task holds more than most + 1 files.
    """
    ranked = commit_files.withColumn("_k", F.dense_rank().over(W.partitionBy(commit).orderBy(path))).filter(F.col("_k") <= most + 1)
    lists = ranked.groupBy(commit).agg(F.array_sort(F.collect_set(path)).alias("files"), F.max("_k").alias("_k"), *(F.min(c).alias(c) for c in by))
    return lists.filter(F.col("_k").between(least, most)).select("files", *by)


def paired(lists: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """a, b, by: a row for each commit and each two of its files, of which a is the lesser."""
    at = lists.select(F.posexplode("files").alias("_i", "a"), "files", *by)
    return at.select("a", F.explode(F.slice("files", F.col("_i") + 2, F.size("files"))).alias("b"), *by)


def both_ways(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counted pairs, and each the other way round."""
    return pairs.select(F.stack(F.lit(2), "a", "b", "b", "a").alias("a", "b"), *by, "n")


def companions(pairs: DataFrame, changed: DataFrame | None = None, top: int = 3, least: int = 3, share: float = 0.4) -> DataFrame:
    """Of each a its `top` most frequent b; of those the frequent ones that the change leaves out.

    The limit comes before the conditions, so a frequent file that changed takes a place. Pairs below `least`
    come after all others of their a, so they are gone before the ranks are made.
    """
    by_a = W.partitionBy("a").orderBy(F.desc("n"), "b")
    ranked = pairs.filter(F.col("n") >= least).withColumn("rank", F.row_number().over(by_a)).withColumn("most", F.first("n").over(by_a))
    kept = ranked.filter((F.col("rank") <= top) & (F.col("n") >= share * F.col("most"))).drop("most")
    return kept.join(changed.select(F.col("path").alias("b")).distinct(), "b", "left_anti") if changed is not None else kept
