"""First-wins, top-k and budgets per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`; an aggregate, so a hot key is combined before the shuffle.

    Null keys are a key of their own. `order` should end in a unique column.
    """
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*rows.columns)


def ranked(rows: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Rows with their place 1.. in each group."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank; Spark limits groups before the shuffle."""
    return ranked(rows, keys, order, rank).filter(F.col(rank) <= k)


def with_totals(rows: DataFrame, totals: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Adds total and dropped (beyond k) of each group, counted before any cap."""
    return rows.join(totals, keys, "left").withColumn("dropped", F.greatest(F.col("total") - k, F.lit(0)))


def within_budget(rows: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: int, least: int = 1) -> DataFrame:
    """The longest prefix of each group whose costs sum up to at most `budget`, with the running cost.

    Taking the last one off while too much is left equals this prefix, as costs are positive. A row costs
    `least` at least, so no more than budget / least rows of a group can be in it: the others are gone
    before the shuffle, and a group is as small as that for the task that sums it up.
    """
    rows = top_k(rows, keys, order, budget // least, "_place").drop("_place")
    running = F.sum(cost).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("running", running).filter(F.col("running") <= budget)
