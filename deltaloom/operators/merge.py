"""Merging findings of several layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.scalars import finding_key, severity_rank
from deltaloom.operators.ranking import first_wins


def without_neighbours(rows: DataFrame, taken: DataFrame, key: str, line: str, reach: int = 1) -> DataFrame:
    """Rows that no row of `taken` of the same key is within `reach` lines of; null lines stay.

    The lines taken are widened by `reach` first, so it is an equi anti join without a range condition.
    """
    wide = taken.filter(F.col(line).isNotNull()).select(F.col(key).alias("_key"), F.explode(F.array(*(F.col(line) + d for d in range(-reach, reach + 1)))).alias("_line")).distinct()
    return rows.join(wide, (F.col(key) == F.col("_key")) & (F.col(line) == F.col("_line")), "left_anti")


def postprocessed(findings: DataFrame, floor: float, order: str = "ord", keys: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """Findings at or above the floor, the first by `order` of each place and title (whatever its case and outer white space)."""
    kept = findings.filter(F.col("confidence") >= floor).withColumn("_title", finding_key(F.col("title")))
    return first_wins(kept, [*keys, "_title"], [order]).drop("_title")


def report_order() -> list:
    """Worst first, then surest, then by place."""
    return [F.desc(severity_rank(F.col("severity"))), F.desc("confidence"), F.asc("file"), F.asc(F.coalesce("line", F.lit(0))), F.asc("ord")]
