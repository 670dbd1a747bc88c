"""Scoring findings against golden places, one to one and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.operators.staging import stage, unstage

TOLERANCE = 2


def first_come(pairs: DataFrame, keys: list[str], taker: str, place: str) -> DataFrame:
    """keys, taker, place: what comes out if takers, in ascending order, each take the first place left of those they fit.

    pairs: keys, taker and place of all that fit; takers and places are numbered within their keys.
    In rounds instead of one after the other: every taker asks for the first place that it has not lost, and
    each place goes to the first that asks. A place only ever passes to an earlier taker, so whoever comes
    after its holder has lost it. When nobody loses anything, the holders are those of the sequential
    order: the first taker always gets its first place, and by induction each next one the first
    left. Rounds are as many as the longest chain of takers that push each other on; a group of any size is spread.
    """
    left = stage(pairs.select(*keys, taker, place).distinct(), "pairs")
    count = left.count()
    while True:
        asks = left.groupBy(*keys, taker).agg(F.min(place).alias(place))
        held = asks.groupBy(*(F.col(k).alias(f"_{k}") for k in [*keys, place])).agg(F.min(taker).alias("_holder"))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, place]]
        kept = stage(left.join(held, on, "left").filter(F.col("_holder").isNull() | (F.col(taker) <= F.col("_holder"))).select(*keys, taker, place), "pairs")
        now = kept.count()
        unstage(left)
        left = kept
        if now == count:
            return left.groupBy(*keys, taker).agg(F.min(place).alias(place))
        count = now


def _numbered(rows: DataFrame, group: str, columns: list[str], name: str) -> DataFrame:
    """rows with a place in their order, made of all their columns, so that no two of a group have the same."""
    known = rows.select(group, *columns)
    copies = W.partitionBy(group, *columns).orderBy(F.lit(0))
    return known.withColumn("_copy", F.row_number().over(copies)).withColumn(name, F.struct(*columns, "_copy"))


def fitting(findings: DataFrame, golden: DataFrame, group: str) -> DataFrame:
    """group, file, taker, place: golden places of the same group and file as a finding, within TOLERANCE lines, whose
    keyword is in its text (in any case). Both are told by all that they have, `ord` first.

    Lines of golden places are widened first, so it is an equi join.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("detail", F.lit(""))))
    found = _numbered(findings.filter(F.col("line").isNotNull()), group, ["ord", "file", "line", "title", "detail"], "taker").select(group, "file", "line", "taker", text.alias("_text"))
    near = F.explode(F.array(*(F.col("line") + d for d in range(-TOLERANCE, TOLERANCE + 1)))).alias("line")
    wide = _numbered(golden, group, ["ord", "path", "line", "keyword"], "place").select(F.col(group).alias("_group"), F.col("path").alias("file"), F.lower(F.coalesce("keyword", F.lit(""))).alias("_word"), "place", near)
    both = found.join(wide, (F.col(group).eqNullSafe(F.col("_group"))) & (found["file"] == wide["file"]) & (found["line"] == wide["line"]))
    return both.filter(F.contains("_text", F.col("_word"))).select(group, found["file"], "taker", "place")


def greedy_match(findings: DataFrame, golden: DataFrame, group: str) -> DataFrame:
    """group, tp, fp, fn: findings in their order take the first golden place that is left of those they fit."""
    matched = first_come(fitting(findings, golden, group), [group, "file"], "taker", "place")
    count = lambda df, tp, fp, fn: df.select(group, *(F.lit(n).cast("long").alias(c) for c, n in (("tp", tp), ("fp", fp), ("fn", fn))))
    every = count(findings, 0, 1, 0).unionAll(count(golden, 0, 0, 1)).unionAll(count(matched, 1, -1, -1))
    return every.groupBy(group).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def precision_recall(scores: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over all groups; empty denominators give 1, 1 and 0."""
    total = scores.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    return total.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))
