"""Interval ownership: which span holds a point, innermost first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.operators.staging import dealt, stage


def owning_span(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, order: list[Column], keep: list[str], cell: int = 64) -> DataFrame:
    """Each point with the columns `keep` of the least span by `order` that holds it (nulls: none).

    Spans are dealt to cells of `cell` units, so the join is an equi join on keys and cell: a key with
    very many spans is not compared with all of its points. The winner is an aggregate, not a window,
    so it is combined before the shuffle.
    """
    tagged = points.select(*keys, at).distinct()
    cells = spans.filter(F.col(start) <= F.col(end)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), *(F.col(k).alias(f"k_{k}") for k in keep))
    right = cells.select(*(F.col(k).alias(f"_s_{k}") for k in keys), "_cell", F.col(start).alias("_start"), F.col(end).alias("_end"), rank.alias("_rank"))
    on = [F.col(k) == F.col(f"_s_{k}") for k in keys] + [F.floor(F.col(at) / cell) == F.col("_cell"), F.col(at).between(F.col("_start"), F.col("_end"))]
    best = tagged.join(right, on).groupBy(*keys, at).agg(F.min("_rank").alias("_best"))
    owned = best.select(*keys, at, *(F.col(f"_best.k_{k}").alias(k) for k in keep))
    return points.join(owned, [*keys, at], "left")


def running_at(events: DataFrame, asked: DataFrame, keys: list[str], at: str, value: str, cell: int = 4096, running: str = "running") -> DataFrame:
    """The rows asked with `running`: the sum of the values of all events of their keys up to their place, it included; 0 for none.

    Events and questions go along one line together. The line is cut into cells of `cell` units, which are
    dealt to tasks by number of rows; what lies before a cell is one more event at its start. So sums run inside
    of cells, no key's whole line is one task's, and questions keep their columns instead of being looked up again.
    """
    ask = asked.withColumn("_at", F.col(at).cast("long")).withColumn("_v", F.lit(0).cast("long")).withColumn("_ask", F.lit(True))
    tell = events.select(*keys, F.col(at).cast("long").alias("_at"), F.col(value).cast("long").alias("_v")).filter(F.col("_at").isNotNull())
    place = F.floor(F.col("_at") / cell)
    slim = ask.select(*keys, "_at", "_v").unionByName(tell)
    cells = stage(slim.groupBy(*keys, place.alias("_cell")).agg(F.sum("_v").alias("_t"), F.count(F.lit(1)).alias("_n")), "cells")
    before = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    carry = cells.select(*keys, (F.col("_cell") * cell).alias("_at"), F.sum("_t").over(before).alias("_v")).filter("_v <> 0 and _at is not null")
    line = ask.unionByName(tell, allowMissingColumns=True).unionByName(carry, allowMissingColumns=True).withColumn("_cell", place)
    line = dealt(line, cells.agg(F.sum("_n")).first()[0], *keys, "_cell")
    upto = W.partitionBy(*keys, "_cell").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    return line.withColumn(running, F.sum("_v").over(upto)).filter("_ask").select(*asked.columns, running)


def _looked_up(rows: DataFrame, running: DataFrame, keys: list[str], place: Column, at: str, name: str) -> DataFrame:
    """rows with the running sum at a place of theirs, 0 where it is null."""
    right = running.select(*(F.col(k).alias(f"_r_{k}") for k in keys), F.col(at).alias("_r_at"), F.col("running").alias(name))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [place.cast("long") == F.col("_r_at")]
    return rows.join(right, on, "left").drop(*(f"_r_{k}" for k in keys), "_r_at").withColumn(name, F.coalesce(name, F.lit(0)))


def coverage(spans: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str, name: str = "points", cell: int = 4096) -> DataFrame:
    """spans with the number of distinct points of their keys that lie in them, ends included.

    What lies up to the end, less what lies before the start: one sweep and two equi joins, however many
    spans and points a key has. Spans that end before they start, or lack an end, hold none.
    """
    events = points.select(*keys, at).distinct().withColumn("_one", F.lit(1))
    ends = spans.select(*keys, (F.col(start) - 1).cast("long").alias(at)).unionByName(spans.select(*keys, F.col(end).cast("long").alias(at))).distinct()
    running = running_at(events, ends, keys, at, "_one", cell)
    both = _looked_up(_looked_up(spans, running, keys, F.col(start) - 1, at, "_before"), running, keys, F.col(end), at, "_upto")
    count = F.when(F.col(start) <= F.col(end), F.col("_upto") - F.col("_before")).otherwise(0)
    return both.withColumn(name, count.cast("long")).drop("_before", "_upto")


def depth(points: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str, at: str, name: str = "depth", cell: int = 4096) -> DataFrame:
    """points with the number of spans of their keys that they lie in: spans begun less spans ended, by one sweep."""
    good = spans.filter(F.col(start) <= F.col(end))
    begun = good.select(*keys, F.col(start).alias(at), F.lit(1).alias("_step"))
    ended = good.select(*keys, (F.col(end) + 1).alias(at), F.lit(-1).alias("_step"))
    return running_at(begun.unionByName(ended), points, keys, at, "_step", cell, name)
