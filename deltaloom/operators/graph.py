"""Graphs as edge tables: closures, depth-limited walks, PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.operators.staging import stage, together

#: Levels of a closure that are one job and one written table.
LEVELS = 3


def descendants(starts: DataFrame, edges: DataFrame, start: str = "start", child: str = "child", parent: str = "parent", stops: DataFrame | None = None) -> DataFrame:
    """start, node, depth: everything below each start, over any number of levels, each node once at its least depth.

    stops (start, node) end a walk: they are reached, but not what is only below them. Cycles end where they
    meet what is known. LEVELS levels are one job and one written table, so plans don't grow with
    depth, and a chain of n levels takes n / LEVELS jobs. Distances from the starts only are kept: a table
    of all distances, as doubling needs, grows with the square of a chain.
    """
    down = edges.select(F.col(parent).alias("_up"), F.col(child).alias("_down")).distinct()
    frontier = stage(starts.select(F.col(start).alias("start"), F.col(start).alias("node")).distinct(), "frontier")
    seen, depth, out = frontier, 0, None
    while True:
        front, known, new = frontier, seen, None
        for _ in range(LEVELS):
            depth += 1
            open_ = front if stops is None else front.join(stops.select("start", "node"), ["start", "node"], "left_anti")
            front = open_.join(down, F.col("node") == F.col("_up")).select("start", F.col("_down").alias("node")).distinct().join(known, ["start", "node"], "left_anti")
            known = known.unionAll(front)
            level = front.withColumn("depth", F.lit(depth))
            new = level if new is None else new.unionAll(level)
        new = stage(new, "levels")
        out = new if out is None else out.unionAll(new)
        frontier = new.filter(F.col("depth") == depth).select("start", "node")
        if frontier.isEmpty():
            return out
        seen = seen.unionAll(new.select("start", "node"))


def ancestors(starts: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """start, node, depth, path: upward walks of at most `most` steps over edges (child, parent, position).

    path holds the positions taken; in the order of paths a walk comes before what is beyond it, which is
    the order of a depth-first search.
    """
    up = edges.select(F.col("child").alias("_child"), F.col("parent").alias("_parent"), F.col("position").cast("int").alias("_position"))
    level = starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path"))
    out = level
    for depth in range(1, most + 1):
        level = level.join(up, F.col("node") == F.col("_child")).select("start", F.col("_parent").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("_position")).alias("path"))
        if depth % 3 == 0:
            level = stage(level, "level")
        out = out.unionAll(level)
    return out


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 25, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, score after a fixed number of iterations; parallel edges count, self-loops don't, the mass of
    nodes without out-edges is spread evenly.

    The iteration is linear: scores are a sum of the vectors v_k that k steps along the edges make of the
    uniform vector, with factors that depend on the vectors' sums only. So each step is one join and
    one aggregation, without a scalar in between, and factors are worked out at the end from as many numbers
    as there are iterations. A step is one job and one written table: plans of many steps, with all their
    stages, are held by the driver. An empty vector ends the walk, as all that follow are empty too.
    """
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null")
    counted = stage(pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c")), "edges")
    nodes = stage(counted.select(F.col("src").alias("node")).unionAll(counted.select(F.col("dst").alias("node"))).distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    counted = counted.filter("src <> dst")
    out = counted.groupBy("src").agg(F.sum("c").alias("d"))
    weighted = stage(counted.join(out, "src").select("src", "dst", (F.col("c") / F.col("d")).alias("w")), "weights")
    vector, every = nodes.select("node", F.lit(1.0 / n).alias("v")), []
    for k in range(1, iterations + 1):
        step = weighted.join(vector, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
        written = stage(step.select(F.col("dst").alias("node"), "v", F.lit(k).alias("k")), "vector")
        if written.isEmpty():
            break
        every.append(written)
        vector = written.select("node", "v")
    if not every:
        return nodes.withColumn("score", F.lit(1.0 / n))
    every = together(*every)
    mass = {r["k"]: r["m"] for r in every.groupBy("k").agg(F.sum("v").alias("m")).collect()}
    factor = [1.0] + [0.0] * iterations
    for _ in range(iterations):
        moved = sum(factor[k] * mass.get(k + 1, 0.0) for k in range(iterations))
        factor = [damping * (1 - moved) + 1 - damping, *(damping * f for f in factor[:-1])]
    weight = F.element_at(F.array(*map(F.lit, factor[1:])), F.col("k"))
    sums = every.groupBy("node").agg(F.sum(F.col("v") * weight).alias("s"))
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("s", F.lit(0.0)) + factor[0] / n).alias("score"))
