"""Linking files: class hierarchy, resolved calls, ambiguous copies, drops.

An edge exists only with evidence: an exact target, an inherited method, a dotted tail that only one
definition has, or a name that the calling file's imports support.
"""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.scalars import owner_name, short_name
from deltaloom.operators.evidence import FANOUT, import_evidence, longest_prefix, suffix_matches
from deltaloom.operators.graph import ancestors
from deltaloom.operators.ranking import first_wins, ranked
from deltaloom.operators.staging import stage

# Names that say nothing about what is called, and bases outside of any repository.
PROTOCOL_METHODS = """
get set add append extend insert remove pop clear update items keys values copy
read write close flush seek tell send recv connect start stop run join split
strip encode decode count index find replace sort reverse
put acquire release wait notify cancel result submit
""".split()
OUTSIDE_BASES = ("object", "Exception", "ABC", "Protocol", "Enum", "Generic", "NamedTuple", "TypedDict", "BaseModel")
BUILTINS = sorted(dir(builtins))
MAX_DEPTH = 8


def numbered(table: DataFrame) -> DataFrame:
    """Adds key (repo, path, ord): the order of files by path and of rows in a file."""
    return table.withColumn("key", F.struct("path", "ord"))


def symbols_with_names(symbols: DataFrame) -> DataFrame:
    return numbered(symbols).withColumn("fqname", F.concat_ws(".", "module", "qualname")).withColumn("short", short_name(F.col("qualname")))


def by_fqname(symbols: DataFrame) -> DataFrame:
    """The first definition of each full name."""
    return first_wins(symbols, ["repo", "fqname"], ["key"])


def importable(asks: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """repo, path, short, c_fqname, c_key: the definitions of a short name that a file has itself, or that are in a
    module that the file's imports give evidence of.

    asks: distinct (repo, path, short). The modules of the file's evidence come first, so names meet by
    module and name: a name that a whole repository has is as cheap as any.
    """
    of = definitions.select("repo", "short", F.col("module").alias("c_module"), F.col("path").alias("c_path"), F.col("fqname").alias("c_fqname"), F.col("key").alias("c_key"))
    proof = import_evidence(imports, ["repo", "path"], module="c_module")
    columns = ["repo", "path", "short", "c_fqname", "c_key"]
    far = asks.join(proof, ["repo", "path"]).join(of, ["repo", "c_module", "short"]).select(columns)
    own = asks.join(of.withColumnRenamed("c_path", "path"), ["repo", "path", "short"]).select(columns)
    return far.unionByName(own).distinct()


def answers(asks: DataFrame, definitions: DataFrame, imports: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """repo, path, short, n, c_fqname: what `importable` finds, for the asks that have at most `fanout` candidates.

    A file's definitions of one name are counted before they meet the asks, and more than `fanout` are never
    listed, so what is joined grows with asks and imports, not with how often a name is defined.
    """
    ask, place = ["repo", "path", "short"], ["repo", "c_module", "c_path", "short"]
    of = definitions.select("repo", F.col("module").alias("c_module"), F.col("path").alias("c_path"), "short", F.col("fqname").alias("c_fqname"), F.col("key").alias("c_key")).distinct()
    first = ranked(of, place, [F.col("c_key")], "_rank").withColumn("_name", F.when(F.col("_rank") <= fanout, F.col("c_fqname")))
    groups = stage(first.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), F.collect_list("_name").alias("_names")), "definitions")
    proof = import_evidence(imports, ["repo", "path"], module="c_module").join(groups.select("repo", "c_module").distinct(), ["repo", "c_module"], "left_semi")

    def near(groups: DataFrame, *more: str) -> DataFrame:
        far = asks.join(proof, ["repo", "path"]).join(groups, ["repo", "c_module", "short"]).filter(~F.col("c_path").eqNullSafe(F.col("path")))
        own = asks.join(groups.withColumn("path", F.col("c_path")), ask)
        return far.select(*ask, *more).unionByName(own.select(*ask, *more))

    few = near(groups, "_n").groupBy(*ask).agg(F.sum("_n").alias("n")).filter(F.col("n") <= fanout)
    return near(groups.filter(F.col("_n") <= fanout), "_names").join(few, ask).select(*ask, "n", F.explode("_names").alias("c_fqname"))


def hierarchy(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """repo, child, parent, position: base classes in the same module first, else the only one that imports support."""
    classes = symbols.filter("kind = 'class'")
    raw = classes.select("repo", "path", "module", F.col("fqname").alias("child"), "key", F.posexplode("bases").alias("position", "raw")).withColumn("short", short_name(F.col("raw")))
    raw = raw.filter(~F.col("short").isin(*OUTSIDE_BASES))
    known = by_fqname(symbols).filter("kind = 'class'").select("repo", F.col("fqname").alias("parent"))
    local = raw.withColumn("parent", F.concat_ws(".", "module", "short")).join(known, ["repo", "parent"], "left_semi").select("repo", "child", "key", "position", "parent")
    rest = raw.join(local.select("repo", "child", "key", "position"), ["repo", "child", "key", "position"], "left_anti")
    only = answers(rest.select("repo", "path", "short").distinct(), classes, imports, 1).withColumnRenamed("c_fqname", "parent")
    one = rest.drop("parent").join(only, ["repo", "path", "short"]).select("repo", "child", "key", "position", "parent")
    return local.unionByName(one).groupBy("repo", "child", "position").agg(F.min("parent").alias("parent"))


def _named(repo: str, name: str) -> Column:
    """Names of one repository and others apart."""
    return F.concat_ws("\x00", F.col(repo), F.col(name))


def inherited(targets: DataFrame, table: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, target, found: the method that a class inherits, for targets `Class.method` that it doesn't define.

    Upward walks of at most MAX_DEPTH steps; of several definitions, the first of a depth-first search.
    """
    classes = table.filter("kind = 'class'").select("repo", F.col("fqname").alias("class"))
    asked = targets.select("repo", "target", owner_name(F.col("target")).alias("class"), short_name(F.col("target")).alias("method")).distinct().join(classes, ["repo", "class"], "left_semi")
    starts = asked.select(_named("repo", "class").alias("start")).distinct()
    up = edges.select(_named("repo", "child").alias("child"), _named("repo", "parent").alias("parent"), "position")
    walks = ancestors(starts, up, MAX_DEPTH).withColumn("repo", F.substring_index("start", "\x00", 1)).withColumn("class", F.substring_index("start", "\x00", -1)).withColumn("at", F.substring_index("node", "\x00", -1))
    methods = table.select("repo", F.col("fqname").alias("found"))
    hits = asked.join(walks.select("repo", "class", "at", "path"), ["repo", "class"]).withColumn("found", F.concat_ws(".", "at", "method")).join(methods, ["repo", "found"], "left_semi")
    return first_wins(hits.select("repo", "target", "found", "path"), ["repo", "target"], ["path"]).select("repo", "target", "found")


def link(calls: DataFrame, symbols: DataFrame, imports: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(linked, dropped).

    linked: the calls with `callee` (full name) and `tag` (how it was bound; ambiguous copies have a row for
    each candidate). dropped: calls of a known name without a binding, counted as too ambiguous.
    """
    table = by_fqname(symbols)
    calls = numbered(calls)
    on = ["repo", "target"]
    # What a target alone decides is found for distinct targets; calls meet it in one join.
    targets, known = stage(calls.select(*on).distinct(), "targets"), table.select("repo", F.col("fqname").alias("target"))
    rest = targets.join(known, on, "left_anti")
    up = stage(inherited(rest, table, edges), "inherited")
    methods = symbols.filter(F.instr("qualname", ".") > 0).groupBy("repo", "qualname").agg(F.count(F.lit(1)).alias("n"), F.min("fqname").alias("callee"))
    ends = suffix_matches(rest.join(up.select(*on), on, "left_anti"), methods, ["repo"], "target", "qualname")
    tails = ends.groupBy(*on).agg(F.sum("n").alias("n"), F.min("callee").alias("callee")).filter("n = 1").select(*on, "callee", F.lit(True).alias("tail"))
    named = targets.join(known, on, "left_semi").withColumn("callee", F.col("target")).unionByName(up.withColumnRenamed("found", "callee")).withColumn("tail", F.lit(False))
    bound = stage(named.unionByName(tails), "bound")

    direct = calls.join(bound.filter("not tail"), on)
    # Written, as many joins below start from it; so are the outcomes.
    rest = stage(calls.drop("key").join(bound, on, "left").filter("tail is null or tail").drop("tail"), "open-calls")
    rest = numbered(rest).withColumn("short", short_name(F.col("target")))
    builtin = (F.col("resolution") == "name") & F.col("short").isin(*BUILTINS)
    protocol = F.col("resolution").isin("attr", "typed") & F.col("short").isin(*PROTOCOL_METHODS)
    silent = rest.filter(builtin | protocol)
    open_ = rest.filter(~(builtin | protocol))

    by_tail, free = open_.filter("callee is not null"), open_.filter("callee is null").drop("callee")
    ask = ["repo", "path", "short"]
    told = stage(answers(free.select(*ask).distinct(), symbols, imports), "outcomes")
    near = free.join(told.withColumnRenamed("c_fqname", "callee"), ask)

    own = lambda df, tag=F.col("resolution"): df.select(*calls.columns, "callee", tag.alias("tag"))
    linked = own(direct).unionByName(own(by_tail)).unionByName(own(near, F.when(F.col("n") == 1, F.col("resolution")).otherwise("ambiguous")))
    ids = ["repo", "key"]
    # A call is lost if its outcome is: no id is looked up among all that are linked.
    tried = free.join(symbols.select("repo", "short").distinct(), ["repo", "short"], "left_semi")
    lost = tried.join(told.select(*ask).distinct(), ask, "left_anti").select(*ids).unionByName(silent.select(*ids))
    return linked, lost


def depends(imports: DataFrame, files: DataFrame) -> DataFrame:
    """repo, path, target, module: the module of the repository that each import leads to, the longest that the target
    is in; imports of what is outside are left out."""
    known = files.select("repo", "module").distinct()
    return longest_prefix(imports.select("repo", "path", "target").distinct(), known, ["repo"], "target", "module").filter(F.col("module").isNotNull())


def statistics(parsed: DataFrame, symbols: DataFrame, calls: DataFrame, linked: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row a repository: files, unparsable, symbols, edges, resolved, targets, too_ambiguous."""
    files = parsed.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("unparsable"))
    parts = [
        symbols.groupBy("repo").agg(F.count(F.lit(1)).alias("symbols")),
        calls.groupBy("repo").agg(F.count(F.lit(1)).alias("edges")),
        linked.groupBy("repo").agg(F.count(F.lit(1)).alias("resolved"), F.count_distinct("callee").alias("targets")),
        dropped.groupBy("repo").agg(F.count(F.lit(1)).alias("too_ambiguous")),
    ]
    for p in parts:
        files = files.join(p, "repo", "left")
    return files.na.fill(0)
