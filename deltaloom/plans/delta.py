"""Contract changes between two revisions of the changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.operators.intervals import coverage

#: Decorators that change how a definition is used.
CONTRACT_DECORATORS = ("property", "staticmethod", "classmethod", "cached_property")
_NONE = "untyped"


def _texts(*parts: Column) -> Column:
    """The non-null ones of some optional texts."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def _flat(parts: list[Column]) -> Column:
    return F.flatten(F.array(*parts))


def _names(params: Column, *kinds: str) -> Column:
    kept = F.filter(params, lambda p: p["kind"].isin(*kinds)) if kinds else params
    return F.transform(kept, lambda p: p["name"])


def _shown(x: Column) -> Column:
    return F.coalesce(x, F.lit(_NONE))


def _param_changes(old: Column, new: Column) -> Column:
    """array<struct<text, breaking>>: removed parameters, then added ones, then changed ones, by position."""
    pair = lambda text, breaking: F.struct(text.alias("text"), breaking.alias("breaking"))
    old_names, new_names = _names(old), _names(new)
    removed = F.transform(F.filter(old, lambda p: ~F.array_contains(new_names, p["name"])), lambda p: pair(F.concat(F.lit("takes no longer: "), p["name"]), F.lit(True)))
    added = F.transform(
        F.filter(new, lambda p: ~F.array_contains(old_names, p["name"])),
        lambda p: F.when(p["has_default"] | p["kind"].isin("vararg", "kwarg"), pair(F.concat(F.lit("takes if given: "), p["name"]), F.lit(False))).otherwise(
            pair(F.concat(F.lit("must now be given: "), p["name"]), F.lit(True))
        ),
    )

    def changes(o: Column, n: Column) -> Column:
        name = o["name"]
        default = (
            F.when(o["has_default"] & ~n["has_default"], pair(F.concat(name, F.lit(": default removed")), F.lit(True)))
            .when(~o["has_default"] & n["has_default"], pair(F.concat(name, F.lit(": default added ("), F.coalesce(n["default"], F.lit("None")), F.lit(")")), F.lit(False)))
            .when(~o["default"].eqNullSafe(n["default"]), pair(F.concat(name, F.lit(": default "), F.coalesce(o["default"], F.lit("None")), F.lit(" -> "), F.coalesce(n["default"], F.lit("None"))), F.lit(False)))
        )
        kind = F.when(o["kind"] != n["kind"], pair(F.concat(name, F.lit(": "), o["kind"], F.lit(" -> "), n["kind"]), F.lit(True)))
        typed = F.when(~o["annotation"].eqNullSafe(n["annotation"]), pair(F.concat(name, F.lit(": type "), _shown(o["annotation"]), F.lit(" -> "), _shown(n["annotation"])), F.lit(False)))
        return F.filter(F.array(kind, default, typed), lambda x: x.isNotNull())

    common = F.filter(old, lambda p: F.array_contains(new_names, p["name"]))
    changed = F.flatten(F.transform(common, lambda o: changes(o, F.get(F.filter(new, lambda n: n["name"] == o["name"]), F.lit(0)))))
    return _flat([removed, added, changed])


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """repo, path, qualname and delta: kind, breaking, details, behavior, went_async, both signatures.

    old and new are definition tables (first definition of each qualified name, reached by direct
    bodies). A name in one of them only is added or removed. Details come by parameter position.
    """
    keys = ["repo", "path", "qualname"]
    columns = ["is_class", "signature", "is_async", "decorators", "returns", "params", "raises", "generator", "shapes"]
    side = lambda df, tag: df.select(*keys, F.struct(*columns).alias(tag))
    both = side(old, "o").join(side(new, "n"), keys, "full_outer")
    o, n = F.col("o"), F.col("n")
    function = ~o["is_class"] & ~n["is_class"]
    none = F.array().cast("array<struct<text: string, breaking: boolean>>")
    params = F.when(function, _param_changes(o["params"], n["params"])).otherwise(none)
    order = lambda x, y: F.filter(_names(x, "posonly", "arg"), lambda a: F.array_contains(_names(y, "posonly", "arg"), a))
    moved = function & (order(o["params"], n["params"]) != order(n["params"], o["params"]))
    toggled = function & (o["is_async"] != n["is_async"])
    listed = lambda x: F.when(F.size(x) == 0, "[]").otherwise(F.concat(F.lit("["), F.array_join(x, ", "), F.lit("]")))
    decorated = o["decorators"] != n["decorators"]
    swapped = F.concat(F.array_except(o["decorators"], n["decorators"]), F.array_except(n["decorators"], o["decorators"]))
    breaking_decorator = decorated & F.arrays_overlap(swapped, F.array(*map(F.lit, CONTRACT_DECORATORS)))
    rest = _texts(
        F.when(moved, "positional parameter order changed"),
        F.when(function & ~o["returns"].eqNullSafe(n["returns"]), F.concat(F.lit("return type "), _shown(o["returns"]), F.lit(" -> "), _shown(n["returns"]))),
        F.when(toggled, "sync/async changed: every call site needs an await added or removed"),
        F.when(decorated, F.concat(F.lit("decorators "), listed(o["decorators"]), F.lit(" -> "), listed(n["decorators"]))),
    )
    details = F.concat(F.transform(params, lambda x: x["text"]), rest)
    gen = function & (o["generator"] != n["generator"])
    more, fewer = F.array_except(n["raises"], o["raises"]), F.array_except(o["raises"], n["raises"])
    behaviour = F.when(
        function,
        _texts(
            F.when(gen & n["generator"], "function -> generator: every call site now gets a generator object"),
            F.when(gen & ~n["generator"], "generator -> function: every call site now gets a plain value"),
            F.when(F.size(more) > 0, F.concat(F.lit("now raises: "), F.array_join(F.array_sort(more), ", "))),
            F.when(F.size(fewer) > 0, F.concat(F.lit("no longer raises: "), F.array_join(F.array_sort(fewer), ", "))),
            F.when(~o["generator"] & ~n["generator"] & (o["shapes"] != n["shapes"]), F.concat(F.lit("return shape changed: "), F.array_join(o["shapes"], " | "), F.lit(" -> "), F.array_join(n["shapes"], " | "))),
        ),
    ).otherwise(F.array().cast("array<string>"))
    contract = (F.size(details) > 0) | (o["signature"] != n["signature"])
    kind = F.when(o.isNull(), "added").when(n.isNull(), "removed").when(contract, "signature_changed").otherwise("body_only")
    breaking = F.exists(params, lambda x: x["breaking"]) | moved | toggled | breaking_decorator
    empty = F.array().cast("array<string>")
    return both.select(
        *keys,
        kind.alias("kind"),
        F.when(o.isNull(), False).when(n.isNull(), True).when(contract, breaking | gen).otherwise(gen).alias("breaking"),
        F.when(o.isNull(), F.array(F.lit("new definition"))).when(n.isNull(), F.array(F.lit("nothing of this name is left"))).when(F.size(details) > 0, details).when(contract, F.array(F.lit("the signature is written differently"))).otherwise(empty).alias("details"),
        F.when(o.isNull() | n.isNull(), empty).otherwise(behaviour).alias("behavior"),
        F.coalesce(toggled & n["is_async"], F.lit(False)).alias("went_async"),
        o["signature"].alias("old_signature"),
        n["signature"].alias("new_signature"),
    )


def is_contract_change() -> Column:
    """A change that callers can notice, over columns kind and behavior."""
    return F.col("kind").isin("removed", "signature_changed") | (F.size("behavior") > 0)


def lost_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    """repo, path, qualname, field, line: data attributes of a class that it no longer answers to in any way."""
    keys = ["repo", "path", "qualname"]
    had = old.filter("is_class").select(*keys, F.explode("fields").alias("f")).select(*keys, F.col("f.name").alias("field"), F.col("f.line").alias("line"))
    has = new.filter("is_class").select(*keys, "exposed")
    return had.join(has, keys).filter(~F.array_contains("exposed", F.col("field"))).drop("exposed")


def removed_symbols(old: DataFrame, surviving: DataFrame, touched: DataFrame) -> DataFrame:
    """Functions and methods of the old revision that are gone, whose lines the diff touched; parts of a
    removed definition are left to it.

    old: symbols of changed files at the base; surviving: symbols of the new tree; touched: (repo, path,
    line) of the old side.
    """
    keys = ["repo", "path", "qualname"]
    gone = old.filter("kind <> 'class'").join(surviving.select(*keys), keys, "left_anti")
    hit = coverage(gone, touched, ["repo", "path"], "start_lineno", "end_lineno", "line", "_touched").filter("_touched > 0").drop("_touched")
    # Definitions around a name are its dotted prefixes: an equi anti join, not a prefix test.
    parts = F.split("qualname", r"\.")
    around = hit.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("outer")).filter("outer <> qualname")
    inner = around.join(hit.select("repo", "path", F.col("qualname").alias("outer")), ["repo", "path", "outer"], "left_semi").select(*keys).distinct()
    return hit.join(inner, keys, "left_anti")
