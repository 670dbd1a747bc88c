"""Proof rules: which call sites, overrides and readers provably break."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.operators.graph import descendants
from deltaloom.operators.merge import postprocessed
from deltaloom.operators.ranking import first_wins
from deltaloom.operators.staging import stage as write_stage
from deltaloom.plans import delta as D
from deltaloom.plans import link as L
from deltaloom.sources import diffs as S
from deltaloom.sources import python_code as P

# Decorators that rewrap a signature; matched at the start of the text.
REWRAPPERS = ("contextmanager", "lru_cache", "cache", "singledispatch", "singledispatchmethod", "pytest.fixture", "fixture", "click.", "app.route")
FINDING = ["repo", "file", "line", "symbol", "severity", "category", "title", "detail", "confidence", "suggestion", "origin", "ord"]


def bind_problems(params: Column, is_method: Column, static: Column, resolution: Column, positional: Column, keywords: Column, star: Column, double_star: Column, attribute: Column) -> Column:
    """Texts of provable binding failures, in a fixed order of rules; empty where a call binds or might.

    All of it is higher-order functions over the parameter array, so it stays in the JVM.
    """
    implicit = is_method & (F.size(params) > 0) & F.get(params, F.lit(0))["name"].isin("self", "cls") & ~static
    bound = attribute | (resolution == "self")
    ps = F.when(implicit & bound, F.slice(params, 2, F.greatest(F.size(params) - 1, F.lit(0)))).otherwise(params)
    names = lambda *kinds: F.transform(F.filter(ps, lambda p: p["kind"].isin(*kinds)), lambda p: p["name"])
    places = names("posonly", "arg")
    filled = F.slice(places, 1, positional)
    any_of = lambda kind: F.exists(ps, lambda p: p["kind"] == kind)
    given = F.array_distinct(keywords)
    none = F.array().cast("array<string>")
    said = lambda xs, before, after: F.transform(xs, lambda x: F.concat(F.lit(before), x, F.lit(after)))
    too_many = F.when(
        ~star & ~any_of("vararg") & (positional > F.size(places)),
        F.array(F.concat(F.lit("passes "), positional.cast("string"), F.lit(" positional argument(s) where at most "), F.size(places).cast("string"), F.lit(" are taken"))),
    ).otherwise(none)
    strict = ~any_of("kwarg")
    unknown = F.when(strict, said(F.array_sort(F.array_except(given, names("arg", "kwonly"))), "passes unexpected keyword argument `", "`")).otherwise(none)
    by_name = F.when(strict, said(F.array_sort(F.array_intersect(given, names("posonly"))), "passes positional-only parameter `", "` as a keyword")).otherwise(none)
    needed = F.filter(ps, lambda p: p["kind"].isin("posonly", "arg", "kwonly") & ~p["has_default"] & ~F.array_contains(filled, p["name"]) & ~((p["kind"] != "posonly") & F.array_contains(given, p["name"])))
    missing = F.when(~star & ~double_star, said(F.transform(needed, lambda p: p["name"]), "is missing required argument `", "`")).otherwise(none)
    # A keyword of a positional-only parameter's name goes to **kwargs where there are any.
    named = F.when(strict, filled).otherwise(F.filter(filled, lambda x: F.array_contains(names("arg"), x)))
    twice = said(F.filter(named, lambda x: F.array_contains(given, x)), "passes `", "` both positionally and as a keyword")
    return F.when(implicit & ~bound, none).otherwise(F.concat(too_many, unknown, by_name, missing, twice))


@dataclass
class Index:
    """Tables of the new tree, and of the changed files at the base."""

    files: DataFrame
    parsed: DataFrame
    symbols: DataFrame
    calls: DataFrame
    reads: DataFrame
    shapes: DataFrame
    definitions: DataFrame
    edges: DataFrame
    linked: DataFrame
    dropped: DataFrame
    old_symbols: DataFrame
    old_definitions: DataFrame
    old_files: DataFrame
    diffs: DataFrame
    keep: Callable[[DataFrame], DataFrame]


def build_index(old: DataFrame, new: DataFrame, diffs: DataFrame | None = None, stage=write_stage, parse=P.parsed) -> Index:
    """Parses and links two snapshots (repo, path, src) once; `stage` writes parse results, `parse` may take them from a store."""
    keep = stage
    diffs = keep(S.file_diffs(diffs if diffs is not None else S.snapshot_diffs(old, new)))
    code = F.col("path").endswith(".py")
    new, old = new.filter(code), old.filter(code)
    files = P.with_modules(new)
    parsed = keep(parse(files)).select(*P.COLUMNS)
    # At the base, only changed files matter; a renamed file is parsed under its new path.
    changed = diffs.filter(~F.col("binary")).select("repo", F.col("path").alias("new_path"), F.coalesce("old_path", "path").alias("path"))
    before = P.with_modules(old).join(changed, ["repo", "path"]).withColumn("path", F.col("new_path")).drop("new_path")
    moved = files.select("repo", "path", F.col("module").alias("new_module"))
    before = before.join(moved, ["repo", "path"], "left").withColumn("module", F.coalesce("new_module", "module")).drop("new_module")
    parsed_old = keep(P.parsed(before))
    symbols = L.symbols_with_names(P.table_of(parsed, "symbols"))
    imports = P.table_of(parsed, "imports").select("repo", "path", "target")
    calls = P.table_of(parsed, "calls")
    edges = L.hierarchy(symbols, imports)
    linked, dropped = L.link(calls, symbols, imports, edges)
    return Index(files, parsed, symbols, calls, P.table_of(parsed, "reads"), P.table_of(parsed, "shapes"), P.table_of(parsed, "definitions"), edges, keep(linked), dropped, L.symbols_with_names(P.table_of(parsed_old, "symbols")), P.table_of(parsed_old, "definitions"), before.select("repo", "path", "src"), diffs, keep)


def touched_symbols(ix: Index) -> DataFrame:
    """Symbols of the new tree that own a touched line: the innermost function or method, else the innermost class."""
    from deltaloom.operators.intervals import owning_span

    lines = ix.diffs.filter("status <> 'D' and not `binary`").select("repo", "path", "status", F.explode("new_lines").alias("line"))
    spans = ix.symbols.withColumn("is_class", (F.col("kind") == "class").cast("int")).withColumn("span", F.col("end_lineno") - F.col("start_lineno"))
    owned = owning_span(lines, spans, ["repo", "path"], "line", "start_lineno", "end_lineno", [F.col("is_class"), F.col("span"), F.col("ord")], ["qualname"])
    return owned.filter("qualname is not null").select("repo", "path", "qualname", "status").distinct()


def changed_symbols(ix: Index) -> DataFrame:
    """Touched symbols with their definition's delta (body_only where no direct definition has the name)."""
    deltas = D.compared(ix.old_definitions, ix.definitions.join(ix.diffs.select("repo", "path"), ["repo", "path"], "left_semi"))
    first = first_wins(ix.symbols, ["repo", "path", "qualname"], ["ord"])
    empty = F.array().cast("array<string>")
    out = touched_symbols(ix).join(first.withColumnRenamed("kind", "symbol_kind"), ["repo", "path", "qualname"]).join(deltas, ["repo", "path", "qualname"], "left")
    return out.withColumns({"kind": F.coalesce("kind", F.lit("body_only")), "breaking": F.coalesce("breaking", F.lit(False)), "details": F.coalesce("details", empty), "behavior": F.coalesce("behavior", empty), "went_async": F.coalesce("went_async", F.lit(False))})


def _finding(symbol: Column, file: Column, line: Column, severity: str, title: Column, detail: Column, confidence: float, suggestion: str) -> list[Column]:
    return [
        F.col("repo"),
        file.alias("file"),
        line.cast("bigint").alias("line"),
        symbol.alias("symbol"),
        F.lit(severity).alias("severity"),
        F.lit("contract").alias("category"),
        title.alias("title"),
        detail.alias("detail"),
        F.lit(confidence).alias("confidence"),
        F.lit(suggestion).alias("suggestion"),
        F.lit("static").alias("origin"),
    ]


def call_findings(ix: Index, changed: DataFrame) -> DataFrame:
    """Calls that no longer bind, and calls of what became async without an await. Every linked call is
    checked: no cap of any packet applies here."""
    units = changed.filter("kind = 'signature_changed'").filter(~F.exists("decorators", lambda d: _starts(d, REWRAPPERS)))
    params = first_wins(ix.definitions.filter("not is_class"), ["repo", "path", "qualname"], ["ord"]).select("repo", "path", "qualname", "params", F.col("is_async").alias("now_async"))
    units = units.join(params, ["repo", "path", "qualname"]).select("repo", F.col("fqname").alias("callee"), F.col("path").alias("u_path"), "qualname", "short", "symbol_kind", "decorators", "params", "now_async", "went_async", "old_signature", "new_signature", F.col("start_lineno").alias("u_start"), F.col("end_lineno").alias("u_end"))
    sites = first_wins(ix.linked.select("repo", "callee", "path", "line", "tag", "text", "ord"), ["repo", "callee", "path", "line"], ["ord"])
    sites = sites.join(units, ["repo", "callee"]).filter(~((F.col("path") == F.col("u_path")) & F.col("line").between(F.col("u_start"), F.col("u_end"))))
    shape = first_wins(ix.shapes.select("repo", "path", "line", F.col("name").alias("short"), "ord", "positional", "keywords", "star", "double_star", "attribute", "consumed"), ["repo", "path", "line", "short"], ["ord"]).drop("ord")
    at = sites.join(shape, ["repo", "path", "line", "short"])
    at = at.withColumn("problems", bind_problems(F.col("params"), F.col("symbol_kind") == "method", F.array_contains("decorators", "staticmethod"), F.col("tag"), F.col("positional"), F.col("keywords"), F.col("star"), F.col("double_star"), F.col("attribute")))
    n = F.size("problems")
    summary = F.concat(F.get("problems", F.lit(0)), F.when(n > 1, F.concat(F.lit(" (+"), (n - 1).cast("string"), F.lit(" more)"))).otherwise(""))
    broken = at.filter(n > 0).select(
        *_finding(
            F.col("callee"), F.col("path"), F.col("line"), "high",
            F.concat(F.lit("call of `"), F.col("short"), F.lit("()` no longer binds: "), summary),
            F.concat(F.lit("`"), F.col("old_signature"), F.lit("` became `"), F.col("new_signature"), F.lit("`; the call `"), F.col("text"), F.lit("` "), F.array_join("problems", "; "), F.lit(" and fails with a TypeError.")),
            0.95, "adapt the call to the new signature",
        )
    )
    idle = at.filter(F.col("went_async") & F.col("now_async") & ~F.col("consumed")).select(
        *_finding(
            F.col("callee"), F.col("path"), F.col("line"), "high",
            F.concat(F.lit("`"), F.col("short"), F.lit("()` is async now, and there is no await here")),
            F.concat(F.lit("`"), F.col("qualname"), F.lit("` returns a coroutine now; `"), F.col("text"), F.lit("` uses it like the value.")),
            0.9, "await the call",
        )
    )
    return broken.unionByName(idle)


def _starts(x: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | x.startswith(p)
    return out


def removed_findings(ix: Index, removed: DataFrame) -> DataFrame:
    """Calls that are bound by an import, module, self or local name to exactly what is gone."""
    units = removed.select("repo", F.col("fqname").alias("target"), F.col("path").alias("u_path"), "qualname", "short")
    sites = ix.calls.filter(F.col("resolution").isin("import", "module", "self", "local")).join(units, ["repo", "target"]).filter("path <> u_path")
    sites = first_wins(sites, ["repo", "target", "path", "line"], ["ord"])
    return sites.select(
        *_finding(
            F.col("target"), F.col("path"), F.col("line"), "critical",
            F.concat(F.lit("call of removed `"), F.col("short"), F.lit("`")),
            F.concat(F.lit("`"), F.col("qualname"), F.lit("` was removed from "), F.col("u_path"), F.lit("; `"), F.col("text"), F.lit("` still refers to it.")),
            0.95, "drop or replace the call, or bring the symbol back",
        )
    )


def descendants_of(ix: Index, starts: DataFrame) -> DataFrame:
    """repo, class, sub: all transitive subclasses of the classes in `starts` (repo, class)."""
    named = starts.select(L._named("repo", "class").alias("start")).distinct()
    edges = ix.edges.select(L._named("repo", "child").alias("child"), L._named("repo", "parent").alias("parent"))
    down = descendants(named, edges)
    part = lambda c, i: F.substring_index(c, "\x00", i)
    return down.select(part("start", 1).alias("repo"), part("start", -1).alias("class"), part("node", -1).alias("sub"))


def overrides_of(ix: Index, methods: DataFrame) -> DataFrame:
    """repo, fqname (of the method), override: methods of the same name in transitive subclasses."""
    asked = methods.filter("symbol_kind = 'method' and parent is not null").select("repo", "fqname", "short", F.concat_ws(".", "module", "parent").alias("class"))
    subs = descendants_of(ix, asked.select("repo", "class"))
    known = L.by_fqname(ix.symbols).select("repo", F.col("fqname").alias("override"), F.col("path").alias("o_path"), F.col("qualname").alias("o_qualname"), F.col("lineno").alias("o_line"), F.col("signature").alias("o_signature"))
    return asked.join(subs, ["repo", "class"]).withColumn("override", F.concat_ws(".", "sub", "short")).join(known, ["repo", "override"]).drop("class", "sub", "short")


def override_findings(ix: Index, changed: DataFrame) -> DataFrame:
    """Overrides that can't take what the changed parent takes, or that ask for more."""
    units = changed.filter("kind = 'signature_changed'")
    params = first_wins(ix.definitions.filter("not is_class"), ["repo", "path", "qualname"], ["ord"]).select("repo", "path", "qualname", "params")
    parents = units.join(params, ["repo", "path", "qualname"]).select("repo", "fqname", "old_signature", "new_signature", F.col("params").alias("p_params"))
    theirs = overrides_of(ix, units).join(params.select("repo", F.col("path").alias("o_path"), F.col("qualname").alias("o_qualname"), F.col("params").alias("o_params")), ["repo", "o_path", "o_qualname"])
    both = theirs.join(parents, ["repo", "fqname"])
    flexible = lambda c: F.exists(c, lambda p: p["kind"].isin("vararg", "kwarg"))
    both = both.filter(~flexible("p_params") & ~flexible("o_params"))
    own = lambda c: F.filter(c, lambda p: ~p["name"].isin("self", "cls"))
    places = lambda c: F.transform(F.filter(own(c), lambda p: p["kind"].isin("posonly", "arg")), lambda p: p["name"])
    needs = lambda c: F.transform(F.filter(own(c), lambda p: p["kind"].isin("posonly", "arg", "kwonly") & ~p["has_default"]), lambda p: p["name"])
    fewer = F.size(places("o_params")) < F.size(places("p_params"))
    absent = F.slice(places("p_params"), F.size(places("o_params")) + 1, F.greatest(F.size(places("p_params")) - F.size(places("o_params")), F.lit(0)))
    extra = F.array_sort(F.array_except(F.array_except(needs("o_params"), needs("p_params")), places("p_params")))
    problem = F.concat_ws("; ", F.when(fewer, F.concat(F.lit("has no place for "), F.array_join(absent, ", "))), F.when(F.size(extra) > 0, F.concat(F.lit("needs "), F.array_join(extra, ", "), F.lit(" that the parent doesn't"))))
    return both.withColumn("problem", problem).filter("problem <> ''").select(
        *_finding(
            F.col("override"), F.col("o_path"), F.col("o_line"), "high",
            F.concat(F.lit("override `"), F.col("o_qualname"), F.lit("` diverges from the changed parent")),
            F.concat(F.lit("`"), F.col("fqname"), F.lit("` is `"), F.col("new_signature"), F.lit("` now; the override `"), F.col("o_signature"), F.lit("` "), F.col("problem"), F.lit(".")),
            0.85, "bring the override in line with the parent",
        )
    )


def lost_readers(ix: Index) -> DataFrame:
    """Reads of lost fields, through subclasses too; a subclass with a symbol of the name keeps its readers."""
    edited = ix.diffs.filter("status in ('M', 'R') and not `binary`").select("repo", "path")
    lost = D.lost_fields(ix.old_definitions, ix.definitions).join(edited, ["repo", "path"], "left_semi")
    classes = ix.symbols.filter("kind = 'class'").select("repo", "path", "qualname", F.col("fqname").alias("class"), "start_lineno", "end_lineno")
    lost = lost.join(classes, ["repo", "path", "qualname"]).select("repo", F.col("path").alias("u_path"), "class", "field", "start_lineno", "end_lineno")
    subs = descendants_of(ix, lost.select("repo", "class")).distinct()
    known = ix.symbols.select("repo", F.col("fqname").alias("own")).distinct()
    through = lost.join(subs, ["repo", "class"]).withColumn("own", F.concat_ws(".", "sub", "field")).join(known, ["repo", "own"], "left_anti")
    every = lost.withColumn("target", F.concat_ws(".", "class", "field")).unionByName(through.withColumn("target", F.col("own")).drop("own", "sub"))
    reads = first_wins(ix.reads.select("repo", "target", "path", "line", "resolution", "text", "caller", "raw", "ord"), ["repo", "target", "path", "line"], ["ord"])
    hits = reads.join(every, ["repo", "target"]).filter(~((F.col("path") == F.col("u_path")) & F.col("line").between(F.col("start_lineno"), F.col("end_lineno"))))
    return first_wins(hits, ["repo", "class", "field", "path", "line"], ["ord"])


def field_findings(ix: Index) -> DataFrame:
    return lost_readers(ix).select(
        *_finding(
            F.col("class"), F.col("path"), F.col("line"), "high",
            F.concat(F.lit("read of removed attribute `"), F.col("field"), F.lit("`")),
            F.concat(F.lit("`"), F.col("class"), F.lit("` has no `"), F.col("field"), F.lit("` any more; `"), F.col("text"), F.lit("` fails with an AttributeError.")),
            0.9, "drop the read or bring the attribute back",
        )
    )


def removed_units(ix: Index) -> DataFrame:
    """Removed symbols of files that are changed, not deleted (a deleted file has no provable call finding)."""
    diffs = ix.diffs.filter("status not in ('A', 'F', 'D') and not `binary`")
    touched = diffs.select("repo", "path", F.explode("old_lines").alias("line"))
    return D.removed_symbols(ix.old_symbols.join(diffs.select("repo", "path"), ["repo", "path"], "left_semi"), ix.symbols, touched)


def findings(ix: Index, floor: float = 0.45) -> DataFrame:
    """All provable findings, one of each (file, line, title); `ord` is the order of the rules, and within one a stable order."""
    changed = ix.keep(changed_symbols(ix))
    parts = call_findings(ix, changed), override_findings(ix, changed), removed_findings(ix, removed_units(ix)), field_findings(ix)
    within = F.pmod(F.xxhash64("repo", "symbol", "title", "detail"), F.lit(1 << 60))
    numbered = [part.withColumn("ord", F.lit(i << 60) + within) for i, part in enumerate(parts)]
    rows = numbered[0].unionByName(numbered[1]).unionByName(numbered[2]).unionByName(numbered[3])
    return postprocessed(rows, floor, keys=("repo", "file", "line")).select(*FINDING)
