"""Review packets: each change with the code that it can break, packed to a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.functions import scalars as S
from deltaloom.operators.graph import pagerank
from deltaloom.operators.history import co_changes, companions
from deltaloom.operators.intervals import depth, owning_span
from deltaloom.operators.ranking import first_wins, ranked, top_k
from deltaloom.plans import check as C
from deltaloom.plans import delta as D
from deltaloom.plans.config import Config

ID = ["repo", "path", "unit", "qualname"]
_SITE = ["s_path", "line", "caller", "target", "raw", "resolution", "text"]
CALLEES, FRAME, CALLEE_COST, SITE_COST = 6, 200, 25, 20


def _hunk_text(hunks: Column) -> Column:
    return F.array_join(F.transform(hunks, lambda h: F.array_join(F.concat(F.array(h["header"]), h["lines"]), "\n")), "\n")


def _hunks_for(hunks: Column, lines: Column, status: Column) -> Column:
    """Hunks that hold one of the lines, else all of them."""
    near = F.filter(hunks, lambda h: F.exists(lines, lambda x: x.between(h["new_start"], h["new_start"] + F.greatest(h["new_count"], F.lit(1)) - 1)))
    return F.when(status == "F", "(reviewed as a whole: there is no diff)").otherwise(_hunk_text(F.when(F.size(near) > 0, near).otherwise(hunks)))


def _units(ix: C.Index, cfg: Config) -> DataFrame:
    """All units without their sites."""
    diffs = ix.diffs.filter("not `binary`").filter(F.col("path").endswith(".py"))
    d = diffs.select("repo", "path", "status", "hunks", "new_lines", "old_lines")
    src = ix.files.select("repo", "path", S.split_lines(F.col("src")).alias("lines"), "src")
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    columns = [*ID, "fqname", "module", "symbol_kind", "parent", "short", "signature", "start_lineno", "end_lineno", "kind", "breaking", "details", "behavior", "went_async", "old_signature", "new_signature", "diff_text", "new_source", "old_source", "removed_fields", "notes", "status"]
    blank = {"fqname": none, "module": none, "symbol_kind": none, "parent": none, "short": none, "signature": none, "start_lineno": F.lit(None).cast("int"), "end_lineno": F.lit(None).cast("int"), "behavior": empty, "went_async": F.lit(False), "old_signature": none, "new_signature": none, "old_source": none, "removed_fields": empty, "notes": empty}

    def made(df: DataFrame, **more: Column) -> DataFrame:
        return df.withColumns({k: v for k, v in blank.items() if k not in df.columns} | more).select(*columns)

    # Changed symbols. The old body only matters where behaviour changed.
    changed = C.changed_symbols(ix).drop("status").join(d, ["repo", "path"]).join(src, ["repo", "path"])
    whole = F.col("status") == "F"
    own_lines = F.filter("new_lines", lambda x: x.between(F.col("start_lineno"), F.col("end_lineno")))
    was = ix.old_files.select("repo", "path", S.split_lines(F.col("src")).alias("old_lines_of"))
    old_src = ix.old_definitions.select("repo", "path", "qualname", F.col("start_lineno").alias("o_start"), F.col("end_lineno").alias("o_end"))
    symbol = changed.join(old_src, ["repo", "path", "qualname"], "left").join(was, ["repo", "path"], "left").withColumn("kind", F.when(whole, "full_review").otherwise(F.col("kind"))).withColumn("breaking", F.col("breaking") & ~whole)
    symbol = made(
        symbol.withColumn("unit", F.lit("symbol")),
        diff_text=_hunks_for(F.col("hunks"), own_lines, F.col("status")),
        new_source=S.numbered_slice(F.col("lines"), F.col("start_lineno"), F.col("end_lineno"), cfg.max_symbol_lines),
        old_source=F.when(F.size("behavior") > 0, S.head_slice(F.col("old_lines_of"), F.col("o_start"), F.col("o_end"), cfg.max_symbol_lines)),
    )
    gone = C.removed_units(ix).withColumnRenamed("kind", "symbol_kind").join(d, ["repo", "path"]).join(was, ["repo", "path"], "left")
    removed = made(
        gone.withColumn("unit", F.lit("removed")),
        kind=F.lit("removed"),
        breaking=F.lit(True),
        details=F.array(F.concat(F.col("qualname"), F.lit(" no longer exists in "), F.col("path"))),
        old_signature=F.col("signature"),
        diff_text=_hunk_text(F.col("hunks")),
        new_source=F.lit(""),
        old_source=S.numbered_slice(F.col("old_lines_of"), F.col("start_lineno"), F.col("end_lineno"), cfg.max_symbol_lines),
    )
    lost = D.lost_fields(ix.old_definitions, ix.definitions).groupBy("repo", "path", "qualname").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "field"))), lambda x: x["field"]).alias("removed_fields"))
    classes = first_wins(ix.symbols.filter("kind = 'class'"), ["repo", "path", "qualname"], ["ord"]).withColumnRenamed("kind", "symbol_kind")
    fields_ = classes.join(lost, ["repo", "path", "qualname"]).join(d.filter("status in ('M', 'R')"), ["repo", "path"]).join(src, ["repo", "path"])
    names = F.array_join("removed_fields", ", ")
    field = made(
        fields_.withColumn("unit", F.lit("field")),
        kind=F.lit("signature_changed"),
        breaking=F.lit(True),
        details=F.transform("removed_fields", lambda x: F.concat(F.lit("field removed: "), x)),
        old_signature=F.concat(F.col("signature"), F.lit(" with "), names),
        new_signature=F.concat(F.col("signature"), F.lit(" without "), names),
        diff_text=_hunk_text(F.col("hunks")),
        new_source=S.numbered_slice(F.col("lines"), F.col("start_lineno"), F.col("end_lineno"), cfg.max_symbol_lines),
        notes=F.array(F.lit("Attributes are gone from this class: every reader below fails.")),
    )
    # Lines outside of any symbol; a change that only deletes counts where its hunks are.
    spans = ix.symbols.select("repo", "path", "start_lineno", "end_lineno")
    lines = d.filter("status <> 'D'").select("repo", "path", F.explode(F.when((F.size("new_lines") == 0) & (F.size("old_lines") > 0), F.transform("hunks", lambda h: h["new_start"])).otherwise(F.col("new_lines"))).alias("line"), (F.size("new_lines") == 0).alias("only_old"))
    loose = depth(lines, spans, ["repo", "path"], "start_lineno", "end_lineno", "line").filter("only_old or depth = 0").groupBy("repo", "path").agg(F.array_sort(F.collect_set("line")).alias("loose"))
    top = loose.join(d, ["repo", "path"]).join(src, ["repo", "path"]).withColumn("shown", F.slice("loose", 1, 60))
    width = F.length(F.element_at("shown", -1).cast("string"))
    window = F.array_join(F.transform(F.filter("shown", lambda x: x <= F.size("lines")), lambda x: F.concat(F.lpad(x.cast("string"), width, " "), F.lit("|"), F.get("lines", x - 1))), "\n")
    module = made(
        top.withColumn("unit", F.lit("module")).withColumn("qualname", F.lit("")),
        kind=F.when(F.col("status") == "A", "added").when(whole, "full_review").otherwise("body_only"),
        breaking=F.lit(False),
        details=F.array(F.lit("module-level change (imports, constants, top-level code)")),
        diff_text=_hunks_for(F.col("hunks"), F.col("loose"), F.col("status")),
        new_source=window,
        notes=F.array(F.lit("Module level: mind import cycles, effects at import, and constants that others read.")),
    )
    had = ix.old_symbols.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"), F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("parent").isNull() & (F.col("kind") != "class"), F.struct("ord", "signature")))), lambda x: F.concat(F.lit("lost: "), x["signature"])), 1, 10).alias("tops"))
    deleted = d.filter("status = 'D'").join(had, ["repo", "path"], "left").withColumn("tops", F.coalesce("tops", empty))
    file = made(
        deleted.withColumn("unit", F.lit("file")).withColumn("qualname", F.lit("")),
        kind=F.lit("removed"),
        breaking=F.lit(True),
        details=F.concat(F.array(F.concat(F.lit("file deleted ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" symbols)"))), F.col("tops")),
        diff_text=F.substring(_hunk_text(F.col("hunks")), 1, 4000),
        new_source=F.lit(""),
        notes=F.array(F.lit("The whole file is gone: what still imports it fails at import.")),
    )
    return symbol.unionByName(removed).unionByName(field).unionByName(module).unionByName(file)


def _sites(ix: C.Index, units: DataFrame) -> DataFrame:
    """Call and read sites of all units, each place once; hop 1."""
    unit = units.select(*ID, "fqname", "short", "start_lineno", "end_lineno", "kind", "behavior")
    calls = ix.calls.select("repo", F.col("path").alias("s_path"), "line", "caller", "target", "raw", "resolution", "text", F.struct("path", "ord").alias("key"))
    outside = ~((F.col("s_path") == F.col("path")) & F.col("line").between(F.col("start_lineno"), F.col("end_lineno")))
    linked = ix.linked.select("repo", F.col("path").alias("s_path"), "line", "caller", F.col("callee").alias("target"), "raw", F.col("tag").alias("resolution"), "text", F.struct("path", "ord").alias("key"), F.col("callee").alias("fqname"))
    one = linked.join(unit.filter("unit = 'symbol'"), ["repo", "fqname"]).filter(outside)
    last = calls.withColumn("short", S.short_name(F.col("raw")))
    gone = last.join(unit.filter("unit = 'removed'"), ["repo", "short"]).filter("s_path <> path")
    exact = F.col("target") == F.col("fqname")
    gone = gone.withColumn("any", F.max(exact.cast("int")).over(W.partitionBy(*ID))).filter((F.col("any") == 0) | exact).drop("any")
    reads = C.lost_readers(ix).select("repo", F.col("u_path").alias("path"), F.col("class").alias("fqname"), F.col("path").alias("s_path"), "line", "caller", "target", "raw", "resolution", "text", F.struct(F.col("path").alias("path"), "ord").alias("key"))
    read = reads.join(unit.filter("unit = 'field'"), ["repo", "path", "fqname"])
    tops = ix.old_symbols.filter("parent is null and kind <> 'class'").select("repo", "path", "short").distinct()
    files = tops.join(unit.filter("unit = 'file'").drop("short"), ["repo", "path"])
    deleted = last.join(files, ["repo", "short"]).filter("s_path <> path")
    columns = [*ID, *_SITE, "key", "kind", "behavior"]
    every = one.select(columns).unionByName(gone.select(columns)).unionByName(read.select(columns)).unionByName(deleted.select(columns))
    return first_wins(every, [*ID, "s_path", "line"], ["key"])


def _with_code(ix: C.Index, sites: DataFrame, cfg: Config) -> DataFrame:
    """Adds snippet, and name and signature of the function around each site."""
    files = ix.files.select("repo", F.col("path").alias("s_path"), S.split_lines(F.col("src")).alias("_lines"))
    shown = sites.join(files, ["repo", "s_path"]).withColumn("snippet", S.numbered_window(F.col("_lines"), F.col("line"), cfg.snippet_radius)).drop("_lines")
    functions = ix.symbols.filter("kind <> 'class'").withColumn("span", F.col("end_lineno") - F.col("start_lineno")).withColumnsRenamed({"path": "s_path", "signature": "around", "fqname": "around_name"})
    return owning_span(shown, functions, ["repo", "s_path"], "line", "start_lineno", "end_lineno", [F.col("span"), F.col("ord")], ["around", "around_name"])


def build(ix: C.Index, cfg: Config | None = None, commits: DataFrame | None = None) -> DataFrame:
    """Packets with callers, callees, overrides, notes, tokens and their place in the review.

    commits: (repo, commit, path), for what usually changes together.
    """
    cfg = cfg or Config()
    units = ix.keep(_units(ix, cfg))
    sites = ix.keep(_sites(ix, units))
    totals = sites.groupBy(*ID).agg(F.count(F.lit(1)).alias("total_callers"))
    contract = D.is_contract_change()
    test = S.is_test_path(F.col("s_path"))
    # Tests are left out before the ranking, or they would take places.
    shown = sites if cfg.include_tests else sites.filter((F.col("unit") != "symbol") | ~test)
    by_score = F.when(F.col("unit") == "symbol", S.site_score(F.col("resolution"), F.col("s_path") != F.col("path"), test, contract)).when(F.col("unit") == "field", 0.0).otherwise(S.confidence_of(F.col("resolution")))
    in_order = ranked(shown.withColumn("is_test", test), ID, [F.desc(by_score), F.asc("key")])
    first = ix.keep(_with_code(ix, in_order.filter((F.col("rank") <= cfg.max_callers) | (F.col("unit") == "field")), cfg).withColumn("hop", F.lit(1)).withColumn("via", F.lit(None).cast("string")))
    callers = first
    if cfg.two_hop:
        wrappers = first.join(units.filter("unit = 'symbol' and breaking").select(*ID), ID, "left_semi").filter(contract & F.instr("around", "*").cast("boolean")).select(*ID, F.col("rank").alias("parent"), F.col("around_name").alias("via"), "kind", "behavior")
        theirs = ix.linked.select("repo", F.col("callee").alias("via"), F.col("path").alias("s_path"), "line", "caller", F.col("callee").alias("target"), "raw", F.col("tag").alias("resolution"), "text", F.struct("path", "ord").alias("key"))
        second = first_wins(wrappers.join(theirs, ["repo", "via"]), [*ID, "s_path", "line"], ["parent", "key"]).join(first.select(*ID, "s_path", "line"), [*ID, "s_path", "line"], "left_anti")
        second = second.withColumn("nth", F.row_number().over(W.partitionBy(*ID).orderBy("parent", "key"))).filter(F.col("nth") + F.col("parent") <= cfg.max_callers + 4)
        second = second.withColumn("rank", F.col("parent")).withColumn("is_test", S.is_test_path(F.col("s_path"))).withColumn("hop", F.lit(2))
        callers = first.unionByName(_with_code(ix, second, cfg).select(*first.columns))
    place = F.struct("rank", "hop", "key")
    site = F.struct(place.alias("place"), F.col("s_path").alias("path"), "line", "caller", "resolution", "text", "snippet", F.col("around").alias("enclosing"), "is_test", "hop", "via")
    listed = callers.groupBy(*ID).agg(F.array_sort(F.collect_list(site)).alias("callers"))

    # What a changed body calls: not for contract changes, where the callers are the question.
    table = first_wins(ix.symbols, ["repo", "fqname"], ["key"]).select("repo", F.col("fqname").alias("callee"), F.struct("path", "lineno", "signature").alias("c"))
    called = ix.linked.filter("tag <> 'ambiguous'").select("repo", F.col("caller").alias("fqname"), "callee", F.struct("path", "ord").alias("key")).filter("callee <> fqname")
    called = first_wins(called, ["repo", "fqname", "callee"], ["key"]).join(units.filter((F.col("unit") == "symbol") & ~contract).select(*ID, "fqname"), ["repo", "fqname"]).join(table, ["repo", "callee"])
    called = top_k(called, ID, [F.asc("key")], CALLEES, "n")
    callees = called.groupBy(*ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]).alias("callees"))
    over = C.overrides_of(ix, units.filter("unit = 'symbol'")).groupBy("repo", "fqname").agg(F.array_sort(F.collect_list(F.struct(F.col("o_path").alias("path"), F.col("o_line").alias("lineno"), F.col("override").alias("fqname"), F.col("o_signature").alias("signature")))).alias("overrides"))
    out = units.join(totals, ID, "left").join(listed, ID, "left").join(callees, ID, "left").join(over, ["repo", "fqname"], "left")
    out = out.withColumn("total_callers", F.coalesce("total_callers", F.lit(0)))
    for name, kind in (("callers", listed.schema["callers"]), ("callees", callees.schema["callees"]), ("overrides", over.schema["overrides"])):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind.dataType)))
    out = out.withColumn("notes", F.when((F.size("overrides") > 0) & contract, F.array_append("notes", F.lit("Subclasses override this method: they usually have to change too."))).otherwise(F.col("notes")))
    # Of something removed: sites that were bound to it are broken; by its name alone they may mean another.
    sure = sites.filter("unit = 'removed'").join(units.select(*ID, "fqname"), ID).filter("target = fqname").select(*ID).distinct().withColumn("_sure", F.lit(True))
    gone = F.when(F.col("_sure"), "It is gone or has another name: the sites below were bound to it, so they fail.").otherwise("It is gone or has another name: the sites below only share its name; look at their imports before calling one broken.")
    out = out.join(sure, ID, "left").withColumn("notes", F.when(F.col("unit") == "removed", F.array_append("notes", gone)).otherwise(F.col("notes"))).drop("_sure")
    if cfg.co_change and commits is not None:
        out = _with_companions(out, ix, commits, contract)
    return _ordered(_packed(out, cfg.unit_budget), ix)


def _with_companions(units: DataFrame, ix: C.Index, commits: DataFrame, contract: Column) -> DataFrame:
    both = lambda c: F.concat_ws("\x00", "repo", c)
    files = commits.filter(F.col("path").endswith(".py"))
    pairs = companions(co_changes(files.select(both("commit").alias("commit"), both("path").alias("path")), "commit", "path"), ix.diffs.select(both("path").alias("path")))
    part = lambda c, i: F.substring_index(c, "\x00", i)
    said = pairs.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "b"))).alias("l")).select(part("a", 1).alias("repo"), part("a", -1).alias("path"), F.array_join(F.transform("l", lambda x: part(x["b"], -1)), ", ").alias("_with"))
    note = F.concat(F.lit("Usually changed together with this file, and left out here: "), F.col("_with"))
    return units.join(said, ["repo", "path"], "left").withColumn("notes", F.when(F.col("_with").isNotNull() & contract & (F.col("unit") == "symbol"), F.array_append("notes", note)).otherwise(F.col("notes"))).drop("_with")


def _packed(units: DataFrame, budget: int) -> DataFrame:
    """Callees go first, then the last callers, then the old source, then the end of the new source."""
    tokens = S.token_estimate
    cost = lambda c: tokens(c["snippet"]) + SITE_COST
    base = tokens(F.col("diff_text")) + tokens(F.col("new_source")) + tokens(F.col("old_source")) + FRAME
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + cost(x))
    room = F.lit(budget) - F.col("_base")
    units = units.withColumn("_base", base).withColumn("_callees", F.greatest(F.lit(0), F.least(F.size("callees").cast("bigint"), F.floor((room - total(F.col("callers"))) / CALLEE_COST))))
    # One pass carries the sum and how many fit: costs are positive, so what fits is the front.
    left = room - F.col("_callees") * CALLEE_COST
    carry = lambda a, x: F.struct((a["sum"] + cost(x)).alias("sum"), (a["n"] + (a["sum"] + cost(x) <= left).cast("int")).alias("n"))
    fits = F.aggregate("callers", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n")), carry, lambda a: a["n"])
    units = units.withColumn("_kept", F.when(F.col("_callees") > 0, F.size("callers")).otherwise(fits))
    units = units.withColumn("callers", F.slice("callers", 1, F.col("_kept"))).withColumn("callees", F.slice("callees", 1, F.col("_callees").cast("int")))
    direct = F.size(F.filter("callers", lambda c: c["hop"] >= 1))
    units = units.withColumn("dropped_callers", F.greatest(F.lit(0).cast("bigint"), F.col("total_callers") - direct))
    size = lambda: tokens(F.col("diff_text")) + tokens(F.col("new_source")) + tokens(F.col("old_source")) + FRAME + total(F.col("callers")) + F.size("callees") * CALLEE_COST
    no_old = (size() > budget) & F.col("old_source").isNotNull()
    units = units.withColumn("_cut", no_old).withColumn("old_source", F.when(~F.col("_cut"), F.col("old_source")))
    units = units.withColumn("notes", F.when(F.col("_cut"), F.array_append("notes", F.lit("the old version is left out to fit the context"))).otherwise(F.col("notes")))
    keep = (F.greatest(F.lit(budget) - tokens(F.col("diff_text")) - FRAME, F.lit(400)) * 3).cast("int")
    units = units.withColumn("_cut", (size() > budget) & (F.length("new_source") > keep))
    units = units.withColumn("new_source", F.when(F.col("_cut"), F.concat(F.substring(F.col("new_source"), F.lit(1), keep), F.lit("\n... (cut to fit the context)"))).otherwise(F.col("new_source")))
    units = units.withColumn("notes", F.when(F.col("_cut"), F.array_append("notes", F.lit("the symbol's body is cut to fit the context"))).otherwise(F.col("notes")))
    return units.withColumn("tokens", size()).drop("_base", "_callees", "_kept", "_cut")


def _ordered(units: DataFrame, ix: C.Index) -> DataFrame:
    """place 1.. of each repository: breaking, contract changes, many callers, long diffs first; in a review of
    whole files by centrality."""
    contract = D.is_contract_change()
    whole = units.groupBy("repo").agg(F.min((F.col("status") == "F").cast("int")).alias("_whole"))
    edges = ix.linked.select(F.concat_ws("\x00", "repo", F.regexp_replace("caller", r"\.<module>$", "")).alias("src"), F.concat_ws("\x00", "repo", "callee").alias("dst"))
    out = units.join(whole, "repo").withColumn("_node", F.concat_ws("\x00", "repo", "fqname"))
    if whole.filter("_whole = 1").limit(1).count():
        out = out.join(pagerank(edges).select(F.col("node").alias("_node"), "score"), "_node", "left")
    else:
        out = out.withColumn("score", F.lit(0.0))
    order = [F.desc(F.when(F.col("_whole") == 1, F.coalesce("score", F.lit(0.0))).otherwise(0.0)), F.desc("breaking"), F.desc(contract), F.desc("total_callers"), F.desc(F.length("diff_text")), F.asc("path"), F.asc("unit"), F.asc("qualname")]
    return out.withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy(*order))).drop("_whole", "_node", "score")


HEADS = {"signature_changed": "CONTRACT CHANGED", "added": "NEW DEFINITION", "removed": "REMOVED: what is listed below refers to something that is gone", "full_review": "FULL REVIEW, without a diff"}


def rendered(p: dict, known: list[dict] = ()) -> str:
    """The text of a packet for a reviewer: sections in a fixed order, empty ones left out."""
    fence = lambda body, kind="python": [f"```{kind}", (body or "").strip("\n"), "```", ""]
    out = [f"# FILE {p['path']}"] + ([f"# SYMBOL {p['qualname']} ({p['symbol_kind']}, lines {int(p['start_lineno'])}-{int(p['end_lineno'])})"] if p["fqname"] else []) + [""]
    out.append("## " + HEADS.get(p["kind"], "BODY CHANGED: the signature is the same"))
    if p["kind"] == "signature_changed":
        out += [f"before: {p['old_signature']}", f"after: {p['new_signature']}", *(f"- {x}" for x in p["details"])]
        out += ["Existing callers may be wrong now."] if p["breaking"] else []
    out += (["", "## BEHAVIOUR CHANGED", *(f"- {x}" for x in p["behavior"])] if len(p["behavior"]) else []) + [""]
    out += ["## DIFF", *fence(p["compact"], "diff")]
    out += ["## BEFORE", *fence(p["old_source"])] if p["old_source"] else []
    out += ["## SOURCE", *fence(p["new_source"])]
    if len(p["callers"]):
        left = f" of {p['total_callers']}, {p['dropped_callers']} left out" if p["dropped_callers"] else ""
        out.append(f"## CALL SITES ({len(p['callers'])}{left})")
        for c in p["callers"]:
            marks = (" [test]" if c["is_test"] else "") + (f" [by way of {c['via']}]" if c["via"] else "") + (f" in {c['enclosing']}" if c["enclosing"] else "")
            out += [f"### {c['path']}:{c['line']}{marks}", *fence(c["snippet"])]
    elif p["fqname"]:
        out += ["## CALL SITES", "(none in this repository)", ""]
    for head, rows in (("OVERRIDDEN BY", p["overrides"]), ("CALLS", p["callees"])):
        if len(rows):
            out += [f"## {head}", *(f"- {x['path']}:{x['lineno']} {x['signature']}" for x in rows), ""]
    out += ["## NOTES", *(f"- {x}" for x in p["notes"]), ""] if len(p["notes"]) else []
    if len(known):
        out += ["## ALREADY PROVEN, don't repeat", *(f"- {f['file']}:{f['line']} {f['title']}" for f in known), ""]
    return "\n".join([*out, "Review this change. An empty list of findings is a good answer."])


def with_prompts(packets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds `prompt`; `known` are proven findings, put with the packets of their symbol."""
    kind = "array<struct<file: string, line: bigint, title: string>>"
    if known is not None:
        told = known.groupBy("repo", F.col("symbol").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("file", "line", "title"))).alias("known"))
        told = told.withColumnRenamed("repo", "_r")
        packets = packets.join(told, (F.col("repo") == F.col("_r")) & F.col("fqname").eqNullSafe(F.col("_s")), "left").drop("_r", "_s")
    packets = packets.withColumn("known", F.coalesce("known", F.array().cast(kind)) if known is not None else F.array().cast(kind))
    packets = packets.withColumn("compact", S.compact_diff(F.coalesce("diff_text", F.lit(""))))
    schema = T.StructType([*packets.schema.fields, T.StructField("prompt", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["prompt"] = [rendered(row, list(row["known"])) for row in pdf.to_dict("records")]
            yield pdf

    return packets.mapInPandas(run, schema).drop("compact")
