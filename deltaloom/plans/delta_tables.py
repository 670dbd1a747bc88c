"""Registered queries of contract deltas and index statistics over revisions made of the given tables.

A part is a definition; the lines of orders shipped up to 1996 give its parameters, raises and shapes at the base, those
from 1997 on the new ones. Parts without lines of one side are new or gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.functions.scalars import split_lines
from deltaloom.operators.ranking import first_wins
from deltaloom.operators.staging import stage
from deltaloom.plans import delta, link, linked_tables
from deltaloom.sources import diffs


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _definitions(spark: SparkSession, d: str, new: bool) -> DataFrame:
    line, part = _t(spark, d, "lineitem"), _t(spark, d, "part")
    side = line.filter(F.year("l_shipdate") >= 1997 if new else F.year("l_shipdate") < 1997)
    name = F.format_string("a%d", "l_linenumber")
    has = F.col("l_tax") > 0.04
    param = F.struct(
        name.alias("name"),
        F.when(F.col("l_returnflag") == "N", "kwonly").when(F.col("l_returnflag") == "R", "posonly").otherwise("arg").alias("kind"),
        F.when(F.col("l_linestatus") == "O", "int").alias("annotation"),
        has.alias("has_default"),
        F.when(has, F.col("l_quantity").cast("int").cast("string")).alias("default"),
    )
    rows = side.withColumn("at", F.struct("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    first = first_wins(rows, ["l_partkey", "l_linenumber"], ["at"])
    place = F.struct("l_suppkey", "l_linenumber") if new else F.struct("l_linenumber", "l_suppkey")
    made = first.groupBy("l_partkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), param.alias("param")))), lambda x: x["param"]).alias("params"),
        F.array_sort(F.collect_set(F.concat(F.lit("E"), "l_returnflag"))).alias("raises"),
        F.array_sort(F.collect_set("l_linestatus")).alias("shapes"),
        (F.max("l_quantity") > 47).alias("generator"),
        (F.min("l_linenumber") == 1).alias("is_async"),
        F.when(F.min("l_linestatus") == "O", "int").alias("returns"),
        F.when(F.min("l_discount") > 0.02, F.array(F.lit("property"))).when(F.max("l_discount") > 0.09, F.array(F.lit("cache"))).otherwise(F.array().cast("array<string>")).alias("decorators"),
    )
    shown = F.concat(F.lit("def f("), F.array_join(F.transform("params", lambda p: p["name"]), ", "), F.lit(")"))
    return made.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("repo"), F.format_string("m%d.py", "p_size").alias("path"), F.format_string("f%d", "p_partkey").alias("qualname"),
        (F.col("p_size") == 1).alias("is_class"), shown.alias("signature"), "is_async", "decorators", "returns", "params", "raises", "generator", "shapes",
    )


_SIDE = """
{side}_first as (select *, row_number() over (partition by l_partkey, l_linenumber order by l_orderkey, l_suppkey, l_quantity, l_extendedprice) as rn from lineitem where year(l_shipdate) {years}),
{side} as (select p_brand as repo, 'm' || p_size || '.py' as path, 'f' || p_partkey as qualname, p_size = 1 as is_class,
    list({{'name': 'a' || l_linenumber, 'kind': case l_returnflag when 'N' then 'kwonly' when 'R' then 'posonly' else 'arg' end, 'annotation': case when l_linestatus = 'O' then 'int' end,
      'has': l_tax > 0.04, 'value': case when l_tax > 0.04 then l_quantity::int::varchar end}} order by {order}) as params,
    list_sort(list(distinct 'E' || l_returnflag)) as raises, list_sort(list(distinct l_linestatus)) as shapes, max(l_quantity) > 47 as generator, min(l_linenumber) = 1 as is_async,
    case when min(l_linestatus) = 'O' then 'int' end as returns, case when min(l_discount) > 0.02 then ['property'] when max(l_discount) > 0.09 then ['cache'] else [] end as decorators
  from {side}_first join part on p_partkey = l_partkey where rn = 1 group by p_brand, p_size, p_partkey)"""
_DELTA_SQL = f"""
with {_SIDE.format(side="o", years="< 1997", order="l_linenumber, l_suppkey")},
{_SIDE.format(side="n", years=">= 1997", order="l_suppkey, l_linenumber")},
pairs as (select coalesce(o.repo, n.repo) as repo, coalesce(o.path, n.path) as path, coalesce(o.qualname, n.qualname) as qualname, o, n,
    not coalesce(o.is_class, false) and not coalesce(n.is_class, false) as f from o full join n on o.repo = n.repo and o.path = n.path and o.qualname = n.qualname),
named as (select *, list_transform(o.params, lambda p: p.name) as o_names, list_transform(n.params, lambda p: p.name) as n_names from pairs where o.qualname is not null and n.qualname is not null),
changes as (select *,
  case when f then list_transform(list_filter(o.params, lambda p: not list_contains(n_names, p.name)), lambda p: {{'text': 'takes no longer: ' || p.name, 'breaking': true}}) else [] end as gone,
  case when f then list_transform(list_filter(n.params, lambda p: not list_contains(o_names, p.name)), lambda p: {{'text': case when p.has then 'takes if given: ' else 'must now be given: ' end || p.name, 'breaking': not p.has}}) else [] end as come,
  case when f then flatten(list_transform(list_filter(o.params, lambda p: list_contains(n_names, p.name)), lambda p: list_transform(list_filter(n.params, lambda q: q.name = p.name), lambda q: list_filter([
    case when p.kind <> q.kind then {{'text': p.name || ': ' || p.kind || ' -> ' || q.kind, 'breaking': true}} end,
    case when p.has and not q.has then {{'text': p.name || ': default removed', 'breaking': true}} when not p.has and q.has then {{'text': p.name || ': default added (' || q.value || ')', 'breaking': false}}
      when p.has and p.value <> q.value then {{'text': p.name || ': default ' || p.value || ' -> ' || q.value, 'breaking': false}} end,
    case when p.annotation is distinct from q.annotation then {{'text': p.name || ': type ' || coalesce(p.annotation, 'untyped') || ' -> ' || coalesce(q.annotation, 'untyped'), 'breaking': false}} end], lambda x: x is not null)))) else [] end as kept,
  f and list_filter(list_transform(list_filter(o.params, lambda p: p.kind <> 'kwonly'), lambda p: p.name), lambda x: list_contains(list_transform(list_filter(n.params, lambda p: p.kind <> 'kwonly'), lambda p: p.name), x))
    <> list_filter(list_transform(list_filter(n.params, lambda p: p.kind <> 'kwonly'), lambda p: p.name), lambda x: list_contains(list_transform(list_filter(o.params, lambda p: p.kind <> 'kwonly'), lambda p: p.name), x)) as moved,
  f and o.is_async <> n.is_async as toggled, o.decorators <> n.decorators as decorated, f and o.generator <> n.generator as gen from named),
said as (select *, list_concat(gone, come, flatten(kept)) as params,
  list_filter([case when moved then 'positional parameter order changed' end,
    case when f and o.returns is distinct from n.returns then 'return type ' || coalesce(o.returns, 'untyped') || ' -> ' || coalesce(n.returns, 'untyped') end,
    case when toggled then 'sync/async changed: every call site needs an await added or removed' end,
    case when decorated then 'decorators [' || array_to_string(o.decorators, ', ') || '] -> [' || array_to_string(n.decorators, ', ') || ']' end], lambda x: x is not null) as rest,
  case when f then list_filter([
    case when gen and n.generator then 'function -> generator: every call site now gets a generator object' when gen then 'generator -> function: every call site now gets a plain value' end,
    case when len(list_filter(n.raises, lambda x: not list_contains(o.raises, x))) > 0 then 'now raises: ' || array_to_string(list_filter(n.raises, lambda x: not list_contains(o.raises, x)), ', ') end,
    case when len(list_filter(o.raises, lambda x: not list_contains(n.raises, x))) > 0 then 'no longer raises: ' || array_to_string(list_filter(o.raises, lambda x: not list_contains(n.raises, x)), ', ') end,
    case when not o.generator and not n.generator and o.shapes <> n.shapes then 'return shape changed: ' || array_to_string(o.shapes, ' | ') || ' -> ' || array_to_string(n.shapes, ' | ') end], lambda x: x is not null) else [] end as behavior
  from changes)
select repo, path, qualname, case when len(params) + len(rest) > 0 or o_names <> n_names then 'signature_changed' else 'body_only' end as kind,
  len(list_filter(params, lambda x: x.breaking)) > 0 or moved or toggled or decorated and list_contains(list_concat(o.decorators, n.decorators), 'property') or gen as breaking,
  case when len(params) + len(rest) > 0 then array_to_string(list_concat(list_transform(params, lambda x: x.text), rest), '; ') when o_names <> n_names then 'the signature is written differently' else '' end as details,
  array_to_string(behavior, '; ') as behavior, toggled and n.is_async as went_async from said
union all select repo, path, qualname, case when o.qualname is null then 'added' else 'removed' end, o.qualname is not null, case when o.qualname is null then 'new definition' else 'nothing of this name is left' end, '', false from pairs where o.qualname is null or n.qualname is null
"""


def contract_delta(spark, d):
    """What callers can notice of each definition between two revisions."""
    rows = delta.compared(_definitions(spark, d, False), _definitions(spark, d, True))
    return rows.select("repo", "path", "qualname", "kind", "breaking", F.array_join("details", "; ").alias("details"), F.array_join("behavior", "; ").alias("behavior"), "went_async")


_STATISTICS_SQL = f"""
with bound as ({linked_tables.ORACLES["link_calls"]}),
files as (select p_brand as repo, count(distinct p_size)::bigint as files, count(distinct case when p_size = 50 then p_size end)::bigint as unparsable, count(*)::bigint as symbols from part group by 1),
edges as (select repo, count(*)::bigint as edges from (select distinct p_brand as repo, l_suppkey, l_orderkey * 8 + l_linenumber as ord from lineitem join part on p_partkey = l_partkey) group by 1),
ends as (select repo, count(*) filter (where tag <> 'dropped')::bigint as resolved, count(distinct callee)::bigint as targets, count(*) filter (where tag = 'dropped')::bigint as too_ambiguous from bound group by 1)
select f.repo, f.files, f.unparsable, f.symbols, coalesce(e.edges, 0) as edges, coalesce(n.resolved, 0) as resolved, coalesce(n.targets, 0) as targets, coalesce(n.too_ambiguous, 0) as too_ambiguous
from files f left join edges e using (repo) left join ends n using (repo)
"""


def index_statistics(spark, d):
    """Files, symbols, edges, bound and dropped calls of each repository."""
    calls, symbols, imports = (stage(make(spark, d), "index") for make in (linked_tables._calls, linked_tables._symbols, linked_tables._imports))
    none = spark.createDataFrame([], "repo string, child string, parent string, position int")
    linked, dropped = link.link(calls, symbols, imports, none)
    parsed = symbols.select("repo", "path").distinct().withColumn("error", F.when(F.col("path") == "m50.py", "bad syntax"))
    return link.statistics(parsed, symbols, calls, linked, dropped)


#: Lines of a hunk, and how they are marked in turn.
_HUNK_LINES, _MARKS = 40, " +-"
_TOUCHED_SQL = r"""
with raw as (select doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]') as lines from documents where text is not null),
kept as (select doc_id, case when len(lines) > 0 and lines[len(lines)] = '' then len(lines) - 1 else len(lines) end as n from raw),
places as (select distinct doc_id, unnest(range(0, n)) as i from kept),
split as (select doc_id, i // 40 as hunk, i % 40 as k from places)
select doc_id, hunk::int as hunk_no, case k % 3 when 1 then 'new' else 'old' end as side,
  (case k % 3 when 1 then 1000 * hunk + 20 + 2 * (k // 3) + 1 else 1000 * hunk + 10 + 2 * (k // 3) + 1 end)::int as line
from split where k % 3 in (1, 2)
"""


def diff_touched(spark, d):
    """Touched lines of both sides, numbered by windows over the rows of diffs whose bodies are whole documents."""
    docs = _t(spark, d, "documents").filter("text is not null").select("doc_id", split_lines(F.col("text")).alias("lines")).dropDuplicates(["doc_id"])
    marked = F.transform("lines", lambda x, i: F.concat(F.when(i % _HUNK_LINES == 0, F.format_string("@@ -%d,40 +%d,40 @@\n", *((i / _HUNK_LINES).cast("int") * 1000 + start for start in (10, 20)))).otherwise(""), F.substring(F.lit(_MARKS), i % _HUNK_LINES % 3 + 1, F.lit(1)), x))
    text = F.concat(F.format_string("diff --git a/%d b/%d\n--- a/%d\n+++ b/%d\n", *["doc_id"] * 4), F.array_join(marked, "\n"))
    rows = diffs.diff_lines(docs.select(F.col("doc_id").cast("string").alias("repo"), text.alias("text")))
    mark = F.substring("line", 1, 1)
    side = F.when((mark == "+") & F.col("new_line").isNotNull(), "new").when((mark == "-") & F.col("old_line").isNotNull(), "old")
    return rows.select(F.col("repo").cast("long").alias("doc_id"), "hunk_no", side.alias("side"), F.when(side == "new", F.col("new_line")).otherwise(F.col("old_line")).alias("line")).filter("side is not null")


QUERIES = {f.__name__: f for f in (contract_delta, index_statistics, diff_touched)}
ORACLES = {"contract_delta": _DELTA_SQL, "index_statistics": _STATISTICS_SQL, "diff_touched": _TOUCHED_SQL}
