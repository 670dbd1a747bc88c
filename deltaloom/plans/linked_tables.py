"""Registered queries of linking, prefixes, sweeps and matching over repositories made of the given tables.

A brand is a repository and a part a definition `<module>.<class>.<method>` or, if it is small, a function of
its module; a supplier's file imports modules and calls definitions, a line of an order for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.operators import evidence, intervals, matching
from deltaloom.operators.staging import dealt, stage
from deltaloom.plans import link

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    method = F.element_at(words, -1)
    rows = _t(spark, d, "part").select(
        F.col("p_brand").alias("repo"),
        F.format_string("m%d.py", "p_size").alias("path"),
        F.format_string("m%d", "p_size").alias("module"),
        F.when(F.col("p_size") > 20, F.concat_ws(".", words[0], method)).otherwise(method).alias("qualname"),
        F.when(F.col("p_size") > 20, "method").otherwise("function").alias("kind"),
        F.col("p_partkey").alias("ord"),
    )
    return link.symbols_with_names(rows)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    symbols = _symbols(spark, d).select("repo", "module", "qualname", "fqname", "short", F.col("ord").alias("l_partkey"))
    return _t(spark, d, "lineitem").join(symbols, "l_partkey").withColumn("user", F.format_string("s%d.py", "l_suppkey"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    target = F.when(F.col("l_returnflag") == "R", F.col("fqname")).when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), F.concat(F.lit("pkg."), F.col("qualname")))
    target = target.when(F.col("l_returnflag") == "A", F.concat(F.lit("x."), F.col("short"))).otherwise(F.col("short"))
    rows = _lines(spark, d).select("repo", F.col("user").alias("path"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), target.alias("target"), F.when(F.col("l_returnflag") == "N", "name").otherwise("attr").alias("resolution"))
    return rows.groupBy("repo", "path", "ord").agg(F.min(F.struct("target", "resolution")).alias("c")).select("repo", "path", "ord", "c.*")


def _imports(spark: SparkSession, d: str) -> DataFrame:
    target = F.when(F.col("l_quantity") < 5, F.concat_ws(".", "module", "short", F.lit("part"))).when(F.col("l_quantity") >= 46, F.col("module"))
    return _lines(spark, d).select("repo", F.col("user").alias("path"), target.alias("target")).filter("target is not null").distinct()


_REPOSITORY = """
words as (select *, split_part(p_name, ' ', 1) as c, string_split(p_name, ' ')[-1] as short from part),
sym as (select p_brand as repo, 'm' || p_size || '.py' as path, 'm' || p_size as module, case when p_size > 20 then c || '.' || short else short end as qualname, short, p_partkey as ord from words),
lines as (select l.*, s.repo, s.module, s.qualname, s.short, s.module || '.' || s.qualname as fqname, 's' || l_suppkey || '.py' as "user" from lineitem l join sym s on s.ord = l.l_partkey),
calls as (select repo, "user" as path, l_orderkey * 8 + l_linenumber as ord, min({'target': case when l_returnflag = 'R' then fqname when l_returnflag = 'A' and l_linestatus = 'O' then 'pkg.' || qualname when l_returnflag = 'A' then 'x.' || short else short end,
  'resolution': case when l_returnflag = 'N' then 'name' else 'attr' end}) as c from lines group by 1, 2, 3),
imports as (select distinct repo, "user" as path, case when l_quantity < 5 then module || '.' || short || '.part' when l_quantity >= 46 then module end as target from lines where l_quantity < 5 or l_quantity >= 46)
"""


@_query(f"""
with {_REPOSITORY.strip()},
asked as (select repo, path, ord, c.target as target, c.resolution as tag, string_split(c.target, '.')[-1] as short from calls),
exact as (select a.* from asked a where exists (select 1 from sym s where s.repo = a.repo and s.module || '.' || s.qualname = a.target)),
open as (select * from asked except all select * from exact),
cand as (select o.*, s.module || '.' || s.qualname as callee, s.ord as def, contains(s.qualname, '.') and ends_with(o.target, '.' || s.qualname) as tail, s.module from open o join sym s on s.repo = o.repo and s.short = o.short),
tails as (select repo, path, ord, min(callee) as callee from cand where tail group by all having count(*) = 1),
near as (select c.* from cand c where not exists (select 1 from tails t where t.repo = c.repo and t.path = c.path and t.ord = c.ord)
  and exists (select 1 from imports i where i.repo = c.repo and i.path = c.path and (i.target = c.module or starts_with(i.target, c.module || '.')))),
counted as (select *, count(*) over (partition by repo, path, ord) as n from near)
select repo, path, ord, target as callee, tag from exact
union all select o.repo, o.path, o.ord, t.callee, o.tag from open o join tails t using (repo, path, ord)
union all select repo, path, ord, callee, case when n = 1 then tag else 'ambiguous' end from counted where n <= 3
union all select distinct repo, path, ord, null, 'dropped' from cand c where not exists (select 1 from tails t where t.repo = c.repo and t.path = c.path and t.ord = c.ord)
  and not exists (select 1 from counted n where n.n <= 3 and n.repo = c.repo and n.path = c.path and n.ord = c.ord)
""")
def link_calls(spark, d):
    """Calls bound by the linker: exactly, by a dotted tail, by evidence of imports, as copies, or dropped."""
    none = spark.createDataFrame([], "repo string, child string, parent string, position int")
    # Read many times over by the linker, like parsed files.
    calls, symbols, imports = stage(_calls(spark, d), "calls"), stage(_symbols(spark, d), "symbols"), stage(_imports(spark, d), "imports")
    linked, dropped = link.link(calls, symbols, imports, none)
    lost = dropped.select("repo", F.col("key.path").alias("path"), F.col("key.ord").alias("ord"), F.lit(None).cast("string").alias("callee"), F.lit("dropped").alias("tag"))
    return linked.select("repo", "path", "ord", "callee", "tag").unionByName(lost)


@_query(f"""
with {_REPOSITORY.strip()},
ends as (select distinct c.repo, c.c.target as target, s.ord as definition from calls c join sym s on s.repo = c.repo and contains(s.qualname, '.') and ends_with(c.c.target, '.' || s.qualname))
select repo, target, count(*)::bigint as definitions, min(definition) as first_definition from ends group by 1, 2
""")
def suffix_join(spark, d):
    """Definitions whose dotted name ends a longer one, by exploded suffixes."""
    found = evidence.suffix_matches(_calls(spark, d), _symbols(spark, d).filter("kind = 'method'").select("repo", "qualname", "ord"), ["repo"], "target", "qualname")
    return found.groupBy("repo", "target").agg(F.count(F.lit(1)).alias("definitions"), F.min("ord").alias("first_definition"))


@_query(f"""
with {_REPOSITORY.strip()}
select i.repo, i.path, i.target, max(s.module) as module from imports i join (select distinct repo, module from sym) s on s.repo = i.repo and (i.target = s.module or starts_with(i.target, s.module || '.')) group by 1, 2, 3
""")
def import_targets(spark, d):
    """The module of the repository that each import leads to."""
    return link.depends(_imports(spark, d), _symbols(spark, d))


@_query(r"""
with u as (select page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') as place from pages),
hosts as (select distinct split_part(place, '/', 1) as prefix from u),
dirs as (select regexp_replace(place, '/[^/]*$', '') as prefix from u group by 1 having count(*) >= 3),
known as (select * from hosts where prefix <> '' union select * from dirs where prefix <> ''),
hit as (select u.page_id, arg_max(k.prefix, length(k.prefix)) as prefix from u join known k on u.place = k.prefix or starts_with(u.place, k.prefix || '/') group by 1)
select u.page_id, u.place, hit.prefix from u left join hit using (page_id)
""")
def page_sections(spark, d):
    """The deepest known section of each page: a host, or a folder of three pages or more."""
    pages = _t(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "").alias("place"))
    hosts = pages.select(F.split("place", "/")[0].alias("prefix"))
    dirs = pages.groupBy(F.regexp_replace("place", "/[^/]*$", "").alias("prefix")).count().filter("count >= 3").select("prefix")
    known = hosts.unionAll(dirs).filter("prefix <> ''")
    return evidence.longest_prefix(pages, known, [], "place", "prefix", "/").select("page_id", "place", "prefix")


@_query("""
with s as (select p_brand as brand, p_partkey as owner, p_partkey as a, p_partkey + p_size - 3 as z from part),
p as (select distinct p_brand as brand, l_partkey as at from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R')
select s.brand, s.owner, count(p.at)::bigint as points from s left join p on p.brand = s.brand and p.at between s.a and s.z group by 1, 2
""")
def span_coverage(spark, d):
    """How many touched lines each span holds, by one sweep of both."""
    part = _t(spark, d, "part")
    points = _t(spark, d, "lineitem").filter("l_returnflag = 'R'").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("brand"), F.col("l_partkey").alias("at"))
    spans = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("owner"), F.col("p_partkey").alias("a"), (F.col("p_partkey") + F.col("p_size") - 3).alias("z"))
    return intervals.coverage(spans, points, ["brand"], "a", "z", "at").select("brand", "owner", "points")


@_query("""
with p as (select distinct l_suppkey as s, l_orderkey as at from lineitem),
s as (select s_suppkey as s, l_orderkey as a, l_orderkey + l_quantity::bigint as z from supplier join lineitem on l_suppkey = s_suppkey where l_tax > 0.04)
select p.s as supplier, p.at, count(s.a)::bigint as depth from p left join s on s.s = p.s and p.at between s.a and s.z group by 1, 2
""")
def span_depth(spark, d):
    """How many spans hold each point: 0 is a line outside of all symbols."""
    lines = _t(spark, d, "lineitem")
    points = dealt(lines.select(F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("at")), lines.count(), "supplier", "at").distinct()
    spans = _t(spark, d, "supplier").join(lines.filter("l_tax > 0.04"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("supplier"), F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("z"))
    return intervals.depth(points, spans, ["supplier"], "a", "z", "at").select("supplier", "at", "depth")


@_query("""
with recursive e as (select user_id, event_id, hour(ts)::varchar as file, minute(ts)::int as line, lower(event_type) as word, value from events),
f as (select *, row_number() over (partition by user_id order by event_id) as k from e where value < 50),
g as (select user_id, event_id, file, line, case when value >= 75 then '' else word end as word from e where value >= 50),
fit as (select f.user_id, f.k, g.event_id as place from f join g on g.user_id = f.user_id and g.file = f.file and abs(f.line - g.line) <= 2 and contains(f.word, g.word)),
busy as (select user_id, k, row_number() over (partition by user_id order by k) as j from (select distinct user_id, k from fit)),
asked as (select b.user_id, b.j, fit.place from busy b join fit using (user_id, k)),
walk as (
  select distinct user_id, 0::bigint as j, []::bigint[] as taken from busy
  union all
  select w.user_id, a.j, case when min(a.place) filter (where not list_contains(w.taken, a.place)) is null then w.taken else list_append(w.taken, min(a.place) filter (where not list_contains(w.taken, a.place))) end
  from walk w join asked a on a.user_id = w.user_id and a.j = w.j + 1 group by w.user_id, a.j, w.taken),
best as (select user_id, max(len(taken)) as tp from walk group by 1)
select user_id, coalesce(tp, 0)::bigint as tp, (count(*) filter (where value < 50) - coalesce(tp, 0))::bigint as fp, (count(*) filter (where value >= 50) - coalesce(tp, 0))::bigint as fn
from e left join best using (user_id) group by user_id, tp
""")
def match_findings(spark, d):
    """True and false positives of findings against golden places, one to one and in order, in parallel rounds."""
    e = _t(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), F.hour("ts").cast("string").alias("file"), F.minute("ts").alias("line"), F.lower("event_type").alias("title"), "value")
    findings = e.filter("value < 50").withColumn("detail", F.lit(""))
    golden = e.filter("value >= 50").select("user_id", "ord", F.col("file").alias("path"), "line", F.when(F.col("value") >= 75, "").otherwise(F.col("title")).alias("keyword"))
    return matching.greedy_match(findings, golden, "user_id")
