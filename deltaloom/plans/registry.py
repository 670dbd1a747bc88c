"""Registered queries of the core library over the driver's tables, each with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.functions import scalars as S
from deltaloom.functions.model_output import normalized, verdict
from deltaloom.operators import evidence, graph, history, intervals, merge, ranking
from deltaloom.operators.staging import dealt
from deltaloom.plans import scenarios

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: str, digits: int = 6):
    return F.round(F.col(c).cast("double"), digits).alias(c)


@_query("""
with pts as (select distinct p_brand as brand, l_partkey as at from lineitem join part on l_partkey = p_partkey),
cand as (select pts.brand, pts.at, p.p_partkey as owner, row_number() over (partition by pts.brand, pts.at order by p.p_size, p.p_partkey) as rn
  from pts join part p on p.p_brand = pts.brand and pts.at between p.p_partkey and p.p_partkey + p.p_size)
select pts.brand, pts.at, cand.owner from pts left join cand on cand.brand = pts.brand and cand.at = pts.at and rn = 1
""")
def line_ownership(spark, d):
    """Innermost span that holds a point (touched line to symbol)."""
    part = _t(spark, d, "part")
    points = _t(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("brand"), F.col("l_partkey").alias("at")).distinct()
    spans = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"), F.col("p_size").alias("size"), F.col("p_partkey").alias("owner"))
    return intervals.owning_span(points, spans, ["brand"], "at", "start", "end", [F.col("size"), F.col("owner")], ["owner"]).select("brand", "at", "owner")


@_query("""
with cf as (select distinct l_orderkey as c, p_brand as p from lineitem join part on l_partkey = p_partkey),
ok as (select c from cf group by c having count(*) between 2 and 30)
select x.p as a, y.p as b, count(*)::bigint as n from cf x join ok on ok.c = x.c join cf y on y.c = x.c and y.p <> x.p group by 1, 2
""")
def co_change(spark, d):
    """Pairs of files that are changed together, in commits of fair size."""
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return history.co_changes(rows, "l_orderkey", "p_brand")


@_query("""
with cf as (select distinct l_orderkey as c, l_partkey as p from lineitem),
ok as (select c from cf group by c having count(*) between 2 and 30),
pairs as (select x.p as a, y.p as b, count(*)::bigint as n from cf x join ok on ok.c = x.c join cf y on y.c = x.c and y.p <> x.p group by 1, 2),
ranked as (select a, b, n, row_number() over (partition by a order by n desc, b) as rank, max(n) over (partition by a) as most from pairs)
select a, b, n, rank::int as rank from ranked where rank <= 3 and n >= 3 and n >= 0.4 * most
""")
def companions(spark, d):
    """The most frequent companions of a file: limit first, conditions after."""
    return history.companions(history.co_changes(_t(spark, d, "lineitem"), "l_orderkey", "l_partkey", sparse=True)).select("a", "b", "n", F.col("rank").cast("int").alias("rank"))


def _pagerank_sql(iterations: int = 25) -> str:
    steps = "".join(
        f", r{i + 1} as materialized (select n.node, 0.15 / cnt.n + 0.85 * dang{i}.m / cnt.n + 0.85 * coalesce(s.v, 0) as v from nodes n cross join cnt cross join dang{i}"
        f" left join (select w.dst, sum(w.w * r{i}.v) as v from w join r{i} on r{i}.node = w.src group by 1) s on s.dst = n.node)"
        + (f", dang{i + 1} as materialized (select coalesce(sum(v), 0) as m from r{i + 1} where node not in (select src from w))" if i + 1 < iterations else "")
        for i in range(iterations)
    )
    return f"""with e as materialized (select 'c' || o_custkey as src, 's' || l_suppkey as dst from orders join lineitem on o_orderkey = l_orderkey),
nodes as materialized (select src as node from e union select dst from e), cnt as materialized (select count(*)::double as n from nodes),
w as materialized (select src, dst, count(*) * 1.0 / sum(count(*)) over (partition by src) as w from e where src <> dst group by 1, 2),
r0 as materialized (select node, 1.0 / cnt.n as v from nodes cross join cnt), dang0 as materialized (select coalesce(sum(v), 0) as m from r0 where node not in (select src from w)){steps}
select node, round(v::double, 10) as score, row_number() over (order by round(v::double, 10) desc, node desc)::int as place from r{iterations} qualify place <= 10"""


@_query(_pagerank_sql())
def pagerank(spark, d):
    """The ten most central nodes of the customer to supplier graph."""
    rows = _t(spark, d, "orders").select("o_orderkey", "o_custkey").join(_t(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    ranks = graph.pagerank(rows.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")))
    top = ranks.select("node", F.round("score", 10).alias("score")).orderBy(F.desc("score"), F.desc("node")).limit(10)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), F.desc("node"))).cast("int"))


_TREE = """with recursive edges as (
  select 'r' || r_regionkey as parent, 'n' || n_nationkey as child from region join nation on n_regionkey = r_regionkey
  union all select 'n' || n_nationkey, 'c' || c_custkey from nation join customer on c_nationkey = n_nationkey
  union all select 'c' || o_custkey, 'o' || o_orderkey from orders)"""


def _tree(spark, d) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    nation, customer, orders = _t(spark, d, "nation"), _t(spark, d, "customer"), _t(spark, d, "orders")
    parts = (nation.select(name("r", "n_regionkey"), name("n", "n_nationkey")), customer.select(name("n", "c_nationkey"), name("c", "c_custkey")), orders.select(name("c", "o_custkey"), name("o", "o_orderkey")))
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).toDF("parent", "child")


@_query(
    _TREE
    + """, down as (select parent as start, child as node, 1 as depth from edges where parent like 'r%'
  union all select start, child, depth + 1 from down join edges on parent = node)
select start, depth::int as depth, count(distinct node)::bigint as nodes from down group by 1, 2"""
)
def closure_depth(spark, d):
    """All that is below each root of a hierarchy, by depth (transitive subclasses)."""
    starts = _t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("start"))
    return graph.descendants(starts, _tree(spark, d)).groupBy("start", "depth").agg(F.count(F.lit(1)).alias("nodes"))


@_query(
    _TREE
    + """, up as (select 'o' || o_orderkey as start, 'o' || o_orderkey as node, 0 as depth from orders
  union all select start, parent, depth + 1 from up join edges on child = node where depth < 8)
select start, node as base, depth::int as depth from up where node like 'n%'"""
)
def depth_capped_walk(spark, d):
    """Upward walk of at most eight steps to the first definition (inherited methods)."""
    starts = _t(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("start"))
    walks = graph.ancestors(starts, _tree(spark, d).withColumn("position", F.lit(0)), most=8)
    found = walks.filter(F.col("node").startswith("n"))
    return ranking.first_wins(found, ["start"], ["path"]).select("start", F.col("node").alias("base"), "depth")


@_query("""
with c as (select distinct l_orderkey as key, l_suppkey as candidate from lineitem),
n as (select key, count(*) as n from c group by 1)
select n.key, n.n::bigint as n, case when n.n = 1 then 'resolved' when n.n <= 3 then 'ambiguous' else 'dropped' end as outcome, case when n.n <= 3 then c.candidate end as candidate
from n join c on c.key = n.key where n.n <= 3
union all select key, n, 'dropped', null from n where n > 3
""")
def fallback_fanout(spark, d):
    """One supported candidate resolves, two or three are copies, more are dropped."""
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("candidate")).distinct()
    return evidence.classified(rows, ["key"]).select("key", "n", "outcome", "candidate")


_HOST = r"^[a-z]+://([^/?#]+)"


@_query(rf"""
with h as (select page_id, regexp_extract(url, '{_HOST}', 1) as host from pages),
p as (select page_id, host, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[1:i], '.'))) as module from h),
m as (select distinct string_split(host, '.')[1] as module from h)
select p.page_id, p.host from p semi join m on m.module = p.module group by 1, 2
""")
def evidence_semi(spark, d):
    """Imports that give evidence of a module: dotted prefixes turn the prefix test into an equi join."""
    hosts = _t(spark, d, "pages").select("page_id", F.regexp_extract("url", _HOST, 1).alias("host"))
    known = hosts.select(F.split("host", r"\.")[0].alias("module")).distinct()
    return evidence.import_evidence(hosts, ["page_id", "host"], "host").join(known, "module", "left_semi").select("page_id", "host").distinct()


@_query(rf"""
with h as (select page_id, regexp_extract(url, '{_HOST}', 1) as host, url from pages)
select regexp_extract(host, '[^.]*$') as short, host, min(page_id)::bigint as page_id, count(*)::bigint as sites from h group by 1, 2
""")
def name_index(spark, d):
    """Sites by the last dotted segment; the first of equal ones counts."""
    rows = _t(spark, d, "pages").select("page_id", F.regexp_extract("url", _HOST, 1).alias("host")).withColumn("short", S.short_name(F.col("host")))
    first = ranking.first_wins(rows, ["short", "host"], ["page_id"])
    return first.join(rows.groupBy("host").agg(F.count(F.lit(1)).alias("sites")), "host").select("short", "host", "page_id", "sites")


@_query("""
with t as (select l_partkey, l_orderkey, l_linenumber, l_quantity * (1 - l_discount) as score,
  row_number() over (partition by l_partkey order by l_quantity * (1 - l_discount) desc, l_orderkey, l_linenumber) as rank, count(*) over (partition by l_partkey) as total from lineitem)
select l_partkey, l_orderkey, l_linenumber, rank::int as rank, total::bigint as total, greatest(total - 8, 0)::bigint as dropped from t where rank <= 8
""")
def topk_sites(spark, d):
    """The best eight sites of each unit, with totals from before the cap."""
    rows = _t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("score"))
    totals = rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("total"))
    best = ranking.top_k(rows, ["l_partkey"], [F.desc("score"), F.asc("l_orderkey"), F.asc("l_linenumber")], 8)
    return ranking.with_totals(best, totals, ["l_partkey"], 8).select("l_partkey", "l_orderkey", "l_linenumber", F.col("rank").cast("int").alias("rank"), "total", F.col("dropped").cast("bigint").alias("dropped"))


@_query("""
with t as (select source, doc_id, greatest(1, floor(length(coalesce(text, '')) / 3.3::double))::bigint + 20 as cost from documents),
r as (select source, doc_id, sum(cost) over (partition by source order by doc_id rows unbounded preceding) as running from t)
select source, doc_id, running::bigint as running from r where running <= 8000
""")
def budget_pack(spark, d):
    """The longest prefix of each group that fits a token budget."""
    rows = _t(spark, d, "documents").select("source", "doc_id", (S.token_estimate(F.col("text")) + 20).alias("cost"))
    return ranking.within_budget(rows, ["source"], [F.asc("doc_id")], F.col("cost"), 8000, least=21).select("source", "doc_id", F.col("running").cast("bigint").alias("running"))


@_query("select doc_id, greatest(1, floor(length(coalesce(text, '')) / 3.3::double))::bigint as tokens from documents")
def token_estimate(spark, d):
    return _t(spark, d, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


@_query(r"""
with l as (select doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]') as raw from documents where text is not null),
s as (select doc_id, case when len(raw) > 0 and raw[len(raw)] = '' then raw[1:len(raw) - 1] else raw end as lines from l),
w as (select doc_id, lines, (len(lines) + 1) // 2 as k from s),
b as (select doc_id, lines, k, greatest(k - 3, 1) as a, least(k + 3, len(lines)) as z from w)
select doc_id, array_to_string(list_transform(range(a, z + 1), lambda i: (case when i = k then '>' else ' ' end) || lpad(i::varchar, length(z::varchar)::int, ' ') || '|' || lines[i]), chr(10)) as snippet from b
""")
def snippet(spark, d):
    """Numbered lines around the middle line of each document."""
    docs = _t(spark, d, "documents").filter("text is not null").select("doc_id", S.split_lines(F.col("text")).alias("lines"))
    middle = F.floor((F.size("lines") + 1) / 2).cast("int")
    return docs.select("doc_id", S.numbered_window(F.col("lines"), middle, 3).alias("snippet"))


@_query(r"select page_id, regexp_matches(url, '(^|/)(en/|[^/]*\?page)') as flagged, regexp_matches(url, '(^|/)(tests?/|test_[^/]*\.py$|[^/]*_test\.py$|conftest\.py$)') as is_test from pages")
def test_path(spark, d):
    return _t(spark, d, "pages").select("page_id", F.col("url").rlike(r"(^|/)(en/|[^/]*\?page)").alias("flagged"), S.is_test_path(F.col("url")).alias("is_test"))


@_query("""
with f as (select event_id, user_id, hour(ts)::int as line, value from events), st as (select user_id, line from f where value >= 50)
select f.event_id, f.user_id, f.line from f where value < 50 and not exists (select 1 from st where st.user_id = f.user_id and abs(st.line - f.line) <= 1)
union all select event_id, user_id, line from f where value >= 50
""")
def merge_anti_range(spark, d):
    """Proven findings own their lines and both neighbours; others survive elsewhere."""
    rows = _t(spark, d, "events").select("event_id", "user_id", F.hour("ts").alias("line"), "value")
    proven, others = rows.filter("value >= 50"), rows.filter("value < 50")
    return proven.unionByName(merge.without_neighbours(others, proven, "user_id", "line")).select("event_id", "user_id", "line")


@_query("""
with f as (select event_id, user_id, lower(trim(event_type)) as title, value from events where value >= 10),
k as (select *, row_number() over (partition by user_id, title order by event_id) as rn from f)
select event_id, user_id, title, row_number() over (partition by user_id order by value desc, event_id)::int as place from k where rn = 1
""")
def postprocess(spark, d):
    """Floor, first of each key, order within each file."""
    rows = _t(spark, d, "events").select("event_id", F.col("user_id").alias("file"), F.lit(None).cast("int").alias("line"), F.col("event_type").alias("title"), F.col("value").alias("confidence"), F.col("event_id").alias("ord"))
    kept = merge.postprocessed(rows, 10)
    place = F.row_number().over(W.partitionBy("file").orderBy(F.desc("confidence"), "event_id")).cast("int")
    return kept.select("event_id", F.col("file").alias("user_id"), S.finding_key(F.col("title")).alias("title"), place.alias("place"))


_SEVERITY = {"click": "low", "view": "info", "purchase": "critical", "signup": "High"}


@_query("""
with m as (select coalesce(case event_type when 'click' then 'low' when 'view' then 'info' when 'purchase' then 'critical' when 'signup' then 'high' end, 'none') as severity, user_id from events),
r as (select severity, user_id, case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 else 0 end as rk from m)
select user_id, count(*)::bigint as findings, max(rk)::int as worst, count(*) filter (where rk >= 3)::bigint as failing from r group by 1
""")
def severity_hist(spark, d):
    """Findings, the worst rank and those at or above the gate, by file."""
    kind = F.lit(None).cast("string")
    for event, severity in _SEVERITY.items():
        kind = F.when(F.col("event_type") == event, severity).otherwise(kind)
    rows = _t(spark, d, "events").withColumn("rank", S.severity_rank(kind))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("findings"), F.max("rank").alias("worst"), F.count_if(F.col("rank") >= 3).alias("failing"))


@_query("""
select event_id, event_id % 3 = 0 as real, case when event_id % 3 < 2 then round(value, 6)::double end as confidence from events
""")
def json_normalize(spark, d):
    """Verdicts out of model text: bare JSON, JSON inside of prose, and text without any."""
    said = F.format_string('{"real": %s, "confidence": %s}', F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"), F.col("value").cast("string"))
    text = F.when(F.col("event_id") % 3 == 0, said).when(F.col("event_id") % 3 == 1, F.concat(F.lit("I looked: "), said, F.lit(" That is all."))).otherwise(F.lit("no idea"))
    found = _t(spark, d, "events").select("event_id", verdict(text).alias("v"))
    return found.select("event_id", F.col("v.real").alias("real"), F.round("v.confidence", 6).alias("confidence"))


@_query("""
with e as (select event_id, '{"findings": [{"title": " ' || event_type || ' ", "line": ' || user_id || ', "severity": "HIGH", "confidence": ' || value || '}, {"title": ""}]}' as content, value, event_type, user_id from events)
select event_id, lower(event_type) as title, user_id::bigint as line, 'high' as severity, 'logic' as category, round(greatest(0.0, least(1.0, value)), 6)::double as confidence from e
""")
def model_findings(spark, d):
    """Findings out of model text, whether it is bare JSON or JSON inside of prose."""
    body = F.format_string('{"findings": [{"title": " %s ", "line": %s, "severity": "HIGH", "confidence": %s}, {"title": ""}]}', "event_type", F.col("user_id").cast("string"), F.col("value").cast("string"))
    prose = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here is what I found:\n"), body, F.lit("\nDone."))).otherwise(body)
    rows = _t(spark, d, "events").select("event_id", prose.alias("content"))
    return normalized(rows, "content", ["event_id"]).select("event_id", F.lower("title").alias("title"), "line", "severity", "category", F.round("confidence", 6).alias("confidence"))


@_query("""
with p as (select l.quality, d.n_chars > 1000 as said from labels l join documents d on d.doc_id = l.doc_id),
c as (select count(*) filter (where said and quality = 1)::bigint as tp, count(*) filter (where said and quality = 0)::bigint as fp, count(*) filter (where not said and quality = 1)::bigint as fn from p)
select tp, fp, fn, round(case when tp + fp = 0 then 1.0 else tp / (tp + fp) end, 9)::double as "precision", round(case when tp + fn = 0 then 1.0 else tp / (tp + fn) end, 9)::double as recall,
  round(case when 2 * tp + fp + fn = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end, 9)::double as f1 from c
""")
def score_prf(spark, d):
    """Precision, recall and F1 of a prediction."""
    from deltaloom.operators.matching import precision_recall

    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", (F.col("n_chars") > 1000).alias("said"))
    one = lambda c: c.cast("long")
    marks = rows.select(one(F.col("said") & (F.col("quality") == 1)).alias("tp"), one(F.col("said") & (F.col("quality") == 0)).alias("fp"), one(~F.col("said") & (F.col("quality") == 1)).alias("fn"))
    return precision_recall(marks).select("tp", "fp", "fn", _r("precision", 9), _r("recall", 9), _r("f1", 9))


@_query("""
with y as (select distinct l_partkey as p, l_suppkey as s, year(o_orderdate) as y from lineitem join orders on o_orderkey = l_orderkey where year(o_orderdate) in (1996, 1997)),
a as (select p, s from y where y = 1996), b as (select p, s from y where y = 1997)
select coalesce(a.p, b.p) as part, coalesce(a.s, b.s) as supplier, case when a.p is null then 'added' when b.p is null then 'removed' else 'kept' end as kind
from a full join b on a.p = b.p and a.s = b.s
""")
def set_deltas(spark, d):
    """Full outer comparison of two revisions: added, removed, kept."""
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y")), F.col("l_orderkey") == F.col("o_orderkey"))
    old, new = (rows.filter(F.col("y") == y).select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).distinct() for y in (1996, 1997))
    both = old.withColumn("o", F.lit(1)).join(new.withColumn("n", F.lit(1)), ["part", "supplier"], "full_outer")
    return both.select("part", "supplier", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept").alias("kind"))


@_query("""
select (select count(*) from documents)::bigint as files, (select count(*) from lineitem)::bigint as edges, (select count(distinct l_partkey) from lineitem)::bigint as targets,
  (select count(*) from (select l_orderkey from lineitem group by 1 having count(distinct l_suppkey) > 3))::bigint as too_ambiguous
""")
def stats(spark, d):
    """Index statistics: one row of counts, each from one aggregation."""
    line = _t(spark, d, "lineitem")
    files = _t(spark, d, "documents").agg(F.count(F.lit(1)).alias("files"))
    edges = line.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("l_partkey").alias("targets"))
    wide = line.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n")).agg(F.count_if(F.col("n") > 3).alias("too_ambiguous"))
    return files.crossJoin(edges).crossJoin(wide)  # three single rows


@_query("""
with r as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber) as rn from lineitem)
select l_partkey, l_suppkey, l_orderkey, l_linenumber from r where rn = 1
""")
def first_wins(spark, d):
    """The first row of each key, by an aggregate."""
    rows = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return ranking.first_wins(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@_query("""
with e as (select distinct o_custkey as src, l_suppkey as dst from orders join lineitem on o_orderkey = l_orderkey)
select distinct h1.src as start, c_custkey as via, h2.dst as reached
from e h1 join supplier on s_suppkey = h1.dst join customer on c_custkey = s_suppkey join e h2 on h2.src = c_custkey
""")
def two_hop(spark, d):
    """Two steps along all edges; each end has at most one wrapper, by key, so no row is filtered."""
    rows = _t(spark, d, "orders").select("o_orderkey", "o_custkey").join(_t(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    # An order is one row, so there are at most as many edges as lines; dealt by src, they are distinct and meet the second step where they are.
    edges = dealt(rows.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")), _t(spark, d, "lineitem").count(), "src").distinct()
    wrap = _t(spark, d, "customer").join(_t(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey")).select("c_custkey", "s_suppkey").distinct()
    first = edges.join(wrap, F.col("dst") == F.col("s_suppkey")).select(F.col("src").alias("start"), F.col("c_custkey").alias("via"))
    # Edges and wrappers are distinct and via is the wrapped supplier's key, so no row comes twice: the largest table, the result, isn't shuffled.
    return first.join(edges, F.col("via") == F.col("src")).select("start", "via", F.col("dst").alias("reached"))


@_query(r"""
with l as (select doc_id, regexp_split_to_array(trim(text, ' '), '\r\n|[\n\r\x0B\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]') as lines from documents where text is not null)
select doc_id, array_to_string(list_filter(lines, lambda x: regexp_matches(x, '^(@@|[+]|-)')), chr(10)) as compact from l
""")
def marked_lines(spark, d):
    """Only the lines of a compact diff."""
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", S.compact_diff(F.col("text")).alias("compact"))


@_query(scenarios.golden_sql())
def check_scenarios(spark, d):
    """The static checker over the bundled scenarios; its SQL is the golden list, not a second computation."""
    return scenarios.findings(spark).select("scenario", "file", F.col("line").cast("int").alias("line"), "severity").distinct()
