"""The jobs as registered queries: each runs twice over the whole tables into one new folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from deltaloom.operators.staging import shared_dir
from jobs import companion_history, scan_texts
from jobs.common import config


def job1_scan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in texts, after a run and one that finds nothing new."""
    base = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        scan_texts.run(spark, f"{sf_dir}/documents.parquet", f"{base}/findings", f"{base}/checkpoint", config(scan_texts.CONFIG))
    return scan_texts.read(spark, f"{base}/findings")


def job2_companion_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companions of files, after two runs over all years."""
    base = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        companion_history.run(spark, f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet", base, config(companion_history.CONFIG))
    return companion_history.read(spark, base)


_SCAN_SQL = r"""
with rules(ord, title, layer, severity, confidence, pattern) as (values
  (0, 'credential in text', 'proof', 'critical', 0.95::double, '(token|secret|password|api_key) ?[=:] ?["''][0-9A-Za-z_-]{16,}["'']'),
  (1, 'mail address', 'proof', 'high', 0.9, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}'),
  (2, 'phone number', 'proof', 'high', 0.85, '[+][0-9]{1,3} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}'),
  (3, 'card number', 'hint', 'medium', 0.6, '(^|[^0-9])[0-9]{16}([^0-9]|$)'),
  (4, 'network address', 'hint', 'medium', 0.6, '(^|[^0-9.])[0-9]{1,3}([.][0-9]{1,3}){3}([^0-9.]|$)'),
  (5, 'Card Number ', 'hint', 'low', 0.55, '[0-9]{16}'),
  (6, 'licence notice', 'hint', 'info', 0.8, '(Licensed|Released) under the')),
split as (select coalesce(source, '') || '/' || doc_id as file, regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]') as raw from documents where text is not null),
lines as (select file, unnest(range(1, len(raw) + 1))::int as line, unnest(raw) as text, len(raw) as n from split),
hits as (select l.file, l.line, r.ord::int as ord, r.title, r.layer, r.severity, r.confidence, left(regexp_replace(l.text, r.pattern, '[...]', 'g'), 120) as excerpt,
    greatest(1, floor(length(l.text) / 3.3::double))::bigint as tokens
  from lines l join rules r on regexp_matches(l.text, r.pattern)),
merged as (select * from hits h where layer = 'proof' or not exists (select 1 from hits p where p.layer = 'proof' and p.file = h.file and abs(p.line - h.line) <= 1)),
kept as (select *, row_number() over (partition by file, line, lower(trim(title)) order by ord) as rn from merged)
select file, line, ord, title, layer, severity, confidence, excerpt, tokens, 0::bigint as batch from kept where rn = 1
"""
_COMPANIONS_SQL = """
with cf as (select distinct l_orderkey as c, l_partkey as p from lineitem join orders on o_orderkey = l_orderkey),
ok as (select c from cf group by c having count(*) between 2 and 30),
pairs as (select x.p as a, y.p as b, count(*)::bigint as n from cf x join ok on ok.c = x.c join cf y on y.c = x.c and y.p <> x.p group by 1, 2),
ranked as (select a, b, n, row_number() over (partition by a order by n desc, b) as rank, max(n) over (partition by a) as most from pairs)
select a, b, n, rank::int as rank from ranked where rank <= 3 and n >= 3 and n >= 0.4 * most
"""
QUERIES = {f.__name__: f for f in (job1_scan_texts, job2_companion_history)}
ORACLES = {"job1_scan_texts": _SCAN_SQL, "job2_companion_history": _COMPANIONS_SQL}
