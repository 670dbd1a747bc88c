"""The training-data operators as registered queries with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import crc_mod

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Labelled documents that a classifier is fitted on, at most.
LANGUAGE_SAMPLE, TOXIC_SAMPLE, CLEAN_SAMPLE = 6_000, 4_000, 8_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.llm.substring import repeat_report

    return repeat_report(_documents(spark, sf_dir), window=50)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.llm import toxicity

    docs = _documents(spark, sf_dir)
    model = toxicity.fit(*toxicity.sample_labelled(docs, _table(spark, sf_dir, "labels"), TOXIC_SAMPLE, CLEAN_SAMPLE, held_out_mod=5))
    return toxicity.score(docs, model, ["doc_id"]).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.llm.media import media_columns

    return media_columns(_documents(spark, sf_dir), ["doc_id"], media=False)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.llm.token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(_documents(spark, sf_dir), WORD_BPE, end_id=1))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.llm import langid

    docs = _documents(spark, sf_dir)
    known = docs.filter(crc_mod(F.col("doc_id"), 4) != 2)
    model = langid.fit(*langid.sample_counts(langid.sample_labelled(known, LANGUAGE_SAMPLE)))
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.llm.bpe_codec import encode_decode

    return encode_decode(_documents(spark, sf_dir), BYTE_BPE)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.llm.packing import pack

    return pack(_documents(spark, sf_dir), WORD_BPE, end_id=0, capacity=2048)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.llm.minhash import near_duplicates

    found = near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.llm import quality
    from deltaloom.llm.common import stage

    measured = stage(quality.measure(_documents(spark, sf_dir), ["doc_id"]), "measured")
    rules = quality.learn_rules(measured, _table(spark, sf_dir, "labels"))
    return quality.judged(measured, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.llm.token_counts import token_counts

    return token_counts(_documents(spark, sf_dir), WORD_BPE, limit=2048)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.llm.simhash import simhash_components

    return simhash_components(_documents(spark, sf_dir))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.llm import conversations

    turns = _table(spark, sf_dir, "conversations")
    return conversations.repair_report(turns, conversations.damaged(turns))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9_quality measures before its rules, which SQL can state."""
    from deltaloom.llm import quality

    return quality.measure(_documents(spark, sf_dir), ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"))


QUERIES = {f.__name__: f for f in (op1_substring, op2_toxicity, op3_media, op4_token_files, op5_language, op6_bpe_codec, op7_packing, op8_minhash, op9_quality, op10_token_counts, op11_simhash, op12_repair, quality_base_counts)}

#: crc32 bit by bit; one step of the recursion a row, over the four states with the cheapest text carried along.
_REPAIR_SQL = """
with recursive marked as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(flatten(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
      lambda ch: list_transform(range(8), lambda i: (ascii(ch) >> i::int) & 1))),
      lambda crc, bit: case when (xor(crc, bit) & 1) = 1 then xor(crc >> 1, 3988292384) else crc >> 1 end, 4294967295::bigint), 4294967295::bigint) % 20 as hit
  from conversations),
damaged as (
  select conv_id, turn, case when hit = 4 then 'user' else role end as role,
    case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when hit = 3 then [0, 1] else [0] end) as copy
  from marked where hit <> 0),
ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as place, left(role, 1) as initial,
    not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank from damaged),
told as (
  select *, not blank and row_number() over (partition by conv_id, role, text order by place) > 1 as duplicate,
    lag(initial) over (partition by conv_id order by place) || initial not in ('su', 'ua', 'au') as illegal from ordered),
rated as (select *, not blank and not duplicate and not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') as truncated from told),
inserts(source, dest, n) as (values ('', '', 0), ('', 'u', 1), ('', 'a', 2), ('s', 's', 0), ('s', 'u', 1), ('s', 'a', 2), ('u', 'u', 0), ('u', 'a', 1), ('a', 'a', 0), ('a', 'u', 1)),
opened as (select *, case when n = 0 then '' when n = 2 then 'user:' || chr(10) || 'assistant:' || chr(10) when dest = 'u' then 'user:' || chr(10) else 'assistant:' || chr(10) end as lines from inserts),
walk as (
  select distinct conv_id, 0::bigint as place, '' as state, {'cost': 0::bigint, 'audit': '', 'lines': ''} as best from rated
  union all
  select w.conv_id, r.place, e.state, min({'cost': w.best.cost + 2 * o.n + e.cost, 'audit': w.best.audit || repeat('I', o.n) || e.op, 'lines': w.best.lines || o.lines || e.line})
  from walk w join opened o on o.source = w.state join rated r on r.conv_id is not distinct from w.conv_id and r.place = w.place + 1,
  lateral (
    select 'D' as op, o.dest as state, 3 as cost, '' as line
    union all select 'K', r.initial, r.truncated::int, r.role || ':' || r.text || chr(10)
      where not r.blank and not r.duplicate and (r.initial = 's' and o.dest = '' or r.initial = 'u' and o.dest <> 'u' or r.initial = 'a' and o.dest = 'u')
    union all select 'R', case when o.dest = 'u' then 'a' else 'u' end, 2 + r.truncated::int, case when o.dest = 'u' then 'assistant:' else 'user:' end || r.text || chr(10)
      where not r.blank and not r.duplicate) e
  group by w.conv_id, r.place, e.state),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank, count_if(duplicate) as duplicate,
    count_if(truncated) as truncated, count_if(illegal) as illegal, max(place) as n from rated group by conv_id),
ended as (
  select w.conv_id, min({'cost': w.best.cost + 2 * o.n, 'audit': w.best.audit || repeat('I', o.n), 'lines': w.best.lines || o.lines}) as best
  from walk w join counted c on c.conv_id is not distinct from w.conv_id and c.n = w.place join opened o on o.source = w.state and o.dest in ('', 'a') group by w.conv_id),
every as (select distinct conv_id from conversations)
select e.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0)::bigint as blank, coalesce(c.duplicate, 0)::bigint as duplicate, coalesce(c.truncated, 0)::bigint as truncated,
  coalesce(c.illegal, 0)::bigint as illegal, coalesce(d.best.cost, 0)::bigint as cost, coalesce(d.best.audit, '') as audit, sha256(coalesce(left(d.best.lines, length(d.best.lines) - 1), '')) as repaired_sha256
from every e left join counted c on c.conv_id is not distinct from e.conv_id left join ended d on d.conv_id is not distinct from e.conv_id
"""
#: Every window of 50 words as a text of its own; its least document is where it stays.
_SUBSTRING_SQL = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from docs where len(w) >= 50),
windows as (select doc_id, i, array_to_string(w[i : i + 49], ' ') as body from starts),
firsts as (select body, min(doc_id) as first from windows group by body having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as place from windows join firsts using (body) where first < doc_id),
placed as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as place from docs),
kept as (select doc_id, string_agg(word, ' ' order by place) as body, count(*) as n from placed anti join gone using (doc_id, place) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(body, '')) as kept_sha256 from docs left join kept using (doc_id)
"""
_BASE_SQL = r"""
with docs as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 3)) as i from docs where len(w) >= 5),
windows as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i : i + 4], ' ')) as n from starts),
repeats as (select doc_id, count(distinct place) as n from (select doc_id, unnest(range(i, i + 5)) as place from windows where n > 1) group by doc_id),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from docs),
same as (select doc_id, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
counted as (
  select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(same.n, 0)::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words
  from docs left join same using (doc_id) left join repeats using (doc_id))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted
"""
ORACLES: dict[str, str] = {"op1_substring": _SUBSTRING_SQL, "op12_repair": _REPAIR_SQL, "quality_base_counts": _BASE_SQL}
