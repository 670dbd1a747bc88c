"""Measures of a review: tokens against whole files, and review sets with golden comments and a judge."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.functions.scalars import clean_comment, ratio, token_estimate
from deltaloom.operators.evidence import import_evidence
from deltaloom.plans import check, packets
from deltaloom.plans.config import Config
from deltaloom.sources import python_code as P
from deltaloom.sources import repository

_GOLDEN = "comment string, severity string"
_COMMENT = "path string, line bigint, severity string, title string, body string"
MANIFEST = f"url string, repo string, num bigint, base string, head string, title string, goldens array<struct<{_GOLDEN.replace(' string', ': string')}>>"
RESULT = f"pr bigint, mode string, packets bigint, comments array<struct<{_COMMENT.replace(' string', ': string').replace(' bigint', ': bigint')}>>"
#: prompt -> number of the candidate that says the same, or -1.
Judge = Callable[[str], int]


def full_context(ix: check.Index) -> DataFrame:
    """repo, path, prompt: the naive prompt of each changed Python file, with its diff, itself and all files that import it.

    An import of a module or of anything below it counts: dotted prefixes make that an equi join.
    """
    changed = ix.diffs.filter("not `binary`").filter(F.col("path").endswith(".py"))
    changed = changed.withColumn("module", F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", "."), r"\.__init__$", ""))
    imports = P.table_of(ix.parsed, "imports").select("repo", F.col("path").alias("user"), "target")
    users = changed.select("repo", "path", "module").join(import_evidence(imports, ["repo", "user"]), ["repo", "module"]).select("repo", "path", "user")
    shown = users.filter("user <> path").withColumn("own", F.lit(1)).unionByName(changed.select("repo", "path", F.col("path").alias("user"), F.lit(0).alias("own"))).distinct()
    part = F.format_string("<file path='%s'>\n%s\n</file>", "user", F.rtrim("src"))
    texts = shown.join(ix.files.select("repo", F.col("path").alias("user"), "src"), ["repo", "user"]).groupBy("repo", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("own", "user", part.alias("part")))), lambda x: x["part"]).alias("parts"))
    diff = F.format_string("<change path='%s'>\n%s\n</change>", "path", F.array_join(F.flatten(F.transform("hunks", lambda h: F.concat(F.array(h["header"]), h["lines"]))), "\n"))
    ask = F.lit("What does the change break in these files? List findings as JSON, none if there are none.")
    return changed.join(texts, ["repo", "path"], "left").select("repo", "path", F.concat_ws("\n", diff, F.array_join("parts", "\n"), ask).alias("prompt"))


def scale_row(spark: SparkSession, modules: int, callers: int) -> DataFrame:
    """modules, callers, full, packets, ratio: estimated tokens of both kinds of prompts after one breaking change of a synthetic tree."""
    old = repository.synthetic(spark, modules, callers)
    new = repository.overlay(old, spark.createDataFrame([("", "orbit/formula.py", "def period(mass, axis, centre):\n    return axis ** 1.5 / mass\n")], "repo string, path string, src string"))
    ix = check.build_index(old, new)
    told = lambda df, name: df.agg(F.coalesce(F.sum(token_estimate(F.col("prompt"))), F.lit(0)).alias(name))
    both = told(full_context(ix), "full").crossJoin(told(packets.with_prompts(packets.build(ix, Config())), "packets"))  # two single rows
    return both.select(F.lit(modules).alias("modules"), F.lit(callers).alias("callers"), "full", "packets", ratio(F.col("full"), F.col("packets"), 0.0).alias("ratio"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The pull requests of a review set with their golden comments, from a JSON file."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def results(spark: SparkSession, path: str) -> DataFrame:
    """What a review said of pull requests, from JSON files."""
    return spark.read.schema(RESULT).json(path, multiLine=True)


def candidates(found: DataFrame, known: DataFrame, tool: str) -> DataFrame:
    """url, tool, comments (cleaned texts, in order) of a tool's results, joined to the manifest by number."""
    said = F.transform("comments", lambda c: clean_comment(F.concat(F.lit("("), F.coalesce(c["path"], F.lit("None")), F.lit(":"), F.coalesce(c["line"].cast("string"), F.lit("None")), F.lit(") "), F.coalesce(c["body"], F.lit("")))))
    return found.join(known.select("url", "num"), F.col("pr") == F.col("num")).select("url", F.lit(tool).alias("tool"), said.alias("comments"))


def question(golden: Column, severity: Column, comments: Column) -> Column:
    """What a judge is asked about one expected remark and all that were made."""
    listed = F.array_join(F.transform(comments, lambda c, i: F.format_string("%d: %s", i, c)), "\n")
    return F.format_string("Expected of a review (%s):\n%s\n\nIt remarked:\n%s\n\nAnswer with the number of the remark that makes the same point; with -1 if none does.", F.coalesce(severity, F.lit("unrated")), golden, listed)


def _asked(judge: Judge) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def one(prompt: str | None) -> int | None:
        try:
            return None if prompt is None else judge(prompt)
        except Exception:  # noqa: BLE001  whatever keeps a judge from answering, nothing is matched
            return None

    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in prompts:
            yield pd.Series([one(p) for p in part], dtype="Int64")

    return F.pandas_udf(run, "long", F.PandasUDFType.SCALAR_ITER)


def judged(known: DataFrame, said: DataFrame, judge: Judge) -> DataFrame:
    """url, tool, golden, matched, comments, matched_comments of each tool's review of a pull request.

    A row for each expected remark, spread over all tasks, so reviews with many are no slower than others.
    The judge sees those with candidates; an answer that names no candidate, or an exception, is no match.
    """
    rows = known.select("url", F.posexplode_outer("goldens").alias("place", "g")).join(said, "url")
    prompt = F.when(F.col("g").isNotNull() & (F.size("comments") > 0), question(F.col("g.comment"), F.col("g.severity"), F.col("comments")))
    answers = rows.withColumn("prompt", prompt).repartition("url", "tool", "place").withColumn("said", _asked(judge)("prompt"))
    hit = F.when(F.col("said").between(0, F.size("comments") - 1), F.col("said"))
    return answers.groupBy("url", "tool").agg(
        F.count("g").alias("golden"), F.count(hit).alias("matched"), F.max(F.size("comments")).cast("long").alias("comments"), F.count_distinct(hit).alias("matched_comments")
    )


def totals(scores: DataFrame) -> DataFrame:
    """One row a tool: sums, recall (0 without goldens) and precision (1 without comments); tools without goldens are left out."""
    sums = scores.groupBy("tool").agg(*(F.sum(c).alias(c) for c in ("golden", "matched", "comments", "matched_comments"))).filter("golden > 0")
    return sums.withColumns({"recall": ratio(F.col("matched"), F.col("golden"), 0.0), "precision": ratio(F.col("matched_comments"), F.col("comments"), 1.0)})


def exported(findings: DataFrame) -> str:
    """Findings as the JSON list of comments that review sets take. The findings of one review are few."""
    from deltaloom.operators.merge import report_order

    rows = findings.orderBy(*report_order()).select("file", "line", "severity", "title", "detail", "suggestion").collect()
    body = lambda r: f"**{r['title']}**\n\n{r['detail']}" + (f"\n\nSuggestion: {r['suggestion']}" if r["suggestion"] else "")
    return json.dumps([{"path": r["file"], "line": r["line"], "severity": r["severity"], "body": body(r)} for r in rows], indent=2)
