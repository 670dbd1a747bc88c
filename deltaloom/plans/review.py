"""The optional reviewer: a function from prompt to text, run over packets, and its merge with what is proven."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.model_output import normalized, verdict
from deltaloom.functions.scalars import severity_rank
from deltaloom.operators.merge import without_neighbours
from deltaloom.operators.ranking import first_wins, top_k
from deltaloom.operators.staging import stage

#: prompt -> dict with content, and prompt_tokens, eval_tokens, duration_ms, truncated where known.
Reviewer = Callable[[str], dict]
#: Errors of a reviewer that a report lists.
ERRORS = 5
_CHAT = "content string, prompt_tokens long, eval_tokens long, duration_ms long, truncated boolean, error string"


def _asked(rows: DataFrame, prompt: str, reviewer: Reviewer, workers: int) -> DataFrame:
    """rows with the reviewer's answer; an exception becomes `error`. workers: calls at the same time."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + _CHAT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = []
            for text in pdf[prompt]:
                try:
                    got = reviewer(text)
                    answers.append((got.get("content", ""), *(int(got.get(k, 0)) for k in ("prompt_tokens", "eval_tokens", "duration_ms")), bool(got.get("truncated", False)), None))
                except Exception as e:  # noqa: BLE001  one failed call is a row of errors, not a failed review
                    answers.append((None, 0, 0, 0, False, str(e)))
            names = ["content", "prompt_tokens", "eval_tokens", "duration_ms", "truncated", "error"]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(answers, columns=names).astype({"content": object, "error": object})], axis=1)

    return rows.repartition(max(1, workers)).mapInPandas(run, schema)


def verification_prompt(title: Column, detail: Column, file: Column, line: Column, code: Column) -> Column:
    """What a sceptic gets: the claim, and the code that it points at."""
    place = F.concat(F.lit("  "), file, F.lit(":"), F.coalesce(line.cast("string"), F.lit("-")), F.lit("  "), title)
    claim = F.lit("Someone reported this:"), place, F.concat(F.lit("  "), F.coalesce(detail, F.lit("")))
    shown = F.lit(""), F.lit("The code:"), F.lit("```python"), F.coalesce(code, F.lit("")), F.lit("```"), F.lit("")
    return F.concat_ws("\n", *claim, *shown, F.lit("Is it a real defect of this code? Refute it unless the code proves it."))


def review(packets: DataFrame, reviewer: Reviewer, proven: DataFrame | None = None, workers: int = 2, floor: float = 0.45, verify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(findings, calls): what the reviewer says of packets with prompts, and a row for each of its calls.

    With `verify`, each of its findings is asked about again, with the call site next to it or else the
    changed source; what isn't real goes, and the verdict caps the confidence. A failed verification
    keeps the finding. Proven findings own their lines and both neighbours.
    """
    calls = _asked(packets.select("repo", "path", "qualname", "fqname", "prompt", "callers", "new_source"), "prompt", reviewer, workers)
    calls = stage(calls, "reviewer")  # a reviewer is asked once, even if an executor is lost
    said = normalized(calls.filter("error is null"), "content", ["repo", "fqname", "callers", "new_source"], F.col("path"))
    said = said.withColumnRenamed("fqname", "symbol").withColumn("ord", F.xxhash64("repo", "file", "symbol", "pos"))
    if verify:
        near = F.filter("callers", lambda c: (c["path"] == F.col("file")) & (F.abs(c["line"] - F.col("line")) <= 4))
        code = F.coalesce(F.get(near, F.lit(0))["snippet"], F.col("new_source"))
        ask = verification_prompt(F.col("title"), F.col("detail"), F.col("file"), F.col("line"), code)
        judged = _asked(said.withColumn("question", ask).drop("callers", "new_source"), "question", reviewer, workers).withColumn("v", verdict(F.col("content")))
        judged = judged.filter(F.col("error").isNotNull() | F.col("v.real"))
        said = judged.withColumn("confidence", F.when(F.col("error").isNotNull(), F.col("confidence")).otherwise(F.least("confidence", F.coalesce("v.confidence", "confidence"))))
    columns = ["repo", "file", "line", "symbol", "severity", "category", "title", "detail", "confidence", "suggestion", "ord"]
    said = said.select(columns).withColumn("origin", F.lit("model"))
    if proven is not None:
        place = lambda df: df.withColumn("_at", F.concat_ws("\x00", "repo", "file"))
        said = without_neighbours(place(said), place(proven), "_at", "line").drop("_at")
        said = proven.select(columns + ["origin"]).unionByName(said)
    kept = said.withColumn("_key", F.struct((F.col("origin") != "static").cast("int"), "ord"))
    kept = first_wins(kept.filter(F.col("confidence") >= floor).withColumn("_t", F.lower(F.trim("title"))), ["repo", "file", "line", "_t"], ["_key"])
    return kept.drop("_t", "_key"), calls


def summary(findings: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """One row a repository: findings, worst severity, and the reviewer's totals, how often it failed, and its first ERRORS errors by symbol."""
    rank = severity_rank(F.col("severity"))
    out = findings.groupBy("repo").agg(F.count(F.lit(1)).alias("findings"), F.max_by("severity", rank).alias("worst_severity"))
    if calls is None:
        return out
    totals = calls.groupBy("repo").agg(*(F.sum(c).alias(c) for c in ("prompt_tokens", "eval_tokens", "duration_ms")), F.count_if("truncated").alias("truncated_units"), F.count(F.lit(1)).alias("units"), F.count("error").alias("failed"))
    shown = top_k(calls.filter("error is not null"), ["repo"], [F.asc("path"), F.asc("qualname"), F.asc("error")], ERRORS)
    shown = shown.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "error"))), lambda x: x["error"]).alias("errors"))
    told = totals.join(shown, "repo", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
    return told.join(out, "repo", "full_outer").na.fill(0, ["findings"])


def gate(findings: DataFrame, fail_on: str = "high") -> int:
    """1 if any finding is at least that severe, else 0."""
    return int(not findings.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(fail_on))).isEmpty())


