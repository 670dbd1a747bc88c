"""Findings out of a model's text: parse, default, clamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# All values are read as text first, so that one bad value doesn't lose its finding.
_FIELDS = ("file", "line", "severity", "category", "title", "detail", "confidence", "suggestion")
_LIST = "array<struct<" + ", ".join(f"{f}: string" for f in _FIELDS) + ">>"


def _found(text: Column) -> Column:
    """The list of findings of a JSON object, or the JSON list itself."""
    listed = F.when(F.substring(F.ltrim(text), 1, 1) == "[", F.from_json(text, _LIST))
    return F.coalesce(F.from_json(text, f"struct<findings: {_LIST}>")["findings"], listed)


def findings_in(content: Column) -> Column:
    """The findings in a text that is JSON, or that has a JSON object between its first and last brace."""
    text = F.trim(content)
    return F.coalesce(_found(text), _found(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def normalized(rows: DataFrame, content: str, keep: list[str], path: Column | None = None) -> DataFrame:
    """A row for each finding with a title: severity medium, category logic and confidence 0.5 where they
    are missing, confidence within 0 and 1, a line that isn't a number null, file `path` where missing."""
    item = rows.select(*keep, *([path.alias("_path")] if path is not None else []), F.posexplode(findings_in(F.col(content))).alias("pos", "_f"))
    f = lambda name: F.col(f"_f.{name}")
    filled = lambda name, default: F.lower(F.coalesce(F.when(f(name) != "", f(name)), F.lit(default)))
    confidence = F.coalesce(f("confidence").try_cast("double"), F.lit(0.5))
    out = item.select(
        *keep,
        "pos",
        F.coalesce(F.when(f("file") != "", f("file")), F.col("_path") if path is not None else F.lit(None)).alias("file"),
        f("line").try_cast("bigint").alias("line"),
        filled("severity", "medium").alias("severity"),
        filled("category", "logic").alias("category"),
        F.trim(f("title")).alias("title"),
        F.trim(F.coalesce(f("detail"), F.lit(""))).alias("detail"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
        F.when(F.trim(f("suggestion")) != "", F.trim(f("suggestion"))).alias("suggestion"),
    )
    return out.filter(F.col("title").isNotNull() & (F.col("title") != ""))


def verdict(content: Column) -> Column:
    """struct(real, confidence) of a verification; unreadable text isn't real."""
    kind = "struct<real: boolean, confidence: string>"
    text = F.trim(content)
    first, block = F.from_json(text, kind), F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), kind)
    return F.struct(
        F.coalesce(first["real"], block["real"], F.lit(False)).alias("real"),
        F.coalesce(first["confidence"], block["confidence"]).try_cast("double").alias("confidence"),
    )
