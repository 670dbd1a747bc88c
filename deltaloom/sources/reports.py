"""Reports of findings and packets: JSON, text for a terminal, a comment in Markdown."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.operators.merge import report_order


def findings_json(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """One row a repository: the report as JSON text, findings in report order."""
    item = F.struct("file", "line", "symbol", "severity", "category", "title", "detail", "confidence", "suggestion")
    ranked = findings.withColumn("_i", F.row_number().over(_by_repo(report_order())))
    lists = ranked.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", item.alias("f")))), lambda x: x["f"]).alias("findings"))
    own = [c for c in summary.columns if c != "repo"]
    both = summary.withColumn("summary", F.struct(*own)).select("repo", "summary").join(lists, "repo", "left")
    empty = F.array().cast(lists.schema["findings"].dataType)
    return both.select("repo", F.to_json(F.struct("summary", F.coalesce("findings", empty).alias("findings")), {"ignoreNullFields": "false"}).alias("json"))


def _by_repo(order: list):
    from pyspark.sql import Window

    return Window.partitionBy("repo").orderBy(*order)


def packets_json(packets: DataFrame) -> DataFrame:
    """One row a packet: JSON with its delta, callers, tokens and prompt."""
    delta = F.struct("kind", "breaking", "details", "old_signature", "new_signature")
    callers = F.transform("callers", lambda c: F.struct(c["path"].alias("path"), c["line"].alias("line"), c["caller"].alias("caller"), c["resolution"].alias("resolution"), c["is_test"].alias("is_test"), c["text"].alias("text")))
    body = F.struct("path", F.col("qualname").alias("symbol"), "fqname", delta.alias("delta"), callers.alias("callers"), "total_callers", "dropped_callers", "tokens", "prompt")
    return packets.select("repo", "place", F.to_json(body).alias("json"))


#: Terminal colours, and those of severities.
_COLOURS = {"red": 31, "yellow": 33, "blue": 34, "grey": 90, "bold": 1}
_SHADE = {"critical": "red", "high": "red", "medium": "yellow", "low": "blue", "info": "grey"}


def wants_colour(stream, env: dict[str, str]) -> bool:
    """A terminal that isn't asked to be plain."""
    return not env.get("NO_COLOR") and env.get("TERM") != "dumb" and bool(getattr(stream, "isatty", lambda: False)())


def painted(text: str, colour: str | None, on: bool) -> str:
    return f"\x1b[{_COLOURS[colour]}m{text}\x1b[0m" if on and colour in _COLOURS else text


def findings_text(findings: DataFrame, width: int = 100, colour: bool = False) -> str:
    """For people: by file, worst first, with a count of each severity. The findings of one review are few."""
    rows = findings.orderBy("file", *report_order()).collect()
    out, last, counts = [], None, {}
    for r in rows:
        if r["file"] != last:
            last = r["file"]
            out.append("\n" + painted(last, "bold", colour))
        counts[r["severity"]] = counts.get(r["severity"], 0) + 1
        out.append(f"  {r['line'] if r['line'] is not None else '-'}: {painted('[' + r['severity'] + ']', _SHADE.get(r['severity']), colour)} {r['title']} ({r['confidence']:.0%})")
        out += textwrap.wrap(r["detail"] or "", width, initial_indent="      ", subsequent_indent="      ")
    return "\n".join([*out, "", ", ".join(f"{n} {s}" for s, n in sorted(counts.items())) or "no findings"]).lstrip("\n")


def packets_text(packets: DataFrame) -> str:
    rows = packets.orderBy("repo", "place").collect()
    out = []
    for p in rows:
        out.append(f"{p['place']}. {p['path']} {p['qualname'] or '<module>'}: {p['kind']}{' (breaking)' if p['breaking'] else ''}, {p['total_callers']} callers, {p['tokens']} tokens")
        out += [f"     {d}" for d in list(p["details"])[:6]]
        out += [f"     {c['path']}:{c['line']}  {(c['text'] or '')[:80]}" for c in p["callers"]]
    return "\n".join(out)


def comment_markdown(findings: DataFrame) -> DataFrame:
    """One row a repository: a review comment. Posting it is up to the caller."""
    place = F.concat(F.lit("`"), F.col("file"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.lit("`"))
    line = F.concat_ws(
        "\n",
        F.concat(F.lit("- **"), F.upper("severity"), F.lit("** · "), F.col("category"), F.lit(" · "), place, F.lit(": **"), F.col("title"), F.lit("** ("), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%)")),
        F.when(F.col("detail") != "", F.concat(F.lit("  "), F.col("detail"))),
        F.when(F.col("suggestion") != "", F.concat(F.lit("  *Suggestion:* "), F.col("suggestion"))),
    )
    ranked = findings.withColumn("_i", F.row_number().over(_by_repo(report_order()))).withColumn("_l", line)
    return ranked.groupBy("repo").agg(F.concat(F.lit("## Review\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_l"))), lambda x: x["_l"]), "\n")).alias("body"))
