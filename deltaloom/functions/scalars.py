"""Scalar building blocks as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from mild to severe; confidence by kind of resolution.
SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCE = {"import": 1.0, "module": 0.95, "self": 0.9, "typed": 0.9, "local": 0.85, "name": 0.6, "attr": 0.55, "ambiguous": 0.35}
DEFAULT_CONFIDENCE = 0.3
#: Paths of tests.
# Fixed value: what counts as a test file.
TEST_PATH = r"(^|/)(tests?/|test_[^/]*\.py$|[^/]*_test\.py$|conftest\.py$)"
#: All line ends that Python's str.splitlines knows.
LINE_END = "\\R|[\\x1C-\\x1E]"


def severity_rank(severity: Column) -> Column:
    """0 for info up to 4 for critical; unknown and null count as 0."""
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(severity))
    return F.coalesce(F.greatest(place - 1, F.lit(0)), F.lit(0)).cast("int")


def confidence_of(resolution: Column) -> Column:
    out = F.lit(DEFAULT_CONFIDENCE)
    for kind, value in CONFIDENCE.items():
        out = F.when(resolution == kind, F.lit(value)).otherwise(out)
    return out


def short_name(dotted: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(dotted, ".", -1)


def owner_name(dotted: Column) -> Column:
    """What comes before the last dot; null without one."""
    return F.when(F.instr(dotted, ".") > 0, F.regexp_extract(dotted, r"^(.*)\.[^.]*$", 1))


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def token_estimate(text: Column) -> Column:
    """3.3 characters a token, rounded down, 1 at least; null counts as empty."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / F.lit(3.3))).cast("bigint")


def site_score(resolution: Column, other_file: Column, test: Column, contract: Column) -> Column:
    """How much a call site matters: its confidence, more in another file, and in tests of a changed contract."""
    return confidence_of(resolution) + F.when(other_file, 0.3).otherwise(0.0) + F.when(test, F.when(contract, 0.15).otherwise(-0.1)).otherwise(0.0)


def split_lines(text: Column) -> Column:
    """Lines as Python's str.splitlines gives them: a line end at the very end opens no further line.

    The text is split once: named in each branch, the split would be made again in each.
    """
    return F.transform(F.array(F.split(text, LINE_END)), lambda lines: F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines))[0]


def numbered_window(lines: Column, line: Column, radius: int) -> Column:
    """Lines line - radius .. line + radius with right-aligned numbers; `>` marks the line itself."""
    start, end = F.greatest(line - radius, F.lit(1)), F.least(line + radius, F.size(lines))
    width = F.length(end.cast("string"))
    shown = F.transform(
        F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))),
        lambda x, i: F.concat(F.when(start + i == line, ">").otherwise(" "), F.lpad((start + i).cast("string"), width, " "), F.lit("|"), x),
    )
    return F.array_join(shown, "\n")


def numbered_slice(lines: Column, start: Column, end: Column, most: int) -> Column:
    """Lines start .. end with numbers; of more than `most`, the middle is left out and counted."""
    last = F.least(end, F.size(lines))
    width = F.length(last.cast("string"))
    all_ = F.transform(F.slice(lines, start, F.greatest(last - start + 1, F.lit(0))), lambda x, i: F.concat(F.lpad((start + i).cast("string"), width, " "), F.lit("|"), x))
    gone = F.size(all_) - F.lit(most - 20) - 15
    cut = F.concat(F.slice(all_, 1, most - 20), F.array(F.concat(F.lit("...| "), gone.cast("string"), F.lit(" lines left out ..."))), F.slice(all_, -15, 15))
    return F.array_join(F.when(F.size(all_) > most, cut).otherwise(all_), "\n")


def head_slice(lines: Column, start: Column, end: Column, most: int) -> Column:
    """Lines start .. end without numbers; of more than `most`, the first most - 5 and a remark on how many follow."""
    body = F.slice(lines, start, F.greatest(F.least(end, F.size(lines)) - start + 1, F.lit(0)))
    rest = F.size(body) - F.lit(most - 5)
    cut = F.concat(F.slice(body, 1, most - 5), F.array(F.format_string("# %d more lines", rest)))
    return F.array_join(F.when(F.size(body) > most, cut).otherwise(body), "\n")


def compact_diff(diff: Column) -> Column:
    """Only hunk heads, added and removed lines."""
    return F.array_join(F.filter(split_lines(F.trim(diff)), lambda x: x.rlike(r"^(@@|\+|-)")), "\n")


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole, and `empty` where whole is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def clean_comment(body: Column, most: int = 450) -> Column:
    """A review comment without badges, images, folded blocks and tags; links keep their text."""
    # What is taken out, in this order.
    for pattern, by in (
        (r"(?s)\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)", ""),
        (r"(?s)!\[[^\]]*\]\([^)]*\)", ""),
        (r"(?s)<details[^>]*>.*?</details>", ""),
        (r"(?s)<[^>]+>", ""),
        (r"(?s)\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\s+", " "),
    ):
        body = F.regexp_replace(body, pattern, by)
    return F.substring(F.trim(body), 1, most)


def dotted_prefixes(dotted: Column, separator: str = ".") -> Column:
    """a.b.c -> [a, a.b, a.b.c]: turns a prefix test into an equi join."""
    parts = F.split(dotted, f"\\Q{separator}\\E")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), separator))


def dotted_suffixes(dotted: Column, least: int = 2) -> Column:
    """w.x.y.z -> [y.z, x.y.z]: the suffixes of `least` words or more that leave a word out; turns a suffix test into an equi join."""
    parts = F.split(dotted, r"\.")
    lengths = F.when(F.size(parts) > least, F.sequence(F.lit(least), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda n: F.array_join(F.slice(parts, -n, n), "."))


def finding_key(title: Column) -> Column:
    return F.lower(F.trim(title))
