"""Quality rules whose cutoffs carry a guarantee: few good documents are rejected in each stratum.

Every document is measured once: a few counts, from them ratios ("signals"), each put into one of BINS
bins. Labelled documents give, for each stratum of length and each signal, how many good and bad ones
lie in each bin: a table of fixed size, whatever the input. From it a cutoff is certified by fixed-
sequence testing: from the mildest cutoff on, while the exact binomial test rejects "the false
rejection rate is at least `risk`" at level `delta` over all strata and signals (Bonferroni). The risk
of a stratum is shared by its signals, so the union of the rules keeps it. A cutoff is used only where
it also tells bad documents from good ones; without enough labels nothing is certified, and nothing
is rejected beyond the base rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import annotate, shielded

#: Signals by name: what they are is in _measure().
SIGNALS = ("symbols", "dup_lines", "repeats", "exclaims", "upper", "long_words")
#: Upper ends of the strata, in words.
STRATA = (50, 200, 1000)
BINS = 64

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BINS, _KEY = "quality_bins", "quality_key"
_SYMBOLS, _SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in 5-word windows that are found twice or more, the first included."""
    n = len(words) - 4
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = h ^ (h >> np.uint64(29))
    keys = h[:n] * _MIX[0]
    for i in range(1, 5):
        keys = (keys ^ (keys >> np.uint64(31))) * _MIX[0] + h[i : i + n] * _MIX[i]
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    return int((np.cumsum(cover) > 0).sum())


def _binned(value: float, half: float) -> int:
    """Monotone from 0 up to BINS - 1; `half` comes to the middle."""
    return min(BINS - 1, int(BINS * value / (value + half)))


def _measure(texts: list[str | None]) -> list:
    rows = []
    for text in texts:
        text = text or ""
        data = text.encode()
        words = data.split()
        n = len(words)
        chars = len(text) - sum(map(text.count, _SPACES))
        symbols = sum(map(text.count, _SYMBOLS))
        seen, dup, lines = set(), 0, 0
        for line in text.split("\n"):
            if line.strip(_SPACES):
                lines += 1
                dup += line in seen
                seen.add(line)
        repeats = repeated_words(words)
        some = max(n, 1)
        upper = len(data) - len(data.translate(None, _UPPER))
        signals = (symbols / some, dup / max(lines, 1), repeats / some, text.count("!") / some, upper / max(chars, 1), chars / some)
        halves = (0.2, 0.2, 0.2, 0.2, 0.2, 8.0)
        rows.append((n, chars, symbols, dup, repeats, bytes(_binned(v, h) for v, h in zip(signals, halves, strict=True)), xxhash.xxh3_64_intdigest(data) - (1 << 63)))
    return list(zip(*rows, strict=True)) if rows else [[]] * 7


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, the five counts, the bins of the signals (one byte each), and a hash of the text.

    A null text counts as one without words: all counts are 0.
    """
    return annotate(docs, text, keep, [*((c, pa.int64()) for c in _COUNTS), (_BINS, pa.binary()), (_KEY, pa.int64())], lambda: _measure)


def stratum() -> Column:
    """0 for the shortest documents, up to len(STRATA)."""
    return sum((F.col("n_words") >= s).cast("int") for s in STRATA)


def bin_of(signal: int) -> Column:
    return F.conv(F.hex(F.substring(F.col(_BINS), signal + 1, 1)), 16, 10).cast("int")


@dataclass(frozen=True)
class Rules:
    """cutoffs[(stratum, signal)]: the bin from which on documents are rejected."""

    cutoffs: dict[tuple[int, int], int] = field(default_factory=dict)

    def verdict(self) -> Column:
        """True for documents that no cutoff rejects."""
        at = stratum()
        bad = F.lit(False)
        for (s, signal), cut in sorted(self.cutoffs.items()):
            bad = bad | ((at == s) & (bin_of(signal) >= cut))
        return ~bad


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Binomial(n, p): the regularised incomplete beta function at 1 - p, exactly as far as floats go.

    Its continued fraction (modified Lentz) takes about as many terms as the square root of n, so a
    billion labels cost no more than a moment.
    """
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x >= (a + 1) / (a + b + 2):  # the fraction converges fast on the other side only
        return max(0.0, 1.0 - front * _beta_fraction(b, a, 1 - x) / b)
    return min(1.0, front * _beta_fraction(a, b, x) / a)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 1_000_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def certified_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int | None:
    """The cutoff to use for the counts of good and bad documents by bin, or None."""
    n, m = int(good.sum()), int(bad.sum())
    if not n or not m:
        return None
    best, gain = None, 0.0
    for cut in range(BINS - 1, 0, -1):
        false = int(good[cut:].sum())
        if binomial_tail(false, n, risk) > level:
            break
        now = bad[cut:].sum() / m - 10 * false / n
        if now > gain + 1e-12 and bad[cut:].sum() * n > 20 * false * m:
            best, gain = cut, now
    return best


def learn_rules(measured: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, doc_id: str = "doc_id") -> Rules:
    """Cutoffs from all labelled documents: at most `risk` of the good ones of a stratum are rejected, with confidence 1 - delta.

    labels has doc_id and quality (1 good, 0 bad); rows with a null in either are left out, and a
    document with both labels counts as good. An empty table certifies nothing, nor do labels that all
    agree. The test needs independent draws: rows of one document, and copies of one text, are one draw,
    and a good one if any of them is.
    """
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("quality").alias("_quality")).filter(F.col("_quality").isNotNull())
    rows = measured.join(known, F.col(doc_id) == F.col("_labelled"))
    signals = F.array(*(F.struct(F.lit(i).alias("signal"), bin_of(i).alias("bin")) for i in range(len(SIGNALS))))
    table = (
        rows.groupBy("n_words", _BINS, _KEY)
        .agg(F.max("_quality").alias("_quality"))
        .select(stratum().alias("stratum"), "_quality", F.explode(signals).alias("x"))
        .groupBy("stratum", "x.signal", "x.bin")
        .agg(F.sum((F.col("_quality") > 0).cast("long")).alias("good"), F.sum((F.col("_quality") <= 0).cast("long")).alias("bad"))
        .collect()  # at most strata * signals * BINS rows
    )
    good = np.zeros((len(STRATA) + 1, len(SIGNALS), BINS), np.int64)
    bad = np.zeros_like(good)
    for r in table:
        good[r.stratum, r.signal, r.bin], bad[r.stratum, r.signal, r.bin] = r.good, r.bad
    tests = good.shape[0] * good.shape[1]
    found = {(s, f): certified_cutoff(good[s, f], bad[s, f], risk / len(SIGNALS), delta / tests) for s in range(good.shape[0]) for f in range(good.shape[1])}
    return Rules({k: v for k, v in found.items() if v is not None})


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(measured: DataFrame, rules: Rules) -> DataFrame:
    """Adds base_failed and kept. Documents with no words fail the base rules."""
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & rules.verdict())


def passing(docs: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """The rows of docs that neither the base rules nor a cutoff rejects, with all their columns."""
    plain, name, back = shielded(docs)
    return back(judged(measure(plain, plain.columns, name(text)), rules).filter("kept"))
