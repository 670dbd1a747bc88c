"""Language identification, words first: known words by their log frequency in each language, unseen
words by their longest known character n-grams, from ORDERS[0] letters down to one.

Frequencies of words and n-grams are counted by tasks over a bounded sample of labelled documents
(`max_docs`, or LEAST_DOCS a language if that is more). That sample is the only bound: the model keeps
every word and n-gram of it, as rows of one table, and every language that has a label is learnt.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.llm.common import annotate, listed, one_core, slices, stage, unstage

ORDERS = (5, 4, 3, 2, 1)
LEAST_DOCS = 20
#: Distinct words that a task remembers the scores of.
REMEMBERED = 150_000
_WORD = re.compile(r"[^\W\d_]+")
_SMOOTH = 0.1


@dataclass
class LanguageModel:
    """Rows of the tables by word and by n-gram, and log frequencies in each language."""

    langs: list[str]
    words: dict[str, int]
    word_table: np.ndarray
    grams: dict[str, int]
    gram_table: np.ndarray

    def word_scores(self, word: str) -> np.ndarray:
        """Log frequency of the word for each language, or the mean of its n-grams' at the longest known order."""
        own = self.words.get(word)
        if own is not None:
            return self.word_table[own]
        for n in ORDERS:
            found = [g for x in grams_of(word, n) if (g := self.grams.get(x)) is not None]
            if found:
                return self.gram_table[found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word whose ends are marked."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _log_table(counts: dict[str, Counter], langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    row = {x: i for i, x in enumerate(sorted(set().union(*(counts.get(lang, ()) for lang in langs))))}
    table = np.zeros((len(row), len(langs)))
    for k, lang in enumerate(langs):
        own = counts.get(lang, Counter())
        table[np.fromiter(map(row.__getitem__, own), np.int64, len(own)), k] = np.fromiter(own.values(), float, len(own))
    below = np.log(table.sum(axis=0) + _SMOOTH * max(len(row), 1))
    return row, (np.log(table + _SMOOTH) - below).astype(np.float32)


def counted(samples: Iterable[tuple[str, str]]) -> dict[str, Counter]:
    """By language, how often each word occurs in its (language, text) pairs."""
    words: dict[str, Counter] = {}
    for lang, text in samples:
        words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
    return words


def counted_grams(words: dict[str, Counter]) -> dict[str, Counter]:
    """By language, how often each n-gram of every order occurs in counted words."""
    grams: dict[str, Counter] = {}
    for lang, own in words.items():
        into = grams.setdefault(lang, Counter())
        for w, c in own.items():
            for n in ORDERS:
                for g in grams_of(w, n):
                    into[g] += c
    return grams


def fit(words: dict[str, Counter], grams: dict[str, Counter]) -> LanguageModel:
    """A model from counts of words and of n-grams by language; orders are normalised apart."""
    langs = sorted(words)
    rows, tables = {}, [np.zeros((0, len(langs)), np.float32)]
    for n in ORDERS:
        own, table = _log_table({lang: Counter({g: c for g, c in grams.get(lang, {}).items() if len(g) == n}) for lang in langs}, langs)
        at = len(rows)
        rows.update((g, at + i) for g, i in own.items())
        tables.append(table)
    return LanguageModel(langs, *_log_table(words, langs), rows, np.concatenate(tables))


def sample_labelled(docs: DataFrame, max_docs: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """l, t: at most max_docs labelled texts (LEAST_DOCS a language if that is more), shared evenly by the languages.

    Copies of a text count once in a language, so a group of copies is neither the whole sample nor all
    that comes to one task. Texts are chosen by a hash of theirs, ranked within the few that pass it.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"), F.xxhash64(text).alias("key"))
    sizes = known.groupBy("l").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()  # one row a language
    share = max(LEAST_DOCS, max_docs // max(1, len(sizes)))
    # A few more than the share pass the hash; the rank within them makes the bound exact.
    most = F.create_map(*(F.lit(x) for r in sizes for x in (r["l"], min(1.0, 1.2 * share / max(1, r["n"]))))) if sizes else None
    unit = F.pmod("key", F.lit(1_000_003)) / 1_000_003
    some = known.filter(unit < most[F.col("l")]) if sizes else known.limit(0)
    once = some.dropDuplicates(["l", "key"])
    rank = F.row_number().over(W.partitionBy("l").orderBy(unit, "key"))
    return stage(once.withColumn("rank", rank).filter(F.col("rank") <= share).select("l", "t"), "labelled-sample")


def sample_counts(samples: DataFrame) -> tuple[dict[str, Counter], dict[str, Counter]]:
    """Counts of the words and of the n-grams of sampled texts (l, t) by language, by tasks; all of them are
    collected, as the sample bounds them."""
    schema = pa.schema([("l", pa.string()), ("w", pa.string()), ("c", pa.int64())])

    def batch(found: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(lang, w, c) for lang, own in found.items() for w, c in own.items()]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, schema, strict=True)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        for part in slices(batches):
            yield batch(counted(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        for part in batches:
            words: dict[str, Counter] = {}
            for lang, w, c in zip(*(x.to_pylist() for x in part.columns), strict=True):
                words.setdefault(lang, Counter())[w] += c
            yield batch(counted_grams(words))

    def gathered(table: DataFrame, langs: Iterable[str]) -> dict[str, Counter]:
        out = {lang: Counter() for lang in langs}
        for lang, x, c in zip(*(listed(y.combine_chunks()) for y in table.select("l", "w", "c").toArrow().columns), strict=True):
            out[lang][x] = c
        return out

    langs = [r["l"] for r in samples.select("l").distinct().collect()]  # texts without a letter still have a language
    sums = lambda table: table.groupBy("l", "w").agg(F.sum("c").alias("c"))
    words = stage(sums(samples.mapInArrow(count, "l string, w string, c long")), "word-counts")
    grams = gathered(sums(words.mapInArrow(cut, "l string, w string, c long")), langs)
    out = gathered(words, langs), grams
    unstage(words)
    return out


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred and score (the winner's posterior, 0 to 1).

    lang_pred is `und` with score 0 where the text is null or has no letter, or where the model has no
    language at all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        row_of: dict[str, int] = {}
        table = np.zeros((1024, len(model.langs)), np.float32)

        def work(texts: list[str | None]) -> list:
            nonlocal table
            preds, scores = [], []
            for text in texts:
                found = _WORD.findall(text.lower()) if text and model.langs else []
                if found and not found[0].isalpha() and not any(map(str.isalpha, text)):
                    found = []
                if not found:
                    preds.append("und"), scores.append(0.0)
                    continue
                if len(row_of) > REMEMBERED:
                    row_of.clear()
                try:
                    rows = list(map(row_of.__getitem__, found))
                except KeyError:
                    for w in found:
                        if w not in row_of:
                            at = len(row_of)
                            if at == len(table):
                                table = np.concatenate([table, np.zeros_like(table)])
                            row_of[w] = at
                            table[at] = model.word_scores(w)
                    rows = list(map(row_of.__getitem__, found))
                total = table[rows].sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                preds.append(model.langs[best]), scores.append(float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum()))
            return [preds, scores]

        return work

    return annotate(docs, text, keep, [("lang_pred", pa.string()), ("score", pa.float64())], make)
