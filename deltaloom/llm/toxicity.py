"""Toxicity by a bag of subwords: word vectors are means of hashed word and character n-gram vectors,
a document is the mean of its words, and a linear softmax reads that mean. Vectors and softmax are
trained jointly in numpy, from a random start, on a bounded sample of labelled documents, so a
misspelling that was never seen still gets the vectors of its n-grams.

All averaging is linear, and the softmax has two classes, so a step needs only one number per bucket,
word and document: forwards the vectors' products with the difference of the two rows of the softmax,
backwards the sums of the documents' errors. Gradients are exact for any number of dimensions.

Only buckets that toxic and clean documents have unlike often are trained. How unlike, and when to stop, is
told by every fifth of the learning documents, which the vectors don't see; where the border lies, by all; labels outside of the sample are never looked at. After training the vectors'
products are the whole model: scoring needs that table (`buckets` floats, broadcast) and one number per
distinct word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from copy import copy
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.llm.common import annotate, crc_mod, shielded

#: Hashed vectors, their dimensions, sizes of n-grams, documents that a word needs, standard errors that a bucket needs to be trained (all are tried).
BUCKETS, DIM, GRAMS, MIN_DOCS, TELLING = 1 << 18, 16, (3, 4, 5), 3, (6, 4, 3)
#: One in so many learning documents tells when to stop.
CHECKED = 5
#: Distinct words that a task remembers the contribution of.
REMEMBERED = 300_000
_WORD = re.compile(r"[^\W_]+")


def features(word: str) -> list[int]:
    """Buckets of the word itself and of its character n-grams."""
    marked = f"<{word}>".encode()
    out = [crc32(marked) % BUCKETS]
    text = f"<{word}>"
    for n in GRAMS:
        out += [crc32(text[i : i + n].encode()) % BUCKETS for i in range(len(text) - n + 1)]
    return out


@dataclass
class ToxicModel:
    bias: float
    table: np.ndarray  # by bucket: its vector along the softmax's difference


def _border(logits: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """(F1, border): the middle of the gap between two log odds that tells toxic (y = 1) from clean documents best.

    Clean documents beyond the border count with two standard errors more than were seen, so where few
    tell, clean documents are left alone rather than toxic ones caught.
    """
    order = np.argsort(-logits, kind="stable")
    x, toxic, weight = logits[order], y[order], share[order]
    hit, false = np.cumsum(weight * toxic), np.cumsum(1 - toxic)
    each = np.cumsum(weight * (1 - toxic)) / np.maximum(1, false)
    each = np.where(false > 0, each, share[y < 1].mean() if (y < 1).any() else 0.0)
    f1 = 2 * hit / (hit + each * (false + 2 * np.sqrt(false + 1)) + (share * y).sum())
    last = np.append(x[1:] < x[:-1], True)  # a border lies between different log odds only
    k = int(np.flatnonzero(last)[f1[last].argmax()])
    return float(f1[k]), float((x[k] + x[k + 1]) / 2 if k + 1 < len(x) else x[k] - 1)


class _Bags:
    """Documents as bags of words, and words as bags of buckets, for sums in both directions."""

    def __init__(self, doc_of: np.ndarray, word_of: np.ndarray, weight: np.ndarray, parts: list[list[int]], docs: int):
        self.doc_of, self.word_of, self.weight, self.docs = doc_of, word_of, weight, docs
        self.used, flat = np.unique(np.fromiter((x for p in parts for x in p), np.int64), return_inverse=True)
        self.flat, self.lens = flat.astype(np.int32), np.array(list(map(len, parts)), np.float64)
        self.part_of = np.repeat(np.arange(len(parts), dtype=np.int32), self.lens.astype(np.int64))

    def down(self, per_bucket: np.ndarray) -> np.ndarray:
        """By document, the mean over its words of the means over their buckets."""
        words = np.bincount(self.part_of, per_bucket[self.flat], len(self.lens)) / self.lens
        return np.bincount(self.doc_of, words[self.word_of] * self.weight, self.docs)

    def up(self, per_doc: np.ndarray) -> np.ndarray:
        """By bucket, what a number for each document sums up to: the adjoint of `down`."""
        words = np.bincount(self.word_of, per_doc[self.doc_of] * self.weight, len(self.lens)) / self.lens
        return np.bincount(self.flat, words[self.part_of], len(self.used))

    def evidence(self, y: np.ndarray, learnt: np.ndarray) -> np.ndarray:
        """By bucket, how unlike often toxic and clean learning documents have it, in standard errors of the log odds."""
        seen = np.zeros((2, len(self.used)))
        bucket_at = np.concatenate([[0], np.cumsum(self.lens)]).astype(np.int64)
        word_at = np.searchsorted(self.doc_of, np.arange(self.docs + 1))
        for d in np.flatnonzero(learnt).tolist():
            words = self.word_of[word_at[d] : word_at[d + 1]]
            if len(words):
                seen[int(y[d] > 0)][np.concatenate([self.flat[bucket_at[w] : bucket_at[w + 1]] for w in words.tolist()])] += 1
        many = np.array([[(learnt & (y < 1)).sum()], [(learnt & (y > 0)).sum()]])
        odds = np.log((seen + 0.5) / (many - seen + 0.5))
        error = np.sqrt((1 / (seen + 0.5) + 1 / (many - seen + 0.5)).sum(axis=0))
        return np.abs(odds[1] - odds[0]) / error

    def only(self, trained: np.ndarray) -> _Bags:
        """The same bags with these buckets; the others still count in the means."""
        out = copy(self)
        at = trained[self.flat]
        number = np.cumsum(trained) - 1
        out.used, out.flat, out.part_of = self.used[trained], number[self.flat[at]].astype(np.int32), self.part_of[at]
        some = np.bincount(out.part_of, minlength=len(self.lens))[self.word_of] > 0
        out.doc_of, out.word_of, out.weight = self.doc_of[some], self.word_of[some], self.weight[some]
        return out


def fit(samples: Iterable[tuple[str, int]], prior: float | None = None, epochs: int = 200, rate: float = 0.2, seed: int = 1) -> ToxicModel:
    """Trains on (text, label) pairs, weighted so that the toxic class has the share `prior` (its share of the pairs if None).

    Texts are read one at a time and kept as arrays of word numbers. Words of fewer than MIN_DOCS
    documents only count in their documents' lengths: on their own they would be learnt by heart. The
    model of the step that did best on the documents left out is kept, with the border that tells all of
    them apart best. Labels that all agree give a model that says so of every document.
    """
    number: dict[str, int] = {}
    words_of, shares, y = [], [], []
    for text, label in samples:
        bag = Counter(_WORD.findall(text.lower()))
        if bag:
            words_of.append(np.array([number.setdefault(w, len(number)) for w in bag], np.int32))
            shares.append(np.array(list(bag.values()), np.float32) / bag.total())
            y.append(label)
    y = np.array(y, np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicModel(-4.0 if not len(y) or y.max() < 1 else 4.0, np.zeros(BUCKETS, np.float32))
    doc_of = np.repeat(np.arange(len(y), dtype=np.int32), [len(w) for w in words_of])
    doc_word, weight = np.concatenate(words_of), np.concatenate(shares)
    common = np.bincount(doc_word, minlength=len(number)) >= MIN_DOCS
    kept = common[doc_word]
    doc_of, weight, doc_word = doc_of[kept], weight[kept], (np.cumsum(common, dtype=np.int32) - 1)[doc_word[kept]]
    index = [w for w, c in zip(number, common.tolist(), strict=True) if c]
    del number, words_of, shares
    if not index:
        return ToxicModel(-4.0, np.zeros(BUCKETS, np.float32))
    bags = _Bags(doc_of, doc_word, weight, [features(w) for w in index], len(y))
    prior = float(y.mean()) if prior is None else prior
    share = np.where(y > 0, prior / (y > 0).sum(), (1 - prior) / (y < 1).sum())
    # Every CHECKED-th document of either label is left out, where that leaves some to learn from.
    nth = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y < 1))
    out = (nth % CHECKED == 0) if min((y > 0).sum(), (y < 1).sum()) >= CHECKED else np.zeros(len(y), bool)
    told = out if out.any() else ~out
    learnt = share * ~out / (share * ~out).sum()

    evidence = bags.evidence(y, ~out)
    best = (-1.0, bags, np.zeros(0), 0.0)
    for errors in TELLING:
        own = bags.only(evidence > errors)
        for step, along, offset, logits in _steps(own, y, learnt, prior, epochs, rate, seed):
            if step % 4 == 0:
                f1, _ = _border(logits[told], y[told], share[told])
                if f1 > best[0]:
                    best = (f1, own, along.copy(), offset - _border(logits, y, share)[1])
    _, own, along, bias = best
    table = np.zeros(BUCKETS, np.float32)
    table[own.used] = along
    return ToxicModel(bias, table)


def _steps(bags: _Bags, y: np.ndarray, learnt: np.ndarray, prior: float, epochs: int, rate: float, seed: int) -> Iterator[tuple[int, np.ndarray, float, np.ndarray]]:
    """Steps of Adam from a random start: the number, the buckets' products, the bias and all documents' log odds."""
    random = np.random.default_rng(seed)
    vectors, softmax, bias = random.normal(0, 1 / DIM, (len(bags.used), DIM)), random.normal(0, 1, (2, DIM)), np.array([0.0, np.log(prior / (1 - prior))])
    params = [vectors, softmax, bias]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, epochs + 1):
        difference = softmax[1] - softmax[0]
        along = vectors @ difference
        logits = bags.down(along) + bias[1] - bias[0]
        yield step, along, float(bias[1] - bias[0]), logits
        error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y) * learnt
        by_bucket = bags.up(error)
        toward = by_bucket @ vectors
        for p, g, (m, v) in zip(params, (np.outer(by_bucket, difference), np.stack([-toward, toward]), np.array([-error.sum(), error.sum()])), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.05 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-12)


def sample_labelled(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int, held_out_mod: int | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[Iterator[tuple[str, int]], float | None]:
    """(pairs, share): labelled texts, at most most_toxic and most_clean of either label, chosen by a hash of
    the label's row, and the share of toxic ones among all labels that may be learnt from (None: there are none).

    labels has doc_id and toxic; a document with both labels counts as toxic, nulls are left out. Of several
    texts with one id the one of least hash is taken, so the bound holds whatever repeats. With held_out_mod,
    ids whose crc32 is divisible by it are never taken.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_y"))
    if held_out_mod:
        known = known.filter(crc_mod(F.col("_id"), held_out_mod) != 0)
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect() if r["_y"] in (0, 1)}
    share = sizes.get(1, 0) / sum(sizes.values()) if sizes else None
    unit = F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) / 1_000_003
    chosen, most = F.lit(False), F.lit(0)
    for label, n in sizes.items():
        own = most_toxic if label else most_clean
        chosen = chosen | ((F.col("_y") == label) & (unit < min(1.0, 1.2 * own / n)))
        most = F.when(F.col("_y") == label, own).otherwise(most)
    # A few more than the bound pass the hash; the rank among them makes it exact.
    rank = F.row_number().over(W.partitionBy("_y").orderBy(unit, "_id"))
    picked = known.filter(chosen).withColumn("_rank", rank).filter(F.col("_rank") <= most).select("_id", "_y")
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull()).join(F.broadcast(picked), "_id")
    rows = texts.groupBy("_id", "_y").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), F.col("_text"))).alias("_text"))
    return ((r["_text"], int(r["_y"])) for r in rows.select("_text", "_y").toLocalIterator()), share


def score(docs: DataFrame, model: ToxicModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    A null text, or one without words, gets the score of the bias alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.table))

    def make():
        bias, table = shared.value
        known: dict[str, float] = {}

        def work(texts: list[str | None]) -> list:
            found = [_WORD.findall(t.lower()) if t else [] for t in texts]
            new = [w for w in set().union(*found) if w not in known]
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set().union(*found))
            if new:
                parts = [features(w) for w in new]
                ends = np.cumsum([0, *map(len, parts)])
                sums = np.add.reduceat(table[np.fromiter((x for p in parts for x in p), np.int64, ends[-1])], ends[:-1])
                known.update(zip(new, (sums / np.diff(ends)).tolist(), strict=True))
            logits = np.array([bias + (sum(map(known.__getitem__, w)) / len(w) if w else 0.0) for w in found])
            scores = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
            return [scores, (scores >= 0.5).astype(np.int32)]

        return work

    return annotate(docs, text, keep, [("score", pa.float64()), ("predicted", pa.int32())], make)


def without_toxic(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, with all their columns."""
    plain, name, back = shielded(docs)
    return back(score(plain, model, plain.columns, name(text)).filter("predicted = 0"))
