"""Substring dedup: words covered by a window that also starts in a document with a smaller id go.

Suffixes are partitioned by prefixes, and each group gets a suffix tree of its own. A suffix matters by
its first `window` words. Sampled suffixes name the groups: those that begin with the least 16-word gram
of some window, and that gram is their prefix. Equal windows hold the same sampled suffix at the same
place, and neighbouring windows share one, so a run of suffixes goes to its group with its words stated
once. A prefix that only one document has can't hold a repeat and is dropped before any text moves. Equal
runs then become one, by an aggregate that is combined before the shuffle: the least id of their
documents goes into the trees, and the others are covered whole.

A prefix with more than `heavy` different runs is too large for a group. Its suffixes are then dealt by
prefixes of their own, which are lengthened along LADDER until a group fits, up to all `window` words:
suffixes that agree in all of them are one node, and are aggregated.

A group's tree (SuffixTree) has the suffixes in order as leaves, and an internal node wherever neighbours
agree in more words than those around them. The uppermost internal nodes of at least `window` words are
the repeats: the leaves of one in documents beyond its smallest id are covered, each as far as the node
is deep. Overlapping spans of a document are joined.

Documents of equal words are one class: only the first is searched, the others are covered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import listed, one_core, sha256_hex, shielded, slices, stage, text_key, texts_of, unstage

#: Words of a prefix, different runs (or suffixes) beyond which it is lengthened, and words of the groups that a task has at a time.
GRAM, HEAVY, GROUP_WORDS = 16, 4096, 1 << 19
#: Words of lengthened prefixes, as shares of the window in fiftieths.
LADDER = (4, 12, 20, 32, 50)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8."""
    return text.encode().split() if text else []


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _MULT + (b ^ (b >> np.uint64(32)))
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def runs_of(words: list[list[bytes]], window: int) -> list[list[tuple[int, int, int]]]:
    """For each document its runs of suffixes that share a prefix: (prefix hash, first suffix, number)."""
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if total < window:
        return out
    gram = min(GRAM, window)
    flat = np.fromiter((xxhash.xxh3_64_intdigest(x) for w in words for x in w), np.uint64, total)
    ends = np.cumsum(sizes)
    # Grams by doubling; those that cross documents are never looked at.
    h, size = flat, 1
    while size < gram:
        step = min(size, gram - size)
        h = _mixed(h[: len(h) - step], h[step:])
        size += step
    # The rightmost least gram among the grams of a window, by doubling.
    span = window - gram + 1
    best, at, size = h, np.arange(len(h)), 1
    while size < span:
        step = min(size, span - size)
        left, right = best[: len(best) - step], best[step:]
        at = np.where(right <= left, at[step:], at[: len(at) - step])
        best = np.minimum(left, right)
        size += step
    begins = ends - sizes
    valid = np.zeros(len(at) + 1, np.int64)
    some = sizes >= window
    np.add.at(valid, begins[some], 1)
    np.add.at(valid, ends[some] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    doc = np.searchsorted(ends, starts, "right")
    anchor = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    for d, p, s, n in zip(doc[first].tolist(), h[anchor[first]].view(np.int64).tolist(), (starts[first] - begins[doc[first]]).tolist(), count.tolist(), strict=True):
        out[d].append((p, s, n))
    return out


class SuffixTree:
    """The suffix tree of some suffixes of texts: leaves in order, and how many words neighbours agree in.

    words: numbers of words, texts one after another, each ended by a number of its own. leaves: where
    suffixes start. Ranks of 1, 2, 4 ... words order the suffixes by doubling; the same ranks tell how
    far two of them agree.
    """

    def __init__(self, words: np.ndarray, leaves: np.ndarray, longest: int):
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
        ranks, size = [rank], 1
        while size < longest:
            # Beyond the end nothing matters: a text's end is unlike any other word.
            far = np.append(rank[size:], np.zeros(min(size, len(rank)), np.int64))
            rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + far, return_inverse=True)[1].astype(np.int64)
            ranks.append(rank)
            size *= 2
        self.order = np.argsort(rank[leaves], kind="stable")
        at = leaves[self.order]
        agreed = np.zeros(max(0, len(at) - 1), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            x, y = np.minimum(at[:-1] + agreed, len(words) - 1), np.minimum(at[1:] + agreed, len(words) - 1)
            agreed += (ranks[k][x] == ranks[k][y]).astype(np.int64) << k
        #: Words that leaf i (in order) and the one before agree in; the first one has none before.
        self.agreed = np.concatenate([[0], agreed]) if len(at) else np.zeros(0, np.int64)

    def nodes(self, least: int) -> list[tuple[int, int, int, int]]:
        """Internal nodes of at least so many words as (depth, first leaf, last leaf, parent), parents by their place
        in the list (-1: the parent has fewer words, or is the root); leaves by their place in `order`."""
        deep = np.flatnonzero(self.agreed >= least)
        if not len(deep):
            return []
        done: list[list[int]] = []
        open_: list[list[int]] = []  # [depth, first leaf, children's places]
        ends = np.append(np.flatnonzero(np.diff(deep) > 1), len(deep) - 1)
        start = 0
        for end in ends.tolist():
            block = deep[start : end + 1]
            start = end + 1
            for i, h in [*zip(block.tolist(), self.agreed[block].tolist(), strict=True), (int(block[-1]) + 1, 0)]:
                first, child = i - 1, None
                while open_ and open_[-1][0] > h:
                    depth, first, children = open_.pop()
                    if child is not None:
                        children.append(child)
                    child = len(done)
                    done.append([depth, first, i - 1, -1])
                    for c in children:
                        done[c][3] = child
                if h and (not open_ or open_[-1][0] < h):
                    open_.append([h, first, []])
                if child is not None and open_:
                    open_[-1][2].append(child)
        return [tuple(x) for x in done]


def _spans(first: int, begin: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Word spans of some suffixes of a run, in order, joined where they touch."""
    if not len(begin):
        return []
    reach = np.maximum.accumulate(begin + size)
    cut = np.flatnonzero(begin[1:] > reach[:-1])
    return [(first + int(a), first + int(b)) for a, b in zip(begin[np.append(0, cut + 1)], reach[np.append(cut, len(begin) - 1)], strict=True)]


_SPAN = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _trees(window: int):
    """Sorted runs (prefix, doc_id, key, first, number, words as text) into spans."""

    def solve(held: list) -> pa.RecordBatch | None:
        number: dict[bytes, int] = {}
        texts = [[number.setdefault(x, len(number)) for x in text.split()] for *_, text in held]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        words = np.fromiter((x for i, t in enumerate(texts) for x in (*t, len(number) + i)), np.int64, int(sizes.sum()))
        n = np.array([h[3] for h in held], np.int64)
        owner = np.repeat(np.arange(len(held)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        tree = SuffixTree(words, begins[owner] + place, int(sizes.max()))
        doc = np.array([h[0] for h in held], np.int64)[owner][tree.order]
        covered = np.zeros(len(owner), np.int64)  # words, by leaf in order
        for depth, first, last, parent in tree.nodes(window):
            if parent < 0:
                own = doc[first : last + 1]
                covered[first : last + 1] = np.where(own > own.min(), depth, 0)
        some = np.flatnonzero(covered)
        leaf = tree.order[some]
        by_place = np.argsort(leaf)
        leaf, size = leaf[by_place], covered[some][by_place]
        rows, edge = [], np.searchsorted(owner[leaf], np.arange(len(held) + 1))
        for i in np.unique(owner[leaf]).tolist():
            d, key, first, _, _ = held[i]
            own = slice(edge[i], edge[i + 1])
            rows += [(d, key, a, b) for a, b in _spans(first, place[leaf[own]], size[own])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SPAN.types, strict=True)], schema=_SPAN) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        held, size, now = [], 0, None
        for part in slices(batches, 2048):
            for prefix, d, key, first, n, text in zip(*map(listed, part.columns), strict=True):
                if prefix != now and size > GROUP_WORDS:
                    if (out := solve(held)) is not None:
                        yield out
                    held, size = [], 0
                now = prefix
                held.append((d, key, first, n, text))
                size += n + window
        if held and (out := solve(held)) is not None:
            yield out

    return run


def _measured(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, key, sha (of the words), n_words, prefixes (of the runs, in order)."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("sha", pa.binary()), ("n_words", pa.int64()), ("prefixes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        for part in slices(batches):
            words = [split_words(t) for t in part.column(1).to_pylist()]
            prefixes = [[p for p, _, _ in runs] for runs in runs_of(words, window)]
            shas = [bytes.fromhex(sha256_hex(b" ".join(w))) for w in words]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(shas, pa.binary()), pa.array(map(len, words), pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], schema=schema)

    return texts.mapInArrow(run, "doc_id long, key long, sha binary, n_words long, prefixes array<long>")


def _runs(found: DataFrame, window: int) -> DataFrame:
    """Runs of the documents of `found` (doc_id, key, text, places of runs): prefix, doc_id, key, first, n, words."""
    schema = pa.schema([("prefix", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        for part in slices(batches, 64):
            docs, keys, texts, places = (c.to_pylist() for c in part.columns)
            words = [split_words(t) for t in texts]
            rows = []
            for d, key, w, runs, at in zip(docs, keys, words, runs_of(words, window), places, strict=True):
                for prefix, first, n in (runs[i] for i in set(at)):
                    rows.append((prefix, d, key, first, n, b" ".join(w[first : first + n + window - 1])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema.types, strict=True)], schema=schema)

    return found.select("doc_id", "key", "text", "places").mapInArrow(run, "prefix long, doc_id long, key long, first long, n int, words binary")


def _lengthened(runs: DataFrame, window: int, heavy: int) -> DataFrame:
    """Covered spans of the runs of heavy prefixes: every suffix goes to a group by a prefix of its own, the shortest
    of LADDER that at most `heavy` suffixes share. A prefix of all `window` words is one node, whatever its leaves."""
    steps = sorted({max(1, window * x // 50) for x in LADDER[:-1]} | {window})
    schema = pa.schema([("names", pa.list_(pa.int64())), ("whole", pa.binary()), ("doc_id", pa.int64()), ("key", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            rows = []
            for d, key, first, n, text in zip(*map(listed, part.columns), strict=True):
                w = text.split()
                for i in range(n):
                    names = [xxhash.xxh3_64_intdigest(b" ".join(w[i : i + k])) - (1 << 63) for k in steps[:-1]]
                    own = b" ".join(w[i : i + window])
                    rows.append((names, xxhash.xxh3_128_digest(own), d, key, first + i, 1, own))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema.types, strict=True)], schema=schema)

    made = runs.select("doc_id", "key", "first", "n", "words").mapInArrow(explode, "names array<long>, whole binary, doc_id long, key long, first long, n int, words binary")
    rest, out = stage(made, "suffixes"), []
    for k in range(len(steps) - 1):
        here = rest.withColumn("prefix", F.col("names")[k])
        large = stage(here.groupBy("prefix").count().filter(F.col("count") > heavy).select("prefix"), "large")
        fits = here.join(large, "prefix", "left_anti").select("prefix", "doc_id", "key", "first", "n", "words")
        out.append(fits.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_trees(window), "doc_id long, key long, begin long, end long"))
        rest = stage(here.join(large, "prefix", "left_semi").drop("prefix"), "suffixes")
        if rest.isEmpty():
            break
    node = rest.groupBy("whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("whole", "least")
    out.append(rest.select("whole", "doc_id", "key", "first").join(node, "whole").filter("doc_id > least").select("doc_id", "key", F.col("first").alias("begin"), (F.col("first") + window).alias("end")))
    spans = out[0]
    for more in out[1:]:
        spans = spans.unionAll(more)
    return spans


def _covered(runs: DataFrame, window: int, heavy: int) -> DataFrame:
    """doc_id, key, begin, end: covered spans of runs (prefix, doc_id, key, first, n, words).

    Equal runs are collapsed before the trees: only the document with the least id of a kind is in them,
    and runs of the others are covered whole.
    """
    runs = stage(runs.withColumn("name", F.xxhash64("prefix", F.md5("words"))), "runs")
    kinds = stage(runs.groupBy("prefix", "name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("n").alias("n"), F.first("words").alias("words")), "kinds")
    many = stage(kinds.groupBy("prefix").count().filter(F.col("count") > heavy).select("prefix"), "many")
    few = kinds.join(many, "prefix", "left_anti")
    # The trees see one run of a kind, at place 0 of the document with the least id; its kind comes back as the key.
    seen = few.select("prefix", F.col("least").alias("doc_id"), F.col("name").alias("key"), F.lit(0).cast("long").alias("first"), "n", "words")
    found = seen.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_trees(window), "doc_id long, key long, begin long, end long")
    found = found.select("doc_id", F.col("key").alias("name"), F.col("begin").alias("b"), F.col("end").alias("e"))
    own = runs.select("doc_id", "name", "key", "first").join(found, ["doc_id", "name"]).select("doc_id", "key", (F.col("first") + F.col("b")).alias("begin"), (F.col("first") + F.col("e")).alias("end"))
    shared = few.filter("least < most").select("prefix", "name", "least")
    whole = runs.select("prefix", "name", "doc_id", "key", "first", "n").join(shared, ["prefix", "name"]).filter("doc_id > least")
    out = own.unionAll(whole.select("doc_id", "key", F.col("first").alias("begin"), (F.col("first") + F.col("n") + window - 1).alias("end")))
    if many.limit(1).count():
        out = out.unionAll(_lengthened(runs.join(many, "prefix", "left_semi"), window, heavy))
    return out


def _cleaned(window: int):
    """Spans of a document before its text, into what is kept of it."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        now, spans, done = None, [], False
        for part in slices(batches, 1024):
            rows = []
            for d, key, begin, end, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (d, key) != now:
                    now, spans, done = (d, key), [], False
                if text is None:
                    spans.append((begin, end))
                elif not done:
                    done = True  # repeated rows have one result, which joins to each of them
                    words = split_words(text)
                    keep = np.ones(len(words), bool)
                    for a, b in spans:
                        keep[a:b] = False
                    if spans:
                        rows.append((d, key, int((~keep).sum()), b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema.types, strict=True)], schema=schema)

    return run


def find_repeats(docs: DataFrame, window: int = 50, heavy: int = HEAVY, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(measured, changed) of the rows of docs.

    measured: doc_id, key (of the text), sha (of its words joined by spaces), n_words, whole (all words
    are covered by an earlier document of the same words). changed: doc_id, key, removed, kept (words
    joined by a space) of the documents of which some words are covered otherwise.

    A null text has no words. A null doc_id is neither smaller nor larger than any other: such rows
    never change. Rows of one doc_id don't cover one another; repeated rows have equal results.
    """
    texts = texts_of(docs, doc_id, text).withColumn("key", text_key(F.col("text")))
    measured = stage(_measured(texts, window), "measured")
    known = measured.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    classes = stage(known.groupBy("sha").agg(F.min("doc_id").alias("first_id")), "classes")
    # One document of a class: joined by both columns, so a large class is spread.
    firsts = known.join(classes.withColumnRenamed("first_id", "doc_id"), ["sha", "doc_id"], "left_semi")
    runs = stage(firsts.select("doc_id", "key", F.posexplode("prefixes").alias("place", "prefix")), "prefixes")
    repeated = runs.groupBy("prefix").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    repeated = stage(repeated.select("prefix"), "repeated")
    hits = runs.join(repeated, "prefix").groupBy("doc_id", "key").agg(F.collect_list("place").alias("places"))
    hits = stage(hits, "hits")
    unstage(runs)
    found = stage(texts.join(hits, ["doc_id", "key"]).select("doc_id", "key", "text", "places"), "found")
    spans = _covered(_runs(found, window), window, heavy)
    spans = stage(spans, "spans")
    both = spans.withColumn("text", F.lit(None).cast("string")).unionAll(found.select("doc_id", "key", F.lit(None).cast("long").alias("begin"), F.lit(None).cast("long").alias("end"), "text"))
    both = both.repartition("doc_id", "key").sortWithinPartitions("doc_id", "key", F.col("text").isNotNull())
    changed = stage(both.mapInArrow(_cleaned(window), "doc_id long, key long, removed long, kept string"), "changed")
    unstage(found, spans, hits, repeated)
    whole = F.col("first_id").isNotNull() & (F.col("doc_id") > F.col("first_id"))
    return measured.join(classes, "sha", "left").select("doc_id", "key", "sha", "n_words", F.coalesce(whole, F.lit(False)).alias("whole")), changed


def repeat_report(docs: DataFrame, window: int = 50, heavy: int = HEAVY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    measured, changed = find_repeats(docs, window, heavy, doc_id, text)
    parts = changed.select("doc_id", "key", "removed", F.sha2(F.col("kept"), 256).alias("kept_sha"))
    whole, n = F.col("whole"), F.col("n_words")
    return measured.join(parts, ["doc_id", "key"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, n).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = 50, heavy: int = HEAVY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with covered words taken out of the text; texts without any stay as they are.

    All rows and columns stay; a text of which nothing is left is empty.
    """
    measured, changed = find_repeats(docs, window, heavy, doc_id, text)
    whole = measured.filter("whole").select("doc_id", "key", F.lit("").alias("_kept")).distinct()
    new = changed.select("doc_id", "key", F.col("kept").alias("_kept")).unionAll(whole)
    new = new.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    plain, name, back = shielded(docs)
    own = F.col(name(text))
    joined = plain.join(new.hint("merge"), (F.col(name(doc_id)).cast("long") == F.col("_id")) & (text_key(own) == F.col("_key")), "left")
    return back(joined.withColumn(name(text), F.coalesce(F.col("_kept"), own)))
