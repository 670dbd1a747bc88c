"""Packing documents into as few sequences as possible by bin completion, a branch-and-bound search.

Only the lengths of pieces matter, and there are at most `capacity` different ones, so the search runs
over a histogram of fixed size, whatever the number of documents. A step takes the longest piece left,
enumerates fillings for the rest of its sequence that no other filling dominates, tries the one with
the least waste first, and applies it as often as the counts allow, then once, so that any number of times
is tried. The best-fit solution by decreasing length is the first incumbent; a branch whose waste can't lead to fewer sequences is cut, and the search ends when the
incumbent meets the lower bound (or after `effort` steps, with the incumbent). Half of the effort goes to
the likely fillings of each step, which make a good incumbent; the rest to all undominated ones, lazily.

The solution is a list of slots: of the pieces of one length, those with ranks from .. to go to these
sequences at this place. Ranks come from counts by (length, bucket) and a rank within the bucket, so a
length that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.llm.bpe import encoder
from deltaloom.llm.common import one_core, slices, stage, text_key, texts_of

#: Pieces that one task ranks; fillings that a further one is compared with.
BUCKET_ROWS, COPIES, DOMINATORS = 100_000, 4096, 32


@dataclass(frozen=True)
class Pattern:
    """`times` sequences, each with these (length, copies), longest first."""

    items: tuple[tuple[int, int], ...]
    times: int


def fillings(counts: dict[int, int], lengths: list[int], room: int, width: int = 6, most: int = 12) -> list[tuple[tuple[int, int], ...]]:
    """Fillings of `room` by pieces that are left, least waste first; lengths: those with a count, ascending.

    A filling that leaves room for another piece, or that another one dominates (the other has one
    piece where this has several that it could hold), isn't listed. A filling by one piece that fits
    exactly dominates all.
    """
    if counts.get(room):
        return [((room, 1),)]
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []

    def search(left: int, below: int, items: tuple[tuple[int, int], ...], wide: int) -> bool:
        k = bisect_right(lengths, min(left, below)) - 1
        if k < 0:
            found.append((left, items))
            return left == 0
        if items and counts.get(left) and left < below:
            found.append((0, (*items, (left, 1))))
            return True
        for j in range(k, max(-1, k - wide), -1):
            x = lengths[j]
            if search(left - x * (c := min(counts[x], left // x)), x - 1, (*items, (x, c)), max(1, wide // 2)):
                return True
            if len(found) >= most:
                return False
        return False

    search(room, room, (), width)
    if not found:
        return [()]
    # Exact pairs: the longest first piece that has its complement.
    if min(found)[0]:
        for j in range(bisect_right(lengths, room) - 1, -1, -1):
            x = lengths[j]
            if 2 * x < room:
                break
            if counts.get(room - x) and (room - x != x or counts[x] > 1):
                found.append((0, ((x, 1), (room - x, 1)) if room - x != x else ((x, 2),)))
                break
    found.sort(key=lambda f: (f[0], sum(c for _, c in f[1])))
    kept: list[tuple[tuple[int, int], ...]] = []
    for _, items in found:
        if items not in kept and not any(_dominates(k, items) for k in kept):
            kept.append(items)
    return kept


def every_filling(counts: dict[int, int], lengths: list[int], room: int, spare: Callable[[], int]) -> Iterator[tuple[tuple[int, int], ...] | None]:
    """All fillings of `room` that no other one dominates: those of `fillings` first, then the rest one by one.

    Fillings that waste more than spare() are left out. None stands for a step of the search that found
    nothing new, so that the caller can count its effort. counts and lengths must not change meanwhile.
    """
    kept = fillings(counts, lengths, room)
    yield from list(kept)
    if kept == [()] or kept[0] == ((room, 1),):
        return
    reach = [0, *accumulate(x * counts[x] for x in lengths)]

    def search(left: int, below: int, items: tuple[tuple[int, int], ...], need: int) -> Iterator[tuple[tuple[int, int], ...] | None]:
        """need: the shortest piece that was passed over; a filling that leaves room for it isn't maximal."""
        k = bisect_right(lengths, min(left, below)) - 1
        if k < 0:
            # Tried against the first ones only: a dominated filling costs a step, and nothing is lost by it.
            if left < need and left <= spare() and not any(_dominates(f, items) for f in kept[:DOMINATORS]):
                kept.append(items)
                yield items
            else:
                yield None
            return
        for j in range(k, -1, -1):
            x = lengths[j]
            if j < k:
                need = min(need, lengths[j + 1])
            if left - reach[j + 1] >= need or left - reach[j + 1] > spare():  # what is left is too little
                yield None
                return
            most = min(counts[x], left // x)
            for c in range(most, 0, -1):
                yield from search(left - x * c, x - 1, (*items, (x, c)), need if c == most else min(need, x))

    yield from search(room, room, (), room + 1)


def _dominates(a: tuple, b: tuple) -> bool:
    """Whether b's pieces can be put into a's, one largest piece of a for all of b's that differ."""
    if not a or not b:
        return not b and bool(a)
    rest_a, rest_b = dict(a), dict(b)
    for x in set(rest_a) & set(rest_b):
        c = min(rest_a[x], rest_b[x])
        rest_a[x] -= c
        rest_b[x] -= c
    only_b = sum(x * c for x, c in rest_b.items())
    return only_b <= max((x for x, c in rest_a.items() if c), default=0)


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit by decreasing length: each piece goes where the least room is left; equal sequences are one group."""
    rooms: list[int] = []
    groups: dict[int, list[Pattern]] = {}

    def add(room: int, pattern: Pattern) -> None:
        if room not in groups:
            groups[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        groups[room].append(pattern)

    for x, n in sorted(histogram.items(), reverse=True):
        while n > 0:
            k = bisect_right(rooms, x - 1)
            room = rooms[k] if k < len(rooms) else capacity
            old = groups[room].pop() if k < len(rooms) else Pattern((), n)
            copies = min(n, room // x)
            times = min(old.times, n // copies)
            if k < len(rooms) and times < old.times:
                groups[room].append(Pattern(old.items, old.times - times))
            elif k < len(rooms) and not groups[room]:
                del groups[room], rooms[k]
            add(room - copies * x, Pattern((*old.items, (x, copies)), times))
            n -= copies * times
    return [p for group in groups.values() for p in group]


def complete_bins(histogram: dict[int, int], capacity: int, effort: int = 20_000) -> list[Pattern]:
    """Patterns that use every piece of the histogram (length -> pieces) exactly once."""
    counts = {x: c for x, c in histogram.items() if c > 0}
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("a piece doesn't fit a sequence")
    total = sum(x * c for x, c in counts.items())
    bound = max(-(-total // capacity), sum(c for x, c in counts.items() if 2 * x > capacity))
    best = best_fit(counts, capacity)
    best_bins = sum(p.times for p in best)
    lengths = sorted(counts)
    bins = waste = steps = 0

    def take(items: tuple[tuple[int, int], ...], times: int) -> None:
        for x, c in items:
            counts[x] -= c * times
            if not counts[x]:
                del counts[x]
                lengths.pop(bisect_right(lengths, x) - 1)

    def give(items: tuple[tuple[int, int], ...], times: int) -> None:
        for x, c in items:
            if x not in counts:
                lengths.insert(bisect_right(lengths, x), x)
            counts[x] = counts.get(x, 0) + c * times

    def spare() -> int:
        """Fewer sequences than the incumbent's leave this much waste from here on."""
        return (best_bins - 1) * capacity - total - waste

    def options(whole: bool) -> Iterator[tuple[tuple[int, int], ...] | None]:
        """Fillings around the longest piece; the rest of them is begun only when the search is back here."""
        top = lengths[-1]
        take(((top, 1),), 1)
        likely = fillings(counts, lengths, capacity - top)
        give(((top, 1),), 1)
        yield from (_joined(top, f) for f in likely)
        if whole:
            own = dict(counts)
            own[top] -= 1
            own = {x: c for x, c in own.items() if c}
            for i, f in enumerate(every_filling(own, sorted(own), capacity - top, spare)):
                if i >= len(likely):
                    yield f if f is None else _joined(top, f)

    # First over likely fillings for half of the effort, then over all of them for what is left.
    for whole, until in ((False, effort // 2), (True, effort)):
        # Depth-first: each level holds the fillings that are still to try and what it has taken.
        path: list[tuple[Pattern, Iterator, int, bool, tuple | None]] = []
        level = options(whole)
        again: tuple | None = None  # a filling to be taken once more, singly: then its next repetitions may differ
        diving = True  # the first descent ends, whatever the effort
        while best_bins > bound:
            steps += 1
            if steps > until and not diving:
                break
            single = again is not None
            items, again = again or next(level, ()), None
            if items:
                most = min(counts[x] // c for x, c in items)
                times = 1 if single else most
                if whole and not single and most > 1:
                    again = items
                # Taken singly before, all that are left would be what was tried first.
                repeated = whole and not single and path and path[-1][3] and path[-1][0].items == items
                lost = (capacity - sum(x * c for x, c in items)) * times
                if lost > spare() or repeated:
                    diving = False
                    continue
                take(items, times)
                bins, waste = bins + times, waste + lost
                path.append((Pattern(items, times), level, lost, single, again))
                again = None
                if not lengths and bins < best_bins:
                    best, best_bins = [p for p, *_ in path], bins
                level = options(whole) if lengths else iter(())
            elif items is not None:
                diving = False
                if not path:
                    break
                pattern, level, lost, _, again = path.pop()
                give(pattern.items, pattern.times)
                bins, waste = bins - pattern.times, waste - lost
        for pattern, _, lost, *_ in reversed(path):
            give(pattern.items, pattern.times)
            bins, waste = bins - pattern.times, waste - lost
    return best


def _joined(top: int, filling: tuple[tuple[int, int], ...]) -> tuple[tuple[int, int], ...]:
    """The filling with the piece that it is around."""
    if filling and filling[0][0] == top:
        return ((top, filling[0][1] + 1), *filling[1:])
    return ((top, 1), *filling)


@dataclass(frozen=True)
class Slots:
    """By length: ascending first ranks, and for each the copies a sequence, first sequence and offset."""

    first: dict[int, np.ndarray]
    rest: dict[int, np.ndarray]  # rows of (copies, sequence, offset)
    sequences: int

    @staticmethod
    def of(patterns: list[Pattern]) -> Slots:
        rank: dict[int, int] = {}
        first: dict[int, list] = {}
        rest: dict[int, list] = {}
        sequence = 0
        for p in patterns:
            offset = 0
            for x, c in p.items:
                first.setdefault(x, []).append(rank.get(x, 0))
                rest.setdefault(x, []).append((c, sequence, offset))
                rank[x] = rank.get(x, 0) + c * p.times
                offset += x * c
            sequence += p.times
        return Slots({x: np.array(v, np.int64) for x, v in first.items()}, {x: np.array(v, np.int64) for x, v in rest.items()}, sequence)

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of the pieces of one length with these ranks."""
        k = np.searchsorted(self.first[length], ranks, "right") - 1
        copies, sequence, offset = self.rest[length][k].T
        nth = ranks - self.first[length][k]
        return sequence + nth // copies, offset + nth % copies * length


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, piece, start, length, ids_crc32: documents' ids with end_id, cut where they are longer than capacity."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        bpe = encoder(tokenizer)
        for part in slices(batches, 1024):
            rows = []
            docs, texts, keys = (c.to_pylist() for c in part.columns)
            for d, k, ids in zip(docs, keys, bpe.encode(texts), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for i, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    rows.append((d, k, i, at, len(own), zlib.crc32(own.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    texts = texts_of(docs, doc_id, text).withColumn("key", text_key(F.col("text")))
    return texts.mapInArrow(run, "doc_id long, key long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, effort: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    A null or empty text is one piece of the end id. Repeated rows are packed as often as they come;
    other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = stage(cut_pieces(docs, tokenizer, end_id, capacity, doc_id, text), "pieces")
    # Rows that repeat are one row with a count, so no bucket grows with copies.
    each = stage(pieces.groupBy("doc_id", "key", "piece", "start", "length", "ids_crc32").agg(F.count(F.lit(1)).alias("copies")), "distinct-pieces")
    histogram, rows = {}, 0
    for r in each.groupBy("length").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows")).collect():  # at most `capacity` rows
        histogram[r["length"]], rows = r["n"], rows + r["rows"]
    slots = spark.sparkContext.broadcast(Slots.of(complete_bins(histogram, capacity, effort)))
    buckets = max(1, -(-rows // BUCKET_ROWS))
    spread = each.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key", "piece"), F.lit(buckets)))
    counted = spread.groupBy("length", "bucket").agg(F.sum("copies").alias("count"))
    before = F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("length", "bucket", before.alias("before"))
    within = F.coalesce(F.sum("copies").over(W.partitionBy("length", "bucket").orderBy("doc_id", "key", "piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = spread.withColumn("within", within).join(offsets, ["length", "bucket"]).withColumn("first", F.col("before") + F.col("within"))
    # Copies come back in runs of COPIES at most, so no array grows with them.
    run = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    nth = F.explode(F.sequence("run", F.least(F.col("run") + COPIES, F.col("copies")) - 1))
    ranked = run.withColumn("nth", nth).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = slots.value
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                sequence[at], offset[at] = own.place(int(x), rank[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
