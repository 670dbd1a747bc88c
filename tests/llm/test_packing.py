import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from deltaloom.llm.bpe import splitter
from deltaloom.llm import packing
from deltaloom.llm.packing import Slots, _dominates, best_fit, complete_bins, every_filling, fillings, pack

WORD = "word_bpe_49k.json"


def fewest(lengths, capacity):
    best = [len(lengths)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                put(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best[0]


def test_as_few_bins_as_brute_force():
    random.seed(5)
    for _ in range(150):
        capacity = random.choice([20, 50, 100])
        lengths = sorted((random.randint(1, capacity) for _ in range(random.randint(1, 11))), reverse=True)
        patterns = complete_bins(Counter(lengths), capacity)
        used = Counter()
        for p in patterns:
            assert sum(x * c for x, c in p.items) <= capacity
            for x, c in p.items:
                used[x] += c * p.times
        assert used == Counter(lengths)
        assert sum(p.times for p in patterns) == fewest(lengths, capacity)


def test_every_undominated_filling_is_tried():
    # Around 1248 only {400, 400} leads to three sequences; {500, 300} and {600} are exact too.
    lengths = [1248, 1148, 1068, 600, 500, 480, 400, 400, 300]
    assert fewest(lengths, 2048) == 3
    assert sum(p.times for p in complete_bins(Counter(lengths), 2048)) == 3
    # Against all subsets: each that is maximal is listed or dominated by one that is listed.
    random.seed(11)
    for _ in range(40):
        counts = Counter(random.randint(2, 30) for _ in range(random.randint(1, 9)))
        room = random.randint(10, 60)
        listed = [f for f in every_filling(counts, sorted(counts), room, lambda: room) if f is not None]
        assert len(set(listed)) == len(listed)
        for picked in itertools.product(*(range(counts[x] + 1) for x in sorted(counts, reverse=True))):
            f = tuple((x, c) for x, c in zip(sorted(counts, reverse=True), picked, strict=True) if c)
            left = room - sum(x * c for x, c in f)
            if left >= 0 and not any(counts[x] > dict(f).get(x, 0) and x <= left for x in counts):
                assert f in listed or any(_dominates(k, f) for k in listed)


def test_a_filling_may_be_used_fewer_times_than_counts_allow():
    cases = [(20, [12, 12, 12, 11, 11, 5, 5, 5, 5, 4, 4, 4, 4], 5), (20, [12, 12, 11, 6, 6, 5, 5, 5, 4, 4, 4, 4], 4)]
    for capacity, lengths, least in cases:
        assert fewest(lengths, capacity) == least == sum(p.times for p in complete_bins(Counter(lengths), capacity))


def test_best_fit_and_a_result_that_is_never_worse():
    random.seed(6)
    for _ in range(100):
        capacity = random.choice([20, 100])
        lengths = sorted((random.randint(1, capacity) for _ in range(random.randint(1, 60))), reverse=True)
        rooms = []
        for x in lengths:
            room = min((r for r in rooms if r >= x), default=None)
            if room is not None:
                rooms.remove(room)
            rooms.append((capacity if room is None else room) - x)
        assert sum(p.times for p in best_fit(Counter(lengths), capacity)) == len(rooms)
        assert sum(p.times for p in complete_bins(Counter(lengths), capacity, effort=0)) <= len(rooms)


def test_large_histogram_meets_its_bound():
    random.seed(1)
    h = Counter(min(2048, max(1, int(random.lognormvariate(5.3, 1.2)))) for _ in range(200_000))
    assert sum(p.times for p in complete_bins(h, 2048)) == -(-sum(x * c for x, c in h.items()) // 2048)


def test_fillings_are_maximal_and_exact_ones_dominate():
    assert fillings({5: 1, 3: 2}, [3, 5], 5) == [((5, 1),)]
    assert fillings({3: 2}, [3], 7) == [((3, 2),)]
    assert fillings({}, [], 7) == [()]
    with pytest.raises(ValueError):
        complete_bins({9: 1}, 8)
    assert complete_bins({}, 8) == []


def test_slots_place_every_rank_once():
    patterns = complete_bins({4: 7, 3: 5, 1: 9}, 10)
    slots, seen = Slots.of(patterns), defaultdict(list)
    for length, n in ((4, 7), (3, 5), (1, 9)):
        for s, o in zip(*slots.place(length, np.arange(n)), strict=True):
            seen[s].append((o, length))
    for places in seen.values():
        at = 0
        for o, length in sorted(places):
            assert o == at
            at += length
        assert at <= 10
    assert len(seen) == slots.sequences


def test_pack(odd_docs, odd_rows, no_docs):
    got = pack(odd_docs, WORD, end_id=0, capacity=64).collect()
    ids = lambda t: np.array([*splitter(WORD).library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    want = Counter()
    for d, t, *_ in odd_rows:
        x = ids(t)
        for i, at in enumerate(range(0, len(x), 64)):
            want[d, i, at, len(x[at : at + 64]), zlib.crc32(x[at : at + 64].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0] + [n for _, n in sorted(places)])[:-1].tolist()
        assert sum(n for _, n in places) <= 64
    assert pack(no_docs, WORD).count() == 0


@pytest.mark.parametrize("run", [4096, 7])
def test_repeated_rows_are_one_row_with_a_count(spark, monkeypatch, run):
    """One document 5,000 times among others: every copy has a place of its own, whatever the bucket's size."""
    monkeypatch.setattr(packing, "BUCKET_ROWS", 40)
    monkeypatch.setattr(packing, "COPIES", run)
    rows = [(7, "the same words again")] * 5000 + [(k, "other words " * (k % 9)) for k in range(100, 300)] + [(None, None)] * 3
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), WORD, end_id=0, capacity=64).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0] + [n for _, n in sorted(places)])[:-1].tolist()
        assert sum(n for _, n in places) <= 64
