"""SimHash fingerprints, the Gray-order index and its components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from deltaloom.llm import simhash


def fingerprint_by_force(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def components_by_force(values):
    """Least place of each component of unsigned numbers that differ in at most two bits."""
    label = list(range(len(values)))
    codes = np.array(values, np.uint64)
    while True:
        new = [min(label[j] for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 2)) for i in range(len(values))]
        if new == label:
            return label
        label = new


def clouds(seed, n=400, volatile=9):
    """Numbers in clouds whose members differ in a few bits, drifting chains, and numbers on their own."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    bits = {c: rng.sample(range(64), volatile) for c in centres}
    out = {0, (1 << 64) - 1}
    for _ in range(n):
        c = rng.choice(centres)
        for b in rng.sample(bits[c], rng.randrange(volatile)):
            c ^= 1 << b
        out.add(c)
    step = rng.getrandbits(64)
    for _ in range(40):
        step ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        out.add(step)
    return sorted(out | {rng.getrandbits(64) for _ in range(100)})


def test_fingerprints(odd_rows):
    texts = [r[1] for r in odd_rows] + ["a", "A b", "a B c", "a b c d " * 400, "É é\x85x\xa0y \x1c z", "x " * 70_000]
    assert [int.from_bytes(simhash.fingerprint(t)) for t in texts] == [fingerprint_by_force(t) for t in texts]


def test_rank_is_the_place_in_gray_order(spark):
    codes = [i ^ i >> 1 for i in range(64)]
    got = spark.createDataFrame([(c,) for c in codes], "c long").select(simhash.gray_rank(F.col("c")).alias("r")).collect()
    assert [r.r + (1 << 63) for r in got] == list(range(64))


@pytest.mark.parametrize("fan", [2, 8])
def test_index_finds_all_pairs(fan):
    for seed in range(5):
        codes = np.array(clouds(seed), np.uint64)
        group = np.sort(np.random.default_rng(seed).integers(0, 4, len(codes)))
        sizes = np.unique(group, return_counts=True)[1]
        q, m = simhash.GrayIndex(codes, sizes, fan).search(codes, group, after=np.arange(len(codes)))
        near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
        i, j = np.nonzero(np.triu(near & (group[:, None] == group[None, :]), 1))
        assert sorted(zip(q.tolist(), m.tolist(), strict=True)) == sorted(zip(i.tolist(), j.tolist(), strict=True))


def test_search_leaves_groups_out():
    """Far groups are pruned high up: a search visits few of the leaves."""
    rng = np.random.default_rng(0)
    codes = np.sort(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    index, seen = simhash.GrayIndex(codes, np.array([len(codes)])), []
    count = np.bitwise_count
    try:
        simhash.np.bitwise_count = lambda x: seen.append(len(x)) or count(x)
        index.search(codes[:100], np.zeros(100, np.int64))
    finally:
        simhash.np.bitwise_count = count
    assert sum(seen) < 0.2 * 100 * len(codes)


@pytest.mark.parametrize("chunk", [1, 3, 40, 16_384])
def test_links_connect_like_all_pairs(spark, chunk):
    values = clouds(7, 150, 7)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    codes = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    place = {v: i for i, v in enumerate(signed)}
    label = list(range(len(values)))
    pairs = [(place[r.a], place[r.b]) for r in simhash.links(codes, chunk).collect()]
    while True:
        new = list(label)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    assert label == components_by_force(values)


def documents(seed=3):
    rng = random.Random(seed)
    rows, base = [], [" ".join(rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(rng.randrange(30, 300))) for _ in range(12)]
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(99)}"
        rows.append((rng.randrange(120), " ".join(words)))
    return rows + [(500, None), (501, ""), (2, " \n "), (None, base[0]), (None, "no id, and nothing near it"), (7, base[1].upper()), (7, base[1])]


def by_force(rows):
    prints = [fingerprint_by_force(t) for _, t in rows]
    label = components_by_force(prints)
    least = {}
    for (d, _), c in zip(rows, label, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted((str(d), f"{p:016x}", least.get(c)) for (d, _), p, c in zip(rows, prints, label, strict=True))


@pytest.mark.parametrize("chunk", [2, 16_384])
def test_components(spark, chunk):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_components(docs, chunk).collect())
    assert got == by_force(rows)


def test_odd_tables(spark, odd_docs, odd_rows, no_docs):
    clash = odd_docs.withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(9)).withColumn("node", F.lit(1))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_components(clash).collect())
    assert got == by_force([r[:2] for r in odd_rows])
    assert simhash.simhash_components(no_docs).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.simhash_components(no_docs).count() == 0
