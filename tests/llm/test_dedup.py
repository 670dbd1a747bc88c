"""Substring dedup and near-duplicate classes against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deltaloom.llm import minhash, substring


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def kept_by_force(rows, window):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                first[tuple(w[i : i + window])] = min(d, first.get(tuple(w[i : i + window]), d))
    out = []
    for d, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                keep[i : i + window] = [False] * window
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((d or 0, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(5, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [[f"u{rng.randrange(3000)}" for _ in range(rng.randrange(30))] for _ in range(3)] + rng.sample(passages, rng.randrange(3))
        rng.shuffle(parts)
        rows.append((rng.randrange(50), " ".join(itertools.chain(*parts))))
    rows += [rows[0], (99, rows[1][1]), (None, rows[2][1]), (7, "a a a a a a a a a a a a a a a a a a a a a a a a a"), (8, "a a a a a a a a a a a a"), (9, None), (10, ""), (11, "é\x85x\xa0y " * 20), (12, "é\x85x\xa0y " * 21)]
    return rows


@pytest.mark.parametrize(("window", "heavy"), [(3, 4096), (20, 4096), (20, 1), (8, 2), (50, 3)])
def test_substring(spark, window, heavy):
    rows = corpus(window)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeat_report(docs, window, heavy).collect())
    assert got == kept_by_force(rows, window)


def test_without_repeats_keeps_rows_and_columns(spark, odd_docs, no_docs):
    rows = [(1, "one two three four five six", "x"), (2, "seven one two three four eight", "y"), (3, "one two three four five six", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {r.doc_id: (r.text, r.kept) for r in substring.without_repeats(docs, 4).collect()}
    assert got == {1: (rows[0][1], "x"), 2: ("seven eight", "y"), 3: ("", None)}
    out = substring.without_repeats(odd_docs, 50)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert substring.repeat_report(no_docs).count() == 0


def test_tree_has_the_nodes_of_all_common_prefixes():
    """Against the definition: a node is a set of all suffixes that agree in so many words, and in no word more."""
    rng = random.Random(1)
    for _ in range(30):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 6))]
        words = np.array([x for i, t in enumerate(texts) for x in (*t, 100 + i)])
        leaves = np.flatnonzero(words < 100)
        tree = substring.SuffixTree(words, leaves, max(map(len, texts)) + 1)
        suffixes = [tuple(words[i:].tolist()) for i in leaves.tolist()]
        assert [suffixes[i] for i in tree.order] == sorted(suffixes)
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        for least in (1, 2, 4):
            want = {}
            for a, b in itertools.combinations(suffixes, 2):
                if (k := common(a, b)) >= least:
                    want[a[:k]] = {i for i, s in enumerate(suffixes) if s[:k] == a[:k]}
            nodes = tree.nodes(least)
            got = {suffixes[tree.order[first]][:depth]: {int(i) for i in tree.order[first : last + 1]} for depth, first, last, _ in nodes}
            assert got == want and len(nodes) == len(want)
            for depth, first, last, parent in nodes:
                name = suffixes[tree.order[first]][:depth]
                above = max((n for n in want if len(n) < depth and name[: len(n)] == n), key=len, default=None)
                assert (parent < 0) == (above is None)
                assert parent < 0 or suffixes[tree.order[nodes[parent][1]]][: nodes[parent][0]] == above


def near_corpus(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for group in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 200))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9999)}"
            rows.append((i := i + 1, " ".join(copy)))
        if group % 3 == 0:
            rows.append((i := i + 1, " ".join(base + base)))
    rows += [(i + 1, "short text"), (i + 2, "short text"), (i + 3, None), (i + 4, ""), (i + 5, ""), (None, rows[0][1]), rows[3]]
    rng.shuffle(rows)
    return rows


def classes_by_force(rows, similar):
    bags = [minhash.shingles_of([words(t)])[0] for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    use = [i for i, (d, t) in enumerate(rows) if d is not None and words(t)]
    for a, b in itertools.combinations(use, 2):
        if words(rows[a][1]) == words(rows[b][1]) or minhash.probability_jaccard(*bags[a], *bags[b]) >= similar:
            parent[top(a)] = top(b)
    least = defaultdict(lambda: 1 << 60)
    for i in use:
        least[top(i)] = min(least[top(i)], rows[i][0])
    return Counter((d, None if d is None else least[top(i)] if i in set(use) else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("chunk", [4096, 3])
def test_near_duplicates(spark, chunk):
    rows = near_corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs, chunk=chunk).collect()) == classes_by_force(rows, 0.8)


def test_links_whose_signatures_agree_little(spark):
    """Similarity 0.811, but less than 0.68 of the slots agree: found by their buckets, and to be verified."""
    rows = []
    for seed in (132, 1544, 1561, 2309):
        rng = random.Random(seed)
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        copy = [f"n{i}" if i in (10, 60) else w for i, w in enumerate(base)]
        a, b = minhash.signatures(minhash.shingles_of([[w.encode() for w in x] for x in (base, copy)]))
        assert (a == b).mean() < 0.68 and (minhash.band_names(a[None]) == minhash.band_names(b[None])).any()
        rows += [(2 * seed, " ".join(base)), (2 * seed + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect()} == {(d, d - d % 2) for d, _ in rows}


def test_an_earlier_band_that_agrees_by_accident_hides_no_link(spark, monkeypatch):
    """a and b are alike and share band 5 only; their bytes agree in band 0 too, where names differ. c is the centre."""
    text = [f"w{i}" for i in range(100)]
    texts = {1: text, 2: [*text[:-1], "x"], 3: [*text[:50], *(f"c{i}" for i in range(50))]}
    small = {d: np.zeros(minhash.SLOTS, np.uint8) for d in texts}
    small[1][80:88], small[2][88:] = 1, 1
    rows = [(d, d * 10, [5 if k == 5 else 1000 * d + k for k in range(minhash.BANDS)], bytearray(small[d].tobytes())) for d in texts]

    def measured(docs):
        made = spark.createDataFrame(rows, "doc_id long, node long, bands array<long>, small binary")
        return docs.select("doc_id", "key").join(made, "doc_id").select("doc_id", "key", "node", F.lit(0).cast("long").alias("more"), "bands", "small")

    monkeypatch.setattr(minhash, "_measured", measured)
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_index_finds_all_that_are_alike():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 400, 60)).astype(np.uint64)
    bags = [(np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype(np.uint64), 1 + (k % 2) * 4) for k in range(30)]
    bags += [(np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 400, 3).astype(np.uint64)])), 1 + (k % 2) * 2) for k in range(30)]
    bags = [(h, rng.integers(1, high + 1, len(h)).astype(np.uint32)) for h, high in bags]
    found = 0
    for similar in (0.5, 0.8, 0.9):
        index = minhash.BagIndex([*bags, (np.zeros(0, np.uint64), np.zeros(0, np.uint32))], similar)
        for h, c in [*bags, (base, np.ones(len(base), np.uint32))]:
            for may, (x, y) in zip(index.candidates(h, c), bags, strict=False):
                alike = minhash.probability_jaccard(h, c, x, y) >= similar
                found += alike
                assert may or not alike
    assert found > 200
    # What all bags share makes no candidates.
    common = np.arange(1000, 1070, dtype=np.uint64)
    bags = [(np.concatenate([common, np.arange(30, dtype=np.uint64) + 10_000 * (k + 1)]), np.ones(100, np.uint32)) for k in range(50)]
    index = minhash.BagIndex(bags, 0.8)
    assert sum(index.candidates(*b).sum() for b in bags) == 50


def test_long_documents_with_a_common_passage_make_no_pairs(spark, monkeypatch):
    """600 documents of 5,500 words share 4,000; three of them have a near copy. Only those and a few more are compared."""
    rng = np.random.default_rng(8)
    common = np.arange(4000, dtype=np.uint64)
    own = [np.sort(rng.integers(10_000, 2**60, 1500)).astype(np.uint64) for _ in range(600)]
    for k in (1, 2, 3):
        own[k + 300] = np.sort(np.concatenate([own[k][:1400], own[k + 300][:100]]))
    bags = [np.concatenate([common, o]) for o in own]
    compared, real = [], minhash.probability_jaccard
    monkeypatch.setattr(minhash, "probability_jaccard", lambda *x: compared.append(1) or real(*x))
    rows = [(1, None, query, k, k, b.tobytes(), None) for query in (False, True) for k, b in enumerate(bags)]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["band", "sub", "query", "node", "component", "shingles", "counts"])
    links = {x for out in minhash._rest(0.8)(iter([batch])) for x in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    assert links == {(k, k + 300) for k in (1, 2, 3)} and len(compared) < 300


@pytest.mark.parametrize("held", [1 << 30, 200_000])
def test_long_documents_are_linked_exactly(spark, monkeypatch, held):
    """Documents of 4,600 words, beyond any length that is treated apart, in parts by members and by bytes."""
    monkeypatch.setattr(minhash, "PART_BYTES", held)
    random.seed(12)
    passage = [f"p{random.randrange(10**6)}" for _ in range(3000)]
    rows = [(k, " ".join([*passage, *(f"o{k}x{random.randrange(10**6)}" for _ in range(1600))])) for k in range(12)]
    for k in (2, 5):
        words = rows[k][1].split()
        words[77], words[3900] = "changed", "too"
        rows.append((20 + k, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(k, k) for k in range(12)} | {(22, 2), (25, 5)}


def test_one_node_for_two_texts_is_two_nodes(spark, monkeypatch):
    made = minhash._measured
    monkeypatch.setattr(minhash, "_measured", lambda docs: made(docs).withColumn("node", F.col("node") % 2))
    rows = near_corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect()) == classes_by_force(rows, 0.8)


def test_recall_of_planted_pairs(spark):
    """6,000 documents, pairs of every similarity from 0.7 to 1, and a passage that a third of all share; against all pairs."""
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for k in range(2800):
        base = [f"w{rng.randrange(200_000)}" for _ in range(rng.randrange(60, 120))] + (shared if k % 3 == 0 else [])
        rows.append(base)
        if k % 7 < 6:
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**9)}"
            rows.append(copy)
    rows += [[f"u{rng.randrange(10**9)}" for _ in range(50)] for _ in range(6000 - len(rows))]
    bags = [minhash.shingles_of([[w.encode() for w in r]])[0] for r in rows]
    where = defaultdict(list)
    for i, (h, _) in enumerate(bags):
        for x in h.tolist():
            where[x].append(i)
    met = {(a, b) for held in where.values() if len(held) < 100 for a, b in itertools.combinations(held, 2)}
    links = {p: j for p in met if (j := minhash.probability_jaccard(*bags[p[0]], *bags[p[1]])) >= 0.8}
    assert len(links) > 1200 and min(links.values()) < 0.81 and max(links.values()) > 0.95
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(4)
    label = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert {i: c for i, c in label.items() if i != c} == {b: a for a, b in links}


def test_first_of_each_class(spark, odd_docs, no_docs):
    got = minhash.first_of_each_class(odd_docs)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    assert minhash.near_duplicates(no_docs).count() == 0
    docs = spark.createDataFrame([(3, "a b c d e f g", 1), (5, "a b c d e f g", 2)], "doc_id long, text string, class_id int")
    assert [tuple(r) for r in minhash.first_of_each_class(docs).collect()] == [(3, "a b c d e f g", 1)]


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.6, 0.9):
        common, own = rng.integers(0, 1 << 62, int(600 * share)), [rng.integers(0, 1 << 62, 600 - int(600 * share)) for _ in range(2)]
        bags = [(np.unique(np.concatenate([common, o]).astype(np.uint64)), None) for o in own]
        bags = [(h, rng.integers(1, 6, len(h))) for h, _ in bags]
        s = minhash.signatures(bags, slots=3000)
        exact = minhash.probability_jaccard(*bags[0], *bags[1])
        assert abs((s[0] == s[1]).mean() - exact) < 4 * (exact * (1 - exact) / 3000) ** 0.5 + 1e-3


def test_probability_jaccard_by_definition():
    rng = random.Random(2)
    for _ in range(50):
        x = {k: rng.randrange(1, 5) for k in rng.sample(range(20), rng.randrange(1, 12))}
        y = {k: rng.randrange(1, 5) for k in rng.sample(range(20), rng.randrange(1, 12))}
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in {*x} & {*y})
        side = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
        assert minhash.probability_jaccard(*side(x), *side(y)) == pytest.approx(want)


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(500, k) for k in range(501, 540)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: top(x) for p in pairs for x in p}
