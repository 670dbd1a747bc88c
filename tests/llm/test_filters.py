"""Quality rules, toxicity and language ID."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from deltaloom.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measure(spark, odd_docs, odd_rows, no_docs):
    got = Counter(tuple(r)[:6] for r in quality.measure(odd_docs, ["doc_id"]).collect())
    assert got == Counter((d, *counts(t)) for d, t, *_ in odd_rows)
    random.seed(3)
    texts = [" ".join(random.choice("ab") for _ in range(n)) + "\n" + "x y\n" * (n % 3) for n in range(40)]
    rows = quality.measure(spark.createDataFrame([(t,) for t in texts], "text string"), ["text"]).collect()
    assert all(tuple(r)[1:6] == counts(r.text) for r in rows)
    assert quality.measure(no_docs, ["doc_id"]).count() == 0


def test_binomial_tail_and_cutoffs():
    assert quality.binomial_tail(0, 10, 0.5) == pytest.approx(2**-10)
    assert quality.binomial_tail(3, 8, 0.3) == pytest.approx(0.805896, abs=1e-6)
    rng = random.Random(7)
    for _ in range(300):
        n, p = rng.randrange(1, 400), rng.choice([0.001, 0.01, 0.05, 0.3, 0.9])
        k = rng.randrange(n + 1)
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9, abs=1e-300)
    assert quality.binomial_tail(49_000_000, 1_000_000_000, 0.05) < 1e-6 < quality.binomial_tail(49_999_000, 1_000_000_000, 0.05)
    good, bad = np.zeros(quality.BINS, int), np.zeros(quality.BINS, int)
    good[:10], bad[40:50] = 500, 30
    assert quality.certified_cutoff(good, bad, 0.01, 1e-3) == 40
    assert quality.certified_cutoff(good // 500, bad, 0.01, 1e-3) is None  # ten good ones prove nothing
    good[45] = 400
    cut = quality.certified_cutoff(good, bad, 0.01, 1e-3)
    assert cut is None or cut > 45


def test_rules_need_labels(spark, odd_docs, odd_rows, no_docs):
    measured = quality.measure(odd_docs, ["doc_id"])
    rules = quality.learn_rules(measured, spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int"))
    assert rules.cutoffs == {}
    kept = quality.passing(odd_docs, rules)
    base = {d for d, t, *_ in odd_rows if counts(t)[0] >= 10 and 100 * counts(t)[4] <= 20 * counts(t)[0]}
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == base
    assert quality.passing(no_docs, rules).count() == 0


def cutoffs_by_force(rows, text, labels):
    """The certified bins from plain lists, by exact sums of binomial terms: a risk of 1/20 shared by the signals, a level of 1/20 by all."""
    draws = {}
    for r in rows:
        if r.doc_id in labels:
            key = (r.n_words, text[r.doc_id], bytes(r.quality_bins))
            draws[key] = max(draws.get(key, 0), labels[r.doc_id])
    out = {}
    strata, signals = len(quality.STRATA) + 1, len(quality.SIGNALS)
    for s in range(strata):
        own = [(k[2], y) for k, y in draws.items() if sum(k[0] >= x for x in quality.STRATA) == s]
        for f in range(signals):
            good, bad = [b[f] for b, y in own if y], [b[f] for b, y in own if not y]
            if not good or not bad:
                continue
            best = 0.0
            for cut in range(quality.BINS - 1, 0, -1):
                false, caught, n = sum(x >= cut for x in good), sum(x >= cut for x in bad), len(good)
                if sum(math.comb(n, i) * (20 * signals - 1) ** (n - i) for i in range(false + 1)) * 20 * strata * signals > (20 * signals) ** n:
                    break
                gain = caught / len(bad) - 10 * false / n
                if gain > best + 1e-12 and caught * n > 20 * false * len(bad):
                    out[s, f], best = cut, gain
    return out


def test_rules_by_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["word", "other", "thing", "more"]) + (rng.choice("!$#") * rng.randrange(9) if i % 4 == 0 else "") for _ in range(rng.choice([20, 100])))) for i in range(4000)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string")
    measured = quality.measure(docs, ["doc_id"])
    labels = {i: int(i % 4 != 0 or i % 997 == 0) for i, _ in rows if i % 5}
    rules = quality.learn_rules(measured, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    want = cutoffs_by_force(measured.collect(), dict(rows), labels)
    assert want and rules.cutoffs == want
    for r in quality.judged(measured, rules).collect():
        s = sum(r.n_words >= x for x in quality.STRATA)
        assert r.kept == (not r.base_failed and not any(cut <= r.quality_bins[f] for (at, f), cut in want.items() if at == s))
    agreeing = spark.createDataFrame([(i, 1) for i in range(4000)], "doc_id long, quality int")
    assert quality.learn_rules(measured, agreeing).cutoffs == {}


def test_quality_query(spark):
    rows = queries.op9_quality(spark, SF).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(not r.kept for r in rows if r.base_failed)
    good = [r for r in rows if label.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(not r.kept for r in good) <= 0.05 * len(good)


def test_toxicity(spark, odd_docs, no_docs):
    rows = queries.op2_toxicity(spark, SF).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    hit, flagged, toxic = sum(p and y for p, y in held), sum(p for p, _ in held), sum(y for _, y in held)
    assert toxic >= 5 and hit / toxic >= 0.6 and hit / flagged >= 0.8  # 45 toxic labels to learn from
    model = toxicity.fit([("you idiot fool", 1), ("kind words here", 0)] * 20 + [("such an idiot", 1), ("what kind people", 0)] * 20)
    out = toxicity.score(odd_docs, model, ["doc_id"]).collect()
    assert len(out) == odd_docs.count() and len({r.score for r in out if r.doc_id in (2, 3, 8)}) == 1
    assert toxicity.without_toxic(odd_docs, model).columns == odd_docs.columns
    assert toxicity.score(no_docs, model, ["doc_id"]).count() == 0
    sure = lambda t: model.bias + float(np.mean([model.table[toxicity.features(w)].mean() for w in t.split()]))
    assert sure("idiots") > sure("kinds")  # words that were never seen
    assert toxicity.fit([]).bias < 0 and toxicity.fit([("a b", 0)]).bias < 0


def test_toxicity_on_held_out_rows(spark):
    """Ten times the labels: precision and recall on rows that were never learnt from."""
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    hit, flagged, toxic = sum(r.predicted and r.toxic for r in rows), sum(r.predicted for r in rows), sum(r.toxic for r in rows)
    assert toxic > 80 and hit / toxic > 0.85 and hit / flagged > 0.85


def test_toxic_sample_is_bounded_whatever_repeats(spark):
    """One labelled id with a third of all rows, equal and different: one text of it is taken."""
    rows = [(1, "the same text")] * 2000 + [(2, f"text {k}") for k in range(2000)] + [(k, f"of {k}") for k in range(3, 503)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k < 200)) for k in range(1, 503)], "doc_id long, toxic int")
    pairs, share = toxicity.sample_labelled(docs, labels, 1000, 1000)
    pairs = list(pairs)
    assert len(pairs) == 502 and share == pytest.approx(199 / 502) and sum(t == "the same text" for t, _ in pairs) == 1
    few = Counter(y for _, y in toxicity.sample_labelled(docs, labels, 30, 50)[0])
    assert few[1] <= 30 and few[0] <= 50 and min(few.values()) > 15


def test_vectors_are_more_than_one_number():
    """Dimensions part from one another, and sums by bucket are those of the plain embedding."""
    rng = random.Random(2)
    texts = [(" ".join(rng.choices(["idiot", "fool", "you"] if i % 3 == 0 else ["kind", "good", "you"], k=6)), int(i % 3 == 0)) for i in range(60)]
    words = sorted({w for t, _ in texts for w in t.split()})
    parts = [toxicity.features(w) for w in words]
    doc_of, word_of, weight = (np.array(x) for x in zip(*((i, words.index(w), c / 6) for i, (t, _) in enumerate(texts) for w, c in Counter(t.split()).items()), strict=True))
    bags = toxicity._Bags(doc_of, word_of, weight, parts, len(texts))
    vectors = np.random.default_rng(1).normal(size=(len(bags.used), 5))
    at = {b: i for i, b in enumerate(bags.used.tolist())}
    embedded = np.array([np.mean([np.mean([vectors[at[b]] for b in toxicity.features(w)], axis=0) for w in t.split()], axis=0) for t, _ in texts])
    assert np.allclose(np.stack([bags.down(vectors[:, d]) for d in range(5)], 1), embedded)
    error = np.random.default_rng(2).normal(size=len(texts))
    assert np.allclose(bags.up(error) @ vectors, error @ embedded)  # the softmax's gradient, from sums by bucket
    y = np.array([y for _, y in texts], float)
    steps = list(toxicity._steps(bags, y, np.full(len(y), 1 / len(y)), 0.3, 30, 0.2, 1))
    assert ((steps[-1][3] > 0) == (y > 0)).all() and toxicity.DIM >= 16


def test_border_is_told_by_the_given_rows():
    f1, border = toxicity._border(np.array([3.0, 2.0, 1.0, 0.5, -1.0, -2.0]), np.array([1.0, 1.0, 0.0, 0.0, 1.0, 0.0]), np.ones(6))
    assert f1 == pytest.approx(2 * 2 / (2 + 2 + 3)) and border == pytest.approx(1.5)  # the one beyond isn't worth two clean ones
    x, y = np.repeat([3.0, 1.0, -1.0, -3.0], 2000), np.repeat([1.0, 0.0, 1.0, 0.0], 2000)
    y[2000:2200], y[2200:4000] = 0.0, 1.0
    assert toxicity._border(x, y, np.ones(8000))[1] == pytest.approx(-2)  # many tell what few can't


def test_language(spark, odd_docs, no_docs):
    rows = queries.op5_language(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    words = langid.counted([("en", "the house and the garden"), ("de", "das haus und der garten")])
    model = langid.fit(words, langid.counted_grams(words))
    assert model.word_scores("thez").argmax() == model.langs.index("en")  # backs off to its n-grams
    out = {r.doc_id: r for r in langid.identify(odd_docs, model, ["doc_id"]).collect()}
    assert {out[d].lang_pred for d in (2, 3, 8)} == {"und"} and all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(no_docs, model, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.fit({}, {}), ["doc_id"]).collect()} == {"und"}
    assert langid.sample_counts(langid.sample_labelled(no_docs, 10)) == ({}, {})


def language_by_force(text, counts):
    """The language of most summed log frequency, from the definitions: words first, then the longest known n-grams."""
    langs = sorted(counts)
    tables = [{g: c for g, c in counts.items()}]
    for n in langid.ORDERS:
        own = {lang: Counter() for lang in langs}
        for lang in langs:
            for w, c in counts[lang].items():
                for g in (f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)):
                    own[lang][g] += c
        tables.append(own)

    def logs(table, x):
        size = len(set().union(*table.values()))
        return [np.log((table[lang][x] + 0.1) / (table[lang].total() + 0.1 * size)) for lang in langs]

    total = np.zeros(len(langs))
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if any(tables[0][lang][w] for lang in langs):
            total += logs(tables[0], w)
            continue
        for n, table in zip(langid.ORDERS, tables[1:], strict=True):
            found = [logs(table, g) for g in (f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)) if any(table[lang][g] for lang in langs)]
            if found:
                total += np.mean(found, axis=0)
                break
    return langs[int(total.argmax())], 1 / np.exp(total - total.max()).sum()


def test_language_by_force(spark):
    words = {"en": "the house and garden of this that", "de": "das haus und der garten von diesem", "fr": "la maison et le jardin de ce"}
    random.seed(4)
    counts = langid.counted([(lang, " ".join(random.choices(w.split(), k=60))) for lang, w in words.items()])
    pool = [*" ".join(words.values()).split(), "jardine", "housen", "gartenhaus", "xyz", "q", "ceci"]
    texts = [" ".join(random.choices(pool, k=random.randrange(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in langid.identify(docs, langid.fit(counts, langid.counted_grams(counts)), ["text"]).collect():
        lang, score = language_by_force(r.text, counts)
        assert (r.lang_pred == lang or abs(score - 0.5) < 1e-4) and r.score == pytest.approx(score, abs=1e-4)


def test_language_sample_takes_every_language_and_no_copies(spark):
    rows = [("en", f"text number {i}") for i in range(500)] + [("en", "one copied text")] * 3000
    rows += [(f"l{k}", f"w{k} w{k}") for k in range(100) for _ in range(3)]
    got = langid.sample_labelled(spark.createDataFrame(rows, "lang string, text string"), 400)
    assert got.count() == got.distinct().count() <= 20 * 101
    assert {r.l for r in got.select("l").distinct().collect()} == {lang for lang, _ in rows}
    assert set(langid.sample_counts(got)[0]) == {lang for lang, _ in rows}


def test_language_model_keeps_all_words_and_grams_of_its_sample(spark):
    """100,000 distinct words of one language, more than any fixed table would take, and all their n-grams."""
    rows = [("en", " ".join("".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(i, i + 1000))) for i in range(0, 100_000, 1000)] + [("de", "zwei worte"), ("xx", "1 2")]
    samples = spark.createDataFrame(rows, "l string, t string").repartition(5)
    words, grams = langid.sample_counts(samples)
    assert words == langid.counted(rows) | {"xx": Counter()} and len(words["en"]) == 100_000
    assert grams == langid.counted_grams(words) and len(langid.fit(words, grams).words) == 100_002
