"""Near-duplicate classes by ProbMinHash: weighted word shingles, banding, exact verification.

Every shingle of a document is a Poisson process whose rate is its count; an arrival goes to a random
slot of the signature, and a slot keeps the shingle that came first. Two documents agree in a slot with
the probability Jaccard of their counts. Arrivals are made in rounds over many documents at once; a
shingle stops when its next arrival is later than all of its document's slots (early termination).

Documents of equal words are collapsed first. Bands of ROWS slots with two or more members are buckets:

1. In each bucket the member that agrees best with the bucket's most frequent values is the centre, and
   is paired with all members: one star, linear in the bucket. Pairs are verified exactly, and links
   become components.
2. Members that are not in the main component of a bucket are then held against all its members of other
   components, through an index of the bucket's rarest shingles: bags that are alike enough share one of
   the rarest that make up more than 1 - `similar` of each, so what a whole bucket shares (a common passage)
   makes no candidates. Candidates are verified exactly, and only links are emitted. Links within a
   component change nothing, so no link between members of a bucket is lost.

What is lost are pairs that share no band at all: (1 - s^ROWS)^BANDS of the pairs of similarity s, about
3 in a million at 0.8 and fewer above.

A bucket of more than CHUNK members is dealt to several tasks by a hash of the member; their centres get
a star of their own. In step 2 a bucket is dealt anew, so that a task holds CHUNK members and about
PART_BYTES of bags, and members outside of the main component go to each of its tasks. Centres with very
many links are hot keys of the joins that verify them, which adaptive execution splits.

A document's node is a 64-bit hash of its words; where two texts have one (told by 64 bits more), they
get new ones, so only texts that agree in 128 bits count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import listed, one_core, shielded, slices, stage, text_key, texts_of, unstage
from deltaloom.llm.substring import split_words

#: Words of a shingle, least similarity of a link, bands and slots of a band.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 24, 4
SLOTS = BANDS * ROWS
#: Members of a bucket that a task takes at once.
CHUNK = 4096
#: Bytes of shingle bags that a task of step 2 holds at once; whatever its length, a single bag is held whole.
PART_BYTES = 32 << 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles_of(words: list[list[bytes]], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document its distinct shingles (64-bit hashes, ascending) and their counts; none below `size` words."""
    lengths = [len(w) for w in words]
    flat = np.fromiter((xxhash.xxh3_64_intdigest(x) for w in words for x in w), np.uint64, sum(lengths))
    if len(flat) >= size:
        n = len(flat) - size + 1
        h = flat[:n].copy()
        for k in range(1, size):
            h = _scrambled(h + _A) + flat[k : n + k]
        h = _scrambled(h)
    out, at = [], 0
    for n in lengths:
        out.append(np.unique(h[at : at + n - size + 1], return_counts=True) if n >= size else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        at += n
    return out


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """One row of 32-bit shingle names for each document; documents without shingles have zeros."""
    sizes = np.array([len(h) for h, _ in bags], np.int64)
    best = np.full(len(bags) * slots, np.iinfo(np.uint64).max, np.uint64)
    some = sizes > 0
    if some.any():
        element = np.concatenate([h for h, _ in bags])
        rate = np.concatenate([c for _, c in bags]).astype(np.float64)
        doc = np.repeat(np.arange(len(bags)), sizes)
        time, state, name = np.zeros(len(element)), element.copy(), _scrambled(element ^ _C) & np.uint64(0xFFFFFFFF)
        while len(doc):
            state = state + _A
            random = _scrambled(state)
            time = time - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            slot = (_scrambled(random ^ _B) >> np.uint64(32)).astype(np.int64) * slots >> 32
            # Positive floats order like their bits; the name breaks ties.
            arrival = time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | name
            np.minimum.at(best, doc * slots + slot, arrival)
            last = (best.reshape(-1, slots).max(axis=1) >> np.uint64(32)).astype(np.uint32)
            going = (arrival >> np.uint64(32)).astype(np.uint32) < last[doc]
            doc, time, state, name, rate = doc[going], time[going], state[going], name[going], rate[going]
    out = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(-1, slots)
    out[~some] = 0
    return out


def band_names(signature: np.ndarray) -> np.ndarray:
    """64-bit names of the bands of each signature; the low five bits are the band's number."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _A, parts.shape[:2]).copy()
    for k in range(ROWS):
        h = _scrambled(h ^ parts[:, :, k] * _A) + _C
    return (h & ~np.uint64(31) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Sum over common shingles i of 1 / sum over all j of max(x_j / x_i, y_j / y_i); 0 for empty bags."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if x.max() == 1 and y.max() == 1:
        return len(common) / (len(a) + len(b) - len(common))
    x, y = x.astype(float), y.astype(float)
    both_x, both_y = x[i], y[j]
    rest_x, rest_y = x.sum() - both_x.sum(), y.sum() - both_y.sum()
    ratio, group = np.unique(both_x / both_y, return_inverse=True)
    total = 0.0
    for k, r in enumerate(ratio):  # the denominator, times x_i, depends on i by the ratio only
        scale = rest_x + r * rest_y + np.maximum(both_x, r * both_y).sum()
        total += both_x[group == k].sum() / scale
    return float(total)


def _measured(texts: DataFrame) -> DataFrame:
    """doc_id, key, node and more (128 bits of the words), bands, small (a byte of each slot); without words node is null."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("more", pa.int64()), ("bands", pa.list_(pa.int64())), ("small", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        for part in slices(batches, 1024):
            words = [split_words(t) for t in part.column(1).to_pylist()]
            node = [divmod(xxhash.xxh3_128_intdigest(b" ".join(w)), 1 << 64) if w else None for w in words]
            high, low = ([x[k] - (1 << 63) if x else None for x in node] for k in (0, 1))
            bags = shingles_of(words)
            found = signatures(bags)
            bands = [b if len(h) else None for b, (h, _) in zip(band_names(found).tolist(), bags, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array([r.tobytes() for r in found.astype(np.uint8)], pa.binary())], schema=schema)

    return texts.mapInArrow(run, "doc_id long, key long, node long, more long, bands array<long>, small binary")


def _told_apart(measured: DataFrame) -> DataFrame:
    """measured with new nodes for texts that share one and differ in `more`: hardly any, whatever the input's size."""
    twins = measured.filter("node is not null").groupBy("node").agg(F.min("more").alias("_a"), F.max("more").alias("_b")).filter("_a <> _b").select("node", F.lit(True).alias("_twin"))
    twins = stage(twins, "twins")
    if twins.isEmpty():
        return measured.drop("more")
    node = F.when(F.col("_twin"), F.xxhash64("more", "node")).otherwise(F.col("node"))
    return measured.join(twins, "node", "left").withColumn("node", node).drop("_twin", "more")


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_STAR = "a long, b long, band long, small binary"


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns, of sorted batches."""
    now, rows = None, []
    for part in slices(batches, 4096):
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _centre(small: np.ndarray) -> int:
    """The row that agrees in most slots with each slot's most frequent byte."""
    if len(small) < 3:
        return 0
    slots = small.shape[1]
    counts = np.bincount((small.astype(np.int64) + 256 * np.arange(slots)).ravel(), minlength=256 * slots).reshape(slots, 256)
    return int((small == counts.argmax(axis=1).astype(np.uint8)).sum(axis=1).argmax())


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, sub, node, small), sorted by the first two: pairs of each part's centre, and the centre itself (b null) where there are more parts."""
    one_core()
    for (band, sub), rows in _groups(batches, 2):
        node = np.array([r[0] for r in rows], np.int64)
        small = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
        c = _centre(small)
        b = node[node != node[c]]
        a = np.full(len(b), node[c])
        pairs = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.binary())]
        if len(b):
            yield pa.RecordBatch.from_arrays(pairs, names=["a", "b", "band", "small"])
        if sub is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node[c]]), pa.nulls(1, pa.int64()), pa.array([band]), pa.array([small[c].tobytes()], pa.binary())], names=["a", "b", "band", "small"])


def _bag(shingles: bytes, counts: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(shingles, "<u8")
    return h, np.frombuffer(counts, "<u4") if counts else np.ones(len(h), np.uint32)


class BagIndex:
    """Shingle bags, to find those that may be alike to one bag at the price of the rare shingles in common.

    Shingles are ordered by how many bags have them. Of each bag the rarest are indexed until they make up more
    than 1 - similar of it. Bags that share none of those have less than `similar` in common: all that the
    one whose rarest end first could share lies beyond them. The sum of the lesser shares of common
    shingles is at least the probability Jaccard, as the sum of max(x_j / x_i, y_j / y_i) is at least
    that of either.
    """

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], similar: float) -> None:
        self.similar, self.n = similar, len(bags)
        some = [(i, b) for i, b in enumerate(bags) if len(b[0])]
        every = np.concatenate([h for _, (h, _) in some]) if some else np.zeros(0, np.uint64)
        self.known, self.often = np.unique(every, return_counts=True)
        rare = [(i, self._rarest(h, c)) for i, (h, c) in some]
        shingles = np.concatenate([h for _, h in rare]) if rare else np.zeros(0, np.uint64)
        owner = np.repeat(np.array([i for i, _ in rare], np.int64), [len(h) for _, h in rare])
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.owner = shingles[order], owner[order]

    def _rarest(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        often = np.where(self.known[at] == h, self.often[at], 0)  # what no bag has comes first
        order = np.lexsort((h, often))
        mass = np.cumsum(c[order]) / c.sum()
        return h[order[: int(np.searchsorted(mass, 1 - self.similar + 1e-9, "right")) + 1]]

    def candidates(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Whether each bag may have a probability Jaccard of `similar` or more with (h, c)."""
        out = np.zeros(self.n, bool)
        if len(h) and len(self.shingles):
            rare = self._rarest(h, c)
            low, high = (np.searchsorted(self.shingles, rare, side) for side in ("left", "right"))
            n = high - low
            out[self.owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        return out


def _rest(similar: float):
    """(band, sub, query, node, component, shingles, counts), sorted: members of a part first, then queries,
    into the links (a, b).

    Candidates of different components are verified in each bucket that they share; a component that a
    bucket has linked is not tried again there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        now, members, own, root = None, [], None, {}

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        for part in slices(batches, 256):
            found = []
            for band, sub, query, node, component, shingles, counts in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (band, sub) != now:
                    now, members, own, root = (band, sub), [], None, {}
                if not query:
                    members.append((node, component, _bag(shingles, counts)))
                    continue
                if own is None:
                    own = np.array([m[1] for m in members], np.int64), BagIndex([m[2] for m in members], similar)
                bag = _bag(shingles, counts)
                for i in np.flatnonzero(own[1].candidates(*bag) & (own[0] != component)).tolist():
                    other, its, theirs = members[i]
                    if top(its) != top(component) and probability_jaccard(*bag, *theirs) >= similar:
                        root[top(its)] = top(component)
                        found.append((min(node, other), max(node, other)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else [[]] * 2)], schema=_PAIR)

    return run


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) into (node, shingles, counts): 32-bit names in ascending order; counts null where all are 1."""
    one_core()
    for part in slices(batches, 64):
        rows = []
        for node, (h, c) in zip(part.column(0).to_pylist(), shingles_of([split_words(t) for t in part.column(1).to_pylist()]), strict=True):
            rows.append((node, h.astype("<u8").tobytes(), None if not len(c) or c.max() == 1 else c.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["node", "shingles", "counts"])


def _linked(similar: float):
    """(a, b, shingles and counts of both) into the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        for part in slices(batches, 256):
            keep = []
            columns = [c.to_pylist() for c in part.columns]
            for i, (ha, ca, hb, cb) in enumerate(zip(*columns[2:], strict=True)):
                if probability_jaccard(*_bag(ha, ca), *_bag(hb, cb)) >= similar:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), part.column(1).take(pa.array(keep, pa.int64()))], schema=_PAIR)

    return run


def verified(pairs: DataFrame, bags: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle bags have a probability Jaccard of at least `similar`."""
    one = bags.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))
    other = bags.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
    both = pairs.distinct().hint("merge").join(one, "b").hint("merge").join(other, "a")
    return both.select("a", "b", "sa", "ca", "sb", "cb").mapInArrow(_linked(similar), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that has a link.

    Large-star and small-star steps alternate until nothing changes; every step writes its edges, so the
    lineage stays short. The number of steps grows with the logarithm of the longest chain.
    """
    edges = stage(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).unionAll(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
        new = stage(small.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).filter("u < v").distinct(), "edges")
        mark = tuple(new.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        unstage(edges)
        edges = new
        if mark == before:
            break
        before = mark
    leaves = edges.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
    return stage(leaves.unionAll(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()), "components")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (of the text), class_id (the least doc_id of its class) for every row of docs.

    Documents of equal words are in one class; others are linked from a similarity of `similar` on, and
    a class is what links connect. A document without words, or of fewer than SHINGLE words that no
    other one equals, is a class of its own. Rows without a doc_id have no class. Rows of one doc_id
    and different texts are documents of their own with the same id.
    """
    texts = texts_of(docs, doc_id, text).withColumn("key", text_key(F.col("text")))
    measured = _told_apart(stage(_measured(texts), "signatures"))
    known = measured.filter(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    classes = stage(known.groupBy("node").agg(F.min("doc_id").alias("first_id")), "classes")
    firsts = known.filter(F.col("bands").isNotNull()).join(classes.withColumnRenamed("first_id", "doc_id"), ["node", "doc_id"], "left_semi")
    # Names of bands are counted and joined without signatures; those go to the members of buckets only.
    banded = firsts.select("doc_id", "key", "node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = stage(shared.select("band", F.ceil(F.col("members") / chunk).cast("int").alias("parts")), "buckets")
    bucketed = stage(banded.join(shared, "band").select("band", "parts", "doc_id", "key", "node"), "bucketed")
    involved = stage(bucketed.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("at")).select("node", "at.*"), "involved")
    small = firsts.select("node", "doc_id", "key", "small").join(involved, ["node", "doc_id", "key"]).dropDuplicates(["node"]).select("node", "small")
    members = bucketed.join(small, "node").withColumn("sub", F.when(F.col("parts") > 1, F.pmod(F.hash("node"), F.col("parts"))))
    members = stage(members.select("band", "parts", "sub", "node", "small"), "members")
    unstage(bucketed, shared)
    # Texts of members only. Joins with texts and bags shuffle at every size, so what is measured holds for more.
    found = texts.join(involved.hint("merge"), ["doc_id", "key"]).select("node", "text")
    bags = stage(found.mapInArrow(_bags, "node long, shingles binary, counts binary").withColumn("size", F.octet_length("shingles") + F.coalesce(F.octet_length("counts"), F.lit(0))), "bags")

    stars = stage(members.select("band", "sub", "node", "small").repartition("band", "sub").sortWithinPartitions("band", "sub").mapInArrow(_stars, _STAR), "stars")
    pairs = stars.filter(F.col("b").isNotNull()).select("a", "b")
    centres = stars.filter(F.col("b").isNull())
    if centres.limit(1).count():
        ordered = centres.select("band", F.lit(None).cast("int").alias("sub"), F.col("a").alias("node"), "small").repartition("band").sortWithinPartitions("band")
        pairs = pairs.unionAll(ordered.mapInArrow(_stars, _STAR).select("a", "b"))
    links = stage(verified(pairs, bags, similar), "links")
    first = components(links)

    label = members.join(first, "node", "left").select("band", "sub", "parts", "node", F.coalesce("component", F.col("node")).alias("component"))
    label = stage(label, "labelled")
    sizes = label.groupBy("band", "component").count()
    main = sizes.groupBy("band").agg(F.max(F.struct("count", "component")).alias("most"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    main = stage(main.select("band", F.col("most.component").alias("main")), "mixed")
    mixed = label.join(main, "band")
    # Buckets are dealt by members and by bytes of their bags, whatever the length of a text.
    sizes = bags.select("node", "size").dropDuplicates(["node"]).hint("merge")
    weights = mixed.join(sizes, "node").groupBy("band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("size") / PART_BYTES)).cast("int").alias("parts"))
    dealt = F.when(F.col("parts") > 1, F.pmod(F.hash("node"), F.col("parts")))
    mixed = stage(mixed.drop("parts", "sub").join(weights, "band").withColumn("sub", dealt), "mixed-members")
    carried = bags.join(mixed.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    mixed = stage(mixed.join(carried, "node"), "mixed-bags")
    queries = mixed.filter("component <> main").withColumn("sub", F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(None).cast("int")))))
    columns = ["band", "sub", "query", "node", "component", "shingles", "counts"]
    both = mixed.withColumn("query", F.lit(False)).select(columns).unionAll(queries.withColumn("query", F.lit(True)).select(columns))
    added = stage(both.repartition("band", "sub").sortWithinPartitions("band", "sub", "query").mapInArrow(_rest(similar), "a long, b long"), "more")
    final = first
    if added.limit(1).count():
        # New links lie between components: those are joined, and the first labels follow.
        of = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
        between = added.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
        second = components(between).toDF("component", "joined")
        moved = first.join(second, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
        alone = second.join(first.select(F.col("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("joined").alias("component"))
        final = stage(moved.unionAll(alone), "components")
    unstage(members, label, bags, stars, mixed, added)

    ids = classes.join(final, "node", "left").select("node", "first_id", F.coalesce("component", F.col("node")).alias("component"))
    least = ids.groupBy("component").agg(F.min("first_id").alias("class_id"))
    ids = stage(ids.join(least, "component").select("node", "class_id"), "class-ids")
    return measured.select("doc_id", "key", "node").join(ids, "node", "left").select("doc_id", "key", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def first_of_each_class(docs: DataFrame, similar: float = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents of which the class has one with a smaller id.

    Of rows that share the class's id, the one that is the class's first text stays (rows that repeat
    it stay with it); rows without a doc_id all stay.
    """
    found = near_duplicates(docs, similar, doc_id=doc_id, text=text).filter("doc_id <> class_id").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    found = stage(found, "dropped")
    plain, name, back = shielded(docs)
    same = (F.col(name(doc_id)).cast("long") == F.col("_id")) & (text_key(F.col(name(text))) == F.col("_key"))
    return back(plain.join(found.hint("merge"), same, "left_anti"))
