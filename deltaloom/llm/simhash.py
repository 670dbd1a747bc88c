"""SimHash classes: fingerprints of word shingles, linked through a Gray-order hierarchical index.

Fingerprints of WIDTH bits that differ in at most DISTANCE of them agree wholly in one of DISTANCE + 1
blocks of bits. So the index has one root for each block: fingerprints are rotated until the block
leads, and nodes of the first level are the values of the block. In Gray order (by the rank of a
rotated fingerprint in the reflected binary code) the members of a node are neighbours, as ranks and codes
share prefixes, and so are codes that differ in few bits.

Below, a node holds what all its members share, as a mask and a pattern; a child holds only the bits that
its own members share beyond those of its parent. A search goes down with all fingerprints at once,
adds the differences from each node's own bits to those of its path, and leaves out the whole group
of a node once the sum is over DISTANCE. At a leaf the sum is the exact distance.

A node of the first level is one group of a shuffle. Where it has over `chunk` members, its children by
the next STEP bits are groups of their own, again and again: a fingerprint is a member of its own child and
visits those that lie within what is left of the DISTANCE. So no task holds more than `chunk` members, however
many fingerprints agree in a block, and nothing is left out. Tasks return a star for each of the components
that they find, not the pairs, and components of all tasks are joined at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import one_core, slices, stage, texts_of, unstage
from deltaloom.llm.minhash import components

SHINGLE, SEED, WIDTH, DISTANCE = 3, 42, 64, 2
#: Leading bit and length of each block; any two fingerprints within DISTANCE agree in one of them.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Members of a group that a task holds; bits by which a larger group is split; children of a node inside a task.
CHUNK, STEP, FAN = 16_384, 8, 8
#: Fingerprints that go down the index together, rows that a task gathers, shingles hashed at once.
QUERIES, GATHERED, HASHED = 1024, 65_536, 65_536

_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """The SimHash of a whole text as 8 bytes, the highest bit first: A-Z in lower case, words between ASCII
    white space, every shingle with its repeats (all words where they are fewer); 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(WIDTH // 8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        begins, ends = begins[: 1 - shingle], ends[shingle - 1 :]
    else:
        begins, ends = begins[:1], ends[-1:]
    counts, digest = np.zeros(WIDTH, np.int64), xxhash.xxh64_digest
    for at in range(0, len(begins), HASHED):
        pairs = zip(begins[at : at + HASHED].tolist(), ends[at : at + HASHED].tolist(), strict=True)
        digests = np.frombuffer(b"".join([digest(joined[x:y], seed) for x, y in pairs]), np.uint8).reshape(-1, WIDTH // 8)
        # Bits are counted in bytes, 255 rows at a time.
        for part in range(0, len(digests), 255):
            counts += np.unpackbits(digests[part : part + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(begins)).tobytes()


def fingerprints(texts: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint of each text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        for part in slices(batches):
            made = np.frombuffer(b"".join(map(fingerprint, part.column(1).to_pylist())), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made)], names=["doc_id", "fp"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(code: Column) -> Column:
    """The rank of a code in Gray order, as a number whose signed order is that of ranks."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << (WIDTH - 1))))


class GrayIndex:
    """Groups of fingerprints, each in Gray order, under nodes with the bits that all their members share.

    codes: unsigned, group by group. sizes: members of each group. Level 0 has the codes themselves,
    the last level one node a group.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, fan: int = FAN):
        self.codes, self.levels = codes, []
        everything = np.full(len(codes), ~np.uint64(0))
        ones, any_ = codes, codes
        self.levels.append((everything, codes, np.arange(1, len(codes) + 1), None))
        while True:
            group_at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            own = np.arange(int(sizes.sum())) - np.repeat(group_at, sizes)
            heads = np.flatnonzero(own % fan == 0)
            ones, any_ = np.bitwise_and.reduceat(ones, heads), np.bitwise_or.reduceat(any_, heads)
            mask = ~(ones ^ any_)
            last = np.concatenate([heads[1:], [len(own)]])
            self.levels.append((mask, ones & mask, self.levels[-1][2][last - 1], (heads, last)))
            sizes = -(-sizes // fan)
            if sizes.max(initial=0) <= 1:
                break

    def search(self, codes: np.ndarray, group: np.ndarray, after: np.ndarray | None = None, most: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of all that differ in at most `most` bits, where query i looks at group[i] only, and
        only at members beyond place after[i]."""
        mask, pattern, end, _ = self.levels[-1]
        query, node = np.arange(len(codes)), group
        gone = np.bitwise_count((codes ^ pattern[node]) & mask[node])
        for level in range(len(self.levels) - 1, -1, -1):
            keep = gone <= most
            if after is not None:
                keep &= self.levels[level][2][node] > after[query] + 1
            query, node, gone = query[keep], node[keep], gone[keep]
            if not level or not len(query):
                break
            heads, last = self.levels[level][3]
            above = self.levels[level][0][node]
            n = last[node] - heads[node]
            first = np.repeat(heads[node] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            query, gone, above, node = np.repeat(query, n), np.repeat(gone, n), np.repeat(above, n), first + np.arange(int(n.sum()))
            mask, pattern, _, _ = self.levels[level - 1]
            gone = gone + np.bitwise_count((codes[query] ^ pattern[node]) & mask[node] & ~above)
        return query, node


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Connect places a with b: labels are the least place of each component, before and after."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def linked(codes: np.ndarray, group: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the components of members, and of visitors with the members near them, in places of codes.

    Rows are sorted by group, members (own) before visitors, members in Gray order.
    """
    members = np.flatnonzero(own)
    if not len(members):
        return members, members
    names, sizes = np.unique(group[members], return_counts=True)
    index, labels = GrayIndex(codes[members], sizes), np.arange(len(members))
    of = np.searchsorted(names, group)
    for at in range(0, len(members), QUERIES):
        some = np.arange(at, min(at + QUERIES, len(members)))
        q, m = index.search(codes[members[some]], of[members[some]], after=some)
        join_labels(labels, some[q], m)
    far = np.flatnonzero(labels != np.arange(len(members)))
    a, b = [members[labels[far]]], [members[far]]
    visitors = np.flatnonzero(~own & np.isin(group, names))
    for at in range(0, len(visitors), QUERIES):
        some = visitors[at : at + QUERIES]
        q, m = index.search(codes[some], of[some])
        pairs = np.unique(np.stack([labels[m], some[q]]), axis=1)
        a.append(members[pairs[0]]), b.append(pairs[1])
    return np.concatenate(a), np.concatenate(b)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, node, own, fp), sorted, into links; whole groups together, visitors of a large one in parts."""
    one_core()
    held = None

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        block, node, own, fp = rows
        group = np.concatenate([[0], np.cumsum((block[1:] != block[:-1]) | (node[1:] != node[:-1]))])
        a, b = linked(fp.view(np.uint64), group, own)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], schema=_FOUND)

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if len(held[0]) < GATHERED:
            continue
        block, node, own, _ = held
        open_ = (block == block[-1]) & (node == node[-1])
        whole = ~open_
        if whole.any():
            yield found([x[whole] for x in held])
            held = [x[open_] for x in held]
        elif not own[-1]:  # one group only: its members stay for the visitors to come
            yield found(held)
            held = [x[own] for x in held]
    if held is not None and len(held[0]):
        yield found(held)


def _rotated(fp: Column, begin: int) -> Column:
    return fp if not begin else F.shiftleft(fp, begin).bitwiseOR(F.shiftrightunsigned(fp, WIDTH - begin))


def links(codes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """a, b: links that connect the distinct fingerprints (column fp) as all pairs within DISTANCE would."""
    parts, before = [], []
    for k, (begin, length) in enumerate(BLOCKS):
        code = _rotated(F.col("fp"), begin)
        parts.append(codes.select(F.lit(k).alias("block"), "fp", code.alias("code"), F.shiftrightunsigned(code, WIDTH - length).alias("node")))
    visits = parts[0].unionAll(parts[1]).unionAll(parts[2]).withColumns({"own": F.lit(True), "gone": F.lit(0)})
    depth, ready = 0, []
    deltas = [(d, d.bit_count()) for d in range(1 << STEP) if d.bit_count() <= DISTANCE]
    # Nodes of different depths have names of their own: a level below, `block` is larger by their number.
    length = F.element_at(F.array(*(F.lit(n) for _, n in BLOCKS)), F.col("block") % len(BLOCKS) + 1)
    while True:
        large = visits.filter("own").groupBy("block", "node").count().filter(F.col("count") > chunk).select("block", "node")
        large = stage(large, "large")
        before.append(large)
        if depth + max(n for _, n in BLOCKS) + STEP > WIDTH or large.isEmpty():
            ready.append(visits)
            break
        ready.append(visits.join(large, ["block", "node"], "left_anti"))
        here = visits.join(large, ["block", "node"])
        part = F.call_function("shiftrightunsigned", F.col("code"), F.lit(WIDTH - STEP - depth) - length).bitwiseAND(F.lit((1 << STEP) - 1))
        near = F.explode(F.array(*(F.struct(F.lit(d).cast("long").alias("delta"), F.lit(n).alias("n")) for d, n in deltas))).alias("step")
        went = here.select("block", "node", "fp", "code", "own", "gone", part.alias("part"), near).filter(F.col("gone") + F.col("step.n") <= DISTANCE)
        # Of two members of one node, the one with the smaller part visits the other's child.
        went = went.filter((F.col("step.delta") == 0) | ~F.col("own") | (F.col("part") < F.col("part").bitwiseXOR(F.col("step.delta"))))
        child = F.shiftleft("node", STEP).bitwiseOR(F.col("part").bitwiseXOR(F.col("step.delta")))
        went = went.select((F.col("block") + len(BLOCKS)).alias("block"), "fp", "code", child.alias("node"), (F.col("own") & (F.col("step.delta") == 0)).alias("own"), (F.col("gone") + F.col("step.n")).alias("gone"))
        there = went.filter("own").select("block", "node").distinct()
        visits = stage(went.join(there, ["block", "node"], "left_semi"), "visits")
        before.append(visits)
        depth += STEP
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    out = out.repartition("block", "node").sortWithinPartitions("block", "node", F.desc("own"), gray_rank(F.col("code")))
    found = stage(out.select("block", "node", "own", "fp").mapInArrow(_links, "a long, b long"), "links")
    unstage(*before)
    return found


def simhash_components(docs: DataFrame, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row of docs.

    Rows are connected whose fingerprints differ in at most DISTANCE bits; component_id is the least doc_id
    that links lead to, its own included. A null or empty text has the fingerprint 0, which is linked like any
    other. Repeated rows come out as often as they came in; rows of one doc_id and different texts have
    fingerprints of their own. Rows without a doc_id take part in links, but give no component its id
    (null where no row of the component has one). Other columns are ignored. An empty table gives an
    empty result.
    """
    known = stage(fingerprints(texts_of(docs, doc_id, text)), "fingerprints")
    codes = stage(known.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "codes")
    found = links(codes.select("fp"), chunk)
    joined = codes.join(components(found), F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = stage(joined.join(least, "component").select("fp", "component_id"), "component-ids")
    unstage(found, codes)
    return known.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
