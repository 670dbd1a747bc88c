"""Byte-level BPE over a distinct-word table, and decoding through an id-to-piece table.

Plan: the distinct pre-tokens are encoded once (see token_counts). Each slice of SLICE_ROWS documents
becomes a skeleton that holds its words in order, as ranks in the broadcast head of bounded size; words
outside of the head leave a gap, and go with their positions through a shuffle join with the table of
distinct words. Skeletons and joined words meet again by slice, where ids are put in place by position.
A skeleton is about a third of its texts, so less is moved than by texts or ids. Both passes have to
cut the same slices, whichever task runs again: a table that isn't read straight from files is written
first (see common.scanned).

Decoding joins ids with the table of ids and pieces, which has a row for each id of the vocabulary and
is held by each task: a join without a shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.bpe import BYTE_CHARS, splitter
from deltaloom.llm.common import drop_shuffles, listed, one_core, scanned, sha256_hex, slices, stage, text_key, texts_of
from deltaloom.llm.token_counts import distinct_pieces, encoded_pieces, head_of, name_of

#: Words in the broadcast head, and bytes of their names and ids.
HEAD_ROWS, HEAD_BYTES = 640_000, 24 << 20
_GAP = 0xFFFFFF


def _slice_key(doc_ids: list, keys: list) -> int:
    """A 64-bit name of a slice of rows, the same in both passes; equal slices are alike, so they may share it."""
    return xxhash.xxh3_64_intdigest(repr((doc_ids, keys)).encode()) - (1 << 63)


def _ranked(split, ranks: dict[str, int], texts: list[str | None]) -> tuple[list[int], np.ndarray, list[int], list[str]]:
    """Words of each text, the ranks of all words in order, and the places and names of those without a rank."""
    found = [split.pieces(t) if t else [] for t in texts]
    flat = list(chain.from_iterable(found))
    own = np.array(list(map(ranks.get, flat, repeat(_GAP))), np.uint32)
    places, names = [], []
    for i in np.flatnonzero(own == _GAP).tolist():
        # Long words have their names by digest, so they are looked up once more.
        name = name_of(flat[i])
        own[i] = ranks.get(name, _GAP)
        if own[i] == _GAP:
            places.append(i), names.append(name)
    return list(map(len, found)), own, places, names


def _tail_rows(tokenizer: str, shared):
    """(name, slice, positions) of the words outside of the head; positions count through the slice's words."""
    schema = pa.schema([("name", pa.string()), ("slice", pa.int64()), ("positions", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        split, ranks = splitter(tokenizer), shared.value[0]
        for part in slices(batches):
            docs, texts, keys = (c.to_pylist() for c in part.columns)
            gaps: dict[str, list[int]] = {}
            _, _, places, names = _ranked(split, ranks, texts)
            for i, name in zip(places, names, strict=True):
                gaps.setdefault(name, []).append(i)
            packed = [struct.pack(f"<{len(where)}I", *where) for where in gaps.values()]
            yield pa.RecordBatch.from_arrays([pa.array(gaps.keys(), pa.string()), pa.array([_slice_key(docs, keys)] * len(gaps), pa.int64()), pa.array(packed, pa.binary())], schema=schema)

    return run


def _skeletons(tokenizer: str, shared):
    """(slice, positions null, body): the documents' ids and lengths in words, and ranks of 3 bytes, packed."""
    schema = pa.schema([("slice", pa.int64()), ("positions", pa.binary()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        split, ranks, pack = splitter(tokenizer), shared.value[0], zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            docs, texts, keys = (c.to_pylist() for c in part.columns)
            sizes, r, _, _ = _ranked(split, ranks, texts)
            none, ids, lengths = np.array([d is None for d in docs], np.uint8), np.array([d or 0 for d in docs], "<i8"), np.array(sizes, "<u8")
            # Planes of equal bytes compress better than interleaved ones.
            planes = np.concatenate([r & 255, r >> 8 & 255, r >> 16]).astype(np.uint8)
            body = pack.compress(len(docs).to_bytes(8, "little") + none.tobytes() + ids.tobytes() + lengths.tobytes() + planes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([_slice_key(docs, keys)], pa.int64()), pa.nulls(1, pa.binary()), pa.array([body], pa.binary())], schema=schema)

    return run


class Decoder:
    """Joins ids with the table of ids and pieces, many at once."""

    def __init__(self, tokenizer: str):
        table = id_to_piece(tokenizer)
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.array([len(x) for x in table], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's end."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.begins[ids] - (ends - n), n)
        at += np.arange(len(at))
        return self.bytes[at], ends


def _assembled(tokenizer: str, shared, schema: pa.Schema):
    """Slices of one task, each with its joined words before its skeleton, into ids and digests.

    A word that a skeleton lacks is an error, so a lost row can't pass unseen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        heads = shared.value[1]
        decoder, kind, unpack = Decoder(tokenizer), np.dtype(splitter(tokenizer).id_type), zstandard.ZstdDecompressor()
        now, gaps = None, {}
        for part in slices(batches, 4096):
            for key, at, body in zip(*map(listed, part.columns), strict=True):
                if key != now:
                    now, gaps = key, {}
                if at is not None:
                    if len(at) == 4:
                        gaps[int.from_bytes(at, "little")] = body
                    else:
                        gaps.update(dict.fromkeys(np.frombuffer(at, "<u4").tolist(), body))
                    continue
                raw = unpack.decompress(body)
                n = int.from_bytes(raw[:8], "little")
                none, docs, sizes = (np.frombuffer(raw, t, n, 8 + k * n) for t, k in ((np.uint8, 0), ("<i8", 1), ("<u8", 9)))
                low, mid, high = np.frombuffer(raw, np.uint8, offset=8 + 17 * n).astype(np.uint32).reshape(3, -1)
                ranks = low | mid << 8 | high << 16
                open_ = np.flatnonzero(ranks == _GAP)
                ranks[open_] = len(heads) - 1  # nothing, until the joined word takes its place
                words = list(map(heads.__getitem__, ranks.tolist()))
                for i in open_.tolist():
                    words[i] = gaps[i]
                ids = np.frombuffer(b"".join(words), kind)
                ends = np.concatenate([[0], np.cumsum(np.array(list(map(len, words)), np.int64) // kind.itemsize)])
                stops = ends[np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])]
                text, text_ends = decoder.decode(ids)
                text_stops = np.concatenate([[0], text_ends])[stops].tolist()
                wide, stops = ids.astype("<u4"), stops.tolist()
                ids_sha = [sha256_hex(wide[a:b].tobytes()) for a, b in pairwise(stops)]
                text_sha = [sha256_hex(text[a:b].tobytes().decode("utf-8", "replace").encode()) for a, b in pairwise(text_stops)]
                rows = [None if x else d for x, d in zip(none.tolist(), docs.tolist(), strict=True)], [b - a for a, b in pairwise(stops)], ids_sha, text_sha
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def id_to_piece(tokenizer: str) -> list[bytes]:
    """The bytes of every id: the vocabulary's table, of fixed size."""
    library = splitter(tokenizer).library
    to_byte = {c: b for b, c in enumerate(BYTE_CHARS)}
    out = [b""] * splitter(tokenizer).vocabulary_size
    for token, i in library.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(map(to_byte.__getitem__, token)) if all(c in to_byte for c in token) else token.encode()
    return out


def encode_decode(docs: DataFrame, tokenizer: str, head: int = HEAD_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs.

    A null text counts as empty: no ids, and the digests of no bytes. Repeated rows come out as often
    as they came in; rows of one doc_id with different texts are encoded apart; other columns are
    ignored. An empty table gives an empty result. The digests are of ids as 32-bit numbers, whatever
    the vocabulary's size.
    """
    spark = docs.sparkSession
    texts = scanned(texts_of(docs, doc_id, text)).withColumn("key", text_key(F.col("text")))
    table = stage(encoded_pieces(distinct_pieces(texts, tokenizer), tokenizer, ids=True), "words")
    top = head_of(table, "ids", head, HEAD_BYTES, F.octet_length("ids"))
    # Ranks by name, and ids by rank; after them nothing, for words that are joined.
    shared = spark.sparkContext.broadcast(({p: i for i, p in enumerate(top)}, [*top.values(), b""]))
    drop_shuffles(spark)
    tail = texts.mapInArrow(_tail_rows(tokenizer, shared), "name string, slice long, positions binary")
    placed = tail.join(table.select("name", F.col("ids").alias("body")), "name").select("slice", "positions", "body")
    bodies = texts.mapInArrow(_skeletons(tokenizer, shared), "slice long, positions binary, body binary")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    met = placed.unionAll(bodies).repartition("slice").sortWithinPartitions("slice", F.col("positions").isNull())
    return met.mapInArrow(_assembled(tokenizer, shared, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
