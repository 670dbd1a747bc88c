"""Token ids in range-coded files, in order of doc_id, and reading them back.

A segment holds the ids of consecutive whole documents: a table of the documents and their lengths, then
blocks of the range coder (see range_coder), each reset and checksummed on its own. Segments are rows of
a Parquet table in the shared folder, so any reader of the cluster can fetch one without the others.

A segment's bytes, all little-endian: MAGIC; bytes of the head and its crc32 (32 bits each); the head,
deflated: the number of documents (32 bits), a byte for each (1: it has no id), their ids (64 bits, 0
for none), their numbers of token ids (64 bits); then the blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.llm.bpe import encoder
from deltaloom.llm.common import one_core, slices, stage, text_key, texts_of
from deltaloom.llm.range_coder import BLOCK_IDS, CorruptBlock, decode, encode

MAGIC = b"DLSEG2"
#: Documents that are tokenised at once.
TOKENIZED_ROWS = 1024
_FILES = "task int, segment int, start_in_task long, n_tokens long, data binary"


def pack_segment(doc_ids: list, ids: list[np.ndarray], end_id: int, alphabet: int) -> bytes:
    """The bytes of documents with these ids; end_id is put behind the ids of each."""
    none = np.array([d is None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    lengths = np.array([len(x) for x in ids], "<u8")
    flat = np.insert(np.concatenate(ids).astype(np.uint32), np.cumsum(lengths).astype(np.int64), end_id)
    head = zlib.compress(struct.pack("<I", len(doc_ids)) + none.tobytes() + named.tobytes() + (lengths + 1).tobytes())
    return MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + encode(flat, alphabet)


def read_segment(data: bytes) -> tuple[list, list[np.ndarray]]:
    """doc_ids and the ids of each document; raises CorruptBlock if a checksum or a length is wrong."""
    size, check = struct.unpack_from("<II", data, len(MAGIC)) if data[: len(MAGIC)] == MAGIC else (0, 1)
    begin = len(MAGIC) + 8
    head = data[begin : begin + size]
    if zlib.crc32(head) != check:
        raise CorruptBlock("the head of a segment makes no sense")
    table = zlib.decompress(head)
    n = struct.unpack_from("<I", table)[0]
    if len(table) != 4 + 17 * n:
        raise CorruptBlock("the table of a segment makes no sense")
    none, named, lengths = (np.frombuffer(table, kind, n, at) for kind, at in ((np.uint8, 4), ("<i8", 4 + n), ("<u8", 4 + 9 * n)))
    flat = decode(data[begin + size :])
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64).tolist()
    if ends[-1] != len(flat):
        raise CorruptBlock("a segment's documents don't fit its ids")
    return [None if x else d for x, d in zip(none.tolist(), named.tolist(), strict=True)], [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes whole texts (null: empty), ends each with end_id, and writes segments in ascending doc_id order.

    Returns the written table: task and segment give the order, n_tokens the ids of the segment and
    start_in_task the ids before it of the same task. Rows without a doc_id come first; rows of one doc_id
    are next to one another, ordered by a hash of their text, and dealt to several tasks if they are many.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        bpe = encoder(tokenizer)
        alphabet = max(bpe.split.vocabulary_size, end_id + 1)
        task = TaskContext.get().partitionId()  # ranges are numbered in their order
        number, start, held, size = 0, 0, ([], []), 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((task, pa.int32()), (number, pa.int32()), (start, pa.int64()), (size, pa.int64()), (pack_segment(*held, end_id, alphabet), pa.binary()))], names=["task", "segment", "start_in_task", "n_tokens", "data"])

        for part in slices(batches, TOKENIZED_ROWS):
            for d, ids in zip(part.column(0).to_pylist(), bpe.encode(part.column(1).to_pylist()), strict=True):
                if held[0] and size + len(ids) + 1 > BLOCK_IDS:
                    yield segment()
                    number, start, held, size = number + 1, start + size, ([], []), 0
                held[0].append(d), held[1].append(ids)
                size += len(ids) + 1
        if held[0]:
            yield segment()

    order = F.col("doc_id").asc_nulls_first(), text_key(F.col("text"))
    ordered = texts_of(docs, doc_id, text).repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ordered.mapInArrow(write, _FILES), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from written segments.

    The ids before a task's first segment are summed over the tasks that wrote, one row each: that table
    is as small as the number of partitions, whatever the data, and is broadcast.
    """
    totals = files.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("task", before.alias("offset"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        for part in slices(batches, 1):
            start = part.column(0).to_pylist()[0]
            doc_ids, ids = read_segment(part.column(1).to_pylist()[0])
            n = np.array([len(x) for x in ids], np.int64)
            starts = start + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((doc_ids, starts, n, [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]), schema.types, strict=True)], schema=schema)

    placed = files.join(F.broadcast(offsets), "task")
    return placed.select((F.col("offset") + F.col("start_in_task")).alias("start"), "data").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
