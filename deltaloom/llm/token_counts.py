"""Token counts without ids: pieces per distinct pre-token, joined to frequencies per document.

Plan: one pass collects the distinct pre-tokens with their document frequency (summed per task before
the shuffle); each is encoded once. A second pass counts pre-tokens per document. The most frequent
ones, at most `head` rows and HEAD_BYTES bytes, are joined map-side from a broadcast of that bounded
size; the rest of the frequencies go through a shuffle join. Pre-tokens of over NAME_CHARS characters go
by a 128-bit digest in both, so long ones (rulers, encoded data, scripts without spaces) are in the head
like any other: no key of the shuffle join has more than about one in `head` of all frequencies.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.bpe import splitter
from deltaloom.llm.common import drop_shuffles, listed, one_core, slices, stage, text_key, texts_of

#: Pre-tokens in the broadcast head, and bytes of their names and values; characters beyond which a pre-token goes by its digest.
HEAD_ROWS, HEAD_BYTES, NAME_CHARS = 131_072, 8 << 20, 40
#: Distinct pre-tokens that a task holds before it passes its partial counts on.
TASK_DISTINCT = 200_000

_PARTIAL = pa.schema([("piece", pa.string()), ("df", pa.int64())])


def name_of(piece: str) -> str:
    """What a pre-token is joined by: itself, or a digest that no pre-token equals, as it holds white space and more."""
    return piece if len(piece) <= NAME_CHARS else "\n\x00" + xxhash.xxh3_128_hexdigest(piece.encode())


def named(pieces: list[str]) -> list[str]:
    """The names of pre-tokens; long ones are rare, so most lists stay as they are."""
    return pieces if not pieces or max(map(len, pieces)) <= NAME_CHARS else list(map(name_of, pieces))


def distinct_pieces(texts: DataFrame, tokenizer: str) -> DataFrame:
    """piece, df: every distinct pre-token of the texts and the number of rows that have it."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        split, seen = splitter(tokenizer), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], schema=_PARTIAL)
            seen.clear()
            return out

        for part in slices(batches):
            for text in part.column(0).to_pylist():
                if text:
                    seen.update(set(split.pieces(text)))
            if len(seen) > TASK_DISTINCT:
                yield flush()
        if seen:
            yield flush()

    return texts.select("text").mapInArrow(partial, "piece string, df long").groupBy("piece").agg(F.sum("df").alias("df"))


def encoded_pieces(pieces: DataFrame, tokenizer: str, ids: bool) -> DataFrame:
    """name, df, n (tokens of the piece) and, if asked, ids (binary, little-endian, of the splitter's id type)."""
    schema = pa.schema([("name", pa.string()), ("df", pa.int64()), ("n", pa.int64())] + ([("ids", pa.binary())] if ids else []))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        split = splitter(tokenizer)
        for part in slices(batches, 8192):
            own = listed(part.column(0))
            flat, ends = split.ids_of(own)
            begins = np.concatenate([[0], ends[:-1]])
            columns = [pa.array(map(name_of, own), pa.string()), part.column(1), pa.array(ends - begins, pa.int64())]
            if ids:
                data, width = flat.astype(split.id_type).tobytes(), np.dtype(split.id_type).itemsize
                columns.append(pa.array([data[x:y] for x, y in zip((begins * width).tolist(), (ends * width).tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return pieces.mapInArrow(encode, "name string, df long, n long" + (", ids binary" if ids else ""))


def head_of(table: DataFrame, column: str, rows: int = HEAD_ROWS, most_bytes: int = HEAD_BYTES, value_bytes: Column | int = 8) -> dict:
    """The most frequent names with one of their columns: at most `rows` entries and `most_bytes` bytes.

    Counts by the logarithm of df (some hundred rows) give the least frequency from which on they are
    few enough; no task sorts or gathers the whole table.
    """
    level = F.floor(F.log2("df") * 16)
    sized = F.sum(F.octet_length("name") + value_bytes).alias("bytes")
    least, taken, size = None, 0, 0
    for r in sorted(table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), sized).collect(), key=lambda r: -r["level"]):
        taken, size = taken + r["n"], size + r["bytes"]
        if taken > rows or size > most_bytes:
            break
        least = r["level"]
    if least is None:
        return {}
    top = table.filter(level >= least).select("name", column).toArrow()
    return dict(zip(listed(top.column(0).combine_chunks()), listed(top.column(1).combine_chunks()), strict=True))


def token_counts(docs: DataFrame, tokenizer: str, limit: int, head: int = HEAD_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows come out as often as they came in;
    rows of one doc_id with different texts are counted apart; other columns are ignored. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, doc_id, text)
    table = stage(encoded_pieces(distinct_pieces(texts, tokenizer), tokenizer, ids=False), "pieces")
    shared = spark.sparkContext.broadcast(head_of(table, "n", head))
    drop_shuffles(spark)
    schema = pa.schema([("name", pa.string()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("n_bytes", pa.int64())])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        split, known = splitter(tokenizer), shared.value
        for part in slices(batches):
            name, doc, key, n, n_bytes = [], [], [], [], []
            for d, t, k in zip(*(c.to_pylist() for c in part.columns), strict=True):
                total, counts = 0, Counter(named(split.pieces(t))) if t else {}
                for p, c in counts.items():
                    own = known.get(p)
                    if own is None:
                        name.append(p), doc.append(d), key.append(k), n.append(c), n_bytes.append(None)
                    else:
                        total += c * own
                name.append(f"\n{d} {k}"), doc.append(d), key.append(k), n.append(total), n_bytes.append(len(t.encode()) if t else 0)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((name, doc, key, n, n_bytes), schema, strict=True)], schema=schema)

    # A row with n_bytes is a document with its head's tokens; its name, which no pre-token equals, spreads it.
    rows = texts.withColumn("key", text_key(F.col("text"))).mapInArrow(frequencies, "name string, doc_id long, key long, n long, n_bytes long")
    joined = rows.join(table.select("name", F.col("n").alias("pieces")), "name", "left")
    own = F.col("n_bytes").isNotNull()
    summed = joined.groupBy("doc_id", "key").agg(
        F.sum(F.when(own, F.col("n")).otherwise(F.col("n") * F.col("pieces"))).alias("total"), F.max("n_bytes").alias("n_bytes"), F.sum(own.cast("long")).alias("copies")
    )
    n_tokens = F.expr("total div copies")
    return summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
