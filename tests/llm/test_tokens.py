"""Token counts, the BPE codec, token files and the range coder against the library itself."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaloom.llm import range_coder
from deltaloom.llm.bpe import CachedEncoder, splitter
from deltaloom.llm.bpe_codec import encode_decode
from deltaloom.llm.common import scanned
from deltaloom.llm.packing import pack
from deltaloom.llm.token_counts import token_counts
from deltaloom.llm.token_files import read_segment, read_token_files, write_token_files

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"

#: Special strings in every kind of case: only the exact ones are special.
SPECIAL = [f(x) for x in ("<|endoftext|>", "<|startoftext|>") for f in (str, str.upper, str.title, str.swapcase, lambda x: x.replace("o", "O"), lambda x: x[:-1])]


def library_ids(name, text):
    return splitter(name).library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'sdlrve .,!1½\n\t<|endofx>_ÄßñΣ ́"), st.characters()), max_size=60))
@pytest.mark.parametrize("name", [WORD, BYTE])
def test_parts_encode_like_the_whole(name, text):
    text = text.encode("utf-8", "ignore").decode()
    split = splitter(name)
    pieces = split.pieces(text)
    ids, ends = split.ids_of(pieces)
    assert ids.tolist() == library_ids(name, text) and len(ends) == len(pieces)
    assert CachedEncoder(name).encode([text, None, ""])[0].tolist() == library_ids(name, text)


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_special_strings_in_any_case(name):
    split = splitter(name)
    for x in SPECIAL:
        for text in (x, f"a {x} b", f"a{x}b", f"{x}{x}", f"É{x} 漢"):
            want = library_ids(name, text)
            assert split.ids_of(split.pieces(text))[0].tolist() == want
            assert CachedEncoder(name).encode([text])[0].tolist() == want


def test_full_cache_still_encodes():
    enc = CachedEncoder(WORD, bound=3)
    texts = ["one two three four", "five six one", "seven two"]
    for t in texts * 2:
        assert enc.encode([t])[0].tolist() == library_ids(WORD, t)


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_token_counts(odd_docs, odd_rows, head):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd_docs, WORD, 2048, head).collect())
    n = lambda t: len(library_ids(WORD, t))
    assert got == sorted((d or 0, len((t or "").encode()), n(t), n(t) > 2048) for d, t, *_ in odd_rows)
    assert any(x[3] for x in got)


@pytest.mark.parametrize("head", [0, 4, 1000])
def test_codec(odd_docs, odd_rows, head):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_decode(odd_docs, BYTE, head).collect())
    want = []
    for d, t, *_ in odd_rows:
        ids = library_ids(BYTE, t)
        text = splitter(BYTE).library.decode(ids, skip_special_tokens=False)
        want.append((d or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_token_files(odd_docs, odd_rows):
    files = write_token_files(odd_docs, WORD, 1)
    got = read_token_files(files).collect()
    assert [r.start for r in sorted(got, key=lambda r: r.start)] == np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist()
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    crc = lambda t: zlib.crc32(np.array([*library_ids(WORD, t), 1], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((d, crc(t)) for d, t, *_ in odd_rows)
    data = bytearray(files.first().data)
    data[-3] ^= 1
    with pytest.raises(range_coder.CorruptBlock):
        read_segment(bytes(data))


def test_special_strings_through_all_operators(spark):
    rows = [(i, f"x {s} y{s}") for i, s in enumerate(SPECIAL)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: [*library_ids(WORD, t)] for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, WORD, 9).collect()} == {i: len(x) for i, x in want.items()}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert {r.doc_id: r.ids_crc32 for r in read_token_files(write_token_files(docs, WORD, 1)).collect()} == {i: crc([*x, 1]) for i, x in want.items()}
    assert {r.doc_id: r.ids_crc32 for r in pack(docs, WORD).collect()} == {i: crc([*x, 0]) for i, x in want.items()}


def test_rows_of_one_id_go_to_several_tasks(spark):
    rows = [(None, f"text number {i}") for i in range(300)] + [(5, f"t{i}") for i in range(300)] + [(9, "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = write_token_files(docs, WORD, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.select("task").distinct().count() > 2
    got = sorted(read_token_files(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + [5] * 300 + [9]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


@pytest.mark.parametrize("head", [0, 5, 1000])
def test_long_words_are_joined_by_digests(spark, head):
    long = ["x" * 41, "=" * 3000, "漢" * 500, "Y" * 41, "=" * 2999]
    rows = [(i, " ".join(long[: 1 + i % 5])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, WORD, 9, head).collect()} == {i: len(library_ids(WORD, t)) for i, t in rows}
    sha = lambda t: hashlib.sha256(np.array(library_ids(BYTE, t), "<u4").tobytes()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in encode_decode(docs, BYTE, head).collect()} == {i: sha(t) for i, t in rows}


def test_tables_that_are_read_twice_have_one_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t {i}") for i in range(50)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d")).filter("doc_id > 3").select("text", "doc_id")
    assert scanned(read) is read
    moved = scanned(read.repartition(7))
    assert moved._staged_at and moved.count() == 46


def test_coder_refuses_alphabets_beyond_its_bound():
    with pytest.raises(ValueError):
        range_coder.encode_block(np.array([1]), range_coder.MAX_ALPHABET + 1)
    assert (range_coder.MAX_ALPHABET + range_coder._GAIN * range_coder.BLOCK_IDS) * (1 + 2 * range_coder._MOST_ODDS) <= 1 << 32


def test_empty_tables(no_docs):
    assert token_counts(no_docs, WORD, 10).count() == encode_decode(no_docs, BYTE).count() == read_token_files(write_token_files(no_docs, WORD, 1)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 999), min_size=1, max_size=700), st.integers(1000, 50_000))
def test_range_coder_round_trip(ids, alphabet):
    ids = np.array(ids)
    assert (range_coder.decode(range_coder.encode(ids, alphabet)) == ids).all()


def test_range_coder_blocks_and_gain():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 40_000, 300)
    ids = np.tile(base, range_coder.BLOCK_IDS // 300 + 20)[: range_coder.BLOCK_IDS + 5000]
    data = range_coder.encode(ids, 49_408)
    assert (range_coder.decode(data) == ids).all()
    assert len(data) < len(ids) / 2  # contexts of order 1 and 2 predict the repetition
    second = range_coder.decode_block(data, range_coder.decode_block(data)[1])[0]
    assert (second == ids[range_coder.BLOCK_IDS :]).all()  # blocks stand alone
