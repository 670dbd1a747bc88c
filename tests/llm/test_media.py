import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from deltaloom.llm import media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 196_416, 300_000])
def test_payloads_survive(n):
    data = random.Random(n).randbytes(n)
    payload = media.payload_of(data)
    (file,) = media.store([payload])
    images = media.read_thumbnails([file])[0]
    assert payload.size % 576 == 0 and payload.size >= 576 and (np.concatenate(images) == payload).all()
    assert file[:2] == b"\xff\xd8" and file[-2:] == b"\xff\xd9"


def test_batches_of_different_sizes():
    rng = random.Random(1)
    payloads = [media.payload_of(rng.randbytes(rng.randrange(4000))) for _ in range(300)]
    files = media.store(payloads)
    assert all((np.concatenate(x) == p).all() for x, p in zip(media.read_thumbnails(files), payloads, strict=True))


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value, f"0{n}b") if n else ""

    def data(self):
        self.text += "1" * (-len(self.text) % 8)
        return bytes(int(self.text[i : i + 8], 2) for i in range(0, len(self.text), 8)).replace(b"\xff", b"\xff\x00")


def colour_jpeg(luma, interval=0):
    """A 2x2-subsampled colour image with some AC terms: luma has DC terms of 8x8 blocks, rows and columns even."""
    dc = media._canonical(dict(enumerate([3, 3, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8])))
    ac = media._canonical({0x00: 2, 0x01: 2, 0xF0: 3, 0x22: 4, 0x13: 5})
    rows, columns = luma.shape
    parts, bits, last, count = [], Bits(), [0, 0, 0], 0
    rng = random.Random(7)

    def block(c, value):
        d = value - last[c]
        last[c] = value
        size = abs(d).bit_length()
        bits.put(*dc[size])
        bits.put(d if d >= 0 else d + (1 << size) - 1, size)
        for symbol in rng.choices([0x01, 0x22, 0x13, 0xF0], k=rng.randrange(3)):
            bits.put(*ac[symbol])
            bits.put(rng.randrange(1 << (symbol & 15)) if symbol & 15 else 0, symbol & 15)
        bits.put(*ac[0x00])

    for y in range(0, rows, 2):
        for x in range(0, columns, 2):
            if interval and count and count % interval == 0:
                parts.append(bits.data() + bytes([0xFF, 0xD0 + (count // interval - 1) % 8]))
                bits, last = Bits(), [0, 0, 0]
            for by in (0, 1):
                for bx in (0, 1):
                    block(0, int(luma[y + by, x + bx]))
            block(1, 3)
            block(2, -5)
            count += 1
    seg = media._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xDB, bytes([0, 16] + [1] * 63)) + seg(0xDB, bytes([1] + [9] * 64))
    head += seg(0xC0, struct.pack(">BHHB", 8, rows * 8 - 3, columns * 8, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    table = lambda kind, codes: media._dht(kind, {s: n for s, (_, n) in codes.items()})
    head += table(0, dc) + table(0x10, ac) + table(1, dc) + table(0x11, ac) + (seg(0xDD, struct.pack(">H", interval)) if interval else b"")
    return head + seg(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + b"".join(parts) + bits.data() + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_subsampled_colour_with_ac_terms(interval):
    luma = np.random.default_rng(2).integers(-60, 60, (6, 8))
    (image,), = media.read_thumbnails([colour_jpeg(luma, interval)])
    assert (image == np.clip(luma * 16 // 8 + 128, 0, 255)).all()


def test_what_is_not_a_baseline_image():
    good = media.store([media.payload_of(b"abc" * 500)])[0]
    for bad in (b"", b"GIF89a", good[:40], good[:-2], good.replace(b"\xff\xc0", b"\xff\xc2", 1), good[: len(good) // 2] + b"\xff\xd9"):
        with pytest.raises(media.JpegError):
            media.luminance([media.parse(bad)[0]])


def test_columns(spark, odd_docs, odd_rows, no_docs):
    rows = media.media_columns(odd_docs, ["doc_id"]).collect()
    want = Counter()
    for d, t, *_ in odd_rows:
        data = (t or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        want[d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert all(r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() for r in rows)
    assert len({r.feature for r in rows if r.doc_id == 1}) == 1
    assert media.media_columns(no_docs, ["doc_id"]).count() == 0


def test_thumbnails_of_stored_files(spark):
    luma = np.random.default_rng(3).integers(-60, 60, (4, 4))
    files = spark.createDataFrame([(1, bytearray(colour_jpeg(luma))), (2, None), (3, bytearray(b"nonsense"))], "id int, body binary")
    rows = {r.id: r for r in media.thumbnails(files, "body", ["id"]).collect()}
    assert (rows[1].width, rows[1].height, rows[1].error) == (32, 29, None) and len(rows[1].thumbnail) == 16 and len(rows[1].thumbnail_hash) == 16
    assert rows[2].error and rows[3].error and rows[2].width is None


def test_kept_columns_may_not_have_a_result_s_name(spark):
    files = spark.createDataFrame([(1, b"", 3)], "id int, body binary, width int")
    with pytest.raises(ValueError, match="width"):
        media.thumbnails(files, "body", ["id", "width"])
    with pytest.raises(ValueError, match="feature"):
        media.media_columns(spark.createDataFrame([("a", 1)], "text string, feature int"), ["feature"])
