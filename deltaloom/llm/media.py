"""Media columns: baseline JPEG in numpy.

Reading: markers are parsed, scans are Huffman-decoded, and the DC terms of the luminance blocks give a
thumbnail of an eighth of the size; AC terms are only skipped. All restart intervals of a batch of
images are decoded in lockstep, one lane each, so the work per block is vectorised.

Writing: a thumbnail becomes a grayscale image whose 8x8 blocks are flat. With a DC quantiser of 8 the
stored term of a block of the value v is exactly v - 128, so the thumbnail that is read back is
bit-equal to what was written: bytes can be stored as samples without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import annotate

#: Blocks in a row of an image that holds bytes, and block rows in one image: 8 * 8184 lines are within the format's 65535.
COLUMNS, MAX_ROWS = 24, 8184
#: Bytes of samples that are coded at a time.
GROUP_BYTES = 1 << 20
# Code lengths of the DC categories 0 to 8; short codes for the steps between letters.
_DC_LENGTHS = (4, 4, 4, 3, 3, 3, 3, 2, 5)


class JpegError(ValueError):
    pass


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), by length and then by symbol, as the format assigns them."""
    code, last, out = 0, 0, {}
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], last, code = (code, n), n, code + 1
    return out


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths.items(), key=lambda x: (x[1], x[0]))
    body = bytes([kind, *(sum(n == i for _, n in order) for i in range(1, 17)), *(s for s, _ in order)])
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def _header(rows: int, columns: int) -> bytes:
    dc = dict(enumerate(_DC_LENGTHS))
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0] + [8] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + bytes([1, 0x11, 0]))
        + _dht(0x00, dc)
        + _dht(0x10, {0: 1})
        + _segment(0xDD, struct.pack(">H", columns))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """For a difference d, at d + 255: the bits of its DC code, its extra bits and the end of block, and their number."""
    codes = _canonical(dict(enumerate(_DC_LENGTHS)))
    bits, lengths = np.zeros(511, np.uint32), np.zeros(511, np.int32)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255], lengths[d + 255] = (code << size | extra) << 1, n + size + 1
    return bits, lengths


_BITS, _LENGTHS = _code_table()


def encode_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded data of rows of samples, a restart interval each: the bytes with restart markers
    before each row (of number row % 8, to be renumbered by none: rows of an image start at 0), and
    where each row's data ends."""
    n, width = rows.shape
    d = rows.astype(np.int32)
    d[:, 1:] -= rows[:, :-1]
    d[:, 0] -= 128
    d += 255
    bits, lengths = _BITS[d], _LENGTHS[d]
    ends = np.cumsum(lengths, axis=1)
    size = (ends[:, -1] + 7) >> 3
    stride = int(size.max()) + 4
    buffer = np.zeros(n * stride, np.uint8)
    base = np.arange(n, dtype=np.int64) * stride
    for j in range(width):
        start = ends[:, j] - lengths[:, j]
        at = base + (start >> 3)
        word = bits[:, j] << (24 - lengths[:, j] - (start & 7)).astype(np.uint32)
        buffer[at] |= (word >> 16).astype(np.uint8)
        buffer[at + 1] |= (word >> 8 & 255).astype(np.uint8)
        buffer[at + 2] |= (word & 255).astype(np.uint8)
    fill = (size * 8 - ends[:, -1]).astype(np.uint32)
    buffer[base + size - 1] |= ((1 << fill) - 1).astype(np.uint8)
    buffer = buffer.reshape(n, stride)
    flat = buffer[np.arange(stride) < size[:, None]]
    stuffed = flat == 255
    row_end = np.cumsum(size)
    # Room for a zero after each 255, and for a marker before each row.
    shift = np.cumsum(stuffed) - stuffed + 2 * np.repeat(np.arange(1, n + 1), size)
    out = np.zeros(len(flat) + int(stuffed.sum()) + 2 * n, np.uint8)
    out[np.arange(len(flat)) + shift] = flat
    over = row_end + np.cumsum(stuffed)[row_end - 1] + 2 * np.arange(1, n + 1)
    begin = np.concatenate([[0], over[:-1]])
    out[begin] = 255
    return out, over


def encode_images(images: list[np.ndarray]) -> list[bytes]:
    """A baseline JPEG for each thumbnail (rows x COLUMNS of samples, 1 to MAX_ROWS rows)."""
    if not images:
        return []
    data, over = encode_rows(np.concatenate(images))
    out, row, at = [], 0, 0
    for image in images:
        rows = len(image)
        ends = over[row : row + rows]
        begins = np.concatenate([[at], ends[:-1]])
        data[begins + 1] = 0xD0 + (np.arange(rows) - 1) % 8
        out.append(_header(rows, image.shape[1]) + data[at + 2 : ends[-1]].tobytes() + b"\xff\xd9")
        row, at = row + rows, int(ends[-1])
    return out


@dataclass
class _Scan:
    height: int
    width: int
    blocks: list[tuple[int, int]]  # of an MCU: (component, place in it)
    sampling: tuple[int, int]  # of the luminance component
    tables: tuple  # DC and AC look-up tables by component
    quantiser: int
    interval: int  # MCUs
    across: int
    mcus: int
    data: np.ndarray  # bytes without stuffing
    starts: np.ndarray  # of the restart intervals, in bytes


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(body: bytes) -> np.ndarray:
    """For 16 bits ahead: length << 8 | symbol; 0 where no code fits."""
    if body not in _LOOKUPS:
        if len(_LOOKUPS) > 256:
            _LOOKUPS.clear()
        counts, symbols = body[:16], body[16:]
        table, code, k = np.zeros(1 << 16, np.int32), 0, 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                if k >= len(symbols) or code >= 1 << n:
                    raise JpegError("bad Huffman table")
                table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        _LOOKUPS[body] = table
    return _LOOKUPS[body]


def parse(data: bytes, at: int = 0) -> tuple[_Scan, int]:
    """The first scan of the image that starts at `at`, and where the image ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at += 2
    quantisers, huffman, frame, interval = {}, {}, None, 0
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise JpegError("cut short")
        at += 2 + size
        try:
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quantisers[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huffman[body[0]] = _lookup(body[1 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0 or marker == 0xC1:
                depth, height, width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or not height or not width:
                    raise JpegError("only 8-bit images with a size are read")
                frame = height, width, {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            elif 0xC2 <= marker <= 0xCF:
                raise JpegError("only baseline images are read")
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                break
        except (IndexError, struct.error) as e:
            raise JpegError("cut short") from e
    if frame is None:
        raise JpegError("no frame before the scan")
    try:
        parts = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
        shapes = [frame[2][c] for c, _ in parts]
        tables = [(huffman[t >> 4], huffman[0x10 | t & 15]) for _, t in parts]
        quantiser = quantisers[shapes[0][2]]
    except (KeyError, IndexError) as e:
        raise JpegError("a table or component is missing") from e
    if parts[0][0] != next(iter(frame[2])):
        raise JpegError("the first scan has no luminance")
    alone = len(parts) == 1
    shapes = [(1, 1, q) for _, _, q in shapes] if alone else shapes
    h, v = max(s[0] for s in shapes), max(s[1] for s in shapes)
    across, down = -(-frame[1] // (8 * h)), -(-frame[0] // (8 * v))
    raw = np.frombuffer(data, np.uint8, offset=at)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    ends = ff[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))]
    if not len(ends):
        raise JpegError("no end of the scan")
    end = int(ends[0])
    keep = np.ones(end, bool)
    inside = ff < end
    zeros, marks = ff[inside & (after == 0)], ff[inside & (after >= 0xD0) & (after <= 0xD7)]
    keep[zeros + 1] = keep[marks] = keep[marks + 1] = False
    place = np.cumsum(keep)
    starts = np.concatenate([[0], place[marks + 1]]).astype(np.int64)
    mcus = across * down
    if len(starts) != (-(-mcus // interval) if interval else 1):
        raise JpegError("restart markers don't fit")
    blocks = [(c, i) for c, (bh, bv, _) in enumerate(shapes) for i in range(bh * bv)]
    stop = at + end
    if data[stop : stop + 2] != b"\xff\xd9":  # further scans hold no luminance DC of a baseline image
        stop = data.find(b"\xff\xd9", stop)
        if stop < 0:
            raise JpegError("no end of image")
    return _Scan(frame[0], frame[1], blocks, shapes[0][:2], tuple(tables), quantiser, interval or mcus, across, mcus, raw[:end][keep], starts), stop + 2


def luminance(scans: list[_Scan]) -> list[np.ndarray]:
    """Thumbnails of scans; those with the same tables and MCU layout are decoded together."""
    out: list = [None] * len(scans)
    groups: dict[tuple, list[int]] = {}
    for i, s in enumerate(scans):
        groups.setdefault((tuple(s.blocks), tuple((id(a), id(b)) for a, b in s.tables)), []).append(i)
    for members in groups.values():
        for i, image in zip(members, _decode([scans[i] for i in members]), strict=True):
            out[i] = image
    return out


def _decode(scans: list[_Scan]) -> list[np.ndarray]:
    first = scans[0]
    data = np.concatenate([s.data for s in scans] + [np.zeros(8, np.uint8)]).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    offsets = np.cumsum([0, *(len(s.data) for s in scans)])
    position = np.concatenate([s.starts + o for s, o in zip(scans, offsets, strict=False)]) * 8
    limit = np.concatenate([np.append(s.starts[1:], len(s.data)) + o for s, o in zip(scans, offsets, strict=False)]) * 8
    steps = np.concatenate([np.minimum(s.interval, s.mcus - np.arange(len(s.starts)) * s.interval) for s in scans])
    luma = sum(c == 0 for c, _ in first.blocks)
    longest = int(steps.max())
    values = np.zeros((len(steps), longest * luma), np.int32)
    predicted = np.zeros((len(first.tables), len(steps)), np.int32)
    order = np.argsort(-steps, kind="stable")  # lanes that end early are at the end
    position, limit = position[order], limit[order]
    sorted_steps = steps[order]

    def ahead(p: np.ndarray) -> np.ndarray:
        return window[np.minimum(p >> 3, len(window) - 1)] << (p & 7).astype(np.uint32)

    for k in range(longest):
        n = int(np.searchsorted(-sorted_steps, -k, "left"))
        p = position[:n]
        for b, (c, _) in enumerate(first.blocks):
            dc, ac = first.tables[c]
            bits = ahead(p)
            got = dc[bits >> 16]
            length, size = got >> 8, got & 255
            if not length.all():
                raise JpegError("a code that the table doesn't have")
            if int((length + size).max()) > 24:
                extra = ahead(p + length) >> (32 - np.maximum(size, 1)).astype(np.uint32)
            else:
                extra = (bits << length.astype(np.uint32)) >> (32 - np.maximum(size, 1)).astype(np.uint32)
            extra = extra.astype(np.int32)
            half = (1 << size) >> 1
            diff = np.where(size == 0, 0, np.where(extra < half, extra - (1 << size) + 1, extra))
            predicted[c, :n] += diff
            if c == 0:
                values[:n, k * luma + b] = predicted[0, :n]
            p = p + length + size
            # AC terms: skip until each lane's end of block.
            got = ac[ahead(p) >> 16]
            p = p + (got >> 8) + (got & 15)
            busy = np.flatnonzero((got & 255) != 0)
            if not got.all():
                raise JpegError("a code that the table doesn't have")
            seen = np.full(len(busy), 1) + (got[busy] >> 4 & 15)
            while len(busy):
                more = seen < 63
                busy, seen = busy[more], seen[more]
                if not len(busy):
                    break
                got = ac[ahead(p[busy]) >> 16]
                if not got.all():
                    raise JpegError("a code that the table doesn't have")
                p[busy] += (got >> 8) + (got & 15)
                going = (got & 255) != 0
                busy, seen = busy[going], seen[going] + 1 + (got[going] >> 4 & 15)
        position[:n] = p
    if (position > limit).any():
        raise JpegError("data ends before the image does")
    back = np.empty_like(values)
    back[order] = values
    images, lane = [], 0
    for s in scans:
        own = back[lane : lane + len(s.starts)]
        lane += len(s.starts)
        flat = own[:, : s.interval * luma].reshape(-1)[: s.mcus * luma] if len(s.starts) == 1 or s.interval * luma == own.shape[1] else np.concatenate([r[: s.interval * luma] for r in own])[: s.mcus * luma]
        h, v = s.sampling
        grid = flat.reshape(s.mcus // s.across, s.across, v, h).transpose(0, 2, 1, 3).reshape(s.mcus // s.across * v, s.across * h)
        grid = np.clip((grid * s.quantiser + 4) // 8 + 128, 0, 255).astype(np.uint8)
        images.append(grid[: -(-s.height // 8), : -(-s.width // 8)])
    return images


def read_thumbnails(files: list[bytes]) -> list[list[np.ndarray]]:
    """For each file, the thumbnails of the images in it, one after another."""
    scans, owner = [], []
    for i, data in enumerate(files):
        at = 0
        while at < len(data):
            scan, at = parse(data, at)
            scans.append(scan), owner.append(i)
    out: list[list[np.ndarray]] = [[] for _ in files]
    for i, image in zip(owner, luminance(scans), strict=True):
        out[i].append(image)
    return out


def average_hash(image: np.ndarray) -> str:
    """64 bits in hex: which cells of an 8x8 grid over the thumbnail are brighter than its mean."""
    rows = np.minimum(np.arange(9) * len(image) // 8, len(image) - 1)
    columns = np.minimum(np.arange(9) * image.shape[1] // 8, image.shape[1] - 1)
    sums = np.zeros((len(image) + 1, image.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(image, axis=0, dtype=np.int64), axis=1, out=sums[1:, 1:])
    top, left = rows[:8], columns[:8]
    bottom, right = np.maximum(rows[1:], top + 1), np.maximum(columns[1:], left + 1)
    cells = (sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]) / ((bottom - top)[:, None] * (right - left))
    return np.packbits(cells.ravel() > cells.mean()).tobytes().hex()


def payload_of(data: bytes) -> np.ndarray:
    """data with bytes 255 up to a positive multiple of 576, as rows of COLUMNS samples."""
    size = max(1, -(-len(data) // 576)) * 576
    out = np.full(size, 255, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(-1, COLUMNS)


def _groups(payloads: list[np.ndarray]) -> Iterator[list[int]]:
    group, size = [], 0
    for i, p in enumerate(payloads):
        if group and size + p.size > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(i)
        size += p.size
    if group:
        yield group


def store(payloads: list[np.ndarray]) -> list[bytes]:
    """Each payload as one file: its images of at most MAX_ROWS rows, one after another."""
    frames = [(i, p[at : at + MAX_ROWS]) for i, p in enumerate(payloads) for at in range(0, len(p), MAX_ROWS)]
    out = [[] for _ in payloads]
    for group in _groups([f for _, f in frames]):
        for k, image in zip(group, encode_images([frames[k][1] for k in group]), strict=True):
            out[frames[k][0]].append(image)
    return [b"".join(x) for x in out]


def media_columns(docs: DataFrame, keep: list[str], text: str = "text", media: bool = True) -> DataFrame:
    """The columns `keep` and, for each text's UTF-8 bytes stored as JPEG samples and read back, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, width, height, feature and, if
    asked, the file itself as `media`.

    A null text counts as empty and is stored as one image of 576 samples. Equal texts give equal rows.
    The format ends at 65535 lines, so a payload of over COLUMNS * MAX_ROWS bytes is several images, one
    after another in one file: all are read back here, while other readers, and `thumbnails`, show the first.
    """
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
    fields += [("width", pa.int32()), ("height", pa.int64()), ("feature", pa.string())] + ([("media", pa.binary())] if media else [])

    def work(texts: list[str | None]) -> list:
        rows = []
        data = [(t or "").encode() for t in texts]
        payloads = [payload_of(x) for x in data]
        for group in _groups(payloads):
            files = store([payloads[i] for i in group])
            for i, file, images in zip(group, files, read_thumbnails(files), strict=True):
                image = images[0] if len(images) == 1 else np.concatenate(images)
                stored = image.tobytes()
                feature = f"{image.shape[1] * 8}x{image.shape[0] * 8}:{average_hash(image)}"
                rows.append((len(data[i]), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-32:]), len(file), hashlib.sha256(file).hexdigest(), image.shape[1] * 8, image.shape[0] * 8, feature, file)[: len(fields)])
        return list(zip(*rows, strict=True)) if rows else [[]] * len(fields)

    return annotate(docs, text, keep, fields, lambda: work)


def thumbnails(images: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and, for JPEG files in a binary column, width, height, thumbnail (samples by
    row), thumbnail_hash and error.

    Null, empty or unreadable files have nulls and the reason in error; of a file with several images
    the first counts. A kept column with the name of a result is a ValueError.
    """
    clash = {"width", "height", "thumbnail", "thumbnail_hash", "error"} & set(keep)
    if clash:
        raise ValueError(f"columns of the input clash with results: {sorted(clash)}")
    out = [f"{f.name} {f.dataType.simpleString()}" for f in images.select(*keep).schema] + ["width int", "height int", "thumbnail binary", "thumbnail_hash string", "error string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(len(keep)).to_pylist():
                try:
                    scan, _ = parse(data or b"")
                    image = luminance([scan])[0]
                    rows.append((scan.width, scan.height, image.tobytes(), average_hash(image), None))
                except JpegError as e:
                    rows.append((None, None, None, None, str(e)))
            new = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(x, t) for x, t in zip(new, kinds, strict=True)], names=[*keep, "width", "height", "thumbnail", "thumbnail_hash", "error"])

    return images.select(*keep, F.col(column).alias("_file")).mapInArrow(run, ", ".join(out))
