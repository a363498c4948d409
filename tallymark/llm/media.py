"""Media columns: baseline JPEG written and read in numpy.

``store`` writes a text's bytes as the samples of grey images: one byte is one 8x8 block whose
only coefficient is its DC value, quantized by 8, so the DC-only thumbnail is the payload itself
and nothing is lost.  Rows of 64 blocks are restart intervals.  ``read`` is a decoder for any
baseline JPEG: it parses the markers, Huffman-decodes the scan, reconstructs the thumbnail of
the first component (luminance) from its DC coefficients, and keeps dimensions and hashes.
All restart intervals of all images of a slice that share their tables are decoded in step, one
block after another, with numpy over the intervals.

Defined results: a null or empty text is one row of zero bytes; texts beyond one image's height
go on in further images behind it; equal texts give equal media; bytes that are no baseline JPEG
give a null thumbnail; repeated rows are stored each; an empty table gives an empty table;
columns other than the id and text columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, only, slices, text_bytes, type_of

ROW = 64
MOST_ROWS = 65535 // 8
QUANT = 8
SLICE = 1 << 20  # bytes that are coded at once: a sample takes some 60 bytes meanwhile
NARROW = 1 << 27  # up to so many bytes, positions of bits are 32-bit numbers
# Huffman tables (fixed values): the format's usual DC luminance table; one AC code, end of block.
DC_BITS, DC_VALUES = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))
AC_BITS, AC_VALUES = [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [0]


class NotBaseline(ValueError):
    """The bytes are not a baseline JPEG that this decoder reads."""


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _codes(bits: list[int]) -> list[tuple[int, int]]:
    """(code, length) of a table's values in order."""
    out, code = [], 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each difference -255..255: its DC code, its bits and the end-of-block code, and their length."""
    dc = _codes(DC_BITS)
    values, lengths = np.zeros(511, np.int32), np.zeros(511, np.int32)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, length = dc[size]
        extra = diff if diff > 0 else diff + (1 << size) - 1 if diff else 0
        values[diff + 255] = (code << size | extra) << 1
        lengths[diff + 255] = length + size + 1
    return values, lengths


_VALUES, _LENGTHS = _diff_codes()


def _head(rows: int, note: bytes) -> bytes:
    parts = [b"\xff\xd8"]
    if note:
        parts.append(_segment(0xFE, note))
    parts += [
        _segment(0xDB, b"\x00" + bytes([QUANT] * 64)),
        _segment(0xC0, b"\x08" + (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big") + b"\x01\x01\x11\x00"),
        _segment(0xC4, b"\x00" + bytes(DC_BITS) + bytes(DC_VALUES)),
        _segment(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_VALUES)),
        _segment(0xDD, ROW.to_bytes(2, "big")),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ]
    return b"".join(parts)


def write_scans(samples: np.ndarray, last: np.ndarray, index: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded rows of 64 samples each (stuffed; a restart marker behind every row but an
    image's last) and each row's end in them.  ``index`` is a row's number in its image."""
    level = samples.astype(np.int32) - 128
    diff = np.diff(level, axis=1, prepend=np.int32(0)) + 255
    lengths = _LENGTHS[diff]
    kind = np.int32 if samples.size < NARROW else np.int64
    ends = np.cumsum(lengths, axis=1, dtype=kind)
    bits = ends[:, -1]
    sizes = (bits + 7) >> 3
    begin = np.cumsum(sizes, dtype=kind) - sizes
    at = (begin[:, None] * 8 + ends - lengths).ravel()
    placed = _VALUES[diff].ravel() << (24 - lengths.ravel() - (at & 7))
    byte = at >> 3
    total = int(sizes.sum())
    out = np.zeros(total + 3, np.int32)
    for shift in (16, 8, 0):
        out += np.bincount(byte + (2 - shift // 8), (placed >> shift) & 255, total + 3).astype(np.int32)
    out = out[:total]
    stop = begin + sizes - 1
    out[stop] += (1 << (-bits & 7)) - 1
    grow = 1 + (out == 255)
    grow[stop] += 2 * ~last
    after = np.cumsum(grow)
    made = np.zeros(int(after[-1]), np.uint8)
    made[after - grow] = out
    marker = after[stop[~last]] - 2
    made[marker], made[marker + 1] = 0xFF, 0xD0 + (index[~last] & 7)
    return made.tobytes(), after[stop]


def encode_texts(data: bytes, offsets: np.ndarray) -> list[bytes]:
    """The media of each row's bytes."""
    sizes = np.diff(offsets)
    rows = np.maximum(1, (sizes + ROW - 1) // ROW)
    first = np.cumsum(rows) - rows
    samples = np.zeros(int(rows.sum()) * ROW, np.uint8)
    from_to = np.arange(len(data), dtype=np.int64) + np.repeat(first * ROW - offsets[:-1], sizes)
    samples[from_to] = np.frombuffer(data, np.uint8)
    number = np.arange(int(rows.sum())) - np.repeat(first, rows)
    index = number % MOST_ROWS
    last = (index == MOST_ROWS - 1) | (number == np.repeat(rows, rows) - 1)
    scans, ends = write_scans(samples.reshape(-1, ROW), last, index)
    image_ends = ends[last].tolist()
    image_rows = (index[last] + 1).tolist()
    out, at, image = [], 0, 0
    for size, n in zip(sizes.tolist(), rows.tolist(), strict=True):
        parts = []
        for k in range(-(-n // MOST_ROWS)):
            parts += [_head(image_rows[image], b"bytes=%d" % size if not k else b""), scans[at : image_ends[image]], b"\xff\xd9"]
            at = image_ends[image]
            image += 1
        out.append(b"".join(parts))
    return out


@dataclass
class Image:
    """One parsed image: its frame, its tables and where its scan lies."""

    width: int = 0
    height: int = 0
    interval: int = 0
    quant: dict = field(default_factory=dict)
    huffman: dict = field(default_factory=dict)
    components: list = field(default_factory=list)
    note: bytes = b""
    scan: tuple[int, int] = (0, 0)

    def tables(self) -> tuple:
        return (tuple(sorted(self.huffman.items())), tuple(self.components), tuple(sorted(self.quant.items())))


def parse(data: bytes, at: int = 0) -> tuple[Image, int]:
    """The image that begins at ``at`` and the place behind its end marker."""
    image = Image()
    if data[at : at + 2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    at += 2
    frame: list[bytes] = []
    while True:
        if len(data) < at + 4 or data[at] != 0xFF:
            raise NotBaseline("no marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.note = image.note or body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
                raise NotBaseline("frame")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise NotBaseline("not a baseline frame")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.huffman[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            image.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            ids = [c[0] for c in frame] if image.width and image.height else []
            if not ids or set(chosen) != set(ids):
                raise NotBaseline("only scans of all components are read")
            image.components = [(c[1] >> 4, c[1] & 15, c[2], chosen[c[0]] >> 4, 16 + (chosen[c[0]] & 15)) for c in frame]
            break
        elif marker == 0xD9:
            raise NotBaseline("no scan")
    end = at
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            raise NotBaseline("no end of image")
        if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
            end += 2
        else:
            break
    image.scan = (at, end)
    if data[end : end + 2] != b"\xff\xd9":
        raise NotBaseline("more than one scan")
    return image, end + 2


def _table(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of the stream -> code length (0: none) and value."""
    length, value = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    for (code, n), v in zip(_codes(list(spec[:16])), spec[16:], strict=False):
        a = code << (16 - n)
        length[a : a + (1 << (16 - n))], value[a : a + (1 << (16 - n))] = n, v
    return length, value


def _decode_group(images: list[Image], scans: list[bytes]) -> list[np.ndarray]:
    """DC values of the first component of images with equal tables, all intervals in step."""
    sizes = np.array([len(s) for s in scans], np.int64)
    raw = np.frombuffer(b"".join(scans), np.uint8)
    base = np.cumsum(sizes) - sizes
    full = np.flatnonzero(raw == 0xFF)
    follow = raw[np.minimum(full + 1, len(raw) - 1)]
    keep = np.ones(len(raw), bool)
    keep[full[follow == 0] + 1] = False
    restart = full[(follow >= 0xD0) & (follow <= 0xD7)]
    keep[restart], keep[restart + 1] = False, False
    before = np.concatenate([[0], np.cumsum(keep)])
    begins = np.union1d(base, restart + 2)
    owner = np.searchsorted(base, begins, "right") - 1
    clean = np.concatenate([raw[keep], np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
    window = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
    place = (before[begins] * 8).astype(np.int32 if len(clean) < NARROW else np.int64)
    limit = (len(window) - 1) * 8
    first = images[0]
    across = max(h for h, *_ in first.components)
    down = max(v for _, v, *_ in first.components)
    single = len(first.components) == 1
    plan = [(c, 1 if single else h * v, dc, ac) for c, (h, v, _, dc, ac) in enumerate(first.components)]
    units = np.array([_units(i, across, down, single) for i in images], np.int64)
    total = units[:, 0] * units[:, 1]
    rank = np.arange(len(begins)) - np.searchsorted(owner, owner)
    step = np.array([i.interval or int(t) for i, t in zip(images, total.tolist(), strict=True)], np.int64)[owner]
    blocks = np.clip(total[owner] - rank * step, 0, step)
    h0, v0 = (1, 1) if single else first.components[0][:2]
    per_unit = h0 * v0
    made = np.zeros((len(begins), int(blocks.max(initial=0)) * per_unit), np.int16)
    tables = {k: _table(s) for k, s in first.huffman.items()}
    predicted = [np.zeros(len(begins), np.int32) for _ in first.components]
    live = np.arange(len(begins))
    for unit in range(int(blocks.max(initial=0))):
        if not (blocks[live] > unit).all():
            live = live[blocks[live] > unit]
        everyone = len(live) == len(begins)
        p = place if everyone else place[live]
        for c, n, dc, ac in plan:
            for k in range(n):
                length, value = tables[dc]
                bits = (window[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF
                size = value[bits]
                if not length[bits].all() or size.max(initial=0) > 11:
                    raise NotBaseline("unknown DC code")
                p = p + length[bits]
                extra = ((window[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF).astype(np.int32) >> (16 - size)
                p = np.minimum(p + size, limit)
                diff = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
                level = predicted[c][live] + diff
                predicted[c][live] = level
                if c == 0:
                    made[live, unit * per_unit + k] = level
                length, value = tables[ac]
                at, some, q = np.ones(len(live), np.int32), np.arange(len(live)), p
                while len(some):
                    bits = (window[q >> 3] >> (16 - (q & 7)).astype(np.uint32)) & 0xFFFF
                    if not length[bits].all():
                        raise NotBaseline("unknown AC code")
                    value_at = value[bits]
                    q = np.minimum(q + length[bits] + (value_at & 15), limit)
                    p[some] = q
                    at = np.where(value_at == 0, 64, at + (value_at >> 4) + 1)
                    more = at < 64
                    some, q, at = some[more], q[more], at[more]
        if everyone:
            place = p
        else:
            place[live] = p
    out = []
    cuts = np.searchsorted(owner, np.arange(len(images) + 1))
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        flat = made[a:b] if (blocks[a:b] == made.shape[1] // per_unit).all() else None
        values = flat.ravel() if flat is not None else np.concatenate([made[j, : int(blocks[j]) * per_unit] for j in range(a, b)])
        wide, tall = units[i].tolist()
        grid = values.reshape(tall, wide, v0, h0).swapaxes(1, 2).reshape(tall * v0, wide * h0)
        h, w = -(-_ceil(images[i].height * v0, down) // 8), -(-_ceil(images[i].width * h0, across) // 8)
        quant = images[i].quant[first.components[0][2]]
        out.append(np.clip((grid[:h, :w].astype(np.int64) * quant + 4) // 8 + 128, 0, 255).astype(np.uint8))
    return out


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def _units(image: Image, across: int, down: int, single: bool) -> tuple[int, int]:
    """Coded units in a row and in a column."""
    if single:
        return _ceil(image.width, 8), _ceil(image.height, 8)
    return _ceil(image.width, 8 * across), _ceil(image.height, 8 * down)


def decode_media(media: list[bytes | None]) -> list[list[tuple[Image, np.ndarray]] | None]:
    """For each value its images with their DC-only luminance thumbnails; None if it is no
    sequence of baseline JPEGs."""
    found: list[list[Image] | None] = []
    groups: dict[tuple, list[tuple[int, int, bytes]]] = {}
    for row, data in enumerate(media):
        images: list[Image] = []
        try:
            at = 0
            while data is not None and at < len(data):
                image, at = parse(data, at)
                images.append(image)
        except (NotBaseline, IndexError):
            images = []
        found.append(images or None)
        for k, image in enumerate(images):
            groups.setdefault(image.tables(), []).append((row, k, data[image.scan[0] : image.scan[1]]))
    thumbs: dict[tuple[int, int], np.ndarray] = {}
    for members in groups.values():
        try:
            shapes = _decode_group([found[r][k] for r, k, _ in members], [s for *_, s in members])
            thumbs |= {(r, k): t for (r, k, _), t in zip(members, shapes, strict=True)}
        except (NotBaseline, IndexError, KeyError, ValueError):
            for r, k, s in members:  # one broken image must not spoil its group
                try:
                    thumbs[r, k] = _decode_group([found[r][k]], [s])[0]
                except (NotBaseline, IndexError, KeyError, ValueError):
                    continue
    return [[(i, thumbs[r, k]) for k, i in enumerate(images)] if images and all((r, k) in thumbs for k in range(len(images))) else None for r, images in enumerate(found)]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Average hash and gradient hash of the thumbnail's 8 x 9 cell means, in hexadecimal."""
    h, w = thumb.shape
    rows, columns = np.arange(8) * h // 8, np.arange(9) * w // 9
    to_r, to_c = np.maximum(rows + 1, np.append(rows[1:], h)), np.maximum(columns + 1, np.append(columns[1:], w))
    cells = np.add.reduceat(np.add.reduceat(thumb, rows, 0, dtype=np.int64), columns, 1)
    means = cells / np.outer(to_r - rows, to_c - columns)
    average, gradient = means[:, :8] > means[:, :8].mean(), means[:, 1:] > means[:, :-1]
    return np.packbits(average).tobytes().hex() + np.packbits(gradient).tobytes().hex()


def stacked(thumbs: list[np.ndarray]) -> np.ndarray:
    """Thumbnails below each other, narrower ones filled up with zeros on the right."""
    if len(thumbs) == 1:
        return thumbs[0]
    width = max(t.shape[1] for t in thumbs)
    return np.concatenate([t if t.shape[1] == width else np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t in thumbs])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, media``: each text's bytes, padded by zeros to rows of 64, as JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, offsets = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(encode_texts(data, offsets), pa.binary())], [id_col, "n_bytes", "media"])

    source = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return arrow_map(source, f"`{id_col}` {type_of(docs, id_col)}, n_bytes bigint, media binary", run)


def read(stored: DataFrame, keep_thumbnail: bool = False, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id_col, width, height, images, media_bytes, media_sha256, payload_bytes, payload_sha256,
    tail_crc32, thumbnail_hash, thumbnail``, all but the media's own size and digest from the
    decoded thumbnails (of further images, below the first)."""
    names = [id_col, "width", "height", "images", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "thumbnail_hash", "thumbnail"]
    kinds = ["int", "int", "int", "bigint", "string", "bigint", "string", "bigint", "string", "binary"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE):
            media = batch.column(1).to_pylist()
            rows = []
            for data, images in zip(media, decode_media(media), strict=True):
                own = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                if images is None:
                    rows.append((None, None, None, *own, None, None, None, None, None))
                    continue
                payload = b"".join(t.tobytes() for _, t in images)
                rows.append((images[0][0].width, sum(i.height for i, _ in images), len(images), *own, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), thumbnail_hash(stacked([t for _, t in images])), payload if keep_thumbnail else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    schema = f"`{id_col}` {type_of(stored, id_col)}, " + ", ".join(f"{n} {k}" for n, k in zip(names[1:], kinds, strict=True))
    source = only(stored, id_col, media_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{media_col}`").alias("media"))
    return arrow_map(source, schema, run)


def text_of(media: bytes) -> str:
    """The text that :func:`store` has put into a media value."""
    images = decode_media([media])[0]
    if images is None or not images[0][0].note.startswith(b"bytes="):
        raise NotBaseline("not a stored text")
    return b"".join(t.tobytes() for _, t in images)[: int(images[0][0].note[6:])].decode()
