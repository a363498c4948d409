"""Text features that the classifiers compute with numpy over a slice of texts at once."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa


def _word_signs() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return table


_WORD = _word_signs()


def lowered_ascii(data: bytes) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    raw = np.frombuffer(data, np.uint8)
    return raw + (((raw >= 0x41) & (raw <= 0x5A)).view(np.uint8) << 5)


def lowered(data: bytes) -> np.ndarray:
    """The bytes with A-Z and the two-byte Latin capitals in lower case."""
    raw = lowered_ascii(data)
    if len(raw):
        second = np.zeros(len(raw), bool)
        second[1:] = raw[:-1] == 0xC3
        raw[second & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 0x20
    return raw


def words(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased runs of letters, digits and non-ASCII signs: each occurrence's row, its number
    among the distinct words, and those."""
    raw = lowered(data)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _WORD[raw]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    cuts = offsets[1:-1]
    if len(starts) and len(cuts):  # a word ends where its row ends
        at = np.searchsorted(starts, cuts, "right") - 1
        split = np.unique(cuts[(at >= 0) & (starts[at] < cuts) & (cuts < ends[at])])
        starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.binary())
    kept = raw[inside[1:-1]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]).dictionary_encode()
    return np.searchsorted(offsets, starts, "right") - 1, coded.indices.to_numpy(), coded.dictionary


def word_features(distinct: pa.Array, prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)) -> np.ndarray:
    """32-bit hashes (one row per word): the word and its prefixes of some byte lengths; a word
    not longer than a prefix has the word's own hash there."""
    out = np.empty((len(distinct), 1 + len(prefixes)), np.int64)
    for i, w in enumerate(distinct.to_pylist()):
        out[i, 0] = whole = zlib.crc32(w)
        for k, n in enumerate(prefixes, 1):
            out[i, k] = zlib.crc32(w[:n], 0x9E37) if len(w) > n else whole
    return out


def _shapes() -> np.ndarray:
    """Byte -> shape: 0 lower-case letter or non-ASCII, 1 capital, 2 digit, 3 blank, 4 line end,
    5 other control, and each ASCII sign on its own."""
    table = np.zeros(256, np.uint8)
    table[:0x20] = 5
    table[0x20], table[0x09], table[0x0A], table[0x0D], table[0x7F] = 3, 3, 4, 4, 5
    table[0x30:0x3A], table[0x41:0x5B] = 2, 1
    signs = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    table[signs] = 6 + np.arange(len(signs))
    return table


_SHAPE = _shapes()
SHAPES = 40
REPEAT = 38  # the shape put behind a word that repeats the one before it


def shape_counts(data: bytes, offsets: np.ndarray, size: int = 2048) -> np.ndarray:
    """For each row the hashed counts of 1- to 3-grams of its shape string.

    Runs of letters of one case, digits and blanks count as one sign of the shape string; a blank
    between two equal words is a sign of its own, so repetition shows.
    """
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros((rows, size), np.float32)
    raw = np.frombuffer(data, np.uint8)
    shape = _SHAPE[raw]
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | (shape[1:] > 4)
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    keep[firsts] = True
    place = np.flatnonzero(keep)
    kind = shape[place].astype(np.int64)
    blank = np.flatnonzero((shape == 3) | (shape == 4))
    begin = np.unique(np.concatenate([firsts, blank + 1]))
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))
    pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(data)])
    code = pieces.dictionary_encode().indices.to_numpy()
    row_of = np.searchsorted(offsets, begin, "right") - 1
    again = np.zeros(len(begin), bool)
    again[1:] = (code[1:] == code[:-1]) & (row_of[1:] == row_of[:-1]) & (stop[1:] - begin[1:] > 2)
    repeated = np.zeros(len(data), bool)
    repeated[begin[again]] = True
    kind[repeated[place]] = REPEAT
    row = np.searchsorted(offsets, place, "right") - 1
    two = np.where(row[1:] == row[:-1], kind[:-1] * SHAPES + kind[1:] + SHAPES, -1)
    cells = []
    for of, gram in ((row, kind), (row[1:], two), (row[2:], np.where(row[2:] == row[:-2], (two[:-1] * SHAPES + kind[2:]) * 7919 + 104729, -1) if len(two) > 1 else np.zeros(0, np.int64))):
        if len(gram):
            good = gram >= 0
            cells.append(of[good] * size + gram[good] % size)
    return np.bincount(np.concatenate(cells), minlength=rows * size).astype(np.float32).reshape(rows, size)


def word_counts(data: bytes, offsets: np.ndarray, size: int = 4096) -> np.ndarray:
    """For each row the hashed counts of its words, of its pairs of neighbouring words, and of the 3-
    and 4-byte parts of its words (with a mark at both ends)."""
    rows = len(offsets) - 1
    row, code, distinct = words(data, offsets)
    if not len(row):
        return np.zeros((rows, size), np.float32)
    known = [b"<" + w + b">" for w in distinct.to_pylist()]
    own = np.array([zlib.crc32(w) for w in known], np.uint32)
    both = row[1:] == row[:-1]
    mixed = (own[code[:-1]][both] * np.uint32(0x9E3779B1)) ^ own[code[1:]][both]
    cells = [row * size + own[code] % size, row[1:][both] * size + (mixed ^ mixed >> np.uint32(15)) % size]
    # parts are counted for each distinct word once and then for its occurrences
    flat = np.frombuffer(b"".join(known), np.uint8).astype(np.uint32)
    lengths = np.array([len(w) for w in known])
    begin = np.cumsum(lengths) - lengths
    for n in (3, 4):
        count = np.maximum(lengths - n + 1, 0)
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        part = np.zeros(len(at), np.uint32)
        for i in range(n):
            part = (part ^ flat[at + i]) * np.uint32(0x01000193)
        part = (part ^ part >> np.uint32(13)) % size
        first, many = (np.cumsum(count) - count)[code], count[code]
        place = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        cells.append(np.repeat(row, many) * size + part[place])
    return np.bincount(np.concatenate(cells), minlength=rows * size).astype(np.float32).reshape(rows, size)
