"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, every turn as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a
line feed, and encoded once with offsets.  The three marks are added tokens of the encoder, so no
token crosses a turn's text.  The spans of the assistant's texts are intersected with the sorted
token spans by binary search; the tokens found carry the loss.

Control strings inside roles and texts are escaped reversibly: ``<`` with any backslashes and a
bar behind it gains one backslash, so ``<|`` never occurs in an escaped text.  Roles also write
line feeds and backslashes as two signs.

Defined results: null texts and roles are empty; turns are ordered by turn (nulls first), then
role, then text; repeated turns and rows are all kept; a null conversation id is one
conversation; an empty table gives an empty table; other columns are not read.  One conversation
is one value, so it must fit in a row, as in any table.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoded, Vocabulary, vocabulary
from .common import arrow_map, only, type_of

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """No ``<|`` is left."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts that carry the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}{SEPARATOR}", escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens that have a sign within a span; token spans are sorted, so two bisections a span."""
    out = np.zeros(len(starts), bool)
    if spans and len(starts):
        begin, end = np.array(spans).T
        first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(starts, end, "left")
        for a, b, empty in zip(first.tolist(), last.tolist(), (begin == end).tolist(), strict=True):
            if not empty:
                out[a:b] = True
    return out


def loss_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The unescaped texts under the mask: runs of tokens that follow each other."""
    out, begin, stop = [], None, 0
    for a, b in zip(starts[loss].tolist(), ends[loss].tolist(), strict=True):
        if begin is None or a > stop:
            if begin is not None:
                out.append(unescape(formatted[begin:stop]))
            begin, stop = a, b
        stop = max(stop, b)
    return out if begin is None else [*out, unescape(formatted[begin:stop])]


@functools.lru_cache(maxsize=2)
def encoder(vocab_path: str) -> Vocabulary:
    """The file's vocabulary with the template's marks as added tokens."""
    return vocabulary(vocab_path).with_added([START, SEPARATOR, END])


def encoded(texts: list[str], vocab_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, each token's first and last code point (exclusive, within its text), and
    where each text's tokens begin.  A token that holds part of a code point spans all of it."""
    vocab, raw = encoder(vocab_path), [t.encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = b"".join(raw)
    got = Encoded(data, offsets, vocab)
    lengths = vocab.token_length[got.ids]
    ends = np.cumsum(lengths)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    own = np.repeat(points[offsets[:-1]], np.diff(got.bounds))
    return got.ids, points[ends - lengths + 1] - 1 - own, points[ends] - own, got.bounds


def format_conversations(conversations: DataFrame, vocab_path: str, loss_roles: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id_col, formatted, ids, starts, ends, loss``: the text, its token ids, their spans in
    code points and for each token whether it carries the loss."""
    names = [id_col, "formatted", "ids", "starts", "ends", "loss"]

    def made(keys: list, texts: list[str], spans: list) -> pa.RecordBatch:
        ids, starts, ends, bounds = encoded(texts, vocab_path)
        loss = np.zeros(len(ids), bool)
        for own, a, b in zip(spans, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            loss[a:b] = mask(own, starts[a:b], ends[a:b])
        cuts = pa.array(bounds.astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (ids, starts.astype(np.int32), ends.astype(np.int32), loss)]
        return pa.RecordBatch.from_arrays([pa.array(keys, id_type), pa.array(texts, pa.string()), *lists], names)

    id_type = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type

        def rows() -> Iterator[tuple]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        ids, texts, spans, held = [], [], [], 0
        for key, turns in itertools.groupby(rows(), key=lambda r: r[0]):
            text, own = render([(role or "", words or "") for _, role, words in turns], loss_roles)
            ids.append(key)
            texts.append(text)
            spans.append(own)
            held += len(text)
            if held > 1 << 20:
                yield made(ids, texts, spans)
                ids, texts, spans, held = [], [], [], 0
        if ids:
            yield made(ids, texts, spans)

    source = only(conversations, id_col, turn_col, role_col, text_col).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    dealt = source.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    return arrow_map(dealt, f"`{id_col}` {type_of(conversations, id_col)}, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>", run)


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from the output alone."""
    names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            starts, ends, loss = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())])
            for text, a, b in zip(batch.column(1).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                turns = parse(text)
                told = "".join(f"{role}\n{words}\n" for role, words in turns)
                under = "".join(loss_texts(text, starts[a:b], ends[a:b], loss[a:b]))
                row = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], names)

    schema = f"`{id_col}` {type_of(formatted, id_col)}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return arrow_map(only(formatted, id_col, "formatted", "starts", "ends", "loss"), schema, run)
