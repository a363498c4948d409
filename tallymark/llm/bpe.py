"""Byte-level BPE: encoding and decoding of whole texts with a minimal acyclic transducer lexicon.

``frequent_words`` counts the pre-tokenizer's words over the whole corpus, ``Lexicon.compile``
turns the most frequent into a shared-suffix automaton whose additive outputs give a word's
number and with it the word's token ids, and ``encode`` memory-maps that file in every worker:
a slice's distinct words run through the automaton, and those that it does not accept are merged
exactly by the vocabulary's merge ranks.  The lexicon changes the speed only, never an id.

Ids are those of the tokenizers library for the same file (``add_special_tokens=False``, no
truncation, no padding); strings of the file's added tokens become their ids.

Defined results: null and empty texts have no tokens; bytes that are not UTF-8 count as U+FFFD;
repeated rows are encoded each; an empty table gives an empty table; columns other than the id
and text columns are not read.
"""

from __future__ import annotations

import copy
import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop_written, new_uri, only, put_bytes, ragged, slices, text_bytes, type_of, written

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
NEVER = np.int32(2**31 - 1)
LONG_WORD = 256


@functools.cache
def _classes() -> np.ndarray:
    """Code point -> LETTER, NUMBER, SPACE or OTHER."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    # The code points with the property White_Space (fixed values).
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def special_spans(data: bytes, offsets: np.ndarray, specials: tuple[bytes, ...]) -> np.ndarray:
    """Places of added tokens' strings, leftmost and then longest first, none across two rows."""
    if not specials:
        return np.zeros((0, 2), np.int64)
    pattern = re.compile(b"|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)))
    spans = np.array([m.span() for m in pattern.finditer(data)], np.int64).reshape(-1, 2)
    if len(spans) and (spans[:, 1] > offsets[np.searchsorted(offsets, spans[:, 0], "right")]).any():
        rows = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        spans = np.array([(a + m.start(), a + m.end()) for a, b in rows for m in pattern.finditer(data[a:b])], np.int64).reshape(-1, 2)
    return spans


def word_bounds(data: bytes, offsets: np.ndarray, specials: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words of all rows (n_words + 1, the last is len(data)), and for each row
    the number of the first of its words (n_rows + 1).

    Words follow the byte-level pre-tokenizer's rule: contractions, then runs of letters, numbers
    or other signs, each with one blank before it, then white space, whose last sign stays apart
    when something follows.  Runs are found once for the whole slice by comparing neighbouring
    classes.  An added token's string is a word of its own.
    """
    size = len(data)
    rows = len(offsets) - 1
    if not size:
        return np.zeros(1, np.int64), np.zeros(rows + 1, np.int64)
    spans = special_spans(data, offsets, specials)
    breaks = np.union1d(offsets, spans.ravel()) if len(spans) else offsets
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if n == size:
        where, first_at = None, breaks
    else:
        wide = np.ones(n, np.int8)
        for limit in (0x80, 0x800, 0x10000):
            wide += points >= limit
        where = np.zeros(n + 1, np.int64)
        np.cumsum(wide, out=where[1:])
        first_at = np.searchsorted(where, breaks)
    kind = _classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[first_at] = True
    new_run = edge[:-1].copy()
    new_run[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(new_run)
    end = np.append(start[1:], n)
    of = kind[start]
    followed = ~edge[end]
    blank = (of == SPACE) & followed & (points[end - 1] == 0x20)
    led = np.zeros(len(start), bool)
    led[1:] = blank[:-1]
    spaces = of == SPACE
    keep = np.zeros(n + 1, bool)
    keep[(start - led)[~spaces]] = True
    keep[start[spaces & (end - start - blank >= 1)]] = True
    keep[(end - 1)[spaces & followed & ~blank & (end - start >= 2)]] = True
    quote = np.flatnonzero((of == OTHER) & (end - start == 1) & (points[start] == 0x27) & ~led & followed)
    quote = quote[of[np.minimum(quote + 1, len(of) - 1)] == LETTER] if len(quote) else quote
    if len(quote):
        after = start[quote] + 1
        length = end[quote + 1] - after
        one = points[after]
        two = np.where(length >= 2, points[np.minimum(after + 1, n - 1)], 0)
        taken = np.zeros(len(quote), np.int64)
        for sign in "stmd":
            taken[one == ord(sign)] = 1
        for a, b in ("re", "ve", "ll"):
            taken[(one == ord(a)) & (two == ord(b))] = 2
        hit = taken > 0
        keep[after[hit]] = False
        rest = hit & (taken < length)
        keep[(after + taken)[rest]] = True
    starts = np.flatnonzero(keep[:n])
    bounds = np.append(starts, n) if where is None else np.append(where[starts], size)
    if len(spans):
        last = np.maximum(np.searchsorted(spans[:, 0], bounds) - 1, 0)
        bounds = bounds[~((bounds > spans[last, 0]) & (bounds < spans[last, 1]))]
    return bounds.astype(np.int64), np.searchsorted(bounds, offsets).astype(np.int64)


def distinct_words(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each word its number among the distinct ones, and those as bytes."""
    words = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: ids, merge ranks, added tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: only plain byte-level BPE files are read")
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        sign = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        byte = {s: b for b, s in sign.items()}
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[sign[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in column], np.int64) for column in ([p[0] for p in pairs], [p[1] for p in pairs], [p[0] + p[1] for p in pairs]))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)
        self.specials = {t["content"].encode(): int(t["id"]) for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        table = [b""] * self.size
        for token, i in vocab.items():
            table[i] = bytes(byte[s] for s in token)
        for token, i in self.specials.items():
            table[i] = token
        self._tokens(table)
        self.first_rank = self._rank(*(x.ravel() for x in np.meshgrid(self.byte_id, self.byte_id, indexing="ij"))).reshape(256, 256)

    def _tokens(self, table: list[bytes]) -> None:
        self.token_bytes, self.size = table, len(table)
        self.token_data = np.frombuffer(b"".join(table), np.uint8)
        lengths = np.array([len(t) for t in table], np.int64)
        self.token_at, self.token_length = np.cumsum(lengths) - lengths, lengths

    def with_added(self, tokens: list[str]) -> Vocabulary:
        """The same vocabulary with further added tokens, whose ids follow the last."""
        fresh = [t.encode() for t in tokens if t.encode() not in self.specials]
        out = copy.copy(self)
        out.specials = self.specials | {t: self.size + i for i, t in enumerate(fresh)}
        out._tokens(self.token_bytes + fresh)
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER).astype(np.int32)

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of distinct words: one pool, and for each word its place and length there.

        Words of one length are merged together: a row each, every round one merge (the lowest
        rank, leftmost first) in every row that still has one.
        """
        data, offsets = _flat(words)
        lengths = np.diff(offsets)
        special = {}
        if self.specials:
            for text, i in self.specials.items():
                for w in np.flatnonzero(lengths == len(text)):
                    if data[offsets[w] : offsets[w + 1]].tobytes() == text:
                        special[int(w)] = i
        pools = []
        total = 0
        start, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for length in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == length)
            if special:
                which = which[~np.isin(which, list(special))]
            if not length or not len(which):
                continue
            if length > LONG_WORD:
                for w in which.tolist():
                    ids = self._merge_long(data[offsets[w] : offsets[w + 1]])
                    start[w], count[w] = total, len(ids)
                    total += len(ids)
                    pools.append(np.array(ids, np.int32))
                continue
            step = max(1, (1 << 20) // length)
            for a in range(0, len(which), step):
                some = which[a : a + step]
                for rows, ids in self._merge_rows(data[offsets[some][:, None] + np.arange(length)]):
                    done = some[rows]
                    start[done] = total + np.arange(len(done)) * ids.shape[1]
                    count[done] = ids.shape[1]
                    total += ids.size
                    pools.append(ids.ravel())
        for w, i in special.items():
            start[w], count[w] = total, 1
            total += 1
            pools.append(np.array([i], np.int32))
        return (np.concatenate(pools) if pools else np.zeros(0, np.int32)), start, count

    def _merge_rows(self, signs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = self.byte_id[signs]
        ranks = self.first_rank[signs[:, :-1], signs[:, 1:]]
        rows = np.arange(len(ids))
        while ids.shape[1] > 1:
            at = ranks.argmin(1)
            every = np.arange(len(ids))
            best = ranks[every, at]
            more = best < NEVER
            if not more.all():
                yield rows[~more], ids[~more]
                rows, ids, ranks, at, best = rows[more], ids[more], ranks[more], at[more], best[more]
                every = every[: len(rows)]
                if not len(rows):
                    return
            width = ids.shape[1] - 1
            column = np.arange(width)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            ids[every, at] = self.made[best]
            column = column[: width - 1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            if width > 1:
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
                ranks[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])
                ranks[right, at[right]] = self._rank(ids[right, at[right]], ids[right, at[right] + 1])
        if len(rows):
            yield rows, ids

    @functools.cached_property
    def _lookup(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def _merge_long(self, signs: np.ndarray) -> list[int]:
        """The same merges for one long word, by a heap: n log n."""
        ids = self.byte_id[signs].tolist()
        n, rank = len(ids), self._lookup
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = int(self.made[r]), False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r2 := rank.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r2, x, ids[x], ids[y]))
        return [t for t, live in zip(ids, alive, strict=True) if live]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens."""
        ids = np.asarray(ids, np.int64)
        return self.token_data[ragged(self.token_at[ids], self.token_length[ids])].tobytes()


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The file's vocabulary, read once in a process."""
    return Vocabulary(path)


class Encoded:
    """A slice of rows as token ids: ``ids[bounds[i]:bounds[i + 1]]`` are row i's."""

    def __init__(self, data: bytes, offsets: np.ndarray, vocab: Vocabulary, lexicon: Lexicon | None = None) -> None:
        bounds, first = word_bounds(data, offsets, tuple(vocab.specials))
        self.first = first
        if len(bounds) > 1:
            self.code, self.words = distinct_words(data, bounds)
        else:
            self.code, self.words = np.zeros(0, np.int32), pa.array([], pa.binary())
        self.pool, self.start, self.count = lexicon.ids(self.words, vocab) if lexicon else vocab.merge(self.words)
        per_word = self.count[self.code]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        self.per_word, self.bounds = per_word, ends[first]

    @functools.cached_property
    def ids(self) -> np.ndarray:
        return self.pool[ragged(self.start[self.code], self.per_word)]


class Lexicon:
    """Words with their token ids in a minimal acyclic transducer, kept as flat arrays in one file.

    Equal suffixes share states.  Every edge carries how many words sort before it below its
    state; the sum along a word's path is the word's number, which indexes the id lists.
    """

    FIELDS = ("edge", "target", "skip", "final", "at", "tokens")

    def __init__(self, **arrays: np.ndarray) -> None:
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def compile(cls, words: list[bytes], vocab: Vocabulary) -> Lexicon:
        """Build from any words (sorted and made distinct here), ids by exact merging."""
        words = sorted({w for w in words if w})
        register: dict[tuple, int] = {}
        frozen: list[tuple] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(frozen)
                frozen.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # final, [(byte, state)], last edge still open
        last = b""
        for word in words:
            same = 0
            most = min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            for depth in range(len(last), same, -1):
                path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        for depth in range(len(last), 0, -1):
            path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
        root = freeze(path[0])
        below = [0] * len(frozen)
        edges, targets, skips = [], [], []
        for state, (final, out) in enumerate(frozen):  # children are frozen before parents
            seen = int(final)
            for sign, to in out:
                edges.append(state << 8 | sign)
                targets.append(to)
                skips.append(seen)
                seen += below[to]
            below[state] = seen
        pool, start, count = vocab.merge(pa.array(words, pa.binary()))
        number = root  # the root is the last frozen state; it is renumbered to 0 by swapping
        order = np.arange(len(frozen), dtype=np.int64)
        order[[0, number]] = order[[number, 0]]
        edge = np.array(edges, np.int64).reshape(-1)
        edge = order[edge >> 8] << 8 | edge & 255
        sort = np.argsort(edge, kind="stable")
        final = np.zeros(len(frozen), np.int8)
        final[order] = [int(f) for f, _ in frozen]
        return cls(edge=edge[sort], target=order[np.array(targets, np.int64)][sort].astype(np.int32), skip=np.array(skips, np.int32)[sort], final=final, at=np.concatenate([[0], np.cumsum(count)]).astype(np.int64), tokens=pool[ragged(start, count)].astype(np.int32))

    def to_bytes(self) -> bytes:
        arrays = {n: np.ascontiguousarray(getattr(self, n)) for n in self.FIELDS}
        head = json.dumps({n: [str(a.dtype), len(a)] for n, a in arrays.items()}).encode().ljust(1016)
        out = [len(head).to_bytes(8, "little"), head]
        for a in arrays.values():
            out += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
        return b"".join(out)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        """Memory-map a file made of :meth:`to_bytes`."""
        raw = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(raw[:8].tobytes(), "little")
        at, arrays = 8 + size, {}
        for name, (kind, length) in json.loads(raw[8:at].tobytes()).items():
            nbytes = np.dtype(kind).itemsize * length
            arrays[name] = raw[at : at + nbytes].view(kind)
            at += nbytes + -nbytes % 8
        return cls(**arrays)

    def number(self, words: pa.Array) -> np.ndarray:
        """Each word's number, or -1 if the automaton does not accept it."""
        data, offsets = _flat(words)
        begin, length = offsets[:-1], np.diff(offsets)
        out = np.full(len(words), -1, np.int64)
        if not len(self.edge):
            return out
        live = np.flatnonzero(length > 0)
        state, total = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        depth = 0
        while len(live):
            key = state << 8 | data[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[at] == key
            live, at, total = live[hit], at[hit], total[hit]
            state = self.target[at].astype(np.int64)
            total = total + self.skip[at]
            depth += 1
            over = length[live] == depth
            good = over & (self.final[state] == 1)
            out[live[good]] = total[good]
            live, state, total = live[~over], state[~over], total[~over]
        return out

    def ids(self, words: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`Vocabulary.merge`: known words from the automaton, the others merged exactly."""
        number = self.number(words)
        unseen = np.flatnonzero(number < 0)
        pool, start, count = vocab.merge(words.take(pa.array(unseen)) if len(unseen) else words.slice(0, 0))
        known = number >= 0
        begin, length = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[known], length[known] = self.at[number[known]], self.at[number[known] + 1] - self.at[number[known]]
        begin[unseen], length[unseen] = start + len(self.tokens), count
        return np.concatenate([self.tokens, pool]), begin, length


def frequent_words(docs: DataFrame, vocab_path: str, size: int = 1 << 16, least: int = 2, longest: int = 64, text_col: str = "text") -> list[bytes]:
    """The most frequent words of all texts, ``size`` at most, of ``least`` occurrences at least and
    ``longest`` bytes at most, so what reaches the driver is bounded; other words are merged when met.

    A histogram of the counts (32 steps to each doubling) tells the count from which the words are
    few enough, so no task sends more than its share of those to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = tuple(vocabulary(vocab_path).specials)
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column(0))
            bounds, _ = word_bounds(data, offsets, specials)
            if len(bounds) > 1:
                words = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
                counts = pc.value_counts(words)
                short = pc.less_equal(pc.binary_length(counts.field("values")), longest)
                yield pa.RecordBatch.from_arrays([counts.field("values").filter(short), counts.field("counts").filter(short)], ["word", "n"])

    texts = only(docs, text_col).select(F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = arrow_map(texts, "word binary, n bigint", count)
    total = counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    total = written(total.withColumn("step", F.floor(F.log2("n") * 32).cast("int")), "words")
    lowest, kept = None, 0
    for r in sorted(total.groupBy("step").count().collect(), reverse=True):
        if kept + r["count"] > size:
            break
        lowest, kept = r["step"], kept + r["count"]
    out = [] if lowest is None else [bytes(r["word"]) for r in total.filter(F.col("step") >= lowest).select("word").collect()]
    drop_written(total)
    return out


def publish(spark, lexicon: Lexicon) -> str:
    """Put the lexicon where every executor can memory-map it; returns what :func:`opened` takes.

    A shared folder that is a mounted file system is mapped in place; from any other store Spark
    fetches the file once to each executor's own file folder.
    """
    uri = new_uri(spark, "lexicon")
    put_bytes(spark, uri, lexicon.to_bytes())
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return uri
    spark.sparkContext.addFile(uri)
    return "spark-file:" + uri.rpartition("/")[2]


@functools.lru_cache(maxsize=4)
def opened(place: str) -> Lexicon:
    """The published lexicon, mapped once in a process."""
    return Lexicon.open(SparkFiles.get(place.removeprefix("spark-file:")) if place.startswith("spark-file:") else place)


def compile_lexicon(docs: DataFrame, vocab_path: str, size: int = 1 << 16, text_col: str = "text") -> str:
    """Count, compile and publish; returns the lexicon's place."""
    return publish(docs.sparkSession, Lexicon.compile(frequent_words(docs, vocab_path, size, text_col=text_col), vocabulary(vocab_path)))


def encode(docs: DataFrame, vocab_path: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` for every row, in token order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in slices(batches, "text"):
            got = Encoded(*text_bytes(batch.column(1)), vocab, opened(lexicon) if lexicon else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(got.bounds.astype(np.int32)), pa.array(got.ids))], [id_col, "ids"])

    return arrow_map(_texts(docs, id_col, text_col), f"`{id_col}` {type_of(docs, id_col)}, ids array<int>", run)


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` from ``ids_col`` (special tokens kept; broken UTF-8 becomes U+FFFD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            texts = [vocab.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return arrow_map(only(encoded, id_col, ids_col), f"`{id_col}` {type_of(encoded, id_col)}, text string", run)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def round_trip(docs: DataFrame, vocab_path: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids again, and give the digests of both:
    ``id_col, n_tokens, ids_sha256, decoded_sha256``.

    Both strings are put together from the slice's distinct words, so a word's ids are written
    in decimal, and turned back into bytes, once for each slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        decimal = np.array([b"%d," % i for i in range(vocab.size)], object)
        token = np.array(vocab.token_bytes, object)
        for batch in slices(batches, "text"):
            got = Encoded(*text_bytes(batch.column(1)), vocab, opened(lexicon) if lexicon else None)
            cut = np.concatenate([[0], np.cumsum(got.count)])
            flat = got.pool[ragged(got.start, got.count)]
            spelt, decoded = decimal[flat].tolist(), token[flat].tolist()
            written, back = np.empty(len(got.words), object), np.empty(len(got.words), object)
            for w, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                written[w], back[w] = b"".join(spelt[a:b]), b"".join(decoded[a:b])
            out: tuple[list, list] = ([], [])
            for a, b in zip(got.first[:-1].tolist(), got.first[1:].tolist(), strict=True):
                codes = got.code[a:b]
                out[0].append(hashlib.sha256(b"".join(written[codes].tolist())[:-1]).hexdigest())
                text = b"".join(back[codes].tolist())
                out[1].append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(got.bounds).astype(np.int64)), pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(_texts(docs, id_col, text_col), f"`{id_col}` {type_of(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", run)
