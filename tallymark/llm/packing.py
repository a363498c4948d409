"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are dealt at random over partitions of even size (a round-robin exchange), so every
partition holds a fair sample of long and short ones however the input is ordered, and repeated rows are
spread.  A partition tokenizes its documents, cuts those longer than a sequence, and packs the
pieces best-fit, longest first, into bins of ``size`` tokens.  Full pieces and nearly full bins
are emitted at once.  The emptiest underfull bins of each partition travel up a tree of ``fan``
children per node as single items: each node best-fits the bins it receives into fuller ones,
emits what is nearly full and passes its emptiest on, until one node is left.

A node passes ``carry`` bins at most, so it reads ``fan * carry`` rows at most at any scale, and the
tree has log(partitions) levels.  What it does not pass is emitted as it is: no piece is ever
dropped.  These are its fuller bins; as partitions are samples of one whole, another node has the same
mix to offer, so they could hardly be filled elsewhere (the tests compare with one best-fit run over
all pieces).  A partition of more than 64 MB of pieces packs in several runs, each a sample as well.

A piece's sequence is found by following its bin through the tree's moves; the moves are as many
as the carried bins, and only pieces of carried bins take part in that join.

Defined results: null and empty texts are the end token alone; a text of any length is cut
whole; repeated rows are packed each; an empty table gives an empty table; columns other than
the id and text columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoded, _texts, vocabulary
from .common import SLICE_BYTES, arrow_map, drop_written, slices, text_bytes, type_of, written

BIN_BITS = 33


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and place in it, and each bin's fill.

    Lengths are whole numbers up to ``size``, so open bins are kept by their free room and the
    tightest room that fits is found by bisection over the rooms in use: n log(size).
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for item, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect_left(rooms, length)
        if at == len(rooms):
            chosen = len(fills)
            fills.append(0)
        else:
            room = rooms[at]
            chosen = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += length
        if room := size - fills[chosen]:
            if room not in by_room:
                by_room[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            by_room[room].append(chosen)
    return bins, offsets, np.array(fills, np.int64)


def _carried(fills: np.ndarray, size: int, full: float, carry: int) -> np.ndarray:
    """The emptiest bins, ``carry`` at most, that are not nearly full."""
    under = np.flatnonzero(fills < full * size)
    return under[np.argsort(fills[under], kind="stable")][:carry]


def pieces(docs: DataFrame, vocab_path: str, size: int = 1024, end_id: int | None = 2, full: float = 0.99, carry: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack within each partition: a row per piece with its bin, its place
    there, the bin's fill, and whether the bin is to travel on.  ``ids`` are little-endian
    unsigned 32-bit ids."""
    names = [id_col, "piece", "start", "length", "ids", "bin", "offset", "fill", "carried"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, part = vocabulary(vocab_path), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], np.uint32).tobytes()
        made = 0

        def rows(columns: list, bins: np.ndarray, offsets: np.ndarray, fills: np.ndarray, carried: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*columns, pa.array(bins), pa.array(offsets), pa.array(fills), pa.array(carried)], names)

        held: list[list] = []  # the partition's pieces shorter than a sequence, as columns

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal made
            columns = [pa.concat_arrays([h[i] for h in held]) for i in range(5)]
            bins, offsets, fills = best_fit(columns[3].to_numpy(), size)
            moving = np.zeros(len(fills), bool)
            moving[_carried(fills, size, full, carry)] = True
            yield rows(columns, (part << BIN_BITS) + made + bins, offsets, fills[bins], moving[bins])
            made += len(fills)
            held.clear()

        waiting = 0
        for batch in slices(batches, "text"):
            got = Encoded(*text_bytes(batch.column(1)), vocab)
            raw, bounds = got.ids.astype("<u4").tobytes(), got.bounds.tolist()
            doc, number, start, length, ids = [], [], [], [], []
            for i in range(batch.num_rows):
                text = raw[4 * bounds[i] : 4 * bounds[i + 1]] + end
                tokens = len(text) // 4
                first = tokens % size or min(tokens, size)
                cuts = [0, *range(first, tokens + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc.append(i)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(text[4 * a : 4 * b])
            columns = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
            whole = np.array(length, np.int64) == size
            if (n := int(whole.sum())):
                alone = [c.filter(pa.array(whole)) for c in columns]
                yield rows(alone, (part << BIN_BITS) + made + np.arange(n), np.zeros(n, np.int64), np.full(n, size), np.zeros(n, bool))
                made += n
            if n < len(whole):
                held.append([c.filter(pa.array(~whole)) for c in columns])
                waiting += sum(c.nbytes for c in held[-1])
            if waiting > 32 * SLICE_BYTES:  # a partition of any size: it packs in runs of bounded memory
                yield from packed()
                waiting = 0
        if held:
            yield from packed()

    schema = f"`{id_col}` {type_of(docs, id_col)}, piece int, start bigint, length bigint, ids binary, bin bigint, offset bigint, fill bigint, carried boolean"
    dealt = _texts(docs, id_col, text_col).hint("rebalance")  # round robin, partitions by size
    return arrow_map(dealt, schema, run)


def _level(bins: DataFrame, size: int, full: float, carry: int, fan: int) -> DataFrame:
    """One level of the tree: ``node, bin, fill`` -> each bin's new bin and place there."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        into, offsets, fills = best_fit(frame["fill"].to_numpy(np.int64), size)
        names = frame["bin"].to_numpy()[np.unique(into, return_index=True)[1]]  # a new bin takes the name of its first
        moving = np.zeros(len(fills), bool)
        moving[_carried(fills, size, full, carry)] = True
        return pd.DataFrame({"bin": frame["bin"], "to": names[into], "base": offsets, "fill": fills[into], "carried": moving[into], "node": frame["parent"]})

    parents = bins.select(F.expr(f"node div {fan}").alias("parent"), "bin", "fill")
    return parents.groupBy("parent").applyInPandas(pack, "bin bigint, to bigint, base bigint, fill bigint, carried boolean, node bigint")


def pack(docs: DataFrame, vocab_path: str, size: int = 1024, end_id: int | None = 2, full: float = 0.99, carry: int = 1024, fan: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents; a row per piece:
    ``id_col, piece, start, length, ids, sequence_id, offset``.

    A document's ids and ``end_id`` are one piece, or if longer than ``size`` pieces of ``size``
    tokens, of which the first may be shorter.  ``offset`` is gapless in each sequence.
    """
    if size < 1 or carry < 1 or fan < 2:
        raise ValueError("size and carry are at least 1, fan at least 2")
    if end_id is None:
        raise ValueError("an end id keeps empty texts packable")
    cut = written(pieces(docs, vocab_path, size, end_id, full, carry, id_col, text_col), "pieces")
    kept = [f"`{id_col}`", "piece", "start", "length", "ids"]
    carried = cut.filter("carried")
    level = carried.filter("offset = 0").select(F.expr(f"shiftright(bin, {BIN_BITS})").alias("node"), "bin", "fill")
    nodes = level.agg(F.max("node").alias("n")).head()["n"]
    if nodes is None:  # nothing is left over
        return cut.selectExpr(*kept, "bin as sequence_id", "offset")
    moves = last = None
    while nodes > 0 or moves is None:
        step = written(_level(level, size, full, carry, fan), "bins")
        if moves is None:
            moves = step.selectExpr("bin", "to", "base")
        else:  # bins that moved on with their new bin
            further = step.selectExpr("bin as to", "to as next", "base as more")
            before, moves = moves, written(moves.join(further, "to", "left").selectExpr("bin", "coalesce(next, to) as to", "base + coalesce(more, 0) as base"), "moves")
            drop_written(before)
            drop_written(last)
        level, last = step.filter("carried and base = 0").selectExpr("node", "to as bin", "fill"), step
        nodes = nodes // fan
    placed = carried.join(moves, "bin").selectExpr(*kept, "to as sequence_id", "base + offset as offset")
    return cut.filter("not carried").selectExpr(*kept, "bin as sequence_id", "offset").unionByName(placed)


def packed_sequences(packed: DataFrame, size: int = 1024) -> DataFrame:
    """Sequences as rows, ``sequence_id, ids`` (binary, in order of offset): the training file."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda out, p: F.concat(out, p["ids"])).alias("ids"))
