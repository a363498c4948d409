"""Quality classifier by nearest-neighbour voting in a latent semantic space.

A bounded sample of labelled texts is turned into weighted n-gram counts, whose leading singular
directions span the latent space.  The labelled latent vectors are broadcast (their number is the
sample's bound); every document's cosine products with all of them are computed exactly, block by
block, and the labels of its nearest neighbours vote with their similarity.

Two families of counts, each put on one scale, make up a text's vector: its words, pairs of
neighbouring words and word parts (what it says, and whether its words are words), and n-grams of its
shape (letter runs, blanks, signs, repeated words).  A score depends on the text alone.

Defined results: null and empty texts, and texts without any feature the sample knows, score the
sample's share of label 1; without labelled rows every score is 0.5; rows of ``labels`` with null
id or label are left out and repeated ones average; cosines count to 9 digits, and ties among
neighbours go to the sample's order (the id's hash, then the id, then the text's), whatever the block;
an empty table gives an empty table; other columns are not read, or with ``keep`` passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh_names, give_back, only, slices, text_bytes, type_of
from .features import shape_counts, word_counts

SHAPE, WORDS = 2048, 4096
FEATURES = SHAPE + WORDS
ROWS = 256  # texts whose counts are held at once


def text_counts(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """A row of counts for each text: shapes, then words."""
    return np.concatenate([shape_counts(data, offsets, SHAPE), word_counts(data, offsets, WORDS)], axis=1)


@dataclass
class Model:
    """What is broadcast: weights and projection of features, unit vectors and labels of the sample."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    sharpness: float
    cut: int

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit((_weighted(counts, self.weight, self.cut) @ self.basis).astype(np.float64))

    def score(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest neighbours."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        latent = self.latent(counts)
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(latent), block):
            some = latent[a : a + block]
            cosine = np.round(some @ self.vectors.T, 9)
            last = np.partition(cosine, len(self.labels) - k, axis=1)[:, -k][:, None]  # the kth highest
            near, tied = cosine > last, cosine == last
            near |= tied & (np.cumsum(tied, axis=1) <= k - near.sum(1, keepdims=True))
            near = np.nonzero(near)[1].reshape(-1, k)
            vote = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** self.sharpness
            total = vote.sum(1)
            known = (total > 0) & (np.abs(some).sum(1) > 0)
            out[a : a + block][known] = ((vote * self.labels[near]).sum(1)[known] / total[known]).clip(0, 1)
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 1e-9)


def _weighted(counts: np.ndarray, weight: np.ndarray, cut: int) -> np.ndarray:
    """Square roots of relative counts, weighted by rarity, as unit vectors; features before ``cut``
    and those from it on each make up half of a vector."""
    halves = []
    for some, of in ((counts[:, :cut], weight[:cut]), (counts[:, cut:], weight[cut:])):
        total = some.sum(1, keepdims=True)
        halves.append(_unit(np.sqrt(np.divide(some, total, out=np.zeros_like(some), where=total > 0)) * of))
    return _unit(np.concatenate(halves, axis=1))


def _directions(rows: np.ndarray, number: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular directions, by iterated products with a few more random ones."""
    number = min(number, rows.shape[1])
    made = np.random.default_rng(0).normal(size=(rows.shape[1], min(rows.shape[1], number + 16)))
    for _ in range(rounds):
        made = np.linalg.qr(rows.T @ (rows @ made.astype(rows.dtype)))[0]
    _, _, turn = np.linalg.svd((rows @ made.astype(rows.dtype)).astype(np.float64), full_matrices=False)
    return np.ascontiguousarray((made @ turn.T)[:, :number]).astype(np.float32)


def fit_model(counts: np.ndarray, labels: np.ndarray, dimensions: int = 96, neighbours: int = 15, sharpness: float = 8.0, cut: int = SHAPE, consume: bool = False) -> Model:
    """The latent space of a sample's counts, spanned by their leading singular directions; with
    ``consume`` the counts' memory is used for the weighted rows."""
    cut = min(cut, counts.shape[1])
    if not len(labels):
        return Model(np.ones(counts.shape[1], np.float32), np.zeros((counts.shape[1], 1), np.float32), np.zeros((0, 1)), np.zeros(0), neighbours, sharpness, cut)
    seen = np.count_nonzero(counts, axis=0)
    weight = np.where(seen > 0, np.log((1 + len(counts)) / (1 + seen)) + 1, 0).astype(np.float32)
    rows = counts if consume else np.empty(counts.shape, np.float32)
    for a in range(0, len(rows), ROWS):  # copies of a block at a time, not of the sample
        rows[a : a + ROWS] = _weighted(counts[a : a + ROWS], weight, cut)
    basis = _directions(rows, dimensions)
    return Model(weight, basis, _unit((rows @ basis).astype(np.float64)), labels.astype(np.float64), neighbours, sharpness, cut)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are not learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int, id_col: str, text_col: str) -> DataFrame:
    """``id, text, label`` of at most ``sample`` labelled rows that are not held out, the first by
    the hash of their ids, so the choice does not depend on the data's order."""
    told = only(labels, id_col, label_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label"))
    told = told.filter("id is not null and label is not null").filter(~held_out("id")).groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = told.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 4096, dimensions: int = 96, neighbours: int = 15, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``sample`` labelled rows (the parameter bounds what reaches the driver)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", rows=ROWS):
            counts = text_counts(*text_bytes(batch.column(1)))
            cells = [np.flatnonzero(r) for r in counts]
            at = [c.astype("<u2").tobytes() for c in cells]
            n = [r[c].astype("<f4").tobytes() for r, c in zip(counts, cells, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["id", "label", "at", "n"])

    rows = labelled_sample(docs, labels, label_col, sample, id_col, text_col).select("id", "text", "label")
    found = arrow_map(rows, f"id {type_of(rows, 'id')}, label int, at binary, n binary", count).orderBy(F.xxhash64("id"), "id", "at", "n").limit(sample)
    got = found.toArrow()
    counts = np.zeros((got.num_rows, FEATURES), np.float32)
    for row, at, n in zip(counts, got.column("at").to_pylist(), got.column("n").to_pylist(), strict=True):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(n, "<f4")
    model = fit_model(counts, got.column("label").to_numpy().astype(int), dimensions, neighbours, consume=True)
    del got, counts
    give_back()
    return model


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``id_col, score, predicted`` for every row; with ``keep`` behind all columns of the table, which
    keep their values (the new ones are ``score_2``, ``predicted_2``, ... where it has such columns)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [c for c in docs.columns if c not in (id_col, text_col)] if keep else []
    names = [id_col, text_col, *extra] if keep else [id_col]
    told = fresh_names(names, ["score", "predicted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, rows=ROWS):
            score = shared.value.score(text_counts(*text_bytes(batch.column(1))))
            kept = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, *told])

    source = only(docs, id_col, text_col, *extra)
    source = source.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    schema = ", ".join(f"`{n}` {type_of(source, n)}" for n in names)
    return arrow_map(source, f"{schema}, `{told[0]}` double, `{told[1]}` int", run)
