"""Toxicity by classifier chains.

Categories are predicted one after another.  Each has a linear model (logistic regression) over
the presence of selected words and word beginnings, and over the log odds of all earlier
categories.  While fitting, those are out-of-fold: a row's earlier probabilities come from models
that have not seen the row or a copy of it (folds go by the text's checksum), so later models learn
from inputs as uncertain as they will be.

The last category is the labelled one.  The earlier ones are kinds of it that the labels do not name
and that are learnt: the labelled positive rows are clustered by the features that tell them from the
others, and a row's cluster is its kind.  Beginnings of words let a model recognise inflected forms it
has not seen.

Defined results: null and empty texts have no features and score by the models' intercepts;
without labelled rows, or with one class only, a category's probability is the sample's share (0
without rows); labels with null id or value are left out and repeated ones average; ties in the
choice of features go to the smaller hash, ties between kinds to the first; an empty table gives an
empty table; columns other than the id and text columns are passed on or not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop_written, fresh_names, give_back, only, slices, text_bytes, type_of, written
from .features import word_features, words
from .quality import labelled_sample

ROWS = 2048  # texts whose features are held at once


@dataclass
class Linear:
    """A logistic regression; ``constant`` replaces it where there was one class only."""

    weights: np.ndarray
    bias: float
    constant: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            p = min(max(self.constant, 1e-6), 1 - 1e-6)
            return np.full(len(x), np.log(p / (1 - p)))
        return x @ self.weights + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), float(self.constant)) if self.constant is not None else _sigmoid(self.logit(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> Linear:
    """Logistic regression with a squared penalty, by accelerated gradient steps.

    Features are put on one scale first, so a rare telling word learns as fast as a common one;
    the rarer class weighs more, by the square root of the classes' ratio.
    """
    if not len(y) or y.min() == y.max():
        return Linear(np.zeros(x.shape[1], np.float32), 0.0, float(y.mean()) if len(y) else 0.0)
    share = float(y.mean())
    mass = np.where(y > 0.5, np.sqrt(max(1.0, (1 - share) / share)), np.sqrt(max(1.0, share / (1 - share))))
    mass = (mass / mass.sum()).astype(np.float32)
    mean = x.mean(0, dtype=np.float64)
    spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x) - mean**2, 0))
    scale = (1 / np.maximum(spread, 0.01)).astype(np.float32)  # goes with the weights: no scaled copy of x
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v = np.random.default_rng(0).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = scale * (x.T @ (x @ (scale * v)))
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.25 * (float(np.linalg.norm(x @ (scale * v)) ** 2) * float(mass.max()) * 1.1 + 1) + penalty)
    w0, b0 = w.copy(), b
    for t in range(rounds):
        m = t / (t + 3)
        yw, yb = w + m * (w - w0), b + m * (b - b0)
        error = (_sigmoid(x @ (scale * yw) + yb) - y).astype(np.float32) * mass
        w0, b0 = w, b
        w = yw - step * (scale * (x.T @ error) + penalty * yw)
        b = yb - step * float(error.sum())
    return Linear(w * scale, b)


@dataclass
class Chain:
    """Categories in order, their models, and the sorted feature hashes that they read."""

    categories: list[str]
    models: list[Linear]
    features: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A column per category; each model reads the earlier ones' log odds."""
        out, odds = [], np.zeros((len(x), 0), np.float32)
        for model in self.models:
            full = np.concatenate([x, odds], 1)
            out.append(model.probability(full))
            odds = np.concatenate([odds, np.clip(model.logit(full), -8, 8)[:, None].astype(np.float32) / 8], 1)
        return np.stack(out, 1).astype(np.float64) if out else np.zeros((len(x), 0))


def fit_chain(x: np.ndarray, labels: dict[str, np.ndarray], features: np.ndarray, fold: np.ndarray | None = None) -> Chain:
    """Fit the categories in their order, each on features and out-of-fold odds of earlier ones;
    ``fold`` has each row's fold (three in turn by default)."""
    odds, models = np.zeros((len(x), 0), np.float32), []
    fold = np.arange(len(x)) % 3 if fold is None else fold
    for number, y in enumerate(labels.values()):
        full = np.concatenate([x, odds], 1)
        models.append(fit_linear(full, y))
        if number + 1 < len(labels):
            unseen = np.zeros(len(x), np.float32)
            for f in np.unique(fold):
                unseen[fold == f] = fit_linear(full[fold != f], y[fold != f]).logit(full[fold == f])
            odds = np.concatenate([odds, np.clip(unseen, -8, 8)[:, None] / 8], 1)
    return Chain(list(labels), models, features)


def learnt_kinds(x: np.ndarray, y: np.ndarray, kinds: int, rounds: int = 20) -> np.ndarray:
    """Each row's kind, -1 for rows of label 0 and rows without any telling feature.

    Rows of label 1 are vectors of the features that are more frequent among them than elsewhere, by
    the log of that ratio; they are clustered by cosine, from rows far from each other on.
    """
    out, rows = np.full(len(y), -1), np.flatnonzero(y > 0.5)
    if not len(rows) or not kinds:
        return out
    often, else_ = x[rows].mean(0), x[y <= 0.5].mean(0) if len(rows) < len(y) else np.zeros(x.shape[1])
    tells = np.log((often + 1e-3) / (else_ + 1e-3))
    points = x[rows] * np.where(tells > 1, tells, 0)
    norm = np.linalg.norm(points, axis=1)
    rows, points = rows[norm > 0], points[norm > 0] / norm[norm > 0, None]
    if not len(rows):
        return out
    chosen, near = [int(np.argmax(points @ points.mean(0)))], np.full(len(points), -1.0)
    while len(chosen) < min(kinds, len(points)):
        near = np.maximum(near, points @ points[chosen[-1]])
        chosen.append(int(np.argmin(np.round(near, 6))))
    middle = points[chosen]
    for _ in range(rounds):
        own = np.argmax(np.round(points @ middle.T, 6), axis=1)
        for k in range(len(middle)):
            if (own == k).any():
                mean = points[own == k].mean(0)
                middle[k] = mean / np.linalg.norm(mean)
    out[rows] = np.argmax(np.round(points @ middle.T, 6), axis=1)
    return out


def presence(data: bytes, offsets: np.ndarray, features: np.ndarray) -> np.ndarray:
    """A row per text: 1 where one of its words has the feature."""
    out = np.zeros((len(offsets) - 1, len(features)), np.float32)
    row, code, distinct = words(data, offsets)
    if len(features) and len(distinct):
        hashes = word_features(distinct)
        at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
        hit = features[at] == hashes
        telling = hit.any(1)[code]
        row, code = row[telling], code[telling]
        for k in range(hashes.shape[1]):
            good = hit[code, k]
            out[row[good], at[code[good], k]] = 1
    return out


def select_features(rows: DataFrame, most: int, least: float = 6.63) -> np.ndarray:
    """The ``most`` features that tell label 1 apart best (chi-square), of ``id, text, label``; none
    below ``least``, which a feature without any bearing on the label reaches once in a hundred times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, code, distinct = words(*text_bytes(batch.column(1)))
            if not len(distinct):
                continue
            hashes = word_features(distinct)
            label = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            pair = np.unique(row.astype(np.int64) * len(distinct) + code)
            row, code = pair // len(distinct), pair % len(distinct)
            seen = _pairs(row, hashes, code)
            feature, number = np.unique(seen[:, 1], return_inverse=True)
            n = np.bincount(number)
            toxic = np.bincount(number, weights=label[seen[:, 0]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(n), pa.array(toxic)], ["feature", "n", "toxic"])

    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).head()
    counted = arrow_map(rows.select("id", "text", "label"), "feature bigint, n bigint, toxic bigint", count).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    n, toxic = float(total["n"]), float(total["toxic"])
    if not 0 < toxic < n:
        return np.zeros(0, np.int64)
    expected = F.col("n") * toxic / n
    chi = (F.col("toxic") - expected) ** 2 / (expected * (1 - F.col("n") / (n + 1)))
    best = counted.filter("n >= 3").withColumn("chi", F.round(chi, 6)).filter(F.col("chi") >= least).orderBy(F.desc("chi"), "feature").limit(most)
    return np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64))


def _pairs(row: np.ndarray, hashes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Distinct (row, feature hash) pairs."""
    keys = np.unique((row[:, None] << 32 | hashes[code]).ravel())
    return np.stack([keys >> 32, keys & 0xFFFFFFFF], 1)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", kinds: int = 4, sample: int = 8192, features: int = 1024, folds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on at most ``sample`` labelled rows that are not held out; ``sample`` and ``features``
    bound what reaches the driver (a bit per feature and row)."""
    rows = written(labelled_sample(docs, labels, label_col, sample, id_col, text_col).select("id", "text", "label"), "toxic-sample")
    chosen = select_features(rows, features)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", rows=ROWS):
            x = np.packbits(presence(*text_bytes(batch.column(1)), chosen).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(3)], ["id", "label", "x", "fold"])

    folded = rows.select("id", "text", "label", (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % folds).alias("fold"))
    marked = arrow_map(folded, f"id {type_of(rows, 'id')}, label int, x binary, fold bigint", mark)
    got = marked.orderBy(F.xxhash64("id"), "id", "x", "label").limit(sample).toArrow()
    drop_written(rows)
    bits = np.frombuffer(b"".join(got.column("x").to_pylist()), np.uint8).reshape(got.num_rows, -(-len(chosen) // 8))
    x = np.unpackbits(bits, axis=1, count=len(chosen)).astype(np.float32) if len(chosen) else np.zeros((got.num_rows, 0), np.float32)
    y = got.column("label").to_numpy().astype(np.float64)
    kind = learnt_kinds(x, y, kinds)
    learnt = {f"kind_{k + 1}": (kind == k).astype(np.float64) for k in range(kinds)}
    chain = fit_chain(x, learnt | {label_col: y}, chosen, got.column("fold").to_numpy())
    del got, bits, x
    give_back()
    return chain


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``id_col``, a probability per category, ``score`` (the last one) and ``predicted`` for every
    row; with ``keep`` only ``score`` and ``predicted``, behind all columns of the table, which keep their
    values (the new ones are ``score_2``, ``predicted_2``, ... where it has such columns)."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    extra = [c for c in docs.columns if c not in (id_col, text_col)] if keep else []
    names = [id_col, text_col, *extra] if keep else [id_col]
    told = [] if keep else [f"p_{c}" for c in chain.categories]
    last = fresh_names([*names, *told], ["score", "predicted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, rows=ROWS):
            p = shared.value.probabilities(presence(*text_bytes(batch.column(1)), shared.value.features))
            kept = [batch.column(i) for i in range(len(names))]
            score = p[:, -1]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(len(told))), pa.array(np.ascontiguousarray(score)), pa.array((score >= 0.5).astype(np.int32))], [*names, *told, *last])

    source = only(docs, id_col, text_col, *extra)
    source = source.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    schema = ", ".join([*(f"`{n}` {type_of(source, n)}" for n in names), *(f"`{n}` double" for n in told)])
    return arrow_map(source, f"{schema}, `{last[0]}` double, `{last[1]}` int", run)
