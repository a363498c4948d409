"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors are dealt to coarse clusters (centres fitted on a bounded sample) and, within a cluster,
by hash into chunks of bounded size.  Each chunk is stored once as a row of an index: its forward
index, the whole-numbered matrix in an order in which similar vectors stand together, is cut into
document-range blocks and those into inner blocks.  For every term (a dimension with a sign) a
block's maximum is known; for a query the summed term maxima bound every score in the block.

1. Every query gets a first threshold, its kth score within the sample.
2. Packages of queries meet pages of chunk maxima; a package and a chunk whose bound lies below
   the thresholds of all the package's queries never meet, so the chunk is not copied there.
3. Where they meet, blocks are scored in falling order of their bounds until these fall below the
   query's kth score so far, and within a block the inner blocks whose bounds reach it.

How much is pruned depends on the data: blocks of like vectors have tight maxima.  A task holds one
package and one chunk, so its memory does not grow with the data.

Defined results: components are floored after scaling and may be of any finite size; sums are exact
(in doubles, 64-bit or unbounded whole numbers, whichever suffices), and a score beyond 64 bits is
the nearest 64-bit number (a product with the scale beyond all doubles, the largest one); shorter vectors count as padded by zeros; rows whose id or vector is
null, or whose vector holds null or non-finite components, take no part; empty vectors score 0;
candidates with the query's own id are left out; repeated candidate rows are candidates each,
repeated query rows are one query; a query id with several vectors asks with each of them, and its
k best are taken from all those answers, so that a candidate may come up once for each vector; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, drop_written, only, ship, written

LEAST, MOST = -(2**63), 2**63 - 1
PAGE = 512  # chunks whose maxima meet a package of queries at once
PRODUCTS = 1 << 21  # products of components that are held at once


def quantized(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x``: usable rows with whole-numbered components (as doubles, which hold them exactly)."""
    raw = F.col("raw")
    usable = F.col("vec_id").isNotNull() & raw.isNotNull() & F.coalesce(F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    limit = F.lit(np.finfo(np.float64).max / max(1.0, scale))  # a product beyond all doubles is the largest one
    # FLOOR of a double is a 64-bit number in SQL; beyond 2**53 every double is whole already
    down = lambda v: F.when(F.abs(v) < F.lit(2.0**53), F.floor(v).cast("double")).otherwise(v)
    whole = F.transform(raw, lambda v: down(F.greatest(F.least(v, limit), -limit) * F.lit(float(scale))))
    return only(vectors, id_col, vector_col).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("raw")).filter(usable).select("vec_id", whole.alias("x"))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _dense(column: pa.ListArray, least: int) -> np.ndarray:
    """The rows of a list column as a matrix of ``least`` columns or more."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), max(least, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


def _pack(matrix: np.ndarray) -> tuple[str, int, bytes]:
    """The matrix in the smallest kind of number that holds it."""
    top = np.abs(matrix).max(initial=0)
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return kind, matrix.shape[1], np.ascontiguousarray(matrix.astype(kind)).tobytes()


def _unpack(kind: str, width: int, data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(rows, width).astype(np.float64)


def _widened(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] == width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _exactly(*matrices: np.ndarray) -> list[np.ndarray]:
    """The matrices as numbers in which all inner products of the first with the others are exact."""
    top = [int(np.abs(m).max(initial=0)) for m in matrices]
    most = top[0] * max(top[1:]) * max(1, matrices[0].shape[1])
    if most < 2**53:
        return list(matrices)
    if most < 2**63:
        return [m.astype(np.int64) for m in matrices]
    return [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in matrices]


def _as_long(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(s, LEAST), MOST) for s in scores.ravel()], np.int64).reshape(scores.shape) if scores.dtype == object else scores.astype(np.int64)


def _bounds(queries: np.ndarray, highest: np.ndarray, lowest: np.ndarray) -> np.ndarray:
    """Summed term maxima: no vector between ``lowest`` and ``highest`` scores more."""
    return _as_long(np.maximum(queries, 0) @ highest.T + np.minimum(queries, 0) @ lowest.T)


def _products(queries: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Inner products of each query with the vectors of its own inner block."""
    return (queries[:, None, :] * blocks).sum(2) if queries.dtype == object else np.einsum("pd,pid->pi", queries, blocks)


def similar_order(vectors: np.ndarray) -> np.ndarray:
    """An order in which each vector is followed by the one most like it that is left."""
    norm = np.linalg.norm(vectors / max(1.0, np.abs(vectors).max(initial=0)), axis=1, keepdims=True)
    unit = np.divide(vectors / max(1.0, np.abs(vectors).max(initial=0)), norm, out=np.zeros_like(vectors), where=norm > 0)
    like = (unit @ unit.T).astype(np.float32)
    out, at = np.empty(len(vectors), np.int64), 0
    for i in range(len(vectors)):
        out[i] = at
        like[:, at] = -9
        at = int(np.argmax(like[at]))
    return out


def prune_and_score(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = 64, inner: int = 2, seeds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Each query's k best (score, id) pairs in one chunk that reach its seed, how many there are, and
    how many (query, vector) pairs were scored for them."""
    n, k_all = len(ids), np.arange(k)
    queries, vectors = _exactly(queries, vectors)
    inner_at = np.arange(0, n, inner)
    high_in, low_in = np.maximum.reduceat(vectors, inner_at), np.minimum.reduceat(vectors, inner_at)
    per = max(1, block // inner)
    outer_at = np.arange(0, len(inner_at), per)
    bounds = _bounds(queries, np.maximum.reduceat(high_in, outer_at), np.minimum.reduceat(low_in, outer_at))
    turn = np.argsort(~bounds, axis=1, kind="stable")
    best = np.full((len(queries), k, 2), LEAST, np.int64)
    filled = np.zeros(len(queries), np.int64)
    floor = np.full(len(queries), LEAST, np.int64) if seeds is None else seeds.copy()
    live, scored = np.arange(len(queries)), 0
    for round_ in range(len(outer_at)):
        at = turn[live, round_]
        goes_on = bounds[live, at] >= floor[live]
        live, at = live[goes_on], at[goes_on]
        if not len(live):
            break
        by_block = np.argsort(at, kind="stable")
        for some in np.split(by_block, np.flatnonzero(np.diff(at[by_block])) + 1):
            a = int(outer_at[at[some[0]]])
            rows = live[some]
            reach = _bounds(queries[rows], high_in[a : a + per], low_in[a : a + per]) >= floor[rows][:, None]
            row, cell = np.nonzero(reach)
            if not len(row):
                continue
            own = (a + cell)[:, None] * inner + np.arange(inner)[None, :]
            there = own < n
            own = np.minimum(own, n - 1)
            step = max(1, PRODUCTS // max(1, inner * queries.shape[1]))
            scores = np.concatenate([_as_long(_products(queries[rows[row[i : i + step]]], vectors[own[i : i + step]])) for i in range(0, len(row), step)])
            scored += int(there.sum())
            good = there & (ids[own] != query_ids[rows[row]][:, None]) & (scores >= floor[rows[row]][:, None])
            who, member = np.nonzero(good)
            if not len(who):
                continue
            # the k best of old and new, by query, falling score and id
            old = k_all[None, :] < filled[rows][:, None]
            query = np.concatenate([np.nonzero(old)[0], row[who]])
            score = np.concatenate([best[rows][old][:, 0], scores[who, member]])
            name = np.concatenate([best[rows][old][:, 1], ids[own[who, member]]])
            order = np.lexsort((name, ~score, query))
            query, score, name = query[order], score[order], name[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            kept = place < k
            best[rows[query[kept]], place[kept], 0], best[rows[query[kept]], place[kept], 1] = score[kept], name[kept]
            filled[rows] = np.bincount(query[kept], minlength=len(rows))
            full = rows[filled[rows] == k]
            floor[full] = np.maximum(floor[full], best[full, k - 1, 0])
    return best, filled, scored


def seeds_of(queries: np.ndarray, query_ids: np.ndarray, sample: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's kth score within the sample: its kth score of all can only be higher."""
    out = np.full(len(queries), LEAST, np.int64)
    if len(ids) >= k:
        exact, others = _exactly(queries, sample)
        for a in range(0, len(queries), 256):
            scores = _as_long(exact[a : a + 256] @ others.T)
            scores[ids[None, :] == query_ids[a : a + 256][:, None]] = LEAST
            out[a : a + 256] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    return out


def centres(sample: np.ndarray, clusters: int, rounds: int = 6) -> np.ndarray:
    """Directions of coarse clusters of the sample (first ones far from each other, then means)."""
    if not clusters:
        return sample[:0]
    top = max(1.0, np.abs(sample).max(initial=0))
    norm = np.linalg.norm(sample / top, axis=1, keepdims=True)
    unit = np.divide(sample / top, norm, out=np.zeros_like(sample), where=norm > 0)
    if len(unit) <= clusters:
        return unit
    near, chosen = np.full(len(unit), -9.0), [0]
    for _ in range(clusters - 1):
        near = np.maximum(near, unit @ unit[chosen[-1]])
        chosen.append(int(np.argmin(near)))
    made = unit[chosen]
    for _ in range(rounds):
        own = np.argmax(unit @ made.T, axis=1)
        sums = np.zeros_like(made)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        made = np.divide(sums, size, out=made.copy(), where=size > 0)
    return made


def _sampled(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, ``most`` at the most, the first by their hash, as ids and matrix."""
    got = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(most).toArrow()
    found = sorted({(i, tuple(x)) for i, x in zip(got.column("vec_id").to_pylist(), got.column("x").to_pylist(), strict=True)})
    return np.array([i for i, _ in found], np.int64), _matrix([x for _, x in found], max((len(x) for _, x in found), default=0))


def _clustered(rows: DataFrame, middle: np.ndarray) -> DataFrame:
    """``vec_id, x, copies, cluster``: distinct rows, how often they stand there, and the likest centre."""
    shared = rows.sparkSession.sparkContext.broadcast(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _dense(batch.column(1), shared.value.shape[1])
            matrix /= max(1.0, np.abs(matrix).max(initial=0))
            own = np.argmax(matrix @ _widened(shared.value, matrix.shape[1]).T, axis=1) if len(shared.value) else np.zeros(len(matrix), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], ["vec_id", "x", "copies", "cluster"])

    counted = rows.groupBy("vec_id", "x").agg(F.count("*").alias("copies"))  # a hot row is one row behind this
    return arrow_map(counted, "vec_id bigint, x array<double>, copies bigint, cluster int", run)


def _dealt(rows: DataFrame, of: dict[int, int], most: int) -> tuple[Column, int]:
    """A row's chunk, of about ``most`` rows of one cluster, and the number of chunks; ``of`` has the
    clusters' sizes (a bounded number of clusters)."""
    parts = [max(1, -(-of.get(c, 0) // most)) for c in range(max(of, default=0) + 1)]
    begin = np.concatenate([[0], np.cumsum(parts)]).tolist()
    own = F.pmod(F.xxhash64("vec_id", "x"), F.get(F.lit(parts), F.col("cluster")).cast("long"))
    return F.get(F.lit(begin[:-1]), F.col("cluster")).cast("long") + own, begin[-1]


def build_index(rows: DataFrame, k: int, most: int, sizes: dict[int, int]) -> DataFrame:
    """A row per chunk: ``part, n, ids, kind, width, x`` in order of likeness, and its term maxima
    ``high, low``.  Of equal rows more than k cannot be among the k best, so k of them stand there."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable", ignore_index=True)
        x = _matrix(frame["x"].to_list(), int(frame["x"].map(len).max()))
        again = np.repeat(np.arange(len(x)), np.minimum(frame["copies"].to_numpy(np.int64), k))
        x, ids = x[again], frame["vec_id"].to_numpy(np.int64)[again]
        order = similar_order(x)
        x, ids = x[order], ids[order]
        kind, width, data = _pack(x)
        return pd.DataFrame({"part": [frame["part"][0]], "n": [len(ids)], "ids": [ids.tobytes()], "kind": [kind], "width": [width], "x": [data], "high": [x.max(0).tobytes()], "low": [x.min(0).tobytes()]})

    part, _ = _dealt(rows, sizes, most)
    return rows.withColumn("part", part).groupBy("part").applyInPandas(build, "part bigint, n bigint, ids binary, kind string, width int, x binary, high binary, low binary")


def package_queries(rows: DataFrame, sample: tuple[np.ndarray, np.ndarray], k: int, most: int, sizes: dict[int, int]) -> DataFrame:
    """A row per package of like queries: ``query_part, n_q, query_ids, query_kind, query_width, q, seeds``."""
    shared = rows.sparkSession.sparkContext.broadcast(sample)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable", ignore_index=True)
        ids, others = shared.value
        width = max(int(frame["x"].map(len).max()), others.shape[1])
        x, own = _matrix(frame["x"].to_list(), width), frame["vec_id"].to_numpy(np.int64)
        seeds = seeds_of(x, own, _widened(others, width), ids, k)
        kind, width, data = _pack(x)
        return pd.DataFrame({"query_part": [frame["part"][0]], "n_q": [len(own)], "query_ids": [own.tobytes()], "query_kind": [kind], "query_width": [width], "q": [data], "seeds": [seeds.tobytes()]})

    part, _ = _dealt(rows, sizes, most)
    return rows.withColumn("part", part).groupBy("part").applyInPandas(build, "query_part bigint, n_q bigint, query_ids binary, query_kind string, query_width int, q binary, seeds binary")


def _queries(row: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, seeds = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["seeds"], np.int64)
    return _widened(_unpack(row["query_kind"], row["query_width"], row["q"], row["n_q"]), width), own, seeds


def meetings(packages: DataFrame, index: DataFrame, chunks: int) -> DataFrame:
    """``query_part, part``: the chunks that a package's queries may find one of their k best in."""
    pages = max(1, -(-chunks // PAGE))
    maxima = index.select(F.expr(f"part div {PAGE}").alias("page"), "part", "high", "low")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long")))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            high, low = ([np.frombuffer(v, np.float64) for v in right[c]] for c in ("high", "low"))
            width = max([*left["query_width"], *(len(v) for v in high)])
            high, low = _matrix(high, width), _matrix(low, width)
            for _, row in left.iterrows():
                x, _, seeds = _queries(row, width)
                x, up, down = _exactly(x, high, low)
                reached = (_bounds(x, up, down) >= seeds[:, None]).any(0)
                out.append(pd.DataFrame({"query_part": row["query_part"], "part": right["part"][reached]}))
        return pd.concat(out) if out else pd.DataFrame({"query_part": [], "part": []}).astype("int64")

    asked = packages.withColumn("page", every)
    # a page goes to every package
    copies = maxima.join(asked.select(F.col("page"), F.col("query_part").alias("to")), "page")
    return asked.groupBy("page", "query_part").cogroup(copies.groupBy("page", "to")).applyInPandas(meet, "query_part bigint, part bigint")


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, block: int = 64, inner: int = 2, chunk: int = 2048, query_chunk: int = 512,
    sample: int = 2048, clusters: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id satisfies ``is_query`` (a condition
    on ``vec_id``) the k best other rows, ties to the smaller id.

    ``sample`` bounds the rows that the driver fits ``clusters`` centres on and that give the first
    thresholds; every row is indexed and the result does not depend on it.
    """
    rows = quantized(vectors, scale, id_col, vector_col)
    known = _sampled(rows, sample)
    few = min(clusters, -(-rows.count() // chunk))  # no more clusters than chunks
    clustered = written(_clustered(rows, centres(known[1], few)), "vectors")
    held = {r["cluster"]: (r["n"], r["q"]) for r in clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect()}
    sizes = {c: n for c, (n, _) in held.items()}
    ship(vectors.sparkSession)
    index = written(build_index(clustered, k, chunk, sizes), "index")
    packages = written(package_queries(clustered.filter(is_query), known, k, query_chunk, {c: q for c, (_, q) in held.items()}), "queries")
    drop_written(clustered)
    chunks = sum(max(1, -(-n // chunk)) for n in sizes.values())

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in frame.iterrows():
            width = max(row["width"], row["query_width"])
            x, own, seeds = _queries(row, width)
            ids = np.frombuffer(row["ids"], np.int64)
            best, filled, _ = prune_and_score(x, own, _widened(_unpack(row["kind"], row["width"], row["x"], row["n"]), width), ids, k, block, inner, seeds)
            there = np.arange(k)[None, :] < filled[:, None]
            out.append(pd.DataFrame({"query_id": np.repeat(own, filled), "vec_id": best[there][:, 1], "score": best[there][:, 0]}))
        return pd.concat(out)

    met = meetings(packages, index, chunks).join(packages, "query_part").join(index.drop("high", "low"), "part")
    found = met.groupBy("part", "query_part").applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
