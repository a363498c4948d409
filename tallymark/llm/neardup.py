"""Near-duplicate components by MinHash bands and sequential Bayesian verification.

1. One pass over the texts gives every document its set of word shingles as 64-bit hashes, the
   set's digest and its MinHash signature.  Documents with one digest are one class, so copies
   are never compared.
2. Signatures are cut into bands; classes that share a band's values share a bucket.  Buckets do
   not emit their pairs: every member is paired with the bucket's hub, the member that shares the
   most bucket places, so the pairs are at most as many as the bucket places.
3. Candidates are compared batch after batch of signature values.  After each batch the posterior
   probability (uniform prior) that the similarity reaches the threshold is bounded; a pair below
   the chosen miss probability is pruned.  A member's most similar surviving hub is verified
   exactly on the full sets.
4. Verified links point from members to hubs, a forest whose roots label the components.  Only
   buckets that still hold several components are open.  In those, a class that shares too few
   shingles with all other open classes cannot have a partner and leaves.  The candidates that
   remain are all pairs of open classes of different components that share one of their rarest
   shingles, as partners must; they are compared and verified in the same way.

Exact but for the misses of banding and of pruning, whose probabilities are parameters:
(1 - t**rows)**bands for a link at the threshold t, and ``miss`` at each batch.

A hub, bucket, label, shingle or class that a large share of all rows names is joined in parts
(``spread_join``), so no task gets all its rows.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing;
repeated rows and copies are one class; rows with null ids have no component and link nothing;
ties go to the smaller id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import hot_keys, spread_join
from .common import arrow_map, drop_written, only, slices, text_bytes, type_of, written
from .features import lowered_ascii

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Rule:
    """What counts as a near duplicate, and how candidates are found."""

    words: int = 5
    similarity: Fraction = Fraction(4, 5)
    bands: int = 30
    rows: int = 5
    miss: float = 1e-6

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingle_sets(data: bytes, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingles as 64-bit hashes."""
    raw = lowered_ascii(data)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_SEPARATOR[raw]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    across = np.unique(cut[inside[cut] & inside[cut + 1]]) if len(cut) else cut
    if len(across):
        starts, ends = np.sort(np.concatenate([starts, across])), np.sort(np.concatenate([ends, across]))
    rows = len(offsets) - 1
    if not len(starts):
        return [np.zeros(0, np.uint64)] * rows
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw[inside[1:-1]])]).dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
    first = np.searchsorted(starts, offsets)
    mixed = np.zeros(len(own), np.uint64)
    for i in range(words):  # the shingle that begins at each word
        mixed[: len(own) - i] = (mixed[: len(own) - i] ^ own[i:]) * np.uint64(0x9E3779B97F4A7C15)
        mixed[: len(own) - i] ^= mixed[: len(own) - i] >> np.uint64(29)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(mixed[a : b - words + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(own[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """MinHash signatures, a row per set; sets are not empty."""
    rng = np.random.default_rng(20240229)
    factor = rng.integers(0, 2**32, hashes, np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, hashes, np.uint32)
    flat = np.concatenate(sets)
    flat = ((flat * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), hashes), np.uint32)
    for i in range(hashes):
        value = flat * factor[i]
        value += add[i]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x85EBCA6B)
        out[:, i] = np.minimum.reduceat(value, begin)
    return out


def least_matches(rule: Rule, seen: int) -> int:
    """The fewest matches among ``seen`` signature values that keep a pair: with a uniform prior
    P(similarity >= t | matches) = P(Binomial(seen + 1, t) <= matches)."""
    t, total = float(rule.similarity), 0.0
    for matches in range(seen + 1):
        total += math.comb(seen + 1, matches) * t**matches * (1 - t) ** (seen + 1 - matches)
        if total >= rule.miss:
            return matches
    return seen


def signed(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """``id, n, set, sig``: set size, 128-bit digest and signature (null for empty sets) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(*text_bytes(batch.column(1)), rule.words)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list[bytes | None] = [None] * len(sets)
            if full:
                for i, row in zip(full, signatures([sets[i] for i in full], rule.hashes), strict=True):
                    sig[i] = row.tobytes()
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "set", "sig"])

    return arrow_map(_texts(docs, id_col, text_col), f"id {type_of(docs, id_col)}, n bigint, set binary, sig binary", run)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def places(classes: DataFrame, rule: Rule) -> DataFrame:
    """``set, bucket, members`` of all buckets that hold several classes."""
    width = 4 * rule.rows
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + b * width, width)) for b in range(rule.bands)])
    rows = classes.select("set", F.explode(keys).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    return written(rows.join(shared, "bucket").select("set", "bucket", "members"), "places")


def hub_pairs(member: DataFrame) -> DataFrame:
    """``a, b``: every member of a bucket (``set, bucket, members``) with the bucket's hub."""
    weight = member.groupBy("set").agg(F.sum("members").alias("weight"))
    weighed = member.join(weight, "set")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "set")).alias("hub"))
    hot = hot_keys(member.select("bucket", F.col("members").alias("n")), "bucket", member.count())
    named = spread_join(member, hubs, "bucket", "set", hot)
    return written(named.select(F.col("set").alias("a"), F.col("hub.set").alias("b")).filter("a != b").distinct(), "pairs")


def hubs_of(pairs: DataFrame) -> list:
    """The hot ones among the b of pairs (``a, b``, a written table)."""
    return hot_keys(pairs.groupBy("b").agg(F.count("*").alias("n")), "b", pairs.count())


def compared(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """``a, b, matches`` of the pairs that sequential Bayesian comparison does not prune."""
    step = rule.hashes // 5
    stops = [*range(step, rule.hashes, step), rule.hashes]
    least = [least_matches(rule, s) for s in stops]
    t = float(rule.similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, rule.hashes) for i in (2, 3))
            live, matches, begin = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for stop, few in zip(stops, least, strict=True):
                matches[live] += (left[live, begin:stop] == right[live, begin:stop]).sum(1)
                live, begin = live[matches[live] >= few], stop
            kept = pa.array(live)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(matches[live])], ["a", "b", "matches"])

    own = classes.select("set", "n", "sig")
    sides = pairs.select("a", "b").join(own.toDF("a", "n_a", "sig_a"), "a")
    sides = spread_join(sides, own.toDF("b", "n_b", "sig_b"), "b", "a", hubs_of(pairs))
    near = sides.filter((F.col("n_a") >= t * F.col("n_b") - 1e-6) & (F.col("n_b") >= t * F.col("n_a") - 1e-6))
    return arrow_map(near.select("a", "b", "sig_a", "sig_b"), "a binary, b binary, matches bigint", run)


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """``a, b`` of the pairs whose full sets reach the similarity; ``texts`` has ``set, text``."""
    top, bottom = rule.similarity.numerator, rule.similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "text_a", 1 << 20):
                left = shingle_sets(*text_bytes(batch.column(2)), rule.words)
                # rows of one hub stand together: its shingles are made once
                hub = batch.column(1).dictionary_encode()
                first = np.unique(hub.indices.to_numpy(), return_index=True)[1]
                right = shingle_sets(*text_bytes(batch.column(3).take(pa.array(first))), rule.words)
                good = []
                for x, h in zip(left, hub.indices.to_pylist(), strict=True):
                    y = right[h]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(bool(len(x)) and bottom * both >= top * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], ["a", "b"])

    sides = pairs.select("a", "b").join(texts.toDF("a", "text_a"), "a")
    sides = spread_join(sides, texts.toDF("b", "text_b"), "b", "a", hubs_of(pairs))
    return arrow_map(sides.select("a", "b", "text_a", "text_b"), "a binary, b binary", run)


def labels_of(state: DataFrame) -> list:
    """The hot labels of a written table ``set, label``."""
    return hot_keys(state.groupBy("label").agg(F.count("*").alias("n")), "label", state.count())


def roots(parents: DataFrame) -> DataFrame:
    """``set, label`` of a forest ``a, b`` (every a has one b, which lies higher in a common order):
    labels jump to their own labels until all are roots, log(depth) rounds."""
    state = written(parents.select(F.col("a").alias("set"), F.col("b").alias("label")), "labels")
    while True:
        jump = state.select(F.col("set").alias("label"), F.col("label").alias("far"))
        after = written(spread_join(state.select("set", "label"), jump, "label", "set", labels_of(state), "left").select("set", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved")), "labels")
        drop_written(state)
        moved = after.agg(F.max("moved").alias("m")).head()["m"]
        state = after
        if not moved:
            own = state.select("set", "label")
            return own.unionByName(own.select(F.col("label").alias("set"), "label").distinct())


def joined(state: DataFrame, more: DataFrame) -> DataFrame:
    """The labels after further links: components of the labels that those connect."""
    at = lambda side: state.select(F.col("set").alias(side), F.col("label").alias(f"l_{side}"))
    named = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    merged = components(named.distinct()).select(F.col("set").alias("label"), F.col("label").alias("next"))
    fresh = merged.select(F.col("label").alias("set"), F.col("next").alias("label")).join(state, "set", "left_anti")
    return spread_join(state.select("set", "label"), merged, "label", "set", labels_of(state), "left").select("set", F.coalesce("next", "label").alias("label")).unionByName(fresh)


def components(links: DataFrame) -> DataFrame:
    """``set, label`` for every class that has a link: the smallest class it reaches.

    Each round takes the smallest label among neighbours and then jumps to the label's own label.
    """
    both = written(links.select("a", "b").unionByName(links.selectExpr("b as a", "a as b")), "both")
    state = written(both.groupBy(F.col("a").alias("set")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(state.selectExpr("set as b", "label as near"), "b").groupBy(F.col("a").alias("set")).agg(F.min("near").alias("near"))
        lower = state.select("set", "label").join(near, "set", "left").select("set", F.least("label", "near").alias("next"), "label")
        jump = lower.select(F.col("set").alias("next"), F.col("next").alias("far"))
        after = written(lower.join(jump, "next", "left").select("set", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "labels")
        drop_written(state)
        moved = after.agg(F.max("moved").alias("m")).head()["m"]
        state = after
        if not moved:
            drop_written(both)
            return state.select("set", "label")


def open_classes(member: DataFrame, state: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """``set, label, n, need`` of the classes in buckets that still hold several components.

    ``need`` is the least overlap with any partner from those buckets: t / (1 + t) of both sizes,
    a partner being no smaller than t * n and than the smallest class of the buckets.
    """
    marked = member.select("set", "bucket").join(state, "set", "left").join(classes.select("set", "n"), "set").select("set", "bucket", "n", F.coalesce("label", "set").alias("label"))
    several = marked.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least")).filter("low != high")
    rows = marked.join(several.select("bucket", "least"), "bucket").groupBy("set").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.min("least").alias("least"))
    top, bottom = rule.similarity.numerator, rule.similarity.denominator
    partner = F.expr(f"greatest(least, (n * {top} + {bottom - 1}) div {bottom})")
    return rows.select("set", "label", "n", ((F.col("n") + partner) * top / (top + bottom) - F.lit(1e-9)).alias("need")).withColumn("need", F.ceil("need"))


def shingled(held: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """``set, n, need, shingle``: a row per distinct shingle of every class held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = shingle_sets(*text_bytes(batch.column(3)), rule.words)
            at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(np.concatenate(sets).view(np.int64))], ["set", "n", "need", "shingle"])

    return arrow_map(held.select("set", "n", "need").join(texts, "set").select("set", "n", "need", "text"), "set binary, n bigint, need bigint, shingle bigint", run)


def hopeless(held: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """``set`` of open classes that share fewer shingles with all other open classes than they
    would need to share with one partner."""
    # a shingle that only one class holds has one row; sums of those per class need no self-join
    alone = shingled(held, texts, rule).groupBy("shingle").agg(F.count("*").alias("holders"), *[F.first(c).alias(c) for c in ("set", "n", "need")]).filter("holders = 1")
    return alone.groupBy("set").agg(F.count("*").alias("own"), F.first("n").alias("n"), F.first("need").alias("need")).filter("n - own < need").select("set")


def rare_prefixes(held: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """``set, shingle, n, place, label``: each open class's first shingles in a common order, rarest
    first, as far as a partner's first common shingle can lie (those no other class holds left out)."""
    rows = shingled(held, texts, rule)
    holders = rows.groupBy("shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
    of = Window.partitionBy("set")
    # a class's place in the common order counts its own shingles, which come first
    place = F.col("n") - F.count("*").over(of) + F.row_number().over(of.orderBy("holders", "shingle"))
    ranked = rows.join(holders, "shingle").select("set", "shingle", "n", "need", place.alias("place"))
    return ranked.filter("place <= n - need + 1").select("set", "shingle", "n", "place").join(held.select("set", "label"), "set")


def last_pairs(first: DataFrame, rule: Rule) -> DataFrame:
    """``a, b``: all pairs of open classes of different components that may be partners.

    Partners share at least t / (1 + t) of both sizes, so the first shingle they share in a common
    order lies among the first n - overlap + 1 of each; with the rarest first these are a class's own
    edits, not what its whole group has in common, so a large group does not pair with itself.
    """
    left, right = (first.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("set", "label", "n", "place")]) for side in "ab")
    top, bottom = rule.similarity.numerator, rule.similarity.denominator
    overlap = f"((n_a + n_b) * {top} + {top + bottom - 1}) div {top + bottom}"
    fits = f"label_a < label_b and place_a <= n_a - {overlap} + 1 and place_b <= n_b - {overlap} + 1"
    hot = hot_keys(first.groupBy("shingle").agg(F.count("*").alias("n")), "shingle", first.count(), least=256)
    return spread_join(left, right, "shingle", "set_a", hot).filter(fits).selectExpr("set_a as a", "set_b as b").distinct()


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row.

    ``component_id`` is the smallest id reachable by links, ``kept`` whether it is the row's own.
    """
    rows = written(signed(docs, rule, id_col, text_col), "signed")
    usable = rows.filter("id is not null and n > 0")
    classes = written(usable.groupBy("set").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies")), "classes")
    member = places(classes, rule)
    labels = _labels(docs, member, classes, rule, id_col, text_col)
    lowest = classes.join(labels, "set").groupBy("label").agg(F.min("least").alias("component"))
    found = spread_join(labels, lowest, "label", "set", labels_of(labels)).select("set", "component")
    by_set = classes.select("set", "least").join(found, "set", "left").select("set", F.coalesce("component", "least").alias("component"))
    told = spread_join(usable.select("id", "n", "set"), by_set, "set", "id", hot_keys(classes.select("set", F.col("copies").alias("n")), "set", rows.count()))
    alone = rows.filter("id is null or n = 0").select("id", "n", F.col("id").alias("component"))
    out = told.select("id", "n", "component").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(False)).alias("kept"))


def _labels(docs: DataFrame, member: DataFrame, classes: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """``set, label`` of all classes that have links."""
    made: list[DataFrame] = [member]

    def kept(df: DataFrame, kind: str) -> DataFrame:
        made.append(written(df, kind))
        return made[-1]

    hubs = hub_pairs(member)
    made.append(hubs)
    first = kept(compared(hubs, classes, rule), "compared")
    # the texts of classes that may be verified: one row each, by the class's smallest id
    wanted = kept(classes.join(member.select("set").distinct(), "set", "left_semi").select(F.col("least").alias("id")), "wanted")
    chosen = _texts(docs, id_col, text_col).join(wanted.hint("shuffle_hash"), "id", "left_semi")
    texts = kept(_one_text(chosen, rule), "texts")
    best = kept(first.groupBy("a").agg(F.max(F.struct("matches", "b")).alias("best")).select("a", F.col("best.b").alias("b")), "best")
    links = kept(verified(best, texts, rule), "links")
    state = written(roots(links), "labels")  # a hub lies above its members by (weight, digest)
    held = kept(open_classes(member, state, classes, rule), "open")
    held = kept(held.join(hopeless(held, texts, rule), "set", "left_anti"), "held")
    prefixes = kept(rare_prefixes(held, texts, rule), "prefixes")
    near = kept(compared(kept(last_pairs(prefixes, rule), "pairs"), classes, rule), "compared")
    more = kept(verified(near, texts, rule), "links")
    if more.limit(1).count():
        state = written(joined(state, more), "labels")
    for table in made:  # the labels are a table of their own
        drop_written(table)
    return state


def _one_text(chosen: DataFrame, rule: Rule) -> DataFrame:
    """``set, text``: one text of each class, found by its digest (an id may stand on several rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(*text_bytes(batch.column(0)), rule.words)
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), batch.column(0)], ["set", "text"])

    return arrow_map(chosen.select("text"), "set binary, text string", run).filter("set is not null").groupBy("set").agg(F.min("text").alias("text"))
