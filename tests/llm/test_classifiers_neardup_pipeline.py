"""Classifiers by held-out accuracy, near duplicates and the pipeline against brute force."""

import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tallymark.llm import features, neardup, packing, quality, queries, toxicity
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def rows_of(path, name):
    return duckdb.sql(f"select * from '{path}/{name}.parquet'").fetchall()


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


ODD = ["", None, " \n", "a", "\x00", "idiot " * 5000, "x" * 90_000, "|" * 300, "Ünï çødé 中文 👍"]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(None, "no id", "clash", 1)] + [(3, "a", "clash", 1)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n int")


# ---- classifiers


def test_op3_held_out(spark, small):
    labels = {i: q for i, q, _ in rows_of(SF, "labels")}
    got = queries.op3_quality(spark, SF).collect()
    assert len(got) == len(rows_of(SF, "documents")) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    tested = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == q for p, q in tested) >= 0.97 * len(tested)
    low = [p for p, q in tested if q == 0]
    assert low.count(0) >= 0.9 * len(low)


def test_knn_is_exact():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.3, (60, 50)).astype(np.float32)
    labels = rng.integers(0, 2, 60)
    model = quality.fit_model(counts, labels, dimensions=10, neighbours=7, sharpness=2.0)
    fresh = rng.poisson(0.3, (40, 50)).astype(np.float32)
    got = model.score(fresh, block=9)
    for row, score in zip(model.latent(fresh), got, strict=True):
        cosine = np.array([float(row @ v) for v in model.vectors])
        near = np.argsort(-cosine)[:7]
        vote = np.maximum(cosine[near], 0) ** 2
        assert score == pytest.approx((vote * labels[near]).sum() / vote.sum(), abs=1e-5)


def test_classifiers_take_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)] + [(None, 1, 1), (1, None, None), (3, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for module, few in ((quality, {"neighbours": 3}), (toxicity, {})):
        model = module.fit(odd, labels, **few)
        got = module.classify(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
        assert module.classify(odd.limit(0), model).count() == 0
        empty = module.fit(odd, labels.limit(0))
        assert module.classify(odd, empty).count() == odd.count()
        kept = module.classify(odd.drop("score"), model, keep=True)
        assert kept.columns == ["doc_id", "text", "n", "score", "predicted"]
        # columns of the same name keep their values, whatever their type and case
        clash = odd.withColumn("Predicted", F.lit("mine"))
        kept = module.classify(clash, model, keep=True)
        assert kept.columns == ["doc_id", "text", "score", "n", "Predicted", "score_2", "predicted_2"]
        assert {(r["score"], r["Predicted"]) for r in kept.collect()} == {("clash", "mine")}
        assert all(0 <= r["score_2"] <= 1 for r in kept.collect())


def plain_lower(raw):
    out = bytearray(raw)
    for i, b in enumerate(raw):
        if 0x41 <= b <= 0x5A or (i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97):
            out[i] += 0x20
    return bytes(out)


def plain_words(raw):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", plain_lower(raw))


def plain_counts(raw):
    """One text's counts, sign by sign and word by word."""
    out = np.zeros(quality.FEATURES)
    signs = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]

    def shape(b):
        if b in (0x20, 0x09):
            return 3
        if b in (0x0A, 0x0D):
            return 4
        if b < 0x20 or b == 0x7F:
            return 5
        return 2 if 0x30 <= b <= 0x39 else 1 if 0x41 <= b <= 0x5A else 6 + signs.index(b) if b in signs else 0

    begins = [0] + [i + 1 for i, b in enumerate(raw) if shape(b) in (3, 4) and i + 1 < len(raw)] if raw else []
    parts = [raw[a:b] for a, b in zip(begins, [*begins[1:], len(raw)], strict=True)]
    again = {begins[i] for i in range(1, len(parts)) if parts[i] == parts[i - 1] and len(parts[i]) > 2}
    kinds = [features.REPEAT if i in again else shape(b) for i, b in enumerate(raw) if i == 0 or shape(b) != shape(raw[i - 1]) or shape(b) > 4]
    two = [a * features.SHAPES + b + features.SHAPES for a, b in zip(kinds, kinds[1:])]
    three = [(a * features.SHAPES + b) * 7919 + 104729 for a, b in zip(two, kinds[2:])]
    for gram in [*kinds, *two, *three]:
        out[gram % quality.SHAPE] += 1
    found = [b"<" + w + b">" for w in plain_words(raw)]
    cells = [zlib.crc32(w) for w in found]
    for a, b in zip(found, found[1:]):
        mixed = (zlib.crc32(a) * 0x9E3779B1 ^ zlib.crc32(b)) % 2**32
        cells.append(mixed ^ mixed >> 15)
    for w in found:
        for n in (3, 4):
            for i in range(len(w) - n + 1):
                part = 0
                for b in w[i : i + n]:
                    part = (part ^ b) * 0x01000193 % 2**32
                cells.append(part ^ part >> 13)
    for cell in cells:
        out[quality.SHAPE + cell % quality.WORDS] += 1
    return out


def test_op3_equals_plain_votes(spark, small):
    """Every document's score from plain counts, a plain projection and a plain nearest-neighbour vote."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in queries.op3_quality(spark, small).collect()}
    far = 0
    for i, text in [r[:2] for r in rows_of(small, "documents")]:
        counts = plain_counts((text or "").encode())
        halves = []
        for some, weight in ((counts[: quality.SHAPE], model.weight[: quality.SHAPE]), (counts[quality.SHAPE :], model.weight[quality.SHAPE :])):
            v = np.sqrt(some / max(1, some.sum())) * weight
            halves.append(v / (np.linalg.norm(v) or 1))
        v = np.concatenate(halves)
        v = v / (np.linalg.norm(v) or 1) @ model.basis
        cosine = [float(v @ w) / (np.linalg.norm(v) or 1) for w in model.vectors]
        near = sorted(range(len(cosine)), key=lambda j: (-round(cosine[j], 9), j))[: model.neighbours]
        votes = [max(cosine[j], 0) ** model.sharpness for j in near]
        wanted = sum(a * model.labels[j] for a, j in zip(votes, near, strict=True)) / sum(votes) if sum(votes) else model.prior
        far += abs(got[i] - wanted) > 1e-3
    assert far <= 1  # counts are in single precision, so a tie may fall the other way


def test_quality_sees_words(spark):
    """Good and bad texts of the same shape: only their words and word parts differ."""
    rng = np.random.default_rng(2)
    syllables = ["ta", "ren", "mo", "lis", "ke", "dor", "vin", "sa", "pel", "uno"]
    vocabulary = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(150)]
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows, told = [], []
    for i in range(900):
        good = i % 2
        found = [str(rng.choice(vocabulary)) for _ in range(60)]
        found = found if good else ["".join(rng.choice(letters, len(w))) for w in found]
        rows.append((i, " ".join(found).capitalize() + "."))
        told.append((i, good))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(told, "doc_id long, quality int")
    got = quality.classify(docs, quality.fit(docs, labels)).collect()
    tested = [r["predicted"] == r["doc_id"] % 2 for r in got if held(r["doc_id"])]
    assert len(tested) > 200 and sum(tested) >= 0.98 * len(tested)


def test_votes_do_not_depend_on_blocks():
    """Many equal neighbours with mixed labels: the first ones of the sample vote, in blocks of any size."""
    rng = np.random.default_rng(1)
    base = rng.poisson(1, (3, 40)).astype(np.float32)
    counts, labels = base[rng.integers(0, 3, 90)], rng.integers(0, 2, 90)
    model = quality.fit_model(counts, labels, dimensions=3, neighbours=7, cut=20)
    fresh = base[rng.integers(0, 3, 50)]
    assert (model.score(fresh, block=1) == model.score(fresh, block=50)).all()
    for row, score in zip(fresh, model.score(fresh, block=17), strict=True):
        same = [i for i in range(90) if (counts[i] == row).all()][:7]
        assert score == pytest.approx(labels[same].mean())


def plain_hashes(word):
    return {zlib.crc32(word)} | {zlib.crc32(word[:n], 0x9E37) if len(word) > n else zlib.crc32(word) for n in (4, 5, 6, 7, 8)}


def test_op10_equals_plain_chain(spark, small):
    """The features from plain counts, and every score from plain sums along the chain."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    chain = toxicity.fit(docs, labels)
    texts = {r[0]: (r[1] or "").encode() for r in rows_of(small, "documents")}
    toxic = {i: t for i, _, t in rows_of(small, "labels") if i in texts and not held(i)}
    n, bad = {}, {}
    for i, t in toxic.items():
        for h in set().union(*map(plain_hashes, plain_words(texts[i]))):
            n[h], bad[h] = n.get(h, 0) + 1, bad.get(h, 0) + t
    rows, share = len(toxic), sum(toxic.values()) / len(toxic)
    chi = {h: round((bad[h] - c * share) ** 2 / (c * share * (1 - c / (rows + 1))), 6) for h, c in n.items() if c >= 3}
    chi = {h: c for h, c in chi.items() if c >= 6.63}
    least = sorted(chi.values(), reverse=True)[: len(chain.features)][-1]
    assert len(chain.features) == min(1024, len(chi))
    assert all(chi[h] >= least - 1e-5 for h in chain.features.tolist())
    assert {h for h, c in chi.items() if c > least + 1e-5} <= set(chain.features.tolist())
    place = {h: k for k, h in enumerate(chain.features.tolist())}
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, small).collect()}
    for i, raw in texts.items():
        present = sorted({place[h] for w in plain_words(raw) for h in plain_hashes(w) if h in place})
        odds = []
        for category, model in zip(chain.categories, chain.models, strict=True):
            if model.constant is not None:
                p, logit = model.constant, np.log(max(model.constant, 1e-6) / (1 - max(model.constant, 1e-6)))
            else:
                logit = float(model.bias + sum(float(model.weights[k]) for k in present) + sum(float(w) * o for w, o in zip(model.weights[len(place) :], odds, strict=True)))
                p = 1 / (1 + np.exp(-logit))
            assert got[i][f"p_{category}"] == pytest.approx(p, abs=1e-4)
            odds.append(min(max(logit, -8), 8) / 8)
        assert got[i]["score"] == got[i][f"p_{chain.categories[-1]}"] and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_kinds_are_learnt():
    """Positive rows of two vocabularies become two kinds, rows without a telling feature none; copies share a fold."""
    rng = np.random.default_rng(4)
    x = (rng.random((400, 30)) < 0.2).astype(np.float32)
    x[:, :6] = 0
    y = np.zeros(400)
    y[:110] = 1
    for i in range(50):
        x[i, rng.integers(0, 3)] = 1
        x[50 + i, 3 + rng.integers(0, 3)] = 1
    x[:50, 0], x[50:100, 3] = 1, 1
    kind = toxicity.learnt_kinds(x, y, 2)
    assert len(set(kind[:50])) == 1 and len(set(kind[50:100])) == 1 and kind[0] != kind[50]
    assert (kind[110:] == -1).all() and (toxicity.learnt_kinds(x, np.zeros(400), 2) == -1).all()
    assert (toxicity.learnt_kinds(x[:, :0], y, 2) == -1).all()


def test_op10_held_out(spark, small):
    sf = "/root/testdata/sf0.1"
    labels = {i: t for i, _, t in rows_of(sf, "labels")}
    got = queries.op10_toxicity(spark, sf).collect()
    tested = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [p for p, t in tested if t], [p for p, t in tested if not t]
    # a tenth of the rows labelled toxic here hold no toxic word at all
    assert toxic.count(1) >= 0.85 * len(toxic) and clean.count(0) >= 0.99 * len(clean)


def test_chain_feeds_earlier_odds():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 6)).astype(np.float32)
    first = (x[:, 0] + x[:, 1] > 1).astype(float)
    chain = toxicity.fit_chain(x, {"one": first, "two": first, "none": np.zeros(600)}, np.arange(6))
    assert [len(m.weights) for m in chain.models] == [6, 7, 8]
    assert chain.models[1].weights[6] > 0.5
    p = chain.probabilities(x)
    assert ((p[:, 1] >= 0.5) == first).all() and (p[:, 2] == 0).all()


def test_word_features():
    row, code, distinct = features.words("É été1 x-Y\nab".encode() + "cd Été1".encode(), np.array([0, 16, 24]))
    assert [(r, distinct[c].as_py().decode()) for r, c in zip(row.tolist(), code.tolist(), strict=True)] == [(0, "é"), (0, "été1"), (0, "x"), (0, "y"), (0, "ab"), (1, "cd"), (1, "été1")]


# ---- near duplicates


def plain_sets(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(rows, k, t=Fraction(4, 5)):
    sets = [(i, plain_sets(x, k)) for i, x in rows]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, s) in enumerate(sets):
        for b in range(a):
            j, z = sets[b]
            if s and z and i is not None and j is not None and find(a) != find(b):
                both = len(s & z)
                if both >= t * (len(s) + len(z) - both):
                    label[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    return sorted(((i, len(s), low[find(a)] if i is not None else None, i is not None and low[find(a)] == i) for a, (i, s) in enumerate(sets)), key=str)


def test_op5(spark, small):
    got = sorted((tuple(r) for r in queries.op5_neardup(spark, small).collect()), key=str)
    assert got == plain_components([(r[0], r[1]) for r in rows_of(small, "documents")], 4)


def test_near_copies_of_one_text(spark):
    """A group whose members are edits of one text: many pairs lie under the threshold, yet the
    links through lightly edited members must all be found."""
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 500, 150)]
    rows = [(i, t) for i, t in enumerate(["", None, "one", "one two three", "One  two\tthree", " \n "])]
    for i in range(10, 150):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 9)):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:40] + [f"y{i}_{j}" for j in range(60)])) for i in range(20)]
    rows += [(9, " ".join(base)), (9, " ".join(base)), (8, " ".join(base).upper()), (None, " ".join(base)), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, set string, n int").repartition(5)
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs, neardup.Rule(words=4)).collect()), key=str)
    assert got == plain_components(rows, 4)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_pruning_keeps_what_it_must():
    rule = neardup.Rule()
    for seen in (30, 90, 150):
        few = neardup.least_matches(rule, seen)
        assert 0.5 * 0.8 * seen < few < 0.8 * seen
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = (np.unique(np.concatenate([common[:800], rng.integers(0, 2**63, 100).astype(np.uint64)])) for _ in range(2))
    sig = neardup.signatures([a, b], 3000)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.03


# ---- pipeline


def test_pipeline(spark, small):
    docs = rows_of(small, "documents")
    texts = {r[0]: r[1] for r in docs}
    labels = {i: (q, t) for i, q, t in rows_of(small, "labels")}
    now = spark.read.parquet(f"{small}/documents.parquet")
    columns = now.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, now = now, corpus_pipeline.written(stage(spark, now, small), "test")
        assert now.columns == columns
        kept.append([r[0] for r in now.select("doc_id").collect()])
        assert set(kept[-1]) <= {r[0] for r in before.select("doc_id").collect()}
    wanted = [r[0] for r in plain_components([(i, texts[i]) for i in kept[1]], 5) if r[3]]
    assert sorted(kept[2]) == sorted(wanted)
    clean = [i for i, (q, t) in labels.items() if q == 1 and t == 0 and not held(i)]
    assert sum(i in set(kept[1]) for i in clean) >= 0.95 * len(clean)
    packed = corpus_pipeline.written(corpus_pipeline.STAGES[3][1](spark, now, small), "test")
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == set(kept[2])
    # the product: whole sequences of ids, in which every document's ids stand
    sequences = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.packed_sequences(packed).collect()}
    assert max(map(len, sequences.values())) <= 1024
    library, told = Tokenizer.from_file(queries.vocab_path()), {}
    for r in sorted(packed.collect(), key=lambda r: (r["doc_id"], r["piece"])):
        told.setdefault(r["doc_id"], []).extend(sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tolist())
    assert told == {i: [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2] for i in kept[2]}


def test_pipeline_takes_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, clashing names, an empty table."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    good = [" ".join(word() for _ in range(60)) + "." for _ in range(40)]
    rows = [(i, t, "en", "mine", None, 1.5) for i, t in enumerate(good)]
    rows += [(100 + i, "IDIOT " * 3 + t, None, "mine", "x", None) for i, t in enumerate(good)]
    rows += [(200 + i, "### " * 60, "en", None, "x", 0.5) for i in range(30)]
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 1, 1) for i in range(40)] + [(200 + i, 0, 0) for i in range(30)] + [(None, 1, 1), (3, None, None)]
    long = " ".join(word() for _ in range(30_000))
    odd = [(300, None), (301, ""), (302, " \n"), (None, good[0]), (None, good[1] + " z"), (None, None), (303, long), (304, long), (305, good[2]), (305, good[3]), (306, "one new text " + good[4][:40]), (306, "another new text " + good[5][:40])]
    rows += [(i, t, "en", "mine", "x", 2.0) for i, t in odd] + [(306, "one new text " + good[4][:40], "en", "also", "x", 2.0)] * 3
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, `Predicted` string, kept double").repartition(3)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {tuple(r) for r in now.collect()}
        now = corpus_pipeline.written(stage(spark, now, str(tmp_path)), "test")
        assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        found = [tuple(r) for r in now.collect()]
        assert set(found) <= before
        ids = {r[0] for r in found}
        if name == "toxicity":
            assert not any(100 <= i < 140 for i in ids if i is not None) and len(found) == len(rows) - 40
        elif name == "quality":
            assert not any(200 <= i < 230 for i in ids if i is not None) and set(range(40)) <= ids
    by = [(r[0], r[1]) for r in found]
    texts = sorted((i, t) for i, t in by if i is not None and i >= 300)
    new = [t for t in ("one new text " + good[4][:40], "another new text " + good[5][:40])]
    assert texts == sorted([(i, t) for i, t in odd[:3] if (i, t) in texts] + [(303, long)] + [(306, t) for t in new]), [t for _, t in texts]
    assert [r[3] for r in found if r[1] == new[0]] == ["also"]  # of rows equal in id and text, the first as JSON
    assert (None, good[0]) not in by and (0, good[0]) in by and (1, good[1]) in by and (None, good[1] + " z") not in by
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(rows)
