"""BPE against the tokenizers library, packing and sharding against their laws."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tallymark.llm import bpe, packing, queries, sharding
from tokenizers import Tokenizer

ODD = ["", None, " ", "\n", "a", "<|endoftext|>x<|endoftext|>", "it's we'll 'S 's", "a" * 3000, "word " * 4000, "é中👍 　x", "x\r\n\n y  z\t", "\x00\x1c ok"]


def documents(path):
    return duckdb.sql(f"select doc_id, text from '{path}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.vocab_path())


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "ids", 1) for i, t in enumerate(ODD)] + [(None, "no id", "x", 1), (1, "a", "twice", 1), (1, "a", "twice", 1)], "doc_id long, text string, ids string, piece int")


def test_ids_equal_the_library(library):
    random.seed(1)
    bits = ["'", "'s", "'re", " ", "  ", "\n", "a", "Z", "é", "9", "!", "<|endoftext|>", "<|endo", "　", "the", " and", "👍", "中", "~" * 300, "ab" * 200]
    texts = ["".join(random.choices(bits, k=random.randint(0, 14))) for _ in range(3000)] + [t or "" for t in ODD]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    vocab = bpe.vocabulary(queries.vocab_path())
    lexicon = bpe.Lexicon.compile([b" and", b"the", b"a", b"abab", b"", "é".encode()], vocab)
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for use in (None, lexicon):
        got = bpe.Encoded(b"".join(data), offsets, vocab, use)
        assert [got.ids[a:b].tolist() for a, b in zip(got.bounds[:-1], got.bounds[1:])] == wanted


def test_lexicon_is_minimal_and_reopens(tmp_path):
    vocab = bpe.vocabulary(queries.vocab_path())
    words = [a + b for a in (b"talk", b"walk", b"work") for b in (b"", b"ed", b"ing", b"s")]
    made = bpe.Lexicon.compile(words, vocab)
    assert len(made.final) == 11  # root, t, w, [tw]a, wo, tal = wor, k, e, i, in, end
    (tmp_path / "x").write_bytes(made.to_bytes())
    again = bpe.Lexicon.open(str(tmp_path / "x"))
    assert isinstance(again.edge.base, np.memmap) or isinstance(again.edge, np.memmap)
    assert again.number(pa.array(sorted(words), pa.binary())).tolist() == list(range(12))
    assert again.number(pa.array([b"tal", b"talks!", b"", b"x"], pa.binary())).tolist() == [-1] * 4
    assert bpe.Lexicon.compile([], vocab).number(pa.array([b"a"], pa.binary())).tolist() == [-1]


def test_op9(spark, small, library):
    got = {r["doc_id"]: r for r in queries.op9_bpe(spark, small).collect()}
    for i, text in documents(small):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_frequent_words_are_bounded(spark):
    texts = [" " + "x" * 70 + " long" + " often" * 9, " " + "x" * 70 + " long"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert bpe.frequent_words(docs, queries.vocab_path(), 1) == [b" often"]
    assert sorted(bpe.frequent_words(docs, queries.vocab_path())) == [b" long", b" often"]
    assert b" " + b"x" * 70 in bpe.frequent_words(docs, queries.vocab_path(), longest=100)


def test_encode_decode_odd(spark, odd, library):
    encoded = bpe.encode(odd, queries.vocab_path(), bpe.compile_lexicon(odd, queries.vocab_path(), 50))
    rows = encoded.collect()
    assert len(rows) == len(ODD) + 3
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, queries.vocab_path()).collect()}
    for i in (0, 4, 5, 7, 9):
        assert back[i] == ODD[i] or back[i] == (ODD[i] or "")
    assert bpe.encode(odd.limit(0), queries.vocab_path()).count() == 0


def check_packed(rows, texts, library, size):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            own = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(own) if "ids_crc32" in r else bytes(r["ids"]) == own
            assert r["length"] == size or k == 0
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence), sum(r["length"] for r in rows)


def test_op1(spark, small, library):
    rows = queries.op1_packing(spark, small).collect()
    sequences, total = check_packed(rows, dict(documents(small)), library, 1024)
    assert sequences <= 1.01 * total / 1024 + 1


def test_pack_over_partitions(spark, odd, small, library):
    docs = spark.createDataFrame([(i, t) for i, t in documents(small)], "doc_id long, text string").repartition(30)
    rows = packing.pack(docs, queries.vocab_path(), size=256, carry=4, fan=3).collect()
    sequences, total = check_packed(rows, dict(documents(small)), library, 256)
    assert sequences <= 1.05 * total / 256 + 1
    packed = packing.pack(odd, queries.vocab_path(), size=64)
    assert packed.filter("doc_id = 0").count() == 1
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 64").count() == 0
    assert sum(len(r["ids"]) for r in packing.packed_sequences(packed).collect()) == 4 * packed.agg({"length": "sum"}).head()[0]
    assert packing.pack(odd.limit(0), queries.vocab_path()).count() == 0


def test_pack_sorted_input(spark):
    """Long documents first, then short ones: as few sequences as one best-fit run over all of them."""
    rng = random.Random(4)
    texts = [" a" * rng.randint(520, 700) for _ in range(4000)] + [" a" * rng.randint(30, 400) for _ in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(8, "doc_id")
    rows = packing.pack(docs, queries.vocab_path()).select("length", "sequence_id").collect()
    best = len(packing.best_fit(np.array([r["length"] for r in rows]), 1024)[2])
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * best


def test_cost_of_the_bound_on_carried_bins():
    """Hash-dealt partitions of three mixes, carried without a bound and with one: the same count but for a thousandth."""
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 1024, 60_000), np.minimum(1023, rng.lognormal(5.5, 1, 60_000).astype(int) + 1), rng.choice([700, 300, 30], 60_000)):
        counts = []
        for carry in (1 << 30, 1024):
            nodes, total = [packing.best_fit(part, 1024)[2] for part in np.array_split(lengths, 16)], 0
            while True:
                moving = [packing._carried(f, 1024, 0.99, carry) for f in nodes]
                total += sum(len(f) - len(m) for f, m in zip(nodes, moving, strict=True))
                items = [f[m] for f, m in zip(nodes, moving, strict=True)]
                groups = [np.concatenate(items[i : i + 8]) for i in range(0, len(items), 8)]
                nodes = [packing.best_fit(g, 1024)[2] for g in groups]
                if len(nodes) == 1:
                    counts.append(total + len(nodes[0]))
                    break
        assert counts[1] <= 1.001 * counts[0], (counts, len(packing.best_fit(lengths, 1024)[2]))


def test_best_fit_takes_the_tightest_room():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 5, 4, 3]), 10)
    assert fills.tolist() == [10, 10, 3]
    assert bins.tolist() == [0, 1, 1, 0, 2] and offsets.tolist() == [0, 0, 5, 6, 0]


def test_shared_folder():
    """The session's setting, then the context's folder; on a cluster never one of the driver's own."""
    from types import SimpleNamespace as Fake

    from tallymark.llm.common import shared_dir

    def session(master, setting=None, checkpoint=None):
        option = Fake(isDefined=lambda: checkpoint is not None, get=lambda: checkpoint)
        context = Fake(master=master, _jsc=Fake(sc=lambda: Fake(getCheckpointDir=lambda: option)))
        return Fake(conf=Fake(get=lambda name, default: setting), sparkContext=context)

    assert shared_dir(session("spark://a:7077", "hdfs://x/c/")) == "hdfs://x/c"
    assert shared_dir(session("yarn", None, "hdfs://y/d")) == "hdfs://y/d"
    with pytest.raises(RuntimeError):
        shared_dir(session("yarn"))
    one = session("local[2]")
    assert shared_dir(one).startswith("file://") and shared_dir(one) == shared_dir(one)


def check_shards(rows, shards):
    places = {}
    for r in rows:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert set(places) <= set(range(shards))


def test_op8(spark, small):
    rows = queries.op8_sharding(spark, small).collect()
    texts = dict(documents(small))
    assert len(rows) == len(texts)
    check_shards(rows, 8)
    load = [0] * 8
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        load[r["shard"]] += r["size"]
    assert max(load) - min(load) <= max(r["size"] for r in rows)


def test_shard_odd_and_versions(spark, odd):
    stored = sharding.SlotMap(spark, slots=64)
    rows = sharding.shard(odd, 3, 64, stored).collect()
    assert len(rows) == odd.count()
    check_shards(rows, 3)
    last = stored.latest()
    first, now = stored.shards(1), stored.shards(last)
    assert last == 2 and len(first) == len(now) == 64 and first == [i % 3 for i in range(64)]
    # rows lie where the stored version says
    by = lambda rows: {(r["doc_id"], r["text_crc32"]): (r["virtual_slot"], r["shard"]) for r in rows}
    assert all(shard == now[slot] for slot, shard in by(rows).values())
    # the same rows again: nothing to move, no version more
    assert by(sharding.shard(odd, 3, 64, stored).collect()) == by(rows) and stored.latest() == 2
    # an older version places by itself
    old = by(sharding.shard(odd, 3, 64, stored, version=1).collect())
    assert all(shard == first[slot] for slot, shard in old.values()) and old != by(rows)
    # one more shard, then fewer: slots move only as far as the balance asks
    grown = sharding.shard(odd, 4, 64, stored).collect()
    check_shards(grown, 4)
    assert stored.latest() == 3
    assert {b for a, b in zip(now, stored.shards(3), strict=True) if a != b} <= {3}
    check_shards(sharding.shard(odd, 2, 64, stored).collect(), 2)
    assert stored.latest() == 4 and set(stored.shards(4)) == {0, 1}
    empty = spark.createDataFrame([], "virtual_slot int, bytes bigint, rows bigint")
    for wrong in (2, 4, 6):
        with pytest.raises(ValueError):
            stored.store(wrong, now, empty)
    with pytest.raises(ValueError):
        sharding.shard(odd, 3, 64, stored, version=9)
    assert sharding.shard(odd.limit(0), 3, 64).count() == 0


def test_shard_rows_that_are_all_alike(spark):
    docs = spark.range(900).selectExpr("cast(7 as long) as doc_id", "'same' as text", "id as size").repartition(5)
    placed = sharding.shard(docs, 3, 16)
    rows = placed.collect()
    check_shards(rows, 3)
    assert len(rows) == 900 and len({r["virtual_slot"] for r in rows}) == 1
    assert "part#" in placed._jdf.queryExecution().toString()


def test_shards_near_equal(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "x" * int(rng.paretovariate(1.2) * 50)) for i in range(20_000)], "doc_id long, text string")
    load = [0] * 8
    for r in sharding.shard(docs, 8).collect():
        load[r["shard"]] += r["size"]
    largest = max(r["size"] for r in sharding.sized(docs).collect())
    assert max(load) - min(load) <= max(largest, 0.001 * sum(load) / 8)
