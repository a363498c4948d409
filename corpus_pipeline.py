"""The corpus pipeline: toxicity, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents.  All but the last return the columns of documents, with
their values, types and order, whatever their names; a column called as one of a model's is left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import neardup, packing, quality, toxicity
from tallymark.llm.common import drop_written, fresh_names, written
from tallymark.llm.queries import table, vocab_path


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic.

    Every row is judged by its whole text alone: repeated rows alike, null and empty texts by the
    models' intercepts (kept, unless most labelled rows are toxic), rows without an id as any other.  No
    labels, or none of a class: nothing is called toxic.  An empty table stays empty.
    """
    scored = toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=True)
    return scored.filter(F.col(f"`{scored.columns[-1]}`") == 0).select(*_own(docs))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote calls good.

    Every row is judged by its whole text alone: repeated rows alike, null and empty texts by the
    sample's share of good ones, rows without an id as any other.  Without labels every score is 0.5
    and all rows stay.  An empty table stays empty.
    """
    scored = quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep=True)
    return scored.filter(F.col(f"`{scored.columns[-1]}`") == 1).select(*_own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8.

    A document is an id with a text, so different texts under one id are different documents; rows
    equal in both are one document, of which the row stays whose other columns come first (as JSON).  Of
    a group the smallest id stays, with the smallest checksum of the text among equal ids; rows
    without an id are documents as well and come behind those with one.  Null, empty and wordless texts
    are in no group and stay.  An empty table stays empty.
    """
    row, kept, times = fresh_names(docs.columns, ["row", "kept", "times"])
    id_, text = F.col("`doc_id`"), F.col("`text`")
    keyed = docs.withColumn(row, F.struct(id_.isNull().alias("missing"), id_.alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("text")))
    found = neardup.near_duplicates(keyed, neardup.Rule(words=5), id_col=row)
    found = found.select(row, F.col("kept").alias(kept)).groupBy(row).agg(F.first(kept).alias(kept), F.count("*").alias(times))
    marks = written(found.filter(~F.col(kept) | (F.col(times) > 1)), "marks")
    marked = keyed.join(marks, row, "left")
    once = marked.filter(F.col(times).isNull()).select(*_own(docs))
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    one = marked.filter(F.col(kept) & (F.col(times) > 1)).groupBy(row).agg(F.min_by(F.struct(*_own(docs)), rest).alias(row + "_"))
    return once.unionByName(one.select(*[F.col(f"`{row}_`")[c].alias(c) for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, packed into sequences of 1024 tokens: a row per piece with its ids, from
    which ``packing.packed_sequences`` puts the sequences together.

    Null and empty texts are the end token alone; texts of any length are cut whole; every row is packed,
    repeated ones, ones that share an id and ones without an id too.  An empty table gives an empty table.
    """
    packed = packing.pack(docs, vocab_path(), size=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: The models and the packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's table goes when the next
    one has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_written(before)
        before = docs
    return docs
