"""Sharding by fixed virtual slots.

Rows are hashed into a fixed number of virtual slots; bytes and rows are aggregated per slot; and
a versioned slot-to-shard map, stored as a small table, says which shard holds a slot.  Rows are placed
by reading a version of that table back.  The first version deals slots out in turn; a rebalancing
edits the latest one: it moves the fewest slots it can and appends the result as the next version, so
rows of other slots stay where they are.

Only DataFrame operations touch rows; the driver sees one row per slot.

Defined results: a null text has size 1 (no bytes, plus one); null ids are hashed with their
text; rows that are equal in id and text share a slot (a slot with more than its share of rows is
numbered in parts, so no task gets all of it); an empty table gives an empty table; columns other
than the id and text columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import path_of
from .common import new_uri, only, written

SLOTS = 4096


def slot_of(*columns: str | Column, slots: int = SLOTS) -> Column:
    """A row's virtual slot."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, virtual_slot``."""
    text = F.col(f"`{text_col}`").cast("string")
    return only(docs, id_col, text_col).select(
        F.col(f"`{id_col}`"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        slot_of(F.col(f"`{id_col}`"), text, slots=slots).alias("virtual_slot"),
    )


def slot_stats(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has any."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The first map, made before any row is known: slots in turn."""
    return [s % shards for s in range(slots)]


def rebalance(current: list[int], stats: dict[int, int], shards: int, tolerance: float = 0.0001) -> list[int]:
    """The next map: slots of dropped shards go to the lightest ones; then, while a shard is heavier
    than the lightest by more than ``tolerance`` of the mean and a slot of it helps, the slot that fits best
    moves there (the heaviest such shard first).  Other slots stay."""
    out, load = list(current), [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    homeless = [s for s, shard in enumerate(out) if shard >= shards]
    for slot, shard in enumerate(out):
        if shard < shards:
            load[shard] += stats.get(slot, 0)
            held[shard].add(slot)
    for slot in sorted(homeless, key=lambda s: (-stats.get(s, 0), s)):
        out[slot] = min(range(shards), key=lambda s: (load[s], len(held[s]), s))
        load[out[slot]] += stats.get(slot, 0)
        held[out[slot]].add(slot)
    mean = sum(load) / shards
    moved = True
    while moved:  # every move lowers the sum of squares of the loads
        moved, low = False, min(range(shards), key=load.__getitem__)
        for high in sorted(range(shards), key=lambda s: (-load[s], s)):
            gap = load[high] - load[low]
            own = [s for s in held[high] if 0 < stats.get(s, 0) < gap]
            if gap > tolerance * mean and own:
                slot = min(own, key=lambda s: (abs(2 * stats[s] - gap), s))
                out[slot] = low
                held[high].remove(slot)
                held[low].add(slot)
                load[high] -= stats[slot]
                load[low] += stats[slot]
                moved = True
                break
    return out


class SlotMap:
    """The stored map: a table ``version, virtual_slot, shard, bytes, rows`` to which versions are
    added; a version is never written twice."""

    def __init__(self, spark: SparkSession, uri: str | None = None, slots: int = SLOTS) -> None:
        self.spark, self.uri, self.slots = spark, uri or new_uri(spark, "slots"), slots

    def latest(self) -> int:
        """The number of the last version, 0 before the first."""
        path, fs = path_of(self.spark, self.uri)
        if not fs.exists(path):
            return 0
        return self.versions().agg(F.max("version").alias("v")).head()["v"] or 0

    def store(self, version: int, shards: list[int], stats: DataFrame) -> None:
        """Append the next version with the slots' bytes and rows when it was made."""
        if version != self.latest() + 1:
            raise ValueError(f"version {version} does not follow version {self.latest()}")
        if len(shards) != self.slots:
            raise ValueError(f"a map has {self.slots} slots, not {len(shards)}")
        made = self.spark.range(self.slots, numPartitions=1).select(
            F.lit(version).alias("version"), F.col("id").cast("int").alias("virtual_slot"), F.get(F.lit(shards), F.col("id").cast("int")).alias("shard")
        )
        made.join(F.broadcast(stats), "virtual_slot", "left").na.fill(0, ["bytes", "rows"]).select(
            "version", "virtual_slot", "shard", "bytes", "rows"
        ).coalesce(1).write.mode("append").parquet(self.uri)

    def versions(self) -> DataFrame:
        return self.spark.read.parquet(self.uri)

    def version(self, number: int) -> DataFrame:
        return self.versions().filter(F.col("version") == number)

    def shards(self, number: int) -> list[int]:
        return [r["shard"] for r in sorted(self.version(number).select("virtual_slot", "shard").collect())]


def place(rows: DataFrame, stats: DataFrame, version: DataFrame, slots: int, id_col: str) -> DataFrame:
    """Rows (``id_col, size, text_crc32, virtual_slot, spin``; ``spin`` differs for every row) in the
    shards that a stored version names, each shard's rows numbered without gaps.

    Rows are numbered within their slot, so no shard is sorted; a slot with more than a quarter of
    a mean slot's rows is cut into parts by ``spin``, five for each slot on average at most.  A slot, and a
    part of it, begins where the shard's earlier ones end.
    """
    mean = stats.agg(F.greatest(F.ceil(F.sum("rows") / (4 * slots)), F.lit(1)).alias("share"))
    cut = stats.crossJoin(F.broadcast(mean)).select("virtual_slot", F.ceil(F.col("rows") / F.col("share")).alias("parts"))
    known = version.select("virtual_slot", "shard").join(F.broadcast(cut), "virtual_slot")  # a row per slot at most
    parted = rows.join(F.broadcast(known), "virtual_slot").withColumn("part", F.pmod(F.xxhash64("spin"), F.col("parts"))).drop("parts")
    counts = parted.groupBy("shard", "virtual_slot", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "part")) - F.col("n")
    begins = counts.select("virtual_slot", "part", before.alias("begin"))  # five rows per slot on average at most
    order = Window.partitionBy("virtual_slot", "part").orderBy(F.col(f"`{id_col}`"), "text_crc32", "size", "spin")
    told = parted.join(F.broadcast(begins), ["virtual_slot", "part"])
    return told.select(F.col(f"`{id_col}`"), "size", "text_crc32", "shard", (F.col("begin") + F.row_number().over(order) - 1).alias("slot"), "virtual_slot")


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, stored: SlotMap | None = None, version: int | None = None, tolerance: float = 0.0001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put all rows into ``shards`` shards of near equal bytes and number each shard's rows:
    ``id_col, size, text_crc32, shard, slot, virtual_slot``.

    With ``version`` rows are placed by that stored version as it is.  Otherwise the latest version of
    the map (the first one, if there is none) is rebalanced by these rows' bytes; if that moves any
    slot, the next version is stored; and rows are placed by the version read back.
    ``slot`` is the row's place in its shard, gapless from 0.
    """
    spark = docs.sparkSession
    stored = stored or SlotMap(spark, slots=slots)
    if stored.slots != slots:
        raise ValueError(f"the stored map has {stored.slots} slots, not {slots}")
    # written once: the texts are read once, and counting and numbering see the same rows
    rows = written(sized(docs, slots, id_col, text_col).withColumn("spin", F.monotonically_increasing_id()), "sized")
    found = [(r["virtual_slot"], r["bytes"], r["rows"]) for r in slot_stats(rows).collect()]  # a row per slot at most
    stats = spark.createDataFrame(found, "virtual_slot int, bytes bigint, rows bigint")
    if version is None:
        version = stored.latest()
        if not version:
            stored.store(1, first_map(shards, slots), stats)
            version = 1
        current = stored.shards(version)
        after = rebalance(current, {s: b for s, b, _ in found}, shards, tolerance)
        if after != current:
            version += 1
            stored.store(version, after, stats)
    elif not 1 <= version <= stored.latest():
        raise ValueError(f"no version {version} is stored")
    return place(rows, stats, stored.version(version), slots, id_col)
