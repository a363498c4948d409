"""How many partitions a shuffle gets: as many as its input asks for, where the session keeps fewer.

A session's number of shuffle partitions is fixed, and adaptive execution lowers it, as far as to one for each
core; with the input each task's rows, sorts and hash tables grow.  The estimate is Catalyst's, of the files read: no job runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 8 << 20  # bytes of input files for a partition
UNKNOWN = 1 << 60  # what Catalyst gives for data of unknown size


def parts(*frames: DataFrame) -> int | None:
    """Partitions for a shuffle of frames: None where those that the session keeps will do."""
    size = 0
    for frame in frames:
        if getattr(frame, "_jdf", None) is None:
            return None
        leaves = frame._jdf.queryExecution().analyzed().collectLeaves()
        sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
        size += sum(s for s in sizes if s < UNKNOWN)
    wanted = -(-size // PART)
    return wanted if wanted > kept_parts(frames[0]) else None


def session_parts(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def kept_parts(frame: DataFrame) -> int:
    """The fewest partitions that a large shuffle of the session's own number is merged into."""
    number, conf = session_parts(frame), frame.sparkSession.conf
    merging = "spark.sql.adaptive.coalescePartitions"
    if "false" in (conf.get("spark.sql.adaptive.enabled").lower(), conf.get(f"{merging}.enabled").lower()):
        return number
    least = conf.get(f"{merging}.minPartitionNum", None)
    if least is None:
        least = frame.sparkSession.sparkContext.defaultParallelism if conf.get(f"{merging}.parallelismFirst").lower() == "true" else 1
    return min(number, int(least))


def dealt(rows: DataFrame, number: int | None, *keys: str | Column) -> DataFrame:
    """``rows`` put together by ``keys``, so that distinct rows, groups and windows by these keys and more
    need no other shuffle."""
    return rows.repartition(number, *keys) if number else rows.repartition(*keys)


def keyed(rows: DataFrame, number: int | None, *keys: str) -> DataFrame:
    """The side of a join with one row per key, dealt into ``number`` partitions if there is one; the
    other side follows, unless this one is broadcast."""
    return rows.repartition(number, *keys) if number else rows


def distinct_count(rows: DataFrame, number: int | None, name: str, out: str) -> DataFrame:
    """One row with the number of a column's distinct values."""
    values = rows.select(name).filter(F.col(name).isNotNull())
    return (dealt(values, number, name) if number else values).distinct().agg(F.count("*").alias(out))
