"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, else the context's
    checkpoint folder.

    Only on a single machine (a local master, as in tests) that names none, one is made, once a
    context; on a cluster a folder of the driver's own would lose what executors write, so that raises.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tallymark_shared", None)
    if not base:
        named = context._jsc.sc().getCheckpointDir()
        base = named.get() if named.isDefined() else None
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallymark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = context._tallymark_shared = f"file://{folder}"
    return base.rstrip("/")


def path_of(spark: SparkSession, uri: str):
    """A path of the cluster's file system, and that file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a file or folder of the shared folder; a stopped session is left alone."""
    if spark._jsc is not None and not spark._jsc.sc().isStopped():
        path, fs = path_of(spark, uri)
        fs.delete(path, True)


def new_uri(spark: SparkSession, kind: str, ending: str = "") -> str:
    """A fresh place in the shared folder, removed when the driver process ends."""
    uri = f"{shared_dir(spark)}/tallymark-{kind}-{uuid.uuid4().hex}{ending}"

    def gone() -> None:
        try:
            remove(spark, uri)
        except Exception:  # noqa: BLE001 - the gateway may be down when the process ends
            return

    atexit.register(gone)
    return uri


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut there,
    and a lost executor costs only a re-read."""
    uri = new_uri(df.sparkSession, kind)
    df.write.mode("overwrite").option("compression", "zstd").parquet(uri)
    out = df.sparkSession.read.schema(df.schema).parquet(uri)
    out._tallymark_uri = uri
    return out


def drop_written(df: DataFrame | None) -> None:
    """Delete a table made by :func:`written` that nothing reads any more; others are left alone."""
    if uri := getattr(df, "_tallymark_uri", None):
        remove(df.sparkSession, uri)
