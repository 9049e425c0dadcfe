"""What every operator shares: reading tables, the shared folder, cutting lineage, finding hot keys."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder (a file or a directory of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that they need no copy of their own."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="gridloom-code-")  # on the driver; Spark hands the file out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "gridloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only on one machine, where the session may name none, a temporary folder is made; on a cluster that raises.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


_written: list[str] = []


def materialize(df: DataFrame, label: str, most_rows: int = 0) -> DataFrame:
    """Write `df` as a compressed table in the shared folder, in files of `most_rows` rows at most if given, and read it back.

    Cuts the lineage and survives the loss of any executor. Takes a Spark job. The table goes with `release` or when
    the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridloom-{label}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", maxRecordsPerFile=most_rows).parquet(path)
    if not _written:
        atexit.register(_forget, spark)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(df: DataFrame) -> None:
    """Remove the table of a materialized frame that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    if path in _written:
        _remove(df.sparkSession, path)
        _written.remove(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of frames that are gone; else they stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession) -> None:
    for path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: what lies on this machine can go all the same
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


#: Keys with more than this share of all rows are hot, if those are more than HOT_ROWS.
HOT_SHARE, HOT_ROWS = 1_000, 1_000_000


def meet(many: DataFrame, one: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """`many` joined with `one`, which has a row per key and `group_rows`, how many of about `rows` rows of `many` have the key.

    Keys with more than 1 / HOT_SHARE of all rows, HOT_SHARE at most, meet theirs by broadcast, others by a shuffle, in which
    no key has more than that share. `group_rows` is dropped.
    """
    limit = max(rows // HOT_SHARE, HOT_ROWS)
    if rows <= limit:
        return many.join(one.drop("group_rows"), list(keys))
    hot = one.where(F.col("group_rows") > limit).drop("group_rows")
    rest = many.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(one.where(F.col("group_rows") <= limit).drop("group_rows"), list(keys))
    return rest.unionByName(many.join(F.broadcast(hot), list(keys)))


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int, *extra) -> DataFrame | None:
    """Groups of more than `limit` rows with `group_rows` and the aggregates `extra`, or None.

    The counts are pre-aggregated before the shuffle; at most rows / `limit` groups can come out.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"), *extra).where(F.col("group_rows") > limit)
    return None if counted.isEmpty() else counted
