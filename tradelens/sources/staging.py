"""Tables that a job writes for itself: in the folder that driver and executors share, read again by any later step."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, as in tests, a local application has one temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tradelens-")
        _OWN[spark.sparkContext.applicationId] = folder
    return folder


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver ends."""
    context = spark.sparkContext
    path = f"{shared_folder(spark)}/tables-{context.applicationId}"
    if f"#{path}" not in _OWN:
        _OWN[f"#{path}"] = path
        atexit.register(_ended, context, path)
    return path


def _ended(context, path: str) -> None:
    if context._jsc is not None and not context._jsc.sc().isStopped():
        _dropped(context, path)


def _dropped(context, path: str) -> None:
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows from a Parquet table in the shared folder, so a lost executor loses none of the work before it."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """What tells the files at the paths from any later state of them: names, sizes and times of change."""
    found = []
    for p in sorted(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in sorted(fs.listStatus(where), key=lambda f: f.getPath().toString()):
            found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return "|".join(found)


def numbered(df: DataFrame, *order: str | Column, keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """df with place: 1, 2, 3 ... in the order, within each of keys if any, by a range exchange and the sizes of its parts.

    No task sees the whole, or all of a key: a part holds a range of keys and values, and the sizes of a key's parts are
    added up. The rows are staged once, so the places stay whatever is computed from them. Rows that the order doesn't tell
    apart are numbered in any order; a key may be null.
    """
    keys = keys or []
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    rows = staged(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row for each part of a key
    upto = Window.partitionBy(*keys) if keys else Window
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first", "_before")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(before, same).withColumn("place", F.col("_before") + F.col("_at") - F.col("_first") + 1).select(*df.columns, "place")
