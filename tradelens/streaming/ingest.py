"""Trades from files as they arrive, merged by id: a file is read once, a trade that comes again replaces itself.

The table is kept in buckets by a hash of its key. A merge rewrites the buckets that its rows fall in and no others, under
its own number; a manifest says which number each bucket is at. Readers see a merge when its manifest is there, all of it or
nothing, and files that no manifest names any more are removed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradelens.sources.store import upsert

#: Buckets of a new table, and manifests that are kept for readers that are under way.
BUCKETS, KEPT = 64, 2


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, store: str) -> list[int]:
    fs, folder = _files(spark, f"{store}/manifests")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, store: str, before: int | None = None) -> dict | None:
    """The newest manifest (before a number): number, buckets, schema and the number that each bucket is at."""
    numbers = [n for n in _numbers(spark, store) if before is None or n < before]
    if not numbers:
        return None
    return json.loads(spark.read.text(f"{store}/manifests/{numbers[-1]}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, store: str, found: dict) -> None:
    """Writes a manifest beside its place and moves it there, so it is never seen in part."""
    fs, path = _files(spark, f"{store}/manifests/{found['number']}.json")
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifests/_{found['number']}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    fs.delete(path, False)
    fs.rename(beside, path)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, store: str, found: dict, buckets: list[int] | None = None) -> DataFrame:
    """The rows of all buckets of a manifest, or of some."""
    at = {int(b): n for b, n in found["at"].items() if buckets is None or int(b) in buckets}
    if not at:
        return spark.createDataFrame([], found["schema"])
    paths = [f"{store}/data/number={n}/bucket={b}" for b, n in sorted(at.items())]
    return spark.read.schema(found["schema"]).parquet(*paths)


def merge(spark: SparkSession, store: str, batch: DataFrame, keys: list[str], number: int, buckets: int = BUCKETS) -> dict:
    """Merges batch into the table at store as number and returns the new manifest; merging a number again changes nothing.

    Of several rows of one key in a batch the greatest stays. A batch without rows leaves all buckets as they are.
    """
    before = manifest(spark, store, number) or {"buckets": buckets, "at": {}, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)}
    bucket = _bucket(keys, before["buckets"])
    touched = sorted(r.b for r in batch.select(bucket.alias("b")).distinct().collect())  # as many as buckets at most
    at = dict(before["at"])
    if touched:
        merged = upsert(_read(spark, store, before, touched), batch, keys).withColumn("bucket", bucket)
        merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/data/number={number}")
        at |= {str(b): number for b in touched}
    found = {**before, "number": number, "at": at}
    _publish(spark, store, found)
    _cleaned(spark, store)
    return found


def _cleaned(spark: SparkSession, store: str) -> None:
    """Removes old manifests, and buckets that none of the kept ones names."""
    numbers = _numbers(spark, store)
    named = set()
    for n in numbers[-KEPT:]:
        named |= {(m, int(b)) for b, m in json.loads(spark.read.text(f"{store}/manifests/{n}.json", wholetext=True).first()[0])["at"].items()}
    for n in numbers[:-KEPT]:
        fs, path = _files(spark, f"{store}/manifests/{n}.json")
        fs.delete(path, False)
    fs, folder = _files(spark, f"{store}/data")
    for version in fs.listStatus(folder) if fs.exists(folder) else []:
        n = int(version.getPath().getName().split("=")[1])
        parts = [p.getPath() for p in fs.listStatus(version.getPath()) if p.getPath().getName().startswith("bucket=")]
        old = [p for p in parts if (n, int(p.getName().split("=")[1])) not in named]
        for p in old:
            fs.delete(p, True)
        if parts and len(old) == len(parts):
            fs.delete(version.getPath(), True)


def merge_trades(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, key: str = "txn_id", files_per_trigger: int = 400) -> StreamingQuery:
    """Reads what source (JSON files of schema) has that checkpoint doesn't know, and merges it into the table at store.

    Trades are filed weeks after they are made, so no watermark drops late ones; the table itself is the state. Each batch
    is merged under its number, which a rerun of the batch repeats, so a lost driver changes nothing.
    """
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(source)
    each = lambda batch, number: merge(batch.sparkSession, store, batch, [key], number)
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, store: str) -> DataFrame | None:
    """The table as its newest manifest has it, or null where there is none."""
    found = manifest(spark, store)
    return None if found is None else _read(spark, store, found)


def resolved_when_due(picks: DataFrame, as_of: str) -> DataFrame:
    """Picks (as_of, horizon_days) whose time has come by a date."""
    return picks.filter(F.expr(f"date_add(as_of, cast(floor(horizon_days * 1.45) as int)) <= date '{as_of}'"))
