"""Stages of a refresh with a log of runs: what is done for the same input is skipped, failures are recorded and tried again."""

from __future__ import annotations

import hashlib
import traceback
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelens.sources.store import preserved

#: The log's columns; a run appends a row for each stage that it started or had to leave out.
LOG = "run string, stage string, version string, status string, n_rows long, note string, finished_at timestamp"


@dataclass
class Stage:
    """A step of a refresh: run gives how many rows it wrote; needs names the stages that must be done before."""

    name: str
    run: Callable[[SparkSession], int]
    needs: list[str] = field(default_factory=list)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log; empty where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(path)


def done(log: DataFrame) -> set[tuple[str, str]]:
    """(stage, version) of what the log has as done: a row for each stage and input, however often it ran."""
    return {(r.stage, r.version) for r in log.filter("status = 'ok'").select("stage", "version").distinct().collect()}


def run_stages(spark: SparkSession, stages: list[Stage], path: str, inputs: str) -> dict[str, str]:
    """Runs stages in their order and gives the status of each: ok, skipped, error or blocked.

    inputs says what state the inputs are in (as fingerprint does); with the stages before it, it is a stage's version. A
    stage that is logged as ok for its version is skipped. After an error the stages that need it are blocked and the others
    go on; a later call with the same inputs runs what isn't done yet.
    """
    run, known, status, versions = uuid.uuid4().hex, done(run_log(spark, path)), {}, {}
    for stage in stages:
        versions[stage.name] = version = hashlib.sha256("|".join([stage.name, inputs, *[versions[n] for n in stage.needs]]).encode()).hexdigest()[:16]
        n_rows, note = None, None
        if any(status[n] in ("error", "blocked") for n in stage.needs):
            status[stage.name], note = "blocked", "needs " + ", ".join(n for n in stage.needs if status[n] in ("error", "blocked"))
        elif (stage.name, version) in known:
            status[stage.name] = "skipped"
            continue
        else:
            try:
                n_rows, status[stage.name] = int(stage.run(spark)), "ok"
            except Exception:  # recorded with its trace; the stages that need it are left out
                status[stage.name], note = "error", traceback.format_exc()[-2000:]
        row = spark.createDataFrame([(run, stage.name, version, status[stage.name], n_rows, note)], LOG.rsplit(",", 1)[0])
        row.withColumn("finished_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
    return status


def stored_universe(old: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """The new universe (ticker, rank ...) with added_on: as old has it for the names that stay, else as_of."""
    return preserved(old, new.withColumn("added_on", F.to_date(F.lit(as_of))), "ticker", "added_on")


def universe_tickers(universe: DataFrame, trades: DataFrame, fallback: int = 300) -> DataFrame:
    """ticker and place: the universe by rank; where it is empty the tickers of most trades that are sure of theirs."""
    listed = universe.select("ticker", F.col("rank").cast("long").alias("place"))
    most = trades.filter("ticker is not null and ticker_confidence >= 0.7").groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ticker").limit(fallback)
    placed = most.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "ticker")).cast("long")).select("ticker", "place")  # of fallback rows
    none = listed.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")  # one row where the universe is empty, else none
    return listed.unionByName(placed.join(F.broadcast(none.select("n")), F.lit(True)).select("ticker", "place"))
