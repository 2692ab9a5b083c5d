"""The domain views over the test tables as DataFrames, and which of them are computed once and kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradelens.operators.activity import ACTIVITY_VIEWS
from tradelens.operators.market import MARKET_VIEWS
from tradelens.plans.dialect import TABLES, spark_frame
from tradelens.plans.scaled import SCALED
from tradelens.sources.staging import fingerprint, staged
from tradelens.sources.views import VIEWS

ALL_VIEWS = VIEWS | ACTIVITY_VIEWS | MARKET_VIEWS
#: The views as Spark runs them.
SPARK_VIEWS = ALL_VIEWS | SCALED
#: Views that many queries use and that take joins or windows over facts: written once, read from then on.
STORED = frozenset({"quotes", "prices", "tradingdays", "relative", "daily", "paired", "stats", "scores", "split", "quarterly", "composite", "zscored"})


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark_frame(spark, sf_dir, text, SPARK_VIEWS, STORED)


_KEPT: dict[tuple[str, str, str, str], DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What make gives for these tables as they are now, staged when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, name, fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES]))
    if key not in _KEPT:
        _KEPT[key] = staged(make(spark, sf_dir), name)
    return _KEPT[key]
