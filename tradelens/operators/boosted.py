"""Boosted trees on the panel: purged folds, error against the mean, rank correlation, spread, importance, and a leakage check."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.operators.weights import quintiles, rank_correlation, walk_forward
from tradelens.sources.staging import staged


def _model(rows: DataFrame, names: list[str], y: str, n_trees: int):
    """Missing values get the training rows' medians, or 0 where a column has none."""
    known = rows.agg(*[F.count(c).alias(c) for c in names]).first()
    filled = Imputer(inputCols=names, outputCols=[f"_{c}" for c in names], strategy="median").fit(rows.fillna({c: 0.0 for c in names if not known[c]}))
    vector = VectorAssembler(inputCols=[f"_{c}" for c in names], outputCol="_x")
    prepare = lambda df: vector.transform(filled.transform(df))
    return prepare, GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="pred", maxDepth=3, maxIter=n_trees, stepSize=0.05, minInstancesPerNode=40, seed=1).fit(prepare(rows))


def save(model, path: str) -> None:
    """Keeps a fitted model; load reads it again."""
    model.write().overwrite().save(path)


def load(path: str) -> GBTRegressionModel:
    return GBTRegressionModel.load(path)


def train(panel: DataFrame, names: list[str], y: str, horizon: int = 63, n_splits: int = 5, n_trees: int = 250) -> DataFrame:
    """One row for each fold: rmse, that of the training mean, ic and the spread between fifths. There are as many fits as folds."""
    rows = panel.filter(F.col(y).isNotNull()).select("ticker", "date", *names, y)
    out = []
    for fold in walk_forward(rows, horizon, n_splits).orderBy("fold").collect():  # a row for each fold
        past, test = rows.filter(F.col("date") <= fold.train_until), rows.filter(F.col("date").between(fold.test_start, fold.test_end))
        prepare, model = _model(past, names, y, n_trees)
        found = model.transform(prepare(test)).select("ticker", "date", y, "pred").withColumn("fold", F.lit(fold.fold))
        mean = past.agg(F.avg(y).alias("m"))
        rmse = lambda e: F.sqrt(F.avg(F.pow(e, F.lit(2))))
        errors = found.crossJoin(F.broadcast(mean)).groupBy("fold").agg(rmse(F.col(y) - F.col("pred")).alias("rmse"), rmse(F.col(y) - F.col("m")).alias("rmse_of_mean"))
        out.append(errors.join(rank_correlation(found, ["fold"], "pred", y), "fold").join(quintiles(found, ["fold"], "pred", y), "fold", "left"))
    result = out[0] if out else rows.sparkSession.createDataFrame([], "fold int, rmse double, rmse_of_mean double, ic double, top double, bottom double, long_short double")
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def importance(panel: DataFrame, names: list[str], y: str, n_trees: int = 250, repeats: int = 5, bucket_rows: int = 20_000) -> DataFrame:
    """feature, importance and sd: how much the squared error grows when a feature is dealt anew among the rows, over repeats.

    Rows are dealt at random to buckets of about bucket_rows, within which a feature's values are permuted; a bucket's
    permutations follow from its number, the feature and the repeat. All features and repeats are scored in one pass.
    """
    rows = panel.filter(F.col(y).isNotNull()).select("ticker", "date", *names, y)
    prepare, model = _model(rows, names, y, n_trees)
    buckets = max(1, -(-rows.count() // bucket_rows))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("ticker", "date"), F.lit(buckets)))

    def permuted(group: pd.DataFrame) -> pd.DataFrame:
        group, number = group.sort_values(["ticker", "date"], kind="stable"), int(group["_bucket"].iloc[0])
        kept = group[[*names, y]]
        out = [kept.assign(feature="", repeat=0)]
        for k, c in enumerate(names):
            for r in range(repeats):
                order = np.random.default_rng([number, k, r]).permutation(len(kept))
                out.append(kept.assign(**{c: kept[c].to_numpy()[order]}, feature=c, repeat=r))
        return pd.concat(out)

    kinds = dict(rows.dtypes)
    many = dealt.groupBy("_bucket").applyInPandas(permuted, ", ".join(f"`{c}` {kinds[c]}" for c in [*names, y]) + ", feature string, repeat int")
    errors = model.transform(prepare(many)).groupBy("feature", "repeat").agg(F.avg(F.pow(F.col(y) - F.col("pred"), F.lit(2))).alias("e"))
    errors = staged(errors, "errors")  # a row for each feature and repeat
    base = errors.filter("feature = ''").select(F.col("e").alias("base"))
    grown = errors.filter("feature <> ''").crossJoin(F.broadcast(base)).withColumn("g", F.col("e") - F.col("base"))
    return grown.groupBy("feature").agg(F.avg("g").alias("importance"), F.coalesce(F.stddev_pop("g"), F.lit(0.0)).alias("sd"))


def leakage_check(disclosed: DataFrame, traded: DataFrame, names: list[str], y: str, **options) -> DataFrame:
    """One row: the mean ic with features as of disclosure, as of the trades themselves, and the gap that hindsight would give."""
    mean = lambda df, name: train(df, names, y, **options).agg(F.avg("ic").alias(name))
    return mean(disclosed, "ic_disclosed").crossJoin(mean(traded, "ic_traded")).withColumn("gap", F.col("ic_traded") - F.col("ic_disclosed"))
