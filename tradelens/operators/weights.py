"""Factor weights: ridge regression on moments by ticker, block bootstrap, walk-forward folds, and a shuffled null.

Everything that a fit needs of its rows is a table of second moments by block, so folds, rebalance dates and null draws
are keys of one aggregation, and only small matrices are solved in tasks.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.operators.panel import FACTORS
from tradelens.operators.ranks import fifths, spearman

#: Penalty, resamples, pull towards equal weights, largest weight, and shuffles.
ALPHA, BOOTS, PULL, LARGEST, NULLS = 5.0, 60, 0.35, 0.45, 120
NAMES = [*FACTORS]
#: Rows within which a draw of the null permutes targets.
BUCKET_ROWS = 50_000


def _moments(rows: DataFrame, keys: list[str], names: list[str], y: str) -> DataFrame:
    """Sums of products of 1, the factors and y by key and block: the ticker, or each row where a key has under 6 tickers."""
    rows = rows.filter(" and ".join(f"{c} is not null and not isnan({c})" for c in [*names, y]))
    tickers = rows.groupBy(*keys).agg(F.countDistinct("ticker").alias("n_groups"))
    block = F.when(F.col("n_groups") >= 6, F.col("ticker")).otherwise(F.concat_ws("|", "ticker", F.col("date").cast("string")))
    z = [F.lit(1.0), *[F.col(c) for c in names], F.col(y)]
    sums = [F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return rows.join(F.broadcast(tickers), keys).groupBy(*keys, "n_groups", block.alias("block")).agg(F.array(*sums).alias("m"))


def _solve(m: np.ndarray, p: int, alpha: float) -> np.ndarray:
    """Ridge coefficients with an intercept, from the upper triangle of the moments."""
    full = np.zeros((p + 2, p + 2))
    full[np.triu_indices(p + 2)] = m
    full = full + np.triu(full, 1).T
    n = max(full[0, 0], 1e-12)
    centred = full[1:, 1:] - np.outer(full[0, 1:], full[0, 1:]) / n
    return np.linalg.solve(centred[:p, :p] + alpha * np.eye(p), centred[:p, p])


def final_weights(coef: np.ndarray, stability: np.ndarray) -> np.ndarray:
    """Coefficients scaled by how often resamples agree on their sign, to a sum of sizes of 1, pulled to equal weights."""
    p = len(coef)
    trusted = coef * np.clip(2 * (stability - 0.5), 0, 1)
    size, equal = np.abs(trusted).sum(), np.full(p, 1 / p)
    w = trusted / size if size > 1e-12 else equal
    side = np.sign(w.sum()) or 1.0
    w = np.clip((1 - PULL) * w + PULL * equal * side, -LARGEST, LARGEST)
    return w / np.abs(w).sum() if np.abs(w).sum() > 1e-12 else w


def fit_weights(rows: DataFrame, keys: list[str], y: str, names: list[str] | None = None, alpha: float = ALPHA, n_boot: int = BOOTS, seed: int = 0) -> DataFrame:
    """keys, n, n_groups, weights and stability (arrays in the order of names) for the rows (keys, ticker, date, names, y).

    A block (ticker) is drawn as often as a Poisson number that its name, the draw and the seed decide. Under max(30, 5 for
    each factor) rows the weights are equal.
    """
    names = names or NAMES
    return solve_weights(_moments(rows, keys, names, y), keys, names, alpha, n_boot, seed)


def solve_weights(moments: DataFrame, keys: list[str], names: list[str], alpha: float = ALPHA, n_boot: int = BOOTS, seed: int = 0) -> DataFrame:
    """What fit_weights gives, from moments (keys, n_groups, block, m)."""
    p = len(names)
    size = (p + 2) * (p + 3) // 2
    u = F.pmod(F.xxhash64("block", "_boot", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    times = F.when(F.col("_boot") == 0, 1.0).otherwise(sum((F.when(u >= float(s), 1.0).otherwise(0.0) for s in steps), F.lit(0.0)))
    drawn = moments.withColumn("_boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot)))).withColumn("times", times)
    sums = drawn.groupBy(*keys, "n_groups", "_boot").agg(F.array(*[F.sum(F.col("times") * F.col("m")[k]) for k in range(size)]).alias("m"))
    kinds = dict(moments.dtypes)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_boot")
        full = np.asarray(group.m.iloc[0])
        n = int(round(full[0]))
        if n < max(30, 5 * p):
            weights, stability = np.full(p, 1 / p), np.zeros(p)
        else:
            coef = _solve(full, p, alpha)
            boots = np.array([_solve(np.asarray(m), p, alpha) if m[0] > 1 else coef for m in group.m.iloc[1:]]).reshape(-1, p)
            stability = (np.sign(boots) == np.sign(coef)).mean(axis=0) if len(boots) else np.ones(p)
            weights = final_weights(coef, stability)
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in keys}, "n": n, "n_groups": int(group.n_groups.iloc[0]), "weights": weights.tolist(), "stability": stability.tolist()}])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, n_groups long, weights array<double>, stability array<double>"
    return sums.groupBy(*keys).applyInPandas(solve, schema)


def walk_forward(rows: DataFrame, horizon: int, n_splits: int = 6, min_train: int = 40, min_test: int = 10) -> DataFrame:
    """fold, test_start, test_end and train_until: tests in order of time, training purged of what overlaps their targets.

    Folds of fewer rows (date) than min_train to train on or min_test to test are left out, all of them for too few dates.
    """
    dates = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n_rows"))
    dates = dates.join(F.broadcast(dates.agg(F.count(F.lit(1)).alias("n_dates"))), F.col("n_dates") >= n_splits + 3)
    blocks = dates.withColumn("block", F.ntile(n_splits + 1).over(Window.orderBy("date")))  # one row for each date
    tests = blocks.filter("block > 1").groupBy((F.col("block") - 2).alias("fold")).agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.sum("n_rows").alias("n_test")).filter(F.col("n_test") >= min_test).drop("n_test")
    tests = tests.withColumn("train_until", F.date_sub("test_start", int(1.5 * horizon) + 5))
    trained = tests.join(F.broadcast(dates), F.col("date") <= F.col("train_until")).groupBy("fold").agg(F.sum("n_rows").alias("n_train"))
    return tests.join(trained.filter(F.col("n_train") >= min_train).select("fold"), "fold")


def predicted(rows: DataFrame, weights: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """rows with pred: the factors times the weights of their keys."""
    names = names or NAMES
    value = sum((F.col(c) * F.col("weights")[k] for k, c in enumerate(names)), F.lit(0.0))
    return rows.join(weights.select(*keys, "weights"), keys).withColumn("pred", value).drop("weights")


def rank_correlation(rows: DataFrame, keys: list[str], a: str, b: str, least: int = 8) -> DataFrame:
    """keys and ic: Spearman's correlation with average ranks at ties; null for fewer rows (date, ticker) than least or no spread."""
    return spearman(rows.select(*dict.fromkeys([*keys, "date", "ticker", a, b])), keys, a, b, ["date", "ticker"], least).select(*keys, F.col("rho").alias("ic"))


def quintiles(rows: DataFrame, keys: list[str], pred: str, y: str) -> DataFrame:
    """keys, top, bottom and long_short: mean outcome of the fifths with the best and the worst predictions, of 20 rows at least."""
    known = rows.select(*dict.fromkeys([*keys, "date", "ticker", pred, y])).filter(F.col(pred).isNotNull() & F.col(y).isNotNull())
    cut = fifths(known, keys, pred, ["date", "ticker"])
    out = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.when(F.col("fifth") == 4, F.col(y))).alias("top"), F.avg(F.when(F.col("fifth") == 0, F.col(y))).alias("bottom"))
    return out.filter("_n >= 20").drop("_n").withColumn("long_short", F.col("top") - F.col("bottom"))


def _draws(seed: int, *at) -> np.random.Generator:
    """The generator of a group's permutations: what the group is decides it, so a rerun deals alike."""
    return np.random.default_rng([seed, *[zlib.crc32(str(x).encode()) for x in at]])


def null_moments(train: DataFrame, y: str, draws: int, names: list[str] | None = None, bucket_rows: int = BUCKET_ROWS, seed: int = 1) -> DataFrame:
    """fold, draw, n_groups, block and m: moments by ticker of the training rows (fold, ticker, date, names, y), y dealt anew.

    Rows are dealt at random to buckets of about bucket_rows, and each draw permutes y within each bucket; the rows move once,
    however many draws there are, and sums by ticker come out.
    """
    names = names or NAMES
    p, size = len(names), (len(names) + 2) * (len(names) + 3) // 2
    known = train.filter(" and ".join(f"{c} is not null and not isnan({c})" for c in [*names, y]))
    sizes = known.groupBy("fold").agg(F.count_distinct("ticker").alias("n_groups"), F.ceil(F.count(F.lit(1)) / bucket_rows).alias("buckets"))
    dealt = known.join(F.broadcast(sizes), "fold").withColumn("bucket", F.pmod(F.xxhash64("ticker", "date", F.lit(seed)), F.col("buckets")))
    upper = np.triu_indices(p + 2)

    def permuted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ticker", "date"], kind="stable")
        fold, bucket, groups = rows.fold.iloc[0], rows.bucket.iloc[0], int(rows.n_groups.iloc[0])
        block = rows.ticker if groups >= 6 else rows.ticker + "|" + rows.date.astype(str)
        first = np.flatnonzero(np.append(True, block.to_numpy()[1:] != block.to_numpy()[:-1]))
        x, target, rng, out = np.c_[np.ones(len(rows)), rows[names].to_numpy(float)], rows[y].to_numpy(float), _draws(seed, fold, bucket), []
        for draw in range(1, draws + 1):
            z = np.c_[x, target[rng.permutation(len(target))]]
            m = np.add.reduceat(z[:, upper[0]] * z[:, upper[1]], first, axis=0)
            out.append(pd.DataFrame({"fold": fold, "draw": draw, "n_groups": groups, "block": block.to_numpy()[first], "m": list(m)}))
        return pd.concat(out)

    kind = dict(train.dtypes)["fold"]
    parts = dealt.select("fold", "bucket", "n_groups", "ticker", "date", *names, y).groupBy("fold", "bucket").applyInPandas(permuted, f"fold {kind}, draw int, n_groups long, block string, m array<double>")
    return parts.groupBy("fold", "draw", "n_groups", "block").agg(F.array(*[F.sum(F.col("m")[k]) for k in range(size)]).alias("m"))


def null_ics(train: DataFrame, test: DataFrame, y: str, draws: int, names: list[str] | None = None, n_boot: int = 8, seed: int = 1) -> DataFrame:
    """fold, draw and ic: weights refitted on permuted targets, against the test rows' targets permuted within each date."""
    names = names or NAMES
    fitted = solve_weights(null_moments(train, y, draws, names, seed=seed), ["fold", "draw"], names, n_boot=n_boot)
    weights = {(r.fold, r.draw): np.array(r.weights) for r in fitted.select("fold", "draw", "weights").collect()}  # folds times draws rows

    def scored(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ticker", kind="stable")
        fold, x, target = rows.fold.iloc[0], rows[names].to_numpy(float), rows[y].to_numpy(float)
        rng, out = _draws(seed, fold, rows.date.iloc[0]), []
        for draw in range(1, draws + 1):
            dealt = target[rng.permutation(len(target))]
            if (fold, draw) in weights:
                out.append(pd.DataFrame({"fold": fold, "draw": draw, "date": rows.date, "ticker": rows.ticker, "pred": x @ weights[fold, draw], "y": dealt}))
        return pd.concat(out) if out else pd.DataFrame(columns=["fold", "draw", "date", "ticker", "pred", "y"])

    kinds = dict(test.dtypes)
    each = test.select("fold", "date", "ticker", *names, y).groupBy("fold", "date").applyInPandas(scored, f"fold {kinds['fold']}, draw int, date {kinds['date']}, ticker string, pred double, y double")
    return rank_correlation(each, ["fold", "draw"], "pred", "y")


def backtest(scores: DataFrame, horizon: int, n_splits: int = 6, n_null: int = NULLS, n_boot: int = BOOTS, min_train: int = 40) -> DataFrame:
    """One row for each fold: sizes, ic, spread, hit rate, and the mean and 95th percentile of the null's ics.

    The null refits on targets shuffled over the training rows and predicts targets shuffled within each date.
    """
    y = f"y_{horizon}"
    rows = scores.filter(F.col(y).isNotNull()).select("ticker", "date", *NAMES, y)
    folds = walk_forward(rows, horizon, n_splits, min_train)
    train = rows.join(F.broadcast(folds), F.col("date") <= F.col("train_until")).select("fold", "ticker", "date", *NAMES, y)
    test = rows.join(F.broadcast(folds), F.col("date").between(F.col("test_start"), F.col("test_end"))).select("fold", "ticker", "date", *NAMES, y)
    weights = fit_weights(train, ["fold"], y, n_boot=n_boot)
    found = predicted(test, weights, ["fold"])
    hits = found.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.avg((F.signum("pred") == F.signum(y)).cast("double")).alias("hit_rate"))
    out = folds.join(hits, "fold").join(weights.select("fold", F.col("n").alias("n_train"), "weights", "stability"), "fold").join(rank_correlation(found, ["fold"], "pred", y), "fold", "left").join(quintiles(found, ["fold"], "pred", y), "fold", "left")
    if n_null:
        chance = null_ics(train, test, y, n_null)
        out = out.join(chance.groupBy("fold").agg(F.avg("ic").alias("null_mean"), F.expr("percentile(ic, 0.95)").alias("null_p95")), "fold", "left")
    else:
        out = out.withColumns({"null_mean": F.lit(None).cast("double"), "null_p95": F.lit(None).cast("double")})
    return out.withColumn("horizon_days", F.lit(horizon))


def backtest_summary(folds: DataFrame, trials: int = 2) -> DataFrame:
    """For each horizon: mean ic, the null's bar, whether it is beaten, the ic deflated for the trials, and the verdict."""
    out = folds.groupBy("horizon_days").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd"), F.count("ic").alias("n_ic"), F.avg("null_p95").alias("null_p95"),
        F.count_if(F.col("ic") > 0).alias("n_positive"), F.avg("long_short").alias("long_short"), F.avg("hit_rate").alias("hit_rate"),
    )
    beaten = F.coalesce(F.col("mean_ic") > F.col("null_p95"), F.lit(False))
    expected = F.sqrt(2 * F.log(F.greatest(F.col("n_folds") * trials, F.lit(2)).cast("double")))
    deflated = F.when(F.col("n_ic") > 1, F.col("mean_ic") - expected * F.when(F.col("sd") > 0, F.col("sd")).otherwise(1e-9) / F.sqrt("n_folds"))
    verdict = F.when(F.col("mean_ic").isNull(), "not enough data").when(F.col("mean_ic") <= F.col("null_p95"), "not above the shuffled null").when((F.col("n_positive") == F.col("n_ic")) & (F.col("mean_ic") > 0.02), "above the null in every fold").otherwise("above the null, not in every fold")
    margin = F.col("mean_ic") - F.coalesce("null_p95", F.lit(0.0))
    confidence = F.when(F.col("mean_ic").isNull(), 0.1).when(~beaten, 0.15).otherwise(F.least(F.greatest(0.3 + margin * 6, F.lit(0.2)), F.lit(0.8)))
    return out.select("horizon_days", "n_folds", "mean_ic", "null_p95", beaten.alias("beats_null"), deflated.alias("deflated_ic"), "n_positive", "long_short", "hit_rate", (F.col("long_short") / 4).alias("expected_scale"), verdict.alias("verdict"), confidence.alias("confidence"))
