"""Queries whose results SQL can't express: kernels over the star schema's monthly series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..config import Config
from ..functions import kernels as K
from ..operators import pairs as P
from ..operators import ranking as R
from ..sources.star import order_observations
from . import discovery as D
from .queries import monthly, tested

#: The lags and permutations are the defaults; monthly series have about 80 places, fewer than the default least number.
MONTHLY = Config(min_observations=48, prescreen=0.08)


def _pairs(spark, sf_dir):
    return P.aligned(monthly(spark, sf_dir))


def ksg_screen(spark, sf_dir):
    return D.screen(_pairs(spark, sf_dir), MONTHLY)


def lag_profile(spark, sf_dir):
    return D.by_pair(_pairs(spark, sf_dir), lambda x, y, _: (K.lag_profile(x, y, MONTHLY.max_lag),), "profile array<double>", ([],))


def lead_direction(spark, sf_dir):
    return D.directed(_pairs(spark, sf_dir), MONTHLY)


def stationarity(spark, sf_dir):
    return D.stationary(monthly(spark, sf_dir)).groupBy("variable_id", "stationary", "steps").agg(F.count("*").alias("n"))


def best_lags(spark, sf_dir):
    return D.by_pair(_pairs(spark, sf_dir), lambda x, y, _: K.best_lag(x, y, MONTHLY.max_lag), "lag int, profile array<double>", (1, [0.0]))


def granger_causality(spark, sf_dir):
    return D.by_pair(_pairs(spark, sf_dir), lambda x, y, _: K.granger(x, y, MONTHLY.max_lag), "direction string, lag int, p double, cointegrated boolean", ("none", 1, 1.0, False))


def granger_on_levels(spark, sf_dir):
    """Differences are tested unless the levels are cointegrated."""
    kernel = lambda x, y, _: K.granger(np.diff(x), np.diff(y), MONTHLY.max_lag, levels=(x, y))
    return D.by_pair(_pairs(spark, sf_dir), kernel, "direction string, lag int, p double, cointegrated boolean", ("none", 1, 1.0, False))


def granger_cross_check(spark, sf_dir):
    return D.by_pair(_pairs(spark, sf_dir), lambda x, y, _: K.granger_cross_check(x, y, MONTHLY.max_lag), "direction string, lag int, p_xy double, p_yx double", ("none", 1, 1.0, 1.0))


def cointegration(spark, sf_dir):
    return D.by_pair(_pairs(spark, sf_dir), lambda x, y, _: K.cointegration(x, y), "cointegrated boolean, p double", (False, 1.0))


def histogram_permutation(spark, sf_dir):
    return D.by_pair(_pairs(spark, sf_dir), lambda x, y, _: K.histogram_permutation_p(x, y), "mi double, p double", (0.0, 1.0))


def unit_roots(spark, sf_dir):
    def run(key, pdf):
        v = pdf.sort_values("ts")["value"].to_numpy()
        return pd.DataFrame([[*key, K.adf_p(v), K.kpss_p(v)]], columns=["variable_id", "adf_p", "kpss_p"])

    return monthly(spark, sf_dir).groupBy("variable_id").applyInPandas(run, "variable_id string, adf_p double, kpss_p double")


def out_of_sample(spark, sf_dir):
    return D.validated(_pairs(spark, sf_dir).withColumns({"lag": F.lit(2), "direction": F.lit("x->y")}))


WINDOWS = "gains array<double>, ratio double, robust boolean, breaks int, adjusted double, adjusted_robust boolean"


def walk_forward(spark, sf_dir):
    """Monthly series have about 80 places: one window of the default sizes fits, or none."""
    return D.by_pair(_pairs(spark, sf_dir), lambda x, y, _: K.walk_forward(x, y, 2), WINDOWS, ([], 0.0, False, 0, 0.0, False))


def walk_forward_short(spark, sf_dir):
    """Smaller windows, so that there are several."""
    return D.by_pair(_pairs(spark, sf_dir), lambda x, y, _: K.walk_forward(x, y, 2, 36, 14, 6), WINDOWS, ([], 0.0, False, 0, 0.0, False))


def half_split(spark, sf_dir):
    return D.by_pair(_pairs(spark, sf_dir), lambda x, y, _: K.both_halves(x, y, 2), "first double, second double, robust boolean", (0.0, 0.0, False))


def screen_all_pairs(spark, sf_dir):
    return D.screen_all(monthly(spark, sf_dir), MONTHLY)


def backtest_random(spark, sf_dir):
    """Backtest of every pair with the random baseline and the verdict."""
    return D.backtested(_pairs(spark, sf_dir).withColumn("lag", F.lit(2)))


SIGNALS = [("urgent to low", "orders:1-URGENT:F", "orders:5-LOW:F", 3), ("high to medium", "orders:2-HIGH:O", "orders:3-MEDIUM:O", 1), ("no data", "orders:9-NONE:F", "orders:5-LOW:F", 2)]


def signal_backtests(spark, sf_dir):
    """Backtests of a table of signals; the one without data is left out."""
    signals = spark.createDataFrame(SIGNALS, "name string, signal_id string, target_id string, lag long")
    return D.backtest_signals(signals, order_observations(spark, sf_dir), MONTHLY)


def candidate_revalidation(spark, sf_dir):
    return D.revalidated(R.trading_candidates(tested(spark, sf_dir)), order_observations(spark, sf_dir), MONTHLY)


def candidate_halves(spark, sf_dir):
    return D.revalidated(R.trading_candidates(tested(spark, sf_dir)), order_observations(spark, sf_dir), MONTHLY, halves=True)


def discovery(spark, sf_dir):
    """The whole run: every stage on what the one before found."""
    return D.discover(monthly(spark, sf_dir), MONTHLY).select("rank", "x", "y", "direction", "lag", "mi", "direction_pvalue", "oos_r2", "oos_valid", "score", "confidence", "caveats")


ALL = (ksg_screen, lag_profile, best_lags, lead_direction, stationarity, unit_roots, granger_causality, granger_on_levels, granger_cross_check, cointegration, histogram_permutation, out_of_sample)
ALL += (walk_forward, walk_forward_short, half_split, screen_all_pairs, backtest_random, signal_backtests, candidate_revalidation, candidate_halves, discovery)
QUERIES = {f.__name__: f for f in ALL}
