"""The discovery run: observations to ranked, validated, directed relations.

Relational stages stay in the JVM; the kernels run one pair or one series per group through
Arrow, so the work spreads over pairs. Each stage keeps only the pairs that passed the one
before. A kernel that fails gives its neutral value and the reason in `error`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import kernels as K
from ..operators import pairs as P
from ..operators import ranking as R
from ..operators import series as S
from ..session import written


def stationary(obs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """obs of each series after differencing or detrending, with `steps` and `stationary`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        v, ok, steps = K.make_stationary(pdf["value"].to_numpy(), cfg.stationarity_alpha, cfg.max_differences)
        out = pdf.iloc[len(pdf) - len(v) :]
        return pd.DataFrame({"variable_id": out["variable_id"], "ts": out["ts"], "value": v, "stationary": ok, "steps": ",".join(steps)})

    return obs.select("variable_id", "ts", "value").groupBy("variable_id").applyInPandas(run, "variable_id string, ts date, value double, stationary boolean, steps string")


def by_pair(pairs: DataFrame, kernel, fields: str, neutral: tuple) -> DataFrame:
    """x, y, n, fields, error: kernel(xv, yv, row) of every pair's aligned values."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        try:
            got, error = kernel(pdf["xv"].to_numpy(), pdf["yv"].to_numpy(), pdf.iloc[0]), None
        except (ValueError, np.linalg.LinAlgError) as e:
            got, error = neutral, str(e)
        return pd.DataFrame([[*key, len(pdf), *got, error]], columns=["x", "y", "n", *names, "error"])

    return pairs.groupBy("x", "y").applyInPandas(run, f"x string, y string, n long, {fields}, error string")


def screen(pairs: DataFrame, cfg: Config = Config()) -> DataFrame:
    return by_pair(pairs, lambda x, y, _: K.permutation_p(x, y, cfg.permutations, cfg.neighbors, cfg.significance, cfg.seed), "mi double, mi_pvalue double", (0.0, 1.0))


def directed(pairs: DataFrame, cfg: Config = Config()) -> DataFrame:
    return by_pair(pairs, lambda x, y, _: K.direction(x, y, cfg.max_lag, cfg.direction_permutations, cfg.neighbors, cfg.significance), "direction string, lag int, direction_pvalue double", ("none", 1, 1.0))


def validated(pairs: DataFrame, cfg: Config = Config(), oriented: bool = False) -> DataFrame:
    """Out-of-sample gain of pairs that carry a lag; oriented: along the direction found, else always x to y."""

    def run(x, y, row):
        a, b = (y, x) if oriented and row["direction"] == "y->x" else (x, y)
        r2 = K.out_of_sample(a, b, int(row["lag"]), cfg.train_ratio)
        return r2, bool(r2 > cfg.min_r2)

    return by_pair(pairs, run, "oos_r2 double, oos_valid boolean", (0.0, False))


def prepared(obs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """variable_id, ts, value of the series that pass the quality gate, made stationary, and still long enough after that."""
    obs = written(S.resample_frequent(obs), "resampled")  # read twice from here on
    fit = S.quality(obs, cfg.min_observations, cfg.min_variance, cfg.max_nan_ratio).where("passed").select("variable_id")
    ready = written(stationary(obs.join(fit, "variable_id", "left_semi"), cfg).select("variable_id", "ts", "value"), "series")
    long = ready.groupBy("variable_id").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.min_observations)
    return ready.join(long, "variable_id", "left_semi")


def screen_all(obs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """x, y, n, mi, mi_pvalue of all pairs of equally long series whose information is significant."""
    same = P.aligned(obs)
    lengths = obs.groupBy("variable_id").agg(F.count("*").alias("n"))
    found = screen(same, cfg).where(F.col("mi_pvalue") < cfg.significance).drop("error")
    for c in ("x", "y"):
        found = found.join(lengths.select(F.col("variable_id").alias(c), F.col("n").alias(f"n_{c}")), c)
    return found.where("n_x = n_y").drop("n_x", "n_y")


def discover(obs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """rank, x, y, direction, lag, mi, direction_pvalue, oos_r2, oos_valid, score, confidence, caveats.

    Fewer than two series give an empty result. Every stage is written, so that no plan holds the ones before.
    """
    ready = prepared(obs, cfg)
    pairs = P.aligned(ready, P.blocks_for(ready.select("variable_id").distinct().count()))
    long = P.overlapping(pairs, cfg.min_observations).select("x", "y")
    if cfg.prescreen > 0:
        long = long.join(written(P.prescreen(pairs, cfg.prescreen, cfg.prescreen_lags).select("x", "y"), "prescreened"), ["x", "y"], "left_semi")
    pairs = written(pairs.join(long, ["x", "y"], "left_semi"), "pairs")
    found = written(screen(pairs, cfg).where(F.col("mi_pvalue") < cfg.significance).select("x", "y", "mi", "mi_pvalue"), "screened")
    led = written(directed(pairs.join(found, ["x", "y"], "left_semi"), cfg).where("direction <> 'none'").drop("n", "error"), "directed")
    led = R.benjamini_hochberg(found.join(led, ["x", "y"]), cfg.fdr_alpha, "direction_pvalue").where("fdr_significant")
    led = written(led, "significant")
    proof = written(validated(pairs.join(led.select("x", "y", "lag", "direction"), ["x", "y"]), cfg).drop("n", "error"), "validated")
    return R.caveats(R.rank(R.score(led.join(proof, ["x", "y"]), cfg.weights)))


def revalidated(candidates: DataFrame, obs: DataFrame, cfg: Config = Config(), halves: bool = False, least_common: int = 60, most: int = 10) -> DataFrame:
    """The best `most` candidates (signal, target, lag, oos_r2) with walk-forward figures, or with both halves', and status.

    Series are resampled, aligned on `least_common` months at least, made stationary each and aligned again.
    """
    top = candidates.orderBy(F.desc("oos_r2"), "signal", "target").limit(most)
    month = S.resample(obs)
    one = lambda c, v: month.select(F.col("variable_id").alias(c), "ts", F.col("value").alias(v))
    both = top.join(one("signal", "xv"), "signal").join(one("target", "yv"), ["target", "ts"])
    names = ["first", "second"] if halves else ["gains", "ratio", "breaks", "adjusted"]
    kinds = ["double", "double"] if halves else ["array<double>", "double", "int", "double"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, lag = pdf.sort_values("ts"), int(key[2])
        nothing = [None] * len(names)
        values, status = nothing, "TOO FEW COMMON"
        if len(pdf) >= least_common:
            (x, *_), (y, *_) = (K.make_stationary(pdf[c].to_numpy(), cfg.stationarity_alpha, cfg.max_differences) for c in ("xv", "yv"))
            n = min(len(x), len(y))  # differences lose their first places
            x, y, status = x[len(x) - n :], y[len(y) - n :], "TOO SHORT"
            if n >= lag + 40 and halves:
                *values, good = K.both_halves(x, y, lag)
                status = "ROBUST" if good else "FRAGILE"
            elif n >= lag + 40:
                gains, ratio, good, breaks, adjusted, still = K.walk_forward(x, y, lag)
                values = [gains, ratio, breaks, adjusted]
                status = ("ROBUST*" if still else "FRAGILE") if breaks else ("ROBUST" if good else "FRAGILE")
        return pd.DataFrame([[*key, *values, status]], columns=["signal", "target", "lag", *names, "status"])

    schema = "signal string, target string, lag long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", status string"
    return both.withColumn("lag", F.col("lag").cast("long")).groupBy("signal", "target", "lag").applyInPandas(run, schema)


BACKTEST = "train int, test int, slope double, sharpe double, yearly double, drawdown double, win_rate double, hold_sharpe double, hold_yearly double, hold_drawdown double, random_mean double, random_deviation double"


def backtested(pairs: DataFrame, draws: int = 1000) -> DataFrame:
    """Figures of each pair (x, y, ts, xv, yv, lag) against holding and random positions, with verdict; pairs that are too short have only an error."""
    out = by_pair(pairs, lambda x, y, row: K.backtest(x, y, int(row["lag"]), draws=draws), BACKTEST, (None,) * 12)
    random = F.col("sharpe") > F.col("random_mean") + 2 * F.col("random_deviation")
    hold = F.col("sharpe") > F.col("hold_sharpe")
    return out.withColumn("verdict", R.verdict(random, hold))


def backtest_signals(signals: DataFrame, obs: DataFrame, cfg: Config = Config(), draws: int = 1000) -> DataFrame:
    """The backtest of each row of signals (name, signal_id, target_id, lag) on monthly, stationary series; signals without data are left out."""
    wanted = signals.select(F.col("signal_id").alias("variable_id")).union(signals.select("target_id")).distinct()
    month = written(stationary(S.resample(obs).join(F.broadcast(wanted), "variable_id", "left_semi"), cfg).select("variable_id", "ts", "value"), "signals")
    one = lambda c, v: month.select(F.col("variable_id").alias(c), "ts", F.col("value").alias(v))
    both = signals.join(one("signal_id", "xv"), "signal_id").join(one("target_id", "yv"), ["target_id", "ts"])
    out = backtested(both.select(F.col("name").alias("x"), F.col("target_id").alias("y"), "ts", "xv", "yv", "lag"), draws)
    return out.withColumnsRenamed({"x": "name", "y": "target_id"})


def as_hypotheses(ranked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Nested rows with both series' metadata; pairs without metadata are left out."""
    meta = lambda c: catalog.select(F.col("variable_id").alias(c), F.struct("*").alias(f"{c}_series"))
    return ranked.join(meta("x"), "x").join(meta("y"), "y")
