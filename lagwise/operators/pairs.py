"""Operators on pairs of series. A pair's rows are (x, y, ts, xv, yv) with x < y.

Pairs come from an equi-join on the date with x < y as a residual condition, so the rows
shuffled are the observations, and the joined rows are aggregated by pair with partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def pair_window() -> WindowSpec:
    return Window.partitionBy("x", "y")


#: Series in a block; with more series than this a date's pairs are dealt over several tasks.
BLOCK = 2000


def blocks_for(n_series: int) -> int:
    return max(1, -(-n_series // BLOCK))


def aligned(obs: DataFrame, blocks: int = 1) -> DataFrame:
    """The common dates of every unordered pair.

    With one block a date's pairs are made by one task. With more, series are dealt into blocks by
    a hash, every observation is sent once for each block that it may meet, and a task makes the
    pairs of one date and two blocks: blocks times the shuffle, blocks squared times the tasks.
    """
    a, b = obs.select(F.col("variable_id").alias("x"), "ts", F.col("value").alias("xv")), obs.select(F.col("variable_id").alias("y"), "ts", F.col("value").alias("yv"))
    same = (a["ts"] == b["ts"]) & (a["x"] < b["y"])
    if blocks > 1:
        of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
        a = a.withColumn("own", of("x")).withColumn("other", every)
        b = b.withColumn("own", of("y")).withColumn("other", every)
        same = (a["ts"] == b["ts"]) & (a["own"] == b["other"]) & (a["other"] == b["own"]) & (a["x"] < b["y"])
    return a.join(b, same).select("x", "y", a["ts"], "xv", "yv")


def align(obs: DataFrame, x: str, y: str, method: str = "inner") -> DataFrame:
    """ts, x, y of two series; method inner (common dates) or outer (all, null where one has none)."""
    if method not in ("inner", "outer"):
        raise ValueError(f"unknown method {method!r}")
    one = lambda i, c: obs.where(F.col("variable_id") == i).select("ts", F.col("value").alias(c))
    return one(x, "x").join(one(y, "y"), "ts", method).orderBy("ts")


def all_pairs(ids: DataFrame) -> DataFrame:
    """Every unordered pair of ids (variable_id); the pair space is the feature here."""
    a, b = ids.select(F.col("variable_id").alias("x")), ids.select(F.col("variable_id").alias("y"))
    return a.join(b, F.col("x") < F.col("y"))


def overlapping(pairs: DataFrame, least: int) -> DataFrame:
    """x, y, n of pairs with at least `least` common dates."""
    return pairs.groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def lagged(pairs: DataFrame, lag: int) -> DataFrame:
    """Pairs with x taken `lag` places earlier: (x[:n-lag], y[lag:])."""
    if not lag:
        return pairs
    return pairs.withColumn("xv", F.lag("xv", lag).over(pair_window().orderBy("ts"))).where(F.col("xv").isNotNull())


def _mid_rank(value: str):
    ties = Window.partitionBy("x", "y", value)
    return F.rank().over(pair_window().orderBy(value)) + (F.count("*").over(ties) - 1) / 2


def spearman(pairs: DataFrame) -> DataFrame:
    """x, y, n, rho: rank correlation with average ties."""
    ranked = pairs.select("x", "y", _mid_rank("xv").alias("rx"), _mid_rank("yv").alias("ry"))
    return ranked.groupBy("x", "y").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def prescreen(pairs: DataFrame, threshold: float, lags: tuple[int, ...] = (0, 1, 3, 6, 12)) -> DataFrame:
    """x, y, best: pairs whose rank correlation reaches threshold at some lag, in either direction."""
    swapped = pairs.select(F.col("x").alias("y"), F.col("y").alias("x"), "ts", F.col("yv").alias("xv"), F.col("xv").alias("yv"))
    parts = []
    for lag in lags:
        for turned, rows in ((False, pairs), (True, swapped)):
            if turned and not lag:
                continue
            rho = spearman(lagged(rows, lag)).where(F.col("n") > 20) if lag else spearman(rows)
            a, b = ("y", "x") if turned else ("x", "y")
            parts.append(rho.select(F.col(a).alias("x"), F.col(b).alias("y"), F.when(~F.isnan("rho"), F.abs("rho")).alias("rho")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("x", "y").agg(F.max("rho").alias("best")).where(F.col("best") >= threshold)


def histogram_mi(pairs: DataFrame, bins: int = 20) -> DataFrame:
    """x, y, mi: plug-in mutual information in nats on a bins * bins grid, at least 0."""
    lo_hi = pairs.groupBy("x", "y").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("xv", "yv") for f in (F.min, F.max)], F.count("*").alias("total"))
    cell = lambda c: F.when(F.col(f"{c}_max") > F.col(f"{c}_min"), F.least(F.floor((F.col(c) - F.col(f"{c}_min")) / (F.col(f"{c}_max") - F.col(f"{c}_min")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    cells = pairs.join(lo_hi, ["x", "y"]).groupBy("x", "y", "total", cell("xv").alias("bx"), cell("yv").alias("by")).agg(F.count("*").alias("c"))
    share = cells.select("x", "y", (F.col("c") / F.col("total")).alias("p"), (F.sum("c").over(Window.partitionBy("x", "y", "bx")) / F.col("total")).alias("px"), (F.sum("c").over(Window.partitionBy("x", "y", "by")) / F.col("total")).alias("py"))
    return share.groupBy("x", "y").agg(F.greatest(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))), F.lit(0.0)).alias("mi"))


def ridge_one(pairs: DataFrame, lag: int, ratio: float = 0.6, alpha: float = 1.0) -> DataFrame:
    """x, y, slope, intercept of y on x `lag` places earlier, fitted on the first floor(n * ratio) rows; closed form."""
    rows = lagged(pairs, lag).select("*", F.row_number().over(pair_window().orderBy("ts")).alias("i"), F.count("*").over(pair_window()).alias("n"))
    fit = rows.where(F.col("i") <= F.floor(F.col("n") * ratio)).groupBy("x", "y")
    s = fit.agg(F.covar_pop("xv", "yv").alias("c"), F.var_pop("xv").alias("v"), F.count("*").alias("k"), F.avg("xv").alias("mx"), F.avg("yv").alias("my"))
    slope = F.col("c") * F.col("k") / (F.col("v") * F.col("k") + alpha)
    return s.select("x", "y", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def backtest(pairs: DataFrame, lag: int, ratio: float = 0.6) -> DataFrame:
    """Sign trades of y on the ridge prediction from x, on the rows after the fit: sharpe, win rate, drawdown, buy and hold."""
    from .series import drawdown, sharpe

    rows = lagged(pairs, lag).select("*", F.row_number().over(pair_window().orderBy("ts")).alias("i"), F.count("*").over(pair_window()).alias("n"))
    test = rows.where(F.col("i") > F.floor(F.col("n") * ratio)).join(ridge_one(pairs, lag, ratio), ["x", "y"])
    position = F.when(F.col("intercept") + F.col("slope") * F.col("xv") > 0, 1.0).otherwise(-1.0)
    trades = test.select(F.concat_ws("|", "x", "y").alias("pair"), "ts", (position * F.col("yv")).alias("value"), "yv")
    hold = sharpe(trades, "pair", "yv").select("pair", F.col("sharpe").alias("hold_sharpe"))
    return sharpe(trades, "pair").join(drawdown(trades, "pair"), "pair").join(hold, "pair")


def ar1_mse(obs: DataFrame, ratio: float = 0.7) -> DataFrame:
    """variable_id, phi, mse of an autoregression of order 1 without intercept, on the rows after the fit."""
    from .series import by_time, split_at

    rows = split_at(obs, ratio).withColumn("before", F.lag("value").over(by_time())).where(F.col("before").isNotNull())
    fit = rows.where("train").groupBy("variable_id").agg((F.sum(F.col("value") * F.col("before")) / F.sum(F.col("before") * F.col("before"))).alias("phi"))
    test = rows.where(~F.col("train")).join(fit, "variable_id")
    return test.groupBy("variable_id", "phi").agg(F.avg(F.pow(F.col("value") - F.col("phi") * F.col("before"), 2)).alias("mse"))


def walk_forward_windows(lengths: DataFrame, train: int = 60, test: int = 24, step: int = 12) -> DataFrame:
    """A row per (keys, lag, n) and window start that fits: start, train_end, test_end."""
    last = F.col("n") - train - test - F.col("lag")
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))
    out = lengths.withColumn("start", F.explode(starts))
    return out.withColumns({"train_end": F.col("start") + train, "test_end": F.col("start") + train + test + F.col("lag").cast("int")})
