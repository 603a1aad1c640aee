"""Operators on long-form series: observations(variable_id, ts, value), catalog(variable_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

CATALOG = "variable_id string, source string, name string, frequency string, unit string, geo string, observations int, start_date date, end_date date, domain string"
OBSERVATIONS = "variable_id string, ts date, value double"


def by_time() -> WindowSpec:
    return Window.partitionBy("variable_id").orderBy("ts")


def real(value: str = "value") -> Column:
    """value with NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(value), F.col(value))


def catalog_of(obs: DataFrame) -> DataFrame:
    """Counts and first and last dates of each series."""
    return obs.groupBy("variable_id").agg(F.count("*").alias("observations"), F.min("ts").alias("start_date"), F.max("ts").alias("end_date"))


def list_series(catalog: DataFrame, source: str | None = None, geo: str | None = None) -> DataFrame:
    for name, value in (("source", source), ("geo", geo)):
        if value is not None:
            catalog = catalog.where(F.col(name) == value)
    return catalog.orderBy("variable_id")


def get_series(catalog: DataFrame, variable_id: str) -> DataFrame:
    return catalog.where(F.col("variable_id") == variable_id).withColumn("unit", F.coalesce("unit", F.lit("")))


def get_observations(obs: DataFrame, variable_id: str, start=None, end=None) -> DataFrame:
    """ts, value of one series, both ends of the range included."""
    found = obs.where(F.col("variable_id") == variable_id)
    if start is not None:
        found = found.where(F.col("ts") >= F.lit(start).cast("date"))
    if end is not None:
        found = found.where(F.col("ts") <= F.lit(end).cast("date"))
    return found.select("ts", "value").orderBy("ts")


def latest(rows: DataFrame, keys: list[str], seq: str = "load_seq") -> DataFrame:
    """The last loaded row of each key: an upsert. One partial aggregate, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest if c != seq])


def upsert(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """held with new's rows in place of those with equal keys."""
    return latest(held.withColumn("load_seq", F.lit(0)).unionByName(new.withColumn("load_seq", F.lit(1))), keys)


def median_gap(obs: DataFrame) -> DataFrame:
    """Median days between neighbours; 0 for series of under two points."""
    gaps = obs.select("variable_id", F.datediff("ts", F.lag("ts").over(by_time())).alias("gap"))
    return gaps.groupBy("variable_id").agg(F.coalesce(F.median("gap"), F.lit(0.0)).alias("median_gap"))


def resample(obs: DataFrame, unit: str = "month", how: str = "avg") -> DataFrame:
    """One value per calendar month, quarter or year, labelled by its first day; empty ones are absent."""
    fold = {"avg": F.avg, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "last": lambda v: F.max_by(v, "ts"), "first": lambda v: F.min_by(v, "ts")}[how]
    return obs.groupBy("variable_id", F.trunc("ts", unit).alias("label")).agg(fold(real()).alias("value")).select("variable_id", F.col("label").alias("ts"), "value")


def resample_frequent(obs: DataFrame, below: float = 25) -> DataFrame:
    """Monthly means of series with a median gap below `below` days; others as they are."""
    marked = obs.join(median_gap(obs), "variable_id")
    often = F.col("median_gap") < below
    return resample(marked.where(often)).unionByName(marked.where(~often).select("variable_id", "ts", "value"))


def target_unit(gap: float) -> str:
    """The calendar unit of a median gap in days."""
    if 85 <= gap <= 95:
        return "quarter"
    return "year" if 360 <= gap <= 370 else "month"


def downsample(high: DataFrame, low: DataFrame, how: str = "avg") -> DataFrame:
    """ts, high, low: one series (ts, value) brought to the calendar unit of a sparser one, then dates they share.

    Where `high` isn't denser than `low`, both are aligned as they are.
    """
    two = high.select(F.lit("high").alias("variable_id"), "ts", "value").unionByName(low.select(F.lit("low").alias("variable_id"), "ts", "value"))
    gaps = {r["variable_id"]: r["median_gap"] for r in median_gap(two).collect()}  # two rows
    one = lambda i, rows: rows.where(F.col("variable_id") == i).select("ts", F.col("value").alias(i))
    left = two if gaps.get("high", 0.0) >= gaps.get("low", 0.0) else resample(two.where("variable_id = 'high'"), target_unit(gaps["low"]), how)
    return one("high", left).join(one("low", two), "ts").orderBy("ts")


def quality(obs: DataFrame, min_obs: int = 120, min_var: float = 1e-10, max_nan: float = 0.20) -> DataFrame:
    """Each series' verdict and the first rule that it breaks."""
    v = real()
    s = obs.groupBy("variable_id").agg(F.count("*").alias("total"), F.count(v).alias("n_observations"), F.var_pop(v).alias("variance"))
    s = s.withColumn("nan_ratio", 1 - F.col("n_observations") / F.col("total"))
    reason = F.when(F.col("nan_ratio") > max_nan, "nan ratio").when(F.col("n_observations") < min_obs, "observations").when(F.coalesce("variance", F.lit(0.0)) < min_var, "variance").otherwise("")
    return s.withColumn("reason", reason).withColumn("passed", F.col("reason") == "").drop("total")


def first_difference(obs: DataFrame) -> DataFrame:
    return obs.withColumn("value", F.col("value") - F.lag("value").over(by_time())).where(F.col("value").isNotNull())


def detrend(obs: DataFrame) -> DataFrame:
    """Residuals from a least-squares line through places 0..n-1."""
    placed = obs.withColumn("i", F.row_number().over(by_time()) - 1)
    line = placed.groupBy("variable_id").agg(F.regr_slope("value", "i").alias("slope"), F.regr_intercept("value", "i").alias("level"))
    return placed.join(line, "variable_id").select("variable_id", "ts", (F.col("value") - F.col("level") - F.coalesce("slope", F.lit(0.0)) * F.col("i")).alias("value"))


def split_at(obs: DataFrame, ratio: float) -> DataFrame:
    """obs with place i, length n, and train: whether i is among the first floor(n * ratio)."""
    every = Window.partitionBy("variable_id")
    out = obs.select("*", (F.row_number().over(by_time()) - 1).alias("i"), F.count("*").over(every).alias("n"))
    return out.withColumn("train", F.col("i") < F.floor(F.col("n") * ratio))


def zscore_by_train(obs: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Values standardised by mean and population deviation (at least 1e-10) of the training part."""
    rows = split_at(obs, ratio)
    stats = rows.where("train").groupBy("variable_id").agg(F.avg("value").alias("m"), F.greatest(F.stddev_pop("value"), F.lit(1e-10)).alias("s"))
    return rows.join(stats, "variable_id").select("variable_id", "ts", "train", ((F.col("value") - F.col("m")) / F.col("s")).alias("z"))


def clip01(x: Column, high) -> Column:
    """x / high within 0 and 1; 0 where high isn't positive."""
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(high <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / high)))


def drawdown(returns: DataFrame, key: str = "variable_id", order: str = "ts", value: str = "value", start: float = 100.0) -> DataFrame:
    """Each row's equity (start + running sum) and the deepest fall so far from a peak, as a share of that peak."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    eq = returns.withColumn("equity", start + F.sum(value).over(w))
    fall = eq.withColumn("peak", F.max("equity").over(w)).withColumn("fall", (F.col("equity") - F.col("peak")) / F.col("peak"))
    return fall.groupBy(key).agg(F.max_by("equity", order).alias("final_equity"), F.min("fall").alias("max_drawdown"))


def sharpe(returns: DataFrame, key: str = "variable_id", value: str = "value", periods: int = 12) -> DataFrame:
    n, sd = F.count(value), F.stddev_pop(value)
    ratio = F.when((n < 2) | (sd < 1e-10), 0.0).otherwise(F.avg(value) / sd * F.sqrt(F.lit(float(periods))))
    return returns.groupBy(key).agg(ratio.alias("sharpe"), F.avg((F.col(value) > 0).cast("int")).alias("win_rate"), (F.avg(value) * periods).alias("annual_mean"))
