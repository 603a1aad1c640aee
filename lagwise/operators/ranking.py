"""Multiple testing, scores, ranks and filters on rows of tested pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import clip01


def benjamini_hochberg(rows: DataFrame, alpha: float = 0.05, p: str = "p") -> DataFrame:
    """rows with fdr_significant. The ranks come from counts of equal p-values, summed over the distinct ones."""
    counts = rows.groupBy(p).agg(F.count("*").alias("_c"))
    ranks = counts.select(p, F.sum("_c").over(Window.orderBy(p)).alias("_r"))
    total = counts.agg(F.sum("_c").alias("_n"))
    limit = ranks.join(F.broadcast(total)).where(F.col(p) <= F.col("_r") / F.col("_n") * alpha).agg(F.max(p).alias("_limit"))
    return rows.join(F.broadcast(limit)).withColumn("fdr_significant", F.coalesce(F.col(p) <= F.col("_limit"), F.lit(False))).drop("_limit")


def round_half_even(x: Column, places: int) -> Column:
    return F.rint(x * 10**places) / 10**places


def score(rows: DataFrame, weights=(0.25, 0.25, 0.35, 0.15)) -> DataFrame:
    """rows(mi, direction_pvalue, oos_r2, oos_valid, fdr_significant) with score 0 to 10 and confidence."""
    top = rows.agg(F.greatest(F.coalesce(F.max("mi"), F.lit(0.0)), F.lit(0.01)).alias("max_mi"))
    strength = -F.log10(F.greatest(F.col("direction_pvalue"), F.lit(1e-15)))
    parts = [clip01(F.col("mi"), F.col("max_mi")), clip01(strength, 10), clip01(F.col("oos_r2"), 0.3), clip01(strength * F.greatest(F.col("oos_r2"), F.lit(0.0)), 3)]
    raw = sum((w * p for w, p in zip(weights, parts)), F.lit(0.0))
    out = rows.join(F.broadcast(top)).withColumn("score", round_half_even(10 * raw, 2)).drop("max_mi")
    sure = F.when((F.col("score") >= 7) & F.col("oos_valid") & F.col("fdr_significant"), "high").when((F.col("score") >= 4) & (F.col("oos_valid") | F.col("fdr_significant")), "medium")
    return out.withColumn("confidence", sure.otherwise("low"))


def rank(rows: DataFrame, order=("score",), ties=("x", "y")) -> DataFrame:
    """rows with rank 1..N, best first; equal scores in the order of their ids.

    Only the distinct scores (two places, so about a thousand) are sorted in one task; rows are
    sorted within their score and moved up by how many have a better one.
    """
    counts = rows.groupBy(*order).agg(F.count("*").alias("_n"))
    better = F.coalesce(F.sum("_n").over(Window.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(*[F.col(c).alias(f"_{c}") for c in order], better.alias("_base"))
    same = F.lit(True)
    for c in order:
        same = same & rows[c].eqNullSafe(base[f"_{c}"])
    out = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*order).orderBy(*ties)))
    return out.join(base, same).withColumn("rank", (F.col("_base") + F.col("_place")).cast("long")).drop("_base", "_place", *[f"_{c}" for c in order])


def caveats(rows: DataFrame) -> DataFrame:
    notes = F.array(F.when(~F.col("oos_valid"), "out-of-sample validation failed"), F.when(F.col("direction") == "bidirectional", "bidirectional"))
    return rows.withColumn("caveats", F.array_compact(notes))


def last_segment(variable_id: Column) -> Column:
    return F.element_at(F.split(variable_id, ":"), -1)


def blacklisted(variable_id: Column, prefix: str = "STLPPM") -> Column:
    return F.upper(last_segment(variable_id)).startswith(prefix)


def identity(x_id: Column, y_id: Column, x_name: Column, y_name: Column) -> Column:
    """1 for one id, 0.95 for one name, else the share of common words where it is over 0.7, else 0."""
    a, b = (F.array_distinct(F.array_remove(F.split(F.upper(c), r"\s+"), "")) for c in (x_name, y_name))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return F.when(x_id == y_id, 1.0).when(F.upper(x_name) == F.upper(y_name), 0.95).when(share > 0.7, share).otherwise(0.0)


def filter_chain(rows: DataFrame, threshold: float = 0.5, seasons: tuple[int, ...] = (4, 12)) -> DataFrame:
    """rows(x, y, x_name, y_name, lag, score) without blacklisted ids, near-identical series and seasonal echoes, ranked again."""
    same = identity(F.col("x"), F.col("y"), F.col("x_name"), F.col("y_name"))
    kept = rows.where(~blacklisted(F.col("x")) & ~blacklisted(F.col("y"))).where(same <= threshold).where(~(F.col("lag").isin(*seasons) & (same > 0.5)))
    return rank(kept)


def trading_candidates(rows: DataFrame, min_lag: int = 1, min_r2: float = 0.01, most: int = 10) -> DataFrame:
    """signal, target, lag, oos_r2, description of the `most` best one-way, validated rows."""
    one_way = rows.where((F.col("direction") != "bidirectional") & (F.col("lag") >= min_lag) & (F.col("oos_r2") >= min_r2) & F.col("oos_valid"))
    forward = F.col("direction").isin("x->y", "x→y")
    out = one_way.select(F.when(forward, F.col("x")).otherwise(F.col("y")).alias("signal"), F.when(forward, F.col("y")).otherwise(F.col("x")).alias("target"), "lag", "oos_r2")
    out = out.orderBy(F.desc("oos_r2"), "signal", "target").limit(most)
    return out.withColumn("description", F.format_string("%s leads %s by %d periods (R2 %.4f)", "signal", "target", "lag", "oos_r2"))


def known_relations(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """For each relation(name, a, b: keyword arrays) the first ranked row whose ids hold a word of each, either way round; null if none."""
    has = lambda c, words: F.exists(words, lambda w: F.contains(F.upper(c), F.upper(w)))
    x, y, a, b = F.col("x"), F.col("y"), F.col("a"), F.col("b")
    hit = relations.join(rows.select("x", "y", "rank"), (has(x, a) & has(y, b)) | (has(x, b) & has(y, a)), "left")
    return hit.groupBy("name").agg(F.min("rank").alias("rank"))


def high_correlation(rows: DataFrame, rho: DataFrame, most: float = 0.95, least: int = 48) -> DataFrame:
    """rows without pairs whose levels correlate over `most` on `least` dates or more; pairs without data stay."""
    drop = rho.where((F.col("n") >= least) & (F.abs("rho") > most)).select("x", "y")
    return rows.join(drop, ["x", "y"], "left_anti")


def verdict(beats_random: Column, beats_hold: Column) -> Column:
    """What a backtest shows, in words; null where it wasn't run."""
    random = F.when(beats_random, "beats random (>2 sigma)").when(~beats_random, "does NOT beat random")
    return F.concat(random, F.lit(" | "), F.when(beats_hold, "beats buy-and-hold").otherwise("does NOT beat buy-and-hold"))


def gates(found: DataFrame, rules: dict[str, tuple[str, int]]) -> DataFrame:
    """gate, value, least, passed: a row per rule name -> (column of the one row of found, least value)."""
    rows = F.array(*[F.struct(F.lit(name).alias("gate"), F.col(c).cast("long").alias("value"), F.lit(least).cast("long").alias("least")) for name, (c, least) in rules.items()])
    return found.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.value") >= F.col("r.least")).alias("passed"))
