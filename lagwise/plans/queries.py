"""Queries over the star schema, one per operator, each with the same in SQL.

Computed doubles are rounded to 6 places, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..operators import pairs as P
from ..operators import ranking as R
from ..operators import series as S
from ..session import new_path, written
from ..sources import payloads as L
from ..sources.star import order_catalog, order_observations, table
from . import reports as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

OBS = "obs AS (SELECT concat('orders:', o_orderpriority, ':', o_orderstatus) AS variable_id, CAST(o_orderdate AS DATE) AS ts, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(*) AS value FROM orders GROUP BY 1, 2)"
MON = OBS + ", mon AS (SELECT variable_id, CAST(date_trunc('month', ts) AS DATE) AS ts, floor(avg(value) * 1e6 + 0.4999) / 1e6 AS value FROM obs GROUP BY 1, 2)"
PAIRS = MON + ", pairs AS (SELECT a.variable_id AS x, b.variable_id AS y, a.ts, a.value AS xv, b.value AS yv FROM mon a JOIN mon b ON a.ts = b.ts AND a.variable_id < b.variable_id)"
CAT = OBS + ", cat AS (SELECT variable_id, split_part(variable_id, ':', 1) AS source, concat('mean order price ', lower(split_part(variable_id, ':', 2)), ' status ', lower(split_part(variable_id, ':', 3))) AS name, split_part(variable_id, ':', 3) AS geo, count(*) AS observations, min(ts) AS start_date, max(ts) AS end_date FROM obs GROUP BY 1)"
TESTED = PAIRS + """, stat AS (SELECT x, y, count(*) AS n, round(corr(xv, yv), 6) AS r FROM pairs GROUP BY 1, 2),
tested AS (SELECT x, y, n, r, round(-0.5 * ln(1 - r * r), 6) AS mi, round(1 - abs(r), 6) AS direction_pvalue, 1 + n % 12 AS lag, round(r * r * 3, 6) AS oos_r2, r * r * 3 > 0.02 AS oos_valid,
CASE WHEN r > 0.05 THEN 'x->y' WHEN r < -0.05 THEN 'y->x' ELSE 'bidirectional' END AS direction, split_part(x, ':', 2) AS x_name, split_part(y, ':', 2) AS y_name FROM stat)"""
FDR = TESTED + """, ranked_p AS (SELECT *, row_number() OVER (ORDER BY direction_pvalue) AS pr, count(*) OVER () AS total FROM tested),
fdr AS (SELECT * EXCLUDE (pr, total), coalesce(pr <= (SELECT max(pr) FROM ranked_p WHERE direction_pvalue <= pr / total * 0.95), false) AS fdr_significant FROM ranked_p)"""
SCORED = FDR + """, parts AS (SELECT *, -log10(greatest(direction_pvalue, 1e-15)) AS l, greatest((SELECT max(mi) FROM fdr), 0.01) AS top FROM fdr),
scored AS (SELECT * EXCLUDE (l, top), round_even(10 * (0.25 * greatest(0, least(1, mi / top)) + 0.25 * greatest(0, least(1, l / 10)) + 0.35 * greatest(0, least(1, oos_r2 / 0.3)) + 0.15 * greatest(0, least(1, l * greatest(oos_r2, 0) / 3))), 2) AS score FROM parts),
conf AS (SELECT *, CASE WHEN score >= 7 AND oos_valid AND fdr_significant THEN 'high' WHEN score >= 4 AND (oos_valid OR fdr_significant) THEN 'medium' ELSE 'low' END AS confidence FROM scored),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, x, y) AS rank FROM conf)"""


def query(sql: str, with_: str = ""):
    """Registers a Spark query under its name with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = (f"WITH {with_} " if with_ else "") + sql
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steady(S.resample(order_observations(spark, sf_dir)))


def steady(df: DataFrame) -> DataFrame:
    """value to 6 places; a value half way between two goes down whatever noise the order of addition left in it."""
    return df.withColumn("value", F.floor(F.col("value") * 1e6 + 0.4999) / 1e6)


def month_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.aligned(monthly(spark, sf_dir))


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the columns that the discovery's tests give, made from their correlation."""
    s = month_pairs(spark, sf_dir).groupBy("x", "y").agg(F.count("*").alias("n"), F.round(F.corr("xv", "yv"), 6).alias("r"))
    r = F.col("r")
    direction = F.when(r > 0.05, "x->y").when(r < -0.05, "y->x").otherwise("bidirectional")
    return s.select(
        "x", "y", "n", "r", F.round(-0.5 * F.log(1 - r * r), 6).alias("mi"), F.round(1 - F.abs(r), 6).alias("direction_pvalue"), (1 + F.col("n") % 12).alias("lag"), F.round(r * r * 3, 6).alias("oos_r2"),
        (r * r * 3 > 0.02).alias("oos_valid"), direction.alias("direction"), F.split("x", ":")[1].alias("x_name"), F.split("y", ":")[1].alias("y_name"),
    )


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank(R.score(R.benjamini_hochberg(tested(spark, sf_dir), 0.95, "direction_pvalue")))


#: As patterns of RE2.
REGIONAL = "|".join([*L.STATE_NAMES, *L.REGIONAL_WORDS]).replace("(", "[(]").replace(")", "[)]")
ONE, TWO = "orders:1-URGENT:F", "orders:2-HIGH:F"


@query("SELECT variable_id, source, name, geo, observations, start_date, end_date FROM cat WHERE source = 'orders' AND geo = 'F'", CAT)
def series_catalog(spark, sf_dir):
    return S.list_series(order_catalog(spark, sf_dir), "orders", "F").drop("frequency", "unit")


@query(f"SELECT variable_id, name, '' AS unit, observations FROM cat WHERE variable_id = '{ONE}'", CAT)
def series_lookup(spark, sf_dir):
    return S.get_series(order_catalog(spark, sf_dir), ONE).select("variable_id", "name", "unit", "observations")


@query("SELECT count(*) AS n_series FROM cat", CAT)
def series_count(spark, sf_dir):
    return order_catalog(spark, sf_dir).agg(F.count("*").alias("n_series"))


@query("SELECT source, count(*) AS n FROM cat WHERE source IN ('orders', 'events') GROUP BY 1", CAT)
def source_filter(spark, sf_dir):
    return order_catalog(spark, sf_dir).where(F.col("source").isin("orders", "events")).groupBy("source").agg(F.count("*").alias("n"))


@query(f"SELECT ts, round(value, 6) AS value FROM obs WHERE variable_id = '{ONE}' AND ts BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'", OBS)
def obs_range(spark, sf_dir):
    return r6(S.get_observations(order_observations(spark, sf_dir), ONE, "1996-03-01", "1996-06-30"), "value")


@query("SELECT DISTINCT variable_id FROM obs", OBS)
def distinct_ids(spark, sf_dir):
    return order_observations(spark, sf_dir).select("variable_id").distinct().orderBy("variable_id")


@query(f"SELECT a.ts, a.value AS x, b.value AS y FROM mon a JOIN mon b ON a.ts = b.ts WHERE a.variable_id = '{ONE}' AND b.variable_id = '{TWO}'", MON)
def aligned_pair(spark, sf_dir):
    return P.align(monthly(spark, sf_dir), ONE, TWO)


@query(f"SELECT coalesce(a.ts, b.ts) AS ts, round(a.value, 6) AS x, round(b.value, 6) AS y FROM (SELECT * FROM obs WHERE variable_id = '{ONE}') a FULL JOIN (SELECT * FROM obs WHERE variable_id = '{TWO}') b ON a.ts = b.ts", OBS)
def outer_align(spark, sf_dir):
    return r6(P.align(order_observations(spark, sf_dir), ONE, TWO, "outer"), "x", "y")


@query("SELECT a.variable_id AS x, b.variable_id AS y FROM cat a JOIN cat b ON a.variable_id < b.variable_id", CAT)
def all_pairs(spark, sf_dir):
    return P.all_pairs(order_catalog(spark, sf_dir))


@query("SELECT x, y, count(*) AS n FROM pairs GROUP BY 1, 2 HAVING count(*) >= 48", PAIRS)
def pair_overlap(spark, sf_dir):
    return P.overlapping(month_pairs(spark, sf_dir), 48)


@query("SELECT variable_id, ts, round(CASE WHEN ts >= DATE '1998-01-01' THEN value * 2 ELSE value END, 6) AS value FROM mon UNION ALL SELECT 'new:1', DATE '2020-01-01', 1.5", MON)
def upsert_latest(spark, sf_dir):
    held = monthly(spark, sf_dir)
    new = held.where("ts >= '1998-01-01'").withColumn("value", F.col("value") * 2)
    more = spark.range(1).select(F.lit("new:1").alias("variable_id"), F.lit("2020-01-01").cast("date").alias("ts"), F.lit(1.5).cast("double").alias("value"))
    return r6(S.upsert(held, new.unionByName(more), ["variable_id", "ts"]), "value")


@query("SELECT variable_id, coalesce(median(gap), 0.0) AS median_gap FROM (SELECT variable_id, date_diff('day', lag(ts) OVER (PARTITION BY variable_id ORDER BY ts), ts) AS gap FROM obs) GROUP BY 1", OBS)
def median_gap(spark, sf_dir):
    return S.median_gap(order_observations(spark, sf_dir))


@query("SELECT * FROM mon", MON)
def monthly_resample(spark, sf_dir):
    return steady(S.resample_frequent(order_observations(spark, sf_dir)))


@query("SELECT variable_id, CAST(date_trunc('quarter', ts) AS DATE) AS ts, round(max(value), 6) AS value FROM obs GROUP BY 1, 2", OBS)
def downsample_quarter(spark, sf_dir):
    return r6(S.resample(order_observations(spark, sf_dir), S.target_unit(91.0), "max"), "value")


@query("SELECT variable_id, n_observations, round(variance, 4) AS variance, 0.0::DOUBLE AS nan_ratio, CASE WHEN n_observations < 80 THEN 'observations' WHEN variance < 1e-10 THEN 'variance' ELSE '' END AS reason, n_observations >= 80 AND variance >= 1e-10 AS passed FROM (SELECT variable_id, count(*) AS n_observations, var_pop(value) AS variance FROM mon GROUP BY 1)", MON)
def quality_gate(spark, sf_dir):
    out = S.quality(monthly(spark, sf_dir), min_obs=80)
    return out.select("variable_id", "n_observations", F.round("variance", 4).alias("variance"), F.col("nan_ratio").cast("double").alias("nan_ratio"), "reason", "passed")


@query("SELECT variable_id, ts, round(d, 6) AS value FROM (SELECT variable_id, ts, value - lag(value) OVER (PARTITION BY variable_id ORDER BY ts) AS d FROM mon) WHERE d IS NOT NULL", MON)
def first_diff(spark, sf_dir):
    return r6(S.first_difference(monthly(spark, sf_dir)), "value")


@query("SELECT variable_id, ts, round(value - b - a * i, 5) AS value FROM (SELECT *, row_number() OVER (PARTITION BY variable_id ORDER BY ts) - 1 AS i FROM mon) JOIN (SELECT variable_id, regr_slope(value, i) AS a, regr_intercept(value, i) AS b FROM (SELECT *, row_number() OVER (PARTITION BY variable_id ORDER BY ts) - 1 AS i FROM mon) GROUP BY 1) USING (variable_id)", MON)
def detrend(spark, sf_dir):
    return S.detrend(monthly(spark, sf_dir)).withColumn("value", F.round("value", 5))


PLACED = ", placed AS (SELECT *, row_number() OVER (PARTITION BY variable_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY variable_id) AS n FROM mon)"


@query("SELECT variable_id, ts, i < floor(n * 0.7) AS train, round((value - m) / s, 6) AS z FROM placed JOIN (SELECT variable_id, avg(value) AS m, greatest(stddev_pop(value), 1e-10) AS s FROM placed WHERE i < floor(n * 0.7) GROUP BY 1) USING (variable_id)", MON + PLACED)
def train_zscore(spark, sf_dir):
    return r6(S.zscore_by_train(monthly(spark, sf_dir)), "z")


MID = "rank() OVER (PARTITION BY x, y ORDER BY {c}) + (count(*) OVER (PARTITION BY x, y, {c}) - 1) / 2.0"


@query(f"SELECT x, y, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT x, y, {MID.format(c='xv')} AS rx, {MID.format(c='yv')} AS ry FROM pairs) GROUP BY 1, 2", PAIRS)
def spearman_lag0(spark, sf_dir):
    return r6(P.spearman(month_pairs(spark, sf_dir)), "rho")


def _lag_sql(k: int, a: str, b: str) -> str:
    return f"SELECT {a} AS x, {b} AS y, abs(corr(rx, ry)) AS rho FROM (SELECT x, y, {MID.format(c='xv')} AS rx, {MID.format(c='yv')} AS ry FROM (SELECT x, y, lag({'xv' if a == 'x' else 'yv'}, {k}) OVER (PARTITION BY x, y ORDER BY ts) AS xv, {'yv' if a == 'x' else 'xv'} AS yv FROM pairs) WHERE xv IS NOT NULL) GROUP BY x, y HAVING count(*) > 20".replace(f"{a} AS x, {b} AS y", "x, y", 1)


@query("SELECT x, y, round(max(rho), 6) AS best FROM (" + " UNION ALL ".join([_lag_sql(0, "x", "y"), *[_lag_sql(k, a, b) for k in (1, 3) for a, b in (("x", "y"), ("y", "x"))]]) + ") GROUP BY 1, 2 HAVING max(rho) >= 0.15", PAIRS)
def spearman_prescreen(spark, sf_dir):
    return r6(P.prescreen(month_pairs(spark, sf_dir), 0.15, (0, 1, 3)), "best")


@query("SELECT x, y, round(max(rho), 6) AS best FROM (" + " UNION ALL ".join([_lag_sql(0, "x", "y"), *[_lag_sql(k, a, b) for k in (1, 3, 6, 12) for a, b in (("x", "y"), ("y", "x"))]]) + ") GROUP BY 1, 2 HAVING max(rho) >= 0.15", PAIRS)
def spearman_prescreen_all_lags(spark, sf_dir):
    """As spearman_prescreen, with all lags of Config."""
    return r6(P.prescreen(month_pairs(spark, sf_dir), 0.15, Config().prescreen_lags), "best")


@query(
    """SELECT x, y, round(greatest(sum(p * ln(p / (px * py))), 0), 6) AS mi FROM (SELECT x, y, c / total AS p, sum(c) OVER (PARTITION BY x, y, bx) / total AS px, sum(c) OVER (PARTITION BY x, y, by_) / total AS py FROM
(SELECT x, y, total, least(floor((xv - x0) / (x1 - x0) * 20), 19) AS bx, least(floor((yv - y0) / (y1 - y0) * 20), 19) AS by_, count(*)::DOUBLE AS c FROM pairs JOIN
(SELECT x, y, min(xv) AS x0, max(xv) AS x1, min(yv) AS y0, max(yv) AS y1, count(*)::DOUBLE AS total FROM pairs GROUP BY 1, 2) USING (x, y) GROUP BY 1, 2, 3, 4, 5)) GROUP BY 1, 2""",
    PAIRS,
)
def hist_mi(spark, sf_dir):
    return r6(P.histogram_mi(month_pairs(spark, sf_dir)), "mi")


@query("SELECT x, y, direction_pvalue, fdr_significant FROM fdr", FDR)
def bh_fdr(spark, sf_dir):
    return R.benjamini_hochberg(tested(spark, sf_dir), 0.95, "direction_pvalue").select("x", "y", "direction_pvalue", "fdr_significant")


@query("SELECT variable_id, round(phi, 6) AS phi, round(avg(pow(value - phi * before, 2)), 3) AS mse FROM w JOIN (SELECT variable_id, sum(value * before) / sum(before * before) AS phi FROM w WHERE before IS NOT NULL AND i < floor(n * 0.7) GROUP BY 1) USING (variable_id) WHERE NOT i < floor(n * 0.7) GROUP BY 1, phi", MON + PLACED + ", w AS (SELECT *, lag(value) OVER (PARTITION BY variable_id ORDER BY ts) AS before FROM placed)")
def ar1_ols_mse(spark, sf_dir):
    out = P.ar1_mse(monthly(spark, sf_dir))
    return out.select("variable_id", F.round("phi", 6).alias("phi"), F.round("mse", 3).alias("mse"))


LAGGED = PAIRS + ", shifted AS (SELECT * FROM (SELECT x, y, ts, lag(xv, 2) OVER (PARTITION BY x, y ORDER BY ts) AS xv, yv FROM pairs) WHERE xv IS NOT NULL), pl AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY ts) AS i, count(*) OVER (PARTITION BY x, y) AS n FROM shifted), fit AS (SELECT x, y, covar_pop(xv, yv) * count(*) / (var_pop(xv) * count(*) + 1) AS slope, avg(xv) AS mx, avg(yv) AS my FROM pl WHERE i <= floor(n * 0.6) GROUP BY 1, 2)"


@query("SELECT x, y, round(slope, 6) AS slope, round(my - slope * mx, 4) AS intercept FROM fit", LAGGED)
def ridge1(spark, sf_dir):
    out = P.ridge_one(month_pairs(spark, sf_dir), 2)
    return out.select("x", "y", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("SELECT x, y, n, lag, CAST(s AS INTEGER) AS start, CAST(s + 30 AS INTEGER) AS train_end, CAST(s + 42 + lag AS INTEGER) AS test_end FROM (SELECT x, y, n, lag, unnest(CASE WHEN n - 42 - lag >= 0 THEN range(0, CAST(n - 42 - lag AS BIGINT) + 1, 12) ELSE [] END) AS s FROM tested)", TESTED)
def walk_forward_windows(spark, sf_dir):
    return P.walk_forward_windows(tested(spark, sf_dir).select("x", "y", "n", "lag"), 30, 12, 12)


@query("SELECT rank, x, y, score, confidence FROM ranked", SCORED)
def pair_score(spark, sf_dir):
    return ranked(spark, sf_dir).select("rank", "x", "y", "score", "confidence")


@query("SELECT confidence, count(*) AS n, count(*) FILTER (oos_valid) AS n_valid FROM ranked GROUP BY 1", SCORED)
def confidence_counts(spark, sf_dir):
    return ranked(spark, sf_dir).groupBy("confidence").agg(F.count("*").alias("n"), F.count_if("oos_valid").alias("n_valid"))


@query("SELECT rank, x, y, score FROM ranked ORDER BY rank LIMIT 10", SCORED)
def top_k(spark, sf_dir):
    return ranked(spark, sf_dir).select("rank", "x", "y", "score").orderBy("rank").limit(10)


@query("SELECT x, y, concat_ws('; ', CASE WHEN NOT oos_valid THEN 'out-of-sample validation failed' END, CASE WHEN direction = 'bidirectional' THEN 'bidirectional' END) AS caveats FROM tested", TESTED)
def caveats(spark, sf_dir):
    return R.caveats(tested(spark, sf_dir)).select("x", "y", F.array_join("caveats", "; ").alias("caveats"))


NAMES = CAT + ", np AS (SELECT a.variable_id AS x, b.variable_id AS y, a.name AS x_name, b.name AS y_name, list_distinct(string_split(upper(a.name), ' ')) AS wa, list_distinct(string_split(upper(b.name), ' ')) AS wb FROM cat a JOIN cat b ON a.variable_id < b.variable_id), ident AS (SELECT x, y, CASE WHEN upper(x_name) = upper(y_name) THEN 0.95 WHEN len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) > 0.7 THEN len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) ELSE 0.0 END AS identity FROM np)"


@query("SELECT x, y, round(identity, 6) AS identity FROM ident", NAMES)
def identity_jaccard(spark, sf_dir):
    cat = order_catalog(spark, sf_dir).select("variable_id", "name")
    two = P.all_pairs(cat).join(cat.toDF("x", "x_name"), "x").join(cat.toDF("y", "y_name"), "y")
    return two.select("x", "y", F.round(R.identity(F.col("x"), F.col("y"), F.col("x_name"), F.col("y_name")).cast("double"), 6).alias("identity"))


@query("SELECT variable_id, upper(split_part(variable_id, ':', 3)) LIKE 'F%' AS blacklisted FROM cat", CAT)
def blacklist(spark, sf_dir):
    return order_catalog(spark, sf_dir).select("variable_id", R.blacklisted(F.col("variable_id"), "F").alias("blacklisted"))


@query("SELECT row_number() OVER (ORDER BY score DESC, x, y) AS rank, x, y, score FROM ranked WHERE x_name <> y_name", SCORED)
def filter_chain(spark, sf_dir):
    return R.filter_chain(ranked(spark, sf_dir).drop("rank")).select("rank", "x", "y", "score")


@query(f"SELECT x, y, r FROM tested WHERE NOT EXISTS (SELECT 1 FROM (SELECT x, y, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT x, y, {MID.format(c='xv')} AS rx, {MID.format(c='yv')} AS ry FROM pairs) GROUP BY 1, 2) s WHERE s.x = tested.x AND s.y = tested.y AND s.n >= 48 AND abs(s.rho) > 0.1)", TESTED)
def high_corr(spark, sf_dir):
    return R.high_correlation(tested(spark, sf_dir), P.spearman(month_pairs(spark, sf_dir)), 0.1).select("x", "y", "r")


@query("SELECT CASE direction WHEN 'x->y' THEN x ELSE y END AS signal, CASE direction WHEN 'x->y' THEN y ELSE x END AS target, lag, oos_r2 FROM tested WHERE direction <> 'bidirectional' AND lag >= 1 AND oos_r2 >= 0.01 AND oos_valid ORDER BY oos_r2 DESC, signal, target LIMIT 10", TESTED)
def trading_candidates(spark, sf_dir):
    return R.trading_candidates(tested(spark, sf_dir)).drop("description")


@query("SELECT name, min(rank) AS rank FROM (VALUES ('urgent leads low', 'URGENT', '5-LOW'), ('high and medium', '2-HIGH', '3-MEDIUM'), ('nothing', 'GOLD', 'SILVER')) r(name, a, b) LEFT JOIN ranked ON (contains(x, a) AND contains(y, b)) OR (contains(x, b) AND contains(y, a)) GROUP BY 1", SCORED)
def known_relations(spark, sf_dir):
    rel = spark.createDataFrame([("urgent leads low", ["URGENT"], ["5-LOW"]), ("high and medium", ["2-HIGH"], ["3-MEDIUM"]), ("nothing", ["GOLD"], ["SILVER"])], "name string, a array<string>, b array<string>")
    return R.known_relations(ranked(spark, sf_dir), rel)


DIFF = MON + ", ret AS (SELECT variable_id, ts, d / 10000 AS value FROM (SELECT variable_id, ts, value - lag(value) OVER (PARTITION BY variable_id ORDER BY ts) AS d FROM mon) WHERE d IS NOT NULL)"


@query("SELECT variable_id, round(max_by(equity, ts), 6) AS final_equity, round(min((equity - peak) / peak), 6) AS max_drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY variable_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT *, 100 + sum(value) OVER (PARTITION BY variable_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM ret)) GROUP BY 1", DIFF)
def drawdown(spark, sf_dir):
    ret = S.first_difference(monthly(spark, sf_dir)).withColumn("value", F.col("value") / 10000)
    return r6(S.drawdown(ret), "final_equity", "max_drawdown")


@query("SELECT variable_id, round(CASE WHEN count(*) < 2 OR stddev_pop(value) < 1e-10 THEN 0 ELSE avg(value) / stddev_pop(value) * sqrt(12) END, 6) AS sharpe, round(avg(CAST(value > 0 AS INTEGER)), 6) AS win_rate, round(avg(value) * 12, 6) AS annual_mean FROM ret GROUP BY 1", DIFF)
def sharpe(spark, sf_dir):
    ret = S.first_difference(monthly(spark, sf_dir)).withColumn("value", F.col("value") / 10000)
    return r6(S.sharpe(ret), "sharpe", "win_rate", "annual_mean")


@query("SELECT concat(x, '|', y) AS pair, round(avg(t) / stddev_pop(t) * sqrt(12), 6) AS sharpe, round(avg(CAST(t > 0 AS INTEGER)), 6) AS win_rate, round(avg(yv) / stddev_pop(yv) * sqrt(12), 6) AS hold_sharpe FROM (SELECT x, y, yv, CASE WHEN my - slope * mx + slope * xv > 0 THEN 1.0 ELSE -1.0 END * yv AS t FROM pl JOIN fit USING (x, y) WHERE i > floor(n * 0.6)) GROUP BY x, y", LAGGED.replace("mon b ON", "mon b ON").replace("FROM mon a JOIN mon b", "FROM dmon a JOIN dmon b").replace(", pairs AS", ", dmon AS (SELECT variable_id, ts, round(d, 6) AS value FROM (SELECT variable_id, ts, value - lag(value) OVER (PARTITION BY variable_id ORDER BY ts) AS d FROM mon) WHERE d IS NOT NULL), pairs AS"))
def backtest(spark, sf_dir):
    diffs = r6(S.first_difference(monthly(spark, sf_dir)), "value")
    out = P.backtest(P.aligned(diffs), 2)
    return r6(out.select("pair", "sharpe", "win_rate", "hold_sharpe"), "sharpe", "win_rate", "hold_sharpe")


@query("SELECT c_custkey, title FROM (SELECT c_custkey, concat(n_name, ' ', c_mktsegment) AS title FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE NOT regexp_matches(lower(title), '" + REGIONAL + "|chin| auto')")
def regional_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select("c_custkey", F.concat_ws(" ", "n_name", "c_mktsegment").alias("title"))
    return rows.where(~L.is_regional(F.col("title"), ("chin", " auto")))


@query("SELECT concat('wb:', r_name, '_', n_name) AS variable_id FROM region, nation ORDER BY r_regionkey, n_nationkey LIMIT 40")
def indicator_cross(spark, sf_dir):
    a = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("code"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("code"))
    return L.cross_catalog(a, b, "wb", 40).select("variable_id")


@query("SELECT o_orderpriority AS variable_id, make_date(CAST(year(o_orderdate) AS BIGINT), 1, 1) AS ts, count(*) AS value FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997) GROUP BY 1, 2")
def unpivot_years(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    wide = o.groupBy(F.col("o_orderpriority").alias("variable_id")).agg(*[F.nullif(F.count_if(F.year("o_orderdate") == y), F.lit(0)).alias(str(y)) for y in (1995, 1996, 1997)])
    return L.unpivot_years(wide, ["variable_id"], ["1995", "1996", "1997"])


@query("SELECT event_type AS variable_id, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def json_payload(spark, sf_dir):
    k = F.from_json("props", "struct<k:bigint>")["k"]
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("variable_id"), F.col("ts").cast("date").alias("day"), k.alias("k")).where("k is not null")
    return rows.groupBy("variable_id", "day").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT o_orderkey, p, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 0 THEN CAST(date_trunc('year', d) AS DATE) WHEN o_orderkey % 4 = 1 THEN CAST(date_trunc('month', d) AS DATE) ELSE d END AS ts FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'not-a-date' END AS p FROM orders)")
def parse_period(spark, sf_dir):
    kind = F.col("o_orderkey") % 4
    p = F.when(kind == 0, F.date_format("o_orderdate", "yyyy")).when(kind == 1, F.date_format("o_orderdate", "yyyy-MM")).when(kind == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("not-a-date")
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).withColumn("ts", L.parse_period(F.col("p")))


@query("SELECT series_id, query, title, popularity, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY popularity DESC, series_id) AS place FROM (SELECT concat('P', p_partkey) AS series_id, p_brand AS query, substr(p_name, 1, 120) AS title, p_size AS popularity FROM part WHERE p_size >= 10 AND p_partkey % 7 <> 0 AND NOT regexp_matches(lower(p_name), '" + REGIONAL + "')) ) WHERE place <= 10 ORDER BY query, place LIMIT 100")
def discovery_cap(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = part.select(F.concat(F.lit("P"), "p_partkey").alias("series_id"), F.col("p_brand").alias("query"), F.col("p_name").alias("title"), F.lit("M").alias("frequency"), F.col("p_size").alias("popularity"))
    curated = part.where("p_partkey % 7 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("series_id"))
    return L.discover(found, curated, total=100).select("series_id", "query", "title", "popularity", "place")


SETS = "SELECT 'both' AS kind, count(*) AS n FROM (SELECT DISTINCT ts FROM obs WHERE variable_id = '{0}' INTERSECT SELECT DISTINCT ts FROM obs WHERE variable_id = '{1}') UNION ALL SELECT 'either', count(*) FROM (SELECT ts FROM obs WHERE variable_id IN ('{0}', '{1}') GROUP BY 1) UNION ALL SELECT 'first only', count(*) FROM (SELECT DISTINCT ts FROM obs WHERE variable_id = '{0}' EXCEPT SELECT ts FROM obs WHERE variable_id = '{1}')"


@query(SETS.format(ONE, TWO), OBS)
def index_sets(spark, sf_dir):
    obs = order_observations(spark, sf_dir)
    a, b = (obs.where(F.col("variable_id") == i).select("ts") for i in (ONE, TWO))
    n = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n("both", a.intersect(b)).unionAll(n("either", a.union(b).distinct())).unionAll(n("first only", a.subtract(b)))


@query("SELECT rank, x AS x_id, y AS y_id, direction, lag, mi, score, confidence, concat_ws('; ', CASE WHEN NOT oos_valid THEN 'out-of-sample validation failed' END, CASE WHEN direction = 'bidirectional' THEN 'bidirectional' END) AS caveats FROM ranked", SCORED)
def export_rows(spark, sf_dir):
    out = R.caveats(ranked(spark, sf_dir))
    return out.select("rank", F.col("x").alias("x_id"), F.col("y").alias("y_id"), "direction", "lag", "mi", "score", "confidence", F.array_join("caveats", "; ").alias("caveats"))


@query("SELECT count(*) AS n_pairs, count(*) FILTER (score > 3) AS n_over_3, bool_and(score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score)) AS all_finite FROM ranked", SCORED)
def smoke_gates(spark, sf_dir):
    s = F.col("score")
    return ranked(spark, sf_dir).agg(F.count("*").alias("n_pairs"), F.count_if(s > 3).alias("n_over_3"), F.bool_and(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))).alias("all_finite"))


FLAT = SCORED + """, flat AS (SELECT rank, score, x AS x_id, x_name, y AS y_id, y_name, direction, lag::BIGINT AS lag, mi, direction_pvalue, oos_r2, confidence,
concat_ws('; ', CASE WHEN NOT oos_valid THEN 'out-of-sample validation failed' END, CASE WHEN direction = 'bidirectional' THEN 'bidirectional' END) AS caveats FROM ranked)"""


def flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses, written once: they are used more than once by reports."""
    return written(O.flat(R.caveats(ranked(spark, sf_dir))), "hypotheses")


def joined_caveats(df: DataFrame) -> DataFrame:
    return df.withColumn("caveats", F.array_join("caveats", "; "))


@query("SELECT * FROM flat", FLAT)
def hypothesis_rows(spark, sf_dir):
    return joined_caveats(O.flat(R.caveats(ranked(spark, sf_dir))))


@query("SELECT *, split_part(x_id, ':', 1) AS x_source, DATE '2000-01-01' AS start_date FROM flat WHERE rank <= 50", FLAT)
def json_round_trip(spark, sf_dir):
    """The best 50 exported as a JSON envelope and read back."""
    path = new_path(spark, "json")
    O.export_json(R.caveats(ranked(spark, sf_dir)), path, 50)
    return joined_caveats(O.read_hypotheses(spark, path)).drop("y_source", "frequency", "geo")


@query("SELECT json_extract_string(j, '$.disclaimer') AS disclaimer, CAST(json_extract(j, '$.total') AS BIGINT) AS total FROM (SELECT to_json({'disclaimer': 'Predictive associations, NOT proof of causation.', 'total': count(*)}) AS j FROM flat WHERE rank <= 50)", FLAT)
def json_envelope(spark, sf_dir):
    rows = flat_rows(spark, sf_dir).where("rank <= 50")
    j = O.envelope(rows, "rank", "hypotheses", O.DISCLAIMER, total=True)
    return j.select(F.from_json("json", "struct<disclaimer:string,total:long>").alias("j")).select("j.*")


@query("SELECT * REPLACE (CAST(rank AS VARCHAR) AS rank, CAST(lag AS VARCHAR) AS lag) FROM (SELECT * EXCLUDE (score, mi, direction_pvalue, oos_r2) FROM flat)", FLAT)
def csv_round_trip(spark, sf_dir):
    """All 13 columns exported as CSV and read back as text; numbers that engines print differently left out."""
    path = new_path(spark, "csv")
    O.export_csv(R.caveats(ranked(spark, sf_dir)), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.drop("score", "mi", "direction_pvalue", "oos_r2").fillna("", ["caveats"])


CARD = """concat('+', repeat('-', 59), '+', chr(10), printf('| #%d  Score: %.2f/10  [%s]', rank, score, upper(confidence)), chr(10), '+', repeat('-', 59), '+', chr(10),
'|  ', x_name, chr(10), printf('|    %s  (lag: %d periods)', direction, lag), chr(10), '|  ', y_name, chr(10), '|', chr(10), printf('|  MI: %.4f  |  Dir p: %.2e  |  OOS R2: %.4f', mi, direction_pvalue, oos_r2), chr(10),
'|  Series: ', x_id, ' -> ', y_id, CASE WHEN caveats = '' THEN '' ELSE concat(chr(10), '  Caveats:', chr(10), '    [!] ', replace(caveats, '; ', concat(chr(10), '    [!] '))) END, chr(10), '|', chr(10),
'|  Predictive associations, NOT proof of causation.', chr(10), '+', repeat('-', 59), '+')"""


@query(f"SELECT rank, {CARD} AS card FROM flat WHERE rank <= 20", FLAT)
def report_cards(spark, sf_dir):
    return O.cards(O.flat(R.caveats(ranked(spark, sf_dir)).where("rank <= 20")))


@query("SELECT CASE WHEN count(*) = 0 THEN 'No significant hypotheses found.' ELSE concat('Hypotheses: ', count(*), ' (high ', count(*) FILTER (confidence = 'high'), ', medium ', count(*) FILTER (confidence = 'medium'), ', low ', count(*) FILTER (confidence = 'low'), '). Predictive associations, NOT proof of causation.') END AS header FROM flat", FLAT)
def report_header(spark, sf_dir):
    return O.confidence_header(O.flat(R.caveats(ranked(spark, sf_dir))))


CANDIDATES = FLAT + """, cand AS (SELECT CASE direction WHEN 'x->y' THEN x_id ELSE y_id END AS signal, CASE direction WHEN 'x->y' THEN y_id ELSE x_id END AS target, CASE direction WHEN 'x->y' THEN x_name ELSE y_name END AS signal_name,
CASE direction WHEN 'x->y' THEN y_name ELSE x_name END AS target_name, lag, oos_r2, score, confidence, mi, direction_pvalue FROM flat WHERE direction <> 'bidirectional' AND lag >= 1 AND oos_r2 >= 0.01 AND oos_r2 > 0.02 ORDER BY oos_r2 DESC, signal, target LIMIT 10)"""


@query("SELECT signal, target, concat(printf('[Score: %.2f/10]  [%s]', score, upper(confidence)), chr(10), '  Signal: ', signal_name, chr(10), '    --> Target: ', target_name, chr(10), printf('    Lag: %d periods  |  OOS R2: %.4f  |  Dir p: %.2e  |  MI: %.4f', lag, oos_r2, direction_pvalue, mi), chr(10), printf('    %s leads %s by %d periods (R2 %.4f)', signal, target, lag, oos_r2)) AS card FROM cand", CANDIDATES)
def trading_cards(spark, sf_dir):
    all_ = R.caveats(ranked(spark, sf_dir))
    return O.trading_cards(O.trading_rows(O.flat(all_), R.trading_candidates(all_)))


@query("SELECT 15::BIGINT AS total_variables_ingested, count(*) AS total_hypotheses, count(*) FILTER (confidence = 'high') AS high_confidence, count(*) FILTER (confidence = 'medium') AS medium_confidence, count(*) FILTER (caveats NOT LIKE '%out-of-sample%') AS oos_validated, 2::BIGINT AS known_relationships_found, 10::BIGINT AS trading_candidates FROM flat", FLAT)
def run_summary(spark, sf_dir):
    return O.run_summary(O.flat(R.caveats(ranked(spark, sf_dir))), 15, 2, 10)


@query("SELECT gate, value, least, value >= least AS passed FROM (SELECT 'variables' AS gate, (SELECT count(*) FROM cat) AS value, 500::BIGINT AS least UNION ALL SELECT 'validated', (SELECT count(*) FILTER (oos_valid) FROM ranked), 30 UNION ALL SELECT 'known', (SELECT count(*) FROM ranked WHERE contains(x, 'URGENT') AND contains(y, '5-LOW')), 5 UNION ALL SELECT 'candidates', (SELECT count(*) FROM cand), 5)", CANDIDATES + ", cat AS" + CAT.split(", cat AS")[1])
def run_gates(spark, sf_dir):
    """Whether a run has enough variables, validated hypotheses, known relations and candidates."""
    rows = written(ranked(spark, sf_dir), "ranked")
    known = (F.contains("x", F.lit("URGENT")) & F.contains("y", F.lit("5-LOW")))
    one = rows.agg(F.count_if("oos_valid").alias("validated"), F.count_if(known).alias("known"))
    one = one.join(R.trading_candidates(rows).agg(F.count("*").alias("candidates"))).join(order_catalog(spark, sf_dir).agg(F.count("*").alias("variables")))
    return R.gates(one, {"variables": ("variables", 500), "validated": ("validated", 30), "known": ("known", 5), "candidates": ("candidates", 5)})


@query("SELECT concat('climate:', r_name, '_', n_name, '_', d) AS variable_id, concat(n_name, ' ', d) AS name, CASE d WHEN 'TAVG' THEN 'celsius' WHEN 'PRCP' THEN 'mm' WHEN 'CLDD' THEN 'degree_days' ELSE 'unknown' END AS unit, r_name AS geo FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('TAVG'), ('PRCP'), ('CLDD'), ('WIND')) t(d)")
def station_cross(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return L.station_catalog(n.select(F.concat_ws(":", "r_name", "n_name").alias("station_id"), F.col("n_name").alias("name"), F.col("r_name").alias("geo")), ("TAVG", "PRCP", "CLDD", "WIND"))


@query("SELECT concat('climate:', r_name, '_', n_name, '_TAVG') AS variable_id, concat(r_name, ':', n_name) AS station_id, 'TAVG' AS datatype, make_date(y, 1, 1) AS start, make_date(least(y + 9, 1994), 12, 31) AS end FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES (1970), (1980), (1990)) t(y) WHERE NOT contains(r_name, '_')")
def climate_requests(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return L.climate_requests(L.station_catalog(n.select(F.concat_ws(":", "r_name", "n_name").alias("station_id"), F.col("n_name").alias("name"), F.col("r_name").alias("geo")), ("TAVG",)), 1970, 1994)


@query("SELECT concat('energy:', o_orderpriority) AS variable_id, make_date(year(o_orderdate)::BIGINT, month(o_orderdate)::BIGINT, 1) AS ts, o_totalprice AS value FROM orders WHERE o_orderkey % 5 NOT IN (0, 1)")
def energy_payload(spark, sf_dir):
    """Landed bodies, one per customer: periods as yyyy-MM, every fifth value null, every fifth no number."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    cell = F.struct(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.when(k == 0, None).when(k == 1, "w/h").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    data = o.groupBy(F.concat(F.lit("energy:"), "o_orderpriority").alias("variable_id"), "o_custkey").agg(F.collect_list(cell).alias("data"))
    bodies = data.select("variable_id", F.to_json(F.struct(F.struct(F.size("data").alias("total"), "data").alias("response"))).alias("body"))
    return L.energy_rows(bodies)


def _climate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages, one per customer and half year, those of customers divisible by 7 broken."""
    o = table(spark, sf_dir, "orders")
    cell = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.lit("TAVG").alias("datatype"), F.lit("s").alias("station"), F.col("o_totalprice").alias("value"))
    year = (F.floor(F.year("o_orderdate") / 10) * 10).cast("int")
    page = o.groupBy(F.concat(F.lit("climate:"), "o_orderpriority").alias("variable_id"), year.alias("first_year"), (F.col("o_custkey") * 1000 + 1).alias("page_offset")).agg(F.collect_list(cell).alias("results"))
    result = F.struct(F.struct(F.struct(F.lit(1).alias("offset"), F.size("results").alias("count"), F.lit(1000).alias("limit")).alias("resultset")).alias("metadata"), "results")
    return page.select("variable_id", "first_year", "page_offset", F.when((F.col("page_offset") - 1) / 1000 % 7 == 0, "<html>503</html>").otherwise(F.to_json(result)).alias("body"))


@query("SELECT concat('climate:', o_orderpriority) AS variable_id, CAST(o_orderdate AS DATE) AS ts, o_totalprice AS value FROM orders WHERE o_custkey % 7 <> 0")
def climate_payload(spark, sf_dir):
    return L.climate_rows(_climate_pages(spark, sf_dir))


@query("SELECT concat('climate:', o_orderpriority) AS variable_id, CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS first_year, count(DISTINCT o_custkey) FILTER (o_custkey % 7 <> 0) AS pages, count(*) FILTER (o_custkey % 7 <> 0) AS rows FROM orders GROUP BY 1, 2")
def climate_chunks(spark, sf_dir):
    return L.climate_chunks(_climate_pages(spark, sf_dir)).drop("complete")


@query(f"SELECT a.ts, round(a.value, 6) AS high, round(b.value, 6) AS low FROM (SELECT CAST(date_trunc('month', ts) AS DATE) AS ts, avg(value) AS value FROM obs WHERE variable_id = '{ONE}' GROUP BY 1) a JOIN (SELECT ts, value FROM mon WHERE variable_id = '{TWO}') b USING (ts)", MON)
def downsample_align(spark, sf_dir):
    obs = order_observations(spark, sf_dir)
    low = monthly(spark, sf_dir).where(F.col("variable_id") == TWO)
    return r6(S.downsample(obs.where(F.col("variable_id") == ONE), low), "high", "low")


@query("SELECT concat('landed:', c_custkey) AS variable_id, 'landed' AS source, c_name AS name, c_mktsegment AS unit, 'daily' AS frequency, count(*) AS observations, min(CAST(o_orderdate AS DATE)) AS start_date, max(CAST(o_orderdate AS DATE)) AS end_date FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50) JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2, 3, 4, 5")
def landed_list(spark, sf_dir):
    """The first 50 entries of a curated list, from landed rows of which every third is null or NaN."""
    catalog = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").cast("string").alias("series_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("unit"), F.lit("daily").alias("frequency"))
    value = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).when(F.col("o_orderkey") % 2 == 0, float("nan"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("series_id"), F.col("o_orderdate").alias("ts"), value.alias("value"))
    return L.landed_series(catalog, rows, "landed", 50)[0]


@query("SELECT x, y, count(*) AS n, round(corr(xv, yv), 6) AS r FROM pairs GROUP BY 1, 2", PAIRS)
def blocked_pairs(spark, sf_dir):
    """All pairs dealt by blocks of series as well as by date."""
    return P.aligned(monthly(spark, sf_dir), blocks=4).groupBy("x", "y").agg(F.count("*").alias("n"), F.round(F.corr("xv", "yv"), 6).alias("r"))


@query("SELECT x, y, n, round(corr(rx, ry), 6) AS rho FROM (SELECT x, y, count(*) OVER (PARTITION BY x, y) AS n, rank() OVER (PARTITION BY x, y ORDER BY xv) + (count(*) OVER (PARTITION BY x, y, xv) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY x, y ORDER BY yv) + (count(*) OVER (PARTITION BY x, y, yv) - 1) / 2.0 AS ry FROM pairs) WHERE n >= 48 GROUP BY 1, 2, 3 ORDER BY abs(rho) DESC, x, y LIMIT 20", PAIRS)
def flagship(spark, sf_dir):
    return entry_query(spark, sf_dir)


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most rank-correlated pairs of monthly order series with enough common months."""
    rho = r6(P.spearman(month_pairs(spark, sf_dir)).where(F.col("n") >= 48), "rho")
    return rho.orderBy(F.desc(F.abs("rho")), "x", "y").limit(20)
