"""Hypotheses and candidates as rows, JSON envelopes, CSV and text.

A report is what a reader looks at: envelopes and texts gather the rows they are given in one
row, so give them the best few (top_k); export_lines and export_csv take any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["rank", "score", "x_id", "x_name", "y_id", "y_name", "direction", "lag", "mi", "direction_pvalue", "oos_r2", "confidence", "caveats"]
DISCLAIMER = "Predictive associations, NOT proof of causation."
TRADING_DISCLAIMER = "Statistical associations with lag. NOT trading advice."
BACKTEST_DISCLAIMER = "Backtest on historical data. Past performance does NOT guarantee future results."
HYPOTHESIS = "struct<rank:long,score:double,x_id:string,x_name:string,y_id:string,y_name:string,direction:string,lag:long,mi:double,direction_pvalue:double,granger_pvalue:double,oos_r2:double,confidence:string,caveats:array<string>>"


def flat(ranked: DataFrame) -> DataFrame:
    """The 13 columns of a hypothesis, from rows with x, y, x_name, y_name."""
    return ranked.withColumnsRenamed({"x": "x_id", "y": "y_id"}).select(*COLUMNS)


def envelope(rows: DataFrame, order: str, key: str, disclaimer: str, extra: dict[str, Column] | None = None, total: bool = False) -> DataFrame:
    """One row `json`: an object with disclaimer, total if wanted, extra members, and the rows in order under `key`."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*rows.columns).alias("row"))))
    members = [F.lit(disclaimer).alias("disclaimer")] + [F.size("all").alias("total")] * total + [c.alias(n) for n, c in (extra or {}).items()]
    return rows.agg(listed.alias("all")).select(F.to_json(F.struct(*members, F.transform("all", lambda x: x["row"]).alias(key))).alias("json"))


def export_json(ranked: DataFrame, path: str, most: int | None = None) -> None:
    """An envelope of the best `most` hypotheses (all if None) as one JSON text file in path."""
    rows = flat(ranked if most is None else ranked.orderBy("rank").limit(most))
    envelope(rows, "rank", "hypotheses", DISCLAIMER, total=True).write.mode("overwrite").text(path)


def export_lines(ranked: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are partitions."""
    flat(ranked).write.mode("overwrite").json(path)


def export_csv(ranked: DataFrame, path: str) -> None:
    """The 13 columns with a header, caveats joined by `; `; no rows: no lines."""
    flat(ranked).withColumn("caveats", F.array_join("caveats", "; ")).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_hypotheses(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an exported envelope; old files' granger_pvalue stands in for direction_pvalue, 0.05 for neither; no caveats: none."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"struct<hypotheses:array<{HYPOTHESIS}>>")["hypotheses"]).alias("h")).select("h.*")
    p = F.coalesce("direction_pvalue", "granger_pvalue", F.lit(0.05))
    source = lambda c: F.when(F.contains(c, F.lit(":")), F.split(c, ":")[0]).otherwise("unknown")
    rows = rows.withColumns({"direction_pvalue": p, "caveats": F.coalesce("caveats", F.array().cast("array<string>")), "x_source": source("x_id"), "y_source": source("y_id")})
    return rows.drop("granger_pvalue").withColumns({"frequency": F.lit("monthly"), "geo": F.lit("US"), "start_date": F.lit("2000-01-01").cast("date")})


def cards(hypotheses: DataFrame) -> DataFrame:
    """rank, card: a text card of each row of the 13 columns."""
    rule = "+" + "-" * 59 + "+"
    notes = F.when(F.size("caveats") > 0, F.concat(F.lit("\n  Caveats:\n"), F.array_join(F.transform("caveats", lambda c: F.concat(F.lit("    [!] "), c)), "\n"))).otherwise("")
    parts = [
        F.format_string(f"{rule}\n| #%d  Score: %.2f/10  [%s]\n{rule}\n", "rank", "score", F.upper("confidence")),
        F.format_string("|  %s\n|    %s  (lag: %d periods)\n|  %s\n|\n", "x_name", "direction", "lag", "y_name"),
        F.format_string("|  MI: %.4f  |  Dir p: %.2e  |  OOS R2: %.4f\n", "mi", "direction_pvalue", "oos_r2"),
        F.format_string("|  Series: %s -> %s", "x_id", "y_id"),
        notes,
        F.lit(f"\n|\n|  {DISCLAIMER}\n{rule}"),
    ]
    return hypotheses.select("rank", F.concat(*parts).alias("card"))


def confidence_header(hypotheses: DataFrame) -> DataFrame:
    """One row `header`: counts by confidence, or that there is nothing."""
    n = {c: F.count_if(F.col("confidence") == c) for c in ("high", "medium", "low")}
    text = F.format_string("Hypotheses: %d (high %d, medium %d, low %d). " + DISCLAIMER, F.count("*"), *n.values())
    return hypotheses.agg(F.when(F.count("*") == 0, "No significant hypotheses found.").otherwise(text).alias("header"))


def report(hypotheses: DataFrame) -> DataFrame:
    """One row `report`: header and cards in rank order."""
    body = cards(hypotheses).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "card"))), lambda x: x["card"]), "\n\n").alias("body"))
    return confidence_header(hypotheses).join(body).select(F.concat_ws("\n\n", "header", F.nullif("body", F.lit(""))).alias("report"))


def trading_rows(hypotheses: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (signal, target, lag, oos_r2, description) with place, names, score, confidence, mi and p of their hypothesis."""
    h, names = hypotheses, ["score", "confidence", "mi", "direction_pvalue"]
    forward = h.select(F.col("x_id").alias("signal"), F.col("y_id").alias("target"), F.col("x_name").alias("signal_name"), F.col("y_name").alias("target_name"), *names)
    turned = h.select(F.col("y_id").alias("signal"), F.col("x_id").alias("target"), F.col("y_name").alias("signal_name"), F.col("x_name").alias("target_name"), *names)
    return candidates.join(forward.unionAll(turned), ["signal", "target"])


def trading_cards(rows: DataFrame) -> DataFrame:
    """signal, target, card of trading rows."""
    text = F.format_string(
        "[Score: %.2f/10]  [%s]\n  Signal: %s\n    --> Target: %s\n    Lag: %d periods  |  OOS R2: %.4f  |  Dir p: %.2e  |  MI: %.4f\n    %s",
        "score", F.upper("confidence"), "signal_name", "target_name", "lag", "oos_r2", "direction_pvalue", "mi", "description",
    )
    return rows.select("signal", "target", text.alias("card"))


def run_summary(hypotheses: DataFrame, ingested: int, known: int, candidates: int) -> DataFrame:
    """One row with the counts of a discovery run."""
    valid = ~F.array_contains("caveats", "out-of-sample validation failed")
    return hypotheses.agg(
        F.lit(ingested).cast("long").alias("total_variables_ingested"),
        F.count("*").alias("total_hypotheses"),
        F.count_if(F.col("confidence") == "high").alias("high_confidence"),
        F.count_if(F.col("confidence") == "medium").alias("medium_confidence"),
        F.count_if(valid).alias("oos_validated"),
        F.lit(known).cast("long").alias("known_relationships_found"),
        F.lit(candidates).cast("long").alias("trading_candidates"),
    )


def export_run(ranked: DataFrame, candidates: DataFrame, summary: DataFrame, folder: str, top: int = 50, filters: list[str] | None = None, robust: DataFrame | None = None) -> None:
    """A run's files in folder: top, all, trading and summary; a cleaned run's trading file also names filters and robust signals."""
    export_json(ranked, f"{folder}/top{top}", top)
    export_lines(ranked, f"{folder}/all")
    extra = {"filters_applied": F.array(*map(F.lit, filters))} if filters else {}
    placed = candidates.withColumn("place", -F.col("oos_r2"))
    if robust is not None:
        good = robust.where(F.col("status").startswith("ROBUST"))
        placed = placed.join(good.select("signal", "target", "status"), ["signal", "target"], "left")
    envelope(placed, "place", "candidates", TRADING_DISCLAIMER, extra).write.mode("overwrite").text(f"{folder}/trading")
    summary.select(F.to_json(F.struct("*")).alias("json")).write.mode("overwrite").text(f"{folder}/summary")


def export_backtests(results: DataFrame, path: str) -> None:
    """The backtests that could be run, in an envelope."""
    envelope(results.where("error is null").drop("error"), "name", "results", BACKTEST_DISCLAIMER).write.mode("overwrite").text(path)


def backtest_cards(results: DataFrame) -> DataFrame:
    """name, card of each backtest that could be run."""
    text = F.format_string(
        "BACKTEST: %s (train %d, test %d, slope %.6f)\n  Sharpe %+.3f, yearly %+.4f, drawdown %.4f, win rate %.3f\n  Hold: Sharpe %+.3f, yearly %+.4f, drawdown %.4f\n  Random: mean %+.3f, deviation %.3f\n  VERDICT: %s",
        "name", "train", "test", "slope", "sharpe", "yearly", "drawdown", "win_rate", "hold_sharpe", "hold_yearly", "hold_drawdown", "random_mean", "random_deviation", "verdict",
    )
    return results.where("error is null").select("name", text.alias("card"))


def cached(spark: SparkSession, folder: str, top: int = 50) -> DataFrame:
    """The report of an exported run, without running anything again."""
    return report(read_hypotheses(spark, f"{folder}/top{top}"))
