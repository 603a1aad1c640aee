"""URL verdicts: allow and block rules first, gradient-boosted trees on lexical features for the rest.

Features of a URL: length, path depth, digit ratio, character entropy, counts of
parameters, labels, hyphens and dots, and statistics of its host's last label (how many
URLs carry it, and the smoothed block rate among labelled ones). A row's own rule gives it
its label, so the rate that it is trained with leaves out all rows of that rule: what the
trees learn of a suffix is what other rules say of it. Every tree sees a part of the features,
so that none of them decides alone. All features are built-in column functions; the trees
are MLlib's, so no Python runs on executors.

Labels are those given (url, label: 1.0 block, 0.0 allow) or, without any, what the rules say.
Suffix statistics count every row, by partial sums per task. The trees are fitted on at most
`FIT_ROWS` labelled rows with the smallest hash of their URL, equal URLs being one row with a
weight (a documented bound for fitting only). With one class or no labelled row there is
nothing to learn: the verdict is then the class seen, or allow.

Defined cases: null URLs and those without `://` have empty host and path, match no rule
and get the model's verdict on an empty string; a URL of any length is judged whole; repeated
rows are judged alike; an empty table gives an empty result; the longest rule wins and rules of
equal length in list order; contradictory labels of one URL count as block; no rule, or more
than MAX_RULES (they become one expression), is an error (ValueError); columns other than page_id
and the URL's, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

FIT_ROWS, MAX_RULES, ROUNDS, DEPTH, SMOOTHING = 20_000, 1_000, 20, 3, 20.0
FEATURES = ["f_len", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_marks", "f_sfx_n", "f_sfx_rate"]


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host (A-Z lower-cased) and path."""
    u, at = F.coalesce(F.col(url), F.lit("")), F.locate("://", F.coalesce(F.col(url), F.lit("")))
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.withColumns({"host": F.translate(host, upper, upper.lower()), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def matched_rule(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, action), or null. rules: (action, host, path prefix)."""
    if not rules or len(rules) > MAX_RULES:
        raise ValueError(f"1 to {MAX_RULES} rules")
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    host, path = F.col("host"), F.col("path")
    found = None
    for action, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def features(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages (with host and path) and the lexical features of their own URL, and suffix."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    count = lambda c: (n - F.length(F.replace(u, c))).cast("double")
    letters = F.when(n > 0, F.array_distinct(F.split(u, ""))).otherwise(F.array().cast("array<string>"))

    def gain(total: Column, c: Column) -> Column:
        p = count(c) / n
        return total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return pages.withColumns(
        {
            "suffix": F.coalesce(F.element_at(F.split("host", r"\."), -1), F.lit("")),
            "f_len": n.cast("double"),
            "f_depth": (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/")))).cast("double"),
            "f_digits": (n - F.length(F.translate(u, "0123456789", ""))) / F.greatest(n, F.lit(1)),
            "f_entropy": F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0).cast("double"), gain),
            "f_params": F.when(query == "", 0.0).otherwise((F.length(query) - F.length(F.replace(query, F.lit("&"))) + 1).cast("double")),
            "f_labels": F.size(F.split("host", r"\.")).cast("double"),
            "f_marks": count(F.lit("-")) + count(F.lit(".")) + count(F.lit("_")),
        }
    )


def with_suffix_stats(rows: DataFrame, label: str = "label", rule: str = "rule") -> DataFrame:
    """rows with f_sfx_n and f_sfx_rate. label: 1.0 block, 0.0 allow, null unlabelled; rule: what gave the label."""
    sums = rows.groupBy("suffix", F.col(rule).alias("s_rule")).agg(F.count("*").alias("n"), F.count(label).alias("seen"), F.coalesce(F.sum(label), F.lit(0.0)).alias("block"))
    sums = cut(sums, "url-suffixes")
    stats = sums.groupBy("suffix").agg(F.sum("n").alias("s_n"), F.sum("seen").alias("s_seen"), F.sum("block").alias("s_block"))
    own = sums.where("s_rule is not null").select(F.col("suffix").alias("o_suffix"), "s_rule", F.col("seen").alias("o_seen"), F.col("block").alias("o_block"))
    out = rows.join(stats, "suffix", "left").join(own, (F.col("suffix") == F.col("o_suffix")) & (F.col(rule) == F.col("s_rule")) & F.col(label).isNotNull(), "left")
    less = lambda all_, mine: F.col(all_) - F.coalesce(F.col(mine), F.lit(0))
    rate = (less("s_block", "o_block") + SMOOTHING / 2) / (less("s_seen", "o_seen") + SMOOTHING)
    return out.withColumns({"f_sfx_n": F.log1p("s_n"), "f_sfx_rate": rate}).drop("s_n", "s_seen", "s_block", "o_suffix", "s_rule", "o_seen", "o_block")


def fit(labelled: DataFrame, label: str = "label"):
    """Trees fitted on at most FIT_ROWS of labelled, or the only class seen (0.0 when there is none)."""
    once = labelled.where(F.col(label).isNotNull()).groupBy(F.xxhash64("url", "host", "path").alias("pick"), *FEATURES, label).agg(F.count("*").cast("double").alias("f_weight"))
    sample = cut(once.orderBy("pick", *FEATURES, label).limit(FIT_ROWS), "url-fit")
    seen = [r[0] for r in sample.select(label).distinct().collect()]  # two at most
    if len(seen) < 2:
        return seen[0] if seen else 0.0
    ready = VectorAssembler(inputCols=FEATURES, outputCol="f_vec").transform(sample)
    trees = GBTClassifier(labelCol=label, featuresCol="f_vec", predictionCol="f_pred", weightCol="f_weight", maxIter=ROUNDS, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=7, cacheNodeIds=False, checkpointInterval=-1)
    return trees.fit(ready)


def scored(rows: DataFrame, model) -> DataFrame:
    """rows with f_pred: 1.0 block, 0.0 allow."""
    if isinstance(model, float):
        return rows.withColumn("f_pred", F.lit(model))
    return model.transform(VectorAssembler(inputCols=FEATURES, outputCol="f_vec").transform(rows))


def featured(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, ruled (1.0 block, 0.0 allow, null), label and all features of every page."""
    rows = features(parse(pages.select("page_id", F.col(f"`{url}`").alias("url"))).withColumn("hit", matched_rule(rules)))
    rows = rows.select("*", F.col("hit.rule").alias("rule"), F.when(F.col("hit.action") == "block", 1.0).when(F.col("hit").isNotNull(), 0.0).alias("ruled")).drop("hit")
    if labels is None:
        return cut(with_suffix_stats(rows.withColumn("label", F.col("ruled"))), "urls")
    known = labels.where("url is not null and label is not null").groupBy(F.col("url").alias("l_url")).agg(F.max(F.col("label").cast("double")).alias("label"))
    rows = rows.join(known, F.col("url") == F.col("l_url"), "left").withColumn("source", F.col("l_url"))
    return cut(with_suffix_stats(rows, rule="source").drop("l_url", "source"), "urls")


def classify(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict of every page; a rule's verdict, where one fits, goes before the trees'."""
    rows = featured(pages, rules, url, labels)
    verdict = F.when(F.coalesce(F.col("ruled"), F.col("f_pred")) == 1.0, "block").otherwise("allow")
    return scored(rows, fit(rows)).select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"))


def held_out(pages: DataFrame, rules: Sequence[tuple[str, str, str]], one_in: int = 5, labels: DataFrame | None = None) -> tuple[int, int]:
    """(right, all) of the trees' verdicts on labelled pages whose URL's hash is in one part, learned from the others."""
    rows = featured(pages, rules, labels=labels).where("label is not null")
    apart = F.pmod(F.xxhash64("url"), F.lit(one_in)) == 0
    return tuple(scored(rows.where(apart), fit(rows.where(~apart))).agg(F.count_if(F.col("f_pred") == F.col("label")), F.count("*")).first())
