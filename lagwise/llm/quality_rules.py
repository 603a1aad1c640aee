"""Quality rules whose cutoffs follow each language and source.

A mergeable quantile sketch of each measure is kept for every (lang, source): a
log-linear histogram of integers (exact below 32, then 16 buckets per power of two,
so at most 1/16 too high). Sketches are sums of bucket counts, so they merge by
addition: sources roll up into languages and languages into one global sketch. The upper
fence of a measure is its median plus SPREAD robust deviations, these worked out from the
distance between lower quartile and median, which holds while less than half of a group is
junk. Median and quartile of each group are shrunk towards those of its language, and these
towards the global ones, with the weight of PRIOR documents; so a group of any size has
fences, its own data decide them more the more it has, and nothing switches at a size.

A document breaks a fence if its count lies above what the fence expects for its length and
above what chance adds to that: Z standard deviations of a Poisson count in the measure's unit.

Documents join the fences of their group; nothing is sampled. Groups with at least one in
SHARE of all documents, at most SHARE of them by arithmetic, go by a broadcast; the others
hold less than one in SHARE each and meet their documents in a shuffle, so neither a hot
source nor very many sources load one task.

Everything is JVM-side: the measures are array expressions inside one scan, which
shuffles nothing; the sketch aggregates partially per task before its shuffle, so a
source with a third of all rows sends a few hundred counts per task.

Defined cases: null or empty text has no words and fails the base rules; a text of any length
is measured whole; null lang and source form groups of their own; a value equal to its limit is
kept; repeated rows are judged alike; an empty table gives an empty result; with no document
that passes the base rules nothing is kept. `score` returns its own columns only; `keep` returns
all columns unchanged, whatever their names; `measures` adds columns in a struct `q` and needs
that name to be free. Windows are compared by a 64-bit hash of their eight words within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, words_of

#: Base rules: least number of words, words per window, most repeated words in a hundred.
MIN_WORDS, WINDOW, MAX_REPEAT_PCT = 20, 8, 30
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Fence:
    """count of base * scale is the measure, an integer; unit: how many of count come at a time."""

    measure: str
    count: str
    base: str
    scale: int
    unit: int


#: Symbols, repeated words and words equal to the one before per thousand words; repeated lines per thousand lines; hundredths of a character a word.
FENCES = (
    Fence("symbols", "n_symbols", "n_words", 1000, 1),
    Fence("dup_lines", "n_dup_lines", "n_lines", 1000, 1),
    Fence("repeats", "n_repeat_words", "n_words", 1000, 2 * WINDOW),
    Fence("runs", "n_runs", "n_words", 1000, 1),
    Fence("word_len", "word_chars", "n_words", 100, 2),
)
#: Robust deviations above the median; of chance; the distance of the quartile in a normal distribution; documents that a parent level counts for.
SPREAD, Z, QUARTILE, PRIOR, SHARE = 6.0, 3.0, 0.6745, 50, 1000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_runs"]


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(keys: Column) -> Column:
    """Positions covered by windows whose key comes twice or more; keys: one hash per window start."""

    def within(ordered: Column) -> Column:
        marked = F.transform(
            ordered,
            lambda x, j: F.when(
                (F.get(ordered, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(ordered, j - 1)["h"] == x["h"])), x["i"]
            ),
        )
        starts = F.sort_array(F.array_compact(marked))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            starts,
            zero,
            lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(a["end"] - p, F.lit(0))).alias("n")),
            lambda a: a["n"],
        )

    ordered = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(_let(ordered, within))


def measures(docs: DataFrame) -> DataFrame:
    """docs with a struct q: the counts of COUNTS, base_failed, and the measures of FENCES."""
    # the caller's columns travel in one struct, so that no name clashes; steps are plain columns, so that each is worked out once
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    step = step.select("row", "text", words_of(F.col("text")).alias("words"), F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("lines"))
    step = step.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    h, n = F.col("hashes"), F.size("words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    step = step.withColumn("keys", F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _covered(F.col("keys")),
        "n_lines": F.size("lines"),
        "n_runs": F.size(F.filter(h, lambda x, j: (j > 0) & (F.get(h, j - 1) == x))),
    }
    step = step.select("row", *[counts[c].cast("long").alias(c) for c in COUNTS])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    rates = [F.floor(F.col(f.count) * f.scale / F.greatest(f.base, F.lit(1))).cast("long").alias(f.measure) for f in FENCES]
    return step.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.struct(*COUNTS, failed.alias("base_failed"), *rates).alias("q"))


def bucket_top(v: Column) -> Column:
    """The largest integer in v's sketch bucket: v itself below 32, else 16 buckets per power of two."""
    shift = F.length(F.bin(v)) - 5
    cell = F.floor(v / F.pow(F.lit(2), shift)).cast("long")
    return F.when(v < 32, v).otherwise(((cell + 1) * F.pow(F.lit(2), shift)).cast("long") - 1)


def sketch(measured: DataFrame) -> DataFrame:
    """Bucket counts (lang, source, measure, top, n) per (lang, source) of what passes the base rules. measured: lang, source, q."""
    pairs = F.array(*[F.struct(F.lit(f.measure).alias("m"), bucket_top(F.col(f"q.{f.measure}")).alias("t")) for f in FENCES])
    rows = measured.where(~F.col("q.base_failed")).select("lang", "source", F.explode(pairs).alias("p"))
    return rows.groupBy("lang", "source", F.col("p.m").alias("measure"), F.col("p.t").alias("top")).agg(F.count("*").alias("n"))


def _quantiles(sketches: DataFrame, level: int) -> DataFrame:
    """keys of the level, measure, size, mid, low."""
    keys = ["lang", "source"][:level]
    merged = sketches.groupBy(*keys, "measure", "top").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    run = merged.select("*", F.sum("n").over(w.orderBy("top")).alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda num, den: F.min(F.when(F.col("upto") * den >= F.col("total") * num, F.col("top"))).cast("double")
    return run.groupBy(*keys, "measure").agg(F.max("total").alias("size"), at(1, 2).alias("mid"), at(1, 4).alias("low"))


def fences(sketches: DataFrame) -> DataFrame:
    """One row per (lang, source) of the sketches: g_lang, g_source, g_size, and g_<measure>: its fence."""
    out = _quantiles(sketches, 0).select("measure", F.col("size").alias("whole"), F.col("mid").alias("up_mid"), F.col("low").alias("up_low"))
    for level in (1, 2):
        keys = ["lang", "source"][:level]
        up = out.select(*[F.col(k).alias(f"up_{k}") for k in keys[:-1]], F.col("measure").alias("up_measure"), "whole", "up_mid", "up_low")
        own = _quantiles(sketches, level)
        same = own["measure"] == up["up_measure"]
        for k in keys[:-1]:
            same = same & own[k].eqNullSafe(up[f"up_{k}"])
        shrunk = lambda c: ((F.col("size") * F.col(c) + PRIOR * F.col(f"up_{c}")) / (F.col("size") + PRIOR))
        out = own.join(up, same).select(*keys, "measure", "size", "whole", shrunk("mid").alias("m"), shrunk("low").alias("l"))
        out = out.select(*keys, "measure", "size", "whole", F.col("m").alias("up_mid"), F.col("l").alias("up_low"))
    fence = F.col("up_mid") + SPREAD * ((F.col("up_mid") - F.col("up_low")) / QUARTILE)
    out = out.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(F.max("size").alias("g_size"), F.max("whole").alias("g_whole"), *[F.max(F.when(F.col("measure") == f.measure, fence)).alias(f"g_{f.measure}") for f in FENCES])
    return out


def judge(measured: DataFrame, share: int = SHARE) -> DataFrame:
    """measured (lang, source, q and others) with kept: false where the base rules fail or a measure breaks its group's fence.

    measured is read several times (sketch, then join): pass a written table.
    """
    groups = cut(fences(sketch(measured)), "fences")
    large = groups.where(F.col("g_size") * share >= F.col("g_whole"))
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    over = F.lit(False)
    for f in FENCES:
        expected = F.col(f"g_{f.measure}") * F.greatest(f"q.{f.base}", F.lit(1)) / f.scale
        over = over | (F.col(f"q.{f.count}") > expected + Z * F.sqrt(f.unit * expected) + Z * Z * f.unit)
    kept = (~F.col("q.base_failed") & ~F.coalesce(over, F.lit(False))).alias("kept")
    own = [F.col(f"`{c}`") for c in measured.columns]
    # documents of groups that have no fences fail the base rules, so the second join keeps every row
    first = measured.join(F.broadcast(large), same).select(*own, kept)
    rest = measured.join(F.broadcast(large.select("g_lang", "g_source")), same, "left_anti")
    small = groups.where(F.col("g_size") * share < F.col("g_whole"))
    return first.unionAll(rest.join(small, same, "left").select(*own, kept))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and every count of docs, base_failed and kept."""
    slim = docs.select("doc_id", "text", "lang", "source")
    return judge(cut(measures(slim).drop("text"), "quality")).select("doc_id", "lang", "source", "q.*", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, unchanged."""
    measured = cut(measures(docs.select(F.struct("*").alias("row"), "text", "lang", "source")).drop("text"), "quality")
    return judge(measured).where("kept").select("row.*")


#: The counts and verdicts of `score` over a table `documents`, in DuckDB's dialect.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i:i + {WINDOW - 1}] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW})),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win), range({WINDOW}) r(j) WHERE c > 1 GROUP BY rid),
runs AS (SELECT rid, count(*) AS n FROM (SELECT rid, w = lag(w) OVER (PARTITION BY rid ORDER BY i) AS same FROM (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d)) WHERE same GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
(len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, coalesce(runs.n, 0)::BIGINT AS n_runs FROM lines LEFT JOIN rep USING (rid) LEFT JOIN runs USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM c),
m AS ({" UNION ALL ".join(f"SELECT lang, source, '{f.measure}' AS measure, {f.count} * {f.scale} // greatest({f.base}, 1) AS v FROM b WHERE NOT base_failed" for f in FENCES)}),
t AS (SELECT lang, source, measure, CASE WHEN v < 32 THEN v ELSE (((v >> (length(bin(v)) - 5)) + 1) << (length(bin(v)) - 5)) - 1 END AS top FROM m),
q0 AS (SELECT measure, quantile_disc(top, 0.5)::DOUBLE AS mid, quantile_disc(top, 0.25)::DOUBLE AS low FROM t GROUP BY 1),
q1 AS (SELECT lang, measure, (count(*) * quantile_disc(top, 0.5)::DOUBLE + {PRIOR} * any_value(q0.mid)) / (count(*) + {PRIOR}) AS mid, (count(*) * quantile_disc(top, 0.25)::DOUBLE + {PRIOR} * any_value(q0.low)) / (count(*) + {PRIOR}) AS low FROM t JOIN q0 USING (measure) GROUP BY 1, 2),
q2 AS (SELECT t.lang, t.source, t.measure, (count(*) * quantile_disc(top, 0.5)::DOUBLE + {PRIOR} * any_value(q1.mid)) / (count(*) + {PRIOR}) AS mid, (count(*) * quantile_disc(top, 0.25)::DOUBLE + {PRIOR} * any_value(q1.low)) / (count(*) + {PRIOR}) AS low FROM t JOIN q1 ON t.measure = q1.measure AND t.lang IS NOT DISTINCT FROM q1.lang GROUP BY 1, 2, 3),
g AS (SELECT lang, source, {", ".join(f"max(CASE WHEN measure = '{f.measure}' THEN mid + {SPREAD} * ((mid - low) / {QUARTILE}) END) AS g_{f.measure}" for f in FENCES)} FROM q2 GROUP BY 1, 2),
e AS (SELECT b.*, {", ".join(f"g_{f.measure} * greatest({f.base}, 1) / {f.scale} AS e_{f.measure}" for f in FENCES)} FROM b LEFT JOIN g ON b.lang IS NOT DISTINCT FROM g.lang AND b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({" OR ".join(f"{f.count} > e_{f.measure} + {Z}::DOUBLE * sqrt({f.unit} * e_{f.measure}) + {Z * Z * f.unit}::DOUBLE" for f in FENCES)}, false) AS kept FROM e"""
