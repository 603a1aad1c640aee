import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagwise.operators import pairs as P
from lagwise.operators import ranking as R
from lagwise.operators import series as S
from lagwise.plans import kernel_queries, queries
from lagwise.sources import payloads as L

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def obs(spark, **series):
    day = dt.date(2020, 1, 1)
    rows = [(k, dt.date(2020 + i // 12, 1 + i % 12, 1), float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows or [("a", day, 0.0)], S.OBSERVATIONS)


def test_upsert_takes_the_later(spark):
    a, b = obs(spark, u=[1, 2]), obs(spark, u=[5])
    got = {(r.ts.month, r.value) for r in S.upsert(a, b, ["variable_id", "ts"]).collect()}
    assert got == {(1, 5.0), (2, 2.0)}


def test_quality_verdicts(spark):
    frame = obs(spark, good=range(30), flat=[1] * 30, short=[1, 2], holes=[float("nan")] * 10 + list(range(20)))
    got = {r.variable_id: r.reason for r in S.quality(frame, min_obs=20).collect()}
    assert got == {"good": "", "flat": "variance", "short": "observations", "holes": "nan ratio"}


def test_alignment(spark):
    frame = obs(spark, x=[1, 2, 3, 4, 5], y=[10, 20, 30])
    assert P.align(frame, "x", "y").count() == 3
    assert P.align(frame, "x", "y", "outer").count() == 5
    with pytest.raises(ValueError):
        P.align(frame, "x", "y", "left")


def test_false_discovery(spark):
    mark = lambda ps, a=0.05: [r.fdr_significant for r in R.benjamini_hochberg(spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double"), a).orderBy("i").collect()]
    assert mark([0.001, 0.002, 0.003]) == [True] * 3
    assert mark([0.5, 0.001, 0.8, 0.002, 0.9]) == [False, True, False, True, False]
    assert mark([0.1]) == [False] and mark([]) == []


def test_periods_and_payloads(spark):
    rows = spark.createDataFrame([(p,) for p in ("2024-01", "2024", "2024-01-15", "not-a-date", "")], "p string")
    assert [r.d for r in rows.select(L.parse_period(F.col("p")).alias("d")).collect()] == [dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 1, 15), None, None]
    body = '{"response":{"total":2,"data":[{"period":"2024-01","value":"1.5"},{"period":"2024-02","value":null}]}}'
    assert [r.value for r in L.energy_rows(spark.createDataFrame([("e:1", body)], "variable_id string, body string")).collect()] == [1.5]
    assert len(L.chunks(2000, 2024)) == 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], S.OBSERVATIONS)
    assert S.resample_frequent(empty).count() == 0 and P.spearman(P.aligned(empty)).count() == 0


@pytest.mark.parametrize("name", ["flagship", "median_gap", "pair_score", "known_relations", "backtest", "discovery_cap"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.ORACLE[name]).df()[list(got.columns)]
    def cell(v):
        if pd.isna(v):
            return "null"
        try:
            return round(float(v), 5)
        except (TypeError, ValueError):
            return str(v)

    key = lambda d: sorted(str([cell(v) for v in r]) for r in d.itertuples(index=False))
    assert key(got) == key(want)


def test_streamed_upsert(spark, tmp_path):
    from lagwise.streaming.ingest import current, observation_stream, upsert_stream

    obs(spark, u=[1, 2]).write.parquet(str(tmp_path / "in"))
    upsert_stream(observation_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert current(spark, str(tmp_path / "out")).count() == 2


def test_kernel_queries_look_at_all_lags(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.standard_normal(80)
    y = np.concatenate([r.standard_normal(8), x[:-8]]) + 0.2 * r.standard_normal(80)
    pairs = P.aligned(obs(spark, x=x, y=y))
    monkeypatch.setattr(kernel_queries, "_pairs", lambda *_: pairs)
    led = kernel_queries.lead_direction(spark, SF).first()
    assert led.direction in ("x->y", "bidirectional") and led.lag == 8 and round(led.direction_pvalue * 101, 6) == 1
    profile = kernel_queries.lag_profile(spark, SF).first().profile
    assert len(profile) == 12 and max(profile) == profile[7]
    cause = kernel_queries.granger_causality(spark, SF).first()
    assert cause.lag >= 8 and cause.direction in ("x->y", "bidirectional")
    assert kernel_queries.MONTHLY.permutations == 200 and kernel_queries.ksg_screen(spark, SF).count() == 1


def test_prescreen_of_all_lags_equals_sql(spark):
    test_query_equals_sql(spark, "spearman_prescreen_all_lags")
    assert "lag(xv, 12)" in queries.ORACLE["spearman_prescreen_all_lags"]
