"""Rounding, quantiles, sums and deviations agree with DuckDB to the last bit; checksums beyond a long stay exact."""

from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from busloom.operators import exact, ordered
from busloom.plans import catalogue


def test_rounding_as_sql(spark):
    rng = np.random.default_rng(1)
    values = [0.0005005, -0.0005005, 0.1484335, 2.5e-6, -0.4999999e-6, 2140080.1733615, 1e12 + 0.1, 1e305, 0.0, *(rng.integers(0, 10**9, 2000) * 1e-6 + 5e-7), *((np.arange(2000) * 57600 + 28800) / 16e6 / 3600)]
    frame = pd.DataFrame({"x": values})
    theirs = duckdb.connect().sql("SELECT round(x, 6) AS r FROM frame").df()["r"].tolist()
    got = spark.createDataFrame(frame.reset_index()).select("index", exact.rounded(F.col("x"), 6).alias("r"), F.round("x", 6).alias("plain")).orderBy("index").toPandas()
    assert got["r"].tolist() == theirs
    assert got["plain"].tolist() != theirs  # ties of the shortest decimal, not of the double


def test_quantiles_as_sql(spark):
    rng = np.random.default_rng(2)
    frame = pd.concat([pd.DataFrame({"g": g, "x": rng.normal(0, 1e3, rng.integers(3, 40))}) for g in range(200)])
    theirs = duckdb.connect().sql("SELECT g, quantile_cont(x, [0.05, 0.25, 0.5, 0.95]) AS p FROM frame GROUP BY g ORDER BY g").df()
    theirs = [list(p) for p in theirs["p"]]
    rows = spark.createDataFrame(frame)
    assert [list(r["p"]) for r in ordered.quantiles(rows, ["g"], "x", [0.05, 0.25, 0.5, 0.95], "p").orderBy("g").collect()] == theirs
    sorted_ = rows.groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("a")).orderBy("g")
    assert [list(r) for r in sorted_.select(*[exact.quantile(F.col("a"), p).alias(f"p{p}") for p in (0.05, 0.25, 0.5, 0.95)]).collect()] == theirs


def test_moments_as_sql(spark):
    rng = np.random.default_rng(3)
    arrays = [[float(v) if i % 5 else None for i, v in enumerate(rng.normal(100, 30, 16))] for _ in range(200)] + [[], [None], [2.0]]
    got = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<double>").select("i", exact.moments(F.col("a")).alias("m")).select("i", "m.*").orderBy("i").collect()
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for r, a in zip(got, arrays, strict=True):
        frame = pd.DataFrame({"x": pd.array(a, dtype="Float64")})
        assert (r["mean"], r["sd"], r["total"]) == con.sql("SELECT avg(x), stddev_pop(x), sum(x) FROM frame").fetchall()[0]


def test_store_groups_unrounded_values(spark, monkeypatch):
    features = spark.createDataFrame([("v1", "c", 0, 1.0000001), ("v1", "c", 1, 1.0000002), ("v1", "c", 2, 2.0), ("v1", "c", 3, 2.0)], "vehicle string, capture string, widx long, dt_mean_norm double")
    monkeypatch.setattr(catalogue, "bus", lambda *_: SimpleNamespace(features=features))
    got = catalogue.queries()["s8_feature_store"](spark, "").collect()
    assert sorted((r["dt"], r["n"]) for r in got) == [(1.0, 1), (1.0, 1), (2.0, 2)]


def test_checksum_beyond_a_long(spark, monkeypatch):
    us = 6 * 10**18
    frames = spark.createDataFrame([("v0", "c0", "dos", i, us, 1, 2, [1, 2, *[-1] * 6], 0, None, None) for i in range(3)], "vehicle string, capture string, family string, seq long, us long, aid int, dlc int, b array<int>, y int, s0 long, s1 long")
    monkeypatch.setattr(catalogue.src, "event_frames", lambda *_: frames)
    assert [(int(r["us"]), r["n"]) for r in catalogue.queries()["s1_s3_captures"](spark, "").collect()] == [(3 * us, 3)]
