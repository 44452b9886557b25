"""Average / percentile ranks and exact quantiles against pandas and numpy,
for both strategies, including a hot group spread over many partitions."""

import numpy as np
import pandas as pd
import pytest

from tardy.operators.ranking import average_rank, group_quantiles, value_positions


def _data(seed=0, n=4000):
    rng = np.random.default_rng(seed)
    g = rng.choice([1, 2, 3, 4], size=n, p=[0.7, 0.1, 0.1, 0.1])  # group 1 is hot
    v = rng.integers(0, 300, size=n).astype(float)  # many ties
    v[rng.random(n) < 0.05] = np.nan
    g = g.astype(float)
    g[rng.random(n) < 0.01] = np.nan  # null keys get null ranks
    return pd.DataFrame({"g": g, "v": v, "rid": np.arange(n)})


@pytest.mark.parametrize("strategy,parts", [("window", None), ("range", 4), ("range", 37)])
def test_average_rank_matches_pandas(spark, strategy, parts):
    pdf = _data()
    df = spark.createDataFrame(pdf).selectExpr("CAST(g AS BIGINT) g", "v", "rid")
    if strategy == "range":
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = average_rank(df, ["g"], "v", "r", "pct", strategy=strategy).toPandas().sort_values("rid")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    exp = pdf.copy()
    exp["r"] = exp.groupby("g")["v"].rank(method="average")
    exp["pct"] = exp.groupby("g")["v"].rank(method="average", pct=True)
    np.testing.assert_allclose(out["r"].to_numpy(float), exp["r"].to_numpy(float), equal_nan=True)
    np.testing.assert_allclose(out["pct"].to_numpy(float), exp["pct"].to_numpy(float), equal_nan=True)


def test_percentile_ranks_in_unit_interval_and_mean_rank(spark):
    pdf = _data(seed=3)
    df = spark.createDataFrame(pdf).selectExpr("CAST(g AS BIGINT) g", "v", "rid")
    out = average_rank(df, ["g"], "v", "r", "pct", strategy="range").toPandas().dropna(subset=["r"])
    assert (out.pct > 0).all() and (out.pct <= 1).all()
    for _, grp in out.groupby("g"):
        n = len(grp)
        assert abs(grp.r.mean() - (n + 1) / 2) < 1e-9


def test_positions_strategies_agree(spark):
    pdf = _data(seed=5)
    df = spark.createDataFrame(pdf).selectExpr("CAST(g AS BIGINT) g", "v")
    a = value_positions(df, ["g"], "v", strategy="window").toPandas().sort_values(["g", "v"]).reset_index(drop=True)
    b = value_positions(df, ["g"], "v", strategy="range", num_partitions=29).toPandas().sort_values(["g", "v"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a[["g", "v", "_n", "_below", "_total"]], b[["g", "v", "_n", "_below", "_total"]], check_dtype=False)


@pytest.mark.parametrize("strategy", ["window", "range"])
def test_quantiles_match_numpy(spark, strategy):
    pdf = _data(seed=7).dropna(subset=["g"])
    df = spark.createDataFrame(pdf).selectExpr("CAST(g AS BIGINT) g", "v")
    probs = {"q1": 0.25, "med": 0.5, "q3": 0.75, "p90": 0.9}
    out = group_quantiles(df, ["g"], "v", probs, strategy=strategy).toPandas().set_index("g").sort_index()
    for g, grp in pdf.groupby("g"):
        vals = grp.v.dropna().to_numpy()
        for name, q in probs.items():
            assert out.loc[g, name] == pytest.approx(np.percentile(vals, q * 100), abs=1e-12)
