"""Row choice, density, histogram, box statistics and OLS against numpy."""

import math

import numpy as np
import pandas as pd
import pytest

from tardy.operators import ols
from tardy.operators.dedupe import first_per_key
from tardy.operators.density import auto_histogram, box_stats, kde_grid


def test_first_per_key_nulls_first_and_null_key_group(spark):
    df = spark.createDataFrame(
        [(1, None, "a"), (1, 2, "b"), (1, 1, "c"), (None, 5, "d"), (None, 4, "e")], "k long, o long, x string"
    )
    out = {r.k: (r.o, r.x) for r in first_per_key(df, ["k"], ["o"]).collect()}
    assert out[1] == (None, "a")  # nulls sort first, as in the DuckDB twin
    assert out[None] == (4, "e")  # null keys form one group
    out2 = {r.k: (r.o, r.x) for r in first_per_key(df, ["k"], ["o"], nulls_last=["o"]).collect()}
    assert out2[1] == (1, "c")


def test_kde_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.clip(rng.normal(0.5, 0.15, 300), 0, 1)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "v": x}))
    out = kde_grid(df, ["k"], "v").toPandas().sort_values("grid_i")
    bw = x.std(ddof=1) * len(x) ** (-0.2)
    grid = np.linspace(max(x.min() - 3 * bw, 0), min(x.max() + 3 * bw, 1), 200)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi))
    np.testing.assert_allclose(out.x.to_numpy(), grid, atol=1e-12)
    np.testing.assert_allclose(out.density.to_numpy(), dens, rtol=1e-10)


def test_kde_skips_degenerate_levels(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.3), (2, 0.3), (3, 0.1), (3, 0.2)], "k long, v double")
    keys = {r.k for r in kde_grid(df, ["k"], "v").select("k").distinct().collect()}
    assert keys == {3}


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.beta(2, 5, 500)
    out = auto_histogram(spark.createDataFrame(pd.DataFrame({"v": x})), "v").toPandas().sort_values("bin")
    q75, q25 = np.percentile(x, [75, 25])
    fd = 2 * (q75 - q25) * len(x) ** (-1 / 3)
    st = (x.max() - x.min()) / (math.log2(len(x)) + 1)
    nb = int(math.ceil((x.max() - x.min()) / min(fd, st)))
    counts, edges = np.histogram(x, bins=nb, range=(x.min(), x.max()))
    assert len(out) == nb
    np.testing.assert_array_equal(out["count"].to_numpy(), counts)
    np.testing.assert_allclose(out.bin_lo.to_numpy(), edges[:-1], atol=1e-12)


def test_box_stats(spark):
    x = np.array([1, 2, 3, 4, 5, 6, 7, 8, 100.0])
    out = box_stats(spark.createDataFrame(pd.DataFrame({"k": 0, "v": x})), ["k"], "v").first()
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    assert (out.q1, out.median, out.q3) == (q1, med, q3)
    assert out.whisker_high == 8 and out.whisker_low == 1 and out.n_outliers == 1


def _dense_cluster_ols(pdf, y, factors, cluster):
    cols, X = ["Intercept"], [np.ones(len(pdf))]
    for f in factors:
        lv = sorted(pdf[f].unique())
        for level in lv[1:]:
            cols.append(f"C({f})[T.{level}]")
            X.append((pdf[f] == level).to_numpy(float))
    X = np.column_stack(X)
    yv = pdf[y].to_numpy()
    b = np.linalg.pinv(X, rcond=1e-10) @ yv
    e = yv - X @ b
    bread = np.linalg.pinv(X.T @ X, rcond=1e-10)
    g = pdf[cluster].to_numpy()
    meat = sum(np.outer((X[g == c] * e[g == c, None]).sum(0), (X[g == c] * e[g == c, None]).sum(0)) for c in np.unique(g))
    n, k = X.shape
    G = len(np.unique(g))
    V = bread @ meat @ bread * (G / (G - 1)) * ((n - 1) / (n - k))
    return cols, b, np.sqrt(np.diag(V))


def _ols_frame(seed, collinear=False):
    rng = np.random.default_rng(seed)
    n = 600
    pdf = pd.DataFrame({
        "course_id": rng.integers(0, 25, n),
        "gender": rng.choice(["F", "M"], n),
        "is_a_urm": rng.choice(["N", "Y"], n),
        "first_gen_status": rng.choice(["N", "Y"], n),
        "ethnicity": rng.choice(["Asian", "Black", "Hispanic", "White"], n),
    })
    if collinear:
        pdf["is_a_urm"] = np.where(pdf.ethnicity.isin(["Black", "Hispanic"]), "Y", "N")
    pdf["procrastination_mean_rank"] = rng.random(n) + 0.05 * (pdf.gender == "M")
    return pdf


@pytest.mark.parametrize("collinear", [False, True])
def test_ols_cluster_matches_dense(spark, collinear):
    pdf = _ols_frame(4, collinear)
    res = ols.fit(spark.createDataFrame(pdf))
    terms = res["terms"].toPandas().sort_values("term_idx")
    cols, b, se = _dense_cluster_ols(pdf, "procrastination_mean_rank", ["gender", "is_a_urm", "first_gen_status", "ethnicity"], "course_id")
    assert list(terms.term) == cols
    np.testing.assert_allclose(terms.coef.to_numpy(), b, atol=1e-9)
    np.testing.assert_allclose(terms.se.to_numpy(), se, rtol=1e-8)
    z = b / se
    np.testing.assert_allclose(terms.p.to_numpy(), [math.erfc(abs(v) / math.sqrt(2)) for v in z], rtol=1e-8)
    stats = dict(res["fit_stats"].toPandas().values)
    assert stats["rank"] == (len(cols) - 1 if collinear else len(cols))
    assert stats["nobs"] == len(pdf)


def test_ols_per_key_models(spark):
    a, b = _ols_frame(5), _ols_frame(6)
    both = pd.concat([a.assign(m=1), b.assign(m=2)])
    res = ols.fit(spark.createDataFrame(both), keys=["m"])["terms"].toPandas()
    for m, part in ((1, a), (2, b)):
        _, coef, _ = _dense_cluster_ols(part, "procrastination_mean_rank", ["gender", "is_a_urm", "first_gen_status", "ethnicity"], "course_id")
        np.testing.assert_allclose(res[res.m == m].sort_values("term_idx").coef.to_numpy(), coef, atol=1e-9)


def test_seeded_student_is_the_one_pandas_draws(spark):
    import random

    import pandas as pd

    from tardy.plans.explore import student_bands

    rnd = random.Random(5)
    rows = [(u, rnd.random() * 0.3 + 0.35 * (u % 3)) for u in rnd.sample(range(1000, 9000), 150) for _ in range(3)]
    rows += [(None, 0.1), (7, None)]
    got = {r.band: (r.user_id, r.n_users) for r in student_bands(spark.createDataFrame(rows, "user_id long, assignment_percentile_ranks double").repartition(3)).collect()}
    mean = pd.DataFrame(rows, columns=["u", "p"]).dropna(subset=["u"]).groupby("u")["p"].mean()
    bands = {"low": mean[mean < 0.25], "mid": mean[(mean > 0.4) & (mean < 0.6)], "high": mean[mean > 0.75]}
    assert got == {b: (int(m.sample(n=1, random_state=1).index[0]), len(m)) for b, m in bands.items()}
    one = student_bands(spark.createDataFrame([(3, 0.1)], "user_id long, assignment_percentile_ranks double")).collect()
    assert [(r.band, r.user_id) for r in one] == [("low", 3)]
