"""OLS with treatment-coded categorical covariates and cluster-robust
(sandwich) standard errors, computed from sufficient statistics.

Rows never leave Spark. The work is split so that no step holds more than a
fixed-size object per model:

1. ``suffstats``: per (model keys, cluster, covariate pattern) the count,
   sum(y) and sum(y^2) -- a map-side combined aggregate over the rows;
2. one ``applyInPandas`` per model on its pattern totals (at most the product of
   the level counts rows): sorted levels, dummy terms (the first level is the
   reference), the normal equations' beta, (X'X)^+, fit statistics, and for every
   pattern its active terms and fitted value; written;
3. per-cluster score vectors s_g = sum x * (sum y - n * fitted) and their
   outer products, summed per model on Spark (p^2 values per cluster);
4. a last ``applyInPandas`` per model on p x p matrices: covariance
   c * B M B with c = G/(G-1) * (N-1)/(N-p), normal p-values and 95 % bounds;
   written, and read for the terms and for the covariance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import COVARIATES, RESPONSE
from ..sources.tables import materialize
from .joinback import small_or_shuffled

RCOND = 1e-10
Z975 = 1.959963984540054
INTERCEPT = "Intercept"
FIT_STATS = ("nobs", "n_clusters", "rank", "df_model", "df_resid", "rsquared", "rsquared_adj", "llf", "aic", "bic", "ssr")


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def listwise(df: DataFrame, y: str, factors: Sequence[str], cluster: str) -> DataFrame:
    cond = F.col(y).isNotNull() & F.col(cluster).isNotNull()
    for f in factors:
        cond = cond & F.col(f).isNotNull()
    return df.where(cond)


def suffstats(
    df: DataFrame,
    keys: Sequence[str] = (),
    y: str = RESPONSE,
    factors: Sequence[str] = COVARIATES,
    cluster: str = "course_id",
) -> DataFrame:
    """(keys, cluster, factors) -> n, sy, syy over complete rows."""
    d = listwise(df, y, factors, cluster)
    return d.groupBy(*keys, cluster, *[F.col(f).cast("string").alias(f) for f in factors]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy")
    )


def design_levels(sfs: DataFrame, keys: Sequence[str] = (), factors: Sequence[str] = COVARIATES) -> DataFrame:
    """Levels per (model, factor): sorted, the first is the reference, the
    others are dummy terms ``C(f)[T.level]`` numbered from 1 in formula order
    (0 is the intercept). The table has one row per level and model."""
    keys = list(keys)
    arms = ", ".join(f"{pos}, '{f}', `{f}`" for pos, f in enumerate(factors))
    parts = sfs.select(*keys, F.expr(f"stack({len(factors)}, {arms}) AS (factor_pos, factor, level)")).distinct()
    w = Window.partitionBy(*keys, "factor").orderBy("level")
    lv = parts.withColumn("level_no", F.row_number().over(w) - 1)
    terms = lv.where("level_no > 0")
    wt = Window.partitionBy(*keys).orderBy("factor_pos", "level_no")
    terms = terms.withColumn("term_idx", F.row_number().over(wt)).select(*keys, "factor", "level", "term_idx")
    return lv.join(terms, [*keys, "factor", "level"], "left").select(
        *keys,
        "factor_pos",
        "factor",
        "level",
        "level_no",
        (F.col("level_no") == 0).alias("is_reference"),
        F.when(F.col("level_no") > 0, F.concat(F.lit("C("), F.col("factor"), F.lit(")[T."), F.col("level"), F.lit("]"))).alias("term"),
        "term_idx",
    )


def _term(factor: str, level: str) -> str:
    return f"C({factor})[T.{level}]"


def _solve(keys: list[str], factors: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = [sorted(pdf[f].unique()) for f in factors]
        number, term_of = 1, []
        for values in levels:
            term_of.append({v: number + k - 1 for k, v in enumerate(values) if k})
            number += len(values) - 1
        p = number
        active = [[0, *[t[v] for t, v in zip(term_of, row, strict=True) if v in t]] for row in pdf[factors].itertuples(index=False)]
        X = np.zeros((len(pdf), p))
        for r, act in enumerate(active):
            X[r, act] = 1.0
        n = pdf["n"].to_numpy(float)
        sy = pdf["sy"].to_numpy(float)
        syy = float(pdf["syy"].sum())
        xtx = X.T @ (X * n[:, None])
        xty = X.T @ sy
        bread = np.linalg.pinv(xtx, rcond=RCOND, hermitian=True)
        beta = bread @ xty
        sv = np.linalg.svd(xtx, compute_uv=False)
        rank = int((sv > RCOND * sv.max()).sum()) if sv.size and sv.max() > 0 else 0
        N = float(n.sum())
        fitted = X @ beta
        ssr = float(syy - 2.0 * fitted @ sy + (n * fitted * fitted).sum())
        ssr = max(ssr, 0.0)
        ybar = sy.sum() / N
        tss = syy - N * ybar * ybar
        df_model = rank - 1
        df_resid = N - rank
        r2 = 1.0 - ssr / tss if tss > 0 else float("nan")
        r2a = 1.0 - (N - 1) / df_resid * (1.0 - r2) if df_resid > 0 else float("nan")
        llf = -N / 2.0 * (math.log(2 * math.pi) + math.log(ssr / N) + 1.0) if ssr > 0 else float("nan")
        aic = -2 * llf + 2 * (df_model + 1)
        bic = -2 * llf + math.log(N) * (df_model + 1)
        stats = dict(nobs=N, rank=rank, df_model=df_model, df_resid=df_resid, rsquared=r2,
                     rsquared_adj=r2a, llf=llf, aic=aic, bic=bic, ssr=ssr)
        none = [None] * len(factors)
        rows = [("coef", i, -1, None, float(beta[i]), p, None, *none) for i in range(p)]
        rows += [("bread", i, j, None, float(bread[i, j]), p, None, *none) for i in range(p) for j in range(p)]
        rows += [("stat", -1, -1, k, float(v), p, None, *none) for k, v in stats.items()]
        rows += [("level", f, k, v, float(term_of[f].get(v, 0)), p, None, *none) for f, values in enumerate(levels) for k, v in enumerate(values)]
        rows += [("pattern", -1, -1, None, float(fitted[r]), p, act, *row) for r, (act, row) in enumerate(zip(active, pdf[factors].itertuples(index=False), strict=True))]
        out = pd.DataFrame(rows, columns=["kind", "i", "j", "name", "value", "_p", "_active", *factors])
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out[keys + ["kind", "i", "j", "name", "value", "_p", "_active", *factors]]

    return run


def _finish(keys: list[str], factors: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(pdf.loc[pdf.kind == "coef", "i"].max()) + 1
        beta = np.zeros(p)
        c = pdf[pdf.kind == "coef"]
        beta[c.i.to_numpy()] = c.value.to_numpy()
        B = np.zeros((p, p))
        b = pdf[pdf.kind == "bread"]
        B[b.i.to_numpy(), b.j.to_numpy()] = b.value.to_numpy()
        M = np.zeros((p, p))
        m = pdf[pdf.kind == "meat"]
        M[m.i.to_numpy(), m.j.to_numpy()] = m.value.to_numpy()
        names = {0: INTERCEPT}
        for r in pdf[(pdf.kind == "level") & (pdf.value > 0)].itertuples():
            names[int(r.value)] = _term(factors[r.i], r.name)
        st = dict(zip(pdf.loc[pdf.kind == "stat", "name"], pdf.loc[pdf.kind == "stat", "value"]))
        N, G = st["nobs"], st["n_clusters"]
        corr = (G / (G - 1.0)) * ((N - 1.0) / (N - p)) if G > 1 and N > p else float("nan")
        V = corr * (B @ M @ B)
        se = np.sqrt(np.clip(np.diag(V), 0.0, None))
        with np.errstate(divide="ignore", invalid="ignore"):
            z = beta / se
        pval = np.array([math.erfc(abs(v) / math.sqrt(2.0)) if np.isfinite(v) else float("nan") for v in z])
        rows = []
        for i in range(p):
            rows.append(("coef", i, -1, names[i], None, float(beta[i]), float(se[i]), float(z[i]), float(pval[i]),
                         float(beta[i] - Z975 * se[i]), float(beta[i] + Z975 * se[i])))
        for i in range(p):
            for j in range(p):
                rows.append(("cov", i, j, names[i], names[j], float(V[i, j]), None, None, None, None, None))
        out = pd.DataFrame(rows, columns=["kind", "i", "j", "term_i", "term_j", "coef", "se", "z", "p", "ci_low", "ci_high"])
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return run


_SOLVED = "kind string, i int, j int, name string, value double, _p int, _active array<int>"
_FINISHED = "kind string, i int, j int, term_i string, term_j string, coef double, se double, z double, p double, ci_low double, ci_high double"


def _schema(fields: list[T.StructField], rest: str, factors: Sequence[str] = ()) -> T.StructType:
    return T.StructType([*fields, *T._parse_datatype_string(rest).fields, *[T.StructField(f, T.StringType()) for f in factors]])


def fit(
    df: DataFrame,
    keys: Sequence[str] = (),
    y: str = RESPONSE,
    factors: Sequence[str] = COVARIATES,
    cluster: str = "course_id",
    sfs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Fit one model per ``keys`` value. Returns DataFrames ``terms`` (keys,
    term_idx, term, coef, se, z, p, ci_low, ci_high), ``cov`` (keys, term_i,
    term_j, value), ``fit_stats`` (keys, statistic, value), ``levels`` and
    ``suffstats``. ``sfs`` may pass sufficient statistics that are already written."""
    keys, factors = list(keys), list(factors)
    model_keys = keys or ["_model"]
    if sfs is None:
        # Written once: every later step reads this small table (models x
        # clusters x covariate patterns) instead of recomputing the rows.
        sfs = materialize(suffstats(df, keys, y, factors, cluster), "ols_suffstats")
    if not keys:
        sfs = sfs.withColumn("_model", F.lit(0))

    # 2. levels and normal equations per model from pattern totals
    pat = sfs.groupBy(*model_keys, *factors).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"))
    kf = _key_fields(sfs, model_keys)
    solved = pat.groupBy(*model_keys).applyInPandas(_solve(model_keys, factors), _schema(kf, _SOLVED, factors))
    solved = materialize(solved, "ols_solved")
    level = solved.where(F.col("kind") == "level")
    factor = F.element_at(F.array(*[F.lit(f) for f in factors]), F.col("i") + 1)
    levels = level.select(
        *model_keys, F.col("i").alias("factor_pos"), factor.alias("factor"), F.col("name").alias("level"), F.col("j").alias("level_no"),
        (F.col("j") == 0).alias("is_reference"),
        F.when(F.col("j") > 0, F.concat(F.lit("C("), factor, F.lit(")[T."), F.col("name"), F.lit("]"))).alias("term"),
        F.when(F.col("j") > 0, F.col("value").cast("int")).alias("term_idx"),
    )

    # 3. cluster scores and their outer products
    patterns = small_or_shuffled(materialize(solved.where(F.col("kind") == "pattern").select(*model_keys, *factors, "_p", "_active", F.col("value").alias("_fit")), "ols_patterns"))
    res = sfs.join(patterns, [*model_keys, *factors]).withColumn("_r", F.col("sy") - F.col("n") * F.col("_fit"))
    score = (
        res.select(*model_keys, cluster, "_p", "_r", F.explode("_active").alias("t"))
        .groupBy(*model_keys, cluster, "_p", "t")
        .agg(F.sum("_r").alias("s"))
        .groupBy(*model_keys, cluster, "_p")
        .agg(F.map_from_entries(F.collect_list(F.struct("t", "s"))).alias("_s"))
    )
    idx = F.sequence(F.lit(0), F.col("_p") * F.col("_p") - 1)
    s_at = lambda t: F.coalesce(F.element_at(F.col("_s"), t), F.lit(0.0))
    meat = (
        score.select(
            *model_keys, "_p",
            F.posexplode(F.transform(idx, lambda q: s_at((q / F.col("_p")).cast("int")) * s_at(q % F.col("_p")))).alias("q", "v"),
        )
        .groupBy(*model_keys, "_p", "q")
        .agg(F.sum("v").alias("value"))
        .select(
            *model_keys, F.lit("meat").alias("kind"), (F.col("q") / F.col("_p")).cast("int").alias("i"),
            (F.col("q") % F.col("_p")).cast("int").alias("j"), F.lit(None).cast("string").alias("name"), "value",
        )
    )
    n_clusters = sfs.groupBy(*model_keys).agg(F.countDistinct(cluster).cast("double").alias("value")).select(
        *model_keys, F.lit("stat").alias("kind"), F.lit(-1).alias("i"), F.lit(-1).alias("j"),
        F.lit("n_clusters").alias("name"), "value",
    )
    own = solved.where(F.col("kind") != "pattern").select(*model_keys, "kind", "i", "j", "name", "value")
    parts = own.unionByName(meat).unionByName(n_clusters)

    # 4. covariance, p-values, intervals per model
    fin = parts.groupBy(*model_keys).applyInPandas(_finish(model_keys, factors), _schema(kf, _FINISHED))
    fin = materialize(fin, "ols_fit")
    terms = fin.where(F.col("kind") == "coef").select(
        *keys, F.col("i").alias("term_idx"), F.col("term_i").alias("term"), "coef", "se", "z", "p", "ci_low", "ci_high"
    )
    cov = fin.where(F.col("kind") == "cov").select(*keys, "term_i", "term_j", F.col("coef").alias("value"))
    stats = parts.where(F.col("kind") == "stat").select(*keys, F.col("name").alias("statistic"), "value")
    return {"terms": terms, "cov": cov, "fit_stats": stats, "levels": levels.drop("_model"), "suffstats": sfs.drop("_model")}
