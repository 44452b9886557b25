"""DuckDB twins of the regressions: the normal equations' pseudo-inverse by
Gauss-Jordan steps of a recursive CTE (one matrix per model), then the sandwich
covariance by joins."""

from __future__ import annotations

from .ctes import cte

FACTORS = ("gender", "is_a_urm", "first_gen_status", "ethnicity")
#: Terms of the fixture's levels (fixed values).
TERMS = (
    "Intercept", "C(gender)[T.M]", "C(is_a_urm)[T.Y]", "C(first_gen_status)[T.Y]",
    "C(ethnicity)[T.Black]", "C(ethnicity)[T.Hispanic]", "C(ethnicity)[T.International]",
    "C(ethnicity)[T.Multiple Races]", "C(ethnicity)[T.Native/Pacific]", "C(ethnicity)[T.Unknown]", "C(ethnicity)[T.White]",
)


def _product(a: str, b: str) -> str:
    """The product of two matrices (lists of rows)."""
    return f"""list_transform({a}, lambda row: list_transform(range(1, len({b}[1]) + 1), lambda col:
  list_sum(list_transform(row, lambda c, l: c * {b}[l][col]))))"""


def _eliminate(start: str, name: str, k: str) -> str:
    """Gauss-Jordan steps over (matrix | identity); ``ok``: the pivots used."""
    return f"""
{start}
UNION ALL
SELECT {k}, p, step + 1, list_append(ok, m[step][step] > 1e-7), CASE WHEN m[step][step] > 1e-7 THEN
  list_transform(m, lambda r, i: CASE WHEN i = step THEN list_transform(m[step], lambda c: c / m[step][step])
    ELSE list_transform(r, lambda c, j: c - r[step] * m[step][j] / m[step][step]) END) ELSE m END
FROM {name} WHERE step <= p
"""


def register(x: str, sfs: str, keys: tuple[str, ...]) -> None:
    """CTEs ``{x}_terms``, ``{x}_cov`` and ``{x}_stats`` of the models that
    ``keys`` tell apart; ``sfs``: the sufficient statistics."""
    k = ", ".join(keys)
    using = f"USING ({k})"

    def of(alias: str) -> str:
        return ", ".join(f"{alias}.{c}" for c in keys)

    cte(f"{x}_sfs", f"SELECT row_number() OVER () AS rid, * FROM ({sfs}) s")
    arms = " UNION ".join(f"SELECT {k}, {i} AS pos, '{f}' AS factor, {f} AS level FROM {x}_sfs" for i, f in enumerate(FACTORS))
    cte(f"{x}_lv", f"""
SELECT *, CASE WHEN no > 0 THEN row_number() OVER (PARTITION BY {k}, no > 0 ORDER BY pos, no) ELSE 0 END AS t
FROM (SELECT *, row_number() OVER (PARTITION BY {k}, factor ORDER BY level) - 1 AS no FROM ({arms}) a) b
""")
    cte(f"{x}_names", f"""
SELECT {k}, t, 'C(' || factor || ')[T.' || level || ']' AS term FROM {x}_lv WHERE t > 0
UNION ALL SELECT DISTINCT {k}, 0, 'Intercept' FROM {x}_lv
""")
    joined = " ".join(f"JOIN {x}_lv l{i} ON l{i}.factor = '{f}' AND l{i}.level = s.{f} AND ({of(f'l{i}')}) = ({of('s')})" for i, f in enumerate(FACTORS))
    marks = ", ".join(f"l{i}.t" for i in range(len(FACTORS)))
    cte(f"{x}_act", f"SELECT s.*, list_distinct([0, {marks}]) AS a FROM {x}_sfs s {joined}")
    cte(f"{x}_on", f"SELECT rid, {k}, course_id, n, sy, syy, unnest(a) AS t FROM {x}_act")
    cte(f"{x}_xtx", f"SELECT {of('u')}, u.t AS i, v.t AS j, sum(u.n)::DOUBLE AS w FROM {x}_on u JOIN {x}_on v ON u.rid = v.rid GROUP BY ALL")
    cte(f"{x}_p", f"SELECT {k}, max(t) + 1 AS p FROM {x}_names GROUP BY {k}")
    cte(f"{x}_rows", f"""
SELECT {of('g')}, g.p, g.i, list(CASE WHEN g.j < g.p THEN coalesce(w.w, 0.0) WHEN g.j - g.p = g.i THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY g.j) AS r
FROM (SELECT *, unnest(range(2 * p)) AS j FROM (SELECT *, unnest(range(p)) AS i FROM {x}_p) q) g
LEFT JOIN {x}_xtx w ON ({of('w')}) = ({of('g')}) AND w.i = g.i AND w.j = g.j
GROUP BY {of('g')}, g.p, g.i
""")
    # Elimination that leaves out dependent columns: X'X = R' A R with R the
    # reduced rows and A the part of the independent columns, so its
    # pseudo-inverse is R' (R R')^-1 A^-1 (R R')^-1 R.
    cte(f"{x}_gj", _eliminate(f"SELECT {k}, p, 1 AS step, []::BOOLEAN[] AS ok, list(r ORDER BY i) AS m FROM {x}_rows GROUP BY {k}, p", f"{x}_gj", k))
    cte(f"{x}_red", f"""
SELECT {k}, p, list_transform(m, lambda r, i: list_transform(r[1:p], lambda c: CASE WHEN ok[i] THEN c ELSE 0 END)) AS rr,
  list_transform(m, lambda r, i: list_transform(r[p + 1:], lambda c, j: CASE WHEN ok[i] AND ok[j] THEN c ELSE 0 END)) AS aa, ok
FROM {x}_gj WHERE step = p + 1
""")
    cte(f"{x}_gj2", _eliminate(f"""
SELECT {k}, p, 1 AS step, []::BOOLEAN[] AS ok, list_transform(rr, lambda r, i: list_concat(
  list_transform(rr, lambda q, j: CASE WHEN i = j AND NOT ok[i] THEN 1.0 ELSE list_dot_product(r, q) END),
  list_transform(r, lambda c, j: CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE))) AS m FROM {x}_red""", f"{x}_gj2", k))
    cte(f"{x}_side", f"""
SELECT {of('d')}, d.p, aa, {_product("list_transform(m, lambda r: r[d.p + 1:])", "rr")} AS hr
FROM {x}_red d JOIN {x}_gj2 g ON ({of('g')}) = ({of('d')}) AND g.step = d.p + 1
""")
    cte(f"{x}_pinv", f"""
SELECT {k}, p, {_product("list_transform(range(1, p + 1), lambda i: list_transform(hr, lambda r: r[i]))", "ahr")} AS m
FROM (SELECT *, {_product("aa", "hr")} AS ahr FROM {x}_side) s
""")
    cte(f"{x}_inv", f"""
SELECT {k}, i, j, m[i + 1][j + 1] AS v
FROM (SELECT *, unnest(range(p)) AS j FROM (SELECT *, unnest(range(p)) AS i FROM {x}_pinv) q) g
""")
    cte(f"{x}_beta", f"""
SELECT {of('b')}, b.i AS t, sum(b.v * y.s) AS coef
FROM {x}_inv b JOIN (SELECT {k}, t, sum(sy) AS s FROM {x}_on GROUP BY {k}, t) y ON ({of('y')}) = ({of('b')}) AND y.t = b.j GROUP BY ALL
""")
    cte(f"{x}_fit", f"SELECT {of('o')}, o.rid, o.course_id, o.n, o.sy, o.syy, sum(b.coef) AS f FROM {x}_on o JOIN {x}_beta b USING ({k}, t) GROUP BY ALL")
    cte(f"{x}_score", f"SELECT {of('o')}, o.course_id, o.t, sum(f.sy - f.n * f.f) AS s FROM {x}_on o JOIN {x}_fit f ON f.rid = o.rid GROUP BY ALL")
    cte(f"{x}_meat", f"SELECT {of('u')}, u.t AS i, v.t AS j, sum(u.s * v.s) AS w FROM {x}_score u JOIN {x}_score v ON ({of('u')}) = ({of('v')}) AND u.course_id = v.course_id GROUP BY ALL")
    cte(f"{x}_size", f"""
SELECT {of('f')}, p, rk, sum(n)::DOUBLE AS nobs, count(DISTINCT course_id)::DOUBLE AS g, greatest(sum(syy) - 2 * sum(f * sy) + sum(n * f * f), 0) AS ssr,
       sum(syy) - sum(sy) * sum(sy) / sum(n) AS tss
FROM {x}_fit f JOIN (SELECT {k}, p, len(list_filter(ok, lambda b: b)) AS rk FROM {x}_red) d {using} GROUP BY {of('f')}, p, rk
""")
    cte(f"{x}_half", f"SELECT {of('b')}, b.i, m.j, sum(b.v * m.w) AS v FROM {x}_inv b JOIN {x}_meat m ON ({of('b')}) = ({of('m')}) AND m.i = b.j GROUP BY ALL")
    cte(f"{x}_vcov", f"""
SELECT {of('h')}, h.i, b.j, sum(h.v * b.v) * any_value(CASE WHEN z.g > 1 AND z.nobs > z.p THEN z.g / (z.g - 1) * (z.nobs - 1) / (z.nobs - z.p) END) AS v
FROM {x}_half h JOIN {x}_inv b ON ({of('b')}) = ({of('h')}) AND b.i = h.j JOIN {x}_size z ON ({of('z')}) = ({of('h')}) GROUP BY {of('h')}, h.i, b.j
""")
    cte(f"{x}_cov", f"""
SELECT {of('v')}, a.term AS term_i, b.term AS term_j, v.v AS value FROM {x}_vcov v
JOIN {x}_names a ON ({of('a')}) = ({of('v')}) AND a.t = v.i JOIN {x}_names b ON ({of('b')}) = ({of('v')}) AND b.t = v.j
""")
    # 2 (1 - Phi(|z|)) by the series of the error function (all terms positive)
    cte(f"{x}_terms", f"""
SELECT * EXCLUDE (h), CASE WHEN h IS NULL THEN NULL WHEN h > 5.6 THEN 0.0 WHEN h = 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * exp(-h * h) * list_sum(list_transform(range(150),
  lambda q: exp(q * ln(2 * h * h) + ln(h) - (q + 1) * ln(2) - lgamma(q + 1.5) + 0.5 * ln(pi())))) END AS p,
  coef - 1.959963984540054 * se AS ci_low, coef + 1.959963984540054 * se AS ci_high
FROM (SELECT *, coef / nullif(se, 0) AS z, abs(coef / nullif(se, 0)) / sqrt(2) AS h FROM (
  SELECT {of('b')}, CAST(b.t AS INTEGER) AS term_idx, n.term, b.coef, CASE WHEN v.v IS NOT NULL THEN sqrt(greatest(v.v, 0)) END AS se FROM {x}_beta b
  JOIN {x}_names n ON ({of('n')}) = ({of('b')}) AND n.t = b.t JOIN {x}_vcov v ON ({of('v')}) = ({of('b')}) AND v.i = b.t AND v.j = b.t) y) w
""")
    cte(f"{x}_stats", f"""
SELECT {k}, unnest(['nobs', 'n_clusters', 'rank', 'df_model', 'df_resid', 'rsquared', 'rsquared_adj', 'llf', 'aic', 'bic', 'ssr']) AS statistic,
  unnest([nobs, g, rk, rk - 1, nobs - rk, r2, 1 - (nobs - 1) / (nobs - rk) * (1 - r2), llf, 2 * rk - 2 * llf, ln(nobs) * rk - 2 * llf, ssr]) AS value
FROM (SELECT *, 1 - ssr / tss AS r2, -nobs / 2 * (ln(2 * pi()) + ln(ssr / nobs) + 1) AS llf FROM {x}_size) s
""")


def wide(x: str, value: str) -> str:
    picks = ", ".join(f"""max({value}) FILTER (WHERE term = '{t}') AS "{t}\"""" for t in TERMS)
    return f"""
SELECT CAST(a_n AS INTEGER) AS a_n, CAST(s_n AS INTEGER) AS s_n, CAST(a_thres AS DOUBLE) AS a_thres, CAST(s_thres AS DOUBLE) AS s_thres, {picks}
FROM {x}_terms GROUP BY a_n, s_n, a_thres, s_thres
"""
