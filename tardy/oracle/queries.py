"""Oracle SQL per registered query (DuckDB dialect over the driver tables)."""

from __future__ import annotations

import numpy as np

from .ctes import submissions_sql, with_ctes

DIGITS = 8
SQL: dict[str, str] = {}

SUB_DOUBLES = ("score", "published_score", "points_possible", "current_score", "final_score")
ANALYSIS_DOUBLES = ("final_score",)
CLEAN_DOUBLES = ("final_score", "course_mean")
RANK_DOUBLES = CLEAN_DOUBLES + ("assignment_ranks", "assignment_percentile_ranks")
SCORE_DOUBLES = (
    "mean_rank", "procrastination_mean_rank", "procrastination_median_rank",
    "procrastination_var_rank", "procrastination_std_rank",
)
STUDENT_DOUBLES = CLEAN_DOUBLES + SCORE_DOUBLES + ("final_score_ranks", "final_score_percentile_ranks")


def sql(name: str, body: str, doubles: tuple[str, ...] = ()) -> None:
    if doubles:
        rep = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in doubles)
        body = f"SELECT * REPLACE ({rep}) FROM (\n{body.strip()}\n) q"
    SQL[name] = with_ctes(body)


# ---- warehouse ---------------------------------------------------------------
sql("valid_enrollment", "SELECT * FROM w_valid_enrollment")
sql("stu_demographics", "SELECT * FROM w_vsd")
sql("course_enrollments", "SELECT * FROM w_course_enrollments")
sql("course_assignments", "SELECT * FROM w_course_assignments")
sql("course_submissions", "SELECT * FROM w_course_submissions")
sql("course_meta", "SELECT * FROM w_course_meta")
sql("eligible_courses", "SELECT * FROM w_eligible")
sql("top_courses", "SELECT * FROM w_course_enrollments ORDER BY enrollments DESC, course_canvas_id ASC")
sql("submissions", "SELECT * FROM w_submissions", SUB_DOUBLES)
sql("submissions_due_range", "SELECT * FROM w_submissions WHERE due_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30 23:59:59'", SUB_DOUBLES)
sql("submissions_sis_only", submissions_sql(sis_only=True), SUB_DOUBLES)
sql("submissions_quiz_only", submissions_sql(quiz_only=True), SUB_DOUBLES)
sql("sql_query", """
SELECT cd.id AS course_canvas_id, count(DISTINCT ad.id) AS assignments
FROM assignment_dim ad LEFT JOIN course_dim cd ON cd.id = ad.course_id
WHERE ad.submission_types != 'none' AND ad.grading_type != 'not_graded' AND ad.workflow_state = 'published'
GROUP BY cd.id
""")

# ---- cleaning ------------------------------------------------------------------
sql("ethnicity_remap", "SELECT * FROM c_analysis", ANALYSIS_DOUBLES)
sql("course_stats", """
SELECT course_id, count(DISTINCT user_id) AS course_size, avg(final_score) AS course_mean
FROM c_analysis WHERE course_id IS NOT NULL GROUP BY course_id
""", ("course_mean",))
sql("course_filter", "SELECT * FROM c_s1", CLEAN_DOUBLES)
sql("assignment_filter", "SELECT * FROM c_s2", CLEAN_DOUBLES)
sql("course_assignment_counts", """
SELECT course_id, count(DISTINCT assignment_id) AS n_assignments FROM c_s2 GROUP BY course_id
""")
sql("student_filter", "SELECT * FROM c_s3", CLEAN_DOUBLES)
sql("course_student_counts", """
SELECT course_id, count(DISTINCT user_id) AS n_students FROM c_s3 GROUP BY course_id
""")
sql("clean_submissions", "SELECT * FROM c_s4", CLEAN_DOUBLES)
sql("filter_audit", """
SELECT *, lag(student_course_obs) OVER (ORDER BY stage_no) - student_course_obs AS excluded_student_course,
       lag(course_obs) OVER (ORDER BY stage_no) - course_obs AS excluded_courses
FROM (
SELECT 0 AS stage_no, 'loaded' AS stage, count(*) AS rows,
       count(DISTINCT (course_id, user_id)) FILTER (WHERE course_id IS NOT NULL AND user_id IS NOT NULL) AS student_course_obs,
       count(DISTINCT course_id) AS course_obs FROM c_analysis
UNION ALL
SELECT 1, 'course_filter', count(*), count(DISTINCT (course_id, user_id)) FILTER (WHERE course_id IS NOT NULL AND user_id IS NOT NULL),
       count(DISTINCT course_id) FROM c_s1
UNION ALL
SELECT 2, 'assignment_filter', count(*), count(DISTINCT (course_id, user_id)) FILTER (WHERE course_id IS NOT NULL AND user_id IS NOT NULL),
       count(DISTINCT course_id) FROM c_s2
UNION ALL
SELECT 3, 'student_filter', count(*), count(DISTINCT (course_id, user_id)) FILTER (WHERE course_id IS NOT NULL AND user_id IS NOT NULL),
       count(DISTINCT course_id) FROM c_s3
UNION ALL
SELECT 4, 'invariants', count(*), count(DISTINCT (course_id, user_id)) FILTER (WHERE course_id IS NOT NULL AND user_id IS NOT NULL),
       count(DISTINCT course_id) FROM c_s4
) a
""")

# ---- ranks and scores ------------------------------------------------------------
sql("assignment_ranks", "SELECT * FROM c_ranked", RANK_DOUBLES)
sql("procrastination_scores", "SELECT * FROM c_scores", SCORE_DOUBLES)
sql("ranks_submission_level", """
SELECT r.*, s.mean_rank, s.procrastination_mean_rank, s.procrastination_median_rank,
       s.procrastination_var_rank, s.procrastination_std_rank
FROM c_ranked r LEFT JOIN c_scores s ON r.user_id = s.user_id AND r.course_id = s.course_id
""", RANK_DOUBLES + SCORE_DOUBLES)
sql("student_course_lvl", "SELECT * FROM c_student", STUDENT_DOUBLES)
sql("final_score_ranks", """
SELECT user_id, course_id, final_score, final_score_ranks, final_score_percentile_ranks FROM c_student
""", ("final_score", "final_score_ranks", "final_score_percentile_ranks"))
sql("student_course_dropna", """
SELECT * FROM c_student
WHERE course_id IS NOT NULL AND course_name IS NOT NULL AND user_id IS NOT NULL AND final_score IS NOT NULL
  AND ethnicity IS NOT NULL AND gender IS NOT NULL AND is_a_urm IS NOT NULL AND first_gen_status IS NOT NULL
  AND course_size IS NOT NULL AND course_mean IS NOT NULL AND n_assignments IS NOT NULL
  AND n_assignments_updated IS NOT NULL AND n_students_updated IS NOT NULL AND mean_rank IS NOT NULL
  AND procrastination_mean_rank IS NOT NULL AND procrastination_median_rank IS NOT NULL
  AND procrastination_var_rank IS NOT NULL AND procrastination_std_rank IS NOT NULL
  AND final_score_ranks IS NOT NULL AND final_score_percentile_ranks IS NOT NULL
""", STUDENT_DOUBLES)

# ---- exploratory statistics -----------------------------------------------------
MAIN_ETH = "('White', 'Asian', 'Black', 'Hispanic')"
Y = "procrastination_mean_rank"
GSTAT = ("center", "mean", "std", "se")

cte_grade = """
SELECT course_id, avg(final_score_percentile_ranks) AS fs_pct_mean,
       median(final_score_percentile_ranks) AS fs_pct_median,
       stddev_samp(final_score_percentile_ranks) AS fs_pct_std
FROM c_student GROUP BY course_id
"""
sql("course_grade_stats", cte_grade, ("fs_pct_mean", "fs_pct_median", "fs_pct_std"))


def _group_sql(dim: str, where: str = "") -> str:
    return f"""
SELECT '{dim}' AS dimension, CAST({dim} AS VARCHAR) AS level, count(*) AS n, median({Y}) AS center,
       avg({Y}) AS mean, stddev_samp({Y}) AS std, stddev_samp({Y}) / sqrt(count(*)) AS se
FROM c_student WHERE {dim} IS NOT NULL {where} GROUP BY {dim}
"""


sql("group_se_gender", _group_sql("gender"), GSTAT)
sql("group_se_first_gen", _group_sql("first_gen_status"), GSTAT)
sql("group_se_ethnicity", _group_sql("ethnicity"), GSTAT)
sql("se_plot_data", _group_sql("gender") + " UNION ALL " + _group_sql("first_gen_status")
    + " UNION ALL " + _group_sql("ethnicity", f"AND ethnicity IN {MAIN_ETH}"), GSTAT)
sql("main_ethnicity_filter", f"""
SELECT count(*) AS rows_total, count(*) FILTER (WHERE ethnicity IN {MAIN_ETH}) AS rows_kept,
       count(*) FILTER (WHERE ethnicity IS NULL OR ethnicity NOT IN {MAIN_ETH}) AS rows_removed
FROM c_student
""")
user_mean_sql = """
SELECT user_id, avg(assignment_percentile_ranks) AS mean_pct_rank FROM c_ranked
WHERE user_id IS NOT NULL GROUP BY user_id
"""
sql("user_mean_rank", user_mean_sql, ("mean_pct_rank",))
# The seeded draw out of n users, for n = 1, 2, ... (more users than that are
# drawn by the Spark query alone).
PLACES = [int(np.random.RandomState(1).permutation(n)[0]) for n in range(1, 1025)]
bands_sql = f"""
SELECT band, n_users, user_id, mean_pct_rank
FROM (SELECT *, count(*) OVER (PARTITION BY band) AS n_users,
             row_number() OVER (PARTITION BY band ORDER BY user_id) - 1 AS place
      FROM (SELECT *, CASE WHEN mean_pct_rank < 0.25 THEN 'low'
                           WHEN mean_pct_rank > 0.4 AND mean_pct_rank < 0.6 THEN 'mid'
                           WHEN mean_pct_rank > 0.75 THEN 'high' END AS band
            FROM ({user_mean_sql}) u) b
      WHERE band IS NOT NULL) d
WHERE place = ({PLACES}::BIGINT[])[n_users]
"""
sql("student_bands", bands_sql, ("mean_pct_rank",))
sql("student_time_series", f"""
SELECT band, user_id, seq, 'A' || CAST(seq AS VARCHAR) AS label, due_date, submitted_at, assignment_id,
       course_id, assignment_percentile_ranks
FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY band, user_id ORDER BY due_date NULLS LAST) - 1 AS INTEGER) AS seq
  FROM (
    SELECT * FROM (
      SELECT p.band, r.user_id, r.due_date, r.submitted_at, r.assignment_id, r.assignment_percentile_ranks,
             r.course_id,
             row_number() OVER (PARTITION BY p.band, r.user_id, r.due_date
                                ORDER BY r.submitted_at NULLS FIRST, r.assignment_id NULLS FIRST,
                                         r.assignment_percentile_ranks NULLS FIRST, r.course_id NULLS FIRST) AS rn
      FROM c_ranked r JOIN (SELECT band, user_id FROM ({bands_sql}) bb) p ON r.user_id = p.user_id) x
    WHERE rn = 1) f) s
""", ("assignment_percentile_ranks",))
sql("course_counts_check", """
SELECT count(*) AS n_courses, count(*) FILTER (WHERE n_students < 20) AS n_under_20_students,
       count(*) FILTER (WHERE n_assignments < 5) AS n_under_5_assignments
FROM (SELECT course_id, count(DISTINCT assignment_id) AS n_assignments, count(DISTINCT user_id) AS n_students
      FROM c_s4 WHERE course_id IS NOT NULL GROUP BY course_id) c
""")

SCORED = """(SELECT r.*, s.procrastination_mean_rank FROM c_ranked r
  LEFT JOIN c_scores s ON r.user_id = s.user_id AND r.course_id = s.course_id)"""


def _kde_sql(keys: list[str], rows_sql: str) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"r.{c} = g.{c}" for c in keys)
    gk = ", ".join(f"g.{c}" for c in keys)
    return f"""
SELECT {gk}, g.grid_i, g.x,
       sum(exp(-0.5 * pow((g.x - r.v) / g.bw, 2))) / (g.n * g.bw * sqrt(2 * pi())) AS density
FROM (
  SELECT st.*, CAST(i AS INTEGER) AS grid_i,
         CASE WHEN i = 199 THEN hi ELSE i * ((hi - lo) / 199.0) + lo END AS x
  FROM (
    SELECT *, greatest(mn - bw * 3.0, 0.0) AS lo, least(mx + bw * 3.0, 1.0) AS hi
    FROM (SELECT {k}, count(v) AS n, stddev_samp(v) AS sd, min(v) AS mn, max(v) AS mx,
                 stddev_samp(v) * pow(CAST(count(v) AS DOUBLE), -0.2) AS bw
          FROM ({rows_sql}) rr WHERE v IS NOT NULL GROUP BY {k}
          HAVING count(v) >= 2 AND stddev_samp(v) > 0) s0) st, range(200) t(i)) g
JOIN ({rows_sql}) r ON {on}
WHERE r.v IS NOT NULL
GROUP BY {gk}, g.grid_i, g.x, g.n, g.bw
"""


def _kde_dim(dim: str, levels: str) -> str:
    rows = f"SELECT {dim} AS level, {Y} AS v FROM {SCORED} sc WHERE {dim} IN {levels}"
    return f"SELECT '{dim}' AS dimension, * FROM ({_kde_sql(['level'], rows)}) kk"


sql("kde_by_gender", _kde_dim("gender", "('M', 'F')"), ("x", "density"))
sql("kde_by_first_gen", _kde_dim("first_gen_status", "('Y', 'N')"), ("x", "density"))
sql("kde_by_ethnicity", _kde_dim("ethnicity", MAIN_ETH), ("x", "density"))
_matrix_rows = f"""
SELECT course_id, course_name, 'gender' AS dimension, gender AS level, {Y} AS v FROM {SCORED} a WHERE gender IN ('M', 'F')
UNION ALL
SELECT course_id, course_name, 'first_gen_status', first_gen_status, {Y} FROM {SCORED} b WHERE first_gen_status IN ('Y', 'N')
UNION ALL
SELECT course_id, course_name, 'ethnicity', ethnicity, {Y} FROM {SCORED} c WHERE ethnicity IN {MAIN_ETH}
"""
sql("course_density_matrix", _kde_sql(["course_id", "course_name", "dimension", "level"], _matrix_rows), ("x", "density"))
sql("course_grade_box", f"""
WITH g AS ({cte_grade}),
long AS (SELECT * FROM (SELECT 'mean' AS stat, fs_pct_mean AS v FROM g UNION ALL
                        SELECT 'median', fs_pct_median FROM g UNION ALL
                        SELECT 'std', fs_pct_std FROM g) u WHERE v IS NOT NULL),
q AS (SELECT stat, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM long GROUP BY stat)
SELECT l.stat, q.q1, q.median, q.q3, count(*) AS n,
       min(v) FILTER (WHERE v >= q.q1 - (q.q3 - q.q1) * 1.5) AS whisker_low,
       max(v) FILTER (WHERE v <= q.q3 + (q.q3 - q.q1) * 1.5) AS whisker_high,
       count(*) FILTER (WHERE v < q.q1 - (q.q3 - q.q1) * 1.5 OR v > q.q3 + (q.q3 - q.q1) * 1.5) AS n_outliers
FROM long l JOIN q ON l.stat = q.stat GROUP BY l.stat, q.q1, q.median, q.q3
""", ("q1", "median", "q3", "whisker_low", "whisker_high"))
sql("course_grade_hist", f"""
WITH g AS (SELECT fs_pct_mean AS v FROM ({cte_grade}) gg WHERE fs_pct_mean IS NOT NULL),
s AS (SELECT count(v) AS n, min(v) AS mn, max(v) AS mx, quantile_cont(v, 0.25) AS q25,
             quantile_cont(v, 0.75) AS q75 FROM g),
w AS (SELECT *, (mx - mn) / (log2(CAST(n AS DOUBLE)) + 1.0) AS sturges,
             2.0 * (q75 - q25) * pow(CAST(n AS DOUBLE), -1.0 / 3.0) AS fd FROM s),
e AS (SELECT *, CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END AS wd,
             CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS f,
             CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS l FROM w),
nb AS (SELECT *, CAST(CASE WHEN wd > 0 THEN ceil((l - f) / wd) ELSE 1 END AS INTEGER) AS nbins FROM e),
st AS (SELECT *, (l - f) / nbins AS step FROM nb),
i0 AS (SELECT g.v, st.*, least(CAST(floor((g.v - st.f) * st.nbins / (st.l - st.f)) AS INTEGER), st.nbins - 1) AS i0
       FROM g, st),
ix AS (SELECT *, CASE WHEN v < (CASE WHEN i0 = nbins THEN l ELSE i0 * step + f END) THEN i0 - 1
                      WHEN v >= (CASE WHEN i0 + 1 = nbins THEN l ELSE (i0 + 1) * step + f END) AND i0 != nbins - 1
                        THEN i0 + 1
                      ELSE i0 END AS bin FROM i0),
cnt AS (SELECT bin, count(*) AS c FROM ix GROUP BY bin),
bins AS (SELECT CAST(b AS INTEGER) AS bin, st.* FROM st, range(st.nbins) t(b))
SELECT bins.bin,
       CASE WHEN bins.bin = nbins THEN l ELSE bins.bin * step + f END AS bin_lo,
       CASE WHEN bins.bin + 1 = nbins THEN l ELSE (bins.bin + 1) * step + f END AS bin_hi,
       coalesce(cnt.c, 0) AS count
FROM bins LEFT JOIN cnt ON bins.bin = cnt.bin
""", ("bin_lo", "bin_hi"))

# ---- regression ---------------------------------------------------------------------
SUFFSTATS = f"""
SELECT course_id, CAST(gender AS VARCHAR) AS gender, CAST(is_a_urm AS VARCHAR) AS is_a_urm,
       CAST(first_gen_status AS VARCHAR) AS first_gen_status, CAST(ethnicity AS VARCHAR) AS ethnicity,
       count(*) AS n, sum({Y}) AS sy, sum({Y} * {Y}) AS syy
FROM c_student
WHERE {Y} IS NOT NULL AND course_id IS NOT NULL AND gender IS NOT NULL AND is_a_urm IS NOT NULL
  AND first_gen_status IS NOT NULL AND ethnicity IS NOT NULL
GROUP BY ALL
"""
sql("ols_suffstats", SUFFSTATS, ("sy", "syy"))
_levels = f"""
SELECT factor_pos, factor, level FROM (
  SELECT DISTINCT 0 AS factor_pos, 'gender' AS factor, CAST(gender AS VARCHAR) AS level FROM c_student s WHERE {{c}}
  UNION ALL SELECT DISTINCT 1, 'is_a_urm', CAST(is_a_urm AS VARCHAR) FROM c_student s WHERE {{c}}
  UNION ALL SELECT DISTINCT 2, 'first_gen_status', CAST(first_gen_status AS VARCHAR) FROM c_student s WHERE {{c}}
  UNION ALL SELECT DISTINCT 3, 'ethnicity', CAST(ethnicity AS VARCHAR) FROM c_student s WHERE {{c}}) u
""".replace("{c}", f"""{Y} IS NOT NULL AND course_id IS NOT NULL AND gender IS NOT NULL AND is_a_urm IS NOT NULL
  AND first_gen_status IS NOT NULL AND ethnicity IS NOT NULL""")
sql("design_levels", f"""
SELECT factor, level, level_no, level_no = 0 AS is_reference,
       CASE WHEN level_no > 0 THEN 'C(' || factor || ')[T.' || level || ']' END AS term,
       CASE WHEN level_no > 0 THEN CAST(row_number() OVER (PARTITION BY level_no > 0 ORDER BY factor_pos, level_no) AS INTEGER) END AS term_idx
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY factor ORDER BY level) - 1 AS INTEGER) AS level_no FROM ({_levels}) l) x
""")

# the grid: 3 x 3 threshold pairs share one plan; (a_n, s_n) act on course counts
from .ctes import cte  # noqa: E402

cte("g_ga", "SELECT * FROM (VALUES (0.25), (0.5), (0.75)) t(a_thres)")
cte("g_gs", "SELECT * FROM (VALUES (0.25), (0.5), (0.75)) t(s_thres)")
cte("g_gn", "SELECT * FROM (VALUES (5), (15), (25)) t(a_n)")
cte("g_gsn", "SELECT * FROM (VALUES (10), (20), (30), (40)) t(s_n)")
cte("g_ratio", """SELECT assignment_id, count(DISTINCT user_id) / min(course_size) AS r FROM c_s1
          WHERE assignment_id IS NOT NULL GROUP BY assignment_id""")
cte("g_s2", """SELECT ga.a_thres, s.* FROM c_s1 s JOIN g_ratio ratio ON s.assignment_id = ratio.assignment_id
       JOIN g_ga ga ON ratio.r > ga.a_thres""")
cte("g_nas", "SELECT a_thres, course_id, count(DISTINCT assignment_id) AS n_assignments FROM g_s2 GROUP BY a_thres, course_id")
cte("g_uc", """SELECT s2.a_thres, s2.user_id, s2.course_id, count(DISTINCT s2.assignment_id) AS na, max(nas.n_assignments) AS nc
       FROM g_s2 s2 JOIN g_nas nas ON s2.a_thres = nas.a_thres AND s2.course_id = nas.course_id
       WHERE s2.user_id IS NOT NULL GROUP BY s2.a_thres, s2.user_id, s2.course_id""")
cte("g_keep3", "SELECT uc.a_thres, gs.s_thres, uc.user_id, uc.course_id FROM g_uc uc JOIN g_gs gs ON uc.na > floor(uc.nc * gs.s_thres)")
cte("g_s3", """SELECT k.s_thres, s2.*, nas.n_assignments FROM g_s2 s2 JOIN g_keep3 k ON s2.a_thres = k.a_thres AND s2.user_id = k.user_id
       AND s2.course_id = k.course_id JOIN g_nas nas ON s2.a_thres = nas.a_thres AND s2.course_id = nas.course_id""")
cte("g_cc", """SELECT a_thres, s_thres, course_id, count(DISTINCT assignment_id) AS nau, count(DISTINCT user_id) AS nsu,
              count(*) AS n_rows FROM g_s3 GROUP BY a_thres, s_thres, course_id""")
cte("g_surv", "SELECT gn.a_n, gsn.s_n, cc.* FROM g_cc cc JOIN g_gn gn ON cc.nau > gn.a_n JOIN g_gsn gsn ON cc.nsu > gsn.s_n")
sql("grid_survivors", """
SELECT CAST(gn.a_n AS INTEGER) AS a_n, CAST(gsn.s_n AS INTEGER) AS s_n, CAST(ga.a_thres AS DOUBLE) AS a_thres,
       CAST(gs.s_thres AS DOUBLE) AS s_thres,
       (SELECT count(*) FROM c_s1) AS rows_course_filter,
       coalesce((SELECT count(*) FROM g_s2 s2 WHERE s2.a_thres = ga.a_thres), 0) AS rows_assignment_filter,
       coalesce((SELECT count(*) FROM g_s3 s3 WHERE s3.a_thres = ga.a_thres AND s3.s_thres = gs.s_thres), 0) AS rows_student_filter,
       coalesce((SELECT sum(n_rows) FROM g_surv v WHERE v.a_n = gn.a_n AND v.s_n = gsn.s_n AND v.a_thres = ga.a_thres
                 AND v.s_thres = gs.s_thres), 0)::BIGINT AS rows_final,
       coalesce((SELECT count(*) FROM g_surv v WHERE v.a_n = gn.a_n AND v.s_n = gsn.s_n AND v.a_thres = ga.a_thres
                 AND v.s_thres = gs.s_thres), 0)::BIGINT AS n_courses,
       coalesce((SELECT sum(nsu) FROM g_surv v WHERE v.a_n = gn.a_n AND v.s_n = gsn.s_n AND v.a_thres = ga.a_thres
                 AND v.s_thres = gs.s_thres), 0)::BIGINT AS n_student_courses
FROM g_gn gn, g_gsn gsn, g_ga ga, g_gs gs
""")
cte("g_rk", """SELECT *, (rank() OVER (PARTITION BY a_thres, s_thres, assignment_id ORDER BY submitted_at NULLS LAST)
                  + (count(*) OVER (PARTITION BY a_thres, s_thres, assignment_id, submitted_at) - 1) / 2.0::DOUBLE)
                 / count(submitted_at) OVER (PARTITION BY a_thres, s_thres, assignment_id) AS pct
       FROM g_s3""")
cte("g_yy", """SELECT a_thres, s_thres, user_id, course_id, avg(CASE WHEN submitted_at IS NOT NULL THEN pct END) AS y
       FROM g_rk WHERE user_id IS NOT NULL GROUP BY ALL""")
cte("g_fr", """SELECT a_thres, s_thres, user_id, course_id, gender, is_a_urm, first_gen_status, ethnicity FROM (
         SELECT *, row_number() OVER (PARTITION BY a_thres, s_thres, user_id, course_id
           ORDER BY due_date IS NULL, due_date NULLS FIRST, submitted_at NULLS FIRST, assignment_id NULLS FIRST,
             course_name NULLS FIRST, final_score NULLS FIRST, ethnicity NULLS FIRST, gender NULLS FIRST,
             is_a_urm NULLS FIRST, first_gen_status NULLS FIRST, course_size NULLS FIRST, course_mean NULLS FIRST,
             n_assignments NULLS FIRST) AS rn FROM g_rk) q WHERE rn = 1""")
cte("g_sfs", """SELECT yy.a_thres, yy.s_thres, yy.course_id, CAST(fr.gender AS VARCHAR) AS gender,
               CAST(fr.is_a_urm AS VARCHAR) AS is_a_urm, CAST(fr.first_gen_status AS VARCHAR) AS first_gen_status,
               CAST(fr.ethnicity AS VARCHAR) AS ethnicity, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy
        FROM g_yy yy JOIN g_fr fr ON yy.a_thres = fr.a_thres AND yy.s_thres = fr.s_thres AND yy.user_id = fr.user_id
          AND yy.course_id = fr.course_id
        WHERE y IS NOT NULL AND fr.gender IS NOT NULL AND fr.is_a_urm IS NOT NULL AND fr.first_gen_status IS NOT NULL
          AND fr.ethnicity IS NOT NULL
        GROUP BY yy.a_thres, yy.s_thres, yy.course_id, fr.gender, fr.is_a_urm, fr.first_gen_status, fr.ethnicity""")
sql("grid_suffstats", """
SELECT CAST(v.a_n AS INTEGER) AS a_n, CAST(v.s_n AS INTEGER) AS s_n, CAST(v.a_thres AS DOUBLE) AS a_thres,
       CAST(v.s_thres AS DOUBLE) AS s_thres, sfs.course_id, sfs.gender, sfs.is_a_urm, sfs.first_gen_status,
       sfs.ethnicity, sfs.n, round(sfs.sy, 8) AS sy, round(sfs.syy, 8) AS syy
FROM g_sfs sfs JOIN g_surv v ON sfs.a_thres = v.a_thres AND sfs.s_thres = v.s_thres AND sfs.course_id = v.course_id
""")

# regressions: solved in DuckDB too
from . import regression as R  # noqa: E402

TERM_DOUBLES = ("coef", "se", "z", "p", "ci_low", "ci_high")
R.register("lr", "SELECT 0 AS mk, * FROM (" + SUFFSTATS + ") s0", ("mk",))
sql("ols_coeffs", "SELECT * EXCLUDE (mk) FROM lr_terms", TERM_DOUBLES)
sql("ols_cluster_cov", "SELECT * EXCLUDE (mk) FROM lr_cov", ("value",))
sql("ols_pvalues", "SELECT term, round(p, 4) AS p FROM lr_terms")
sql("ols_confint", "SELECT term, ci_low, ci_high FROM lr_terms", ("ci_low", "ci_high"))
sql("ols_fit_stats", "SELECT * EXCLUDE (mk) FROM lr_stats", ("value",))
R.register("gr", "SELECT v.a_n, v.s_n, g.* FROM g_sfs g JOIN g_surv v USING (a_thres, s_thres, course_id)", ("a_n", "s_n", "a_thres", "s_thres"))
sql("grid_coeffs", """
SELECT CAST(a_n AS INTEGER) AS a_n, CAST(s_n AS INTEGER) AS s_n, CAST(a_thres AS DOUBLE) AS a_thres, CAST(s_thres AS DOUBLE) AS s_thres,
  * EXCLUDE (a_n, s_n, a_thres, s_thres) FROM gr_terms
""", TERM_DOUBLES)
WIDE = tuple(f'"{t}"' for t in R.TERMS)
sql("grid_coeffs_wide", R.wide("gr", "coef"), WIDE)
sql("grid_pvalues", R.wide("gr", "round(p, 4)"), WIDE)
sql("grid_confint", R.wide("gr", "ci_low"), WIDE)

sql("csv_scan", """
SELECT course_id, course_name, assignment_id, due_date, submitted_at, user_id, gender, ethnicity, is_a_urm,
       first_gen_status, final_score FROM w_submissions
""", ("final_score",))

sql("course_stats_join", "SELECT * FROM c_s0", CLEAN_DOUBLES)
sql("course_invariants", """
SELECT course_id, count(DISTINCT assignment_id) AS n_assignments_updated, count(DISTINCT user_id) AS n_students_updated,
       count(DISTINCT user_id) > 20 AND count(DISTINCT assignment_id) > 5 AS kept
FROM c_s3 WHERE course_id IS NOT NULL GROUP BY course_id
""")
sql("datetime_parse", "SELECT submission_id, submitted_at, due_date FROM w_submissions")

sql("submissions_by_due_date", "SELECT * FROM w_submissions ORDER BY due_date NULLS LAST, submission_id", SUB_DOUBLES)
sql("course_sizes", """
SELECT course_id, count(DISTINCT assignment_id) AS n_assignments, count(DISTINCT user_id) AS n_students
FROM c_s4 WHERE course_id IS NOT NULL GROUP BY course_id ORDER BY n_students, course_id
""")
sql("course_grade_box_outliers", f"""
WITH g AS ({cte_grade}),
long AS (SELECT course_id, unnest(['mean', 'median', 'std']) AS stat, unnest([fs_pct_mean, fs_pct_median, fs_pct_std]) AS value FROM g),
q AS (SELECT stat, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM long WHERE value IS NOT NULL GROUP BY stat)
SELECT course_id, stat, value, a - (b - a) * 1.5 AS lo_limit, b + (b - a) * 1.5 AS hi_limit FROM long JOIN q USING (stat)
WHERE value < a - (b - a) * 1.5 OR value > b + (b - a) * 1.5
""", ("value", "lo_limit", "hi_limit"))
sql("export_csv", "SELECT id, submitted_at + to_microseconds(id % 1000000) AS submitted_at FROM submission_dim")
SQL["clean_from_csv"] = SQL["ranks_submission_level"]
SQL["students_from_csv"] = SQL["student_course_lvl"]
