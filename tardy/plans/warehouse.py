"""Warehouse stage: course summary views and the submission-level table.

Join order is written so the big fact side (submissions) meets pre-joined
dimensions once per key: user dimensions (user -> pseudonym -> demographics)
are joined among themselves first, as are enrollments and course scores.
Broadcast is left to Spark/AQE, which checks the runtime size of each side
against ``spark.sql.autoBroadcastJoinThreshold``; a hot key on the fact side
is split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (
    ENROLLMENT_STATES,
    MIN_ASSIGNMENTS,
    MIN_ENROLLMENTS,
    MIN_SUBMISSIONS,
    STUDENT_ENROLLMENT_TYPE,
)
from ..operators.dedupe import first_per_key, with_codes
from ..operators.joinback import NARROW_ROWS, small_or_shuffled
from ..sources.fixtures import Warehouse
from ..sources.tables import materialize

COURSE_COLS = (
    "course_canvas_id", "course_name", "course_code", "strt_date",
    "root_account_id", "account_id", "workflow_state",
)

DEMOGRAPHICS = ("gender", "ethnicity", "is_a_urm", "first_gen_status")

SUBMISSION_COLS = (
    "submission_id", "course_id", "course_name", "title", "assignment_id", "due_date",
    "submitted_at", "sd_grade", "attempts", "submission_type", "user_id", "score",
    "published_score", "points_possible", "gender", "ethnicity", "is_a_urm",
    "first_gen_status", "current_score", "final_score", "id", "type", "workflow_state",
)


def valid_enrollment(wh: Warehouse) -> DataFrame:
    """One enrollment per (user, course); the lowest enrollment id wins.
    Dedupe happens before any type/state filter."""
    return first_per_key(
        wh.enrollment_dim.select("id", "user_id", "course_id", "type", "workflow_state"),
        keys=["user_id", "course_id"],
        order=["id", "type", "workflow_state"],
    )


def stu_demographics(wh: Warehouse) -> DataFrame:
    """One demographic row per anonymous net id (renamed columns); ties
    broken by the smallest (gender, ethnicity, urm, first_gen)."""
    renamed = wh.stu_enrollment.select(
        F.col("`anon-netid`").alias("anon_netid"),
        F.col("EFFDT_GENDER").alias("gender"),
        F.col("ST_ETHNIC_IPEDS").alias("ethnicity"),
        F.col("ST_URM_FLAG").alias("is_a_urm"),
        F.col("FIRST_GENERATION").alias("first_gen_status"),
    )
    return first_per_key(
        renamed, keys=["anon_netid"], order=["gender", "ethnicity", "is_a_urm", "first_gen_status"]
    )


def _course_cols(cd: str = "cd") -> list:
    return [
        F.col(f"{cd}.id").alias("course_canvas_id"),
        F.col(f"{cd}.name").alias("course_name"),
        F.col(f"{cd}.code").alias("course_code"),
        F.col(f"{cd}.start_at").alias("strt_date"),
        F.col(f"{cd}.root_account_id").alias("root_account_id"),
        F.col(f"{cd}.account_id").alias("account_id"),
        F.col(f"{cd}.workflow_state").alias("workflow_state"),
    ]


def _user_demographics(wh: Warehouse) -> DataFrame:
    """user_dim -> pseudonym -> demographics, keeping only users with a
    demographic row (every caller filters ``anon_netid IS NOT NULL``)."""
    ud = wh.user_dim.select(F.col("id").alias("u_id"))
    pd_ = wh.pseudonym_dim.select(F.col("user_id").alias("p_user_id"), "unique_name")
    vsd = stu_demographics(wh)
    return (
        ud.join(pd_, F.col("p_user_id") == F.col("u_id"))
        .join(vsd, F.col("anon_netid") == F.col("unique_name"))
        .select("u_id", "anon_netid", "gender", "ethnicity", "is_a_urm", "first_gen_status")
    )


def course_enrollments(wh: Warehouse) -> DataFrame:
    """Distinct students (by anonymous id) per course."""
    ed = valid_enrollment(wh).where(
        (F.col("type") == STUDENT_ENROLLMENT_TYPE) & F.col("workflow_state").isin(*ENROLLMENT_STATES)
    )
    j = (
        ed.alias("ed")
        .join(wh.course_dim.alias("cd"), F.col("cd.id") == F.col("ed.course_id"), "left")
        .join(_user_demographics(wh), F.col("u_id") == F.col("ed.user_id"))
    )
    return j.groupBy(*_course_cols()).agg(F.countDistinct("anon_netid").alias("enrollments"))


def course_assignments(wh: Warehouse) -> DataFrame:
    """Distinct graded, published assignments per course (three-valued
    ``!=``: null types are dropped as in SQL)."""
    ad = wh.assignment_dim.where(
        (F.col("submission_types") != "none")
        & (F.col("grading_type") != "not_graded")
        & (F.col("workflow_state") == "published")
    )
    j = ad.alias("ad").join(wh.course_dim.alias("cd"), F.col("cd.id") == F.col("ad.course_id"), "left")
    return j.groupBy(*_course_cols()).agg(F.countDistinct("ad.id").alias("assignments"))


def _valid_submissions(wh: Warehouse) -> DataFrame:
    return wh.submission_dim.where(
        F.col("grade_matches_current_submission")
        & F.col("submitted_at").isNotNull()
        & (F.col("workflow_state") != "unsubmitted")
        & F.col("submission_type").isNotNull()
    )


def course_submissions(wh: Warehouse) -> DataFrame:
    """Distinct current submissions per course; course and user come from
    the submission fact (unlike the submission table).

    The submissions are counted where the join on their id has put them: per known
    course (null: any other) and set of users, mostly of one. Only these counts
    are shuffled, to find the sets with a user that has a demographic row."""
    sd = _valid_submissions(wh).select(F.col("id").alias("sd_id"))
    sf = wh.submission_fact.select("submission_id", F.col("course_id").alias("sf_course_id"), F.col("user_id").alias("sf_user_id"))
    known = wh.course_dim.select(F.col("id").alias("k")).distinct()
    j = sd.join(sf, F.col("submission_id") == F.col("sd_id")).join(known, F.col("k") == F.col("sf_course_id"), "left")
    of_submission = j.groupBy("sd_id", "k").agg(F.array_sort(F.collect_set("sf_user_id")).alias("users"))
    of_users = of_submission.groupBy("k", "users").agg(F.count(F.lit(1)).alias("n"))
    single = of_users.select("k", "users", "n", F.explode("users").alias("user"))
    found = single.join(_user_demographics(wh).select("u_id"), F.col("u_id") == F.col("user"), "left_semi")
    counts = found.select("k", "users", "n").distinct().groupBy("k").agg(F.sum("n").alias("submissions"))
    courses = wh.course_dim.alias("cd").select(*_course_cols()).distinct()
    return counts.join(courses, F.col("course_canvas_id") == F.col("k"), "left").select(*courses.columns, "submissions")


def course_meta(wh: Warehouse) -> DataFrame:
    """Full outer join of the three course views on the course id."""
    ce = course_enrollments(wh).select(F.col("course_canvas_id").alias("k_e"), "enrollments")
    ca = course_assignments(wh).select(F.col("course_canvas_id").alias("k_a"), "assignments")
    cs = course_submissions(wh).select(F.col("course_canvas_id").alias("k_s"), "submissions")
    ea = ce.join(ca, F.col("k_e") == F.col("k_a"), "full").select(
        F.coalesce("k_e", "k_a").alias("k_ea"), "enrollments", "assignments"
    )
    return ea.join(cs, F.col("k_ea") == F.col("k_s"), "full").select(
        F.coalesce("k_ea", "k_s").alias("course_canvas_id"), "enrollments", "assignments", "submissions"
    )


def eligible_courses(wh: Warehouse) -> DataFrame:
    """Courses big enough for the study: every count above its limit."""
    m = course_meta(wh)
    least = {"enrollments": MIN_ENROLLMENTS, "submissions": MIN_SUBMISSIONS, "assignments": MIN_ASSIGNMENTS}
    for count, limit in least.items():  # a missing count is not above its limit
        m = m.where(F.col(count) > limit)
    return m.select("course_canvas_id")


def submissions(wh: Warehouse, sis_only: bool = False, quiz_only: bool = False) -> DataFrame:
    """The submission-level table: one distinct wide row per current
    submission of an eligible course by a student with demographics.

    Rows are made distinct before the joins, not after: each side keeps its key
    and only columns of the result, so that joins of distinct sides are distinct.
    The two large ones are made so under the partitioning by submission id
    that their join needs anyway; the 23-column rows are never shuffled for it.

    ``sis_only`` keeps courses with a SIS id, ``quiz_only`` keeps quiz
    submissions (both optional predicates of the study, off by default).
    """
    sd = _valid_submissions(wh)
    if quiz_only:
        sd = sd.where(F.col("submission_type") == "online_quiz")
    sd = sd.select(
        F.col("id").alias("submission_id"),
        F.col("assignment_id").alias("sd_assignment_id"),
        F.col("user_id").alias("sd_user_id"),
        "submitted_at",
        F.col("grade").alias("sd_grade"),
        F.col("attempt").alias("attempts"),
        "submission_type",
    ).repartition("submission_id").distinct()
    sf = wh.submission_fact.select(F.col("submission_id").alias("sf_id"), "score", "published_score").repartition("sf_id").distinct()
    # `ad.course_id IN (eligible)` turns the assignment join inner and keeps
    # only assignments of eligible courses (semi join on the small side).
    ad = wh.assignment_dim.join(
        eligible_courses(wh), F.col("course_id") == F.col("course_canvas_id"), "left_semi"
    ).select(
        F.col("id").alias("assignment_id"),
        F.col("course_id").alias("ad_course_id"),
        "title",
        F.col("due_at").alias("due_date"),
        "points_possible",
    ).distinct()
    cd = wh.course_dim.select(F.col("id").alias("course_id"), F.col("name").alias("course_name"), "sis_source_id")
    if sis_only:
        cd = cd.where(F.col("sis_source_id").isNotNull())
    cd = cd.drop("sis_source_id").distinct()
    ve = valid_enrollment(wh).select(
        F.col("id"), F.col("user_id").alias("ve_user_id"), F.col("course_id").alias("ve_course_id"), "type", "workflow_state"
    )
    csf = wh.course_score_fact.select("enrollment_id", "current_score", "final_score")
    enr = ve.join(csf, F.col("enrollment_id") == F.col("id"), "left").drop("enrollment_id")
    enr = enr.repartition("ve_user_id", "ve_course_id").distinct()
    demographics = materialize(_user_demographics(wh).drop("anon_netid").distinct(), "demographics")
    # A user and the code of their demographics, which a small dictionary spells
    # out at the end: narrow enough to be broadcast far longer than the texts.
    coded = with_codes(demographics, DEMOGRAPHICS, "_demographics")
    users, spelled = coded if coded else (demographics, None)
    users = small_or_shuffled(materialize(users.select("u_id", "_demographics"), "coded_users"), NARROW_ROWS) if coded else users

    j = (
        sd.join(sf, F.col("sf_id") == F.col("submission_id"))
        .join(ad, F.col("assignment_id") == F.col("sd_assignment_id"))
        .join(users, F.col("u_id") == F.col("sd_user_id"))
        .join(cd, F.col("course_id") == F.col("ad_course_id"), "inner" if sis_only else "left")
        .join(
            enr,
            (F.col("ve_user_id") == F.col("sd_user_id")) & (F.col("ve_course_id") == F.col("course_id")),
            "left",
        )
    )
    if spelled is not None:
        j = j.join(F.broadcast(spelled), "_demographics")
    return j.select(
        "submission_id",
        "course_id",
        "course_name",
        "title",
        "assignment_id",
        "due_date",
        "submitted_at",
        "sd_grade",
        "attempts",
        "submission_type",
        F.col("u_id").alias("user_id"),
        "score",
        "published_score",
        "points_possible",
        "gender",
        "ethnicity",
        "is_a_urm",
        "first_gen_status",
        "current_score",
        "final_score",
        "id",
        "type",
        "workflow_state",
    )


def ordered_by_count(courses: DataFrame, count: str) -> DataFrame:
    """All courses, the largest count first (then by id)."""
    return courses.orderBy(F.col(count).desc_nulls_last(), F.col("course_canvas_id").asc_nulls_last())


def register_views(wh: Warehouse) -> None:
    """The base tables and the three course views under their names."""
    wh.register()
    for view, count in ((course_enrollments, "enrollments"), (course_assignments, "assignments"), (course_submissions, "submissions")):
        ordered_by_count(view(wh), count).createOrReplaceTempView(view.__name__)


def query(wh: Warehouse, sql: str) -> DataFrame:
    """A caller's SQL text over the warehouse tables and views."""
    register_views(wh)
    return wh.course_dim.sparkSession.sql(sql)


def ordered_by_due_date(submissions: DataFrame) -> DataFrame:
    """The submission table as the study stores it: by due date, nulls last."""
    return submissions.orderBy(F.col("due_date").asc_nulls_last(), "submission_id")
