"""Parameters of the cleaning pipeline and of the regression grid."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CleanConfig:
    """Thresholds of the cleaning pipeline.

    a_n: a course must keep more than ``a_n`` distinct assignments.
    s_n: a course must keep more than ``s_n`` distinct students.
    a_thres: an assignment is kept when distinct submitters / course size > a_thres.
    s_thres: a student-course is kept when its distinct assignments
        > floor(n_assignments * s_thres).
    """

    a_n: int = 5
    s_n: int = 20
    a_thres: float = 0.5
    s_thres: float = 0.5


# ---- fixed values (must equal the analysed study) -------------------------
# Ethnicity relabelling, applied in this order.
ETHNICITY_REMAP = {
    "Non Resident Alien": "International",
    "Two or More Races": "Multiple Races",
    "Hawaii/Pac": "Native/Pacific",
    "Am. Indian": "Native/Pacific",
    "No Citizenship Status": "Unknown",
}
# The four groups used by the ethnicity plots and the filtered error bars.
MAIN_ETHNICITIES = ("White", "Asian", "Black", "Hispanic")
# Levels drawn per demographic dimension in the density plots.
KDE_LEVELS = {
    "gender": ("M", "F"),
    "first_gen_status": ("Y", "N"),
    "ethnicity": MAIN_ETHNICITIES,
}
# Grid of the regression study: a_n 5/15/25, s_n 10/20/30/40, thresholds 1/4, 2/4, 3/4.
GRID_A_N = (5, 15, 25)
GRID_S_N = (10, 20, 30, 40)
GRID_A_THRES = (0.25, 0.5, 0.75)
GRID_S_THRES = (0.25, 0.5, 0.75)
# Course eligibility in the warehouse stage (all strict).
MIN_ASSIGNMENTS = 5
MIN_ENROLLMENTS = 20
MIN_SUBMISSIONS = 100
# Enrollment filter of the course views.
STUDENT_ENROLLMENT_TYPE = "StudentEnrollment"
ENROLLMENT_STATES = ("active", "completed")
# Band limits of the time-series sample (per-user mean percentile rank).
BAND_LOW = 0.25
BAND_MID = (0.4, 0.6)
BAND_HIGH = 0.75
SAMPLE_SEED = 1
# Regression formula terms (response and categorical covariates).
RESPONSE = "procrastination_mean_rank"
COVARIATES = ("gender", "is_a_urm", "first_gen_status", "ethnicity")
# ---------------------------------------------------------------------------
