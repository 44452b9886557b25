"""tardy: submission-timing analytics on Spark (warehouse views, cleaning,
ranks, procrastination scores, exploratory statistics, regression grid)."""

__version__ = "0.1.0"
