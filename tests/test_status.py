"""The status report where a source has runs but none that has finished."""

from pyspark.sql import functions as F

from notelake.operators import audits

DOCS = "document_id long, source_id string, status string, last_success_at long, discovered_at long, next_due_at long"
RUNS = "source_id string, run_no long, started_at long, finished_at long, failed long, not_before_at long, over_budget boolean"


def test_no_finished_run_has_no_number_of_budget_runs(spark):
    docs = spark.createDataFrame([(i, s, "processed", 5, 1, 900) for i, s in enumerate("abc")], DOCS)
    runs = spark.createDataFrame([("a", 1, 10, None, 0, 5, True), ("b", 1, 10, 20, 0, 5, False), ("b", 2, 30, 40, 0, 5, True), ("b", 3, 50, None, 0, 5, True)], RUNS)
    got = {r.source_id: (r.budget_runs, r.unfinished_runs) for r in audits.status_report(docs, runs, 100).select("source_id", F.col("budget_runs"), "unfinished_runs").collect()}
    assert got == {"a": (None, 1), "b": (1, 1), "c": (None, None)}
