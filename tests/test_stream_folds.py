"""Streams that fold rows by message: batches that come one after the other, a restart, and no work key by key in Python."""

import random

import pytest

from notelake.operators import delivery
from notelake.streaming import jobs

ATTEMPT = "mail_id long, attempt_no long, started_at long, line_id long, finished_at long, outcome string"


def attempts(seed, mails=30):
    rng = random.Random(seed)
    return [
        (m, n, t := rng.randint(0, 50), rng.randint(0, 9), None if (o := rng.choice([None, "accepted", "permanent", "temporary", "uncertain"])) is None else t + 60, o)
        for m in range(mails) for n in range(1, rng.randint(2, 8))
    ]


def run(spark, folder, parts, make):
    """Result rows after each part; between parts the job is started again from its checkpoint."""
    out = []
    for part in parts:
        spark.createDataFrame(part, ATTEMPT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        job = make(spark.readStream.schema(ATTEMPT).parquet(f"{folder}/in"))
        out.append(sorted(map(tuple, jobs.drained(job, f"{folder}/job").collect()), key=str))
    assert sorted(map(tuple, jobs.drained(job, f"{folder}/job").collect()), key=str) == out[-1]  # nothing new
    return out


def split(rows, seed, n):
    rng = random.Random(seed)
    parts = [[] for _ in range(n)]
    for r in rows:
        parts[rng.randrange(n)].append(r)
    return parts


def late(parts):
    latest, out = {}, []
    for part in parts:
        for m, n, t, line, *_ in sorted(part, key=lambda r: (r[0], r[3], r[2], r[1])):
            out.append((m, line, t, "late" if m in latest and t < latest[m] else "accepted"))
            latest[m] = max(t, latest.get(m, t))
    return out


@pytest.mark.parametrize("n", [1, 3])
def test_late_rows(spark, tmp_path, n):
    parts = split(attempts(1), 2, n)
    got = run(spark, tmp_path, parts, lambda s: jobs.late_rows(s.select("mail_id", "line_id", "started_at", "attempt_no")))
    for i in range(n):
        assert got[i] == sorted(late(parts[: i + 1]), key=str)


@pytest.mark.parametrize("n", [1, 3])
def test_delivery(spark, tmp_path, n):
    parts, want = split(attempts(3), 4, n), []
    got = run(spark, tmp_path, parts, jobs.delivery)
    for i in range(n):
        mails, so_far = {r[0] for r in parts[i]}, [r for part in parts[: i + 1] for r in part]
        own = spark.createDataFrame([r for r in so_far if r[0] in mails], ATTEMPT)
        want += map(tuple, delivery.delivery_state(own, [300, 1800, 7200], 6).collect())
        assert got[i] == sorted(want, key=str)


def test_no_key_goes_through_python(spark):
    rows = spark.createDataFrame([(1, 1, 5, 1, 9, "accepted")], ATTEMPT)
    log = delivery.delivery_log(rows, rows.selectExpr("mail_id", "started_at AS at"))
    for job in (jobs.late_rows(rows), jobs.delivery(rows), jobs.delivery_with_grants(log)):
        kept = job.fold(job.rows, None)
        for df in (kept, job.fold(job.rows, kept), job.shown(kept, kept) if job.shown else kept):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "Pandas" not in plan
