"""State of messages from attempts and manual grants: batch, stream and a plain fold agree, whatever comes late."""

import random

from notelake.operators import delivery
from notelake.streaming import jobs

ATTEMPT = "mail_id long, attempt_no long, started_at long, line_id long, finished_at long, outcome string"


def logs(seed, mails=40):
    rng = random.Random(seed)
    attempts = [
        (m, n, t := rng.randint(0, 90_000), rng.randint(0, 9), None if (o := rng.choice([None, "accepted", "permanent", "permanent", "temporary", "uncertain"])) is None else t + 60, o)
        for m in range(mails) for n in range(1, rng.randint(1, 8))
    ]
    grants = [(m, rng.randint(0, 100_000)) for m in range(mails) for _ in range(rng.randint(0, 4))]
    return attempts, grants


def plain(attempts, grants):
    own = {}
    for m, n, at, line, finished, outcome in attempts:
        own.setdefault(m, []).append((at, 1, n, line, -1 if finished is None else finished, outcome or ""))
    for m, at in grants:
        own.setdefault(m, []).append((at, 0, -1, -1, -1, ""))
    return sorted((m, *jobs.folded(log)) for m, log in own.items())


def rows(df):
    found = [(r.mail_id, r.state, r.reason, r.next_attempt_at, r.manual_pending, r.granted, r.refused) for r in df.collect()]
    return sorted(found, key=lambda r: r[0])


def test_batch_is_the_plain_fold(spark):
    attempts, grants = logs(1)
    frames = spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame(grants, "mail_id long, at long")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(rows(delivery.delivery_fold(*frames, [300, 1800, 7200], 6)), key=key) == sorted(plain(attempts, grants), key=key)
    assert delivery.delivery_fold(frames[0].limit(0), frames[1].limit(0), [300], 6).count() == 0


def test_grants_one_by_one(spark):
    attempts = [(1, 6, 100, 0, 160, "uncertain"), (2, 1, 100, 0, 160, "permanent"), (2, 2, 500, 0, 560, "temporary"), (3, 1, 100, 0, 160, "accepted"), (4, 1, 100, 0, None, None), (5, 6, 100, 0, 160, "temporary"), (5, 7, 300, 0, 360, "accepted")]
    grants = [(1, 200), (1, 300), (2, 400), (3, 200), (4, 200), (5, 250), (6, 1)]
    frames = spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame(grants, "mail_id long, at long")
    got = {r[0]: r[1:] for r in rows(delivery.delivery_fold(*frames, [300, 1800, 7200], 6))}
    assert got == {
        1: ("pending", None, 1960, True, 1, 1),  # not before the uncertain attempt's wait is over; the second grant is refused
        2: ("blocked", "manual_attempt_failed", None, False, 1, 0),
        3: ("accepted", None, None, False, 0, 1),
        4: ("sending", None, None, False, 0, 1),
        5: ("accepted", None, None, False, 1, 0),
        6: ("pending", None, None, False, 0, 1),
    }


def test_stream_reorders_what_comes_late(spark, tmp_path):
    attempts, grants = logs(2, 15)
    log = delivery.delivery_log(spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame(grants, "mail_id long, at long")).collect()
    random.Random(3).shuffle(log)
    schema = "mail_id long, at long, kind int, attempt_no long, line_id long, finished_at long, outcome string"
    seen = 0
    for part in range(3):
        spark.createDataFrame(log[part::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = jobs.drained(jobs.delivery_with_grants(stream), str(tmp_path / "job"))
        mails = {r.mail_id for r in log[part::3]}
        assert out.count() == seen + len(mails)  # one row for each message that the batch concerns
        seen += len(mails)
    want, got = plain(attempts, grants), rows_of(out)
    assert all(row in got[row[0]] for row in want)


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.mail_id, set()).add((r.mail_id, r.state, r.reason, r.next_attempt_at, r.manual_pending, r.granted, r.refused))
    return out
