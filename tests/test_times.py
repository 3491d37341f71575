"""Times of generated clauses against a plain Python reading of them."""

import datetime
import random
import re

import pytest

from notelake.operators import facts

PACK = facts.Pack(action="apply")
ZONE = datetime.timezone(datetime.timedelta(hours=8))


def moment(said, late):
    """Seconds of a full date, or None if there is no such moment."""
    day, _, clock = said.partition(" ")
    try:
        at = datetime.datetime(*map(int, day.split("-")), tzinfo=ZONE)
    except ValueError:
        return None
    if not clock:
        return int(at.timestamp()) + (86399 if late else 0)
    h, m = map(int, clock.split(":"))
    return int(at.timestamp()) + h * 3600 + m * 60 if h < 24 and m < 60 else int(at.timestamp()) + 86400 if (h, m) == (24, 0) else None


def reading(kind, dates, gap):
    """What a clause of a kind over these dates says: (opens, deadline, code)."""
    year, full = None, []
    for i, said in enumerate(dates):
        own = re.match(r"(20\d\d)-", said)
        year = own[1] if own else year if i and gap in (" to ", " - ", " until ", " through ") else None
        full.append(said if own else year and f"{year}-{said}")
    if None in full:
        return None, None, "year_missing"
    both = kind in ("period", "both") or (kind == "opens" and gap == " until ")  # until speaks of a deadline
    if len(full) > 2 or (len(full) == 2 and not both) or (len(full) == 1 and kind == "period"):
        return None, None, "ambiguous_time"
    if len(full) == 2:
        o, e = moment(full[0], False), moment(full[1], True)
        return (o, e, None) if o is not None and e is not None and o <= e else (None, None, "invalid_time")
    if kind == "opens":
        o = moment(full[0], False)
        return (o, None, None) if o is not None else (None, None, "invalid_time")
    e = moment(full[0], True)
    return (None, e, None) if e is not None else (None, None, "invalid_time")


def test_generated_clauses(spark):
    rng = random.Random(8)
    begin = {"period": "registration period ", "both": "opens on the day; deadline".replace(";", ",") + " in ", "opens": "opens on ", "due": "apply by "}
    rows, want = [], {}
    for i in range(600):
        kind, gap = rng.choice(list(begin)), rng.choice([" to ", " - ", " until ", " through ", ", or ", " then to "])
        day = lambda: rng.choice(["2024-12-28", "2024-2-29", "2023-2-29", "2025-01-05", "01-05", "12-28", "2-29", "2024-13-01"]) + rng.choice(["", "", " 08:30", " 24:00", " 25:00", " 9:05"])
        dates = [day() for _ in range(rng.choice([1, 1, 2, 2, 2, 3]))]
        rows.append((i, "body_text", 0, 0, begin[kind] + gap.join(dates) + rng.choice(["", " (Beijing time)"])))
        want[i] = reading("both" if kind == "opens" and gap == " until " and len(dates) > 1 else kind, dates, gap)
    cut = spark.createDataFrame(rows, "document_id long, field string, clause_no int, start long, text string")
    published = spark.createDataFrame([(i, datetime.date(2024, 1, 1)) for i in range(600)], "document_id long, published_date date")
    got = {r.document_id: (r.opens_at, r.deadline_at, r.unknown) for r in facts.time_facts(cut, published, PACK).collect()}
    assert {i: (got[i], want[i], rows[i][4]) for i in want if got[i] != want[i]} == {}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("registration period 2024-12-28 to 01-05", "invalid_time"),  # the year is handed on, so the end comes first
        ("registration period 12-28 to 2025-01-05", "year_missing"),  # and is not handed back
        ("registration period 2024-01-05 to 12-28", None),
        ("apply by 2024-01-05 10:30:15", "invalid_time"),
        ("apply by 2024-01-05 10:30 pm", "invalid_time"),
        ("apply by 2024-01-05 10:30 (Paris time)", "unsupported_timezone"),
        ("apply by 2024-01-05 10:30 EDT", "unsupported_timezone"),
        ("apply by Jan 5", "year_missing"),
        ("deadline to be announced, opens on 2024-01-05", "time_unrecognized"),
        ("the deadline is soon", "time_unrecognized"),
        ("registration period 2024-01-05", "ambiguous_time"),
    ],
)
def test_codes(spark, text, want):
    cut = spark.createDataFrame([(1, "body_text", 0, 0, text)], "document_id long, field string, clause_no int, start long, text string")
    published = spark.createDataFrame([(1, datetime.date(2024, 1, 1))], "document_id long, published_date date")
    assert [r.unknown for r in facts.time_facts(cut, published, PACK).collect()] == [want]


def test_texts_without_times_and_odd_rows(spark):
    cut = spark.createDataFrame([(1, "body_text", 0, 0, "on 2024-01-05 nothing is due to us"), (2, "body_text", 0, 0, ""), (3, "body_text", 0, 0, None), (4, "body_text", 0, 0, "deadline " + "1-1 " * 5_000)], "document_id long, field string, clause_no int, start long, text string")
    published = spark.createDataFrame([(i, None) for i in range(1, 5)], "document_id long, published_date date")
    got = {r.document_id: r.unknown for r in facts.time_facts(cut, published, PACK).collect()}
    assert got == {4: "year_missing"}
