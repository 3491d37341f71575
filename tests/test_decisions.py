"""Decisions for many profiles without meeting all of them; standing phrases; audits of delivery."""

import random

import pytest

from notelake.operators import decisions, delivery, percolate

AT = 1_704_000_000
FACT = "document_id long, category string, opens_at long, deadline_at long, deadline_lower_at long, opening_confirmed boolean, cancelled boolean, audience_declared boolean, eligibility_complete boolean, information_incomplete boolean, published_date date, kind string, previous_route string, comparison_known boolean, conditions_changed boolean"


@pytest.fixture(scope="module")
def world(spark):
    """Facts, constraints, profiles and interests of some documents, and what each is as plain rows."""
    import datetime

    rng = random.Random(11)
    day = datetime.date(2023, 12, 31)
    facts = [
        (i, rng.choice(["opportunity", "information"]), None, AT + rng.choice([-1, 1]) * 86400, None, True, False, rng.random() < 0.8, rng.random() < 0.8, rng.random() < 0.2, day, rng.choice(["new", "update"]), rng.choice(["none", "digest"]), True, False)
        for i in range(60)
    ]
    asked = [(i, rng.choice(["level", "year"]), rng.choice(["in", "in", "unsupported"]), rng.sample(["a", "b", "c"], rng.randint(0, 2))) for i in range(0, 60, 2) for _ in range(rng.randint(0, 3))]
    profiles = [("p", "level", "a"), ("p", "year", "b"), ("q", "level", None), ("q", "year", "c"), ("r", "level", "c"), ("s", None, None), ("t", "college", "x")]
    matches = [(i, rng.choice(["x", "y"]), rng.choice(["opportunity", None, "uncertain"]), True) for i in range(0, 60, 3)]
    interests = [("p", "x", True, False, True, False), ("s", "y", True, False, False, False), ("r", "x", False, True, False, False)]
    return facts, asked, profiles, matches, interests


def frames(spark, world):
    facts, asked, profiles, matches, interests = world
    return (
        spark.createDataFrame(facts, FACT),
        spark.createDataFrame(asked, "document_id long, field string, operator string, values array<string>"),
        spark.createDataFrame(profiles, "profile_id string, field string, actual string"),
        spark.createDataFrame(matches, "document_id long, topic string, context string, is_primary boolean"),
        spark.createDataFrame(interests, "profile_id string, topic string, interest boolean, excluded boolean, high_value boolean, store_only boolean"),
    )


def own_eligibility(fact, asked, answers):
    results = ["unknown" if op == "unsupported" or not values or answers.get(field) is None else "match" if answers[field] in values else "mismatch" for d, field, op, values in asked if d == fact[0]]
    if fact[1] != "opportunity" and not results:
        return "not_required"
    if "mismatch" in results:
        return "ineligible"
    return "unknown" if "unknown" in results or not fact[7] or not fact[8] or fact[9] else "eligible"


def test_every_pair_is_decided_once(spark, world):
    """A pair's row, or its document's row for all others, gives what a plain loop over all pairs gives."""
    facts, asked, profiles, matches, interests = world
    fact, constraints, known, topics, wants = frames(spark, world)
    rows = decisions.decide_batch(fact, constraints, known, decisions.interest_flags(topics, wants), AT, "hybrid", AT + 86400)
    own = {(r.document_id, r.profile_id): r for r in rows.collect()}
    assert len(own) == rows.count()
    ids = sorted({p for p, _, _ in profiles})
    for f in facts:
        listed = [p for p in ids if (f[0], p) in own]
        assert (own[f[0], None].profiles if (f[0], None) in own else 0) == len(ids) - len(listed)
        for p in ids:
            answers = {field: actual for q, field, actual in profiles if q == p}
            row = own.get((f[0], p)) or own[f[0], None]
            assert row.eligibility == own_eligibility(f, asked, answers)
            cared = any(d == f[0] and t == topic and q == p for d, t, _, _ in matches for q, topic, *_ in interests)
            assert cared or row.relevance in ("unmatched", "unknown")


def test_no_plan_compares_all_with_all(spark, world):
    fact, constraints, known, topics, wants = frames(spark, world)
    rows = decisions.decide_batch(fact, constraints, known, decisions.interest_flags(topics, wants), AT, "hybrid", AT + 86400)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_phrase_is_an_interest(spark, world):
    """What a profile includes literally makes a document relevant to it, as a topic that is offered would."""
    fact, constraints, known, topics, wants = frames(spark, world)
    phrases = spark.createDataFrame([("t", "night school"), ("s", "never said")], "profile_id string, phrase string")
    docs = spark.createDataFrame([(i, "title", "the night school opens" if i % 4 == 1 else "nothing") for i in range(60)], "document_id long, title string, body_text string")
    hits = percolate.phrase_hits(docs, phrases.select("phrase"))
    decide = lambda flags: {(r.document_id, r.profile_id): (r.relevance, r.action) for r in decisions.decide_batch(fact, constraints, known, flags, AT, "hybrid", AT + 86400).collect()}
    without, having = decide(decisions.interest_flags(topics, wants)), decide(decisions.interest_flags(topics, wants, hits, phrases))
    new = {k for k in having if k not in without}
    assert new == {(i, "t") for i in range(1, 60, 4)}
    assert all(having[k][0] == "matched" for k in new) and {having[k][1] for k in new} > {"DIGEST"}
    assert {k: v for k, v in having.items() if k[1] not in ("t", None)} == {k: v for k, v in without.items() if k[1] not in ("t", None)}


@pytest.mark.parametrize("rare", [1, 2, 50])
def test_phrase_hits_are_those_of_a_plain_loop(spark, monkeypatch, rare):
    monkeypatch.setattr(percolate, "RARE", rare)
    monkeypatch.setattr(percolate, "SLICE", 3)
    rng = random.Random(5)
    say = lambda n: "".join(rng.choices("abé 中😀\n", k=n))
    docs = [(i, say(8), say(rng.randint(0, 200))) for i in range(60)] + [(61, None, None), (62, "", "aab" * 5_000), (5, "abab", None)]
    phrases = [say(k) for k in (1, 1, 2, 2, 3, 3, 4, 4, 5, 9)] + ["aab", "", None, "aab", "nowhere at all", "é"]
    got = percolate.phrase_hits(spark.createDataFrame(docs, "document_id long, title string, body_text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    want = [(d, f, p, (t or "").find(p), (t or "").find(p) + len(p)) for d, *texts in docs for f, t in zip(("title", "body_text"), texts, strict=True) for p in {p for p in phrases if p} if p in (t or "")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert percolate.phrase_hits(spark.createDataFrame(docs, "document_id long, title string, body_text string"), spark.createDataFrame([], "phrase string")).count() == 0


def test_every_message_is_audited(spark):
    messages = spark.createDataFrame(
        [(1, "pending", 100, 100), (2, "accepted", 100, None), (3, "sending", 100, None), (4, "retry", 100, 1300), (5, "retry", 100, 9), (6, "uncertain", 100, 1000 + 1800), (7, "blocked", 100, None), (8, "pending", 100, 7), (9, None, 100, None)],
        "mail_id long, state string, frozen_at long, next_attempt_at long",
    )
    attempts = spark.createDataFrame(
        [(3, 1, 900, 0, None, None), (4, 1, 900, 0, "temporary", 1000), (5, 1, 900, 0, "temporary", 1000), (6, 1, 900, 0, "uncertain", 1000), (7, 6, 900, 0, "temporary", 1000), (6, 1, 800, 0, "temporary", 850)],
        "mail_id long, attempt_no long, started_at long, line_id long, outcome string, finished_at long",
    )
    got = {r.mail_id: (r.rule, r.computed, r.computed_due) for r in delivery.delivery_audit(messages, attempts, [300, 1800, 7200], 6).collect()}
    assert got == {2: ("state", "pending", 100), 5: ("due", "retry", 1300), 8: ("due", "pending", 100), 9: ("state", "pending", 100)}
