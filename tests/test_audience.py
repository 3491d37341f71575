"""Audience clauses by segmentation, against a plain reading of generated groups."""

import random

import pytest

from notelake.operators import audience

LEXICON = [
    ("condition", "college", "law", "School of Law"), ("condition", "college", "arts", "school of arts"), ("condition", "college", "fine arts", "school of arts and design"), ("condition", "level", "graduate", "graduates"), ("condition", "level", "undergraduate", "undergraduates"),
    ("condition", "year", "2020", "entry 2020"), ("and", "", "", "and"), ("or", "", "", "or"), ("not", "", "", "not"), ("open", "", "", "("), ("close", "", "", ")"), ("soft", "", "", "preferably"), ("status", "state", "enrolled", "enrolled"), ("filler", "", "", "of the"), ("filler", "", "", "of"), ("and", "", "", None),
]
MEANS = {"school of law": ("college", "law"), "school of arts": ("college", "arts"), "school of arts and design": ("college", "fine arts"), "graduates": ("level", "graduate"), "undergraduates": ("level", "undergraduate"), "entry 2020": ("year", "2020")}


def read(spark, *clauses):
    rows = spark.createDataFrame([(i, 0, c[0] if isinstance(c, tuple) else c, isinstance(c, tuple)) for i, c in enumerate(clauses)], "document_id long, clause_no int, said string, negated boolean")
    lexicon = spark.createDataFrame(LEXICON, "role string, field string, value string, phrase string")
    out = [{} for _ in clauses]
    for r in audience.qualifications(rows, lexicon).collect():
        assert r.operator == ("unsupported" if r.code else "in") and r.field not in out[r.document_id]
        out[r.document_id][r.field] = (tuple(r["values"]), r.code, r.complete)
    return out


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("Graduates of the SCHOOL OF LAW", {"level": (("graduate",), ""), "college": (("law",), "")}),
        ("school of arts and design", {"college": (("fine arts",), "")}),  # the longest, not arts and a rest
        ("school of artsy folk", {"other": ((), "unrecognized_audience")}),  # no part of a longer word
        ("undergraduates", {"level": (("undergraduate",), "")}),  # not graduates within it
        ("graduates with honours", {"level": (("graduate",), ""), "other": ((), "unrecognized_condition")}),
        ("graduates of (school of law or school of arts)", {"level": (("graduate",), ""), "college": (("arts", "law"), "unsupported_or")}),
        ("graduates, not (entry 2020 and (school of law))", {"level": (("graduate",), ""), "year": (("2020",), "unsupported_negation"), "college": (("law",), "unsupported_negation")}),
        ("not graduates, entry 2020", {"level": (("graduate",), "unsupported_negation"), "year": (("2020",), "")}),
        ("school of arts and (school of law or entry 2020)", {"college": (("arts", "law"), "unsupported_or"), "year": (("2020",), "unsupported_or")}),  # one field is one condition
        ("(graduates", {"level": (("graduate",), "unbalanced_group")}),
        ("graduates) not", {"level": (("graduate",), "unbalanced_group")}),
        ("preferably graduates", {"level": (("graduate",), "soft_qualification")}),
        ("enrolled graduates", {"level": (("graduate",), ""), "state": (("enrolled",), "unsupported_condition")}),
        ("", {"other": ((), "unrecognized_audience")}),
        (None, {"other": ((), "unrecognized_audience")}),
        (("graduates",), {"level": (("graduate",), "unsupported_negation")}),
    ],
)
def test_clauses(spark, said, want):
    (got,) = read(spark, said)
    assert {f: v[:2] for f, v in got.items()} == want
    assert all(v[2] == all(code == "" for _, code in want.values()) for v in got.values())


def test_generated_groups(spark):
    """Nested groups with or and not: a plain recursive reading says what can be answered."""
    rng = random.Random(12)

    def group(depth):
        """A group's text, and its conditions with whether an or or a not reaches them."""
        word = rng.choice([" and ", " or ", ", "])
        texts, own = [], []
        for _ in range(rng.randint(1, 3)):
            negated = rng.random() < 0.2
            if depth < 3 and rng.random() < 0.4:
                text, inner = group(depth + 1)
                text = f"({text})"
            else:
                text = rng.choice(list(MEANS))
                inner = [(MEANS[text], False, False)]
            texts.append(("not " if negated else "") + text)
            own += [(m, o, n or negated) for m, o, n in inner]
        return word.join(texts), [(m, o or (word == " or " and len(texts) > 1), n) for m, o, n in own]

    made = [group(0) for _ in range(150)]
    for (text, conditions), got in zip(made, read(spark, *(t for t, _ in made)), strict=True):
        want = {}
        for (field, value), reached, negated in conditions:
            values, codes = want.setdefault(field, (set(), set()))
            values.add(value)
            codes.add("unsupported_negation" if negated else "unsupported_or" if reached else "")
        expected = {f: (tuple(sorted(v)), next(c for c in audience.CODES if c in codes)) for f, (v, codes) in want.items()}
        assert ({f: v[:2] for f, v in got.items()}, text) == (expected, text)


def test_long_clauses_and_an_empty_dictionary(spark):
    (got,) = read(spark, "(" * 200 + "graduates" + ")" * 200 + " and school of law" * 300)
    assert {f: v[:2] for f, v in got.items()} == {"level": (("graduate",), ""), "college": (("law",), "")}
    rows = spark.createDataFrame([(1, 0, "graduates", False)], "document_id long, clause_no int, said string, negated boolean")
    lexicon = spark.createDataFrame([], "role string, field string, value string, phrase string")
    assert [(r.field, r.code) for r in audience.qualifications(rows, lexicon).collect()] == [("other", "unrecognized_audience")]
    assert audience.qualifications(rows.limit(0), lexicon).count() == 0
