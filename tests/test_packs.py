"""Packs as tables: matched by shared grams whatever their length, and told apart by their digest."""

import random

from pyspark.sql import functions as F

from notelake.operators import facts, percolate, rules

PACK = "rule_id string, topic string, phrase string"


def test_mentions_are_those_of_a_plain_loop(spark):
    rng = random.Random(9)
    say = lambda n: "".join(rng.choices("ab é", k=n))
    texts = [(i, f, say(rng.randint(0, 90))) for i in range(40) for f in ("title", "body_text")] + [(50, "title", None), (51, "title", ""), (3, "title", "aaaaaa")]
    pack = [(f"r{i}", f"t{i % 5}", say(rng.randint(1, 6))) for i in range(60)] + [("r1", "t1", "aa"), ("x", "t9", "aa"), ("y", "t9", None), ("z", "t9", "")]

    def places(text, phrase):
        out, at = [], text.find(phrase)
        while at >= 0:
            out.append(at)
            at = text.find(phrase, at + len(phrase))
        return out

    want = sorted((d, f, r, t, at, at + len(p)) for d, f, text in texts for r, t, p in set(pack) if p for at in places(text or "", p))
    got = rules.topic_mentions(spark.createDataFrame(texts, "document_id long, field string, text string"), spark.createDataFrame(pack, PACK))
    assert sorted(map(tuple, got.collect())) == want


def test_the_plan_does_not_grow_with_the_pack(spark):
    texts = spark.createDataFrame([(1, "title", "one two three")], "document_id long, field string, text string").repartition(2)
    size = lambda n: len(rules.topic_mentions(texts, spark.createDataFrame([(f"r{i}", "t", f"phrase {i}") for i in range(n)], PACK).repartition(2))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(3) - size(3_000)) < 200


def test_rows_keep_what_they_carry(spark):
    texts = spark.createDataFrame([(1, "abc", [1, 2], None), (2, None, [], "x")], "k long, text string, a array<int>, phrase2 string")
    got = percolate.phrase_places(texts, spark.createDataFrame([("b",), ("c",)], "phrase string"))
    assert got.columns == ["k", "a", "phrase2", "phrase", "at", "size"]
    assert sorted(map(tuple, got.collect())) == [(1, [1, 2], None, "b", 1, 1), (1, [1, 2], None, "c", 2, 1)]
    assert percolate.phrase_places(texts.limit(0), spark.createDataFrame([("b",)], "phrase string")).count() == 0


def test_versions_of_packs(spark):
    pack = [(f"r{i}", "t", f"phrase {i}") for i in range(300)]
    version = lambda rows: tuple(rules.pack_version(spark.createDataFrame(rows, PACK)).first())
    n, digest = version(pack)
    assert n == 300 and version(pack[::-1] + pack[:5]) == (n, digest)
    assert version(pack[1:])[1] != digest and version([("r0", "u", "phrase 0"), *pack[1:]])[1] != digest
    assert rules.pack_version(spark.createDataFrame([], PACK)).count() == 0


def test_a_rival_topic_between_breaks_the_link(spark):
    pack = facts.Pack(action="apply")
    topics = spark.createDataFrame([("grant", "grant"), ("prize", "prize"), ("prize", "award")], "topic string, phrase string")
    said = ["apply for the grant", "apply for the prize, grant", "the award, the grant: apply", "grant award apply", "apply for the award prize"]
    texts = spark.createDataFrame([(i, "body_text", t) for i, t in enumerate(said)], "document_id long, field string, text string")
    cut = facts.clauses(texts, pack)
    acts = facts.action_blocked(facts.action_mentions(cut, pack), pack)
    got = facts.topic_context(facts.topic_mentions(cut, topics), acts).select("document_id", "topic", "start", F.col("context") == "opportunity").collect()
    linked = {(r[0], r[1], said[r[0]][r[2] :].split()[0].strip(",:")) for r in got if r[3]}
    assert linked == {(0, "grant", "grant"), (1, "prize", "prize"), (2, "grant", "grant"), (3, "prize", "award"), (4, "prize", "award"), (4, "prize", "prize")}
