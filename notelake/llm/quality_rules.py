"""Operator 8 [native]: quality rules with risk-controlled thresholds.

Each rule compares one measure of a text with a cutoff. Cutoffs are chosen per stratum (language) on labelled good
rows, in two halves (by a hash of doc_id). The first half orders the choices: at a step of STEPS each rule takes its
strictest cutoff that rejects no more than the step's share of the half, or a looser one, so choices get stricter from
step to step. The second half tests them, from lenient to strict: a choice is safe if the exact binomial bound on the share of good rows
that any of its rules rejects stays within RISK, at confidence 1 - DELTA over all strata together (Bonferroni; within
a stratum tests stop at the first that fails, so its steps need no correction). The last safe choice is used; without
one the rules are off. So, with confidence 1 - DELTA, no more than RISK of any stratum's good texts are rejected by
the rules. Languages with too few labelled good rows for a safe choice share one stratum: for them the risk holds over
all of them together. A language without labels has the thresholds of that stratum, or without one the mildest cutoff
that each rule has anywhere (none, if it is off somewhere).

All of it is DataFrame functions. A text's repeated windows are found inside its row, so nothing but one row of
numbers per document is stored, and only counts per stratum are shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, stored

RISK = 0.03
DELTA = 0.05
#: Choices from lenient to strict: the share of good rows that one rule may reject in the half that orders them, and
#: by how many cutoffs the strictest such cutoff is loosened.
STEPS = ((0.0, 3), (0.0, 2), (0.0, 1), (0.0, 0), (0.001, 0), (0.002, 0), (0.004, 0), (0.006, 0), (0.008, 0), (0.01, 0), (0.015, 0), (0.02, 0), (0.03, 0))
WINDOW = 8
_BLANK = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"

#: Measure, and its cutoffs from strict to lenient; a text is rejected above the cutoff, or below it for "min_".
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "repeat_ratio": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3),
    "dup_line_ratio": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    "upper_ratio": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "bang_ratio": (0.02, 0.05, 0.1, 0.2, 0.5, 0.8),
    "mean_word": (6.0, 6.5, 7.0, 8.0, 9.0, 12.0, 20.0),
    "min_mean_word": (4.5, 4.0, 3.5, 3.0, 2.0),
}


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _next(items: Column, by: int) -> Column:
    return F.slice(items, F.lit(1 + by), F.size(items))


def _pair_hash(items: Column, by: int) -> Column:
    return F.zip_with(items, _next(items, by), lambda a, b: F.xxhash64(a, b))


def measured(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, stratum, the counts of the contract and the measures of RULES."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    bare = F.trim(F.col("text"), F.lit(_BLANK))
    base = base.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(_BLANK))) > 0)
    counted = base.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), _BLANK)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), _SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(_without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("n_upper"),
        (F.length("text") - F.length(_without(F.col("text"), "!"))).alias("n_bang"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    counted = counted.withColumn("h2", _pair_hash(F.col("h1"), 1)).withColumn("h4", _pair_hash(F.col("h2"), 2)).drop("h1", "h2")
    counted = counted.withColumn("windows", F.slice(_pair_hash(F.col("h4"), 4), F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0)))).drop("h4")
    counted = counted.withColumn("again", F.size(F.array_distinct("windows")) < F.size("windows"))
    ranked = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    counted = counted.withColumn("ranked", F.when(F.col("again"), ranked))
    twins = F.zip_with(F.col("ranked"), _next(F.col("ranked"), 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    counted = counted.withColumn("starts", F.when(F.col("again"), F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))))
    steps = F.zip_with(F.col("starts"), _next(F.col("starts"), 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    repeated = F.when(F.col("again"), F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    counted = counted.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"), "n_upper", "n_bang", F.greatest(F.size("lines"), F.lit(1)).alias("n_lines"),
    )
    share = lambda a, b: (F.col(a) / b).cast("double")
    return counted.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", words).alias("symbol_ratio"), share("n_repeat_words", words).alias("repeat_ratio"), share("n_dup_lines", F.col("n_lines")).alias("dup_line_ratio"),
        share("n_upper", F.greatest("word_chars", F.lit(1))).alias("upper_ratio"), share("n_bang", words).alias("bang_ratio"), share("word_chars", words).alias("mean_word"),
    )


def _violates(rule: str, measure: Column, cutoff: Column) -> Column:
    return measure < cutoff if rule.startswith("min_") else measure > cutoff


def _measure(rule: str) -> Column:
    return F.col(rule.removeprefix("min_"))


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z >= 1 (Stirling's series at z + 8; error under 1e-13)."""
    w = z + 8
    below = sum((F.log(z + i) for i in range(1, 8)), F.log(z))
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * w * w * w * w * w) - below


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(X <= x) of a binomial variable: the exact bound on the risk is at most p where this is at most the error level."""
    n = n.cast("double")

    def term(k: Column) -> Column:
        k = k.cast("double")
        return F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), x.cast("long")), F.lit(0.0), lambda s, k: s + term(k))


def with_strata(per: DataFrame, risk: float, delta: float) -> DataFrame:
    """``per`` (stratum, m: rows of the testing half) with ``own``, whether the stratum has thresholds of its own, and
    ``level``, the error level of a stratum. A stratum is thin if even without a false rejection nothing could be safe.
    One row a language comes in."""
    k = F.row_number().over(W.orderBy(F.desc("m"), "stratum"))
    n = F.count("*").over(W.partitionBy())
    level = delta / (F.col("k") + (F.col("k") < F.col("strata")).cast("int"))
    fits = F.col("m") * math.log1p(-risk) <= F.log(level)
    ranked = per.withColumns({"k": k, "strata": n}).withColumn("last", F.max(F.when(fits, F.col("k"))).over(W.partitionBy()))
    own = F.coalesce(F.col("k") <= F.col("last"), F.lit(False))
    used = F.coalesce("last", F.lit(0)) + (F.coalesce("last", F.lit(0)) < F.col("strata")).cast("int")
    return ranked.withColumns({"own": own, "level": delta / F.greatest(F.lit(1), used)}).drop("k", "strata", "last")


def _choices(first: DataFrame) -> DataFrame:
    """For each stratum and step the cutoff of each rule (null: off). ``first``: stratum, n and x_<rule>_<i>."""
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(s).alias("share"), F.lit(k).alias("looser")) for i, (s, k) in enumerate(STEPS)))).alias("s")
    rows = first.select("*", steps)
    place = {r: F.coalesce(*(F.when(F.col(f"x_{r}_{i}") <= F.col("s.share") * F.col("n"), F.lit(i)) for i in range(len(cuts)))) for r, cuts in RULES.items()}
    strictest = {r: F.get(F.array(*map(F.lit, cuts)), F.least(place[r] + F.col("s.looser"), F.when(place[r].isNotNull(), F.lit(len(cuts) - 1)))) for r, cuts in RULES.items()}
    return rows.select("stratum", F.col("s.step").alias("step"), *(c.alias(f"c_{r}") for r, c in strictest.items()))


def thresholds(measures: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """For each stratum with labelled good rows: own, and c_<rule>, its cutoff of each rule (null: off); and a row
    with stratum null for all others. Labels that differ for one doc_id count as not good."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = measures.where("NOT base_failed").join(good, "doc_id", "left_semi").withColumn("testing", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 1)
    held = stored(held, "held")
    sizes = stored(with_strata(held.groupBy("stratum").agg(F.count_if("testing").alias("m")), risk, delta), "strata")
    named = held.join(sizes.select("stratum", "own", "level"), "stratum").withColumn("stratum", F.when(F.col("own"), F.col("stratum")))
    flags = [F.count_if(_violates(r, _measure(r), F.lit(c))).alias(f"x_{r}_{i}") for r, cuts in RULES.items() for i, c in enumerate(cuts)]
    choices = stored(_choices(named.where("NOT testing").groupBy("stratum").agg(F.count("*").alias("n"), *flags)), "choices")
    # Every testing row meets the few choices of its stratum; what is shuffled are counts.
    a, b = named.where("testing").alias("a"), choices.alias("b")
    met = a.join(b, F.col("a.stratum").eqNullSafe(F.col("b.stratum")))
    rejects = [F.coalesce(_violates(r, _measure(r), F.col(f"c_{r}")), F.lit(False)) for r in RULES]
    tested = met.groupBy("b.stratum", "step", "level").agg(F.count("*").alias("n"), F.count_if(reduce(Column.__or__, rejects)).alias("x"))
    safe = F.when(F.col("x") < F.col("n") * risk, binomial_tail(F.col("x"), F.col("n"), risk) <= F.col("level")).otherwise(False)
    until = tested.withColumn("failed", F.max((~safe).cast("int")).over(W.partitionBy("stratum").orderBy("step").rowsBetween(W.unboundedPreceding, 0))).where("failed = 0")
    last = until.groupBy("stratum").agg(F.max("step").alias("last"))
    chosen = choices.alias("c").join(last.alias("l"), F.col("c.stratum").eqNullSafe(F.col("l.stratum")) & (F.col("step") == F.col("last"))).select("c.*").drop("step")
    alone = sizes.where("own").select("stratum").join(chosen, "stratum", "left")
    return alone.unionByName(chosen.where("stratum IS NULL"), allowMissingColumns=True)


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    failed (the rules that reject it).

    A null or blank text has no words and fails the base; a null lang is a stratum of its own; without labels, or with
    too few for a bound, the rules are off and kept is the opposite of base_failed. Repeated rows get a row each.
    """
    measures = stored(measured(docs), "measures")
    cut = stored(thresholds(measures, labels, risk, delta), "cutoffs")  # one row a language
    own = cut.where("stratum IS NOT NULL").withColumn("own", F.lit(True))
    shared = F.col("stratum").isNull()
    mildest = lambda r: F.when(F.count(f"c_{r}") == F.count("*"), (F.min if r.startswith("min_") else F.max)(f"c_{r}"))
    other = cut.agg(*(F.when(F.count_if(shared) > 0, F.max(F.when(shared, F.col(f"c_{r}")))).otherwise(mildest(r)).alias(f"o_{r}") for r in RULES)).first()
    rows = measures.join(own, "stratum", "left")
    cutoff = lambda r: F.when(F.col("own"), F.col(f"c_{r}")).otherwise(F.lit(other[f"o_{r}"]).cast("double"))
    verdict = rows.withColumn("failed", F.array_compact(F.array(*(F.when(_violates(r, _measure(r), cutoff(r)), F.lit(r)) for r in RULES))))
    return verdict.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed"
    )
