"""Who a notice is for: audience clauses cut into the longest words of a dictionary, and what these say together.

The dictionary is a table (role, field, value, phrase): conditions, and the words and, or, not, ( and ) that join them,
words that soften, states no profile records, and fillers. Phrases meet clauses by shared grams (``percolate``); of those
that overlap the leftmost and longest stays. What no phrase covers is the rest, and a clause is complete only if it has
none. Alternatives and negations reach as far as the group they stand in: what is inside cannot be answered, what is
outside can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .percolate import phrase_places

ROLES = ("condition", "and", "or", "not", "open", "close", "soft", "status", "filler")


def _whole(said: Column, at: Column, size: Column) -> Column:
    """Whether a match is not a part of a longer word."""
    letter = r"[\p{L}\p{N}]"
    before, after = F.when(at > 0, F.substring(said, at, F.lit(1))).otherwise(""), F.substring(said, at + size + 1, F.lit(1))
    first, last = F.substring(said, at + 1, F.lit(1)), F.substring(said, at + size, F.lit(1))
    return ~(first.rlike(letter) & before.rlike(letter)) & ~(last.rlike(letter) & after.rlike(letter))


def segments(clauses: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``clauses`` (any columns and ``said``, the text) with segments, an array of (at, size, role, field, value) in
    order, and rest, what lies between them without white space and commas. Letters' case does not matter. A phrase that
    the dictionary has twice with different meanings counts as the first of them by role, field and value."""
    own = clauses.withColumn("_id", F.monotonically_increasing_id())
    words = lexicon.select(F.lower("phrase").alias("phrase"), "role", "field", "value").groupBy("phrase").agg(F.min(F.struct("role", "field", "value")).alias("w"))
    low = F.lower("said")
    found = phrase_places(own.select("_id", low.alias("low"), low.alias("text")), words.select("phrase")).where(_whole(F.col("low"), F.col("at"), F.col("size"))).join(words, "phrase")
    match = F.struct("at", (-F.col("size")).alias("shorter"), "size", "w.role", "w.field", "w.value")
    gathered = found.groupBy("_id").agg(F.array_sort(F.collect_list(match)).alias("m"))  # of one clause
    rows = own.join(gathered, "_id", "left")
    kind = "array<struct<at:int,size:int,role:string,field:string,value:string>>"
    start = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("kept"), F.lit("").alias("rest"))

    def take(s: Column, m: Column) -> Column:
        one = F.struct(*(m[c].alias(c) for c in ("at", "size", "role", "field", "value")))
        gap = F.substring(F.col("said"), s["end"] + 1, m["at"] - s["end"])
        return F.when(m["at"] >= s["end"], F.struct((m["at"] + m["size"]).alias("end"), F.array_append(s["kept"], one).alias("kept"), F.concat(s["rest"], gap).alias("rest"))).otherwise(s)

    rows = rows.withColumn("s", F.aggregate(F.coalesce("m", F.array().cast("array<struct<at:int,shorter:int,size:int,role:string,field:string,value:string>>")), start, take))
    rest = F.regexp_replace(F.concat("s.rest", F.substring(F.col("said"), F.col("s.end") + 1, F.length("said"))), r"[\s,]+", "")
    return rows.select(*clauses.columns, F.col("s.kept").alias("segments"), rest.alias("rest"))


def _groups(segments: Column, negated: Column) -> Column:
    """Conditions with the groups they stand in; which groups hold an or, which are negated; whether brackets match."""
    cond = "array<struct<field:string,value:string,path:array<int>,negated:boolean>>"
    none = F.array().cast("array<int>")
    start = F.struct(
        F.array(F.lit(0)).alias("path"), F.lit(1).alias("next"), F.lit(False).alias("pending"), F.array().cast(cond).alias("conditions"), none.alias("ors"), F.when(negated, F.array(F.lit(0))).otherwise(none).alias("nots"), F.lit(False).alias("bad"),
    )
    names = ("path", "next", "pending", "conditions", "ors", "nots", "bad")

    def step(s: Column, x: Column) -> Column:
        change = lambda **new: F.struct(*(new.get(n, s[n]).alias(n) for n in names))
        here = F.element_at(s["path"], -1)
        one = F.struct(x["field"].alias("field"), x["value"].alias("value"), s["path"].alias("path"), s["pending"].alias("negated"))
        return (
            F.when(x["role"] == "condition", change(conditions=F.array_append(s["conditions"], one), pending=F.lit(False)))
            .when(x["role"] == "or", change(ors=F.array_append(s["ors"], here)))
            .when(x["role"] == "not", change(pending=F.lit(True)))
            .when(x["role"] == "open", change(path=F.array_append(s["path"], s["next"]), next=s["next"] + 1, nots=F.when(s["pending"], F.array_append(s["nots"], s["next"])).otherwise(s["nots"]), pending=F.lit(False)))
            .when(x["role"] == "close", change(path=F.when(F.size(s["path"]) > 1, F.slice(s["path"], 1, F.size(s["path"]) - 1)).otherwise(s["path"]), bad=s["bad"] | (F.size(s["path"]) == 1)))
            .otherwise(s)
        )

    return F.aggregate(segments, start, step, lambda s: F.struct(s["conditions"].alias("conditions"), s["ors"].alias("ors"), s["nots"].alias("nots"), (s["bad"] | (F.size(s["path"]) > 1) | s["pending"]).alias("bad")))


CODES = ("unbalanced_group", "soft_qualification", "unsupported_negation", "unsupported_or", "")


def qualifications(clauses: DataFrame, lexicon: DataFrame) -> DataFrame:
    """document_id, clause_no, field, values, operator, code and complete of each condition that audience clauses name.

    ``clauses``: document_id, clause_no, said, negated (by what stands before). All values that a clause names of one
    field are one condition: in, or unsupported with the code of why, if one of them is softened, negated, one of
    alternatives, or brackets do not match. A state that no profile records, and a rest or a clause without any condition
    (field other), are unsupported too. complete: the clause has nothing of that kind.
    """
    rows = segments(clauses, lexicon).withColumn("g", _groups(F.col("segments"), F.col("negated")))
    soft = F.exists("segments", lambda x: x["role"] == "soft")
    reach = lambda c, groups: F.arrays_overlap(c["path"], groups)
    code = lambda c: F.when(F.col("g.bad"), CODES[0]).when(soft, CODES[1]).when(c["negated"] | reach(c, F.col("g.nots")), CODES[2]).when(reach(c, F.col("g.ors")), CODES[3]).otherwise("")
    named = F.transform("g.conditions", lambda c: F.struct(c["field"].alias("field"), c["value"].alias("value"), code(c).alias("code")))
    states = F.transform(F.filter("segments", lambda x: x["role"] == "status"), lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"), F.lit("unsupported_condition").alias("code")))
    other = F.when(F.size("g.conditions") == 0, "unrecognized_audience").when(F.col("rest") != "", "unrecognized_condition")
    left = F.when(other.isNotNull(), F.array(F.struct(F.lit("other").alias("field"), F.lit(None).cast("string").alias("value"), other.alias("code")))).otherwise(F.array().cast("array<struct<field:string,value:string,code:string>>"))
    every = F.concat(named, states, left)
    rows = rows.select("document_id", "clause_no", F.forall(every, lambda c: c["code"] == "").alias("complete"), F.inline(every))
    order = F.array(*map(F.lit, CODES))
    worst = F.min_by("code", F.when(F.array_contains(order, F.col("code")), F.array_position(order, F.col("code"))).otherwise(0))
    per = rows.groupBy("document_id", "clause_no", "complete", "field").agg(F.array_sort(F.collect_set("value")).alias("values"), worst.alias("code"))
    return per.select("document_id", "clause_no", "field", "values", F.when(F.col("code") == "", "in").otherwise("unsupported").alias("operator"), "code", "complete")
