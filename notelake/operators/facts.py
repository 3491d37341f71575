"""Rule facts of notices, found by a table of topic phrases and a pack of patterns: one job over all texts, clause by
clause.

Clauses are cut at a pack's break characters, one character each; spans count code points. A clause is the unit in
which topics and actions can belong together, so pairs are only formed within one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import digest
from .percolate import phrase_hits, phrase_places
from .responses import first_reason

GAP, BEFORE, AFTER, NEAR = 24, 32, 16, 8


@dataclass(frozen=True)
class Pack:
    """What the rules look for. Patterns are those of Java; those that must stand at an edge say so themselves."""

    action: str
    breaks: str = r"[.;!?\n]"
    step: str = ","
    negated: str = r"(?:not|never|no longer)[^,.;\n]{0,10}$"
    closed: str = r"^\s*(?:is closed|has ended|ended)"
    unavailable: str = r"^\s*(?:is not yet|not yet) open"
    record: str = r"history|records of"
    menu: str = r"click|menu|->"
    past: str = r"last year|previously|in the past"
    current: str = r"now|this year|from today"
    admin: str = r"\bfees?\b|refund|withdraw"
    instruction: str = r"(?:please|must|now open:?)\s*$"
    results: str = r"results|award list"
    pair: str = r"(?:recruit|hire) (?:teaching )?assistants"
    pair_topic: str = "recruitment"
    pair_unavailable: str = r"no recruitment|recruitment is suspended"
    pair_present: str = r"now|this term"
    audience: str = r"(?:open to|limited to) ([^.;\n]+)"
    refused: str = r"\bnot\s*$"
    unsupported: tuple[tuple[str, str], ...] = (("gpa", r"GPA|grade average"), ("language", r"IELTS|TOEFL"), ("age", r"aged? under [0-9]+"))
    section: str = r"(?m)^Requirements:[ ]*$"
    next_section: str = r"(?m)^(?:Documents|Contact):"
    numbered: str = r"(?m)^[0-9]+\) ([^\n]+)$"
    deadline: str = r"deadline|apply by|register by|until"
    opening: str = r"opens on|open from"
    relative: str = r"from today on"
    date: str = r"(?<![0-9:.-])(?:20[0-9]{2}-)?[0-9]{1,2}-[0-9]{1,2}(?![0-9-])(?: [0-9]{1,2}:[0-9]{2}(?![0-9]))?"  # the year may be said before
    range: str = r"^\s*(?:to|until|through|-)\s*$"  # all that stands between the two ends of one stretch of time
    period: str = r"registration period|applications from"
    yearless: str = r"(?:Jan|Feb|Mar) [0-9]{1,2}\b"
    foreign_zone: str = r"\b(?:UTC|GMT|EST|EDT|PST|PDT|CET|CEST)\b"
    zone: str = r"\(([A-Za-z ]+ time)\)"
    local_zones: tuple[str, ...] = ("Beijing time", "Shanghai time", "China standard time")
    more_clock: str = r"^\s*(?::[0-9]|\.[0-9]|[+-][0-9]{2}:|[AaPp][Mm]\b|Z\b|(?:to|until|-)\s*[0-9]{1,2}:)"  # a clock that goes on is not understood
    before_day: str = r"before"
    deferred: str = r"deadline to be announced"
    media: str = r"(?:requirements|deadline|schedule)[^.;\n]{0,25}(?:see|in) (?:the )?(?:attachment|image|picture)"


def clauses(texts: DataFrame, pack: Pack) -> DataFrame:
    """document_id, field, clause_no, start, text of each clause that is not blank. ``texts``: document_id, field,
    text."""
    rows = texts.where("text IS NOT NULL").select("document_id", "field", F.posexplode(F.split("text", pack.breaks, -1)).alias("clause_no", "text"))
    start = F.coalesce(F.sum(F.length("text") + 1).over(W.partitionBy("document_id", "field").orderBy("clause_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start", start).where(F.trim("text") != "").select("document_id", "field", "clause_no", "start", "text")


def _places(text: Column, pattern: str) -> Column:
    """Start and word of each match of ``pattern`` in ``text``."""
    words, pieces = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.transform(F.split(text, pattern, -1), F.length)
    upto = lambda items, k: F.aggregate(F.slice(items, F.lit(1), k), F.lit(0), lambda s, x: s + x)
    return F.transform(words, lambda w, i: F.struct((upto(pieces, i + 1) + upto(F.transform(words, F.length), i)).alias("at"), w.alias("word")))


def action_mentions(cut: DataFrame, pack: Pack) -> DataFrame:
    """One row an action: document_id, field, clause_no, clause (text), clause_start, at (in the clause), word."""
    rows = cut.select("document_id", "field", "clause_no", F.col("text").alias("clause"), F.col("start").alias("clause_start"), F.explode(_places(F.col("text"), pack.action)).alias("a"))
    return rows.select("document_id", "field", "clause_no", "clause", "clause_start", "a.at", "a.word")


def action_blocked(actions: DataFrame, pack: Pack) -> DataFrame:
    """``actions`` with the reason why an action is no offer to act, each looked for in a window of its own; ok if none."""
    end = F.col("at") + F.length("word")
    before, after = F.substring("clause", F.lit(1), F.col("at")), F.substring("clause", end + 1, F.length("clause"))
    prefix, follow = F.right(before, F.lit(BEFORE)), F.left(after, F.lit(AFTER))
    local = F.concat(F.regexp_extract(before, f"[^{pack.step}]*$", 0), "word", F.left(F.regexp_extract(after, f"^[^{pack.step}]*", 0), F.lit(NEAR)))
    since = F.regexp_replace(prefix, f"(?s)^.*(?:{pack.current})", "")
    rules = [
        ("negated", prefix.rlike(pack.negated)), ("closed", follow.rlike(pack.closed)), ("unavailable", follow.rlike(pack.unavailable)), ("record", local.rlike(pack.record)), ("menu", local.rlike(pack.menu)),
        ("past", since.rlike(pack.past)), ("administration", local.rlike(pack.admin)),
    ]
    return actions.withColumns({"blocked": first_reason(rules), "instructed": before.rlike(pack.instruction)})


def topic_mentions(cut: DataFrame, topics: DataFrame) -> DataFrame:
    """document_id, field, clause_no, clause_start, topic, at and size of each topic phrase in a clause. ``topics``: topic,
    phrase."""
    places = phrase_places(cut.select("document_id", "field", "clause_no", F.col("start").alias("clause_start"), "text"), topics.select("phrase"))
    return places.join(topics.select("topic", "phrase").distinct(), "phrase").select("document_id", "field", "clause_no", "clause_start", "topic", "size", "at")


def topic_context(mentions: DataFrame, actions: DataFrame) -> DataFrame:
    """document_id, field, topic, start and context of every mention: opportunity where an action that is not blocked
    stands near, in the same clause and with no other topic between; else subject in a title, incidental in a body."""
    key = ["document_id", "field", "clause_no"]
    free = actions.where("blocked = 'ok'").select(*key, F.col("at").alias("a"), F.length("word").alias("n"))
    others = mentions.groupBy(*key).agg(F.collect_list(F.struct("topic", "at", "size")).alias("others"))  # of one clause
    pairs = mentions.join(free, key, "left").join(others, key)
    first = F.col("a") + F.col("n") <= F.col("at")
    low, high = F.when(first, F.col("a") + F.col("n")).otherwise(F.col("at") + F.col("size")), F.when(first, F.col("at")).otherwise(F.col("a"))
    pairs = pairs.withColumns({"low": low, "high": high})
    rival = F.exists("others", lambda o: (o["topic"] != F.col("topic")) & (o["at"] >= F.col("low")) & (o["at"] + o["size"] <= F.col("high")))
    linked = F.col("a").isNotNull() & (F.col("high") - F.col("low") <= GAP) & ~rival
    per = pairs.groupBy("document_id", "field", "topic", (F.col("clause_start") + F.col("at")).alias("start")).agg(F.max(F.coalesce(linked, F.lit(False))).alias("linked"))
    return per.select("document_id", "field", "topic", "start", F.when(F.col("linked"), "opportunity").when(F.col("field") == "title", "subject").otherwise("incidental").alias("context"))


def document_link(contexts: DataFrame, actions: DataFrame, mentions: DataFrame, titles: DataFrame, pack: Pack) -> DataFrame:
    """``contexts`` with title subjects resolved: with an instruction in the body that names no topic, the one subject
    of a title without rivals becomes an opportunity, others are uncertain (link_unknown)."""
    named = mentions.select("document_id", "field", "clause_no").distinct()
    told = actions.where("field = 'body_text' AND blocked = 'ok' AND instructed").join(named, ["document_id", "field", "clause_no"], "left_anti").select("document_id").distinct().withColumn("told", F.lit(True))
    title = F.col("field") == "title"
    own = contexts.groupBy("document_id").agg(F.collect_set(F.when(title & (F.col("context") != "incidental"), F.col("topic"))).alias("title_topics"), F.collect_set(F.when(~title & (F.col("context") == "opportunity"), F.col("topic"))).alias("body_topics"))
    plain = titles.select("document_id", F.col("title").rlike(pack.results + "|" + pack.admin).alias("other"))
    rows = contexts.join(own, "document_id").join(told, "document_id", "left").join(plain, "document_id", "left")
    open_ = title & (F.col("context") == "subject") & F.coalesce("told", F.lit(False)) & ~F.coalesce("other", F.lit(False))
    one = (F.size("title_topics") == 1) & (F.size(F.array_except("body_topics", "title_topics")) == 0)
    context = F.when(open_, F.when(one, "opportunity").otherwise("uncertain")).otherwise(F.col("context"))
    return rows.select("document_id", "field", "topic", "start", context.alias("context"), F.when(open_ & ~one, F.lit("topic_action_link_unknown")).alias("unknown"))


def recruitment_topic(cut: DataFrame, actions: DataFrame, titles: DataFrame, pack: Pack) -> DataFrame:
    """document_id and context of the recruitment topic, which needs its own pair of words: a title with the pair and a
    body that offers it now, or that instructs to act; suspended recruitment makes it incidental, both uncertain."""
    clause = cut.select("document_id", "field", F.col("text").rlike(pack.pair).alias("pair"), F.col("text").rlike(pack.pair_present).alias("present"), F.col("text").rlike(pack.pair_unavailable).alias("off"))
    body, title = F.col("field") == "body_text", F.col("field") == "title"
    per = clause.groupBy("document_id").agg(F.max(title & F.col("pair")).alias("titled"), F.max(body & F.col("pair") & F.col("present")).alias("offered"), F.max(body & F.col("pair")).alias("bodied"), F.max(F.col("off")).alias("off"))
    told = actions.where("field = 'body_text' AND blocked = 'ok' AND instructed").select("document_id").distinct().withColumn("told", F.lit(True))
    rows = per.join(told, "document_id", "left").join(titles.select("document_id", F.col("title").rlike(pack.results).alias("results")), "document_id", "left")
    proof = F.col("offered") | (F.col("titled") & F.coalesce("told", F.lit(False)))
    titled = F.col("titled") & ~F.col("results")
    context = F.when(proof & F.col("off"), "uncertain").when(F.col("off"), "incidental").when(proof, "opportunity").when(titled, "uncertain").otherwise("incidental")
    return rows.where(F.col("titled") | F.col("bodied")).select("document_id", context.alias("context"))


def notice_category(docs: DataFrame, actions: DataFrame, recruitment: DataFrame, contexts: DataFrame, pack: Pack) -> DataFrame:
    """document_id and category: reference, opportunity, information or unknown."""
    acts = actions.where("blocked = 'ok'").select("document_id").union(recruitment.where("context = 'opportunity'").select("document_id")).distinct().withColumn("acts", F.lit(True))
    primary = contexts.where("field = 'title' AND context = 'opportunity'").select("document_id").distinct().withColumn("prime", F.lit(True))
    rows = docs.select("document_id", "title", "body_text").join(acts, "document_id", "left").join(primary, "document_id", "left")
    reference = F.col("title").rlike(pack.results) | (F.col("title").rlike(pack.admin) & F.col("prime").isNull())
    kind = F.when(reference, "reference").when(F.col("acts"), "opportunity").when(F.trim("body_text") != "", "information").otherwise("unknown")
    return rows.select("document_id", kind.alias("category"))


def audience_clauses(cut: DataFrame, pack: Pack) -> DataFrame:
    """document_id, clause_no, said and negated of each clause that names an audience."""
    before = F.regexp_extract("text", rf"(?s)^(.*?)(?:{pack.audience})", 1)
    rows = cut.where(F.col("text").rlike(pack.audience))
    return rows.select("document_id", "clause_no", F.regexp_extract("text", pack.audience, 1).alias("said"), before.rlike(pack.refused).alias("negated"))


def unsupported_conditions(cut: DataFrame, pack: Pack) -> DataFrame:
    """document_id, field, start and excerpt of each condition that no profile can answer."""
    named = lambda f: lambda m: F.struct(F.lit(f).alias("field"), m["at"].alias("at"), m["word"].alias("excerpt"))
    found = F.flatten(F.array(*(F.transform(_places(F.col("text"), p), named(f)) for f, p in pack.unsupported)))
    rows = cut.select("document_id", "start", F.explode(found).alias("m"))
    return rows.select("document_id", F.col("m.field").alias("field"), (F.col("start") + F.col("m.at")).alias("start"), F.col("m.excerpt").alias("excerpt"))


def section_conditions(docs: DataFrame, pack: Pack) -> DataFrame:
    """document_id, number and text of the numbered conditions of a requirements section, up to the next heading."""
    after = F.element_at(F.split("body_text", pack.section, 2), 2)
    section = F.get(F.split(F.when(F.size(F.split("body_text", pack.section, 2)) > 1, after), pack.next_section, 2), F.lit(0))
    rows = docs.select("document_id", F.posexplode(F.regexp_extract_all(section, F.lit(pack.numbered), F.lit(1))).alias("i", "text"))
    return rows.select("document_id", (F.col("i") + 1).alias("number"), "text")


def _moment(said: Column, late: bool) -> Column:
    """Seconds (Shanghai) of a date with or without a clock; a day ends at 23:59:59, 24:00 is the next day."""
    day, clock = F.regexp_extract(said, r"^([0-9-]+)", 1), F.regexp_extract(said, r" ([0-9]{1,2}:[0-9]{2})$", 1)
    date = F.try_to_timestamp(day, F.lit("yyyy-M-d"))
    hour, minute = F.split_part(clock, F.lit(":"), F.lit(1)).try_cast("int"), F.split_part(clock, F.lit(":"), F.lit(2)).try_cast("int")
    seconds = F.when(clock == "", 86399 if late else 0).when((hour == 24) & (minute == 0), 86400).when((hour < 24) & (minute < 60), hour * 3600 + minute * 60)
    return F.unix_seconds(F.to_utc_timestamp(date, "Asia/Shanghai")) + seconds


def date_tokens(text: Column, pack: Pack) -> Column:
    """The dates of a clause in order: said, before and after (the text up to the next ones), date (as said, with its
    year), early and late moments. A date without a year takes that of the date before it if the two are the ends of one
    stretch, and that year is handed on; without one, or if its clock goes on, its moments are null."""
    said, pieces = F.regexp_extract_all(text, F.lit(f"({pack.date})"), F.lit(1)), F.split(text, pack.date, -1)
    found = F.transform(said, lambda x, i: F.struct(x.alias("said"), F.get(pieces, i).alias("before"), F.get(pieces, i + 1).alias("after")))
    year = lambda x: F.regexp_extract(x, "^(20[0-9]{2})-", 1)

    def hand_on(state: Column, x: Column) -> Column:
        own = year(x["said"])
        now = F.when(own != "", own).when(x["before"].rlike(pack.range), state["year"]).otherwise("")
        full = F.when(own != "", x["said"]).when(now != "", F.concat(now, F.lit("-"), x["said"]))
        return F.struct(now.alias("year"), F.array_append(state["dates"], F.struct(x["said"].alias("said"), x["before"].alias("before"), x["after"].alias("after"), full.alias("date"))).alias("dates"))

    none = F.array().cast("array<struct<said:string,before:string,after:string,date:string>>")
    dated = F.aggregate(found, F.struct(F.lit("").alias("year"), none.alias("dates")), hand_on)["dates"]
    moment = lambda x, late: F.when(~x["after"].rlike(pack.more_clock), _moment(x["date"], late))
    return F.transform(dated, lambda x: F.struct(x["said"], x["before"], x["after"], x["date"], moment(x, False).alias("early"), moment(x, True).alias("late")))


def time_facts(cut: DataFrame, published: DataFrame, pack: Pack) -> DataFrame:
    """document_id, clause_no, opens_at, deadline_at, lower_at and unknown of each clause about time. ``published``:
    document_id, published_date. Two dates are an opening and a deadline where the clause speaks of both or of a period."""
    text = F.col("text")
    rows = cut.where(text.rlike(f"{pack.deadline}|{pack.opening}|{pack.relative}|{pack.period}")).join(published, "document_id")
    rows = rows.withColumns({"d": date_tokens(text, pack), "due": text.rlike(pack.deadline), "opens": text.rlike(pack.opening), "rel": text.rlike(pack.relative), "period": text.rlike(pack.period)})
    n = F.size("d")
    first, second = F.get("d", F.lit(0)), F.get("d", F.lit(1))
    today = F.unix_seconds(F.to_utc_timestamp(F.col("published_date").cast("timestamp"), "Asia/Shanghai"))
    both = (n == 2) & ((F.col("opens") & F.col("due")) | F.col("period"))
    one_opens, one_due = F.col("opens") & ~F.col("due"), F.col("due")
    rows = rows.withColumn("both", both)
    opens = F.when(both, first["early"]).when(one_opens & (n == 1), first["early"]).when(F.col("rel"), today)
    due = F.when(both, second["late"]).when(one_due & (n == 1), first["late"])
    rows = rows.withColumns({"o": opens, "e": due})
    wrong = F.when(F.col("both"), F.col("o").isNull() | F.col("e").isNull() | (F.col("o") > F.col("e"))).when(n == 1, F.when(one_due, F.col("e").isNull()).otherwise(F.col("o").isNull()))
    zones = F.regexp_extract_all("text", F.lit(pack.zone), F.lit(1))
    foreign = text.rlike(pack.foreign_zone) | F.exists(zones, lambda z: ~z.isin(*pack.local_zones))
    code = first_reason([
        ("time_unrecognized", text.rlike(pack.deferred)), ("unsupported_timezone", foreign), ("year_missing", text.rlike(pack.yearless) | F.exists("d", lambda x: x["date"].isNull())),
        ("ambiguous_time", (n > 2) | ((n == 2) & ~F.col("both")) | ((n == 1) & F.col("period") & ~one_opens & ~one_due)), ("time_unrecognized", (n == 0) & ~F.col("rel")), ("invalid_time", wrong),
    ], "")
    lower = F.when(one_due & (n == 1) & text.rlike(pack.before_day) & ~first["said"].contains(" "), first["early"])
    rows = rows.withColumns({"code": code, "l": lower})
    good = F.col("code") == ""
    return rows.select("document_id", "field", "clause_no", "text", F.when(good, F.col("o")).alias("opens_at"), F.when(good, F.col("e")).alias("deadline_at"), F.when(good, F.col("l")).alias("lower_at"), F.when(~good, F.col("code")).alias("unknown"))


def time_resolution(times: DataFrame) -> DataFrame:
    """document_id, opens_at, deadline_at, deadline_lower_at and unknowns: one opening and one deadline, or none. A clause
    that is not understood voids both, and so does an opening after the deadline."""
    one = lambda c: F.when(F.count_distinct(c) == 1, F.max(c))
    per = times.groupBy("document_id").agg(
        one("opens_at").alias("o"), one("deadline_at").alias("e"), one("lower_at").alias("l"), F.count_distinct("opens_at").alias("no"), F.count_distinct("deadline_at").alias("ne"), F.array_sort(F.collect_set("unknown")).alias("u"),
    )
    bad, crossed = F.size("u") > 0, F.coalesce(F.col("o") > F.col("e"), F.lit(False))
    conflict = (F.col("no") > 1) | (F.col("ne") > 1) | (crossed & ~bad)
    keep = ~bad & ~crossed
    rows = per.withColumns({"opens_at": F.when(keep, F.col("o")), "deadline_at": F.when(keep, F.col("e"))})
    codes = F.concat("u", F.array_compact(F.array(F.when(conflict, F.lit("conflicting_evidence")), F.when(keep & F.col("l").isNotNull() & F.col("deadline_at").isNotNull(), F.lit("imprecise_deadline")))))
    return rows.select("document_id", "opens_at", "deadline_at", F.when(F.col("deadline_at").isNotNull(), F.col("l")).alias("deadline_lower_at"), codes.alias("unknowns"))


def media_dependence(docs: DataFrame, pack: Pack) -> DataFrame:
    """document_id and incomplete: only media, or a key condition that points to them. ``docs``: body_text, media (n)."""
    only = (F.col("media") > 0) & (F.trim(F.coalesce("body_text", F.lit(""))) == "")
    points = F.coalesce(F.col("body_text").rlike(pack.media), F.lit(False))
    return docs.select("document_id", (only | points).alias("incomplete"))


def notice_facts(category: DataFrame, contexts: DataFrame, asked: DataFrame, hard: DataFrame, times: DataFrame, media: DataFrame) -> DataFrame:
    """One row a document: category, topics, constraints, times, completeness and the digest of it all."""
    topics = contexts.groupBy("document_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "topic", "context"))).alias("topics"))
    said = asked.groupBy("document_id").agg(F.array_sort(F.array_compact(F.collect_set(F.when(F.col("field") != "other", F.concat_ws(":", "field", "operator", F.array_join("values", "|")))))).alias("constraints"), F.min("complete").alias("whole"))
    more = hard.groupBy("document_id").agg(F.array_sort(F.collect_set("field")).alias("unsupported"))
    none = F.array().cast("array<string>")
    rows = category.join(topics, "document_id", "left").join(said, "document_id", "left").join(more, "document_id", "left").join(times, "document_id", "left").join(media, "document_id", "left")
    rows = rows.select(
        "document_id", "category", F.coalesce("topics", none).alias("topics"), F.coalesce("constraints", none).alias("constraints"), F.col("whole").isNotNull().alias("audience_declared"),
        (F.coalesce("whole", F.lit(False)) & F.col("unsupported").isNull() & ~F.coalesce("incomplete", F.lit(False))).alias("eligibility_complete"), "opens_at", "deadline_at", "deadline_lower_at", F.coalesce("incomplete", F.lit(False)).alias("information_incomplete"),
    )
    return rows.withColumn("facts_sha256", digest(**{c: F.col(c) for c in rows.columns}))


def deadline_evidence(times: DataFrame, resolved: DataFrame, quotes: DataFrame) -> DataFrame:
    """document_id, quote_no and supported: the clause that a quote stands in must alone give the notice's deadline."""
    own = times.where("deadline_at IS NOT NULL").select("document_id", "text", F.col("deadline_at").alias("alone"))
    proven = own.join(resolved.select("document_id", "deadline_at"), "document_id").where(F.col("alone") == F.col("deadline_at")).select("document_id", "text")
    rows = quotes.join(proven, "document_id", "left")
    return rows.groupBy("document_id", "quote_no").agg(F.coalesce(F.max(F.contains("text", "quote")), F.lit(False)).alias("supported"))


def topic_candidates(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """document_id, topic of each topic with a phrase in title or body."""
    return phrase_hits(docs, topics.select("phrase")).join(topics, "phrase").select("document_id", "topic").distinct()
