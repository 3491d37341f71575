"""Data-quality packs and review metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..registry import query
from ..sources.bindings import oracle, view

#: (table, key, rule, predicate that a row must meet); a null result counts as met.
CHECKS = [
    ("notice", "document_id", "status_domain", "status IN ('discovered', 'processed', 'failed')"),
    ("notice", "document_id", "processed_has_success", "status <> 'processed' OR last_success_at IS NOT NULL"),
    ("notice", "document_id", "attempt_after_success", "last_attempt_at >= last_success_at"),
    ("notice", "document_id", "failed_has_code", "status <> 'failed' OR last_error_code IS NOT NULL"),
    ("notice", "document_id", "failed_never_succeeded", "status <> 'failed' OR last_success_at IS NULL"),
    ("response", "id", "body_when_200", "status_code <> 200 OR body_sha256 IS NOT NULL"),
    ("response", "id", "no_redirect", "final_url = requested_url"),
    ("message", "mail_id", "accepted_has_time", "state <> 'accepted' OR accepted_at IS NOT NULL"),
    ("attempt", "mail_id", "finished_after_start", "finished_at >= started_at"),
    ("attempt", "mail_id", "outcome_when_finished", "finished_at IS NULL OR outcome IS NOT NULL"),
    ("event", "event_id", "due_not_before_event", "due_at >= occurred_at"),
]
_CHECKED = ("notice", "response", "message", "attempt", "event")


@query("check_violations", oracle(" UNION ALL ".join(f"SELECT '{t}' AS tbl, '{r}' AS rule, {k} AS key FROM {t} WHERE NOT ({p})" for t, k, r, p in CHECKS), *_CHECKED))
def _(spark, sf):
    found = []
    for t in _CHECKED:
        own = [c for c in CHECKS if c[0] == t]
        broken = F.explode(F.array_compact(F.array(*(F.when(~F.expr(p), F.lit(r)) for _, _, r, p in own))))
        found.append(view(spark, sf, t).select(F.lit(t).alias("tbl"), broken.alias("rule"), F.col(own[0][1]).alias("key")))
    return reduce(lambda a, b: a.unionByName(b), found)


UNIQUE = [("attempt", ("mail_id", "attempt_no")), ("notice", ("document_id",)), ("version", ("document_id", "raw_sha")), ("response", ("requested_url",))]


@query("unique_violations", oracle(" UNION ALL ".join(f"SELECT '{t}' AS tbl, concat_ws(':', {', '.join(f'CAST({k} AS VARCHAR)' for k in ks)}) AS key, count(*) AS n FROM {t} GROUP BY {', '.join(ks)} HAVING count(*) > 1" for t, ks in UNIQUE), "attempt", "notice", "version", "response"))
def _(spark, sf):
    one = lambda t, ks: view(spark, sf, t).groupBy(*ks).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(t).alias("tbl"), F.concat_ws(":", *(F.col(k).cast("string") for k in ks)).alias("key"), "n")
    return reduce(lambda a, b: a.unionByName(b), (one(*u) for u in UNIQUE))


FOREIGN = [("attempt", "mail_id", "message", "mail_id"), ("response", "validated_response_id", "response", "id"), ("notice", "current_version_id", "version", "version_id"), ("event", "document_id", "notice", "document_id")]


@query("fk_violations", oracle(" UNION ALL ".join(f"SELECT '{t}.{c}' AS reference, {c} AS key, count(*) AS n FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {p} FROM {u}) GROUP BY {c}" for t, c, u, p in FOREIGN), "attempt", "message", "response", "notice", "version", "event"))
def _(spark, sf):
    def one(t, c, u, p):
        child, parent = view(spark, sf, t).where(f"{c} IS NOT NULL").select(F.col(c).alias("key")), view(spark, sf, u).select(F.col(p).alias("key"))
        return child.groupBy("key").agg(F.count("*").alias("n")).join(parent, "key", "left_anti").select(F.lit(f"{t}.{c}").alias("reference"), "key", "n")

    return reduce(lambda a, b: a.unionByName(b), (one(*f) for f in FOREIGN))


@query("pointer_violations", oracle("SELECT n.document_id, CASE WHEN v.version_id IS NULL THEN 'missing' ELSE 'older_than_newest' END AS code FROM notice n LEFT JOIN version v ON n.current_version_id = v.version_id WHERE v.version_id IS NULL OR v.k = 0", "notice", "version"))
def _(spark, sf):
    v = view(spark, sf, "version").select(F.col("version_id").alias("current_version_id"), "k")
    both = view(spark, sf, "notice").join(v, "current_version_id", "left").where("k IS NULL OR k = 0")
    return both.select("document_id", F.when(F.col("k").isNull(), "missing").otherwise("older_than_newest").alias("code"))


_POINTS = [("notice", "current_version_id", "version", "version_id"), ("response", "validated_response_id", "response", "id"), ("attempt", "mail_id", "message", "mail_id"), ("event", "document_id", "notice", "document_id")]


@query("integrity_totals", oracle(" UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n, count({c}) AS refs, count(*) FILTER ({c} IS NOT NULL AND {c} NOT IN (SELECT {p} FROM {u})) AS orphans FROM {t}" for t, c, u, p in _POINTS), "notice", "version", "response", "attempt", "message", "event"))
def _(spark, sf):
    def one(t, c, u, p):
        parent = view(spark, sf, u).select(F.col(p).alias("key")).distinct().withColumn("held", F.lit(True))
        rows = view(spark, sf, t).select(F.col(c).alias("key")).join(parent, "key", "left")
        return rows.agg(F.lit(t).alias("tbl"), F.count("*").alias("n"), F.count("key").alias("refs"), F.count_if(F.col("key").isNotNull() & F.col("held").isNull()).alias("orphans"))

    return reduce(lambda a, b: a.unionByName(b), (one(*p) for p in _POINTS))


@query("confusion", oracle("SELECT actual, predicted, count(*) AS n FROM review WHERE NOT mismatch GROUP BY ALL", "review"))
def _(spark, sf):
    return view(spark, sf, "review").where("NOT mismatch").groupBy("actual", "predicted").agg(F.count("*").alias("n"))


@query("reminder_rates", oracle("""SELECT source_id, tp, fn, fp, tn, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision FROM (
SELECT source_id, count(*) FILTER (a AND p) AS tp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (NOT a AND NOT p) AS tn
FROM (SELECT source_id, actual IN ('PUSH_NOW', 'DIGEST') AS a, predicted IN ('PUSH_NOW', 'DIGEST') AS p FROM review WHERE NOT mismatch) GROUP BY source_id)""", "review"))
def _(spark, sf):
    a, p = F.col("actual").isin("PUSH_NOW", "DIGEST"), F.col("predicted").isin("PUSH_NOW", "DIGEST")
    out = view(spark, sf, "review").where("NOT mismatch").groupBy("source_id").agg(F.count_if(a & p).alias("tp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"))
    rate = lambda x, y: F.round(F.try_divide(F.col(x), F.col(x) + F.col(y)), 6)
    return out.withColumns({"recall": rate("tp", "fn"), "precision": rate("tp", "fp")})


@query("urgent_misses", oracle("SELECT source_id, item_id, predicted FROM review WHERE NOT mismatch AND actual = 'PUSH_NOW' AND predicted <> 'PUSH_NOW'", "review"))
def _(spark, sf):
    return view(spark, sf, "review").where("NOT mismatch AND actual = 'PUSH_NOW' AND predicted <> 'PUSH_NOW'").select("source_id", "item_id", "predicted")


@query("replay_summary", oracle("SELECT predicted, count(*) AS n, count(*) FILTER (actual <> predicted) AS mismatches, count(*) FILTER (mismatch) AS needs_review FROM review GROUP BY predicted", "review"))
def _(spark, sf):
    return view(spark, sf, "review").groupBy("predicted").agg(F.count("*").alias("n"), F.count_if(F.col("actual") != F.col("predicted")).alias("mismatches"), F.count_if("mismatch").alias("needs_review"))


@query("label_validity", "SELECT doc_id, CASE WHEN quality NOT IN (0, 1) THEN 'quality_domain' WHEN toxic NOT IN (0, 1) THEN 'toxic_domain' WHEN doc_id NOT IN (SELECT doc_id FROM documents) THEN 'unknown_item' ELSE 'ok' END AS code FROM labels")
def _(spark, sf):
    known = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lit(True).alias("known"))
    code = F.when(~F.col("quality").isin(0, 1), "quality_domain").when(~F.col("toxic").isin(0, 1), "toxic_domain").when(F.col("known").isNull(), "unknown_item").otherwise("ok")
    return spark.read.parquet(f"{sf}/labels.parquet").join(known, "doc_id", "left").select("doc_id", code.alias("code"))
