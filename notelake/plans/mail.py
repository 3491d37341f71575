"""Queries on digest texts, plans and passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery, mail
from ..registry import query
from ..sources.bindings import oracle, view
from .delivery import _AT, _PACKED

_ITEM = [
    "event_id", "title", "body_text", "published_date", "CASE WHEN event_id % 3 = 0 THEN 'update' ELSE 'new' END AS kind", "CASE WHEN route = 'immediate' THEN 'PUSH_NOW' ELSE 'DIGEST' END AS action", "event_id % 4 = 1 AS needs_review",
]
_REASONS, _UNKNOWNS = "sequence(1, event_id % 11)", "sequence(1, event_id % 10)"


def _items(spark, sf):
    rows = view(spark, sf, "event").where("route <> 'none'").join(view(spark, sf, "notice").select("document_id", "title", "body_text", "published_date"), "document_id")
    lines = lambda n, word: F.when(F.expr(f"event_id % {n} = 0"), F.array().cast("array<string>")).otherwise(F.transform(F.expr(f"sequence(1, CAST(event_id % {n} AS INT))"), lambda i: F.concat(F.lit(word + " "), i.cast("string"))))
    return rows.select(*map(F.expr, _ITEM), lines(11, "reason").alias("reasons"), lines(10, "unknown").alias("unknowns"))


_L = mail.LABELS
_VISIBLE = r"trim(regexp_replace({}, '[\p{{C}}\s]+', ' ', 'g'))"
_CUT = "CASE WHEN length({0}) > {1} THEN substr({0}, 1, {1} - 1) || '…' ELSE {0} END"
_LISTED = "(SELECT coalesce(string_agg('- {1} ' || i, chr(10) ORDER BY i), '') FROM range(1, least(event_id % {0}, 8) + 1) r(i)) || CASE WHEN event_id % {0} > 8 THEN chr(10) || '" + _L["more"] + "' || (event_id % {0} - 8) ELSE '' END"
_TEXT = rf"""itm AS (SELECT e.event_id, e.installation, e.slot, {_VISIBLE.format('title')} AS t, {_VISIBLE.format('body_text')} AS b, published_date, CASE WHEN event_id % 3 = 0 THEN 'update' ELSE 'new' END AS kind, CASE WHEN route = 'immediate' THEN 'PUSH_NOW' ELSE 'DIGEST' END AS action, event_id % 4 = 1 AS needs_review
FROM event e JOIN notice n ON n.document_id = e.document_id WHERE route <> 'none'),
txt AS (SELECT event_id, needs_review, concat_ws(chr(10), {_CUT.format('t', 180)}, '{_L["published"]}' || strftime(published_date, '%Y-%m-%d'), '{_L["event"]}' || kind, '{_L["decision"]}' || action, CASE WHEN needs_review THEN '{_L["review"]}' END, '{_L["reasons"]}',
CASE WHEN event_id % 11 = 0 THEN '{_L["no_reason"]}' ELSE {_LISTED.format(11, 'reason')} END, CASE WHEN event_id % 10 > 0 THEN '{_L["unknowns"]}' || chr(10) || {_LISTED.format(10, 'unknown')} END, '{_L["excerpt"]}', CASE WHEN b = '' THEN '{_L["no_text"]}' ELSE {_CUT.format('b', 400)} END, CASE WHEN length(b) > 400 THEN '{_L["cut"]}' END) AS text FROM itm)"""


@query("digest_items", oracle(f"WITH {_TEXT} SELECT * FROM txt", "event", "notice"))
def _(spark, sf):
    return mail.digest_items(_items(spark, sf))


@query("digest_documents", oracle(f"""WITH {_TEXT}, {_PACKED}, num AS (SELECT f.installation, f.slot, f.part, needs_review, row_number() OVER (PARTITION BY f.installation, f.slot, f.part, needs_review ORDER BY position) || '.' || chr(10) || text AS x, position FROM fold f JOIN txt USING (event_id) WHERE part IS NOT NULL),
sec AS (SELECT installation, slot, part, needs_review, count(*) AS n, CASE WHEN needs_review THEN '{_L["checked"]}' ELSE '{_L["regular"]}' END || chr(10) || string_agg(x, chr(10) ORDER BY position) AS s FROM num GROUP BY installation, slot, part, needs_review)
SELECT installation, slot, part, CAST(sum(n) AS BIGINT) AS items, sha256(string_agg(s, chr(10) || chr(10) ORDER BY needs_review) || chr(10)) AS body_sha256 FROM sec GROUP BY installation, slot, part""", "event", "notice").replace("WITH event", "WITH RECURSIVE event"))
def _(spark, sf):
    out = mail.digest_documents(delivery.digest_packing(view(spark, sf, "event"), 1500, 3), mail.digest_items(_items(spark, sf)))
    return out.select("installation", "slot", "part", "items", F.sha2("body", 256).alias("body_sha256"))


_CAPACITY = """imm AS (SELECT installation, count(*) AS waiting FROM event WHERE route = 'immediate' AND NOT allocated AND item_bytes <= 1500 GROUP BY installation),
par AS (SELECT installation, count(DISTINCT (slot, part)) AS parts FROM fold WHERE part IS NOT NULL GROUP BY installation),
cap1 AS (SELECT coalesce(i.installation, p.installation) AS installation, coalesce(waiting, 0) AS w, coalesce(parts, 0) AS p, least(coalesce(waiting, 0), 40 - CASE WHEN coalesce(parts, 0) > 0 THEN 1 ELSE 0 END) AS f FROM imm i FULL JOIN par p ON i.installation = p.installation),
cap AS (SELECT installation, f + least(w - f, 40 - f - least(p, 40 - f)) AS immediate, least(p, 40 - f) AS digests, w - f - least(w - f, 40 - f - least(p, 40 - f)) AS immediate_left, p - least(p, 40 - f) AS parts_left FROM cap1)"""


def _capacity(spark, sf):
    events = view(spark, sf, "event")
    packed = delivery.digest_packing(events, 1500, 3)
    parts = packed.where("part IS NOT NULL").select("installation", "slot", "part").distinct()
    return events, packed, mail.plan_capacity(events.where("route = 'immediate' AND NOT allocated AND item_bytes <= 1500"), parts, 40)


@query("plan_capacity", oracle(f"WITH {_PACKED}, {_CAPACITY} SELECT * FROM cap", "event").replace("WITH event", "WITH RECURSIVE event"))
def _(spark, sf):
    return _capacity(spark, sf)[2]


@query("plan_preview", oracle(f"""WITH {_PACKED}, {_CAPACITY}, im AS (SELECT *, row_number() OVER (PARTITION BY installation ORDER BY occurred_at, event_id) AS r FROM event WHERE route = 'immediate' AND NOT allocated AND item_bytes <= 1500),
pt AS (SELECT f.installation, f.slot, part, string_agg(CAST(f.event_id AS VARCHAR), ',' ORDER BY position) AS event_ids, CAST(sum(item_bytes) AS BIGINT) AS bytes FROM fold f JOIN event e ON e.event_id = f.event_id WHERE part IS NOT NULL GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY installation ORDER BY slot, part) AS r FROM pt)
SELECT im.installation, 'immediate' AS kind, NULL::BIGINT AS slot, 1 AS part, CAST(event_id AS VARCHAR) AS event_ids, item_bytes AS bytes, NULL AS code FROM im JOIN cap ON cap.installation = im.installation WHERE r <= immediate
UNION ALL SELECT pr.installation, 'digest', slot, part, event_ids, bytes, NULL FROM pr JOIN cap ON cap.installation = pr.installation WHERE r <= digests
UNION ALL SELECT installation, 'blocked', NULL, NULL, CAST(event_id AS VARCHAR), NULL, 'mail_item_too_large' FROM event WHERE route = 'immediate' AND NOT allocated AND item_bytes > 1500
UNION ALL SELECT installation, 'blocked', slot, NULL, CAST(event_id AS VARCHAR), NULL, 'mail_item_too_large' FROM fold WHERE part IS NULL""", "event").replace("WITH event", "WITH RECURSIVE event"))
def _(spark, sf):
    return mail.plan_preview(*_capacity(spark, sf), 1500)


@query("retry_grants", oracle(f"""WITH l AS (SELECT mail_id, arg_max(coalesce(outcome, ''), (attempt_no, started_at, line_id)) AS outcome, arg_max(coalesce(finished_at, -1), (attempt_no, started_at, line_id)) AS finished_at FROM attempt GROUP BY mail_id),
c AS (SELECT m.mail_id, l.outcome, l.finished_at, CASE WHEN state = 'accepted' THEN 'mail_already_accepted' WHEN state = 'sending' THEN 'mail_recovery_required' WHEN frozen_at > {_AT} THEN 'mail_clock_regressed' WHEN m.mail_id % 31 = 5 THEN 'already_granted' WHEN state <> 'blocked' THEN 'mail_manual_retry_requires_blocked' ELSE 'granted' END AS code FROM message m LEFT JOIN l ON l.mail_id = m.mail_id)
SELECT mail_id, code, CASE WHEN code = 'granted' THEN CASE WHEN outcome = 'uncertain' THEN greatest({_AT}, finished_at + 1800) ELSE {_AT} END END AS next_attempt_at FROM c""", "message", "attempt"))
def _(spark, sf):
    return mail.retry_grants(view(spark, sf, "message").withColumn("granted", F.expr("mail_id % 31 = 5")), delivery.latest_attempt(view(spark, sf, "attempt")), _AT)


@query("delivery_pass", oracle("""SELECT installation, CAST(floor(started_at / 86400) AS BIGINT) AS day, count(*) FILTER (NOT corrupt) AS attempted, count(*) FILTER (NOT corrupt AND outcome = 'accepted') AS accepted, count(*) FILTER (NOT corrupt AND outcome = 'temporary') AS retryable, count(*) FILTER (NOT corrupt AND outcome = 'uncertain') AS uncertain,
count(*) FILTER (NOT corrupt AND outcome = 'permanent') AS permanent, count(*) FILTER (corrupt) AS corrupt, count(*) FILTER (NOT corrupt AND finished_at IS NULL) AS recovered, bool_or(corrupt OR coalesce(outcome IN ('temporary', 'uncertain', 'permanent'), false)) AS needs_attention FROM (
SELECT m.installation, a.*, m.mail_id % 97 = 5 AS corrupt FROM attempt a JOIN message m ON a.mail_id = m.mail_id) GROUP BY ALL""", "message", "attempt"))
def _(spark, sf):
    return mail.delivery_pass(view(spark, sf, "attempt"), view(spark, sf, "message").withColumn("corrupt", F.expr("mail_id % 97 = 5")))


@query("delivery_key", oracle("""SELECT mail_id, CASE WHEN kind = 'digest' THEN SHA[to_json({'installation': installation, 'kind': kind, 'part': part, 'recipient': 'primary', 'slot': slot})] ELSE SHA[to_json({'document': document_id, 'event_seq': event_seq, 'installation': installation, 'recipient': 'primary'})] END AS delivery_key
FROM (SELECT mail_id, installation, kind, CAST(floor(frozen_at / 604800) AS BIGINT) AS slot, mail_id % 3 + 1 AS part, mail_id % 500 AS document_id, mail_id % 5 AS event_seq FROM message)""", "message"))
def _(spark, sf):
    rows = view(spark, sf, "message").selectExpr("*", "CAST(floor(frozen_at / 604800) AS BIGINT) AS slot", "mail_id % 3 + 1 AS part", "mail_id % 500 AS document_id", "mail_id % 5 AS event_seq", "'primary' AS recipient")
    return mail.delivery_keys(rows)
