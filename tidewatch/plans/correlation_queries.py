"""Correlation, burst and timeline queries over the alert view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.digests import as_hex16
from tidewatch.operators import burst, correlate, timeline
from tidewatch.plans.registry import query
from tidewatch.plans.views import ALERTS_SQL, alerts, table
from tidewatch.session import stored

#: The event table spans 30 days with 150 users, so its windows are hours, not seconds.
BURST, CAMPAIGN = 6 * 3600.0, 48 * 3600.0

_KEY = "ns, src, dst, proto, service"
_BASE = f"WITH RECURSIVE alerts AS ({ALERTS_SQL}), att AS (SELECT * FROM alerts WHERE decision = 'Attack' AND score >= 0.5)"
_BURST_SQL = f"""{_BASE},
bn AS (SELECT DISTINCT {_KEY}, t, min(t) OVER (PARTITION BY {_KEY} ORDER BY t RANGE BETWEEN INTERVAL '21600000001 microseconds' FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM att),
ba AS (SELECT {_KEY}, min(t) AS anchor FROM att GROUP BY {_KEY}
       UNION ALL SELECT ba.ns, ba.src, ba.dst, ba.proto, ba.service, bn.nxt FROM ba JOIN bn ON ba.ns = bn.ns AND ba.src = bn.src AND ba.dst = bn.dst AND ba.proto = bn.proto AND ba.service = bn.service AND bn.t = ba.anchor WHERE bn.nxt IS NOT NULL),
bm AS (SELECT att.*, ba.anchor FROM att ASOF JOIN ba ON att.ns = ba.ns AND att.src = ba.src AND att.dst = ba.dst AND att.proto = ba.proto AND att.service = ba.service AND att.t >= ba.anchor),
bs AS (SELECT *, count(*) OVER (PARTITION BY {_KEY}, anchor) AS size, first_value(alert_id) OVER (PARTITION BY {_KEY}, anchor ORDER BY t, alert_id) AS anchor_id FROM bm)"""
_CAMPAIGN_SQL = f"""{_BURST_SQL},
cl AS (SELECT * EXCLUDE (anchor, size, anchor_id), least(src, dst) AS a, greatest(src, dst) AS b FROM bs WHERE size = 1),
cn AS (SELECT DISTINCT ns, a, b, t, min(t) OVER (PARTITION BY ns, a, b ORDER BY t RANGE BETWEEN INTERVAL '172800000001 microseconds' FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM cl),
ca AS (SELECT ns, a, b, min(t) AS anchor FROM cl GROUP BY ns, a, b
       UNION ALL SELECT ca.ns, ca.a, ca.b, cn.nxt FROM ca JOIN cn ON ca.ns = cn.ns AND ca.a = cn.a AND ca.b = cn.b AND cn.t = ca.anchor WHERE cn.nxt IS NOT NULL),
cm AS (SELECT cl.*, ca.anchor FROM cl ASOF JOIN ca ON cl.ns = ca.ns AND cl.a = ca.a AND cl.b = ca.b AND cl.t >= ca.anchor),
cs AS (SELECT *, count(*) OVER (PARTITION BY ns, a, b, anchor) AS size, first_value(alert_id) OVER (PARTITION BY ns, a, b, anchor ORDER BY t, alert_id) AS anchor_id FROM cm),
mem AS (
  SELECT alert_id, t, score, decision, anchor, size, anchor_id, 'burst' AS rule FROM bs WHERE size > 1
  UNION ALL SELECT alert_id, t, score, decision, anchor, size, anchor_id, CASE WHEN size > 1 THEN 'campaign' ELSE 'singleton' END FROM cs),
ids AS (
  SELECT rule, anchor_id, sha256(unhex(hex(encode('tidewatch:incident')) || '00' || printf('%08x', 11) || hex(encode('incident_v1')) || printf('%08x', length(rule)) || hex(encode(rule))
         || string_agg(printf('%08x', length(CAST(alert_id AS VARCHAR))) || hex(encode(CAST(alert_id AS VARCHAR))), '' ORDER BY CAST(alert_id AS VARCHAR)))) AS incident_id
  FROM mem GROUP BY rule, anchor_id)"""


def members(spark, sf_dir) -> DataFrame:
    return correlate.correlate(correlate.verified_members(alerts(spark, sf_dir)), BURST, CAMPAIGN)


@query("w2_bursts", f"{_BURST_SQL} SELECT alert_id, epoch_us(anchor) AS anchor_us, size, anchor_id FROM bs WHERE size > 1")
def w2_bursts(spark, sf_dir):
    return members(spark, sf_dir).where("rule = 'burst'").select("alert_id", "anchor_us", "size", "anchor_id")


@query("w3_campaigns", f"{_CAMPAIGN_SQL} SELECT alert_id, rule, epoch_us(anchor) AS anchor_us, size, anchor_id FROM mem WHERE rule <> 'burst'")
def w3_campaigns(spark, sf_dir):
    return members(spark, sf_dir).where("rule <> 'burst'").select("alert_id", "rule", "anchor_us", "size", "anchor_id")


#: All alerts, benign ones too; those whose service is a number divisible by 5 are unverified.
_ALL = _CAMPAIGN_SQL.replace("att AS (SELECT * FROM alerts WHERE decision = 'Attack' AND score >= 0.5)", "att AS (SELECT * FROM alerts WHERE service <> '0')")


@query(
    "w7_incidents",
    f"""{_ALL}, whole AS (SELECT m.*, 'verified' AS status FROM mem m UNION ALL SELECT alert_id, t, score, decision, t, 1, alert_id, 'unverified', 'no_service' FROM alerts WHERE service = '0'),
wids AS (SELECT * FROM ids UNION ALL SELECT 'unverified', alert_id, sha256(unhex(hex(encode('tidewatch:incident')) || '00' || printf('%08x', 11) || hex(encode('incident_v1')) || printf('%08x', 10) || hex(encode('unverified'))
 || printf('%08x', length(CAST(alert_id AS VARCHAR))) || hex(encode(CAST(alert_id AS VARCHAR))))) FROM alerts WHERE service = '0')
SELECT i.incident_id, m.rule, m.status, count(*) AS size, max(score) AS max_score, CASE WHEN bool_or(decision = 'Attack') THEN 'Attack' ELSE max(CASE WHEN m.alert_id = m.anchor_id THEN decision END) END AS decision,
 epoch_us(min(t)) AS earliest_us, epoch_us(max(t)) AS latest_us
FROM whole m JOIN wids i ON m.rule = i.rule AND m.anchor_id = i.anchor_id GROUP BY i.incident_id, m.rule, m.status""",
)
def w7_incidents(spark, sf_dir):
    """Incidents of all alerts, attacks or not, verified or not."""
    rows = alerts(spark, sf_dir).withColumn("reject", F.when(F.col("service") == "0", "no_service"))
    made = correlate.incidents(correlate.correlate(rows, BURST, CAMPAIGN))
    return made.select("incident_id", "rule", "status", "size", "max_score", "decision", F.unix_micros("earliest").alias("earliest_us"), F.unix_micros("latest").alias("latest_us"))


@query(
    "w5_justifications",
    f"""{_CAMPAIGN_SQL} SELECT i.incident_id, m.alert_id, m.anchor_id, m.rule, epoch_us(m.t) - epoch_us(m.anchor) AS delta_us
FROM mem m JOIN ids i ON m.rule = i.rule AND m.anchor_id = i.anchor_id""",
)
def w5_justifications(spark, sf_dir):
    return members(spark, sf_dir).select("incident_id", "alert_id", "anchor_id", "rule", "delta_us")


@query(
    "a20_alert_reduction",
    f"""{_CAMPAIGN_SQL}, j AS (SELECT m.alert_id, m.decision, i.incident_id FROM mem m JOIN ids i ON m.rule = i.rule AND m.anchor_id = i.anchor_id),
-- planted faults: some members lost, some in a second incident, whose members are read as benign
k AS (SELECT alert_id, incident_id FROM j WHERE alert_id % 41 <> 0 UNION ALL SELECT alert_id, 'second' FROM j WHERE alert_id % 43 = 0),
n AS (SELECT alert_id, count(DISTINCT incident_id) AS n FROM k GROUP BY alert_id)
SELECT (SELECT count(*) FROM att) AS alerts, (SELECT count(DISTINCT incident_id) FROM k) AS incidents, 1 - (SELECT count(DISTINCT incident_id) FROM k) / (SELECT count(*) FROM att) AS reduction,
 (SELECT count_if(coalesce(n, 0) <> 1) FROM att LEFT JOIN n USING (alert_id)) AS misplaced, (SELECT count(*) FROM j WHERE alert_id % 43 = 0) AS downgraded""",
)
def a20_alert_reduction(spark, sf_dir):
    """The report over members with planted faults, so that its invariants have something to find."""
    found = stored(members(spark, sf_dir), "members")
    second = found.where("alert_id % 43 = 0").withColumns({"incident_id": F.lit("second"), "anchor_id": F.lit(-1).cast("long")})
    faulty = found.where("alert_id % 41 <> 0").unionByName(second)
    return correlate.reduction(faulty, correlate.verified_members(alerts(spark, sf_dir)), F.when(F.col("incident_id") == "second", "Benign"))


_PROV = """named_struct('entity_namespace_id', if(user_id % 11 = 0, null, concat('ns', user_id % 3)), 'clock_synchronized', user_id % 7 <> 0,
 'src_entity_id', if(user_id % 13 = 0, ' ', concat('u', user_id)), 'dst_entity_id', concat('svc_', event_type), 'address_reuse_or_nat', event_type = 'error' and user_id % 2 = 0,
 'max_clock_skew_seconds', value / 20.0, 'observed_at_utc', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'validity_start_utc', if(user_id % 5 = 0, '2024-01-10T00:00:00', null),
 'validity_end_utc', if(user_id % 17 = 0, 'never', null)) as prov"""
_REASON_SQL = """CASE WHEN user_id % 11 = 0 THEN 'missing_entity_namespace' WHEN user_id % 7 = 0 THEN 'clock_not_synchronized' WHEN user_id % 13 = 0 THEN 'missing_src_entity_id'
 WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'nat_address_reuse_ambiguous' WHEN value / 20.0 > 5 OR value < 0 OR value IS NULL OR isnan(value) THEN 'clock_skew_exceeded'
 WHEN user_id % 5 = 0 AND date_trunc('second', ts) < TIMESTAMP '2024-01-10' THEN 'outside_entity_validity_interval' WHEN user_id % 17 = 0 THEN 'invalid_timestamp_bounds' END"""


@query("w1_provenance_verdicts", f"SELECT event_id, {_REASON_SQL} AS reason FROM events")
def w1_provenance_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", _PROV)
    return rows.select("event_id", correlate.rejection_reason().alias("reason"))


@query("w4_unverified", f"SELECT event_id AS alert_id, 'unverified' AS rule, {_REASON_SQL} AS status FROM events WHERE {_REASON_SQL} IS NOT NULL")
def w4_unverified(spark, sf_dir):
    prov = table(spark, sf_dir, "events").selectExpr("event_id as alert_id", _PROV).select("alert_id", correlate.rejection_reason().alias("reject"))
    rows = alerts(spark, sf_dir).join(prov, "alert_id", "left")
    return correlate.correlate(rows, BURST, CAMPAIGN).where("rule = 'unverified'").select("alert_id", "rule", "status")


@query(
    "j3_incident_of_alert",
    f"""{_CAMPAIGN_SQL}, j AS (SELECT m.alert_id, i.incident_id FROM mem m JOIN ids i ON m.rule = i.rule AND m.anchor_id = i.anchor_id)
SELECT incident_id, string_agg(CAST(alert_id AS VARCHAR), ',' ORDER BY alert_id) AS alert_ids FROM j GROUP BY incident_id""",
)
def j3_incident_of_alert(spark, sf_dir):
    return members(spark, sf_dir).groupBy("incident_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("alert_id")), lambda x: x.cast("string")), ",").alias("alert_ids"))


@query(
    "w8_corrections",
    f"""{_CAMPAIGN_SQL}, j AS (SELECT m.*, i.incident_id FROM mem m JOIN ids i ON m.rule = i.rule AND m.anchor_id = i.anchor_id),
c AS (SELECT alert_id FROM j WHERE rule = 'burst' AND alert_id <> anchor_id AND alert_id % 3 = 0)
SELECT CASE WHEN c.alert_id IS NULL THEN j.rule ELSE 'corrected' END AS rule, count(*) AS alerts, count(DISTINCT CASE WHEN c.alert_id IS NULL THEN j.incident_id ELSE CAST(j.alert_id AS VARCHAR) END) AS incidents
FROM j LEFT JOIN c ON j.alert_id = c.alert_id GROUP BY 1""",
)
def w8_corrections(spark, sf_dir):
    found = members(spark, sf_dir)
    asked = found.where("rule = 'burst' and alert_id <> anchor_id and alert_id % 3 = 0").select(F.col("alert_id").alias("request_id"), "incident_id", "alert_id")
    done = correlate.apply_corrections(found, asked.union(asked))
    return done.groupBy("rule").agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("incident_id").alias("incidents"))


# ---- bursts

_TOKENS = ("lower(src)", "lower(dst)", "service", "proto", "''", "lower(decision)")
_HASH = "list_filter([" + ", ".join(f"CASE WHEN {t} <> '' THEN sha256(concat('{i}:', {t}))[1:16] END" for i, t in enumerate(_TOKENS)) + "], lambda x: x IS NOT NULL)"
#: Bit by bit over the hex digits: the digit of value v at place p holds bits 4 * (15 - p) + 3 .. 0.
_SIM = (
    "list_aggregate(list_transform(range(1, 17), lambda p: substr('0123456789abcdef', CAST(1 + list_sum(list_transform([8, 4, 2, 1], lambda w: "
    "CASE WHEN 2 * list_sum(list_transform(hs, lambda h: CAST((((strpos('0123456789abcdef', h[p]) - 1) // w) % 2 = 1) AS INT))) >= len(hs) THEN w ELSE 0 END)) AS INT), 1)), 'string_agg', '')"
)
_SIM_SQL = f"alerts AS ({ALERTS_SQL}), hashed AS (SELECT *, {_HASH} AS hs FROM alerts), sim AS (SELECT * EXCLUDE (hs), {_SIM} AS simhash FROM hashed)"


def simhashed(spark, sf_dir) -> DataFrame:
    return alerts(spark, sf_dir).withColumn("simhash", burst.flow_simhash(F.col("src"), F.col("dst"), F.col("service"), F.col("proto"), F.lit(None), F.col("decision")))


@query("d17_simhash", f"WITH {_SIM_SQL} SELECT alert_id, simhash FROM sim")
def d17_simhash(spark, sf_dir):
    return simhashed(spark, sf_dir).select("alert_id", as_hex16(F.col("simhash")).alias("simhash"))


@query(
    "d18_near_simhashes",
    f"""WITH {_SIM_SQL}, h AS (SELECT DISTINCT simhash, ('0x' || simhash)::UBIGINT AS v FROM sim)
SELECT least(x.simhash, y.simhash) AS a, greatest(x.simhash, y.simhash) AS b, CAST(bit_count(CAST(xor(x.v, y.v) AS HUGEINT)) AS INT) AS distance
FROM h x JOIN h y ON x.simhash < y.simhash WHERE bit_count(CAST(xor(x.v, y.v) AS HUGEINT)) <= 3""",
)
def d18_near_simhashes(spark, sf_dir):
    pairs = burst.near_simhashes(simhashed(spark, sf_dir))
    a, b = as_hex16(F.col("a")), as_hex16(F.col("b"))
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "distance")


_BURSTS_SQL = f"""WITH {_SIM_SQL}, g AS (
  SELECT *, lag(t) OVER w AS pt, ('0x' || simhash)::UBIGINT AS v, lag(('0x' || simhash)::UBIGINT) OVER w AS pv FROM sim WINDOW w AS (PARTITION BY src, dst, proto ORDER BY t, alert_id)),
n AS (SELECT *, CASE WHEN pt IS NULL OR epoch_us(t) - epoch_us(pt) > 21600000000 OR bit_count(CAST(xor(v, pv) AS HUGEINT)) > 3 THEN 1 ELSE 0 END AS new FROM g),
b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY src, dst, proto ORDER BY t, alert_id) AS BIGINT) AS burst_no FROM n)"""


@query("d19_bursts", f"{_BURSTS_SQL} SELECT alert_id, burst_no, row_number() OVER (PARTITION BY src, dst, proto, burst_no ORDER BY t, alert_id) AS burst_count, count(*) OVER (PARTITION BY src, dst, proto, burst_no) AS burst_total FROM b")
def d19_bursts(spark, sf_dir):
    return burst.bursts(simhashed(spark, sf_dir), ["src", "dst", "proto"], idle=BURST).select("alert_id", "burst_no", "burst_count", "burst_total")


@query(
    "a11_fatigue_funnel",
    f"""{_BURSTS_SQL}, r AS (SELECT (SELECT count(*) FROM sim) AS raw_weight, (SELECT count(DISTINCT simhash) FROM sim) AS clusters, (SELECT count(DISTINCT simhash) FROM sim WHERE score >= 0.9) AS sure_clusters)
SELECT *, 100.0::DOUBLE * (raw_weight - clusters) / raw_weight AS reduction_pct FROM r""",
)
def a11_fatigue_funnel(spark, sf_dir):
    return burst.fatigue_funnel(simhashed(spark, sf_dir), ["src", "dst", "proto"], idle=BURST)


# ---- order, windows and timelines


@query(
    "w9_timeline",
    """SELECT at_us, kind, ref FROM (
  SELECT epoch_us(ts) AS at_us, 'flow' AS kind, CAST(event_id AS VARCHAR) AS ref FROM events WHERE event_type = 'error'
  UNION ALL SELECT epoch_us(o_orderdate), 'state', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT NULL, 'ledger', concat(conv_id, ':', turn) FROM conversations)""",
)
def w9_timeline(spark, sf_dir):
    flow = table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("ts as at", "cast(event_id as string) as ref")
    state = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderdate as at", "cast(o_orderkey as string) as ref")
    ledger = table(spark, sf_dir, "conversations").selectExpr("concat(conv_id, ':', turn) as ref")
    return timeline.merged({"flow": flow, "state": state, "ledger": ledger}).select(F.unix_micros("at").alias("at_us"), "kind", "ref")


@query(
    "w10_runs",
    """WITH g AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AND row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) > 1 THEN 0 ELSE 1 END AS new FROM conversations),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g)
SELECT conv_id, run, role, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn FROM r GROUP BY conv_id, run, role""",
)
def w10_runs(spark, sf_dir):
    return timeline.actor_runs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "text"], "role").groupBy("conv_id", "run", "role").agg(
        F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn")
    )


@query(
    "w12_failure_rate",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW) AS failures,
 count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW) >= 5 AS limited FROM events WHERE event_type = 'error'""",
)
def w12_failure_rate(spark, sf_dir):
    return timeline.recent_counts(table(spark, sf_dir, "events").where("event_type = 'error'"), ["user_id"], "ts", seconds=86400, limit=5).select("event_id", F.col("recent").alias("failures"), "limited")


@query("w13_pages", "SELECT o_orderkey, epoch_us(o_orderdate) AS at_us FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def w13_pages(spark, sf_dir):
    return timeline.page(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], offset=100, size=50).select("o_orderkey", F.unix_micros("o_orderdate").alias("at_us"))


@query("w14_newest_incidents", f"""{_CAMPAIGN_SQL} SELECT i.incident_id, epoch_us(max(t)) AS latest_us, count(*) AS size FROM mem m JOIN ids i ON m.rule = i.rule AND m.anchor_id = i.anchor_id GROUP BY i.incident_id ORDER BY latest_us DESC, i.incident_id LIMIT 20""")
def w14_newest_incidents(spark, sf_dir):
    made = correlate.incidents(members(spark, sf_dir))
    return made.orderBy(F.desc("latest"), "incident_id").limit(20).select("incident_id", F.unix_micros("latest").alias("latest_us"), "size")


@query(
    "w11_triage_queue",
    f"""WITH {_SIM_SQL}, q AS (SELECT alert_id, score, count(*) OVER (PARTITION BY src, dst, proto) AS burst_count, score * 20 / (1 + alert_id % 7) AS ratio FROM sim)
SELECT alert_id, burst_count, row_number() OVER (ORDER BY burst_count DESC, ratio DESC, score DESC, alert_id) AS position FROM q WHERE score >= 0.5""",
)
def w11_triage_queue(spark, sf_dir):
    rows = alerts(spark, sf_dir).withColumn("burst_count", F.count(F.lit(1)).over(Window.partitionBy("src", "dst", "proto"))).withColumn("ratio", F.expr("score * 20 / (1 + alert_id % 7)"))
    return timeline.triage_queue(rows).select("alert_id", "burst_count", "position")


@query(
    "d7_claims",
    """WITH r AS (SELECT user_id AS id, event_type AS evidence, ts, event_id FROM events UNION ALL SELECT user_id, event_type, ts, event_id FROM events WHERE event_id % 2 = 0)
SELECT id, arg_min(evidence, (ts, event_id)) AS evidence, count(*) AS claims, count(DISTINCT evidence) > 1 AS conflict FROM r GROUP BY id""",
)
def d7_claims(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("user_id as id", "event_type as evidence", "ts", "event_id")
    return timeline.first_claims(rows.union(rows.where("event_id % 2 = 0")), "id", ["ts", "event_id"], "evidence")


@query(
    "j11_latest_signature",
    """WITH a AS (SELECT user_id, ts, event_id, event_type AS signature FROM events WHERE event_type = 'error' OR event_type = 'purchase'), f AS (SELECT * FROM events WHERE event_type IN ('click', 'view'))
SELECT f.event_id, (SELECT arg_max(a.signature, (a.ts, a.event_id)) FROM a WHERE a.user_id = f.user_id AND a.ts <= f.ts) AS signature FROM f""",
)
def j11_latest_signature(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    signs = events.where("event_type in ('error', 'purchase')").select("user_id", "ts", "event_id", F.col("event_type").alias("signature"))
    seen = events.where("event_type in ('click', 'view')").select("user_id", "ts", "event_id")
    return timeline.latest_before(seen, signs, ["user_id"], "ts", "event_id", "signature").select("event_id", "signature")


@query(
    "d21_idempotent_insert",
    """WITH s AS (SELECT * FROM events WHERE event_id % 2 = 0), n AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN value + 1 ELSE value END AS value FROM events)
SELECT n.event_id, CASE WHEN s.event_id IS NULL THEN 'inserted' WHEN s.value IS DISTINCT FROM n.value THEN 'conflict' ELSE 'same' END AS outcome FROM n LEFT JOIN s ON s.event_id = n.event_id""",
)
def d21_idempotent_insert(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    new = events.withColumn("value", F.expr("if(event_id % 10 = 0, value + 1, value)"))
    return timeline.insert_outcomes(events.where("event_id % 2 = 0"), new, "event_id", ["value"])


@query(
    "w6_content_ids",
    f"""WITH alerts AS ({ALERTS_SQL}) SELECT ns, src, count(*) AS alerts, sha256(unhex(hex(encode('tidewatch:members')) || '00' || printf('%08x', strlen(src)) || hex(encode(src))
 || string_agg(printf('%08x', length(CAST(alert_id AS VARCHAR))) || hex(encode(CAST(alert_id AS VARCHAR))), '' ORDER BY CAST(alert_id AS VARCHAR)))) AS member_digest FROM alerts GROUP BY ns, src""",
)
def w6_content_ids(spark, sf_dir):
    """An id that depends on the members of a set alone, not on their order."""
    from tidewatch.functions.digests import id_set_digest

    per = alerts(spark, sf_dir).groupBy("ns", "src").agg(F.count(F.lit(1)).alias("alerts"), F.collect_list("alert_id").alias("ids"))  # a member set is its id
    return per.select("ns", "src", "alerts", id_set_digest("tidewatch:members", [F.col("src")], F.col("ids")).alias("member_digest"))


@query(
    "q2_timeline_kinds",
    """WITH k AS (SELECT 'order' AS kind, o_orderkey AS ref, o_orderdate AS moment FROM orders UNION ALL SELECT 'event', event_id, ts FROM events UNION ALL SELECT 'undated', c_custkey, NULL FROM customer)
SELECT kind, count(*) AS rows, CAST(sum(ref) AS BIGINT) AS refs, count(moment) AS dated FROM k GROUP BY kind""",
)
def q2_timeline_kinds(spark, sf_dir):
    kinds = {
        "order": table(spark, sf_dir, "orders").selectExpr("o_orderkey as ref", "o_orderdate as at"), "event": table(spark, sf_dir, "events").selectExpr("event_id as ref", "ts as at"),
        "undated": table(spark, sf_dir, "customer").selectExpr("c_custkey as ref"),
    }
    kinds["undated"] = kinds["undated"].withColumn("at", F.lit(None).cast("timestamp"))
    return timeline.merged(kinds).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("ref").alias("refs"), F.count("at").alias("dated"))
