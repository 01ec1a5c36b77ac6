"""Smaller queries of the inventory: gates, ratios, attachments, tiers and step chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import audit, burst, reports, scoring, text
from tidewatch.plans import correlation_queries as c
from tidewatch.plans.registry import query
from tidewatch.plans.scoring_queries import _CELLS14, by_bytes, by_score
from tidewatch.plans.views import ALERTS_SQL, FLOWS_SQL, alerts, flows, table

_A, _F = f"WITH alerts AS ({ALERTS_SQL})", f"WITH flows AS ({FLOWS_SQL})"


@query("j4_first_attack_flow", f"{c._CAMPAIGN_SQL} SELECT i.incident_id, arg_min(m.alert_id, (m.t, m.alert_id)) AS flow FROM mem m JOIN ids i ON m.rule = i.rule AND m.anchor_id = i.anchor_id WHERE m.score >= 0.55 GROUP BY i.incident_id")
def j4_first_attack_flow(spark, sf_dir):
    found = c.members(spark, sf_dir)
    return reports.first_attack_flows(found, alerts(spark, sf_dir).where("score >= 0.55"), "incident_id", "t", "alert_id").where("flow is not null")


@query("j2_provenance", f"{_A} SELECT alert_id, CASE WHEN alert_id % 3 = 0 THEN ns END AS namespace FROM alerts")
def j2_provenance(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    return rows.join(rows.where("alert_id % 3 = 0").select("alert_id", F.col("ns").alias("namespace")), "alert_id", "left").select("alert_id", "namespace")


@query("a10_compression_tiers", f"{_A}, n AS (SELECT count(*) AS flows, count_if(decision = 'Attack') AS attacks, count_if(decision = 'Attack' AND score >= 0.9) AS sure FROM alerts) SELECT 'flows' AS stage, flows AS n, 0.0::DOUBLE AS compressed_pct FROM n UNION ALL SELECT 'attacks', attacks, 100.0::DOUBLE * (flows - attacks) / flows FROM n UNION ALL SELECT 'sure', sure, 100.0::DOUBLE * (flows - sure) / flows FROM n")
def a10_compression_tiers(spark, sf_dir):
    row = reports.stage_funnel(alerts(spark, sf_dir), "decision", "score", "src")
    return reports.compression_tiers(row, ["flows", "attacks", "sure"])


@query("a21_queue_ratios", f"""{_CELLS14} SELECT CAST(sum("both" + first_only) AS BIGINT) AS first_queue, CAST(sum("both" + first_only + second_only) AS BIGINT) AS or_queue, CAST(sum("both" + first_only + second_only) AS DOUBLE) / sum("both" + first_only) AS growth FROM c""")
def a21_queue_ratios(spark, sf_dir):
    return scoring.queue_ratios(scoring.overlap_cells(flows(spark, sf_dir), "label", by_score(), by_bytes()))


@query("m17_acceptance_gates", f"{_CELLS14}, g AS (SELECT CAST(max(second_only) FILTER (label = 1) AS BIGINT) AS attacks_gained, CAST(max(first_only) FILTER (label = 1) AS BIGINT) AS attacks_lost, CAST(max(second_only) FILTER (label = 0) AS BIGINT) AS alarms_gained, CAST(max(first_only) FILTER (label = 0) AS BIGINT) AS alarms_lost FROM c) SELECT *, attacks_gained > attacks_lost AS gains, 40 * (attacks_gained - attacks_lost) >= 3 * (alarms_gained - alarms_lost) AS affordable, attacks_gained > attacks_lost AND 40 * (attacks_gained - attacks_lost) >= 3 * (alarms_gained - alarms_lost) AS accepted FROM g")
def m17_acceptance_gates(spark, sf_dir):
    cells = scoring.overlap_cells(flows(spark, sf_dir), "label", by_score(), by_bytes())
    pick = lambda col, y: F.max(F.when(F.col("label") == y, F.col(col)))
    row = cells.agg(pick("second_only", 1).alias("attacks_gained"), pick("first_only", 1).alias("attacks_lost"), pick("second_only", 0).alias("alarms_gained"), pick("first_only", 0).alias("alarms_lost"))
    return scoring.acceptance_gates(row).drop("price")


@query("m21_cohort_ratios", f"{_F}, p AS (SELECT protocol, avg(fwd_bytes) AS mean FROM flows GROUP BY protocol) SELECT protocol, round(mean, 4) AS mean, round(mean / (SELECT mean FROM p WHERE protocol = 'tcp'), 8) AS ratio FROM p")
def m21_cohort_ratios(spark, sf_dir):
    found = scoring.cohort_ratios(flows(spark, sf_dir), "protocol", "fwd_bytes", "tcp")
    return found.select("protocol", F.round("mean", 4).alias("mean"), F.round("ratio", 8).alias("ratio"))


@query("p26_playbooks", f"{_A} SELECT alert_id, CASE WHEN decision = 'Attack' THEN CASE proto WHEN 'tcp' THEN 'isolate' WHEN 'icmp' THEN 'rate-limit' ELSE 'review' END END AS playbook FROM alerts")
def p26_playbooks(spark, sf_dir):
    return alerts(spark, sf_dir).select("alert_id", reports.playbook_of(F.col("decision"), F.col("proto"), {"tcp": "isolate", "icmp": "rate-limit"}, "review").alias("playbook"))


@query("p18_compatibility", f"{_F} SELECT protocol, CASE protocol WHEN 'tcp' THEN 'supported' WHEN 'udp' THEN 'incompatible' ELSE 'unknown' END AS decision, count(*) AS n FROM flows GROUP BY protocol")
def p18_compatibility(spark, sf_dir):
    policy = spark.createDataFrame([("tcp", "supported"), ("udp", "incompatible")], "protocol string, decision string")
    return reports.compatibility(flows(spark, sf_dir), policy, "protocol").groupBy("protocol", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("t3_query_texts", f"{_F} SELECT record_id, concat(protocol, ' traffic port ', dst_port, CASE WHEN fwd_packets >= 40 THEN ' high packet rate' ELSE '' END) AS query FROM flows")
def t3_query_texts(spark, sf_dir):
    return flows(spark, sf_dir).select("record_id", text.flow_query_text(F.col("protocol"), F.col("dst_port"), F.col("fwd_packets"), 40.0).alias("query"))


@query(
    "t4_attached_techniques",
    """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), k AS (SELECT vec_id + 1 AS doc_id, embedding FROM embeddings),
s AS (SELECT q.vec_id, k.doc_id, list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS sim FROM q, k WHERE k.doc_id <> q.vec_id + 1),
b AS (SELECT vec_id, arg_max(doc_id, (round(sim, 9), -doc_id)) AS doc_id, max(sim) AS sim FROM s GROUP BY vec_id)
SELECT q.vec_id, CASE WHEN sim >= 0.45 THEN concat('T', doc_id % 40 + 1000) END AS technique FROM q LEFT JOIN b USING (vec_id)""",
)
def t4_attached_techniques(spark, sf_dir):
    """The rows whose id is divisible by 100 as attacks, every row's vector as a technique's text; a row isn't its own."""
    vectors = table(spark, sf_dir, "embeddings")
    corpus = vectors.selectExpr("vec_id + 1 as doc_id", "embedding", "concat('T', (vec_id + 1) % 40 + 1000) as technique")
    found = text.attach_techniques(vectors.where("vec_id % 100 = 0").withColumn("own", F.col("vec_id") + 1), corpus, "vec_id", "doc_id", "technique", floor=0.45, own="own")
    return found.select("vec_id", "technique")


@query("t12_hypotheses", "SELECT concat('u', user_id) AS actor, event_type AS technique, count(*) AS records, concat('u', user_id, ' may use ', event_type) AS statement FROM events WHERE value > 50 GROUP BY user_id, event_type")
def t12_hypotheses(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value > 50").selectExpr("concat('u', user_id) as actor", "event_type as technique")
    return text.hypotheses(rows, "actor", "technique")


_STEP = "sha256(concat_ws('|', CAST(seq AS VARCHAR), role, coalesce(md5(text), '-')))"


@query(
    "l4_step_chain",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS seq FROM conversations),
s AS (SELECT conv_id, seq, {_STEP} AS step, conv_id % 7 = 3 AND seq % 2 = 0 AS altered, conv_id % 11 = 5 AND seq = 2 AS cut FROM r),
l AS (SELECT *, lag(CASE WHEN altered THEN 'x' || step[2:64] ELSE step END) OVER (PARTITION BY conv_id ORDER BY seq) AS before FROM s)
SELECT conv_id, count(*) AS steps, count_if(altered OR seq > 1 AND before IS DISTINCT FROM CASE WHEN cut THEN 'gone' ELSE before END) AS breaks FROM l GROUP BY conv_id""",
)
def l4_step_chain(spark, sf_dir):
    """One chain a conversation: a step's digest covers its number, role and text, and its link is the digest of the step before.
    Some digests are altered and some links cut; a break is a step whose digest or link does not hold."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.md5("text"))  # a conversation's turns
    rows = table(spark, sf_dir, "conversations").withColumn("seq", F.row_number().over(order))
    step = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "role", F.coalesce(F.md5("text"), F.lit("-"))), 256)
    kept = F.when(F.expr("conv_id % 7 = 3 and seq % 2 = 0"), F.concat(F.lit("x"), F.substring(step, 2, 63))).otherwise(step)
    rows = rows.withColumn("entry_hash", kept)
    before = F.lag("entry_hash").over(Window.partitionBy("conv_id").orderBy("seq"))
    rows = rows.withColumn("prev_hash", F.when(F.expr("conv_id % 11 = 5 and seq = 2"), "gone").otherwise(F.coalesce(before, F.lit(audit.GENESIS))))
    per = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("steps"))
    broken = audit.chain_breaks(rows, "seq", step, "conv_id").groupBy("conv_id").agg(F.count(F.lit(1)).alias("breaks"))
    return per.join(broken, "conv_id", "left").fillna(0, ["breaks"])


@query("d20_backfilled_bursts", f"{c._BURSTS_SQL}, per AS (SELECT src, dst, proto, burst_no, count(*) AS n FROM b GROUP BY ALL) SELECT n AS burst_total, CAST(sum(n) AS BIGINT) AS alerts FROM per GROUP BY n")
def d20_backfilled_bursts(spark, sf_dir):
    rows = burst.bursts(c.simhashed(spark, sf_dir), ["src", "dst", "proto"], idle=c.BURST)
    return rows.groupBy("burst_total").agg(F.count(F.lit(1)).alias("alerts"))


@query("q4_shared_splits", f"{_F}, g AS (SELECT dst_port, count(DISTINCT start_ts < TIMESTAMP '1996-01-01') AS k FROM flows GROUP BY dst_port) SELECT count_if(k = 2) AS shared FROM g")
def q4_shared_splits(spark, sf_dir):
    rows = flows(spark, sf_dir)
    early, late = rows.where("start_ts < '1996-01-01'").select("dst_port"), rows.where("start_ts >= '1996-01-01'").select("dst_port")
    return early.intersect(late).agg(F.count(F.lit(1)).alias("shared"))
