"""Hash-chain, archive and completeness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import audit, ranks
from tidewatch.plans.registry import query
from tidewatch.plans.views import ALERTS_SQL, alerts, table
from tidewatch.session import stored

#: Every order is an entry whose hash covers its key and price; links point to the order before.
_HASH = "sha256(concat_ws('|', 'order', CAST(o_orderkey AS VARCHAR)))"


@query(
    "l1_chain_breaks",
    f"""WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders)
SELECT seq, CASE WHEN o_orderkey % 100 = 7 THEN 'altered_entry' WHEN o_orderkey % 150 = 11 THEN 'broken_link' END AS reason FROM s WHERE seq > 1 AND (o_orderkey % 100 = 7 OR o_orderkey % 150 = 11)""",
)
def l1_chain_breaks(spark, sf_dir):
    """A chain over the orders with planted alterations: entry hashes cover the link's key, links are the hash before."""
    rows = ranks.with_rank(table(spark, sf_dir, "orders").select("o_orderkey"), [], [F.col("o_orderkey").asc()], "seq")
    entry = F.sha2(F.concat_ws("|", F.lit("order"), F.col("o_orderkey").cast("string")), 256)
    rows = rows.withColumn("entry_hash", entry)
    linked = rows.alias("x").join(rows.select((F.col("seq") + 1).alias("n"), F.col("entry_hash").alias("before")).alias("y"), F.col("seq") == F.col("n"), "left")
    linked = linked.withColumn("prev_hash", F.expr(f"case when seq = 1 then '{audit.GENESIS}' when o_orderkey % 150 = 11 and o_orderkey % 100 <> 7 then 'x' else before end"))
    recomputed = F.when((F.col("o_orderkey") % 100 == 7) & (F.col("seq") > 1), F.lit("altered")).otherwise(F.col("entry_hash"))
    return audit.chain_breaks(linked.select("o_orderkey", "seq", "entry_hash", "prev_hash"), "seq", recomputed)


@query("l2_sealed_head", f"SELECT count(*) AS entries, arg_max({_HASH}, o_orderkey) AS head FROM orders")
def l2_sealed_head(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("entry_hash", F.sha2(F.concat_ws("|", F.lit("order"), F.col("o_orderkey").cast("string")), 256))
    return audit.sealed_head(rows, "o_orderkey")


_CUT = "TIMESTAMP '2024-01-15 00:00:00'"


@query("l3_archive_and_prune", f"WITH a AS (SELECT * FROM events WHERE ts < {_CUT} OR (ts = {_CUT} AND event_id <= 5000)) SELECT (SELECT count(*) FROM a) AS archived, (SELECT count(*) FROM events) - (SELECT count(*) FROM a) AS left_over, 0 AS only_table, 0 AS only_archive")
def l3_archive_and_prune(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    archive = audit.archive_up_to(rows, "ts", "event_id", F.lit("2024-01-15 00:00:00").cast("timestamp"), F.lit(5000))
    pruned = audit.prune(rows, archive, "event_id")
    counts = archive.agg(F.count(F.lit(1)).alias("archived")).crossJoin(pruned.agg(F.count(F.lit(1)).alias("left_over")))
    return counts.crossJoin(audit.archive_difference(rows, archive.unionByName(pruned)))


@query("l5_completeness", f"WITH alerts AS ({ALERTS_SQL}) SELECT alert_id, concat_ws(',', CASE WHEN alert_id % 2 > 0 THEN 'model' END, CASE WHEN decision <> 'Attack' THEN 'decision' END) AS gaps, CASE WHEN alert_id % 2 = 0 AND decision = 'Attack' THEN 'COMPLETE' WHEN alert_id % 2 > 0 AND decision <> 'Attack' THEN 'PENDING' ELSE 'PARTIAL' END AS status FROM alerts")
def l5_completeness(spark, sf_dir):
    return alerts(spark, sf_dir).select(*audit.completeness({"model": F.col("alert_id") % 2 == 0, "decision": F.col("decision") == "Attack"}, F.col("alert_id")))


@query("l6_checklist", f"WITH alerts AS ({ALERTS_SQL}) SELECT count_if(score IS NOT NULL) AS scored, count_if(src IS NOT NULL AND dst IS NOT NULL) AS placed, count_if(t IS NOT NULL) AS dated FROM alerts")
def l6_checklist(spark, sf_dir):
    return alerts(spark, sf_dir).agg(F.count_if(F.col("score").isNotNull()).alias("scored"), F.count_if(F.col("src").isNotNull() & F.col("dst").isNotNull()).alias("placed"), F.count_if(F.col("t").isNotNull()).alias("dated"))


_SECRET = b"the ledger's key"
_IPAD, _OPAD = (bytes(x ^ pad for x in _SECRET.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


def _hmac_sql(message: str) -> str:
    """HMAC-SHA-256 of a text under the fixed key, by its definition."""
    return f"sha256(unhex('{_OPAD}' || sha256(unhex('{_IPAD}' || hex(encode({message}))))))"


@query(
    "l1_keyed_chain",
    f"""WITH RECURSIVE o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderkey, concat_ws(';', o_orderkey, o_orderstatus) AS payload FROM orders),
h AS (SELECT o_custkey, seq, {_hmac_sql(f"'{audit.GENESIS}|' || payload")} AS entry_hash FROM o WHERE seq = 1
 UNION ALL SELECT o.o_custkey, o.seq, {_hmac_sql("h.entry_hash || '|' || payload")} FROM h JOIN o ON o.o_custkey = h.o_custkey AND o.seq = h.seq + 1)
SELECT o_custkey, count(*) AS entries, arg_max(entry_hash, seq) AS head, count_if(o_orderkey % 100 = 7 OR o_orderkey % 150 = 11 AND seq > 1) AS breaks FROM h JOIN o USING (o_custkey, seq) GROUP BY o_custkey""",
)
def l1_keyed_chain(spark, sf_dir):
    """A keyed chain of each customer's orders: an entry covers the hash before it and the order's content. Some contents are altered
    afterwards and some links cut: its head, and the entries whose hash or link does not hold."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat_ws(";", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("payload"))
    rows = ranks.with_rank(rows, ["o_custkey"], [F.col("o_orderkey").asc()], "seq")
    chained = audit.with_keyed_chain(rows, _SECRET, "o_custkey", "seq", "payload")
    heads = chained.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("entries"), F.max_by("entry_hash", "seq").alias("head"))
    found = chained.withColumns({"payload": F.expr("if(o_orderkey % 100 = 7, concat(payload, '!'), payload)"), "prev_hash": F.expr("if(o_orderkey % 150 = 11 and seq > 1, 'x', prev_hash)")})
    broken = audit.chain_breaks(found, "seq", audit.keyed_digest(_SECRET, F.col("prev_hash"), F.col("payload")), "o_custkey")
    per = broken.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("breaks"))
    return heads.join(per, "o_custkey", "left").fillna(0, ["breaks"])


@query(
    "l3_sealed_faults",
    f"""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events WHERE ts < {_CUT} OR (ts = {_CUT} AND event_id <= 5000)), n AS (SELECT max(seq) AS last FROM e),
f AS (SELECT (seq - 1) // 64 AS block, CASE WHEN (seq - 1) // 64 = (last - 1) // 64 THEN 'missing' ELSE 'altered' END AS fault FROM e, n WHERE seq IN (130, 131, 700) OR seq > last - 1)
SELECT DISTINCT block, fault FROM f""",
)
def l3_sealed_faults(spark, sf_dir):
    """An archive's blocks against its entries after two neighbours changed places, one value was altered and the last block was cut off."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    kept = audit.archive_up_to(rows, "ts", "event_id", F.lit("2024-01-15 00:00:00").cast("timestamp"), F.lit(5000))
    entries = stored(ranks.with_rank(kept, [], [F.col("ts").asc(), F.col("event_id").asc()], "seq"), "sealed-entries")
    columns = ["event_id", "user_id", "event_type"]
    blocks = audit.digest_blocks(entries, "seq", audit.entry_leaf("seq", columns), 64)
    last = F.floor((entries.agg(F.max("seq")).first()[0] - 1) / F.lit(64))
    changed = entries.withColumns({"seq": F.expr("case seq when 130 then 131L when 131 then 130L else seq end"), "user_id": F.expr("if(seq = 700, user_id + 1, user_id)")})
    return audit.sealed_faults(changed.where(F.floor((F.col("seq") - 1) / 64) < last), blocks, columns, 64)


@query(
    "l6_evidence",
    f"""WITH alerts AS ({ALERTS_SQL}), c AS (SELECT alert_id, decision, alert_id % 9 AS k, alert_id % 5 AS m FROM alerts),
s AS (SELECT alert_id, CASE WHEN k = 1 THEN 'invalid' ELSE 'valid' END AS contract, CASE WHEN k IN (2, 3, 4) THEN 'unscored' ELSE 'scored' END AS scored,
 CASE WHEN decision = 'Benign' THEN 'excluded' WHEN m = 0 THEN 'checked' ELSE 'not_recorded' END AS correlated,
 CASE WHEN m = 1 THEN 'refused' WHEN m = 2 THEN 'clear' ELSE 'not_recorded' END AS addresses, CASE WHEN m = 3 THEN 'recorded' ELSE 'pending' END AS chained FROM c),
l AS (SELECT 'contract' AS id, contract AS status, contract = 'valid' AS passed FROM s UNION ALL SELECT 'scored', scored, scored = 'scored' FROM s UNION ALL SELECT 'correlated', correlated, correlated = 'checked' FROM s
 UNION ALL SELECT 'addresses', addresses, addresses <> 'not_recorded' FROM s UNION ALL SELECT 'chained', chained, false FROM s)
SELECT id, status, passed, count(*) AS n FROM l GROUP BY ALL""",
)
def l6_evidence(spark, sf_dir):
    """The five pieces of evidence of every alert, some of them missing, counted by status."""
    rows = alerts(spark, sf_dir).selectExpr(
        "alert_id", "decision", "score as probability_all", "if(alert_id % 9 = 1, double('NaN'), 1.0d) as f1", "2.0d as f2", "if(alert_id % 9 = 2, 'waiting', 'scored') as reason", "if(alert_id % 9 = 3, 'rejected', 'verified') as evidence_state",
        "if(alert_id % 9 = 4, null, score) as probability", "alert_id % 5 = 0 as windows_checked",
        "case alert_id % 5 when 1 then 'host 8.8.8.8' when 2 then 'at 9.9.9.9' else src end as src", "case alert_id % 5 when 1 then '10.0.0.9' else dst end as dst",
        "alert_id % 5 in (3, 4) as chain_flag", "if(alert_id % 5 = 3, repeat('a', 64), 'none') as entry_hash",
    )
    told = rows.select(F.explode(audit.evidence_checklist(["f1", "f2"])).alias("x")).select("x.*")
    return told.groupBy("id", "status", "passed").agg(F.count(F.lit(1)).alias("n"))
