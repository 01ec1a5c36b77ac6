"""Duplicate, overlap, leakage-group and split queries over the flow view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import digests
from tidewatch.operators import leakage
from tidewatch.plans.registry import query
from tidewatch.plans.views import FLOWS_SQL, flows, table

_F = f"WITH flows AS ({FLOWS_SQL})"
FEATURES = ["duration_ms", "fwd_packets", "dst_port", "protocol"]


def _named(spark, sf_dir) -> DataFrame:
    """Flows with a file, an end time and the fingerprint of what repeats in the table."""
    return flows(spark, sf_dir).withColumns(
        {
            "file": F.expr("tuple_key % 4"),
            "start_us": F.unix_micros("start_ts"),
            "end_us": F.unix_micros("start_ts") + (F.col("fwd_packets") * 3600 * 1_000_000).cast("long"),
            "fp": F.expr("concat_ws('|', split(record_id, ':')[0], split(record_id, ':')[1])"),
        }
    )


_N = f"""{_F}, n AS (SELECT *, tuple_key % 4 AS file, epoch_us(start_ts) AS start_us, epoch_us(start_ts) + CAST(fwd_packets * 3600 * 1000000 AS BIGINT) AS end_us,
 concat(split_part(record_id, ':', 1), '|', split_part(record_id, ':', 2)) AS fp FROM flows)"""


def _blob(parts: list[str]) -> str:
    return " || ".join(f"printf('%08x', strlen({p})) || hex(encode({p}))" for p in parts)


@query("d1_fingerprints", f"{_F} SELECT record_id, sha256(unhex(hex(encode('tidewatch:record')) || '00' || {_blob(["'protocol'", "'1' || protocol", "'dst_port'", "'1' || CAST(dst_port AS VARCHAR)", "'label'", "'1' || CAST(label AS VARCHAR)"])})) AS fingerprint FROM flows")
def d1_fingerprints(spark, sf_dir):
    return flows(spark, sf_dir).select("record_id", digests.record_fingerprint("tidewatch:record", ["protocol", "dst_port", "label"]).alias("fingerprint"))


@query("d3_flow_identity", "SELECT least(concat('u', user_id), concat('svc_', event_type)) AS a, greatest(concat('u', user_id), concat('svc_', event_type)) AS b, count(*) AS flows FROM events GROUP BY 1, 2")
def d3_flow_identity(spark, sf_dir):
    ends = F.array_sort(F.array(F.expr("concat('u', user_id)"), F.expr("concat('svc_', event_type)")))
    return table(spark, sf_dir, "events").groupBy(ends[0].alias("a"), ends[1].alias("b")).agg(F.count(F.lit(1)).alias("flows"))


@query("d4_duplicates", f"{_N}, g AS (SELECT file, fp, count(*) AS n FROM n GROUP BY file, fp HAVING count(*) > 1) SELECT file, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS excess FROM g GROUP BY file")
def d4_duplicates(spark, sf_dir):
    return leakage.duplicate_summary(_named(spark, sf_dir), "fp", "file")


@query("d4_duplicates_overall", f"{_N}, g AS (SELECT fp, count(*) AS n FROM n GROUP BY fp HAVING count(*) > 1) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS excess FROM g")
def d4_duplicates_overall(spark, sf_dir):
    return leakage.duplicate_summary(_named(spark, sf_dir), "fp")


@query(
    "d5_feature_conflicts",
    f"""{_F}, g AS (SELECT count(*) AS n, count(DISTINCT label) AS l FROM flows GROUP BY {', '.join(FEATURES)})
SELECT count(*) AS vectors, count_if(n > 1) AS repeated, CAST(sum(n) FILTER (n > 1) AS BIGINT) AS repeated_rows, count_if(l > 1) AS conflicting, CAST(coalesce(sum(n) FILTER (l > 1), 0) AS BIGINT) AS conflicting_rows FROM g""",
)
def d5_feature_conflicts(spark, sf_dir):
    return leakage.feature_summary(flows(spark, sf_dir), FEATURES, "label")


_ISLANDS = f"""{_N}, o AS (SELECT *, max(end_us) OVER (PARTITION BY tuple_key ORDER BY start_us, end_us, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n),
i AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR start_us > before THEN 1 ELSE 0 END) OVER (PARTITION BY tuple_key ORDER BY start_us, end_us, record_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM o)"""


@query(
    "d6_overlaps",
    f"""{_ISLANDS}, s AS (SELECT count(*) AS n FROM i GROUP BY tuple_key, island)
SELECT count(*) AS components, count_if(n > 1) AS overlapping, CAST(sum(n) FILTER (n > 1) AS BIGINT) AS overlapping_rows, max(n) AS largest FROM s""",
)
def d6_overlaps(spark, sf_dir):
    return leakage.overlap_summary(leakage.overlap_islands(_named(spark, sf_dir), "tuple_key", "start_us", "end_us", "record_id"), "tuple_key")


_LINKS = ("record_id", "fp", "island_key", "start_us", "end_us")


def _linked(spark, sf_dir) -> DataFrame:
    return _named(spark, sf_dir).withColumn("island_key", F.when(F.col("fwd_packets") >= 45, F.col("tuple_key")))


_GROUPS = f"""{_N}, k AS (SELECT * FROM n WHERE fwd_packets >= 45),
o AS (SELECT *, max(end_us) OVER (PARTITION BY tuple_key ORDER BY start_us, end_us, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start_us > before THEN 1 ELSE 0 END) OVER (PARTITION BY tuple_key ORDER BY start_us, end_us, record_id ROWS UNBOUNDED PRECEDING) AS island FROM o),
e AS (SELECT record_id AS x, min(record_id) OVER (PARTITION BY fp) AS y FROM n UNION ALL SELECT record_id, min(record_id) OVER (PARTITION BY tuple_key, island) FROM i),
b AS (SELECT DISTINCT x, y FROM (SELECT x, y FROM e WHERE x <> y UNION ALL SELECT y, x FROM e WHERE x <> y)),
r AS (SELECT x AS node, x AS seen FROM b UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.seen),
root AS (SELECT n.record_id, coalesce(min(r.seen), n.record_id) AS root FROM n LEFT JOIN r ON r.node = n.record_id GROUP BY n.record_id)"""
_GROUPS = _GROUPS.replace("WITH flows", "WITH RECURSIVE flows")


@query("d8_leakage_groups", f"{_GROUPS} SELECT record_id, root FROM root")
def d8_leakage_groups(spark, sf_dir):
    return leakage.leakage_groups(_linked(spark, sf_dir), *_LINKS)


def _decided(spark, sf_dir) -> DataFrame:
    rows = _linked(spark, sf_dir).withColumns({"usable": F.col("duration_ms") > 0, "start": F.col("start_ts")})
    return leakage.leakage_decisions(rows, *_LINKS, F.lit("1997-01-01").cast("timestamp"), oversized=4)


_SHARE = "sha256(unhex(hex(encode('tidewatch:split')) || '00' || printf('%08x', strlen(root)) || hex(encode(root))))[1:16] < '3333333333333333'"
_DECIDED = f"""{_GROUPS}, d AS (SELECT root.root, n.file, n.label, n.start_ts, n.duration_ms > 0 AS usable FROM n JOIN root ON n.record_id = root.record_id),
q AS (SELECT root, count(*) AS rows, CAST(sum(label) AS BIGINT) AS attacks, count_if(NOT usable) AS bad, count(DISTINCT file) AS files, count(DISTINCT label) AS labels, count_if(start_ts >= TIMESTAMP '1997-01-01') AS late FROM d GROUP BY root),
m AS (SELECT *, CAST((bad > 0) AS INT) + 2 * CAST((files > 1) AS INT) + 4 * CAST((labels > 1) AS INT) + 8 * CAST((late > 0 AND late < rows) AS INT) + 16 * CAST((rows > 4) AS INT) AS mask FROM q),
v AS (SELECT root, rows, attacks, mask,
 CASE WHEN mask & 1 > 0 THEN 'unusable_interval' WHEN mask & 2 > 0 THEN 'mixed_files' WHEN mask & 4 > 0 THEN 'mixed_labels' WHEN mask & 8 > 0 THEN 'crosses_boundary' WHEN mask & 16 > 0 THEN 'oversized' END AS reason,
 CASE WHEN mask > 0 THEN 'quarantine' WHEN late > 0 THEN 'test' WHEN {_SHARE} THEN 'validation' ELSE 'train' END AS disposition FROM m)"""


@query("d9_group_decisions", f"{_DECIDED} SELECT * FROM v")
def d9_group_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).drop("_label", "_label_last")


@query("d10_holdout_share", f"{_N}, g AS (SELECT DISTINCT fp AS root FROM n) SELECT count(*) AS groups, count_if({_SHARE}) AS held_out FROM g")
def d10_holdout_share(spark, sf_dir):
    return _named(spark, sf_dir).select("fp").distinct().agg(F.count(F.lit(1)).alias("groups"), F.count_if(leakage.in_holdout(F.col("fp"))).alias("held_out"))


@query("d11_split_counts", f"{_DECIDED} SELECT disposition, count(*) AS groups, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(attacks) AS BIGINT) AS attacks FROM v GROUP BY disposition")
def d11_split_counts(spark, sf_dir):
    return leakage.decision_counts(_decided(spark, sf_dir))


@query(
    "d11_split_violations",
    f"""{_DECIDED}, x AS (SELECT d.root, d.label, v.disposition FROM d JOIN v ON d.root = v.root)
SELECT (SELECT count(*) FROM (SELECT root FROM x GROUP BY root HAVING count(DISTINCT disposition) > 1)) AS crossing_groups,
 (SELECT count(*) FROM (SELECT disposition FROM x WHERE disposition <> 'quarantine' GROUP BY disposition HAVING count(DISTINCT label) < 2)) AS one_class_splits""",
)
def d11_split_violations(spark, sf_dir):
    return leakage.decision_violations(_decided(spark, sf_dir))


@query(
    "d12_quarantine_impact",
    f"""{_DECIDED}, bits(bit, reason) AS (VALUES (1, 'unusable_interval'), (2, 'mixed_files'), (4, 'mixed_labels'), (8, 'crosses_boundary'), (16, 'oversized'))
SELECT bits.reason, count(*) AS groups, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(attacks) AS BIGINT) AS attacks FROM v JOIN bits ON v.mask & bits.bit > 0 GROUP BY bits.reason""",
)
def d12_quarantine_impact(spark, sf_dir):
    return leakage.quarantine_impact(_decided(spark, sf_dir))


_ASSIGN = ("concat('src', c_nationkey % 5) AS source", "CASE WHEN c_custkey % 2 = 0 THEN 'fit' ELSE 'check' END AS role", "c_nationkey AS root", "CASE WHEN c_custkey % 7 = 0 THEN 'test' ELSE 'train' END AS split")


@query(
    "d13_policy_violations",
    f"""WITH a AS (SELECT {', '.join(_ASSIGN)} FROM customer), r(source, role, split) AS (VALUES ('src0', 'fit', 'train'), ('src1', 'fit', 'train'), ('src1', 'check', 'test'), ('src2', 'check', 'train'))
SELECT 'unknown_source' AS kind, count(*) AS n FROM a WHERE source NOT IN (SELECT source FROM r)
UNION ALL SELECT 'forbidden_split', count(*) FROM a WHERE source IN (SELECT source FROM r) AND NOT EXISTS (SELECT 1 FROM r WHERE r.source = a.source AND r.role = a.role AND r.split = a.split)
UNION ALL SELECT 'group_in_several_splits', count(*) FROM (SELECT root FROM a GROUP BY root HAVING count(DISTINCT split) > 1)""",
)
def d13_policy_violations(spark, sf_dir):
    assignments = table(spark, sf_dir, "customer").selectExpr(*_ASSIGN)
    rules = spark.createDataFrame([("src0", "fit", "train"), ("src1", "fit", "train"), ("src1", "check", "test"), ("src2", "check", "train")], "source string, role string, split string")
    return leakage.policy_violations(assignments, rules)


@query(
    "d14_later_holdout",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, CASE WHEN nth <= CASE WHEN n > 1 THEN greatest(1, least(n - 1, floor(n * 8 / 10))) ELSE n END THEN 'train' ELSE 'test' END AS part FROM r""",
)
def d14_later_holdout(spark, sf_dir):
    return leakage.later_holdout(table(spark, sf_dir, "events"), "event_type", "ts", "event_id").select("event_id", "part")


@query(
    "d15_balanced_sample",
    """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256(concat('0:', event_id)), event_id) AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events),
t AS (SELECT *, CASE WHEN n >= 2200 THEN 1 ELSE 2200 // n + CASE WHEN nth <= 2200 % n THEN 1 ELSE 0 END END AS times FROM r WHERE nth <= 2500)
SELECT event_type, count(*) AS rows, CAST(sum(times) AS BIGINT) AS drawn, CAST(sum(times * event_id) AS BIGINT) AS id_sum FROM t GROUP BY event_type""",
)
def d15_balanced_sample(spark, sf_dir):
    drawn = leakage.balanced_sample(table(spark, sf_dir, "events"), "event_type", "event_id", cap=2500, floor=2200)
    return drawn.groupBy("event_type").agg(F.count_distinct("event_id").alias("rows"), F.count(F.lit(1)).alias("drawn"), F.sum("event_id").alias("id_sum"))


@query(
    "d15_class_weights",
    """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), w AS (SELECT *, sqrt(max(n) OVER () / n) AS w FROM c)
SELECT event_type, n, round(w / (SELECT avg(w) FROM w), 9) AS weight FROM w""",
)
def d15_class_weights(spark, sf_dir):
    return leakage.class_weights(table(spark, sf_dir, "events"), "event_type").withColumn("weight", F.round("weight", 9))


@query("j1_one_to_one", f"""{_F}, a AS (SELECT record_id, count(*) AS a FROM flows GROUP BY 1), b AS (SELECT record_id, count(*) AS b FROM flows WHERE label = 1 GROUP BY 1)
SELECT count_if(a IS NOT NULL AND b IS NOT NULL) AS matched, count_if(a IS NULL) AS extra, count_if(b IS NULL) AS missing, count_if(a > 1 OR b > 1) AS repeated FROM a FULL JOIN b USING (record_id)""")
def j1_one_to_one(spark, sf_dir):
    rows = flows(spark, sf_dir)
    return leakage.joined_one_to_one(rows, rows.where("label = 1"), "record_id")


@query("j8_orphans", "SELECT count(*) AS orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def j8_orphans(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


@query("j9_rows_seen", f"""{_F}, tr AS (SELECT DISTINCT {', '.join(FEATURES)} FROM flows WHERE start_ts < TIMESTAMP '1996-01-01')
SELECT count(*) AS rows FROM flows WHERE start_ts >= TIMESTAMP '1996-01-01' AND ({', '.join(FEATURES)}) IN (SELECT ({', '.join(FEATURES)}) FROM tr)""")
def j9_rows_seen(spark, sf_dir):
    rows = flows(spark, sf_dir)
    return leakage.rows_seen_in(rows.where("start_ts >= '1996-01-01'"), rows.where("start_ts < '1996-01-01'"), FEATURES)


@query("j10_shared_vectors", f"""{_F}, g AS (SELECT count(*) AS n, count(DISTINCT label) AS l, string_agg(DISTINCT CASE WHEN start_ts < TIMESTAMP '1996-01-01' THEN 'train' ELSE 'test' END, '+' ORDER BY CASE WHEN start_ts < TIMESTAMP '1996-01-01' THEN 'train' ELSE 'test' END) AS splits FROM flows GROUP BY {', '.join(FEATURES)})
SELECT splits, count(*) AS vectors, CAST(sum(n) AS BIGINT) AS rows, count_if(l > 1) AS conflicting FROM g GROUP BY splits""")
def j10_shared_vectors(spark, sf_dir):
    rows = flows(spark, sf_dir).withColumn("split", F.expr("if(start_ts < '1996-01-01', 'train', 'test')"))
    return leakage.shared_vectors(rows, FEATURES, "split", "label")
