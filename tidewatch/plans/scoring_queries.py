"""Feature, metric, risk and drift queries over the flow view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import fitting, scoring
from tidewatch.plans.registry import query
from tidewatch.plans.views import ALERTS_SQL, FLOWS_SQL, alerts, flows
from tidewatch.session import stored

_F = f"WITH flows AS ({FLOWS_SQL})"
_FEAT = f"""{_F}, feat AS (SELECT *, CASE WHEN duration_ms > 0 THEN (fwd_packets + bwd_packets) / (duration_ms / 1000.0) ELSE 0.0 END AS packets_per_second,
 CASE WHEN duration_ms > 0 THEN (fwd_bytes + bwd_bytes) / (duration_ms / 1000.0) ELSE 0.0 END AS bytes_per_second,
 CASE WHEN fwd_packets > 0 THEN fwd_bytes / fwd_packets ELSE 0.0 END AS fwd_packet_length_mean, CASE WHEN bwd_packets > 0 THEN bwd_bytes / bwd_packets ELSE 0.0 END AS bwd_packet_length_mean FROM flows)"""


def by_score():
    """The first detector's decision."""
    return F.col("score") >= 0.5


def by_bytes():
    """The second detector's decision."""
    return F.col("fwd_bytes") >= 40000


def featured(spark, sf_dir) -> DataFrame:
    return scoring.with_features(flows(spark, sf_dir))


@query("p8_rates", f"{_FEAT} SELECT record_id, packets_per_second, bytes_per_second, fwd_packet_length_mean, bwd_packet_length_mean FROM feat")
def p8_rates(spark, sf_dir):
    return featured(spark, sf_dir).select("record_id", "packets_per_second", "bytes_per_second", "fwd_packet_length_mean", "bwd_packet_length_mean")


_STATS = ", ".join(f"round(avg({c}) FILTER (label = 0), 4) AS {c}_mean, round(CASE WHEN stddev_pop({c}) FILTER (label = 0) > 0 THEN stddev_pop({c}) FILTER (label = 0) ELSE 1.0 END, 4) AS {c}_scale" for c in scoring.NUMERIC)


@query("m1_z_statistics", f"{_FEAT} SELECT {_STATS} FROM feat")
def m1_z_statistics(spark, sf_dir):
    found = scoring.z_statistics(featured(spark, sf_dir).where("label = 0"))
    return found.select([F.round(c, 4).alias(c) for c in found.columns])


@query(
    "m2_z_scores",
    f"""{_FEAT}, s AS (SELECT avg(fwd_packets) AS m, stddev_pop(fwd_packets) AS d FROM feat WHERE label = 0)
SELECT record_id, round((fwd_packets - m) / d, 6) AS fwd_packets_z, CASE WHEN protocol = 'tcp' THEN 1.0 ELSE 0.0 END AS protocol_tcp, CASE WHEN protocol = 'other' THEN 1.0 ELSE 0.0 END AS protocol_other FROM feat, s""",
)
def m2_z_scores(spark, sf_dir):
    rows = featured(spark, sf_dir)
    scored = scoring.z_transform(rows, scoring.z_statistics(rows.where("label = 0")))
    return scored.select("record_id", F.round("fwd_packets_z", 6).alias("fwd_packets_z"), "protocol_tcp", "protocol_other")


@query("m3_log_rates", f"{_FEAT} SELECT record_id, round(ln(1 + packets_per_second), 8) AS packets_per_second, round(ln(1 + bytes_per_second), 8) AS bytes_per_second FROM feat")
def m3_log_rates(spark, sf_dir):
    return scoring.log_rates(featured(spark, sf_dir)).select("record_id", F.round("packets_per_second", 8).alias("packets_per_second"), F.round("bytes_per_second", 8).alias("bytes_per_second"))


def _assembled(spark, sf_dir, label: str | None = None) -> tuple[DataFrame, list[str]]:
    rows = featured(spark, sf_dir)
    rows = rows.withColumn("label", F.expr(label)) if label else rows
    scored = scoring.z_transform(rows, scoring.z_statistics(rows.where("start_ts < '1996-01-01'")))
    scored = stored(scored, "features")  # read by every pass of the fit
    return scored, [f"{c}_z" for c in scoring.NUMERIC] + [f"protocol_{p}" for p in scoring.PROTOCOLS]


#: A label that the features tell, but for one row in sixteen, whose label is turned around.
LEARNABLE = "CASE WHEN (fwd_packets / 50.0 + bwd_packets / 8.0 + CASE WHEN protocol = 'tcp' THEN 0.5 ELSE 0.0 END > 1.25) <> (substr(md5(record_id), 1, 1) = '0') THEN 1 ELSE 0 END"


@query("m4_forest_metrics")
def m4_forest_metrics(spark, sf_dir):
    """The forest of the operator's defaults (100 trees of depth 16), fitted on the earlier flows, judged on the later ones."""
    rows, features = _assembled(spark, sf_dir, LEARNABLE)
    model = scoring.fit_forest(rows.where("start_ts < '1996-01-01'"), features)
    scored = scoring.score_and_decide(rows.where("start_ts >= '1996-01-01'").drop("score"), model)
    return scoring.with_rates(scored.agg(*scoring.confusion(F.col("label"), F.col("verdict") == "Attack")))


@query("m5_logistic_metrics")
def m5_logistic_metrics(spark, sf_dir):
    rows, features = _assembled(spark, sf_dir, LEARNABLE)
    model = scoring.fit_logistic(rows.where("start_ts < '1996-01-01'"), features)
    scored = scoring.score_and_decide(rows.where("start_ts >= '1996-01-01'").drop("score"), model)
    return scoring.ranking_metrics(scored, "label", "probability_attack")


@query("m5_logistic_learns", f"{_F} SELECT count_if({LEARNABLE} = 1) AS positives, count_if({LEARNABLE} = 0) AS negatives, true AS learnt FROM flows WHERE start_ts >= TIMESTAMP '1996-01-01'")
def m5_logistic_learns(spark, sf_dir):
    """The classes of the later flows, and whether the fit tells them apart as well as the turned labels allow (areas of 0.9 and more)."""
    found = m5_logistic_metrics(spark, sf_dir)
    return found.select("positives", "negatives", ((F.col("roc_auc") >= 0.9) & (F.col("average_precision") >= 0.85)).alias("learnt"))


@query("m7_network_threshold")
def m7_network_threshold(spark, sf_dir):
    """The 14-8-3-8-14 network fitted on the earlier benign rows, its 0.99 threshold over them, and the decisions on all rows."""
    rows, features = _assembled(spark, sf_dir)
    benign = rows.where("label = 0 and start_ts < '1996-01-01'")
    scored = stored(fitting.network_errors(rows, fitting.network(benign, features), features).select("label", "start_ts", "anomaly"), "network-errors")
    threshold = scoring.upper_quantile(scored.where("label = 0 and start_ts < '1996-01-01'"), "anomaly").first()["threshold"]
    return scoring.threshold_counts(scored, "anomaly", threshold if threshold is not None else float("inf")).withColumn("threshold", F.lit(threshold).cast("double"))


#: A network of fixed weights over four inputs, for its forward pass in SQL.
_SIZES, _INPUTS = (4, 3, 2, 3, 4), ("duration_ms / 10000.0", "fwd_packets / 50.0", "bwd_packets / 8.0", "CASE WHEN protocol = 'tcp' THEN 1.0 ELSE 0.0 END")
_FIXED = [
    ([[((7 * n + 5 * i + 3 * j) % 11 - 4) / 8 for j in range(b)] for i in range(a)], [((3 * n + j) % 5 - 1) / 16 for j in range(b)])
    for n, (a, b) in enumerate(zip(_SIZES, _SIZES[1:], strict=False))
]


def _forward_sql() -> str:
    """Single precision, input by input: one common table a layer."""
    tables = [f"{_F}, h0 AS (SELECT record_id, " + ", ".join(f"CAST({x} AS FLOAT) AS v{i}" for i, x in enumerate(_INPUTS)) + " FROM flows)"]
    for n, (w, b) in enumerate(_FIXED):
        cells = []
        for j in range(len(b)):
            z = f"CAST({b[j]!r} AS FLOAT)"
            for i in range(len(w)):
                z = f"CAST({z} + v{i} * CAST({w[i][j]!r} AS FLOAT) AS FLOAT)"
            cells.append((f"greatest({z}, CAST(0 AS FLOAT))" if n < len(_FIXED) - 1 else z) + f" AS v{j}")
        tables.append(f"h{n + 1} AS (SELECT record_id, {', '.join(cells)} FROM h{n})")
    squares = " + ".join(f"pow(CAST(a.v{i} AS DOUBLE) - CAST(b.v{i} AS DOUBLE), 2)" for i in range(_SIZES[0]))
    return f"{', '.join(tables)} SELECT record_id, round(({squares}) / {_SIZES[0]}, 6) AS anomaly FROM h0 a JOIN h{len(_FIXED)} b USING (record_id)"


@query("m7_network_residuals", _forward_sql())
def m7_network_residuals(spark, sf_dir):
    """The forward pass of fixed weights and its residuals, row by row."""
    rows = flows(spark, sf_dir).selectExpr("record_id", *[f"{x} as f{i}" for i, x in enumerate(_INPUTS)])
    scored = fitting.network_errors(rows, fitting.Network(_SIZES, _FIXED), [f"f{i}" for i in range(_SIZES[0])])
    return scored.select("record_id", F.round("anomaly", 6).alias("anomaly"))


@query("m7_anomaly_threshold")
def m7_anomaly_threshold(spark, sf_dir):
    """Residual of a 3-wide linear bottleneck fitted on benign rows, its 0.99 threshold and decision counts."""
    rows, features = _assembled(spark, sf_dir)
    matrix = scoring.fit_bottleneck(rows.where("label = 0"), features).stages[-1].pc.toArray().T.tolist()
    scored = scoring.reconstruction_errors(rows, matrix, features)
    threshold = scoring.upper_quantile(scored.where("label = 0"), "anomaly").first()["threshold"]
    return scoring.threshold_counts(scored, "anomaly", threshold).withColumn("threshold", F.lit(threshold))


@query("m6_decisions", f"{_F}, r AS (SELECT score, CASE WHEN fwd_packets = 7 THEN 'non_finite:fwd_packets' WHEN label = 1 AND duration_ms = 0 THEN 'non_finite:duration_ms' WHEN dst_port % 29 = 0 THEN 'no_probability' END AS withheld FROM flows) SELECT withheld, CASE WHEN withheld IS NULL THEN CASE WHEN score >= 0.5 THEN 'Attack' ELSE 'Benign' END END AS verdict, count(*) AS n, min(score) AS lowest FROM r GROUP BY ALL")
def m6_decisions(spark, sf_dir):
    """Decisions at 0.5 inclusive; vectors with a null or a number that is not finite are withheld."""
    rows = flows(spark, sf_dir).withColumns({"duration_ms": F.expr("if(label = 1 and duration_ms = 0, double('NaN'), duration_ms)"), "fwd_packets": F.expr("if(fwd_packets = 7, null, fwd_packets)"), "p": F.expr("if(dst_port % 29 = 0, null, score)")})
    return scoring.decide(rows, "p", 0.5, ["fwd_packets", "duration_ms", "fwd_bytes"]).groupBy("withheld", "verdict").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"))


_CODE = "(0.6 * fwd_packets + 0.8 * bwd_packets)"


@query("m7_residuals", f"{_F} SELECT record_id, round((pow(fwd_packets - 0.6 * {_CODE}, 2) + pow(bwd_packets - 0.8 * {_CODE}, 2)) / 2, 6) AS anomaly FROM flows")
def m7_residuals(spark, sf_dir):
    scored = scoring.reconstruction_errors(flows(spark, sf_dir), [[0.6, 0.8]], ["fwd_packets", "bwd_packets"])
    return scored.select("record_id", F.round("anomaly", 6).alias("anomaly"))


@query(
    "m7_fixed_threshold",
    f"""{_F}, e AS (SELECT label, (pow(fwd_packets - 0.6 * {_CODE}, 2) + pow(bwd_packets - 0.8 * {_CODE}, 2)) / 2 AS anomaly FROM flows),
r AS (SELECT anomaly, row_number() OVER (ORDER BY anomaly) AS nth, count(*) OVER () AS n FROM e WHERE label = 0), t AS (SELECT anomaly AS threshold FROM r WHERE nth = CAST(ceil(0.99 * (n - 1)) AS BIGINT) + 1)
SELECT round(threshold, 6) AS threshold, count_if(label = 0 AND anomaly > threshold + 1e-6) AS benign_above, count_if(label = 1 AND anomaly > threshold + 1e-6) AS attacks_above FROM e, t GROUP BY threshold""",
)
def m7_fixed_threshold(spark, sf_dir):
    """The residual of fixed components, its 0.99 threshold over benign rows, and what lies above it (by more than a millionth)."""
    scored = scoring.reconstruction_errors(flows(spark, sf_dir), [[0.6, 0.8]], ["fwd_packets", "bwd_packets"])
    least = scoring.upper_quantile(scored.where("label = 0"), "anomaly")  # one row
    above = F.col("anomaly") > F.col("threshold") + 1e-6
    rows = scored.crossJoin(F.broadcast(least)).groupBy("threshold").agg(F.count_if((F.col("label") == 0) & above).alias("benign_above"), F.count_if((F.col("label") == 1) & above).alias("attacks_above"))
    return rows.withColumn("threshold", F.round("threshold", 6))


@query("m8_threshold", f"{_F}, r AS (SELECT fwd_bytes, row_number() OVER (ORDER BY fwd_bytes) AS nth, count(*) OVER () AS n FROM flows WHERE label = 0) SELECT fwd_bytes AS threshold FROM r WHERE nth = CAST(ceil(0.99 * (n - 1)) AS BIGINT) + 1")
def m8_threshold(spark, sf_dir):
    return scoring.upper_quantile(flows(spark, sf_dir).where("label = 0"), "fwd_bytes")


@query("m9_threshold_counts", f"{_F} SELECT count_if(score < 0.5) AS below, count_if(score = 0.5) AS equal, count_if(score > 0.5) AS above FROM flows")
def m9_threshold_counts(spark, sf_dir):
    return scoring.threshold_counts(flows(spark, sf_dir), "score", 0.5)


def _cells(decided: str) -> str:
    return f"count_if(label = 1 AND {decided}) AS tp, count_if(label = 0 AND {decided}) AS fp, count_if(label = 0 AND NOT ({decided})) AS tn, count_if(label = 1 AND NOT ({decided})) AS fn"


_RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
 CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr, (tp + tn) / (tp + tn + fp + fn) AS accuracy, (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END) / 2 AS balanced_accuracy"""


@query("m10_binary_metrics", f"{_F}, c AS (SELECT {_cells('score >= 0.5')} FROM flows) SELECT *, {_RATES} FROM c")
def m10_binary_metrics(spark, sf_dir):
    return scoring.with_rates(flows(spark, sf_dir).agg(*scoring.confusion(F.col("label"), by_score())))


@query(
    "m10_ranking_metrics",
    f"""{_F}, p AS (SELECT score, count_if(label = 1) AS p, count_if(label = 0) AS n FROM flows GROUP BY score),
r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM p)
SELECT round(sum(p * cp / (cp + cn)) / sum(p), 9) AS average_precision, round(sum(n * (cp - p / 2)) / sum(p) / sum(n), 9) AS roc_auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM r""",
)
def m10_ranking_metrics(spark, sf_dir):
    found = scoring.ranking_metrics(flows(spark, sf_dir))
    return found.select(F.round("average_precision", 9).alias("average_precision"), F.round("roc_auc", 9).alias("roc_auc"), "positives", "negatives")


@query("m11_always_benign", f"{_F}, c AS (SELECT {_cells('false')} FROM flows) SELECT *, {_RATES} FROM c")
def m11_always_benign(spark, sf_dir):
    return scoring.with_rates(flows(spark, sf_dir).agg(*scoring.confusion(F.col("label"), F.lit(False))))


@query("m12_per_file_metrics", f"{_F}, c AS (SELECT tuple_key % 4 AS file, {_cells('score >= 0.5')} FROM flows GROUP BY ROLLUP (tuple_key % 4)) SELECT *, {_RATES} FROM c")
def m12_per_file_metrics(spark, sf_dir):
    return scoring.per_file_and_pooled(flows(spark, sf_dir).withColumn("file", F.expr("tuple_key % 4")), "file", "label", by_score())


@query(
    "m13_category_recall",
    f"""{_F}, k(protocol) AS (VALUES ('tcp'), ('udp'), ('icmp'), ('other')), p AS (SELECT protocol, count(*) AS support, count_if(score >= 0.5) AS found FROM flows WHERE label = 1 GROUP BY protocol)
SELECT protocol, coalesce(support, 0) AS support, coalesce(found, 0) AS found, CASE WHEN support > 0 THEN found / support END AS recall FROM k LEFT JOIN p USING (protocol)""",
)
def m13_category_recall(spark, sf_dir):
    listed = spark.createDataFrame([(p,) for p in scoring.PROTOCOLS], "protocol string")
    return scoring.category_recall(flows(spark, sf_dir).where("label = 1"), "protocol", by_score(), listed)


_CELLS14 = f"{_F}, c AS (SELECT label, count_if(score >= 0.5 AND fwd_bytes >= 40000) AS both, count_if(score >= 0.5 AND fwd_bytes < 40000) AS first_only, count_if(score < 0.5 AND fwd_bytes >= 40000) AS second_only, count_if(score < 0.5 AND fwd_bytes < 40000) AS neither FROM flows GROUP BY label)"


@query("m14_detector_overlap", f"{_CELLS14} SELECT * FROM c")
def m14_detector_overlap(spark, sf_dir):
    return scoring.overlap_cells(flows(spark, sf_dir), "label", by_score(), by_bytes())


@query("m14_or_rule", f"{_CELLS14} SELECT CAST(sum(second_only) FILTER (label = 1) AS BIGINT) AS extra_attacks, CAST(sum(second_only) FILTER (label = 0) AS BIGINT) AS extra_false_alarms FROM c")
def m14_or_rule(spark, sf_dir):
    return scoring.or_rule_gain(scoring.overlap_cells(flows(spark, sf_dir), "label", by_score(), by_bytes()))


@query(
    "m15_class_report",
    """WITH e AS (SELECT event_type AS t, CASE WHEN value > 30 THEN 'purchase' WHEN value > 10 THEN 'click' ELSE event_type END AS p FROM events),
k AS (SELECT t AS class FROM e UNION SELECT p FROM e), r AS (SELECT class, (SELECT count(*) FROM e WHERE t = class) AS support, (SELECT count(*) FROM e WHERE p = class) AS predicted, (SELECT count(*) FROM e WHERE p = class AND t = class) AS hits FROM k)
SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM r""",
)
def m15_class_report(spark, sf_dir):
    from tidewatch.plans.views import table

    rows = table(spark, sf_dir, "events").selectExpr("event_type as t", "case when value > 30 then 'purchase' when value > 10 then 'click' else event_type end as p")
    return scoring.class_report(rows, "t", "p")


@query(
    "m16_ablation",
    f"""{_F}, c AS (SELECT {_cells('score >= 0.5').replace(' AS ', ' AS base_')}, {_cells('(score >= 0.5 OR fwd_bytes >= 40000)').replace(' AS ', ' AS candidate_')} FROM flows),
r AS (SELECT *, base_tp / (base_tp + base_fn) AS base_recall, base_tp / (base_tp + base_fp) AS base_precision, 1000.0::DOUBLE * base_fp / (base_fp + base_tn) AS base_alarms_per_1000,
 candidate_tp / (candidate_tp + candidate_fn) AS candidate_recall, candidate_tp / (candidate_tp + candidate_fp) AS candidate_precision, 1000.0::DOUBLE * candidate_fp / (candidate_fp + candidate_tn) AS candidate_alarms_per_1000 FROM c)
SELECT *, CASE WHEN candidate_recall > base_recall AND candidate_alarms_per_1000 <= base_alarms_per_1000 THEN 'improves' WHEN candidate_recall > base_recall THEN 'trades_alarms_for_recall'
 WHEN candidate_alarms_per_1000 < base_alarms_per_1000 THEN 'trades_recall_for_alarms' ELSE 'no_gain' END AS verdict FROM r""",
)
def m16_ablation(spark, sf_dir):
    return scoring.ablation(flows(spark, sf_dir), "label", by_score(), by_score() | by_bytes())


def _draw_sql(source: str) -> str:
    """(file, replicate, k): the least k whose binomial distribution function reaches u, for rows (file, replicate, n, p, u)."""
    by = "PARTITION BY file, replicate"
    spread = "9 * sqrt(n * p * (1 - p)) + 10"
    ranges = f"SELECT *, CAST(greatest(0, floor(n * p - ({spread}))) AS BIGINT) AS lo, CAST(least(n, ceil(n * p + {spread})) AS BIGINT) AS hi FROM {source}"
    weights = f"SELECT *, sum(CASE WHEN k > lo THEN ln((n - k + 1) / k * p / (1 - p)) ELSE 0 END) OVER ({by} ORDER BY k) AS lw FROM (SELECT *, unnest(range(lo, hi + 1)) AS k FROM ({ranges}))"
    upto = f"SELECT file, replicate, u, k, sum(w) OVER ({by} ORDER BY k) / sum(w) OVER ({by}) AS upto FROM (SELECT *, exp(lw - max(lw) OVER ({by})) AS w FROM ({weights}))"
    return f"SELECT file, replicate, min(k) AS k FROM ({upto}) WHERE upto >= u GROUP BY file, replicate"


def _report_sql(file: str, replicates: int = 200) -> str:
    u = ", ".join(f"CAST('0x' || substr(md5('42:' || replicate || ':{i}'), 1, 13) AS BIGINT) / CAST({16**13} AS DOUBLE) AS u{i}" for i in (1, 2, 3))
    low, high = int(0.025 * (replicates - 1)) + 1, int(0.975 * (replicates - 1)) + 1
    ends = ", ".join(f"list_sort(list({r}))[{at}] AS {r}_{end}" for r in ("precision", "recall") for end, at in (("low", low), ("high", high)))
    return f"""{_F}, c AS (SELECT {file} AS file, {_cells('score >= 0.5')}, count(*) AS n FROM flows GROUP BY 1),
r AS (SELECT *, {u} FROM c, (SELECT unnest(range(1, {replicates + 1})) AS replicate)),
t1 AS ({_draw_sql("(SELECT file, replicate, n, tp / n AS p, u1 AS u FROM r)")}),
t2 AS ({_draw_sql("(SELECT r.file, r.replicate, n - t1.k AS n, fp / (n - tp) AS p, u2 AS u FROM r JOIN t1 USING (file, replicate))")}),
t3 AS ({_draw_sql("(SELECT r.file, r.replicate, n - t1.k - t2.k AS n, fn / (n - tp - fp) AS p, u3 AS u FROM r JOIN t1 USING (file, replicate) JOIN t2 USING (file, replicate))")}),
d AS (SELECT file, t1.k / (t1.k + t2.k) AS precision, t1.k / (t1.k + t3.k) AS recall FROM t1 JOIN t2 USING (file, replicate) JOIN t3 USING (file, replicate)),
b AS (SELECT file, {ends} FROM d GROUP BY file)"""


@query("m18_bootstrap", f"{_report_sql('0')} SELECT 'precision' AS metric, precision_low AS low, precision_high AS high FROM b UNION ALL SELECT 'recall', recall_low, recall_high FROM b")
def m18_bootstrap(spark, sf_dir):
    """95 % intervals of precision and recall over all flows."""
    row = scoring.holdout_report(flows(spark, sf_dir), "label", by_score())
    ends = [F.struct(F.lit(m).alias("metric"), F.col(f"{m}_low").alias("low"), F.col(f"{m}_high").alias("high")) for m in ("precision", "recall")]
    return row.select(F.explode(F.array(*ends)).alias("x")).select("x.*")


#: Per file: an inspected split, a malformed digest, an unknown model; file 3 is in order.
_PROTOCOL = ("file = 0", "CASE WHEN file = 1 THEN 'xyz' ELSE repeat(substr('abcdef', file + 1, 1), 64) END", "file = 2")


@query(
    "m18_holdout_report",
    f"""{_report_sql('tuple_key % 4')} SELECT c.file, tp, fp, tn, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, precision_low, precision_high, recall_low, recall_high,
 concat_ws(',', CASE WHEN c.file = 0 THEN 'inspected_split' END, CASE WHEN n < 14950 * (SELECT count(*) FROM flows) / 60000.0 THEN 'too_few_samples' END, CASE WHEN c.file = 1 THEN 'malformed_digest' END, CASE WHEN c.file = 2 THEN 'unknown_model' END) AS reasons
FROM c JOIN b USING (file)""",
)
def m18_holdout_report(spark, sf_dir):
    """A report for each of four files, with the reasons why it cannot close the protocol. The least number of samples is about a quarter of the rows."""
    rows = flows(spark, sf_dir).withColumn("file", F.expr("tuple_key % 4"))
    report = scoring.holdout_report(rows, "label", by_score(), ["file"])
    inspected, digest, unknown = map(F.expr, _PROTOCOL)
    total = rows.count()
    samples = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    reasons = scoring.ineligible_reasons(samples, 200, digest, inspected, F.lit(False), ~unknown, F.lit(True), least_samples=F.lit(14950 * total / 60000))
    return report.withColumn("reasons", F.array_join(reasons, ",")).select("file", "tp", "fp", "tn", "fn", "precision", "recall", "precision_low", "precision_high", "recall_low", "recall_high", "reasons")


_SQ = {"duration": "duration_ms", "fwd": "fwd_packets", "bwd": "bwd_packets"}


@query(
    "m19_cohort_residuals",
    f"""{_F}, l AS (SELECT protocol, 'duration' AS feature, duration_ms AS v FROM flows UNION ALL SELECT protocol, 'fwd', fwd_packets FROM flows UNION ALL SELECT protocol, 'bwd', bwd_packets FROM flows),
p AS (SELECT protocol, feature, avg(v) AS mean, quantile_cont(v, 0.5) AS median, sum(v) AS total FROM l GROUP BY protocol, feature)
SELECT protocol, feature, round(mean, 4) AS mean, round(median, 4) AS median, round(total / sum(total) OVER (PARTITION BY protocol), 8) AS share FROM p""",
)
def m19_cohort_residuals(spark, sf_dir):
    found = scoring.cohort_residuals(flows(spark, sf_dir), "protocol", _SQ)
    return found.select("protocol", "feature", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("share", 8).alias("share"))


_GROUPS = {"duration": ["d"], "packets": ["f", "b"], "protocol": ["t", "u"]}
_AUDITED = "record_id, protocol, label, pow(duration_ms / 10000.0 - 0.5, 2) AS d, pow(fwd_packets / 50.0 - 0.5, 2) AS f, pow(bwd_packets / 8.0 - 0.5, 2) AS b, CASE WHEN protocol = 'tcp' THEN 0.0 ELSE 0.25 END AS t, CASE WHEN protocol = 'udp' THEN 0.25 ELSE 0.0 END AS u"


def _quantiles_sql(value: str, shares: dict[str, float], prefix: str) -> str:
    return ", ".join(f"round(quantile_cont({value}, {q}), 8) AS {prefix}{name}" for name, q in shares.items())


@query(
    "m19_group_residuals",
    f"""{_F}, q AS (SELECT {_AUDITED} FROM flows), e AS (SELECT record_id, protocol || '-' || label AS cohort, 0.0 + d AS duration, 0.0 + f + b AS packets, 0.0 + t + u AS protocol_group FROM q),
w AS (SELECT *, 0.0 + duration + packets + protocol_group AS whole, greatest(duration, packets, protocol_group) AS most FROM e),
l AS (SELECT cohort, 'duration' AS feature_group, duration AS v, whole, most, CAST(duration = most AS INT) + CAST(packets = most AS INT) + CAST(protocol_group = most AS INT) AS tops FROM w
 UNION ALL SELECT cohort, 'packets', packets, whole, most, CAST(duration = most AS INT) + CAST(packets = most AS INT) + CAST(protocol_group = most AS INT) FROM w
 UNION ALL SELECT cohort, 'protocol', protocol_group, whole, most, CAST(duration = most AS INT) + CAST(packets = most AS INT) + CAST(protocol_group = most AS INT) FROM w),
p AS (SELECT cohort, feature_group, count(*) AS rows, sum(v) AS total, round(min(v), 8) AS minimum, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS deviation, round(max(v), 8) AS maximum,
 count_if(whole > 0 AND v = most) AS dominant, count_if(whole > 0 AND v = most AND tops = 1) AS solely_dominant,
 {_quantiles_sql("v", scoring.DISTRIBUTION, "")}, {_quantiles_sql("CASE WHEN whole > 0 THEN v / whole END", scoring.SHARES, "share_")} FROM l GROUP BY ALL)
SELECT * REPLACE (round(total, 4) AS total), round(total / sum(total) OVER (PARTITION BY cohort), 8) AS share FROM p""",
)
def m19_group_residuals(spark, sf_dir):
    """Residuals of cohorts (protocol and label) by groups of features, with ties between groups."""
    rows = flows(spark, sf_dir).selectExpr(
        "record_id", "concat(protocol, '-', label) as cohort", "pow(duration_ms / 10000.0 - 0.5, 2) as d", "pow(fwd_packets / 50.0 - 0.5, 2) as f", "pow(bwd_packets / 8.0 - 0.5, 2) as b",
        "if(protocol = 'tcp', 0.0d, 0.25d) as t", "if(protocol = 'udp', 0.25d, 0.0d) as u",
    )
    found = scoring.group_residuals(rows, "cohort", _GROUPS)
    whole = {"cohort", "feature_group", "rows", "dominant", "solely_dominant"}
    return found.select([F.col(c) if c in whole else F.round(c, 4 if c == "total" else 8).alias(c) for c in found.columns])


@query(
    "m20_concentration",
    f"""{_F}, r AS (SELECT protocol, fwd_bytes, row_number() OVER (PARTITION BY protocol ORDER BY fwd_bytes DESC, record_id) AS nth, count(*) OVER (PARTITION BY protocol) AS n FROM flows), t(top) AS (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE))
SELECT protocol, top, count_if(nth <= ceil(n * top)) AS rows, round(sum(CASE WHEN nth <= ceil(n * top) THEN fwd_bytes END) / sum(fwd_bytes), 9) AS share FROM r, t GROUP BY protocol, top""",
)
def m20_concentration(spark, sf_dir):
    return scoring.concentration(flows(spark, sf_dir), "protocol", "fwd_bytes", "record_id").withColumn("share", F.round("share", 9))


@query("m22_error_ranking", f"{_F} SELECT record_id, CASE WHEN fwd_packets >= bwd_packets THEN 'fwd' ELSE 'bwd' END AS first FROM flows WHERE fwd_packets <> bwd_packets")
def m22_error_ranking(spark, sf_dir):
    ranked = scoring.error_ranking({"fwd": "fwd_packets", "bwd": "bwd_packets"}, top=1)
    return flows(spark, sf_dir).where("fwd_packets <> bwd_packets").select("record_id", ranked[0].alias("first"))


_RISK_SQL = f"""WITH alerts AS ({ALERTS_SQL}), s AS (SELECT alert_id, CASE WHEN alert_id % 5 = 0 THEN NULL ELSE score END AS a, CASE WHEN alert_id % 3 = 0 THEN 1.0::DOUBLE WHEN alert_id % 3 = 1 THEN 0.0::DOUBLE END AS b, CASE WHEN alert_id % 4 = 0 THEN 0.5::DOUBLE END AS c FROM alerts),
r AS (SELECT alert_id, 100.0::DOUBLE * (coalesce(0.3::DOUBLE * a, 0) + coalesce(0.15::DOUBLE * b, 0) + coalesce(0.075::DOUBLE * c, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.075::DOUBLE END, 0) AS risk FROM s)"""


@query("m23_dynamic_risk", f"{_RISK_SQL} SELECT alert_id, round(risk, 6) AS risk, CASE WHEN round(risk, 6) >= 85 THEN 'critical' WHEN round(risk, 6) >= 65 THEN 'high' WHEN round(risk, 6) >= 40 THEN 'medium' WHEN risk IS NOT NULL THEN 'low' END AS severity FROM r")
def m23_dynamic_risk(spark, sf_dir):
    rows = alerts(spark, sf_dir).selectExpr("alert_id", "if(alert_id % 5 = 0, null, score) as supervised_rf", "case when alert_id % 3 = 0 then 1.0d when alert_id % 3 = 1 then 0.0d end as threat_intel_ioc", "if(alert_id % 4 = 0, 0.5d, null) as payload_entropy")
    rows = rows.withColumns({k: F.lit(None).cast("double") for k in scoring.RISK_WEIGHTS if k not in rows.columns})
    return scoring.dynamic_risk(rows).select("alert_id", F.round("risk", 6).alias("risk"), "severity")


@query("m24_composite", f"WITH alerts AS ({ALERTS_SQL}) SELECT alert_id, round(100.0::DOUBLE * (0.35::DOUBLE * score + CASE WHEN alert_id % 2 = 0 THEN 0.1::DOUBLE * 0.25::DOUBLE ELSE 0 END) / (0.35::DOUBLE + CASE WHEN alert_id % 2 = 0 THEN 0.1::DOUBLE ELSE 0 END), 6) AS composite, round(0.5::DOUBLE * score + 0.3::DOUBLE * 0.25::DOUBLE + 0.2::DOUBLE * least(1, greatest(0, (alert_id % 10) / 5.0::DOUBLE)), 6) AS consensus FROM alerts")
def m24_composite(spark, sf_dir):
    rows = alerts(spark, sf_dir).selectExpr("alert_id", "score as rf_prob", "if(alert_id % 2 = 0, 0.25d, null) as asset_crit", "cast(alert_id % 10 as double) as lead")
    rows = rows.withColumns({k: F.lit(None).cast("double") for k in scoring.COMPOSITE_WEIGHTS if k not in rows.columns})
    return rows.select("alert_id", F.round(scoring.weighted_score(scoring.COMPOSITE_WEIGHTS), 6).alias("composite"), F.round(scoring.consensus(F.col("rf_prob"), F.lit(0.25), F.col("lead"), 5.0), 6).alias("consensus"))


@query("m25_drift")
def m25_drift(spark, sf_dir):
    """Later flows against the earlier ones' mean and deviation, for every numeric feature."""
    rows = featured(spark, sf_dir)
    early = rows.where("start_ts < '1996-01-01'").agg(*[F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in scoring.NUMERIC])
    baseline = early.select(F.explode(F.array(*scoring.NUMERIC)).alias("x")).select("x.*")
    return scoring.gaussian_drift(rows.where("start_ts >= '1996-01-01'"), baseline)


#: The normal distribution function by its series of positive terms, 1/2 + density * (x + x^3/3 + x^5/15 + ..), which converges for every x.
_CDF_SQL = "0.5 + exp(-x * x / 2) / sqrt(2 * pi()) * x * (1 + list_sum(list_transform(range(1, 200), lambda n: list_product(list_transform(range(1, n + 1), lambda k: x * x / (2 * k + 1))))))"
_DRIFT_SQL = ", ".join(
    f"struct_pack(feature := '{c}', bm := avg({c}) FILTER (start_ts < TIMESTAMP '1996-01-01'), bs := stddev_samp({c}) FILTER (start_ts < TIMESTAMP '1996-01-01'), m := avg({c}) FILTER (start_ts >= TIMESTAMP '1996-01-01'), s := stddev_samp({c}) FILTER (start_ts >= TIMESTAMP '1996-01-01'), n := count({c}) FILTER (start_ts >= TIMESTAMP '1996-01-01'))"
    for c in scoring.NUMERIC
)


@query(
    "m25_gaussian_psi",
    f"""{_FEAT}, a AS (SELECT unnest([{_DRIFT_SQL}]) AS r FROM feat),
m AS (SELECT r.feature, r.n, (r.m - r.bm) / r.bs AS shift, greatest(r.s / r.bs, 0.1) AS ratio FROM a),
d AS (SELECT *, unnest([{", ".join(f"{d!r}::DOUBLE" for d in scoring.DECILES)}]) AS d, unnest(range(1, {len(scoring.DECILES) + 1})) AS i FROM m),
e AS (SELECT feature, n, shift, i, {_CDF_SQL} AS c FROM (SELECT *, (d - shift) / ratio AS x FROM d) UNION ALL SELECT feature, n, shift, 0, 0.0 FROM m UNION ALL SELECT feature, n, shift, {len(scoring.DECILES) + 1}, 1.0 FROM m),
q AS (SELECT feature, n, shift, greatest(c - lag(c) OVER (PARTITION BY feature ORDER BY i), 1e-4) AS q FROM e QUALIFY i > 0),
w AS (SELECT *, q / sum(q) OVER (PARTITION BY feature) AS x FROM q),
p AS (SELECT feature, n, shift, greatest(0.0, sum((x - 0.1) * ln(x / 0.1))) AS psi FROM w GROUP BY ALL)
SELECT feature, n, round(shift, 6) AS z_shift, round(psi, 6) AS psi, CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 OR n < 2 THEN 'moderate_drift' ELSE 'severe_drift' END AS category FROM p""",
)
def m25_gaussian_psi(spark, sf_dir):
    """The Gaussian drift of the later flows, rounded."""
    found = m25_drift(spark, sf_dir)
    return found.select("feature", "n", F.round("z_shift", 6).alias("z_shift"), F.round("psi", 6).alias("psi"), "category")


@query(
    "m25_empirical_psi",
    f"""{_F}, c AS (SELECT quantile_cont(fwd_bytes, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM flows WHERE start_ts < TIMESTAMP '1996-01-01'),
b AS (SELECT start_ts < TIMESTAMP '1996-01-01' AS early, len(list_filter(cuts, lambda x: x < fwd_bytes)) AS bin FROM flows, c),
s AS (SELECT bin, count_if(early) / (SELECT count(*) FROM b WHERE early) AS p, count_if(NOT early) / (SELECT count(*) FROM b WHERE NOT early) AS q FROM b GROUP BY bin)
SELECT round(sum((greatest(q, 1e-4) - greatest(p, 1e-4)) * ln(greatest(q, 1e-4) / greatest(p, 1e-4))), 8) AS psi FROM s""",
)
def m25_empirical_psi(spark, sf_dir):
    rows = flows(spark, sf_dir)
    return scoring.empirical_psi(rows.where("start_ts < '1996-01-01'"), rows.where("start_ts >= '1996-01-01'"), "fwd_bytes").withColumn("psi", F.round("psi", 8))


@query("m27_alert_rows", f"WITH alerts AS ({ALERTS_SQL}) SELECT alert_id, sha256(unhex(hex(encode('tidewatch:alert')) || '00' || printf('%08x', strlen(CAST(alert_id AS VARCHAR))) || hex(encode(CAST(alert_id AS VARCHAR))) || printf('%08x', strlen(src)) || hex(encode(src)) || printf('%08x', strlen(dst)) || hex(encode(dst)))) AS candidate_id FROM alerts WHERE decision = 'Attack'")
def m27_alert_rows(spark, sf_dir):
    from tidewatch.functions.digests import domain_digest

    return alerts(spark, sf_dir).where("decision = 'Attack'").select("alert_id", domain_digest("tidewatch:alert", [F.col("alert_id"), F.col("src"), F.col("dst")]).alias("candidate_id"))
