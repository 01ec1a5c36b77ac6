"""Feature statistics, scores, thresholds, evaluation metrics, risk and drift."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.normalize import mean_size, rate_per_second
from tidewatch.operators import fitting, ranks
from tidewatch.session import shared_dir, stored

NUMERIC = ("duration_ms", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "packets_per_second", "bytes_per_second", "fwd_packet_length_mean", "bwd_packet_length_mean", "dst_port")
PROTOCOLS = ("tcp", "udp", "icmp", "other")


# ---- features


def with_features(flows: DataFrame) -> DataFrame:
    """Flows with their rates and mean sizes (0 where the denominator is)."""
    packets, size = F.col("fwd_packets") + F.col("bwd_packets"), F.col("fwd_bytes") + F.col("bwd_bytes")
    return flows.withColumns(
        {
            "packets_per_second": rate_per_second(packets, F.col("duration_ms")), "bytes_per_second": rate_per_second(size, F.col("duration_ms")),
            "fwd_packet_length_mean": mean_size(F.col("fwd_bytes"), F.col("fwd_packets")), "bwd_packet_length_mean": mean_size(F.col("bwd_bytes"), F.col("bwd_packets")),
        }
    )


def z_statistics(train: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """One row: <column>_mean and <column>_scale (population deviation; 1 where it is 0)."""
    aggs = []
    for c in columns:
        spread = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(spread > 0, spread).otherwise(1.0).alias(f"{c}_scale")]
    return train.agg(*aggs)


def z_transform(df: DataFrame, statistics: DataFrame, columns: Sequence[str] = NUMERIC, protocol: str = "protocol") -> DataFrame:
    """`df` with <column>_z and one-hot protocols; an unknown protocol is an error. The statistics are one row."""
    scored = df.crossJoin(F.broadcast(statistics)).withColumns({f"{c}_z": (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale") for c in columns})
    known = F.when(F.col(protocol).isin(*PROTOCOLS), F.col(protocol)).otherwise(F.raise_error(F.concat(F.lit("unknown protocol: "), F.coalesce(F.col(protocol), F.lit("null")))))
    hot = {f"protocol_{p}": (known == p).cast("double") for p in PROTOCOLS}
    return scored.withColumns(hot).drop(*[f"{c}_{k}" for c in columns for k in ("mean", "scale")])


def log_rates(df: DataFrame) -> DataFrame:
    """The two rates as log(1 + x)."""
    return df.withColumns({c: F.log1p(c) for c in ("packets_per_second", "bytes_per_second")})


def raw_units(df: DataFrame) -> DataFrame:
    """Canonical to raw representation: seconds and one-hot protocols; unset inputs stay null."""
    return df.withColumn("duration_s", F.col("duration_ms") / 1000.0).withColumns({f"proto_{p}": (F.col("protocol") == p).cast("int") for p in PROTOCOLS})


#: Trees of a forest that are fitted together, and megabytes of histograms that a task of a pass holds.
TREES_AT_ONCE, HISTOGRAM_MB = 25, 256


class Forest:
    """A random forest in parts, fitted one after the other: its probability is the mean over all trees."""

    def __init__(self, parts: Sequence, sizes: Sequence[int]):
        self.parts, self.sizes = parts, sizes

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with probability_attack."""
        from pyspark.ml.functions import vector_to_array

        scored = df
        for i, part in enumerate(self.parts):
            scored = part.transform(scored).withColumn(f"_p{i}", vector_to_array("_part")[1]).drop("features", "_part")
        mean = sum((F.col(f"_p{i}") * n for i, n in enumerate(self.sizes)), F.lit(0.0)) / sum(self.sizes)
        return scored.withColumn("probability_attack", mean).drop(*[f"_p{i}" for i in range(len(self.sizes))])


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "label", trees: int = 100, depth: int = 16, leaf: int = 5, seed: int = 42) -> Forest:
    """Random forest over assembled features (MLlib), TREES_AT_ONCE trees at a time. Rows keep their node from level to level, with
    checkpoints in the shared folder, and a task takes as many nodes in a pass as fit HISTOGRAM_MB.

    MLlib holds a row with a count and a node for every tree that it fits, and each task the histograms of a pass: what is held is
    bounded by these two numbers, not by the number of trees. All trees draw from all rows.

    The models are written there and read back: a fitted one of two classes holds its training summary and with it the session, which
    cannot be sent to tasks once something in it has observed a query."""
    spark = train.sparkSession
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    parts, sizes = [], [min(TREES_AT_ONCE, trees - at) for at in range(0, trees, TREES_AT_ONCE)]
    for i, n in enumerate(sizes):
        path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/forest-{uuid.uuid4().hex}"
        # MLlib adds a partition's number to the seed, so parts are far apart.
        forest = RandomForestClassifier(
            featuresCol="features", labelCol=label, probabilityCol="_part", rawPredictionCol="", predictionCol="", numTrees=n, maxDepth=depth, minInstancesPerNode=leaf,
            featureSubsetStrategy="sqrt", seed=seed + 1_000_003 * i, cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=HISTOGRAM_MB,
        )
        Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest]).fit(train).save(path)
        parts.append(PipelineModel.load(path))
    return Forest(parts, sizes)


def fit_logistic(train: DataFrame, features: Sequence[str], label: str = "label", c: float = 1.0, iterations: int = 1000) -> fitting.Logistic:
    """L2 logistic regression: the summed loss times c, plus half the squared weights, to its minimum."""
    return fitting.logistic(train, features, label, c, iterations)


def fit_bottleneck(benign: DataFrame, features: Sequence[str], width: int = 3):
    """The linear bottleneck of benign rows (PCA) whose residual is the anomaly score."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), PCA(k=width, inputCol="features", outputCol="code")]).fit(benign)


def reconstruction_errors(df: DataFrame, components: Sequence[Sequence[float]], features: Sequence[str], means: Sequence[float] | None = None) -> DataFrame:
    """`df` with <feature>_sq and anomaly (their mean): squared residuals after projection on the orthonormal
    rows of `components`, as column expressions."""
    x = F.array(*[F.col(f) - F.lit(float(m)) for f, m in zip(features, means or [0.0] * len(features), strict=True)])
    codes = F.array(*[F.aggregate(F.zip_with(x, F.array(*map(F.lit, map(float, row))), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v) for row in components])

    def squares(code: Column) -> Column:
        back = [sum((code[i] * F.lit(float(row[j])) for i, row in enumerate(components)), F.lit(0.0)) for j in range(len(features))]
        return F.zip_with(x, F.array(*back), lambda v, b: (v - b) * (v - b))

    # A one-element transform binds the codes, so that they are computed once a row.
    df = df.withColumn("_sq", F.transform(F.array(codes), squares)[0])
    df = df.withColumn("anomaly", F.aggregate("_sq", F.lit(0.0), lambda s, v: s + v) / len(features))
    return df.withColumns({f"{f}_sq": F.col("_sq")[j] for j, f in enumerate(features)}).drop("_sq")


def decide(df: DataFrame, probability: str, threshold: float = 0.5, features: Sequence[str] = ()) -> DataFrame:
    """`df` with withheld (why its feature vector cannot be scored, or null) and verdict: Attack from the threshold on, else
    Benign; null where the vector or the probability is missing."""
    reason = withheld_reason(features) if features else F.lit(None).cast("string")
    rows = df.withColumn("withheld", F.coalesce(reason, F.when(F.col(probability).isNull() | F.isnan(probability), "no_probability")))
    return rows.withColumn("verdict", F.when(F.col("withheld").isNull(), F.when(F.col(probability) >= threshold, "Attack").otherwise("Benign")))


def score_and_decide(df: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """`df` with probability_attack and the verdict of `decide`."""
    if isinstance(model, fitting.Logistic):
        return decide(df.withColumn("probability_attack", model.probability()), "probability_attack", threshold)
    if isinstance(model, Forest):
        return decide(model.transform(df), "probability_attack", threshold)
    from pyspark.ml.functions import vector_to_array

    return decide(model.transform(df).withColumn("probability_attack", vector_to_array("probability")[1]), "probability_attack", threshold)


def withheld_reason(features: Sequence[str]) -> Column:
    """Why a feature vector cannot be scored (its first null or non-finite feature), else null."""
    return F.coalesce(*[F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f).cast("double")) == float("inf")), F.lit(f"non_finite:{f}")) for f in features])


# ---- thresholds and metrics


def upper_quantile(df: DataFrame, score: str, q: float = 0.99, ranges: int = 64, most: int = 100_000) -> DataFrame:
    """One row: threshold, the order statistic at ceil(q (n - 1)) (the next value up, no interpolation).

    Over the distinct values with their row counts. Running sums go by `ranges` of distinct values; the one that holds
    the wanted row is cut again until at most `most` distinct values are left to be ordered."""
    per = stored(df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("v")).agg(F.count(F.lit(1)).alias("c")), "quantile")
    size = per.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("values")).first()
    row, values = size["n"] or 0, size["values"]
    rank = row - math.ceil(q * (row - 1)) if row else 0  # from the top, 1 = largest
    while values > max(most, 1):
        # The cuts only say where to sum: that they are approximate changes no result.
        cuts = per.agg(F.array_distinct(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10_000)).alias("cuts"))
        placed = per.crossJoin(F.broadcast(cuts)).withColumn("b", F.size(F.filter("cuts", lambda x: x < F.col("v"))))
        for r in placed.groupBy("b").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("values")).orderBy(F.desc("b")).collect():  # one row a range
            if rank <= r["n"]:
                break
            rank -= r["n"]
        if r["values"] == values:
            break
        per, values = placed.where(F.col("b") == r["b"]).select("v", "c"), r["values"]
    above = F.sum("c").over(Window.orderBy(F.desc("v")))
    return per.withColumn("above", above).where(F.col("above") >= rank).agg(F.max("v").alias("threshold"))


def threshold_counts(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """One row: below, equal and above (decisions are strictly above)."""
    s = F.col(score)
    return df.agg(F.count_if(s < threshold).alias("below"), F.count_if(s == threshold).alias("equal"), F.count_if(s > threshold).alias("above"))


def confusion(label: Column, decided: Column) -> list[Column]:
    hit = F.coalesce(decided, F.lit(False))
    return [
        F.count_if((label == 1) & hit).alias("tp"), F.count_if((label == 0) & hit).alias("fp"),
        F.count_if((label == 0) & ~hit).alias("tn"), F.count_if((label == 1) & ~hit).alias("fn"),
    ]


def _ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(default).cast("double"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, false-positive rate (0 for an empty denominator), accuracy, balanced accuracy (null for one)."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    tpr, tnr = _ratio(tp, tp + fn, None), _ratio(tn, tn + fp, None)
    return counts.withColumns(
        {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn), "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "balanced_accuracy": (tpr + tnr) / 2}
    )


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: average precision (no interpolation) and ROC-AUC (ties count half); null without both classes.

    Over the distinct scores with their class counts; running sums go by score ranges, not one window."""
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    bounds = per.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    block = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("hi") - F.col("s")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(0)
    per = per.crossJoin(F.broadcast(bounds)).withColumn("b", block)
    starts = per.groupBy("b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("b", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("sp"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("sn"))
    inside = Window.partitionBy("b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = per.join(F.broadcast(starts), "b").withColumns({"cp": F.col("sp") + F.sum("p").over(inside), "cn": F.col("sn") + F.sum("n").over(inside)})
    sums = run.agg(
        F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cn"))).alias("_ap"), F.sum(F.col("n") * (F.col("cp") - F.col("p") / 2)).alias("_auc"),
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return sums.select(F.when(F.col("positives") > 0, F.col("_ap") / F.col("positives")).alias("average_precision"), F.when(both, F.col("_auc") / F.col("positives") / F.col("negatives")).alias("roc_auc"), "positives", "negatives")


def per_file_and_pooled(df: DataFrame, file: str, label: str, decided: Column) -> DataFrame:
    """Confusion counts and rates per file and, under a null file, over all."""
    return with_rates(df.rollup(file).agg(*confusion(F.col(label), decided)))


def category_recall(df: DataFrame, category: str, decided: Column, categories: DataFrame) -> DataFrame:
    """(category, support, found, recall) for every listed category, zero rows kept."""
    per = df.groupBy(category).agg(F.count(F.lit(1)).alias("support"), F.count_if(decided).alias("found"))
    rows = categories.join(per, category, "left").fillna(0, ["support", "found"])
    return rows.withColumn("recall", _ratio(F.col("found"), F.col("support"), None))


def overlap_cells(df: DataFrame, label: str, first: Column, second: Column) -> DataFrame:
    """(label, both, first_only, second_only, neither) of two detectors."""
    return df.groupBy(label).agg(F.count_if(first & second).alias("both"), F.count_if(first & ~second).alias("first_only"), F.count_if(~first & second).alias("second_only"), F.count_if(~first & ~second).alias("neither"))


def or_rule_gain(cells: DataFrame, label: str = "label") -> DataFrame:
    """What the OR of both detectors adds to the first: attacks and false alarms."""
    return cells.agg(F.coalesce(F.sum(F.when(F.col(label) == 1, F.col("second_only"))), F.lit(0)).alias("extra_attacks"), F.coalesce(F.sum(F.when(F.col(label) == 0, F.col("second_only"))), F.lit(0)).alias("extra_false_alarms"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, support, predicted, hits, precision, recall) of a K-class decision."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hits")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")))).alias("x")).select("x.*")
    per = both.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "hits")))
    return per.withColumns({"precision": _ratio(F.col("hits"), F.col("predicted")), "recall": _ratio(F.col("hits"), F.col("support"))})


def ablation(df: DataFrame, label: str, base: Column, candidate: Column) -> DataFrame:
    """One row: recall and precision of a baseline and a candidate, false alarms per 1000 benign, and the verdict."""
    y = F.col(label)
    sides = [c.alias(f"{side}_{name}") for side, d in (("base", base), ("candidate", candidate)) for name, c in zip(("tp", "fp", "tn", "fn"), confusion(y, d), strict=True)]
    row = df.agg(*sides)
    for side in ("base", "candidate"):
        tp, fp, tn, fn = (F.col(f"{side}_{c}").cast("double") for c in ("tp", "fp", "tn", "fn"))
        row = row.withColumns({f"{side}_recall": _ratio(tp, tp + fn), f"{side}_precision": _ratio(tp, tp + fp), f"{side}_alarms_per_1000": _ratio(1000 * fp, fp + tn)})
    gain, cost = F.col("candidate_recall") - F.col("base_recall"), F.col("candidate_alarms_per_1000") - F.col("base_alarms_per_1000")
    verdict = F.when((gain > 0) & (cost <= 0), "improves").when((gain > 0) & (cost > 0), "trades_alarms_for_recall").when((gain <= 0) & (cost < 0), "trades_recall_for_alarms").otherwise("no_gain")
    return row.withColumn("verdict", verdict)


def bootstrap_intervals(df: DataFrame, label: str, decided: Column, row_id: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """(metric, low, high): 95 % intervals of precision and recall by a Poisson(1) bootstrap: in every replicate, each row's
    weight is drawn from a hash of its id.

    A row's replicates are made and summed where the row is read; what is shuffled is one row a replicate and cell. True
    negatives count in neither rate and are left out."""
    y = F.col(label)
    hit = F.coalesce(decided, F.lit(False))
    cell = F.when((y == 1) & hit, "tp").when((y == 0) & hit, "fp").when(y == 1, "fn").otherwise("tn")
    rows = df.select(F.xxhash64(F.lit(seed), F.col(row_id).cast("string")).alias("h"), cell.alias("cell")).where("cell <> 'tn'")
    drawn = rows.select("h", "cell", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    u = F.pmod(F.xxhash64("h", "replicate"), F.lit(1 << 32))
    weight, total, p = F.lit(0), 0.0, math.exp(-1)
    for k in range(8):
        total += p
        weight = weight + (u >= int(total * (1 << 32))).cast("int")
        p /= k + 1
    long = drawn.groupBy("replicate", "cell").agg(F.sum(weight).alias("w"))
    per = long.groupBy("replicate").agg(*[F.coalesce(F.sum(F.when(F.col("cell") == c, F.col("w"))), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    rates = per.select(_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    long = rates.select(F.explode(F.array(F.struct(F.lit("precision").alias("metric"), F.col("precision").alias("v")), F.struct(F.lit("recall").alias("metric"), F.col("recall").alias("v")))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))  # as many values as replicates


def _binomial(n: int, p: float, known: dict[tuple[int, float], tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """(first value, distribution function from there on) of a binomial, over nine deviations around its mean and ten more."""
    if (n, p) not in known:
        spread = 9 * math.sqrt(n * p * (1 - p)) + 10
        low, high = max(0, math.floor(n * p - spread)), min(n, math.ceil(n * p + spread))
        k = np.arange(low + 1, high + 1, dtype=float)
        w = np.concatenate([[0.0], np.cumsum(np.log((n - k + 1) / k * p / (1 - p)))]) if 0 < p < 1 else np.where(np.arange(low, high + 1) == n * p, 0.0, -np.inf)
        w = np.exp(w - w.max())
        known.clear()
        known[n, p] = low, np.cumsum(w) / w.sum()
    return known[n, p]


def _drawn(n: Column, p: Column, u: Column) -> Column:
    """The least k at which the distribution function of Binomial(n, p) reaches u."""

    @F.arrow_udf("long")
    def quantile(n: pa.Array, p: pa.Array, u: pa.Array) -> pa.Array:
        out, known = [], {}
        for a, b, c in zip(n.to_pylist(), p.to_pylist(), u.to_pylist(), strict=True):
            low, upto = _binomial(a, b, known)
            out.append(low + min(int(np.searchsorted(upto, c)), len(upto) - 1))
        return pa.array(out, pa.int64())

    return quantile(n, p, u)


def holdout_report(df: DataFrame, label: str, decided: Column, by: Sequence[str] = (), replicates: int = 200, seed: int = 42) -> DataFrame:
    """([by..,] tp, fp, tn, fn, precision, recall, and low and high of their 95 % bootstrap intervals).

    Resampling rows with replacement resamples the four cells as a multinomial: three binomials in turn, drawn by their
    inverse distribution at hashes of seed and replicate. So the work is a count of the rows and `replicates` small draws, whatever
    the number of rows. Bounds are order statistics, without interpolation; a rate of an empty denominator is 0."""
    cells = df.groupBy(*by).agg(*confusion(F.col(label), decided))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    rows = cells.where(n > 0).withColumn("n", n).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))

    def u(turn: int) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.lit(str(turn)))), 1, 13), 16, 10).cast("double") / float(16**13)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    rows = rows.withColumn("_tp", _drawn(F.col("n"), share(F.col("tp"), F.col("n")), u(1)))
    rows = rows.withColumn("_fp", _drawn(F.col("n") - F.col("_tp"), share(F.col("fp"), F.col("n") - F.col("tp")), u(2)))
    rows = rows.withColumn("_fn", _drawn(F.col("n") - F.col("_tp") - F.col("_fp"), share(F.col("fn"), F.col("n") - F.col("tp") - F.col("fp")), u(3)))
    low, high = int(0.025 * (replicates - 1)), int(0.975 * (replicates - 1))
    rates = {"precision": _ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")), "recall": _ratio(F.col("_tp"), F.col("_tp") + F.col("_fn"))}
    ends = [F.element_at(F.array_sort(F.collect_list(r)), at + 1).alias(f"{name}_{end}") for name, r in rates.items() for end, at in (("low", low), ("high", high))]
    per = rows.groupBy(*by, "tp", "fp", "tn", "fn").agg(*ends)  # `replicates` values each
    found = {"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))}
    return per.withColumns(found)


def ineligible_reasons(samples: Column, replicates: int, digest: Column, inspected: Column, synthetic: Column, model_known: Column, supply_verified: Column, inspected_digests: Sequence[str] = (), least_samples: int = 1000, least_replicates: int = 200) -> Column:
    """Why a hold-out evaluation cannot close the protocol, in a fixed order, as an array; empty if it can."""
    clean = F.lower(F.trim(digest))
    seen = clean.isin(*inspected_digests) if inspected_digests else F.lit(False)
    well_formed = F.coalesce(clean.rlike("^[0-9a-f]{64}$"), F.lit(False))
    tests = [
        ("inspected_split", F.coalesce(inspected, F.lit(False)) | F.coalesce(seen, F.lit(False))), ("synthetic_fixture", F.coalesce(synthetic, F.lit(True))), ("too_few_samples", samples < least_samples),
        ("too_few_replicates", F.lit(replicates < least_replicates)), ("malformed_digest", ~well_formed), ("inspected_digest", well_formed & seen),
        ("unknown_model", ~F.coalesce(model_known, F.lit(False))), ("supply_not_verified", ~F.coalesce(supply_verified, F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


#: Shares of the distributions that the audit of residuals tells, and of the records' shares of error.
DISTRIBUTION = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
SHARES = {k: v for k, v in DISTRIBUTION.items() if k != "p95"}


def group_residuals(df: DataFrame, cohort: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(cohort, feature_group, rows, total, share, minimum, mean, deviation, p10 .. p99, maximum, share_p10 .. share_p99, dominant,
    solely_dominant): how a cohort's squared residuals are spread over groups of features.

    A record's error in a group is the sum over its columns. `share` is of the cohort's error (null without any); share_* are
    quantiles of the records' own shares, over records with an error. A group dominates a record whose largest group
    error it has, solely if no other group ties. Quantiles interpolate between neighbours."""
    sums = [sum((F.col(c).cast("double") for c in columns), F.lit(0.0)) for columns in groups.values()]
    rows = df.select(F.col(cohort), F.array(*sums).alias("_e"))
    rows = rows.withColumns({"_all": F.aggregate("_e", F.lit(0.0), lambda a, b: a + b), "_most": F.array_max("_e")})
    rows = rows.withColumn("_tops", F.size(F.filter("_e", lambda v: v == F.col("_most"))))
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("feature_group"), F.col("_e")[i].alias("v"), F.when(F.col("_all") > 0, F.col("_e")[i] / F.col("_all")).alias("s"),
            ((F.col("_all") > 0) & (F.col("_e")[i] == F.col("_most"))).alias("top"),
        )
        for i, name in enumerate(groups)
    ])
    long = stored(rows.select(cohort, "_tops", F.explode(cells).alias("x")).select(cohort, "_tops", "x.*"), "residuals")
    per = long.groupBy(cohort, "feature_group").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("v").alias("total"), F.min("v").alias("minimum"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.max("v").alias("maximum"),
        F.count_if("top").alias("dominant"), F.count_if(F.col("top") & (F.col("_tops") == 1)).alias("solely_dominant"),
    )
    for value, shares, prefix in (("v", DISTRIBUTION, ""), ("s", SHARES, "share_")):
        found = ranks.quantiles(long, [cohort, "feature_group"], value, list(shares.values())).select(F.col(cohort).alias("_c"), F.col("feature_group").alias("_g"), "quantiles")
        per = per.join(found, F.col(cohort).eqNullSafe(F.col("_c")) & (F.col("feature_group") == F.col("_g")), "left")
        per = per.withColumns({prefix + name: F.col("quantiles")[i] for i, name in enumerate(shares)}).drop("_c", "_g", "quantiles")
    return per.withColumn("share", F.try_divide("total", F.sum("total").over(Window.partitionBy(cohort))))  # a row a group


def cohort_residuals(df: DataFrame, cohort: str, squares: Mapping[str, str]) -> DataFrame:
    """(cohort, feature, mean, median, total, share) of squared residuals; share is of the cohort's total."""
    long = df.select(cohort, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).cast("double").alias("v")) for f, c in squares.items()])).alias("x")).select(cohort, "x.*")
    per = long.groupBy(cohort, "feature").agg(F.avg("v").alias("mean"), F.sum("v").alias("total"))
    middle = ranks.quantiles(long, [cohort, "feature"], "v", [0.5]).select(F.col(cohort).alias("_c"), F.col("feature").alias("_f"), F.col("quantiles")[0].alias("median"))
    per = per.join(middle, F.col(cohort).eqNullSafe(F.col("_c")) & (F.col("feature") == F.col("_f")), "left")
    return per.select(cohort, "feature", "mean", "median", "total", F.try_divide("total", F.sum("total").over(Window.partitionBy(cohort))).alias("share"))


def concentration(df: DataFrame, cohort: str, score: str, row_id: str, shares: Sequence[float] = (0.01, 0.05, 0.1)) -> DataFrame:
    """(cohort, top, rows, share): the share of a cohort's score in its top rows (rounded up)."""
    ranked = ranks.with_rank(df.select(cohort, score, row_id), [cohort], [F.col(score).desc_nulls_last(), F.col(row_id).asc()], "_nth", "_n")
    parts = [F.struct(F.lit(s).alias("top"), F.sum(F.when(F.col("_nth") <= F.ceil(F.col("_n") * s), F.col(score))).alias("sum"), F.count_if(F.col("_nth") <= F.ceil(F.col("_n") * s)).alias("rows")) for s in shares]
    per = ranked.groupBy(cohort).agg(F.array(*parts).alias("tops"), F.sum(score).alias("total"))
    return per.select(cohort, F.explode("tops").alias("x"), "total").select(cohort, "x.top", "x.rows", F.try_divide("x.sum", "total").alias("share"))


def error_ranking(squares: Mapping[str, str], top: int = 3) -> Column:
    """The features of a row by descending squared error (ties by name)."""
    pairs = F.array(*[F.struct((-F.col(c)).alias("e"), F.lit(f).alias("f")) for f, c in squares.items()])
    return F.transform(F.slice(F.array_sort(pairs), 1, top), lambda x: x.f)


# ---- risk

#: Weights of the risk signals.
RISK_WEIGHTS = {"supervised_rf": 0.30, "autoencoder_v2_reconstruction": 0.15, "isolation_forest_outlier": 0.10, "ueba_behavioral_deviation": 0.15, "threat_intel_ioc": 0.15, "payload_entropy": 0.075, "periodic_beaconing": 0.075}
COMPOSITE_WEIGHTS = {"rf_prob": 0.35, "ae_error": 0.15, "ti_confidence": 0.15, "asset_crit": 0.10, "vel_burst": 0.10, "hist_fp": 0.05, "campaign_sev": 0.10}


def weighted_score(weights: Mapping[str, float], columns: Mapping[str, str] | None = None) -> Column:
    """100 x the weighted mean of the signals present; absent ones leave the denominator; null without any."""
    present = [(w, F.col((columns or {}).get(k, k)).cast("double")) for k, w in weights.items()]
    total = sum((F.when(c.isNotNull(), F.lit(w) * c).otherwise(0.0) for w, c in present), F.lit(0.0))
    base = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for w, c in present), F.lit(0.0))
    return F.when(base > 0, F.lit(100.0) * (total / base))


def dynamic_risk(df: DataFrame, weights: Mapping[str, float] = RISK_WEIGHTS) -> DataFrame:
    """`df` with risk (0 to 100), severity and risk_base; rows without any signal have a null risk and severity."""
    risk = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when(weighted_score(weights).isNotNull(), weighted_score(weights))))
    risk = F.when(weighted_score(weights).isNotNull(), risk)
    base = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    level = F.when(F.col("risk") >= 85, "critical").when(F.col("risk") >= 65, "high").when(F.col("risk") >= 40, "medium").when(F.col("risk").isNotNull(), "low")
    return df.withColumns({"risk": risk, "risk_base": base}).withColumn("severity", level)


def consensus(a: Column, b: Column, lead: Column, limit: float) -> Column:
    """0.5 a + 0.3 b + 0.2 of the lead's share of its limit, clamped to 0 .. 1."""
    return 0.5 * a + 0.3 * b + 0.2 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), lead / limit))


# ---- drift

#: Inner decile points of the standard normal distribution.
DECILES = (-1.2815515655446004, -0.8416212335729143, -0.5244005127080409, -0.2533471031357997, 0.0, 0.2533471031357997, 0.5244005127080409, 0.8416212335729143, 1.2815515655446004)


def gaussian_drift(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """(feature, n, sample_mean, sample_std, z_shift, psi, category) of numeric columns against a baseline
    (feature, mean, std). The per-feature rows are few; only their PSI runs in Arrow, for the normal CDF."""
    names = [r["feature"] for r in baseline.select("feature").collect()]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in names])).alias("x")).select("x.*")
    per = long.groupBy("feature").agg(F.count("v").alias("n"), F.avg("v").alias("sample_mean"), F.stddev_samp("v").alias("sample_std"))
    rows = per.join(F.broadcast(baseline), "feature")

    @F.arrow_udf("double")
    def psi(mean: pa.Array, std: pa.Array, base_mean: pa.Array, base_std: pa.Array) -> pa.Array:
        out = []
        for m, s, bm, bs in zip(mean.to_pylist(), std.to_pylist(), base_mean.to_pylist(), base_std.to_pylist(), strict=True):
            if m is None or not bs or bs <= 0:
                out.append(None)
                continue
            shift, ratio = (m - bm) / bs, max((s if s is not None and not math.isnan(s) else bs) / bs, 0.1)
            edges = [0.0, *(0.5 * (1 + math.erf((d - shift) / ratio / math.sqrt(2))) for d in DECILES), 1.0]
            q = [max(b - a, 1e-4) for a, b in zip(edges, edges[1:], strict=False)]
            out.append(max(0.0, sum((x / sum(q) - 0.1) * math.log(x / sum(q) / 0.1) for x in q)))
        return pa.array(out, pa.float64())

    rows = rows.withColumn("psi", psi("sample_mean", "sample_std", "mean", "std")).withColumn("z_shift", F.when(F.col("std") > 0, (F.col("sample_mean") - F.col("mean")) / F.col("std")))
    category = F.when(F.col("psi").isNull(), "undefined_baseline").when(F.col("psi") < 0.10, "stable").when((F.col("psi") < 0.25) | (F.col("n") < 2), "moderate_drift").otherwise("severe_drift")
    return rows.withColumn("category", category).select("feature", "n", "sample_mean", "sample_std", "z_shift", "psi", "category")


def empirical_psi(before: DataFrame, after: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: PSI of a column between two tables over the first one's quantile bins (empty shares count 1e-4)."""
    cuts = ranks.quantiles(before, [], column, [i / bins for i in range(1, bins)], "cuts")

    def shares(df: DataFrame, name: str) -> DataFrame:
        binned = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(cuts)).select(F.size(F.filter("cuts", lambda c: c < F.col(column))).alias("bin"))
        per = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
        return per.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))

    rows = before.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(shares(before, "p"), "bin", "left").join(shares(after, "q"), "bin", "left")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-4)) for c in (F.col("p"), F.col("q")))
    return rows.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def acceptance_gates(cells: DataFrame) -> DataFrame:
    """Integer gates over (attacks_gained, attacks_lost, alarms_gained, alarms_lost): more attacks, at least 3 attacks per
    40 extra alarms, and both, as booleans; the price per attack is named infinite where no attack is gained."""
    a, b = F.col("attacks_gained") - F.col("attacks_lost"), F.col("alarms_gained") - F.col("alarms_lost")
    price = F.when((a <= 0) & (b > 0), "infinite").when(a <= 0, "undefined").otherwise((b / a).cast("decimal(20,4)").cast("string"))
    return cells.withColumns({"gains": a > 0, "affordable": 40 * a >= 3 * b, "price": price}).withColumn("accepted", F.col("gains") & F.col("affordable"))


def cohort_ratios(df: DataFrame, cohort: str, score: str, base: str) -> DataFrame:
    """(cohort, mean, ratio) of a score against the mean of the `base` cohort; null where that is 0 or absent."""
    per = df.groupBy(cohort).agg(F.avg(score).alias("mean"))
    ref = per.where(F.col(cohort) == base).agg(F.max("mean").alias("_base"))
    return per.crossJoin(ref).select(cohort, "mean", F.try_divide("mean", "_base").alias("ratio"))


def queue_ratios(cells: DataFrame) -> DataFrame:
    """Queue sizes and their ratio of the first detector alone and of the OR rule, from overlap cells of both labels."""
    sums = cells.agg(F.sum(F.col("both") + F.col("first_only")).alias("first_queue"), F.sum(F.col("both") + F.col("first_only") + F.col("second_only")).alias("or_queue"))
    return sums.withColumn("growth", F.try_divide(F.col("or_queue").cast("double"), F.col("first_queue")))
