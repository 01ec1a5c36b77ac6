"""Fitted models, the hold-out report and the residual audit against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewatch.operators import fitting, scoring
from tidewatch.plans import scoring_queries

SF = "/root/testdata/sf0.001"


def frame(spark, x, y=None):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r), *([] if y is None else [int(y[i])])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ["id", *names, *([] if y is None else ["label"])]).repartition(5), names


def test_logistic_is_the_minimum(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 4)) * [1, 3, 0.1, 1]
    x[:, 3] = x[:, 0]  # a repeated column
    y = (rng.random(900) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 2.0, 0.0] - 1)))).astype(int)
    df, names = frame(spark, x, y)
    for c in (1.0, 0.01):
        model = scoring.fit_logistic(df, names, c=c)
        w, b = np.array(model.weights), model.intercept
        p = 1 / (1 + np.exp(-(x @ w + b)))
        slope = np.append(c * x.T @ (p - y) + w, c * (p - y).sum())
        assert np.abs(slope).max() < 1e-4
    scored = scoring.score_and_decide(df, scoring.fit_logistic(df, names))
    got = {r.id: (r.probability_attack, r.verdict) for r in scored.collect()}
    model = scoring.fit_logistic(df, names)
    for i, row in enumerate(x):
        p = 1 / (1 + math.exp(-(row @ np.array(model.weights) + model.intercept)))
        assert got[i][0] == pytest.approx(p) and got[i][1] == ("Attack" if p >= 0.5 else "Benign")
    assert scoring.ranking_metrics(scored, "label", "probability_attack").first().roc_auc > 0.8
    # Separable rows have a minimum too, and one class or no rows give finite weights.
    assert np.isfinite(scoring.fit_logistic(df.withColumn("label", (F.col("f0") > 0).cast("int")), names).weights).all()
    assert np.isfinite(scoring.fit_logistic(df.withColumn("label", F.lit(1)), names).weights).all()
    assert set(scoring.fit_logistic(df.limit(0), names).weights) == {0.0}


def test_models_of_the_queries_learn(spark):
    row = scoring_queries.m5_logistic_metrics(spark, SF).first()
    assert row.roc_auc > 0.88 and row.average_precision > 0.85
    assert [scoring_queries.m5_logistic_metrics(spark, SF).first().roc_auc for _ in range(3)] == pytest.approx([row.roc_auc] * 3)


def test_a_small_forest_learns(spark):
    rows, features = scoring_queries._assembled(spark, SF, scoring_queries.LEARNABLE)
    model = scoring.fit_forest(rows.where("start_ts < '1996-01-01'"), features, trees=10, depth=8)
    scored = scoring.score_and_decide(rows.where("start_ts >= '1996-01-01'").drop("score"), model)
    found = scoring.with_rates(scored.agg(*scoring.confusion(F.col("label"), F.col("verdict") == "Attack"))).first()
    assert found.balanced_accuracy > 0.8


def test_a_forest_scores_in_a_session_that_has_observed_a_query(spark):
    """A session with an observation cannot be serialized, so a model sent to tasks must not hold it."""
    df = spark.range(400).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 400}
    scored = scoring.score_and_decide(df, scoring.fit_forest(df, ["a", "b"], trees=3, depth=3))
    assert {(r.label, r.verdict): r["count"] for r in scored.groupBy("label", "verdict").count().collect()} == {(0, "Benign"): 229, (1, "Attack"): 171}


def test_network_slopes_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6)) * 0.3
    model = fitting.Network.fresh((6, 5, 2, 5, 6), 3)
    model = model.of(model.flat() + 0.1 * rng.standard_normal(len(model.flat())))  # off the rectifiers' edges
    flat, step = model.flat(), 1e-6
    slope = model.loss(x)[2:]
    for i in rng.choice(len(flat), 25, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += step
        down[i] -= step
        assert slope[i] == pytest.approx((model.of(up).loss(x)[1] - model.of(down).loss(x)[1]) / (2 * step), rel=1e-3, abs=1e-3)
    whole = model.squares(x)
    assert all((model.squares(x[i : i + 1]) == whole[i]).all() for i in range(20))  # a row's score is its own
    z = x.astype(np.float32)
    for n, (w, b) in enumerate(model.layers):
        z = z @ w.astype(np.float32) + b.astype(np.float32)
        z = np.maximum(z, 0) if n < 3 else z
    assert np.abs(whole - (x.astype(np.float32).astype(float) - z) ** 2).max() < 1e-4


def test_network_finds_a_planted_anomaly(spark):
    rng = np.random.default_rng(6)
    code = rng.standard_normal((800, 3))
    x = np.tanh(code @ rng.standard_normal((3, 14))) + 0.01 * rng.standard_normal((800, 14))
    df, names = frame(spark, x)
    model = fitting.network(df, names, steps=40)
    table = fitting.Sums(df, names)
    fresh = fitting.Network.fresh((14, 8, 3, 8, 14), 42)
    assert table.of(model.loss)[1] < 0.5 * table.of(fresh.loss)[1]
    odd = x[0].copy()
    odd[[1, 5, 9]] *= -8
    both = df.unionByName(spark.createDataFrame([(9999, *map(float, odd))], df.columns)).unionByName(spark.createDataFrame([(10000, None, *map(float, odd[1:]))], df.schema))
    scored = fitting.network_errors(both, model, names)
    assert scored.orderBy(F.desc("anomaly")).first().id == 9999
    row = scored.where("id = 5").first()
    assert row.anomaly == pytest.approx(sum(row[f"{n}_sq"] for n in names) / 14)
    assert scored.where("id = 10000").first().anomaly is None
    assert fitting.network(df.limit(0), names, steps=2).sizes == (14, 8, 3, 8, 14)


def test_holdout_intervals_agree_with_resampling(spark):
    rng = np.random.default_rng(8)
    y, p = rng.integers(0, 2, 1500), rng.random(1500)
    df = spark.createDataFrame([(int(a), bool(b > 0.4), int(i % 2)) for i, (a, b) in enumerate(zip(y, p))], "label int, hit boolean, file int")
    got = scoring.holdout_report(df, "label", F.col("hit"), replicates=400).first()
    hit = p > 0.4
    precisions, recalls = [], []
    for _ in range(400):
        at = rng.integers(0, 1500, 1500)
        tp, fp, fn = (hit[at] & (y[at] == 1)).sum(), (hit[at] & (y[at] == 0)).sum(), (~hit[at] & (y[at] == 1)).sum()
        precisions.append(tp / (tp + fp))
        recalls.append(tp / (tp + fn))
    for name, values in (("precision", precisions), ("recall", recalls)):
        low, high = np.sort(values)[[int(0.025 * 399), int(0.975 * 399)]]
        width = high - low
        assert abs(got[f"{name}_low"] - low) < 0.2 * width and abs(got[f"{name}_high"] - high) < 0.2 * width
    per = scoring.holdout_report(df, "label", F.col("hit"), ["file"]).collect()
    assert {r.file for r in per} == {0, 1} and all(r.precision_low < r.precision < r.precision_high for r in per)
    # Cells of nothing: all rows right, no row decided, no rows.
    sure = scoring.holdout_report(df.where("label = 1").withColumn("hit", F.lit(True)), "label", F.col("hit")).first()
    assert (sure.precision_low, sure.recall_high) == (1.0, 1.0)
    none = scoring.holdout_report(df.withColumn("hit", F.lit(False)), "label", F.col("hit")).first()
    assert (none.precision, none.precision_high, none.recall_high) == (0.0, 0.0, 0.0)
    assert scoring.holdout_report(df.limit(0), "label", F.col("hit")).count() == 0


def test_binomials_are_inverted():
    for n, p in ((10, 0.3), (1000, 0.5), (7, 1.0), (7, 0.0), (0, 0.0)):
        low, upto = scoring._binomial(n, p, {})
        pmf = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        assert np.abs(np.diff(np.concatenate([[0], upto])) - pmf[low : low + len(upto)]).max() < 1e-9
    assert len(scoring._binomial(10**12, 0.25, {})[1]) < 10**8


def test_reasons_of_ineligibility(spark):
    good = "a" * 64
    rows = [(5000, good, False, False, True, True, []), (999, good.upper() + " ", None, None, False, None, ["synthetic_fixture", "too_few_samples", "unknown_model", "supply_not_verified"]), (5000, "xyz", True, False, True, True, ["inspected_split", "malformed_digest"]), (5000, "b" * 64, False, False, True, True, ["inspected_split", "inspected_digest"]), (5000, None, False, False, True, True, ["malformed_digest"])]
    df = spark.createDataFrame(rows, "n long, d string, i boolean, s boolean, m boolean, v boolean, want array<string>")
    reasons = scoring.ineligible_reasons(F.col("n"), 200, F.col("d"), F.col("i"), F.col("s"), F.col("m"), F.col("v"), inspected_digests=["b" * 64])
    assert all(r.got == r.want for r in df.select(reasons.alias("got"), "want").collect())
    few = scoring.ineligible_reasons(F.col("n"), 199, F.col("d"), F.col("i"), F.col("s"), F.col("m"), F.col("v"))
    assert df.limit(1).select(few.alias("got")).first().got == ["too_few_replicates"]


def test_residuals_by_group(spark):
    rng = np.random.default_rng(10)
    sq = rng.integers(0, 3, (400, 4)).astype(float)
    sq[:20] = 0
    cohort = [None if i % 7 == 0 else f"c{i % 2}" for i in range(400)]
    df = spark.createDataFrame([(c, *map(float, r)) for c, r in zip(cohort, sq)], "cohort string, a double, b double, c double, d double")
    got = {(r.cohort, r.feature_group): r for r in scoring.group_residuals(df, "cohort", {"one": ["a"], "two": ["b", "c"], "three": ["d"]}).collect()}
    for name in (None, "c0", "c1"):
        mine = np.array([s for s, c in zip(sq, cohort) if c == name])
        errors = np.column_stack([mine[:, 0], mine[:, 1] + mine[:, 2], mine[:, 3]])
        whole = errors.sum(1)
        tops = (errors == errors.max(1)[:, None]) & (whole > 0)[:, None]
        for i, group in enumerate(("one", "two", "three")):
            r, v = got[name, group], errors[:, i]
            assert (r.rows, r.dominant, r.solely_dominant) == (len(v), tops[:, i].sum(), (tops[:, i] & (tops.sum(1) == 1)).sum())
            assert [r.total, r.minimum, r.mean, r.deviation, r.maximum] == pytest.approx([v.sum(), v.min(), v.mean(), v.std(), v.max()])
            assert [r[k] for k in scoring.DISTRIBUTION] == pytest.approx(np.quantile(v, list(scoring.DISTRIBUTION.values())).tolist())
            assert [r[f"share_{k}"] for k in scoring.SHARES] == pytest.approx(np.quantile(v[whole > 0] / whole[whole > 0], list(scoring.SHARES.values())).tolist())
            assert r.share == pytest.approx(v.sum() / whole.sum())
