"""Ranks and running values over parts, and clusters over batches, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import burst, correlate, leakage, ranks, scoring, timeline


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, None if g == 4 else f"g{min(g, 2)}", float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 5, 900), rng.integers(0, 30, 900)))], "id long, g string, v double")


def test_ranks_and_running_sums(spark, rows):
    frame = rows.toPandas().fillna({"g": "~"}).sort_values(["g", "v", "id"])
    got = ranks.with_rank(rows, ["g"], [F.col("v").asc(), F.col("id").asc()], "nth", "n").toPandas().fillna({"g": "~"}).set_index("id")
    assert got.nth[frame.id].tolist() == (frame.groupby("g").cumcount() + 1).tolist()
    assert got.n[frame.id].tolist() == frame.groupby("g").id.transform("size").tolist()
    run = ranks.with_running(rows, [], [F.col("v").desc(), F.col("id").asc()], "upto", "v").toPandas().set_index("id")
    order = frame.sort_values(["v", "id"], ascending=[False, True])
    assert run.upto[order.id].tolist() == order.v.cumsum().tolist()
    assert ranks.with_rank(rows.limit(0), ["g"], [F.col("v")], "nth", "n").count() == 0


def test_parts_grow_with_the_rows(spark, rows, monkeypatch):
    order = [F.col("v").asc(), F.col("id").asc()]
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ranks.in_parts(rows, ["g"], order).agg(F.max(ranks.PART)).first()[0] < few
    by_id = lambda df: {r.id: (r.nth, r.n) for r in df.collect()}
    want = by_id(ranks.with_rank(rows, ["g"], order, "nth", "n"))
    middle = {r.g: r.quantiles for r in ranks.quantiles(rows, ["g"], "v", [0.5]).collect()}
    monkeypatch.setattr(ranks, "PART_ROWS", 20)
    sizes = [r["count"] for r in ranks.in_parts(rows, ["g"], order).groupBy(ranks.PART).count().collect()]
    assert sum(sizes) == 900 and few < len(sizes) <= 45 and max(sizes) < 100
    assert ranks.in_parts(rows, ["g"], order, part_rows=10_000).agg(F.max(ranks.PART)).first()[0] < few
    assert by_id(ranks.with_rank(rows, ["g"], order, "nth", "n")) == want
    assert {r.g: r.quantiles for r in ranks.quantiles(rows, ["g"], "v", [0.5]).collect()} == middle


def test_quantiles(spark, rows):
    frame = rows.toPandas().fillna({"g": "~"})
    got = {r.g or "~": r.quantiles for r in ranks.quantiles(rows, ["g"], "v", [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    assert {g: pytest.approx(np.quantile(v, [0.0, 0.25, 0.5, 0.99, 1.0])) for g, v in frame.groupby("g").v} == got
    assert ranks.quantiles(rows, [], "v", [0.1]).first().quantiles == pytest.approx([np.quantile(frame.v, 0.1)])
    assert ranks.quantiles(rows.limit(0), [], "v", [0.1]).first().quantiles == [None]


def test_overlap_islands_across_parts(spark):
    rng = np.random.default_rng(5)
    spans = [(i, f"k{0 if i % 3 else i % 4}", int(s), int(s + rng.integers(0, 60))) for i, s in enumerate(rng.integers(0, 8000, 700))]
    got = {r.id: (r.k, r.island) for r in leakage.overlap_islands(spark.createDataFrame(spans, "id long, k string, s long, e long"), "k", "s", "e", "id").collect()}
    want = {}
    for key in {s[1] for s in spans}:
        island, latest = 0, None
        for i, _, s, e in sorted((x for x in spans if x[1] == key), key=lambda x: (x[2], x[3], x[0])):
            island += latest is None or s > latest
            latest = e if latest is None else max(latest, e)
            want[i] = (key, island)
    assert got == want


def test_clusters_across_batches(spark):
    rng = np.random.default_rng(7)
    events = [(i, "hot" if i % 2 else f"k{i % 9}", int(t)) for i, t in enumerate(rng.integers(0, 100_000, 3000))]
    df = spark.createDataFrame(events, "alert_id long, k string, s long").withColumn("t", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {r.alert_id: r.anchor // 1_000_000 for r in correlate.anchored_clusters(df, ["k"], 300.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, anchor = {}, {}
    for i, k, s in sorted(events, key=lambda x: (x[1], x[2], x[0])):
        if k not in anchor or s - anchor[k] > 300:
            anchor[k] = s
        want[i] = anchor[k]
    assert got == want


def test_threshold_with_a_heavy_value(spark):
    df = spark.range(1_200_000).select(F.expr("if(id < 1199000, 0.0, cast(id as double))").alias("v"))
    assert scoring.upper_quantile(df, "v").first().threshold == 0.0
    assert scoring.upper_quantile(df, "v", q=0.9995, most=100).first().threshold == 1199400.0


def test_bootstrap_draws_every_row(spark):
    df = spark.range(4000).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 5 != 0).alias("hit"))
    got = {r.metric: (r.low, r.high) for r in scoring.bootstrap_intervals(df, "y", F.col("hit"), "id", replicates=120).collect()}
    for metric, p, rows in (("precision", 0.25, 3200), ("recall", 0.8, 1000)):
        half = 1.96 * (p * (1 - p) / rows) ** 0.5
        assert got[metric] == (pytest.approx(p - half, abs=half / 2), pytest.approx(p + half, abs=half / 2))


def test_bursts_and_latest_facts_across_parts(spark):
    rng = np.random.default_rng(11)
    events = [(i, None if i % 7 == 6 else "hot", int(s), int(h)) for i, (s, h) in enumerate(zip(rng.integers(0, 40_000, 1500), rng.choice([0, 1, 255], 1500)))]
    df = spark.createDataFrame(events, "alert_id long, k string, s long, simhash long").withColumn("t", F.timestamp_seconds("s"))
    got = {r.alert_id: (r.burst_no, r.burst_count, r.burst_total) for r in burst.bursts(df, ["k"], idle=60.0).collect()}
    runs: dict = {}
    for key in ("hot", None):
        last, no = None, 0
        for i, _, s, h in sorted((e for e in events if e[1] == key), key=lambda e: (e[2], e[0])):
            no += last is None or s - last[0] > 60 or bin(h ^ last[1]).count("1") > 3
            last = (s, h)
            runs.setdefault((key, no), []).append(i)
    assert got == {i: (no, n, len(ids)) for (_, no), ids in runs.items() for n, i in enumerate(ids, 1)}
    facts, rows = df.where("alert_id % 5 = 0").withColumn("v", F.col("alert_id").cast("string")), df.where("alert_id % 5 > 0")
    found = {r.alert_id: r.v for r in timeline.latest_before(rows, facts, ["k"], "s", "alert_id", "v").collect()}
    known = sorted((s, i, k) for i, k, s, _ in events if i % 5 == 0)
    want = {i: next((str(j) for at, j, key in reversed(known) if key == k and at <= s), None) for i, k, s, _ in events if i % 5}
    assert found == want


def test_hot_keys_are_walked_in_ranges(spark):
    """Chains that cross ranges: dense stretches (a range inside one window), gaps, equal times across a border, several hot keys."""
    rng = np.random.default_rng(11)
    times = {
        "even": np.arange(0, 400_000, 100), "dense": rng.integers(0, 900, 3000), "mixed": np.concatenate([rng.integers(0, 50_000, 1500), np.full(700, 60_000), rng.integers(60_000, 2_000_000, 1500)]),
        "cold": rng.integers(0, 5000, 40),
    }
    events = [(n * 10_000 + i, k, int(s)) for n, (k, v) in enumerate(times.items()) for i, s in enumerate(v)] + [(-1, None, 5)]
    df = spark.createDataFrame(events, "alert_id long, k string, s long").withColumns({"t": F.timestamp_seconds("s"), "_": F.lit(1)})
    for seconds, range_rows in ((300.0, 100), (30.0, 1000), (100_000.0, 77)):
        made = correlate.anchored_clusters(df, ["k"], seconds, range_rows=range_rows)
        assert made.columns == [*df.columns, "anchor"]
        got = {r.alert_id: r.anchor // 1_000_000 for r in made.collect()}
        want, anchor = {}, {}
        for i, k, s in sorted((e for e in events if e[1]), key=lambda x: (x[1], x[2], x[0])):
            if k not in anchor or s - anchor[k] > seconds:
                anchor[k] = s
            want[i] = anchor[k]
        assert got == want


def test_a_hot_key_uses_many_tasks(spark):
    rows = spark.range(200_000).select(F.col("id").alias("alert_id"), F.lit("one").alias("k"), F.timestamp_seconds(F.col("id") * 7).alias("t"))
    made = correlate.anchored_clusters(rows, ["k"], 30.0, range_rows=10_000)
    per = made.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(per) >= 8 and max(r.n for r in per) <= 60_000
    assert made.agg(F.count_distinct("anchor")).first()[0] == 40_000 and made.where("anchor % 35000000 <> 0").count() == 0


def test_runs_and_funnel_over_parts(spark):
    rng = np.random.default_rng(13)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", None if a == 3 else f"a{a}", None if i % 97 == 0 else int(s), float(s % 10) / 10, int(h)) for i, (a, s, h) in enumerate(zip(rng.integers(0, 4, 2000), rng.integers(0, 40_000, 2000), rng.integers(0, 50, 2000)))]
    df = spark.createDataFrame(rows, "alert_id long, k string, actor string, s long, score double, simhash long").withColumn("t", F.timestamp_seconds("s"))
    got = {r.alert_id: r.run for r in timeline.actor_runs(df, ["k"], ["t", "alert_id"], "actor").collect()}
    want, state = {}, {}
    order = sorted(rows, key=lambda r: (r[1], r[3] is not None, r[3] or 0, r[0]))
    for i, k, a, *_ in order:
        run, last = state.get(k, (0, "-"))
        state[k] = (run + (a != last), a)
        want[i] = state[k][0]
    assert got == want
    buckets, last = {}, {}
    for i, k, _, s, *_ in order:
        new = s is None or last.get(k) is None or s - last[k][0] > 60
        n = last[k][1] + 1 if k in last and last[k] and new else (0 if k not in last or last[k] is None else last[k][1])
        buckets.setdefault((k, i if s is None else ("b", n, s if new else last[k][2])), []).append(i)
        last[k] = (s, n, s if new else last[k][2]) if s is not None else None
    row = burst.fatigue_funnel(df, ["k"]).first()
    assert row.raw_weight == len(rows) and row.clusters == len({r[5] for r in rows})
    weighed = burst.fatigue_funnel(df.withColumn("w", F.lit(3)), ["k"], weight="w").first()
    assert weighed.raw_weight == sum(max(3, len(v)) for v in buckets.values())


def test_recent_counts_of_hot_keys(spark):
    rng = np.random.default_rng(17)
    rows = [(i, None if i % 50 == 0 else ("hot" if i % 3 else f"k{i % 4}"), None if i % 41 == 0 else int(s)) for i, s in enumerate(rng.integers(0, 3000, 1500))]
    df = spark.createDataFrame(rows, "id long, k string, s long").withColumn("t", F.timestamp_seconds("s"))
    for seconds, limit in ((60.0, 5), (1.0, 2), (5000.0, 10)):
        want = {tuple(r) for r in timeline.recent_counts(df, ["k"], "t", seconds, limit).select("id", "recent", "limited", "wait_seconds").collect()}
        got = timeline.recent_counts(df, ["k"], "t", seconds, limit, range_rows=100)
        assert got.columns == [*df.columns, "recent", "limited", "wait_seconds"]
        assert {tuple(r) for r in got.select("id", "recent", "limited", "wait_seconds").collect()} == want
        for i, k, s in rows[1::97]:
            if k and s is not None:
                assert next(r[1] for r in want if r[0] == i) == sum(1 for _, k2, s2 in rows if k2 == k and s2 is not None and s - seconds < s2 <= s)
