"""Queries against their SQL twins on tables that the small scale factors don't have."""

import datetime as dt
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__
from tidewatch.operators import leakage, nearest, scoring
from tidewatch.sources import readers
from tidewatch.streaming import jobs

LARGE = "/root/testdata/sf0.1"


def both(spark, folder, name):
    """The rows of a query and of its SQL twin over the tables of a folder."""
    sql = duckdb.connect()
    sql.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(folder):
        sql.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    found = __spark_entry__.queries()[name](spark, str(folder))
    twin = sql.execute(__spark_entry__.oracle_sql()[name])
    assert found.columns == [c[0] for c in twin.description]
    return sorted(map(repr, map(tuple, found.collect()))), sorted(map(repr, twin.fetchall()))


@pytest.fixture
def many_users(tmp_path):
    """Events of users up to 540,000, as at 6 GB."""
    users = [u + step for u in (0, 3, 250, 1020, 8990, 65530, 540_000) for step in range(24)]
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i) for i in range(len(users))]
    kinds = [("click", "view", "error")[i % 3] for i in range(len(users))]
    events = pa.table({"event_id": range(len(users)), "ts": pa.array(at, pa.timestamp("us")), "user_id": users, "event_type": kinds, "value": [1.0] * len(users)})
    pq.write_table(events, tmp_path / "events.parquet")
    return tmp_path


def test_reports_of_many_rows(spark):
    """14,950 times the rows is no int."""
    found, twin = both(spark, LARGE, "m18_holdout_report")
    assert found == twin and len(found) == 4


def test_intel_of_many_users(spark, many_users):
    """F8: end points of users above 255."""
    found, twin = both(spark, many_users, "j5_threat_intel")
    assert found == twin and "8.8.3.540019" in str(found)


def test_techniques_of_many_users(spark, many_users):
    """ids of more than four digits."""
    found, twin = both(spark, many_users, "p25_techniques")
    assert found == twin and "T541004" in str(found)


@pytest.mark.parametrize("floor", [0.05, 0.9])
def test_all_pairs_equal_brute_force(spark, monkeypatch, floor):
    """below the size where bands pay, all pairs are formed a block of queries at a time; bands find the same above a high floor."""
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 60 * 8 * 8)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 8))
    x[100:200] = 1.5 * x[:100] + 0.2 * x[200:300]  # neighbours
    x[300:330], x[330:360] = x[7], 3 * x[7]  # copies, and others of the same direction
    corpus = spark.createDataFrame([(1000 - i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>").repartition(3)
    queries = corpus.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    like = np.round(unit @ unit.T, 9)
    want = set()
    for i in range(500):
        if (1000 - i) % 3 == 0:
            best = sorted((-like[i, j], 1000 - j) for j in range(500) if like[i, j] >= floor)[:4]
            want |= {(1000 - i, n + 1, doc) for n, (_, doc) in enumerate(best)}
    shuffled = []
    monkeypatch.setattr(nearest, "_banded", lambda *args, real=nearest._banded: shuffled.append(1) or real(*args))
    found = lambda **more: {(r.query_id, r.rank, r.doc_id) for r in nearest.banded_cosine(queries, corpus, 4, floor, **more).collect()}
    assert found() == want and not shuffled
    if floor > 0.5:
        assert found(grid_pairs=0) == want and shuffled


def flows_of(spark, rng, n, hot):
    """(rows, their roots by search): fingerprints, keys and intervals that tie rows in chains, `hot` rows of one fingerprint, rows without either."""
    rows = [(f"r{i:03}", f"p{rng.integers(n // 2)}" if i % 9 else None, int(rng.integers(12)) if i % 3 else None, int(s := rng.integers(400)), int(s + rng.integers(6))) for i in range(n)]
    rows += [(f"s{i:03}", "hot", 20 if i % 5 == 0 else None, 10 * i, 10 * i + 3) for i in range(hot)]
    root = {r[0]: r[0] for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if (a[1] is not None and a[1] == b[1]) or (a[2] is not None and a[2] == b[2] and a[3] <= b[4] and b[3] <= a[4]):
                x, y = sorted((top(a[0]), top(b[0])))
                root[y] = x
    more = [(*r, int(rng.integers(50) == 0), int(rng.integers(30) == 0), bool(rng.integers(40)), dt.datetime(1996 + int(rng.integers(40) == 0), 6, 1)) for r in rows]
    return spark.createDataFrame(more, "id string, fp string, k int, s long, e long, file int, label int, usable boolean, start timestamp").repartition(4), {x: top(x) for x in root}


def test_groups_by_fingerprint(spark, monkeypatch):
    """nodes are fingerprints, decisions come from sums by fingerprint; rows are not joined with their roots."""
    df, root = flows_of(spark, np.random.default_rng(1), 240, 40)
    links = ("id", "fp", "k", "s", "e")
    linked = []
    monkeypatch.setattr(leakage, "connected_components", lambda edges, real=leakage.connected_components: linked.append(edges.count()) or real(edges))
    found = leakage.leakage_groups(df, *links)
    got = {r.id: r.root for r in found.collect()}
    assert got == root and 1 < len(set(root.values())) < 230
    assert linked[0] < 160  # islands of several fingerprints only
    boundary = F.lit("1997-01-01").cast("timestamp")
    rows = df.join(found, "id")
    decisions = leakage.leakage_decisions(df, *links, boundary, oversized=4)
    want = leakage.group_decisions(rows, boundary, oversized=4)
    assert sorted(map(str, decisions.select(want.columns).collect())) == sorted(map(str, want.collect()))
    split = rows.join(want.select("root", "disposition"), "root")
    assert sorted(leakage.decision_counts(decisions).collect()) == sorted(leakage.split_counts(split).collect())
    assert leakage.decision_violations(decisions).collect() == leakage.split_violations(split).collect()
    broken = decisions.unionByName(decisions.where("disposition <> 'quarantine'").limit(1).withColumn("disposition", F.lit("other")))
    assert leakage.decision_violations(broken).first().crossing_groups == 1


def test_manifest_reads_no_large_file_whole(spark, monkeypatch):
    """the files that are too large are little larger than the others, and only streamed."""
    roots, streamed = [], []
    monkeypatch.setattr(readers, "verify_manifest", lambda spark, root, *args, real=readers.verify_manifest, **more: roots.append(root) or real(spark, root, *args, **more))
    monkeypatch.setattr(readers, "streamed_digests", lambda files, real=readers.streamed_digests: streamed.append(files.count()) or real(files))
    found, twin = both(spark, "/root/testdata/sf0.01", "s13_manifest")
    assert found == twin and streamed == [6]
    sizes = {r.large: r.bytes for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots[0]).selectExpr("int(regexp_extract(path, 'nation=([0-9]+)', 1)) % 4 = 3 as large", "length").groupBy("large").agg(F.max("length").alias("bytes")).collect()}
    assert sizes[False] < sizes[True] < 2 * sizes[False]


def test_a_key_asks_little_of_its_state():
    """a key's batch reads its state once, and neither lists its timers nor writes what has not changed."""
    calls, held, timers = [], [], set()

    class Value:
        get = lambda self: calls.append("get") or (held[-1] if held else None)
        update = lambda self, value: calls.append("update") or held.append(value)
        clear = lambda self: calls.append("clear") or held.clear()

    class Handle:
        getValueState = lambda self, *args: Value()
        registerTimer = lambda self, at: calls.append("register") or timers.add(at)
        deleteTimer = lambda self, at: calls.append("delete") or timers.remove(at)

    class Timers:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    anchored = jobs.AnchorProcessor(10_000_000)
    anchored.init(Handle())

    def batch(ms, *rows):
        calls.clear()
        if rows:
            out = anchored.handleInputRows(("k",), iter([Row(us=us, alert_id=i) for us, i in rows]), Timers(ms))
        else:
            out = anchored.handleExpiredTimer(("k",), Timers(ms), None)
            timers.clear()  # the one that has woken the key
        return [(r.anchor_us, r.size, r.alert_ids) for r in out], list(calls)

    assert batch(0, (5_000_000, 1), (12_000_000, 2), (40_000_000, 4)) == ([], ["get", "update", "register"]) and timers == {15_001}
    assert batch(1_000, (14_000_000, 3)) == ([], ["get", "update"])  # the anchor stays, and so its timer
    assert batch(2_000, (3_000_000, 0)) == ([], ["get", "update", "delete", "register"]) and timers == {13_001}
    assert batch(20_000)[0] == [(3_000_000, 3, "0,1,2")] and calls == ["get", "update", "register"]
    timers.clear()
    assert batch(60_000)[0] == [(14_000_000, 1, "3"), (40_000_000, 1, "4")] and calls == ["get", "clear"] and not held


def test_forest_in_parts(spark, monkeypatch):
    """what a fit holds is bounded whatever the number of trees; the probability is the mean over all of them."""
    monkeypatch.setattr(scoring, "TREES_AT_ONCE", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a + 0.3 * b > 0)) for a, b in x], "a double, b double, label int").repartition(2)
    model = scoring.fit_forest(df, ["a", "b"], trees=7, depth=4)
    forests = [part.stages[1] for part in model.parts]
    assert [f.getNumTrees for f in forests] == [3, 3, 1] and forests[0].toDebugString != forests[1].toDebugString
    assert {f.getOrDefault("maxMemoryInMB") for f in forests} == {scoring.HISTOGRAM_MB} and scoring.HISTOGRAM_MB <= 256
    scored = scoring.score_and_decide(df, model).collect()
    for r in scored[:40]:
        each = [t.predictProbability(Vectors.dense(r.a, r.b))[1] for f in forests for t in f.trees]
        assert abs(r.probability_attack - sum(each) / 7) < 1e-9
    assert sum((r.verdict == "Attack") == (r.label == 1) for r in scored) > 360
