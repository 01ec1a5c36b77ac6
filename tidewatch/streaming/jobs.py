"""Structured Streaming forms of ingest, de-duplication, bursts, incidents, as-of look-ups and counts.

Each is a DataFrame -> DataFrame transformation of a stream with keyed state. Two kinds:
  settled   (`settled_bursts`, `settled_counts`, `settled_signatures`, `anchored_stream`): rows wait until the watermark
            has passed them and are then taken in order of time, so that a result equals the batch operator's whatever the
            order of arrival within the delay; what a key holds ends by event-time timers, and idle keys hold nothing
  at once   (`burst_stream`, `signature_stream`): a row is answered in the batch that brings it, in order of arrival; a key's
            one row of state stays, or ends where the caller names for how long an idle key is kept
Rows behind the watermark are dropped by Spark. `land_split` keeps them: it deals a stream out into rows on time and late
ones before any state is involved, and `reconciled` replaces what they touch by the batch operator's results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.digests import id_set_digest, simhash64
from tidewatch.sources.readers import route_sensor_lines, sensor_flow


def ingest_sensor_lines(lines: DataFrame, flows_path: str, dead_letters_path: str, checkpoint: str, most_dead_letters: int | None = None):
    """Start a query that appends good flows and dead letters to two Parquet folders, and their counts by batch to a third. All
    dead letters are stored, or at most `most_dead_letters` of a batch where that is asked for."""

    def land(batch: DataFrame, batch_id: int) -> None:
        routed = route_sensor_lines(batch).persist()
        sensor_flow(routed).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(flows_path)
        dead = routed.where("route = 'dead_letter'").select("code", "excerpt", F.lit(batch_id).alias("batch_id"))
        (dead if most_dead_letters is None else dead.limit(most_dead_letters)).write.mode("append").parquet(dead_letters_path)
        routed.groupBy("route", "code").agg(F.count(F.lit(1)).alias("n")).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{dead_letters_path}-counts")
        routed.unpersist()

    return lines.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(stream: DataFrame, event_id: str, t: str, delay: str = "10 minutes") -> DataFrame:
    """The first row of every event id within the watermark."""
    return stream.withWatermark(t, delay).dropDuplicatesWithinWatermark([event_id])


def rolling_failures(stream: DataFrame, key: str, t: str, width: str = "60 seconds", slide: str = "5 seconds", limit: int = 5, delay: str = "1 minute") -> DataFrame:
    """(window, key, failures, limited): sliding counts, the approximate form of the exact rolling count."""
    counts = stream.withWatermark(t, delay).groupBy(F.window(t, width, slide), key).agg(F.count(F.lit(1)).alias("failures"))
    return counts.withColumn("limited", F.col("failures") >= limit)


def running_funnel(stream: DataFrame, decision: str, score: str, sure: float = 0.9) -> DataFrame:
    """Stage counts over all rows so far (complete or update mode)."""
    attack = F.col(decision) == "Attack"
    return stream.agg(F.count(F.lit(1)).alias("flows"), F.count_if(attack).alias("attacks"), F.count_if(attack & (F.col(score) >= sure)).alias("sure"))


BURST_OUT = "key string, alert_id long, us long, burst_no long, burst_count long"


class BurstProcessor(StatefulProcessor):
    """A key's burst: last time, last SimHash, number and count. The number goes on as long as this row is kept."""

    def __init__(self, idle_us: int, distance: int, keep_ms: int | None = None):
        self.idle_us, self.distance, self.keep_ms = idle_us, distance, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("burst", "us long, simhash long, burst_no long, n long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["us", "alert_id"], kind="stable")
        held = self.state.get() if self.state.exists() else None
        us, sim, no, n = held if held else (None, 0, 0, 0)
        out = []
        for row in frame.itertuples():
            apart = bin((int(row.simhash) ^ int(sim)) & (2**64 - 1)).count("1")
            if us is None or row.us - us > self.idle_us or apart > self.distance:
                no, n = no + 1, 0
            us, sim, n = int(row.us), int(row.simhash), n + 1
            out.append((key[0], int(row.alert_id), us, no, n))
        self.state.update((us, sim, no, n))
        yield pd.DataFrame(out, columns=["key", "alert_id", "us", "burst_no", "burst_count"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter([])

    def close(self) -> None:
        pass


def kept_for(keep: float | None) -> tuple[int | None, str]:
    """(milliseconds, time mode) of state that ends `keep` seconds of the cluster's clock after its last update; without `keep` it stays.

    Spark runs batches without rows to let such state end, so a query with the trigger availableNow does not finish unless
    spark.sql.streaming.noDataMicroBatches.enabled is false; state then ends with the next batch that has rows."""
    if keep is None:
        return None, "none"
    if keep <= 0:
        raise ValueError("state must be kept for more than 0 seconds")
    return max(1, round(keep * 1000)), "processingTime"


def burst_stream(stream: DataFrame, idle: float = 60.0, distance: int = 3, keep: float | None = None) -> DataFrame:
    """Burst numbers and counts of (key, alert_id, us, simhash) rows, at once. Rows of one batch are taken in order of
    time; a row that is late for its key counts as arriving now.

    With `keep`, a key that brings no row for so many seconds of the cluster's clock is forgotten, and its numbers start at 1 again
    when it comes back; so it should be longer than `idle`, and than the stream may lag. `settled_bursts` goes by event time."""
    keep_ms, mode = kept_for(keep)
    return stream.groupBy("key").transformWithStateInPandas(BurstProcessor(int(idle * 1_000_000), distance, keep_ms), outputStructType=BURST_OUT, outputMode="append", timeMode=mode)


CLUSTER_OUT = "key string, anchor_us long, size long, alert_ids string"


class AnchorProcessor(StatefulProcessor):
    """Open rows of a key; a cluster is closed once the watermark has passed its anchor by the window."""

    def __init__(self, span_us: int):
        self.span_us = span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", "us array<long>, alert_ids array<long>")

    def _closed(self, key, watermark_ms: int, rows: list[tuple[int, int]]) -> tuple[list[Row], list[tuple[int, int]]]:
        rows = sorted(rows)
        out, at = [], 0
        while at < len(rows):
            anchor, end = rows[at][0], at
            while end < len(rows) and rows[end][0] - anchor <= self.span_us:
                end += 1
            if anchor + self.span_us >= watermark_ms * 1000:
                break
            out.append(Row(key=key[0], anchor_us=anchor, size=end - at, alert_ids=",".join(str(i) for _, i in rows[at:end])))
            at = end
        return out, rows[at:]

    def _wakes(self, rows: list[tuple[int, int]]) -> int:
        """The one timer of a key whose open rows, in order, are these."""
        return (rows[0][0] + self.span_us) // 1000 + 1

    def _settle(self, key, timers, new: list[tuple[int, int]], woken: bool) -> Iterator[Row]:
        """A key's calls of the state are most of a batch's time: its rows are one value, and its timer follows from them and is not
        asked for; one that has woken the key is over."""
        state = self.rows.get()
        held = list(zip(*state, strict=True)) if state else []
        done, left = self._closed(key, timers.getCurrentWatermarkInMs(), held + new)
        if left != held:
            if left:
                self.rows.update(tuple(map(list, zip(*left, strict=True))))
            else:
                self.rows.clear()
        was = self._wakes(held) if held and not woken else None
        wakes = self._wakes(left) if left else None
        if was != wakes:
            if was is not None:
                self.handle.deleteTimer(was)
            if wakes is not None:
                self.handle.registerTimer(wakes)
        yield from done

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._settle(key, timerValues, [(row.us, row.alert_id) for row in rows], woken=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(key, timerValues, [], woken=True)

    def close(self) -> None:
        pass


def anchored_stream(stream: DataFrame, seconds: float, t: str = "t", delay: str = "10 minutes") -> DataFrame:
    """Closed anchored clusters of (key, alert_id, us) rows with an event-time column. A cluster is closed, and its state ends,
    once the watermark has passed its anchor by the window. Rows behind the watermark are dropped here (see `land_split`)."""
    marked = stream.withWatermark(t, delay)
    return marked.groupBy("key").transformWithState(AnchorProcessor(int(seconds * 1_000_000)), outputStructType=CLUSTER_OUT, outputMode="append", timeMode="eventtime")


SIGNATURE_OUT = "key string, alert_id long, signature string"


class SignatureProcessor(StatefulProcessor):
    """A key's latest signature, for the flows that follow it; only a sign renews it."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "us long, signature string", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        frame["late"] = frame.signature.isna().astype(int)
        frame = frame.sort_values(["us", "late", "alert_id"], kind="stable")
        held, signed = self.state.get() if self.state.exists() else None, False
        out = []
        for row in frame.itertuples():
            if row.late:
                out.append((key[0], int(row.alert_id), held[1] if held and held[0] <= row.us else None))
            elif held is None or row.us >= held[0]:
                held, signed = (int(row.us), row.signature), True
        if signed:
            self.state.update(held)
        yield pd.DataFrame(out, columns=["key", "alert_id", "signature"])

    def close(self) -> None:
        pass


def signature_stream(stream: DataFrame, keep: float | None = None) -> DataFrame:
    """As-of signatures over a union of sign rows (with a signature) and flow rows (a null one) keyed by `key`, at once: a
    sign that arrives after its flow comes too late for it. With `keep`, a sign is forgotten so many seconds of the cluster's
    clock after it was taken, and later flows get null. `settled_signatures` waits, and forgets by event time."""
    keep_ms, mode = kept_for(keep)
    return stream.groupBy("key").transformWithStateInPandas(SignatureProcessor(keep_ms), outputStructType=SIGNATURE_OUT, outputMode="append", timeMode=mode)


# ---- settled forms: in order of time, once the watermark has passed


class SettledProcessor(StatefulProcessor):
    """Rows of a key that the watermark has not passed wait; those it has passed are taken in order. What the key holds is
    dropped when it can matter no more. One timer a key: the next waiting row, or the end of what is held."""

    WAITING = HELD = ""
    COLUMNS: tuple[str, ...] = ()
    #: So many leading fields of a waiting row give its order; the first is its time in microseconds.
    ORDER = 2

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.held = handle.getListState("waiting", self.WAITING), handle.getListState("held", self.HELD)

    def take(self, key: str, held: list[tuple], rows: list[tuple], mark: int) -> tuple[list[tuple], list[tuple]]:
        """(what is held now, output) after rows in order; no later row comes at or before `mark`."""
        raise NotImplementedError

    def ends(self, held: list[tuple]) -> int:
        """The time at which what is held matters no more."""
        raise NotImplementedError

    def _settle(self, key, timers, new: list[tuple]) -> Iterator[pd.DataFrame]:
        mark = timers.getCurrentWatermarkInMs() * 1000
        rows = sorted([*map(tuple, self.waiting.get() if self.waiting.exists() else ()), *new], key=lambda r: r[: self.ORDER])
        ready, later = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        held = list(map(tuple, self.held.get())) if self.held.exists() else []
        held, out = self.take(key[0], held, ready, mark) if ready or held else (held, [])
        if held and self.ends(held) <= mark:
            held = []
        for state, left in ((self.waiting, later), (self.held, held)):
            if left:
                state.put(left)
            elif state.exists():
                state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wake = [r[0] for r in later[:1]] + ([self.ends(held)] if held else [])
        if wake:
            self.handle.registerTimer(-(-min(wake) // 1000))
        yield pd.DataFrame(out, columns=list(self.COLUMNS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        yield from self._settle(key, timerValues, self.read(frame))

    def read(self, frame: pd.DataFrame) -> list[tuple]:
        """Waiting rows from input rows."""
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues, [])

    def close(self) -> None:
        pass


def _settled(stream: DataFrame, processor: SettledProcessor, out: str, t: str, delay: str) -> DataFrame:
    return stream.withWatermark(t, delay).groupBy("key").transformWithStateInPandas(processor, outputStructType=out, outputMode="append", timeMode="eventtime")


class SettledBursts(SettledProcessor):
    """Held: the last row's time and SimHash, the burst's first time and its rows so far."""

    WAITING, HELD = "us long, alert_id long, simhash long", "us long, simhash long, burst_us long, n long"
    COLUMNS = ("key", "alert_id", "us", "burst_us", "burst_count")

    def __init__(self, idle_us: int, distance: int):
        self.idle_us, self.distance = idle_us, distance

    def read(self, frame):
        return list(zip(frame.us.tolist(), frame.alert_id.tolist(), frame.simhash.tolist(), strict=True))

    def take(self, key, held, rows, mark):
        last, out = held[0] if held else None, []
        for us, alert_id, simhash in rows:
            near = last is not None and us - last[0] <= self.idle_us and ((simhash ^ last[1]) & (2**64 - 1)).bit_count() <= self.distance
            last = (us, simhash, last[2] if near else us, last[3] + 1 if near else 1)
            out.append((key, alert_id, us, last[2], last[3]))
        return [last] if last else [], out

    def ends(self, held):
        return held[0][0] + self.idle_us


def settled_bursts(stream: DataFrame, idle: float = 60.0, distance: int = 3, t: str = "t", delay: str = "10 minutes") -> DataFrame:
    """(key, alert_id, us, burst_us, burst_count) of (key, alert_id, us, simhash, t) rows: the burst's first time names it. A key
    holds one row, until it has been idle for `idle` seconds."""
    return _settled(stream, SettledBursts(int(idle * 1_000_000), distance), "key string, alert_id long, us long, burst_us long, burst_count long", t, delay)


class SettledCounts(SettledProcessor):
    """Held: the times of the last `span` before the watermark, with their rows."""

    WAITING, HELD = "us long, alert_id long", "us long, n long"
    COLUMNS = ("key", "alert_id", "us", "recent", "limited", "wait_seconds")

    def __init__(self, span_us: int, limit: int):
        self.span_us, self.limit = span_us, limit

    def read(self, frame):
        return list(zip(frame.us.tolist(), frame.alert_id.tolist(), strict=True))

    def take(self, key, held, rows, mark):
        new, n = np.unique(np.array([r[0] for r in rows], np.int64), return_counts=True)  # later than what is held
        times = np.concatenate([np.array([h[0] for h in held], np.int64), new])
        upto = np.concatenate([[0], np.cumsum([*(h[1] for h in held), *n])]).astype(np.int64)
        us = np.array([r[0] for r in rows], np.int64)
        first, end = np.searchsorted(times, us - self.span_us, "right"), np.searchsorted(times, us, "right")
        recent = upto[end] - upto[first]
        out = [
            (key, r[1], r[0], c, c >= self.limit, (f + self.span_us - r[0]) / 1e6 if c >= self.limit else 0.0)
            for r, c, f in zip(rows, recent.tolist(), times[first].tolist() if len(rows) else [], strict=True)
        ]
        left = times > mark - self.span_us
        return list(zip(times[left].tolist(), np.diff(upto)[left].tolist(), strict=True)), out

    def ends(self, held):
        return held[-1][0] + self.span_us


def settled_counts(stream: DataFrame, seconds: float = 60.0, limit: int = 5, t: str = "t", delay: str = "1 minute") -> DataFrame:
    """(key, alert_id, us, recent, limited, wait_seconds) of (key, alert_id, us, t) rows: the exact rolling count of
    `timeline.recent_counts`, row for row. A key holds the distinct times of its last `seconds`."""
    return _settled(stream, SettledCounts(int(seconds * 1_000_000), limit), "key string, alert_id long, us long, recent long, limited boolean, wait_seconds double", t, delay)


class SettledSignatures(SettledProcessor):
    """Held: the latest signature and its time."""

    WAITING, HELD, ORDER = "us long, flow int, alert_id long, signature string", "us long, signature string", 3
    COLUMNS = ("key", "alert_id", "signature")

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def read(self, frame):
        signs = [None if pd.isna(s) else s for s in frame.signature]
        return [(us, int(sign is None), i, sign) for us, i, sign in zip(frame.us.tolist(), frame.alert_id.tolist(), signs, strict=True)]

    def take(self, key, held, rows, mark):
        last, out = held[0] if held else None, []
        for us, flow, alert_id, sign in rows:
            if not flow:
                last = (us, sign)
            else:
                out.append((key, alert_id, last[1] if last and us - last[0] <= self.keep_us else None))
        return [last] if last else [], out

    def ends(self, held):
        return held[0][0] + self.keep_us


def settled_signatures(stream: DataFrame, keep: float, t: str = "t", delay: str = "10 minutes") -> DataFrame:
    """(key, alert_id, signature) for the flow rows of a union of sign rows (with a signature) and flow rows (a null one): the
    latest sign at or before the flow, if it is at most `keep` seconds old; a sign counts wherever it arrives within the delay. One
    that comes later than that is late: it changes no flow that has been answered. A key holds one sign, for `keep` seconds."""
    return _settled(stream, SettledSignatures(int(keep * 1_000_000)), SIGNATURE_OUT, t, delay)


# ---- incidents: bursts, then campaigns of what they leave alone


def burst_pass(alerts: DataFrame, seconds: float, t: str = "t", delay: str = "10 minutes") -> DataFrame:
    """Closed bursts of (alert_id, t, ns, src, dst, proto, service) alerts within that key; the key is a JSON list. Rows that lack
    a part of it are unverified and left out."""
    parts = ["ns", "src", "dst"]
    keyed = alerts.where(" and ".join(f"{c} is not null" for c in [*parts, t])).withColumns({"key": F.to_json(F.array(*parts, F.coalesce("proto", F.lit("")), F.coalesce("service", F.lit("")))), "us": F.unix_micros(t)})
    return anchored_stream(keyed.select("key", "alert_id", "us", t), seconds, t, delay)


def campaign_pass(bursts: DataFrame, seconds: float, lag: str = "1 second") -> DataFrame:
    """Closed campaigns and singletons of the bursts of one row, within (ns, unordered src and dst). `bursts` is the stored output of
    `burst_pass`, read as a stream: a batch of that holds all closed clusters up to its watermark, so rows come in order of time
    from batch to batch, and `lag` covers what a batch boundary leaves. Its state ends like that of the first pass."""
    key = F.from_json("key", "array<string>")
    pair = F.array_sort(F.array(key[1], key[2]))
    alone = bursts.where("size = 1").select(F.to_json(F.array(key[0], pair[0], pair[1])).alias("key"), F.col("alert_ids").cast("long").alias("alert_id"), F.col("anchor_us").alias("us"), F.timestamp_micros("anchor_us").alias("t"))
    return anchored_stream(alone, seconds, "t", lag)


def closed_members(bursts: DataFrame, campaigns: DataFrame, domain: str = "tidewatch:incident") -> DataFrame:
    """(alert_id, incident_id, rule, anchor_us, size) of what both passes have closed so far, under the ids of the batch
    correlation. Alerts that wait in either pass are in none."""
    rule = F.when(F.col("size") > 1, "campaign").otherwise("singleton")
    found = bursts.where("size > 1").withColumn("rule", F.lit("burst")).unionByName(campaigns.withColumn("rule", rule))
    found = found.withColumn("ids", F.split("alert_ids", ","))
    named = found.withColumn("incident_id", id_set_digest(domain, [F.lit("incident_v1"), F.col("rule")], F.col("ids")))
    return named.select(F.explode(F.col("ids").cast("array<long>")).alias("alert_id"), "incident_id", "rule", "anchor_us", "size")


def start_incidents(alerts: DataFrame, folder: str, burst_seconds: float, campaign_seconds: float, t: str = "t", delay: str = "10 minutes", every: str | None = None):
    """Start both passes under `folder` (bursts, campaigns and their checkpoints): with `every` they run on, triggered so often; without,
    they read what is there, one after the other, and end."""
    spark = alerts.sparkSession

    def run(df: DataFrame, name: str):
        writer = df.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").outputMode("append")
        started = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
        if not every:
            started.awaitTermination()
        return started

    first = run(burst_pass(alerts, burst_seconds, t, delay), "bursts")
    closed = spark.readStream.schema(CLUSTER_OUT).parquet(f"{folder}/bursts")
    return first, run(campaign_pass(closed, campaign_seconds), "campaigns")


# ---- late rows


def split_late(batch: DataFrame, t: str, watermark_us: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a batch against a watermark; null times are late."""
    late = F.coalesce(F.unix_micros(t) < watermark_us, F.lit(True))
    return batch.where(~late), batch.where(late)


def land_split(stream: DataFrame, t: str, delay_seconds: float, folder: str, checkpoint: str):
    """Start a query that lands a stream's rows under `folder`: on_time and late, by batch, and a row a batch in marks.

    The rule is that of a watermark: a row is late if its time is at or before the newest time of all earlier batches less the
    delay, to the millisecond; so are null times. A stateful query over on_time with the same delay drops nothing. A
    batch that was landed is not landed again."""
    spark, delay_ms = stream.sparkSession, int(delay_seconds * 1000)
    spark.createDataFrame([(-1, None)], "batch_id long, newest_us long").write.mode("append").parquet(f"{folder}/marks")

    def land(batch: DataFrame, batch_id: int) -> None:
        marks = batch.sparkSession.read.schema("batch_id long, newest_us long").parquet(f"{folder}/marks")
        before = marks.agg(F.max(F.when(F.col("batch_id") < batch_id, F.col("newest_us"))).alias("newest"), F.max("batch_id").alias("last")).first()
        if before["last"] >= batch_id:
            return
        batch = batch.persist()
        mark = None if before["newest"] is None else (before["newest"] // 1000 - delay_ms) * 1000
        on_time, late = split_late(batch, t, -(2**62) if mark is None else mark + 1)
        on_time.write.mode("overwrite").parquet(f"{folder}/on_time/batch_id={batch_id}")
        late.write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")
        newest = batch.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.max(F.unix_micros(t)).alias("newest_us"))
        newest.write.mode("append").parquet(f"{folder}/marks")
        batch.unpersist()

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconciled(streamed: DataFrame, rows: DataFrame, late: DataFrame, keys: Sequence[str], batch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`streamed` with the results of every key that a late row touches replaced by `batch` over all the key's rows, late ones too.
    Keys are not null. Running it again over the outcome changes nothing."""
    touched = late.select(*keys).distinct()
    anew = batch(rows.unionByName(late).join(touched, list(keys), "left_semi"))
    return streamed.join(touched, list(keys), "left_anti").unionByName(anew.select(*streamed.columns))


def late_rows(stream: DataFrame, t: str, watermark_of: Callable[[], int], path: str, checkpoint: str):
    """Start a query that appends rows behind `watermark_of()` to a sink for the nightly batch."""

    def land(batch: DataFrame, batch_id: int) -> None:
        split_late(batch, t, watermark_of())[1].withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_stream_keys(stream: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """key, us and simhash columns that the stateful forms read."""
    tokens = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return stream.withColumns({"key": F.concat_ws("|", *tokens), "us": F.unix_micros(t), "simhash": simhash64(tokens)})
