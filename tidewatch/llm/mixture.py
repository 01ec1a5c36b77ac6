"""Mixing sources to target weights as a time-varying curriculum.

1. Targets. Every source has a weight; targets share the words of the whole table by weight, stop
   at `max_repeat` times the source's words, and the excess is shared again by weight. Sorting the
   sources by (limit / weight) solves that fill in one pass over one row per source.
2. Demand. A source's weight schedule over training time t in [0, 1] is piecewise linear; its
   integral, scaled to the source's target, is the cumulative demand for its words.
3. Positions. Documents of a source are ordered by a seeded hash; a document whose first word is
   the k-th the source delivers is due when the demand reaches k: the inverse of the integral, a
   closed-form square root per segment. Documents are then range-sorted by that position.

Running sums per source use about sqrt(rows) hash ranges, so a source that holds a third of all
rows is spread over as many tasks as it needs. Words are taken to the nearest word: whole passes
over the source, and a last partial pass that cuts at most one document per source.

Null texts have size 0; the null source is a source of its own, after all others; empty tables and
tables without any word have targets of 0. Repeated doc_ids are separate documents. Documents with a
null id are ordered by the hash of their text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, stored, word_count
from tidewatch.operators import ranks

#: By tier of weight: heavy sources lead, light ones follow. (time, relative weight) knots.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = 3, most: int = 100_000) -> DataFrame:
    """(source, source_size, tier, target) from (source, size): one row per source.

    The order of the sources and the fill are windows over all sources where these are at most `most`; more of them (say, one a
    domain) are ranked and summed in range partitions, with the same result."""
    per = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    by_name = [F.col("source").asc_nulls_last()]
    few = per.count() <= most
    ranked = per.withColumn("_rank", F.row_number().over(Window.orderBy(*by_name))) if few else ranks.with_rank(per, [], by_name, "_rank")
    per = ranked.withColumn("tier", ((F.col("_rank") - 1) % len(weights)).cast("int"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("tier") + 1).cast("long")).withColumn("_limit", F.col("source_size") * max_repeat)
    order = [(F.col("_limit") / F.col("weight")).asc(), *by_name]
    for name, value in (("_limits", "_limit"), ("_upto", "weight")):
        upto = F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        per = per.withColumn(name, upto) if few else ranks.with_running(per, [], order, name, value)
    per = stored(per, "mix-order")
    whole = per.agg(F.sum("source_size").alias("_size"), F.sum("weight").alias("_weight"))  # one row
    per = per.crossJoin(F.broadcast(whole))
    level = (F.col("_size") - (F.col("_limits") - F.col("_limit"))) / (F.col("_weight") - (F.col("_upto") - F.col("weight")))
    per = per.withColumn("_level", level)
    fits = F.col("_level") * F.col("weight") <= F.col("_limit")
    fill = per.agg(F.min(F.when(fits, F.struct((F.col("_limit") / F.col("weight")).alias("at"), F.col("_level").alias("level")))).getField("level").alias("_fill"))  # one row
    limit = F.col("_limit").cast("double")
    target = F.least(limit, F.coalesce(F.col("_fill") * F.col("weight"), limit))
    return per.crossJoin(F.broadcast(fill)).select("source", "source_size", "tier", target.alias("target"))


def due(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which `share` (0 .. 1) of a source's demand has passed: the inverse integral."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, done, found = sum(areas), 0.0, None
    pieces = []
    for (a, b), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        slope, rest = (b[1] - a[1]) / (b[0] - a[0]), share * F.lit(float(total)) - F.lit(done)
        if slope:
            step = (F.sqrt(F.lit(a[1] * a[1]) + F.lit(2 * slope) * rest) - F.lit(float(a[1]))) / F.lit(slope)
        else:
            step = rest / F.lit(float(a[1]))
        done += area
        pieces.append((done / total, F.lit(float(a[0])) + step))
    for end, piece in reversed(pieces):
        found = piece if found is None else F.when(share <= F.lit(end), piece).otherwise(found)
    return found


def mix_documents(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS,
    max_repeat: int = 3, schedules: Sequence = SCHEDULES, seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, tier, start (words its source
    delivers before it in one pass), passes (whole passes), part (words of the last, partial pass),
    taken and position (when it is first due; null if never)."""
    sizes = stored(
        df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null:"), F.md5(text))))).alias("key")),
        "mix-sizes",
    )
    rows = sizes.count()
    buckets = max(1, math.isqrt(rows))
    prefix = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    sizes = sizes.withColumn("bucket", F.shiftright(prefix * buckets, 32))
    targets = source_targets(sizes, weights, max_repeat)
    per_bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("source", "bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    starts = starts.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select(F.col("s.source").alias("_source"), F.col("bucket").alias("_bucket"), "_start", "source_size", "tier", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.expr("source <=> _source and bucket = _bucket")).withColumn("start", F.col("_start") + F.col("_inside"))
    due_words = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(due_words / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("passes", passes)
    left = due_words - F.col("passes") * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), left - F.col("start")))
    placed = placed.withColumn("part", part.cast("long")).withColumn("taken", (F.col("passes") * F.col("size") + F.col("part")).cast("long"))
    return placed.withColumn("position", F.when(F.col("taken") > 0, position_of(F.lit(0), schedules))).select(
        "doc_id", "size", "source", "source_size", "target", "tier", "key", "start", "passes", "part", "taken", "position"
    )


def position_of(turn: Column, schedules: Sequence = SCHEDULES) -> Column:
    """Training position in [0, 1] of a document's copy in pass `turn`, from start, source_size, target and tier."""
    share = F.least(F.lit(1.0), (turn * F.col("source_size") + F.col("start")) / F.col("target"))
    found = None
    for tier, knots in enumerate(schedules):
        at = due(share, knots)
        found = at if found is None else F.when(F.col("tier") == tier, at).otherwise(found)
    return found


def whole_passes(plan: DataFrame) -> DataFrame:
    """The plan of `mix_documents` with no document cut: what the last pass takes of its boundary document is filled with
    whole documents that it did not reach, the largest that fits first, or the boundary document is
    taken whole where that is nearer to the target.

    Only sizes matter to the fill: one document of each size, so its lists are as long as a text's words at most."""
    cut = plan.where("part > 0 and part < size").select(F.col("source").alias("_source"), F.col("start").alias("_cut"), F.col("size").alias("_cut_size"), F.col("part").alias("_room"))
    spare = plan.where("part = 0 and size > 0").join(cut, F.expr("source <=> _source and size <= _room")).groupBy("source", "size").agg(F.min("start").alias("start"))
    lists = spare.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "start")), asc=False).alias("_spare")).withColumnRenamed("source", "_of")
    none = F.array().cast("array<bigint>")

    def fill(acc: Column, x: Column) -> Column:
        took = F.struct((acc.room - x["size"]).alias("room"), F.concat(acc.starts, F.array(x["start"])).alias("starts"))
        return F.when(x["size"] <= acc.room, took).otherwise(acc)

    found = cut.join(lists, F.expr("_source <=> _of"), "left").withColumn("_fill", F.aggregate(F.coalesce("_spare", F.array().cast("array<struct<size:bigint,start:bigint>>")), F.struct(F.col("_room").alias("room"), none.alias("starts")), fill))
    nearer = F.col("_cut_size") - F.col("_room") < F.col("_fill.room")
    picked = found.select("_source", F.explode(F.when(nearer, F.array("_cut")).otherwise(F.col("_fill.starts"))).alias("_start"))
    # Documents with a word have a start of their own in their source.
    met = plan.join(picked, F.expr("size > 0 and source <=> _source and start = _start"), "left")
    part = F.when(F.col("_start").isNotNull(), F.col("size")).when(F.col("part") < F.col("size"), F.lit(0)).otherwise(F.col("part"))
    return met.withColumn("part", part.cast("long")).withColumn("taken", F.col("passes") * F.col("size") + F.col("part")).drop("_source", "_start")


def mixed_documents(
    df: DataFrame, max_repeat: int = 3, seed: int = 17, schedules: Sequence = SCHEDULES, words_per_partition: int = 1_000_000, whole: bool = False
) -> DataFrame:
    """The mix itself: rows of `df` with their columns, one per pass that takes them, in training order.

    With `whole` all texts are whole (see `whole_passes`); else the one document that a source's last pass cuts keeps
    its first words, joined by one space.
    Training time is cut into equal ranges, one partition each, sorted inside. `df` needs doc_id,
    text and source; exact repeats of a row each appear as often as the plan says.
    """
    plan = stored(mix_documents(df, max_repeat=max_repeat, seed=seed, schedules=schedules), "mix-plan")
    plan = (stored(whole_passes(plan), "mix-whole") if whole else plan).where("taken > 0")
    words = plan.agg(F.sum("taken")).first()[0] or 0
    parts = max(1, math.ceil(words / words_per_partition))
    # Rows that agree in doc_id, source and size are numbered, so that each meets its own plan row.
    same = Window.partitionBy("_id", "_source", "_size").orderBy("_key")
    plan = plan.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("start").alias("_key"),
        "start", "source_size", "target", "tier", "passes", "part",
    ).withColumn("_copy", F.row_number().over(same))
    kept = [F.col(c) for c in df.columns]
    docs = df.select(*kept, F.col("doc_id").alias("_id"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), F.xxhash64("text").alias("_key"))
    docs = docs.withColumn("_copy", F.row_number().over(same)).select(*[F.struct(*kept).alias("_row")], *[F.col(c).alias(f"_d{c}") for c in ("_id", "_source", "_size", "_copy")])
    met = docs.join(plan, F.expr("_d_id <=> _id and _d_source <=> _source and _d_size = _size and _d_copy = _copy"))
    turns = met.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") + (F.col("part") > 0).cast("long") - 1)))
    at = position_of(F.col("_turn"), schedules)
    placed = turns.withColumn("_position", at).withColumn("_words", F.when(F.col("_turn") < F.col("passes"), F.col("_size")).otherwise(F.col("part")))
    first = F.array_join(F.slice(F.split(F.ltrim(F.translate("_row.text", "\t\n\x0b\x0c\r", "     ")), " +"), F.lit(1), F.col("_words").cast("int")), " ")
    text = F.when(F.col("_words") < F.col("_size"), first).otherwise(F.col("_row.text"))
    placed = placed.repartitionById(parts, F.least(F.lit(parts - 1), F.floor(F.col("_position") * parts).cast("int"))).sortWithinPartitions("_position", "_id")
    return placed.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in df.columns])
