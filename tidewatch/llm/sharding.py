"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded hash of the record.
Pass 2 shuffles each bucket in memory (Fisher-Yates, seeded by bucket) and numbers its records
from the bucket's start, so the buckets in order are one uniform permutation of the table.
Shards are equal slices of that permutation (law `rows`: counts at most one apart); a bucket
therefore writes into few files. Text is moved once.

A bucket is sized by its bytes; its number of records follows from them. A record is put in order
by its hash, its id and the hash of all its columns (but maps) before the draw, so reruns and retried tasks give the same
permutation whatever order records arrive in. Repeats of a record meet in one bucket up to `hot` of them; beyond, they are
numbered and dealt by number. Null texts count one byte.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import stored, with_offsets


def external_shuffle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 11, bucket_bytes: int = 8 << 20, hot: int = 10_000) -> DataFrame:
    """Every row of `df` as the struct `row`, with `bucket` and `position`, its place (0 .. rows-1) in a
    uniform permutation."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    hashed = [F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("key"), F.xxhash64(*hashed).alias("tie"), size.cast("long").alias("size"))
    rows, total = keyed.agg(F.count(F.lit(1)), F.sum("size")).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    keyed = _spread(keyed.drop("size"), seed, hot).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    starts = with_offsets(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")), "bucket", "rows", buckets)
    keyed = keyed.join(starts.select("bucket", F.col("offset").alias("start")), "bucket")
    schema = T.StructType([keyed.schema["row"], T.StructField("bucket", T.IntegerType()), T.StructField("position", T.LongType())])

    def shuffled(key: tuple, group: pa.Table) -> pa.Table:
        # Records of one key agree in id and text, but for a collision of the hash: ids tell those apart, and other columns the rest.
        order = np.lexsort((group.column("tie").to_numpy(), pc.rank(group.column("row").combine_chunks().field(doc_id), tiebreaker="dense").to_numpy(), group.column("key").to_numpy()))
        np.random.Generator(np.random.PCG64([seed, key[0].as_py()])).shuffle(order)  # Fisher-Yates
        start = group.column("start")[0].as_py()
        out = group.select(["row", "bucket"]).take(pa.array(order))
        return out.append_column("position", pa.array(np.arange(start, start + group.num_rows)))

    # A task takes some sixteen buckets, one after the other, whatever the session's number of partitions.
    parts = min(buckets, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(buckets / 16)))
    return keyed.repartition(parts, "bucket").groupBy("bucket").applyInArrow(shuffled, schema)


def _spread(keyed: DataFrame, seed: int, hot: int) -> DataFrame:
    """(row, key, tie), where records that are repeated more than `hot` times get keys of their own.

    They are written once, so that a record's number, from 1 in its key, stays when a task runs again;
    which repeat has which number does not matter, since they are equal."""
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key")
    often = stored(often, "shuffle-often")
    if not often.limit(1).count():
        return keyed
    same = stored(keyed.join(often, "key", "left_semi").withColumn("nth", F.monotonically_increasing_id()), "shuffle-repeats")
    same = same.withColumn("part", F.shiftright("nth", 33))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = same.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("key", "part").orderBy("nth"))
    numbered = same.join(counts, ["key", "part"]).select("row", F.xxhash64(F.lit(seed), "key", number).alias("key"), "tie")
    return keyed.join(often, "key", "left_anti").unionByName(numbered)


def shard_rows(df: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", seed: int = 11, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Every row of `df` with `shard` (0 .. shards-1) and `slot` (gapless from 0 in its shard), law `rows`.

    Any other column may have any name; a `shard` or `slot` of its own is an error."""
    if {"shard", "slot"} & set(df.columns):
        raise ValueError("shard and slot are the columns that are added")
    rows = df.count()
    mixed = external_shuffle(df, doc_id, text, seed, bucket_bytes)
    shard = F.expr(f"cast((position * {shards}L) div {max(1, rows)}L as int)")
    start = F.expr(f"(shard * {max(1, rows)}L + {shards - 1}L) div {shards}L")
    placed = mixed.withColumn("shard", shard).withColumn("slot", F.col("position") - start)
    return placed.select(*[F.col("row")[c].alias(c) for c in df.columns], "shard", "slot")


def write_shards(df: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Write the shuffled records as Parquet, one folder a shard; each bucket writes its own files."""
    shard_rows(df, shards, **options).write.partitionBy("shard").parquet(path)
