"""Token counts as delta-maintained rollups.

A rollup store is a folder in shared storage with four Parquet tables:
  ledger   one row per document and tokenizer version that a batch set or deleted (its new counts),
           in folders by batch and by bucket (a hash of the document id)
  bases    the live ledger up to a batch, by bucket: what compaction has merged so far
  deltas   the batch's signed change of every (source, lang, version): documents, tokens, chars
  commits  one row per committed batch, and one per written base, each written last
A batch holds upserts (inserted documents and revised counts) and deletes. It is turned into signed
deltas against the ledger of the batches before it: a revision subtracts the old counts and
adds the new ones, also where it moves a document to another source or language. Totals are the
sum of the committed batches' deltas.

A batch reads the latest base and the ledgers after it, `compact_every` batches at most, and of these
only the buckets that its documents fall into: a small batch costs little however large the store
is, and a store of many batches costs no more than one of few.

Committing is idempotent: a batch id that is committed changes nothing, and one that broke off
before its commit row is written over. Readers see committed batches only. The ledger lookup is a
join by document; a rollup row is pre-aggregated on the map side, so hot sources are cheap.

Deleting or revising an unknown document deletes nothing or inserts it. Null texts have no tokens.
Null sources and languages are groups of their own; rows with a null id are left out. Of several rows
of a batch for one document and version, a delete loses to an upsert, and the larger counts win. Batches
are applied one at a time, and count in the order of their ids.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import word_count

KEYS = ("source", "lang", "version")


def letters_and_marks(text: Column) -> Column:
    """Runs of letters and digits, and every other visible character by itself."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]")), F.lit(0)).cast("long")


#: Counters by tokenizer version.
VERSIONS: dict[str, Callable[[Column], Column]] = {"words-1": word_count, "marks-2": letters_and_marks}


def tokenizer_counter(path: str) -> Callable[[Column], Column]:
    """A counter that uses a tokenizer file of the `tokenizers` library (Arrow batches)."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        for batch in batches:
            yield pa.array([len(own.encode(t.as_py() or "", add_special_tokens=False).ids) for t in batch], pa.int64())

    return lambda text: count(text)


def counted(df: DataFrame, version: str, counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Upserts (doc_id, source, lang, version, tokens, chars) for documents under a tokenizer version."""
    tokens = (counter or VERSIONS[version])(F.col("text"))
    return df.select("doc_id", "source", "lang", F.lit(version).alias("version"), tokens.alias("tokens"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))


class Rollup:
    """A store under `path`; see the module. `id_type` is the SQL type of the document ids."""

    COUNTS = "version string, source string, lang string, tokens long, chars long, live boolean"
    DELTAS = "source string, lang string, version string, documents long, tokens long, chars long"

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", buckets: int = 64, compact_every: int = 16):
        self.spark, self.path, self.id_type, self.buckets, self.compact_every = spark, path.rstrip("/"), id_type, buckets, compact_every
        self.ledger = f"doc_id {id_type}, {self.COUNTS}"

    def _commits(self) -> tuple[list[int], tuple[int, str] | None]:
        """Committed batch ids in order, and the latest base (its last batch, its folder); one small row each."""
        try:
            rows = self.spark.read.schema("batch long, base string").parquet(f"{self.path}/commits").collect()
        except Exception as found:
            if "PATH_NOT_FOUND" in str(found):
                return [], None
            raise
        return sorted({r["batch"] for r in rows if r["base"] is None}), max(((r["batch"], r["base"]) for r in rows if r["base"] is not None), default=None)

    def committed(self) -> list[int]:
        """Batch ids with a commit row, in order."""
        return self._commits()[0]

    def _commit(self, batch: int, base: str | None = None) -> None:
        row = self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(base).cast("string").alias("base"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(self.buckets)).cast("int")

    def _by_batch(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        """The named table's rows of some batches, as one scan that reads their folders only."""
        if not batches:
            return self.spark.createDataFrame([], schema + ", batch long")
        found = self.spark.read.schema(schema + ", batch long").option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/batch={b}" for b in batches])
        return found

    def state(self, buckets: list[int] | None = None) -> DataFrame:
        """The live ledger: the latest committed row of every document and version (of some buckets)."""
        batches, base = self._commits()
        held = self._by_batch("ledger", self.ledger + ", bucket int", [b for b in batches if base is None or b > base[0]])
        if base is not None:
            merged = self.spark.read.schema(self.ledger + ", bucket int").parquet(f"{self.path}/bases/{base[1]}")
            held = held.unionByName(merged.withColumn("batch", F.lit(base[0]).cast("long")))
        if buckets is not None:
            held = held.where(F.col("bucket").isin(buckets))
        latest = held.groupBy("doc_id", "version").agg(F.max_by(F.struct("source", "lang", "tokens", "chars", "live"), "batch").alias("x"))
        return latest.where("x.live").select("doc_id", "version", "x.source", "x.lang", "x.tokens", "x.chars")

    def _touched(self, rows: DataFrame) -> list[int] | None:
        """The buckets of a batch's documents, at most `buckets`; null if these are all."""
        found = sorted(r[0] for r in rows.select(self._bucket().alias("bucket")).distinct().collect())
        return found if len(found) < self.buckets else None

    def apply(self, batch: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Commit a batch of upserts (see `counted`) and deletes (doc_id, version; a null version: all
        of the document's). False, and no change, if this batch id was committed before. Ids count upwards: a
        new one at or below a committed one is an error, since later batches have been counted without it."""
        done, base = self._commits()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]} was committed")
        new = []
        if upserts is not None:
            new.append(upserts.where("doc_id is not null").select(F.col("doc_id").cast(self.id_type).alias("doc_id"), "version", "source", "lang", "tokens", "chars", F.lit(True).alias("live")))
        if deletes is not None:
            gone = deletes.where("doc_id is not null").select(F.col("doc_id").cast(self.id_type).alias("doc_id"), "version").distinct()
            state, asked = self.state(self._touched(gone)), gone.select(F.col("doc_id").alias("d"), F.col("version").alias("v"))
            hit = state.join(asked, F.expr("doc_id = d and (v is null or version = v)"), "left_semi")
            new.append(hit.select("doc_id", "version", "source", "lang", "tokens", "chars", F.lit(False).alias("live")))
        if not new:
            raise ValueError("a batch needs upserts or deletes")
        rows = functools.reduce(DataFrame.unionByName, new)
        best = F.max(F.struct("live", "tokens", "chars", "source", "lang")).alias("x")
        rows = rows.groupBy("doc_id", "version").agg(best).select("doc_id", "version", "x.source", "x.lang", "x.tokens", "x.chars", "x.live")
        # Few files a bucket for a small batch; adaptive execution splits large buckets among tasks.
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ledger/batch={batch}")
        rows = self.spark.read.schema(self.ledger + ", bucket int").parquet(f"{self.path}/ledger/batch={batch}")
        old = self.state(self._touched(rows)).join(rows.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
        signed = rows.drop("bucket").where("live").withColumn("sign", F.lit(1)).drop("live").unionByName(old.withColumn("sign", F.lit(-1)))
        deltas = signed.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("documents"), *(F.sum(F.col(c) * F.col("sign")).cast("long").alias(c) for c in ("tokens", "chars")))
        deltas.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        self._commit(batch)
        if sum(b > base[0] if base else True for b in (*done, batch)) >= self.compact_every:
            self.compact()
        return True

    def compact(self) -> None:
        """Merge all committed ledgers into a new base. One that breaks off leaves the store as it was."""
        batches, _ = self._commits()
        if batches:
            name = f"upto={batches[-1]}-{uuid.uuid4().hex}"
            merged = self.state().withColumn("live", F.lit(True)).withColumn("bucket", self._bucket())
            merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/bases/{name}")
            self._commit(batches[-1], name)

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens, chars) over the committed batches; empty groups go."""
        held = self._by_batch("deltas", self.DELTAS, self.committed())
        return held.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in ("documents", "tokens", "chars"))).where("documents <> 0")
