"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes of its word shingles. Two
fingerprints link if at most RADIUS = 3 bits differ. Equal fingerprints are one from here on, however many documents have it.

1. Balls without a block. Of three differing bits at least one lies in one of four blocks of 16 bits; with that block deleted, two
   are left. So every fingerprint emits, for each block that is deleted, all 49 variants within half of that, one bit. Fingerprints
   that share a variant with another one are suspects; the others link with nothing. No pair is formed.
2. Whole balls of the suspects. Half the radius is one bit on one side and two on the other: three differing bits change the
   parity, so fingerprints of an even number of ones emit all variants within two bits, those of an odd number the variants at one.
   Whoever is within one bit of a shared variant is within three bits of all others there, so each variant's
   smallest such fingerprint is linked with the rest: as many links as members, and no linked pair escapes. Links are
   deduplicated and verified. Without step 1 the balls would hold 1,073 variants a fingerprint in the mean.

A variant is shared by at most 49 * 2**16 fingerprints in step 1 and 2,081 in step 2, whatever the size of the table, so no
group grows with the data. Components of links come from the library's star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import small_batches, stored
from tidewatch.operators.components import connected_components

RADIUS, SEED, BLOCKS = 3, 42, 4
#: Shingles whose bits are counted at a time.
CHUNK = 8192

_ONE = "transform(sequence(0, 63), i -> shiftleft(1L, i))"
_TWO = "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
#: The variants of `fp` within one bit, each block deleted in turn; the deleted block holds its number.
_DELETED = f"""flatten(transform(sequence(0, {BLOCKS - 1}), b -> transform(filter(sequence(-1, 63), i -> i < 0 or i div 16 <> b),
 i -> ((fp & ~shiftleft(65535L, 16 * b)) | shiftleft(cast(b + 1 as bigint), 16 * b)) ^ if(i < 0, 0L, shiftleft(1L, i)))))"""
_BALL = f"if(bit_count(fp) % 2 = 0, concat(array(0L), {_ONE}, {_TWO}), {_ONE})"


def fingerprint(raw: bytes, words: int = 3) -> int:
    """The SimHash of a text in UTF-8, unsigned: A-Z lower-cased, words between ASCII white space, shingles with repeats."""
    tokens = raw.lower().split()  # bytes: A-Z and the six white-space characters only
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        end = min(n, at + CHUNK)
        shingles = [b" ".join(s) for s in zip(*(tokens[at + j : end + j] for j in range(min(words, len(tokens)))), strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, end - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, words: int = 3) -> DataFrame:
    """(id, fp) for rows of (id, text); null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"", words) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, fp long")


def ball_links(found: DataFrame) -> DataFrame:
    """(fp, centre): links among the distinct fingerprints `fp` that connect every two of at most RADIUS differing bits."""
    shared = Window.partitionBy("variant")
    emitted = found.select("fp", F.explode(F.expr(_DELETED)).alias("variant"))
    met = emitted.withColumns({"low": F.min("fp").over(shared), "high": F.max("fp").over(shared)})
    suspects = stored(met.where("low < high").select("fp").distinct(), "simhash-suspects")
    balls = suspects.select("fp", F.explode(F.expr(_BALL)).alias("flip")).select("fp", F.col("flip").bitwiseXOR(F.col("fp")).alias("variant"), (F.bit_count("flip") < 2).alias("near"))
    centred = balls.withColumn("centre", F.min(F.when(F.col("near"), F.col("fp"))).over(shared))
    links = centred.where("fp <> centre").select("fp", "centre").distinct()
    return links.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= RADIUS)


def near_simhashes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: the fingerprint as 16 hex digits, and the smallest id that links
    of at most three differing bits reach, its own included.

    Null and empty texts have fingerprint 0, which is linked like any other. Rows without an id have a fingerprint, reach
    nothing and are reached by nothing: their component is null. Rows that share an id are one document with several fingerprints. Ids
    may be of any type with an order.
    """
    small_batches(df.sparkSession)
    docs = stored(fingerprints(df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), words), "simhash-docs")
    named = docs.where("id is not null")
    classes = stored(named.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    several = named.groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("id", "low")
    several = named.join(several, "id").where("fp <> low").select("fp", F.col("low").alias("centre")).distinct()
    links = ball_links(classes.select("fp")).union(several)
    parts = stored(connected_components(links, "fp", "centre"), "simhash-parts")
    reach = parts.join(classes, parts["node"] == classes["fp"]).groupBy("component").agg(F.min("rep").alias("smallest"))
    linked = parts.join(reach, "component").select(F.col("node").alias("fp"), "smallest")
    named_by = classes.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "rep").alias("smallest"))
    out = docs.join(named_by, "fp", "left")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("smallest")).alias("component_id"))
