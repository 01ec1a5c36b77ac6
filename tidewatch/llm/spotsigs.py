"""Document fingerprints by SpotSigs.

A spot signature is an anchor (a very common function word) and the chain of the CHAIN content words
that follow it, SPACING content words apart. A text's fingerprint is its set of signatures, as
sorted 32-bit hashes: enough to compare two fingerprints by Jaccard without their texts. The start
of a text counts as an anchor too, and chains are closed at its end, so every text with a word has
a signature. Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.

A stretch of more than SPARSE content words without an anchor (other languages, lists, menus) gets
anchors chosen by hash: the least hash of every REACH + 1 content words in a row, so that chains
leave no word of it out and a choice depends on the words next to it only. A text without any anchor
is such a stretch at any length; where under an eighth of the words is content, all count as content
and none as an anchor.

Fingerprints are partitioned by their number of signatures, in powers of 1 / similarity, and compared
by a pruned Jaccard: sets of partitions too far apart for the least likeness that counts are never
compared, and a comparison ends as soon as what is left cannot reach it. For `edited_fingerprints`
that least is FLOOR: a likeness below it is told as 0. Two texts without any word have equal, empty
fingerprints (likeness 1); an empty one is unlike any other (likeness 0). Null texts count as empty.

`spot_pairs` finds all pairs of at least a similarity without comparing all: only sets of the same or
of neighbouring partitions that share one of their rarest signatures meet; equal sets are one class.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import small_batches, stored

CHAIN, SPACING = 3, 1
#: Content words that a chain reaches over, and those between anchors of which a chain covers less than a third.
REACH = CHAIN * SPACING
SPARSE = 3 * REACH
#: Function words of four languages; the anchors are the most common of them.
ANCHORS = "the is of to der und die von le et la les el que los del"
FUNCTION_WORDS = (
    "a an and are as at be by for from in it of on or that the this to was were with is not have "
    "der die das den dem des und oder ein eine von zu mit ist nicht auf für sich im auch "
    "le la les un une de des du et en est que qui dans pour pas sur au ce il "
    "el la los las y del de en un una por con para se lo como más su al es que"
)

_rng = np.random.default_rng(99)
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PART = np.ones(256, bool)
_PART[48:58] = _PART[65:91] = _PART[97:123] = _PART[128:] = False


class Signatures:
    """Sorted distinct signature hashes (uint32) of a text, vectorised over its bytes."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)
        self.anchors = np.sort(self.words(ANCHORS))
        self.common = np.sort(self.words(FUNCTION_WORDS + " " + ANCHORS))

    def words(self, text: str) -> np.ndarray:
        raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        gap = np.concatenate([[True], _PART[raw], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[::2], edge[1::2]
        if len(raw) >= len(self.powers):
            n = max(len(raw), 2 * len(self.powers), 1 << 14)
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _B))])
            self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _B_INVERSE))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[raw] * self.powers[: len(raw)], dtype=np.uint64)])
        h = (sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * _B
        return h ^ (h >> np.uint64(29))

    @staticmethod
    def _among(words: np.ndarray, listed: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(listed, words), len(listed) - 1)
        return listed[at] == words

    @staticmethod
    def _by_hash(content: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
        """Content words that are anchors by hash: those in stretches of more than `least` words between chain starts."""
        length = np.diff(np.concatenate([first, [len(content)]]))
        if len(content) <= REACH or length.max() <= least:
            return np.empty(0, np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(content, REACH + 1)
        chosen = np.unique(np.arange(len(windows)) + windows.argmin(axis=1))
        return chosen[np.repeat(length > least, length)[chosen]]

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words(text or "")
        if not len(words):
            return np.empty(0, np.uint32)
        content = np.flatnonzero(~self._among(words, self.common))
        anchors = np.flatnonzero(self._among(words, self.anchors))
        if len(content) * 8 < len(words):
            content, anchors = np.arange(len(words)), anchors[:0]
        chain = np.concatenate([words[content], np.zeros(REACH, np.uint64)])  # zeros close the chains
        first = np.concatenate([[0], np.searchsorted(content, anchors, "right")])
        h = np.concatenate([[np.uint64(1)], words[anchors]])
        kept = first < len(content)
        first, h = first[kept], h[kept]
        chosen = self._by_hash(chain[: len(content)], first, SPARSE if len(anchors) else REACH)
        first, h = np.concatenate([first, chosen + 1]), np.concatenate([h, chain[chosen]])
        for j in range(CHAIN):
            h = (h ^ (h >> np.uint64(30))) * _B_INVERSE + chain[first + j * SPACING]
            h = (h ^ (h >> np.uint64(27))) * _B
        return np.unique((h >> np.uint64(32)).astype(np.uint32))


def length_partition(n: int, similarity: float) -> int:
    """The partition of sets of n signatures: sets of partitions two or more apart cannot be `similarity` alike."""
    return math.floor(math.log(n) / -math.log(similarity)) if n else -1


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets if it is at least `least`, else 0, pruned by length and on the way.

    Shared signatures are counted by ranges of the smaller set; counting ends when those still to come cannot
    bring the likeness to `least`."""
    if not len(a) and not len(b):
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or least and length_partition(len(large), least) - length_partition(len(small), least) > 1:
        return 0.0
    need = least / (1 + least) * (len(small) + len(large)) - 1e-9
    both = 0
    for at in range(0, len(small), 1024):
        if both + len(small) - at < need:
            return 0.0
        part = small[at : at + 1024]
        place = np.minimum(np.searchsorted(large, part), len(large) - 1)
        both += int(np.count_nonzero(large[place] == part))
    return both / (len(small) + len(large) - both) if both >= need else 0.0


def as_string(signatures: np.ndarray) -> str:
    """The fingerprint as text: its sorted hashes, big-endian, in base64."""
    return base64.b64encode(signatures.astype(">u4").tobytes()).decode()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(np.uint32)


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with its texts' `fingerprint`."""

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Signatures()
        for batch in batches:
            yield pa.array([as_string(own(t.as_py())) for t in batch], pa.string())

    return df.withColumn("fingerprint", of(F.col(text)))


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = 64 << 20) -> DataFrame:
    """Every document against its edited text: the last half of its code points replaced by as many
    first ones of the next document in ascending id order (the last is followed by the first).

    Ids are cut into ranges of about `range_bytes` of text by Spark's range partitioner, of which only
    each range's first id is kept (8 bytes a range); the first document of a range also goes to the range
    before it. So the texts are shuffled once, no range depends on another, and a task streams
    through its range in order, holding one document and the one before. Rows that share an id are ordered
    by text and stay in one range; null ids come first. Ids are whole numbers or their texts; any other
    text counts as a null id.
    """
    small_batches(df.sparkSession)
    spark = df.sparkSession
    docs = df.select(F.expr(f"try_cast(`{doc_id}` as bigint)").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.coalesce("id", F.lit(-(2**63)))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / min(range_bytes, 4 << 20)))
    parts = max(1, least, math.ceil(total / range_bytes))
    keys = docs.select(key.alias("key")).repartitionByRange(parts, "key") if parts > 1 else docs.select(key.alias("key")).coalesce(1)
    firsts = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key")).toPandas()["key"]  # one id a range
    lows = np.sort(firsts.to_numpy(np.int64))
    parts = max(1, len(lows))
    sent = spark.sparkContext.broadcast(lows)

    @F.arrow_udf("array<int>")
    def ranges_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lows = sent.value
        for batch in batches:
            k = batch.to_numpy(zero_copy_only=False)
            own = np.searchsorted(lows, k, "right") - 1
            first = lows[own] == k
            out = np.stack([own, (own - 1) % len(lows)], 1).ravel()[np.stack([np.ones(len(k), bool), first], 1).ravel()]
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(1 + first)]).astype(np.int32)), pa.array(out.astype(np.int32)))

    dealt = docs.select("id", key.alias("key"), "text", F.posexplode(ranges_of(key)).alias("ahead", "part"))
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("ahead", "key", "text").select("id", "text", "ahead")
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    )
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Signatures()
        before = None  # (id, text, signatures) of the document that waits for the next one
        done = False
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            ids, ahead = batch.column("id").to_pylist(), batch.column("ahead").to_numpy(zero_copy_only=False)
            for i, text in enumerate(batch.column("text")):
                if done:
                    break
                now = text.as_py()
                mine = own(now)
                if before is not None:
                    last_id, last, sigs = before
                    half = len(last) // 2
                    edited = last[: len(last) - half] + now[:half]
                    changed = own(edited)
                    row = (last_id, len(last), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_string(sigs), as_string(changed), jaccard(sigs, changed), jaccard(sigs, mine))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                before, done = (ids[i], now, mine), bool(ahead[i])  # the first row ahead closes the range
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], [f.name for f in schema])

    return dealt.mapInArrow(compared, schema)


def spot_pairs(df: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (doc_id, fingerprint, class) with class = the smallest id of equal
    fingerprints; pairs (a, b, likeness) of classes whose fingerprints reach `similarity`.

    Lengths are partitioned by powers of 1 / similarity; a set meets its own partition and the next,
    and only through its rarest signatures: the prefix that any similar set must share one of.
    """
    made = fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "fingerprint")
    made = stored(made, "spot-made")
    classes = made.groupBy("fingerprint").agg(F.min("doc_id").alias("class"))
    members = made.join(classes, "fingerprint")

    @F.arrow_udf("array<long>")
    def unpacked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([from_string(f.as_py()).astype(np.int64) for f in batch], pa.list_(pa.int64()))

    sets = stored(classes.where("fingerprint <> '' and class is not null").withColumn("sigs", unpacked("fingerprint")).select("class", "sigs", F.size("sigs").alias("n")), "spot-sets")
    postings = sets.select("class", "n", F.explode("sigs").alias("sig"))
    common = postings.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = postings.join(common, "sig", "left").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "sig"))).alias("by"))
    length = F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity)).cast("int")  # see `length_partition`
    prefix = ranked.withColumn("band", length).withColumn("hit", F.explode(F.slice("by", F.lit(1), F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1))))
    prefix = prefix.where("hit.df > 1").select("class", "n", "band", F.col("hit.sig").alias("sig"))
    low = prefix.withColumn("place", F.explode(F.array("band", F.col("band") + 1)))
    met = low.alias("x").join(prefix.alias("y"), F.expr("x.sig = y.sig and x.place = y.band and (x.n < y.n or x.n = y.n and x.class < y.class)"))
    met = met.where(F.col("x.n") >= F.col("y.n") * similarity - 1e-9).select(F.col("x.class").alias("p"), F.col("y.class").alias("q")).distinct()
    both = met.join(sets.select(F.col("class").alias("p"), F.col("sigs").alias("s"), F.col("n").alias("n_p")), "p").join(sets.select(F.col("class").alias("q"), F.col("sigs").alias("t"), F.col("n").alias("n_q")), "q")
    shared = F.size(F.array_intersect("s", "t"))
    pairs = both.withColumn("likeness", shared / (F.col("n_p") + F.col("n_q") - shared)).where(F.col("likeness") >= similarity)
    return members, pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "likeness")
