"""Near-duplicates by SetSketch registers: band, estimate jointly by likelihood, verify.

Every text becomes its set of distinct word shingles (A-Z lower-cased; a text shorter than the
shingle is one shingle; a text without words has an empty set). A set is sketched into REGISTERS
registers: the minimum of an exponential variate per register and shingle, truncated on an
exponentially spaced scale. Registers merge by maximum, and two sets agree in a register with a
probability close to their Jaccard similarity.

1. Sketch pass over the texts: set size, digest of the set, registers, band keys. Equal sets form
   one class, however many copies there are; classes are all that is compared from here on.
2. Bands of registers: in each band key the other classes meet the smallest one (a star).
3. Candidates whose joint likelihood makes the threshold implausible are dropped; the others are
   verified on their full sets, which a second pass over the texts gathers for candidates only.
4. Links give components. Where a band key still holds classes of different components, exactly
   those cross-component pairs that no star has tested are compared: by registers, block against block of
   bounded size, which tells the suspects, then the suspects by full sets, pair by pair inside the
   tasks, and components are formed again. A key of m classes in components of their own takes m * m / 2
   comparisons of registers (few such keys exist: its classes agree in a band and yet are unlike) in
   tasks that hold two blocks at most; each class is sent to m / BLOCK of them.

The smallest id of a component keeps. Rows with a null id are kept and linked with nothing; rows
that share an id are one document. With 30 bands of 5 registers, a pair at the threshold 0.8
escapes every band with a probability below 1e-5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import small_batches, stored
from tidewatch.operators.components import connected_components

BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: Scale of the registers: base, rate and the largest value.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: A candidate is dropped when its likelihood at the threshold is exp(-SLACK) of the best or less.
SLACK = 12.5
BLOCK = 2048
#: Tasks that a band key's members are dealt to where they are joined with the key.
SPREAD = 16
#: Shingles of a block of sets (eight bytes each).
SET_BLOCK = 1 << 20
BITS = 26

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**64, REGISTERS, dtype=np.uint64)
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text, vectorised over its bytes."""

    def __init__(self, words: int):
        self.words, self.powers = words, np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            m = max(n, 2 * len(self.powers), 1 << 14)
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, _B))])
            self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, _B_INVERSE))])

    def __call__(self, text: str | None) -> np.ndarray:
        raw = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
        gap = np.concatenate([[True], _SPACE[raw], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.empty(0, np.uint64)
        self._grow(len(raw) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[raw] * self.powers[: len(raw)], dtype=np.uint64)])
        word = _mixed((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        k = min(self.words, len(word))
        n = len(word) - k + 1
        h = np.full(n, np.uint64(k))
        for j in range(k):
            h = _mixed(h * _STEP + word[j : j + n])
        return np.unique(h)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers (uint16) of a set of hashes; zeros for the empty set."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full(REGISTERS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 512):
        part = hashes[at : at + 512]
        np.minimum(low, (part[None, :] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=low)
    least = -np.log1p(-np.clip((low.astype(np.float64) + 0.5) / 2.0**64, 1e-300, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    parts = registers.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _B
    for j in range(ROWS):
        h = _mixed(h + parts[:, j] * _BAND[:, j])
    return h.view(np.int64)


def plausible(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a similarity of `threshold` or more is within SLACK of the best joint likelihood.

    greater / less: registers where the first / second sketch is larger; n_a, n_b: the set sizes.
    """
    equal = REGISTERS - greater - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def share(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        up, down = share(u - v * j), share(v - u * j)
        return greater * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    best = high = np.full(len(u), -np.inf)
    for step in np.linspace(0, 1, 41):
        j = most * step
        here = log_likelihood(j)
        best = np.maximum(best, here)
        high = np.maximum(high, np.where(j >= threshold, here, -np.inf))
    edge = log_likelihood(np.minimum(most, threshold))
    high = np.maximum(high, np.where(most >= threshold, edge, -np.inf))
    return high >= np.maximum(best, edge) - SLACK


def _sketched(df: DataFrame, words: int) -> DataFrame:
    """(id, n, digest, registers, bands) for rows of (id, text)."""
    schema = f"id {df.schema['id'].dataType.simpleString()}, n long, digest binary, registers binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            n, digest, registers, bands = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py())
                regs = sketch(found)
                n.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                registers.append(regs.tobytes())
                bands.append(band_keys(regs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(registers, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "n", "digest", "registers", "bands"],
            )

    return df.mapInArrow(run, schema)


def _sets_of(df: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(digest, shingles) of the wanted digests, from the texts of the wanted representatives.

    A fixed-size bitmap of the wanted ids (2**BITS bits, whatever the input) tells which texts to
    shingle again; digests then decide. A full bitmap only costs time.
    """
    spark = df.sparkSession
    width = 1 << BITS
    words64 = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(width)).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask"))
    bitmap = np.zeros(width // 64, np.int64)
    found = words64.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # 2**BITS / 64 rows at most
    bitmap[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    bits = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            bit = batch.column("bit").to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((bits.value[bit >> 6] >> (bit & 63)) & 1)
            texts = batch.column("text")
            for at in range(0, len(hit), 256):  # sets are larger than texts: few at a time
                digest, sets = [], []
                for i in hit[at : at + 256].tolist():
                    found = shingles(texts[i].as_py()).tobytes()
                    digest.append(hashlib.blake2b(found, digest_size=16).digest())
                    sets.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])

    hits = df.select("text", F.pmod(F.xxhash64("id"), F.lit(width)).alias("bit")).mapInArrow(run, "digest binary, shingles binary")
    return hits.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def _verified(df: DataFrame, pairs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of digests whose full sets reach the threshold."""
    ends = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct()
    wanted = stored(ends.join(classes.select("digest", "rep"), "digest"), "near-wanted")
    sets = stored(_sets_of(df, wanted, words), "near-sets")

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):  # views of the batch, not copies
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    first = pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = first.join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("set_b")), "b")
    return both.where(alike("set_a", "set_b")).select("a", "b")


def _screened(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose registers leave the threshold plausible."""
    side = classes.select("digest", "n", "registers")
    met = pairs.join(side.toDF("a", "n_a", "r_a"), "a").join(side.toDF("b", "n_b", "r_b"), "b")

    @F.pandas_udf("boolean")
    def likely(n_a: pd.Series, r_a: pd.Series, n_b: pd.Series, r_b: pd.Series) -> pd.Series:
        if not len(n_a):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(r_a), np.uint16).reshape(-1, REGISTERS)
        y = np.frombuffer(b"".join(r_b), np.uint16).reshape(-1, REGISTERS)
        return pd.Series(plausible((x > y).sum(1), (x < y).sum(1), n_a.to_numpy(float), n_b.to_numpy(float), percent / 100))

    return met.where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")).where(likely("n_a", "r_a", "n_b", "r_b")).select("a", "b")


def _suspects(bands: DataFrame, classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(key, digest, component, n) of the classes that have, in this band key, an untested partner of
    another component with plausible registers.

    bands: (key, digest, low), low being the star's centre, which has been tested with all. In each key
    the largest component is home; blocks of classes of other components (strays) meet the blocks of
    the key's members. A pair counts in the first band that it shares only, so that it is verified once.
    """
    named = bands.where("digest <> low").join(labels, "digest")
    per = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    home = per.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("home"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("members"), F.max("size").alias("largest")).where("parts > 1")
    home = home.withColumns({"blocks": F.ceil(F.col("members") / BLOCK).cast("int"), "turns": F.ceil((F.col("members") - F.col("largest")) / BLOCK).cast("int")})
    # A hot key's members are dealt over SPREAD tasks, each of which has its row of `home`.
    home = home.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    side = classes.select("digest", "n", "registers")
    rows = named.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SPREAD)).cast("int")).join(home, ["key", "salt"]).join(side, "digest")
    rows = rows.withColumn("stray", F.col("component") != F.col("home"))
    own = rows.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).withColumn("asks", F.lit(False)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    asks = rows.where("stray").withColumn("turn", F.pmod(F.xxhash64(F.lit(1), "digest"), F.col("turns")).cast("int"))
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    cols = ["key", "block", "turn", "digest", "component", "n", "registers", "asks"]
    kind = labels.schema["component"].dataType.simpleString()

    def compared(key: tuple, group: pa.Table) -> pa.Table:
        frame = group.drop_columns(["key", "block", "turn"]).to_pandas()
        ask, own = frame[frame.asks], frame[~frame.asks]
        hit_own, hit_ask = np.zeros(len(own), bool), np.zeros(len(ask), bool)
        if len(ask) and len(own):
            regs = np.frombuffer(b"".join(own.registers), np.uint16).reshape(-1, BANDS, ROWS)
            band = int(np.flatnonzero(band_keys(regs[0].ravel()) == key[0].as_py())[0])
            n, part = own.n.to_numpy(float), own.component.to_numpy()
            for at, (component, size, raw) in enumerate(zip(ask.component, ask.n, ask.registers, strict=True)):
                open_ = np.flatnonzero((part != component) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size)))
                mine = np.frombuffer(raw, np.uint16).reshape(BANDS, ROWS)
                if band and len(open_):
                    open_ = open_[~(regs[open_, :band] == mine[:band]).all(2).any(1)]
                if not len(open_):
                    continue
                theirs, mine = regs[open_].reshape(len(open_), -1), mine.ravel()
                likely = open_[plausible((mine > theirs).sum(1), (mine < theirs).sum(1), np.full(len(open_), float(size)), n[open_], percent / 100)]
                hit_own[likely] = True
                hit_ask[at] = len(likely) > 0
        found = frame[["digest", "component", "n"]].loc[[*own.index[hit_own], *ask.index[hit_ask]]].drop_duplicates("digest")
        found.insert(0, "key", key[0].as_py())
        return pa.Table.from_pandas(found, preserve_index=False, schema=wanted)

    wanted = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("component", pa.string() if kind == "string" else pa.int64()), ("n", pa.int64())])
    # Few bytes, much work: as many parts as the rows need, which adaptive execution leaves alone.
    parts = max(int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions")), bands.count() // 2000)
    dealt = own.select(*cols).union(asks.select(*cols)).repartition(parts, "key", "block", "turn")
    return dealt.groupBy("key", "block", "turn").applyInArrow(compared, f"key long, digest binary, component {kind}, n long").distinct()


def _crossing(df: DataFrame, suspects: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) among the suspects of each band key, on full sets; of the links that join the same
    components in one task, one is enough.

    A key's suspects are dealt into blocks of about SET_BLOCK shingles, and every two blocks meet in a task.
    """
    wanted = stored(suspects.select("digest").distinct().join(classes.select("digest", "rep", "registers"), "digest"), "near-wanted")
    sets = _sets_of(df, wanted, words).join(wanted.select("digest", "registers"), "digest")
    per = suspects.groupBy("key").agg(F.ceil(F.sum("n") / SET_BLOCK).cast("int").alias("blocks"))
    dealt = suspects.join(per, "key").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "digest", "component").join(sets, "digest")

    def linked(key: tuple, group: pa.Table) -> pa.Table:
        names, blocks = group.column("digest").to_pylist(), group.column("own").to_numpy()
        regs = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(len(names), BANDS, ROWS)
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]  # views
        size = np.array([len(x) for x in held], float)
        _, part = np.unique(np.array(group.column("component").to_pylist()), return_inverse=True)
        band = int(np.flatnonzero(band_keys(regs[0].ravel()) == key[0].as_py())[0])
        x, y = key[1].as_py(), key[2].as_py()
        a_out, b_out = [], []
        for i in range(1, len(names)):
            open_ = np.flatnonzero((part[:i] != part[i]) & (100 * np.minimum(size[:i], size[i]) >= percent * np.maximum(size[:i], size[i])))
            if x != y:
                open_ = open_[blocks[open_] != blocks[i]]
            if band and len(open_):
                open_ = open_[~(regs[open_, :band] == regs[i, :band]).all(2).any(1)]
            if not len(open_):
                continue
            theirs, mine = regs[open_].reshape(len(open_), -1), regs[i].ravel()
            same = (theirs == mine).sum(1)
            likely = plausible((mine > theirs).sum(1), (mine < theirs).sum(1), np.full(len(open_), size[i]), size[open_], percent / 100)
            for j in open_[likely][np.argsort(-same[likely], kind="stable")]:
                if part[j] == part[i]:
                    continue
                p, q = held[i], held[j]
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                if 100 * both >= percent * (len(p) + len(q) - both):
                    a_out.append(names[i])
                    b_out.append(names[j])
                    part[part == part[j]] = part[i]
        return pa.table({"a": pa.array(a_out, pa.binary()), "b": pa.array(b_out, pa.binary())})

    return dealt.groupBy("key", "x", "y").applyInArrow(linked, "a binary, b binary")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: links where
    100 * intersection >= percent * union of the shingle sets, and their connected components."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sketches = stored(_sketched(docs, words), "near-sketches")
    named = sketches.where("id is not null and n > 0")
    classes = stored(
        named.groupBy("digest").agg(F.min(F.struct("id", "n", "registers", "bands")).alias("x")).select("digest", F.col("x.id").alias("rep"), "x.n", "x.registers", "x.bands"),
        "near-classes",
    )
    bands = classes.select(F.explode("bands").alias("key"), "digest")
    shared = bands.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("key", "low")
    bands = stored(bands.join(shared, "key"), "near-bands")
    stars = stored(_screened(bands.where("digest <> low").select(F.col("low").alias("a"), F.col("digest").alias("b")).distinct(), classes, percent), "near-stars")
    links = stored(_verified(docs, stars, classes, words, percent), "near-links")

    reps = classes.select("digest", "rep")
    # One id with several texts joins their classes.
    held = named.join(reps, "digest").select("id", "rep").distinct()
    several = held.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("id", "low")
    several = held.join(several, "id").where("rep <> low").select(F.col("rep").alias("src"), F.col("low").alias("dst"))

    def labelled(found: DataFrame) -> DataFrame:
        edges = found.join(reps.toDF("a", "src"), "a").join(reps.toDF("b", "dst"), "b").select("src", "dst")
        parts = connected_components(edges.union(several))
        return reps.join(parts, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))

    labels = stored(labelled(links), "near-labels")
    suspects = stored(_suspects(bands, classes, labels, percent), "near-suspects")
    if suspects.limit(1).count():
        more = stored(_crossing(docs, suspects, classes, words, percent), "near-more")
        if more.limit(1).count():
            labels = stored(labelled(links.union(more)), "near-labels")
    out = sketches.select("id", "n", "digest").join(labels, "digest", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def without_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `df` whose document is the smallest of its component. Where that document has
    several rows (a repeated id), the one with the smallest hash of its text stays. Ids may be of any
    type with an order; other columns may have any names but those of this operator's own (_id, _nth)."""
    found = stored(near_duplicates(df, doc_id, text, words, percent).select(F.col("doc_id").alias("_id"), "kept"), "near-found")
    counts = found.where("_id is not null").groupBy("_id").agg(F.bool_and("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows"))
    out = counts.where("not _kept or _rows > 1")
    rest = df.join(out.select("_id"), F.col(doc_id) == F.col("_id"), "left_anti")
    repeated = counts.where("_kept and _rows > 1").select("_id")
    if not repeated.limit(1).count():
        return rest
    order = Window.partitionBy(doc_id).orderBy(F.xxhash64(text))
    one = df.join(repeated, F.col(doc_id) == F.col("_id"), "left_semi").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    return rest.unionByName(one)
