"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased. A word's embedding is
that of its hash plus that of the hash of its first four bytes; hashes seen in fewer than
MIN_DOCUMENTS training texts have the zero vector, so that new words are neutral. Filters of widths 1, 2 and 3 slide over the
whole text; each filter's maximum goes through a logistic layer. The first dimension of an embedding
starts at how surely the training texts' counts tie its hash to the label (a z-score of the
log-odds), and the first filter of each width starts by looking for it; both are then trained. Because a filter is linear in the
embeddings, scoring a text is two table look-ups per word and a few additions.

The fit uses every labelled document, in tasks: a pass counts in how many of them each hash occurs; learners of some LEARNER
documents each, dealt by a hash of the id, train from the same start over EPOCHS passes; their parameters are
averaged, those of an embedding over the learners that moved it (sums of fixed-point numbers, so that the order of
rows and partitions changes nothing). A fifth of the documents calibrates instead: for each language, told from the text's own
function words, the cut that parts the classes best is mapped to a score of 0.7, and so `score >= 0.7` decides in every
language. What the driver gets is bounded by the hashes (2**BITS a side) and by the GRID of scores, not by the rows.
Labels, language and source columns, and ids are never inputs of a score.

Null and empty texts get the score of a text without evidence. Rows with a null label or an id
without a document teach nothing; without two classes every score is 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import small_batches, stored

BITS, SIZE, WIDTHS, FILTERS = 20, 12, (1, 2, 3), 8
MIN_DOCUMENTS, EPOCHS, BATCH, CUT = 4, 3, 32, 0.7
LEARNER, GRID, FIXED = 4096, 1 << 16, 2.0**32
BROADCAST = 500_000  # labelled ids that are broadcast to the documents; more are joined by a shuffle
CHUNK = 50_000

_rng = np.random.default_rng(7)
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PART = np.ones(256, bool)  # bytes outside words
_PART[48:58] = _PART[65:91] = _PART[97:123] = _PART[128:] = False

#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is that for was with are this be by from at it not have",
    "de": "der die und das den von zu mit dem ist nicht ein eine auf für sich im auch",
    "fr": "le les et des du une dans est pour que qui pas sur au par ce il la",
    "es": "el los las y del en por con para una se lo como más su al es que",
}
LANGUAGES = ("", *FUNCTION_WORDS)


class Words:
    """(word hashes, prefix hashes) of a text, each in 0 .. 2**BITS - 1, vectorised over its bytes."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        raw = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
        gap = np.concatenate([[True], _PART[raw], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[::2], edge[1::2]
        if len(raw) >= len(self.powers):
            n = max(len(raw), 2 * len(self.powers), 1 << 14)
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _B))])
            self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _B_INVERSE))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[raw] * self.powers[: len(raw)], dtype=np.uint64)])
        return self._hash(sums, start, end), self._hash(sums, start, np.minimum(end, start + 4))

    def _hash(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * _B
        return (h >> np.uint64(64 - BITS)).astype(np.int32)


def _language_table() -> np.ndarray:
    table, words = np.zeros(1 << BITS, np.int8), Words()
    owners: dict[int, set[int]] = {}
    for k, language in enumerate(LANGUAGES[1:], 1):
        for h in words(FUNCTION_WORDS[language])[0]:
            owners.setdefault(int(h), set()).add(k)
    for h, who in owners.items():
        if len(who) == 1:
            table[h] = min(who)
    return table


_LANGUAGE_OF = _language_table()


def language_of(words: np.ndarray) -> int:
    """Index into LANGUAGES by the text's function words; 0 if it has none or two are even."""
    counts = np.bincount(_LANGUAGE_OF[words], minlength=len(LANGUAGES))[1:]
    top = int(counts.argmax())
    return top + 1 if counts[top] and (counts == counts[top]).sum() == 1 else 0


class Model:
    """Embeddings, filters and the logistic layer; `cuts` by language."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], totals: tuple[int, int], seed: int = 3):
        """counts: for words and for prefixes, texts of each label (0, 1) by hash; totals: texts of each."""
        rng = np.random.default_rng(seed)
        self.index, self.embed = [], []
        for clean, toxic in counts:
            index = np.zeros(1 << BITS, np.int32)
            known = np.flatnonzero(clean + toxic >= MIN_DOCUMENTS)
            index[known] = np.arange(1, len(known) + 1)
            self.index.append(index)
            a, b = toxic[known] + 0.5, clean[known] + 0.5
            table = rng.normal(0, 0.02, (len(known) + 1, SIZE))
            table[0] = 0
            table[1:, 0] += (np.log(a / (totals[1] + 1)) - np.log(b / (totals[0] + 1))) / np.sqrt(1 / a + 1 / b) / 4
            self.embed.append(table.astype(np.float32))
        self.filters = [rng.normal(0, 0.1, (w, SIZE, FILTERS)) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS))
        for k in range(len(WIDTHS)):
            self.filters[k][:, :, 0] = 0
            self.filters[k][0, 0, 0] = 1
            self.out[k * FILTERS] = 1
        self.bias = -2.0
        self.cuts = np.full(len(LANGUAGES), 0.5)

    @cached_property
    def tables(self) -> list[np.ndarray]:
        """Response of every filter row to every embedding; not sent, as it is four times the embeddings."""
        return [t @ self.flat().astype(np.float32) for t in self.embed]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def flat(self) -> np.ndarray:
        """The rows of all filters side by side, as columns."""
        return np.concatenate([f.transpose(1, 0, 2).reshape(SIZE, -1) for f in self.filters], axis=1)

    def pooled(self, word: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Every filter's largest response over the text, 0 at least."""
        best = np.zeros(len(self.out), np.float32)
        for start in range(0, max(1, len(word)), CHUNK):
            a, b = self.index[0][word[start : start + CHUNK + 2]], self.index[1][prefix[start : start + CHUNK + 2]]
            rows = self.tables[0][a] + self.tables[1][b]
            col = 0
            for k, w in enumerate(WIDTHS):
                n = len(rows) - w + 1
                if n > 0:
                    seen = rows[:n, col : col + FILTERS].copy()
                    for j in range(1, w):
                        seen += rows[j : j + n, col + j * FILTERS : col + (j + 1) * FILTERS]
                    part = slice(k * FILTERS, (k + 1) * FILTERS)
                    best[part] = np.maximum(best[part], seen.max(0))
                col += w * FILTERS
        return best

    def raw(self, word: np.ndarray, prefix: np.ndarray) -> float:
        z = float(self.pooled(word, prefix) @ self.out + self.bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(self, word: np.ndarray, prefix: np.ndarray) -> float:
        p, cut = self.raw(word, prefix), float(self.cuts[language_of(word)])
        return CUT * p / cut if p < cut else CUT + (1 - CUT) * (p - cut) / (1 - cut)

    def fit(self, docs: list, labels: np.ndarray, weights: np.ndarray, rate: float = 0.003, decay: float = 1e-3, seed: int = 5) -> list[np.ndarray]:
        """Train on `docs` (their rows of the two embedding tables), each with a weight; the embedding rows that moved."""
        rng = np.random.default_rng(seed)
        dense = [*self.filters, self.out]
        first, second = [np.zeros_like(p) for p in (*self.embed, *dense)], [np.zeros_like(p) for p in (*self.embed, *dense)]
        moved = [np.zeros(len(t), bool) for t in self.embed]
        step, bias_state = 0, [0.0, 0.0]
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for begin in range(0, len(order), BATCH):
                batch = order[begin : begin + BATCH]
                grads, bias_grad, touched = self._slopes([docs[i] for i in batch], labels[batch], weights[batch] / len(batch))
                step += 1
                fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
                for side, (rows, g) in enumerate(touched):  # embeddings: Adam on the rows that this batch touched
                    moved[side][rows] = True
                    m, v = first[side], second[side]
                    m[rows] = 0.9 * m[rows] + 0.1 * g
                    v[rows] = 0.999 * v[rows] + 0.001 * g * g
                    self.embed[side][rows] -= rate * (m[rows] / fix1) / (np.sqrt(v[rows] / fix2) + 1e-8) + rate * decay * self.embed[side][rows]
                for p, g, m, v in zip(dense, grads, first[2:], second[2:], strict=True):
                    m[:] = 0.9 * m + 0.1 * g
                    v[:] = 0.999 * v + 0.001 * g * g
                    p -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
                bias_state = [0.9 * bias_state[0] + 0.1 * bias_grad, 0.999 * bias_state[1] + 0.001 * bias_grad**2]
                self.bias -= rate * (bias_state[0] / fix1) / (np.sqrt(bias_state[1] / fix2) + 1e-8)
        return [np.flatnonzero(t) for t in moved]

    def _slopes(self, docs: list, labels: np.ndarray, weights: np.ndarray) -> tuple[list[np.ndarray], float, list[tuple[np.ndarray, np.ndarray]]]:
        """Derivatives of the documents' weighted log loss: by filters and the logistic layer, by the bias, and by the embedding rows
        of each side that a filter's maximum stands on."""
        ids = [np.concatenate([d[side] for d in docs]) for side in (0, 1)]
        ends = np.cumsum([len(d[0]) for d in docs])
        rows = self.embed[0][ids[0]] + self.embed[1][ids[1]]
        seen = rows @ self.flat()
        best, at, col = np.zeros((len(docs), len(self.out))), np.full((len(docs), len(self.out)), -1), 0
        for k, w in enumerate(WIDTHS):
            n, part = max(0, len(rows) - w + 1), slice(k * FILTERS, (k + 1) * FILTERS)
            total = sum(seen[j : j + n, col + j * FILTERS : col + (j + 1) * FILTERS] for j in range(w))
            for d, end in enumerate(ends):
                start = end - len(docs[d][0])
                own = total[start : max(start, end - w + 1)]
                if len(own):
                    top = own.argmax(0)
                    value = own[top, np.arange(FILTERS)]
                    best[d, part] = np.maximum(value, 0)
                    at[d, part] = np.where(value > 0, start + top, -1)
            col += w * FILTERS
        slope = (1 / (1 + np.exp(-np.clip(best @ self.out + self.bias, -30, 30))) - labels) * weights
        grads, found = [np.zeros_like(f) for f in self.filters], [([], []), ([], [])]
        for k, w in enumerate(WIDTHS):
            where = at[:, k * FILTERS : (k + 1) * FILTERS]
            doc, c = np.nonzero(where >= 0)
            back = slope[doc] * self.out[k * FILTERS + c]
            for j in range(w):
                place = where[doc, c] + j
                np.add.at(grads[k][j].T, c, back[:, None] * rows[place])
                g = back[:, None] * self.filters[k][j].T[c]
                for side in (0, 1):
                    known = ids[side][place] > 0
                    found[side][0].append(ids[side][place][known])
                    found[side][1].append(g[known])
        touched = []
        for rows_of, g_of in found:
            own, turn = np.unique(np.concatenate(rows_of), return_inverse=True)
            g = np.zeros((len(own), SIZE))
            np.add.at(g, turn, np.concatenate(g_of))
            touched.append((own, g))
        return [*grads, best.T @ slope], float(slope.sum()), touched

    def dense(self) -> np.ndarray:
        """Filters, the logistic layer and the bias as lines of SIZE numbers."""
        flat = np.concatenate([*[f.ravel() for f in self.filters], self.out, [self.bias]])
        return np.append(flat, np.zeros(-len(flat) % SIZE)).reshape(-1, SIZE)

    def take_dense(self, lines: np.ndarray) -> None:
        flat, start = lines.ravel(), 0
        for p in (*self.filters, self.out):
            p[...] = flat[start : start + p.size].reshape(p.shape)
            start += p.size
        self.bias = float(flat[start])

    def calibrate(self, bins: dict[int, np.ndarray], least: int = 20) -> None:
        """By language, and over all for those with fewer than `least` of a class, the cut of the best F1. `bins` has by language the
        lines (bin of the score, smallest and largest score in it, documents of label 0 and of 1, their weights)."""
        self.cuts[:] = _best_cut(np.concatenate(list(bins.values()))) if bins else 0.5
        for k, lines in bins.items():
            if k and (lines[:, 3:5].sum(0) >= least).all():
                self.cuts[k] = _best_cut(lines)


def _best_cut(lines: np.ndarray) -> float:
    """Half way between the scores around the best F1, kept within 0.02 .. 0.98."""
    if not lines[:, 4].any():
        return 0.5
    _, turn = np.unique(-lines[:, 0], return_inverse=True)  # from the highest bin down, languages together
    low, high, clean, toxic = np.full(turn.max() + 1, np.inf), np.zeros(turn.max() + 1), np.zeros(turn.max() + 1), np.zeros(turn.max() + 1)
    np.minimum.at(low, turn, lines[:, 1])
    np.maximum.at(high, turn, lines[:, 2])
    np.add.at(clean, turn, lines[:, 5])
    np.add.at(toxic, turn, lines[:, 6])
    i = int((2 * np.cumsum(toxic) / (np.cumsum(clean + toxic) + toxic.sum())).argmax())
    return float(np.clip((low[i] + (high[i + 1] if i + 1 < len(high) else 0)) / 2, 0.02, 0.98))


def _document_counts(train: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and for prefixes, documents of each label (0, 1) by hash, where they are MIN_DOCUMENTS at least."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = Words(), np.zeros((2, 2, 1 << BITS), np.int32)
        for batch in batches:
            for toxic, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
                for side, hashes in enumerate(words(text.as_py())):
                    found[side, toxic][np.unique(hashes)] += 1
        for side in (0, 1):
            own = np.flatnonzero(found[side].any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), side, np.int32)), pa.array(own.astype(np.int32)), pa.array(found[side, 0][own]), pa.array(found[side, 1][own])], ["side", "hash", "clean", "toxic"])

    sums = train.select("y", "text").mapInArrow(counted, "side int, hash int, clean int, toxic int").groupBy("side", "hash").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    known = sums.where(F.col("clean") + F.col("toxic") >= MIN_DOCUMENTS).toArrow()
    side, hashes = known.column("side").to_numpy(), known.column("hash").to_numpy()
    counts = np.zeros((2, 2, 1 << BITS), np.int64)
    for toxic, name in enumerate(("clean", "toxic")):
        counts[side, toxic, hashes] = known.column(name).to_numpy()
    return [(c[0], c[1]) for c in counts]


def _averaged(train: DataFrame, model: Model, learners: int, weights: tuple[float, float]) -> None:
    """Train `learners` copies of the model on documents dealt by their ids, and give it the means of their parameters."""
    sent, names = train.sparkSession.sparkContext.broadcast(pickle.dumps(model)), [f"v{i}" for i in range(SIZE)]

    def learn(group: pa.Table) -> pa.Table:
        own, words = pickle.loads(sent.value), Words()
        group = group.sort_by([("h", "ascending"), ("_id", "ascending")])
        hashes = [words(t.as_py()) for t in group.column("text")]
        docs = [[own.index[side][d[side]] for d in hashes] for side in (0, 1)]
        used = [np.unique(np.concatenate([[0], *d])) for d in docs]  # only the embeddings of this learner's words
        own.embed = [own.embed[side][used[side]].astype(float) for side in (0, 1)]
        local = list(zip(*[[np.searchsorted(used[side], d) for d in docs[side]] for side in (0, 1)], strict=True))
        y = group.column("y").to_numpy().astype(np.int64)
        moved = own.fit(local, y, np.array(weights)[y])
        parts = [(side, used[side][rows], own.embed[side][rows]) for side, rows in enumerate(moved)] + [(2, np.arange(len(own.dense())), own.dense())]
        values = np.rint(np.concatenate([p[2] for p in parts]) * FIXED).astype(np.int64)
        side, rows = np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int32)
        return pa.table([pa.array(side), pa.array(rows), *map(pa.array, values.T)], ["side", "row", *names])

    dealt = train.select("_id", "h", "y", "text", F.pmod(F.xxhash64(F.lit(37), "_id"), F.lit(learners)).alias("learner"))
    dealt = dealt.repartitionByRange(4 * learners, "learner")  # each learner is a range of its own
    lines = dealt.groupBy("learner").applyInArrow(learn, "side int, row int, " + ", ".join(f"{n} long" for n in names))
    means = lines.groupBy("side", "row").agg(*[(F.sum(n) / F.count(F.lit(1)) / FIXED).cast("float").alias(n) for n in names]).toArrow()
    side, rows = means.column("side").to_numpy(), means.column("row").to_numpy()
    values = np.stack([means.column(n).to_numpy() for n in names], 1)
    for k in (0, 1):
        model.embed[k][rows[side == k]] = values[side == k]
    if (side == 2).any():
        model.take_dense(values[side == 2][np.argsort(rows[side == 2])])


def _score_bins(held: DataFrame, model: Model, weights: tuple[float, float]) -> dict[int, np.ndarray]:
    """By language, what `Model.calibrate` asks for: counts of all calibrating documents by their scores in GRID bins."""
    sent = held.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = pickle.loads(sent.value), Words()
        for batch in batches:
            docs = [words(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([language_of(d[0]) for d in docs], pa.int32()), pa.array([own.raw(*d) for d in docs], pa.float64()), batch.column("y")], ["language", "p", "y"])

    rows = held.select("text", "y").mapInArrow(scored, "language int, p double, y int").withColumn("bin", F.floor(F.col("p") * GRID))
    found = rows.groupBy("language", "bin").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count_if(F.col("y") == 0).alias("clean"), F.count_if(F.col("y") == 1).alias("toxic")).toArrow()
    lines = np.stack([np.asarray(found.column(c).to_numpy(), float) for c in ("bin", "low", "high", "clean", "toxic", "clean", "toxic")], 1)
    lines[:, 5:] *= weights
    language = found.column("language").to_numpy()
    return {int(k): lines[language == k] for k in np.unique(language)}


def fit_toxicity(documents: DataFrame, labels: DataFrame, positives: int | None = None, negatives: int | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Train on all labelled documents; with `positives` or `negatives`, on at most so many of that label, chosen by hash order of the id.

    `labels` has (doc_id, label 0/1); repeated ids count once, as toxic if any row says so, with the largest of their texts.
    No text reaches the driver.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("y"))
    marked = marked.where("y in (0, 1)").select(F.col(doc_id).alias("_id"), F.col("y").cast("int").alias("y"), F.xxhash64(F.lit(29), F.col(doc_id)).alias("h"))
    share, totals = [1.0, 1.0], {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if positives is not None or negatives is not None:
        parts = []
        for y, most in enumerate((negatives, positives)):
            few = marked.where(f"y = {y}")
            if most is not None and most < totals.get(y, 0):
                few, share[y] = few.orderBy("h", "_id").limit(most), totals[y] / max(1, most)
            parts.append(few)
        marked = parts[0].union(parts[1])
    spark = documents.sparkSession
    small_batches(spark)
    named = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(marked) if sum(totals.values()) <= BROADCAST else marked, "_id")
    named = named.groupBy("_id").agg(F.first("h").alias("h"), F.first("y").alias("y"), F.max("text").alias("text"))  # one text an id, however often it is repeated
    named = stored(named.withColumn("held", F.pmod(F.xxhash64(F.lit(31), "_id"), F.lit(5)) == 0), "toxicity-labelled")
    sizes = {(r["held"], r["y"]): r["n"] for r in named.groupBy("held", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({y for _, y in sizes}) < 2:
        return None
    train, own = named.where("not held"), [sizes.get((False, y), 0) for y in (0, 1)]
    model = Model(_document_counts(train), (own[0], own[1]))
    _averaged(train, model, max(1, round(sum(own) / LEARNER)), tuple(0.5 * sum(own) / max(1, n) for n in own))
    model.calibrate(_score_bins(named.where("held"), model, (share[0], share[1])))
    return model


def score_toxicity(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`df` with `score` (0 to 1), replacing a column of that name; the whole text counts."""
    if model is None:
        return df.withColumn("score", F.lit(0.0))
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # 110 MB at most, whatever the input

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, words = pickle.loads(sent.value), Words()
        for batch in batches:
            yield pa.array([own.score(*words(t.as_py())) for t in batch], pa.float64())

    return df.withColumn("score", scored(F.col(text)))
