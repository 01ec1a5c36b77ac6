"""The pipeline's stages on the smallest table and on a small fixture, each against a plain version."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewatch.llm import mixture, packing, queries, toxicity
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def words_of(text):
    return len(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def fixture(spark):
    """Nulls in every column, empty and long texts, ties, repeats, clashing names."""
    rng = np.random.default_rng(41)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(300)], rng.integers(1, 90))), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, None, "en", "s0"), (101, "", None, "s1"), (102, " \n\t", "de", None), (103, "long  text\n" * 4000, "en", "s2"), (104, rows[5][1], "en", "s0"), (104, rows[5][1], "en", "s0"), (None, "no id here at all", "fr", "s1"), (None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, start long, kept boolean, _nothing int"
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "k", 1, 2, True, None) for i, t, la, s in rows], kind)


def place_of(row, seed):
    """The hash that orders a source's documents; one without an id goes by its text."""
    name = str(row[0]) if row[0] is not None else None if row[1] is None else "null:" + hashlib.md5(row[1].encode()).hexdigest()
    return hashlib.md5((str(seed) if name is None else f"{seed}:{name}").encode()).hexdigest()


def plain_mix(rows, seed=17, most=3, weights=(5, 2, 1)):
    """{(doc_id, text, source): copies} of rows (doc_id, text, source), from the description of the mix."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words_of(text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(sizes.values()))
    while open_:  # stop the full ones at their limit, share what is left
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > most * sizes[s]]
        for s in full or open_:
            target[s] = most * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in (full or open_)]
    copies = {}
    for s in names:
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (place_of(r, seed), -1 if r[0] is None else r[0], words_of(r[1])))
        due = int(target[s] + 0.5)
        passes, room = divmod(due, sizes[s]) if sizes[s] else (0, 0)
        taken, at, cut = [passes] * len(own), 0, None
        for i, r in enumerate(own):
            n = words_of(r[1])
            if n and at + n <= room:
                taken[i] += 1
            elif n and at < room:
                cut = (i, n, room - at)
            at += n
        if cut:  # the boundary document goes in whole, or the largest unreached ones that fit, one of each size
            first = {}
            for i in range(cut[0] + 1, len(own)):
                n = words_of(own[i][1])
                if 0 < n <= cut[2]:
                    first.setdefault(n, i)
            fill, gap = [], cut[2]
            for n in sorted(first, reverse=True):
                if n <= gap:
                    fill, gap = fill + [first[n]], gap - n
            for i in [cut[0]] if cut[1] - cut[2] < gap else fill:
                taken[i] += 1
        for r, n in zip(own, taken):
            if words_of(r[1]) and n:
                copies[r] = copies.get(r, 0) + n
    return copies, {s: (target[s], sizes[s]) for s in names}


def triple(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages_on_the_table(spark, table, tmp_path):
    docs, labels = table, spark.read.parquet(f"{SF}/labels.parquet")
    for name in ("toxicity", "near_dedup", "mixture"):
        STAGES[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == table.columns
        before, got = {r.doc_id: r for r in docs.collect()}, after.collect()
        if name == "toxicity":
            learn = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
            model, words = toxicity.fit_toxicity(docs, spark.createDataFrame(learn, labels.schema)), toxicity.Words()
            want = {i for i, r in before.items() if model is None or model.score(*words(r.text)) < 0.7}
            assert {r.doc_id for r in got} == want and len(got) == len(want) and all(r == before[r.doc_id] for r in got)
        elif name == "near_dedup":
            parts = brute_components([(i, r.text) for i, r in before.items()], 5)
            assert {r.doc_id for r in got} == {i for i, (_, c) in parts.items() if c == i} and all(r == before[r.doc_id] for r in got)
        else:
            copies, _ = plain_mix(triple(docs))
            found = {}
            for r in got:
                found[(r.doc_id, r.text, r.source)] = found.get((r.doc_id, r.text, r.source), 0) + 1
            assert found == copies
        docs = after
    packed = STAGES["packing"](spark, docs, SF).toPandas()
    plain = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = np.array(ids[start : start + packing.CAPACITY], "<u4")
            want.append((r.doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted(zip(packed.doc_id, packed.piece, packed.start, packed.length, packed.ids_crc32)) == sorted(want)
    sums = packed.groupby("sequence_id").length.sum()
    assert sums.max() <= packing.CAPACITY and len(sums) <= sum(w[3] for w in want) / packing.CAPACITY + 2
    whole = corpus_pipeline.run(spark, SF).groupBy().agg(F.count("doc_id"), F.sum("length")).first()
    assert tuple(whole) == (len(want), sum(w[3] for w in want))


def test_stages_on_odd_rows(spark, fixture):
    odd = lambda df: sorted(map(str, df.collect()))
    kept = STAGES["toxicity"](spark, fixture, SF)
    assert kept.columns == fixture.columns and odd(kept) == odd(fixture)  # its ids have no labels here, nothing is toxic
    once = STAGES["near_dedup"](spark, fixture, SF)
    parts = brute_components([(r.doc_id, r.text) for r in fixture.collect() if r.doc_id is not None], 5)
    assert once.columns == fixture.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in once.collect()) == sorted([i for i, (_, c) in parts.items() if c == i] + [-1, -1])
    mixed = STAGES["mixture"](spark, fixture, SF)
    assert mixed.columns == fixture.columns
    copies, targets = plain_mix(triple(fixture))
    found, words = {}, {}
    for r in mixed.collect():
        found[(r.doc_id, r.text, r.source)] = found.get((r.doc_id, r.text, r.source), 0) + 1
        words[r.source] = words.get(r.source, 0) + words_of(r.text)
    assert found == copies
    largest = {s: max([words_of(t) for _, t, q in triple(fixture) if q == s]) for s in targets}
    assert all(abs(words.get(s, 0) - t) <= max(1, largest[s] / 2) for s, (t, _) in targets.items())
    packed = STAGES["packing"](spark, fixture, SF)
    assert packed.agg(F.count_distinct("doc_id")).first()[0] == 65 and packed.where("piece = 0").count() == fixture.count()


def test_stages_on_an_empty_table(spark, fixture):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, fixture.limit(0), SF).count() == 0, name


def test_mixed_texts_are_whole(spark):
    rows = [(i, f"a{i}\nb  c " + "w\n" * (i * 37 % 90), f"s{i % 3}") for i in range(90)] + [(100, "long  text\n" * 3000, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {i: t for i, t, _ in rows}
    plan = mixture.mix_documents(docs)
    assert plan.where("part > 0 and part < size").count() > 0
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert all(texts[r.doc_id] == r.text for r in mixed.collect())
    got = dict(mixed.groupBy("source").agg(F.sum(mixture.word_count(F.col("text")))).collect())
    for source, want, high in plan.groupBy("source").agg(F.sum("taken"), F.max("size")).collect():
        assert abs(got[source] - want) <= (high / 2 if source == "s2" else 1)
    most = plan.select(F.max(F.ceil(F.col("target") / F.col("source_size")))).first()[0]
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= most


def test_every_operator_is_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
