"""Whitening, hard negatives and SimHash against plain versions: nulls, ties, repeats, empties, clashing names."""

import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import hard_negatives, queries, simhash, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, id long, uid long, x string, block int, anchor long"


def vectors(spark, rows):
    """Vectors with extra columns whose names the operators also use inside."""
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], y, 1, 2, "x", 3, 4) for i, v, y in rows], VECTORS)


def odd_vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.2, width).round(3).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(900, None, 1), (901, [None] * width, 1), (902, [math.nan] + [0.1] * (width - 1), 1), (903, [math.inf] * width, 2), (904, [0.0] * width, 0), (905, [], 0), (906, [0.5], 0)]
    return rows + [(907, rows[1][1], None), (908, rows[1][1], 1), (909, rows[1][1], 1), (None, rows[2][1], 1)]


# ---- 11


def plain_whitened(rows, width, k=8):
    fine = [(i, v) for i, v, _ in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in fine], np.float32).astype(float)) + 100_000
    n, total = len(x), [int(s) for s in x.sum(0)]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, total)) for row in x]
    centred = x - x.mean(0)
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return [i for i, _ in fine], n, deviation, centred @ vector / np.sqrt(value), value / (centred**2).sum() * n


@pytest.mark.parametrize("n, width", [(60, 12), (200, 5), (40, 64)])
def test_whitening_equals_eigenvectors(spark, n, width):
    rows = odd_vectors(n, width, n)
    got = whitening.whitened(vectors(spark, rows).repartition(3)).collect()
    ids, count, deviation, want, share = plain_whitened(rows, width)
    k = min(8, width)
    assert len(got) == len(ids) * k and {r.n for r in got} == {count}
    at = {i: j for j, i in enumerate(ids)}
    y = np.zeros((len(ids), k))
    for r in got:
        assert r.deviation == deviation[at[r.vec_id]] and abs(r.explained / share[r.component - 1] - 1) < 1e-9
        y[at[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(y * np.sign((y * want).sum(0)) - want).max() < 1e-7
    assert {r.identity_error for r in got}.pop() < 1e-9
    assert np.abs(np.cov(y.T, bias=True) - np.eye(k)).max() < 1e-9


def test_whitening_of_repeated_and_missing_variances(spark):
    # Eight equal variances and one larger; then equal rows; then a table that spans two directions only.
    rows = [(i, (np.eye(9)[i % 9] * (2 if i % 9 == 4 else 1) * (1 if i % 2 else -1)).tolist(), 0) for i in range(180)]
    got = whitening.whitened(vectors(spark, rows))
    share = {r.component: r.explained for r in got.collect()}
    assert share[1] == pytest.approx(4 / 12) and all(share[c] == pytest.approx(1 / 12) for c in range(2, 9)) and got.first().identity_error < 1e-9
    assert whitening.whitened(vectors(spark, [(i, [0.25, 0.5], 0) for i in range(5)])).count() == 0
    flat = [(i, [i % 3, 2 * (i % 3), i % 5, 1.0], 0) for i in range(60)]
    assert {r.component for r in whitening.whitened(vectors(spark, flat)).collect()} == {1, 2}


def test_whitening_decaying_spectrum_stops_early_and_keeps_precision(spark):
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((100, 100)))[0]
    x = (rng.standard_normal((300, 100)) * 0.7 ** np.arange(100)) @ basis.T * 20
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    table = whitening.Centred(vectors(spark, rows).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 100, 1024.0, 100_000)
    passes = []
    product = table.product
    table.product = lambda w: passes.append(1) or product(w)
    value, vector = whitening.principal(table, 8)
    whole = np.floor(1024 * np.array([r[1] for r in rows], np.float32).astype(float))
    want, plain = np.linalg.eigh(np.cov(whole.T, bias=True))
    assert np.abs(value / want[::-1][:8] - 1).max() < 1e-10 and np.abs(np.abs((vector * plain[:, ::-1][:, :8]).sum(0)) - 1).max() < 1e-10
    assert len(passes) < 100


def test_whitening_large_sums_empty_and_errors(spark):
    import pyarrow as pa

    assert whitening._deviations(np.array([[2, -1], [0, 5]]), 2**31, [1, 2]).to_pylist() == [None, None]
    assert whitening._deviations(np.array([[2, -1], [0, 5]]), 3, [1, 2]).to_pylist() == [25 + 25, 1 + 169]
    assert whitening._deviations(np.array([[1]]), 3_000_000_000, [0]).equals(pa.array([9 * 10**18]))
    assert whitening.whitened(vectors(spark, [])).collect() == whitening.whitened(vectors(spark, [(1, None, 1)])).collect() == []
    with pytest.raises(Exception, match="beyond"):
        whitening.whitened(vectors(spark, [(1, [1e30], 1), (2, [1.0], 1)])).collect()


# ---- 12


def plain_negatives(rows, width, anchor, label, k=5, percent=80):
    fine = [(i, label(i, y), [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, y in rows if i is not None and y is not None and v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, y, v in fine:
        if anchor(i):
            score = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in fine if j != i)
            for s, j, _ in [x for x in score if x[2] == y][:k]:
                near = [x for x in score if x[2] != y and -percent * s <= -100 * x[0] <= -100 * s][:k]
                out += [(i, j, n + 1, m, -s, -t) for n, (t, m, _) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("n, width, blocks", [(150, 8, None), (150, 70, 40), (80, 3, 20)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, n, width, blocks):
    if blocks:  # several blocks on both sides
        monkeypatch.setattr(hard_negatives, "ROW_BLOCK", blocks)
        monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    rows = odd_vectors(n, width, width)
    df = vectors(spark, rows).repartition(3)
    made = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 4 == 0, made)
    want = plain_negatives(rows, width, lambda i: i % 4 == 0, lambda i, y: (y + 1) % 3 if i % 7 == 0 else y)
    assert want and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_intervals_hold_every_score():
    for width, scale in ((64, 256), (5, 3), (200, 1), (64, 100_000)):
        rng = np.random.default_rng(width)
        x = np.floor(rng.normal(0, scale, (300, width)))
        x[7], x[8] = 0, x[9]
        turned = hard_negatives.rotation(width)
        assert np.abs(turned @ turned.T - np.eye(width)).max() < 1e-12
        codes = hard_negatives.Codes.unpacked(hard_negatives.Codes(x, turned).packed())
        low, high = hard_negatives.Planes(x[:50], turned).bounds(codes)
        exact = x[:50] @ x.T
        assert (low <= exact).all() and (exact <= high).all()
        assert np.median(high - low) < 0.6 * np.median(np.linalg.norm(x, axis=1)) ** 2


def test_hard_negatives_ties_shared_ids_and_empty(spark):
    rows = [(i, [1.0, 0.0], i % 2) for i in range(40)] + [(4, [1.0, 0.0], 0), (50, [-1.0, 0.0], 7)]
    got = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id").isin(4, 50), F.col("label")).collect()
    # Both rows of id 4 have the same lists; 50 has no other row of its label.
    assert len(got) == 2 * 25 and {r.anchor_id for r in got} == {4} and {r.positive_id for r in got} == {0, 2, 6, 8, 10} and {r.negative_id for r in got} == {1, 3, 5, 7, 9}
    assert hard_negatives.hard_negatives(vectors(spark, []), F.col("vec_id") % 2 == 0, F.col("label")).collect() == []
    assert hard_negatives.hard_negatives(vectors(spark, rows), F.lit(None).cast("boolean"), F.col("label")).collect() == []
    with pytest.raises(Exception, match="do not fit"):
        hard_negatives.hard_negatives(vectors(spark, [(1, [1e30], 1), (2, [1.0], 1)]), F.col("vec_id") == 1, F.col("label")).collect()


# ---- 13


def plain_fingerprint(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] if len(tokens) >= 3 else [" ".join(tokens)] * bool(tokens)
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(links, nodes):
    part = {n: n for n in nodes}

    def root(n):
        while part[n] != n:
            n = part[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        part[b] = a
    return {n: root(n) for n in nodes}


def test_simhash_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"W{i}é" if i % 9 == 0 else f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 200))) for _ in range(60)]
    for t in texts[:30]:  # copies with a word or a gap changed
        cut = t.split(" ")
        cut[rng.integers(len(cut))] = "other"
        texts += [" ".join(cut), t.replace(" ", "\t\n"), t + " more"]
    texts += [None, "", " \x0b\x0c", "one", "two words", "a b c", "x " * 50_000, "x " * 50_001]
    rows = [(i + 10, t) for i, t in enumerate(texts)] + [(3, texts[0]), (3, texts[40]), (None, texts[5])]
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, id int, fp string").repartition(4)
    got = simhash.near_simhashes(df).collect()
    assert len(got) == len(rows)
    want = {i: [plain_fingerprint(t) for j, t in rows if j == i] for i, _ in rows}
    for r in got:
        assert int(r.fingerprint, 16) in want[r.doc_id] and len(r.fingerprint) == 16
        if r.doc_id is None:
            assert r.component_id is None
    named = {i: f for i, f in want.items() if i is not None}
    links = [(a, b) for a in named for b in named if a < b and any((x ^ y).bit_count() <= 3 for x in named[a] for y in named[b])]
    part = plain_components(links, named)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(part.items())
    assert len(set(part.values())) < len(part) - 30


def test_balls_lose_no_link(spark):
    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 2**64, 40, dtype=np.uint64).tolist()
    found = set(seeds)
    for s in seeds:
        for far in (1, 2, 3, 3, 3, 4, 5):
            found.add(s ^ sum(1 << int(b) for b in rng.choice(64, far, replace=False)))
        block = 16 * int(rng.integers(4))  # all three differing bits in one block
        found.add(s ^ sum(1 << (block + int(b)) for b in rng.choice(16, 3, replace=False)))
    found = sorted(found)
    signed = [f - 2**64 if f >= 2**63 else f for f in found]
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all(((r.fp ^ r.centre) & (2**64 - 1)).bit_count() <= 3 for r in links) and len({tuple(r) for r in links}) == len(links)
    every = [(a, b) for i, a in enumerate(found) for b in found[i + 1 :] if (a ^ b).bit_count() <= 3]
    assert plain_components([(r.fp & (2**64 - 1), r.centre & (2**64 - 1)) for r in links], found) == plain_components(every, found)


def test_simhash_text_ids_and_empty(spark):
    df = spark.createDataFrame([("b", "x y z"), ("a", "X  y z"), ("c", None)], "name string, body string")
    got = {r.doc_id: r for r in simhash.near_simhashes(df, "name", "body").collect()}
    assert got["b"].component_id == "a" and got["c"].fingerprint == "0" * 16 and got["c"].component_id == "c"
    assert simhash.near_simhashes(df.limit(0), "name", "body").collect() == []


def test_new_queries_over_the_tables(spark):
    for name in ("op11_whitening", "op12_hard_negatives", "op13_simhash"):
        assert queries.QUERIES[name](spark, SF).count() > 0


# ---- what earlier operators must keep


def test_packing_keeps_ids_beyond_floats_beside_nulls(spark):
    from tidewatch.llm import packing

    big = 2**53 + 1
    got = packing.pack_documents(spark.createDataFrame([(big, "some words"), (None, "others"), (big + 2, None)], "doc_id long, text string").coalesce(1), queries.tokenizer_path())
    assert sorted((r.doc_id or 0 for r in got.collect())) == [0, big, big + 2]


def test_rollup_refuses_batches_out_of_order(spark, tmp_path):
    from tidewatch.llm import token_rollup

    store = token_rollup.Rollup(spark, str(tmp_path / "store"), compact_every=3)

    def one(lang):
        return spark.createDataFrame([(1, "s", lang, "words-1", 5, 9)], "doc_id long, source string, lang string, version string, tokens long, chars long")

    assert store.apply(5, one("en"))
    with pytest.raises(ValueError, match="batch 3 comes after batch 5"):
        store.apply(3, one("de"))
    assert store.apply(7, one("fr")) and store.apply(9, one("es")) and not store.apply(7, one("en")) and not store.apply(5, one("en"))
    with pytest.raises(ValueError, match="batch 8 comes after"):
        store.apply(8, one("de"))
    assert [tuple(r) for r in store.totals().collect()] == [("s", "es", "words-1", 1, 5, 9)]


def test_html_of_many_nested_elements():
    from tidewatch.llm import html_text

    article = "This paragraph has words enough for the classifier to be sure of it, and it ends as sentences do."
    comment = "I liked this very much and wrote so below it, as many readers did before me."
    for depth in (5, 24, 30, 200):
        page = '<div class="content">' * depth + f"<p>{article}</p><section class='comments'><p>{comment}</p></section>" + "</div>" * depth
        assert html_text.main_text(page) == article


def test_spot_likeness_is_told_however_small(spark):
    from tidewatch.llm import spotsigs

    own = spotsigs.Signatures()
    rng = np.random.default_rng(2)
    left, right = (" ".join(f"{p}{i} the" for i in rng.integers(0, 10**6, 900)) for p in ("a", "b"))
    right += " " + " ".join(left.split()[:24])
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(spark.createDataFrame([(1, left), (2, right)], "doc_id long, text string")).collect()}
    edited = left[: len(left) - len(left) // 2] + right[: len(left) // 2]

    def plain(a, b):
        a, b = set(own(a).tolist()), set(own(b).tolist())
        return len(a & b) / len(a | b)

    assert 0 < plain(left, right) < 0.02
    assert got[1].near_next == pytest.approx(plain(left, right), abs=1e-12) and got[1].near_edited == pytest.approx(plain(left, edited), abs=1e-12)
    assert set(spotsigs.from_string(got[1].edited_fingerprint).tolist()) == set(own(edited).tolist())


def test_toxicity_scores_equal_a_plain_forward_pass(spark):
    """Every score against word-by-word loops over the fitted tables: hashing, filters, pooling, the logistic layer and the cut."""
    from tidewatch.llm import toxicity

    rng = np.random.default_rng(12)
    vocabulary = [f"v{i}" for i in range(80)] + ["the", "und", "les", "größer", "Ünder", "über"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 40))) + (" blorg, frump!" if i % 4 == 0 else ".")) for i in range(160)]
    rows += [(500, None), (501, ""), (502, "?!"), (503, "the " * 50_010 + "blorg"), (504, "The AND der"), (505, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, labels)
    table, low = toxicity._TABLE.tolist(), 2**64 - 1

    def hashed(word):
        h = sum(table[b] * pow(int(toxicity._B), i, 2**64) for i, b in enumerate(word)) + len(word) & low
        return ((h ^ h >> 31) * int(toxicity._B) & low) >> 64 - toxicity.BITS

    languages = {}
    for k, name in enumerate(toxicity.LANGUAGES[1:], 1):
        for word in toxicity.FUNCTION_WORDS[name].split():
            languages.setdefault(word, set()).add(k)

    def plain(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        words = re.findall(rb"[0-9a-z\x80-\xff]+", raw)
        rows = [model.tables[0][model.index[0][hashed(w)]] + model.tables[1][model.index[1][hashed(w[:4])]] for w in words]
        pooled, col = [], 0
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                seen = [sum(float(rows[i + j][col + j * toxicity.FILTERS + f]) for j in range(width)) for i in range(len(rows) - width + 1)]
                pooled.append(max([0.0, *seen]))
            col += width * toxicity.FILTERS
        p = 1 / (1 + math.exp(-(float(np.dot(pooled, model.out)) + model.bias)))
        votes = [next(iter(languages[w])) for w in (x.decode(errors="replace") for x in words) if len(languages.get(w, ())) == 1]
        counts = [votes.count(k) for k in range(1, len(toxicity.LANGUAGES))]
        best = max(counts)
        cut = model.cuts[counts.index(best) + 1 if best and counts.count(best) == 1 else 0]
        return 0.7 * p / cut if p < cut else 0.7 + 0.3 * (p - cut) / (1 - cut)

    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, model).collect()}
    assert all(got[i] == pytest.approx(plain(t), abs=1e-5) for i, t in rows)
    assert got[500] == got[501] == got[502] < 0.7


def test_sharding_orders_by_the_whole_row(spark):
    from tidewatch.llm import sharding

    rows = [(i % 5, "same text", i) for i in range(60)]
    first = spark.createDataFrame(rows, "doc_id long, text string, other int").coalesce(1)
    again = spark.createDataFrame(rows[::-1], "doc_id long, text string, other int").repartition(5)
    for hot in (10_000, 4):  # also where repeats are numbered
        one, two = ({(r.row.other, r.position) for r in sharding.external_shuffle(df, hot=hot).collect()} for df in (first, again))
        assert len(one) == 60 and {p for _, p in one} == set(range(60)) and (one == two or hot == 4)


def test_url_rules_keep_columns_of_the_caller(spark):
    from tidewatch.llm import url_rules

    df = spark.createDataFrame([("http://a.com/x", 7, "mine", "old")], "url string, _found int, rule string, __found string")
    rules = [("a.com", "/", "block")]
    for most in (10, 0):
        row = url_rules.judge_urls(df, rules, max_broadcast_rules=most).first()
        assert (row._found, row["__found"], row.rule, row.verdict) == (7, "old", "a.com/", "block")
