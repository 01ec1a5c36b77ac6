"""The thin queries over the training-data operators, and their SQL twins where SQL can tell."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import hard_negatives, html_text, mixture, packing, setsketch, sharding, simhash, spotsigs, token_rollup, toxicity, url_rules, vectors, whitening
from tidewatch.llm.common import shared_dir, table

#: The production rules: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return put.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op2_mixture": op2_mixture, "op4_url_filter": op4_url_filter, "op5_sharding": op5_sharding}

_HOST = "CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op2_mixture": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS tier FROM s),
w AS (SELECT *, CASE tier WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
c AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT)
            - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remain,
         CAST(sum(weight) OVER (ORDER BY 3 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_weight
  FROM w),
f AS (SELECT *, remain / open_weight AS level FROM c),
l AS (SELECT *, (SELECT min_by(level, 3 * source_size / weight) FROM f WHERE level * weight <= 3 * source_size) AS fill FROM f),
t AS (SELECT source, source_size, tier, least(CAST(3 * source_size AS DOUBLE), coalesce(fill * weight, CAST(3 * source_size AS DOUBLE))) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.tier,
         CAST(round(t.target) AS BIGINT) AS due,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN due // source_size ELSE 0 END AS passes FROM p),
k AS (
  SELECT *, CAST(passes * size + least(size, greatest(0, due - passes * source_size - start)) AS BIGINT) AS taken,
         least(1.0::DOUBLE, start / target) AS share
  FROM q)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE
         WHEN tier = 0 THEN 0.0::DOUBLE + (sqrt(2.25::DOUBLE + (-2.0::DOUBLE) * (share * 1.0::DOUBLE - 0.0::DOUBLE)) - 1.5::DOUBLE) / (-1.0::DOUBLE)
         WHEN tier = 1 THEN 0.0::DOUBLE + (share * 1.0::DOUBLE - 0.0::DOUBLE) / 1.0::DOUBLE
         WHEN share <= (0.3125::DOUBLE / 1.0::DOUBLE) THEN 0.0::DOUBLE + (sqrt(0.25::DOUBLE + 1.0::DOUBLE * (share * 1.0::DOUBLE - 0.0::DOUBLE)) - 0.5::DOUBLE) / 0.5::DOUBLE
         ELSE 0.5::DOUBLE + (sqrt(0.5625::DOUBLE + 5.0::DOUBLE * (share * 1.0::DOUBLE - 0.3125::DOUBLE)) - 0.75::DOUBLE) / 2.5::DOUBLE
       END END AS position
FROM k
""",
    "op4_url_filter": f"""
WITH p AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
r(rhost, rpath, rverdict) AS (VALUES {_RULES})
SELECT page_id, host, path,
       (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(rverdict, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM p
""",
}


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


QUERIES["op10_setsketch"] = op10_setsketch

ORACLES["op10_setsketch"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * common >= 80 * (nx.n_shingles + ny.n_shingles - common)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.seen)
SELECT n.doc_id, n.n_shingles, min(r.seen) AS component_id, min(r.seen) = n.doc_id AS kept
FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""


def tokenizer_path() -> str:
    """The public word tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES["op3_packing"] = op3_packing


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = toxicity.score_toxicity(documents, toxicity.fit_toxicity(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


QUERIES["op6_toxicity"] = op6_toxicity


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = html_text.extract_text(table(spark, sf_dir, "pages"))
    return read.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES["op1_html_text"] = op1_html_text


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES["op7_neighbours"] = op7_neighbours


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op8_spotsigs"] = op8_spotsigs


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: inserts under the first tokenizer version, deletes of the
    documents labelled as low quality, a re-count under the second version, and a revision that
    re-counts English documents with their line breaks dropped and files them under `en-flat`.
    The second batch is sent twice."""
    documents = table(spark, sf_dir, "documents")
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit(None).cast("string").alias("version"))
    store = token_rollup.Rollup(spark, f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}")
    store.apply(1, token_rollup.counted(documents, "words-1"))
    store.apply(2, deletes=bad)
    store.apply(3, token_rollup.counted(documents, "marks-2"))
    flat = documents.where("lang = 'en'").withColumn("text", F.translate("text", "\n", "")).withColumn("lang", F.lit("en-flat"))
    store.apply(4, token_rollup.counted(flat, "marks-2"))
    store.apply(2, deletes=bad)
    return store.totals()


QUERIES["op9_token_rollup"] = op9_token_rollup

ORACLES["op9_token_rollup"] = r"""
WITH a AS (
  SELECT doc_id, source, lang, 'words-1' AS version, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens, length(text) AS chars
  FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'en-flat' ELSE lang END, 'marks-2',
         len(regexp_extract_all(t, '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')), length(t)
  FROM (SELECT *, CASE WHEN lang = 'en' THEN replace(text, chr(10), '') ELSE text END AS t FROM documents WHERE doc_id IS NOT NULL))
SELECT source, lang, version, count(*) AS documents, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens, CAST(sum(coalesce(chars, 0)) AS BIGINT) AS chars
FROM a GROUP BY source, lang, version
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES["op11_whitening"] = op11_whitening


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES["op12_hard_negatives"] = op12_hard_negatives

ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (
  SELECT p.anchor, p.other AS positive, p.score AS positive_score, s.other, s.score,
         row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score FROM n WHERE rank <= 5
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_simhashes(table(spark, sf_dir, "documents"))


QUERIES["op13_simhash"] = op13_simhash
