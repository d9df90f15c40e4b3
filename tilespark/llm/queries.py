"""One query for each operator, over its whole tables, and the SQL of those that have it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import chat, decontaminate, edit_embedding, hard_negatives, license_scan, mixing, packing, pii, prefix_trie, quality, simhash, token_rollup, toxicity
from tilespark.llm.common import discard, settle, shared_dir, table

#: Documents of fewer words go in the last batch of the rollup.
SHORT = 20


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprints, and the smallest id among the documents that banded and verified links lead to."""
    return edit_embedding.linked_texts(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents counted by two tokenizers; then one is revised to its next version, and short documents go.

    Every batch is committed twice; the second time must change nothing. The batches are
    compacted before the deletes, which then come on top of the compacted totals.
    """
    docs = table(spark, sf_dir, "documents")
    versions = list(token_rollup.TOKENIZERS)
    counted = settle(docs.select("source", "lang", *[token_rollup.token_count(F.col("text"), v).alias(f"n{i}") for i, v in enumerate(versions)]))
    counts = {v: F.col(f"n{i}") for i, v in enumerate(versions)}
    rollup = token_rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")

    def inserts(version: str) -> DataFrame:
        return counted.select(F.lit("insert").alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), counts[version].alias("tokens"), *_no_old())

    revisions = counted.select(
        F.lit("revise").alias("op"), "source", "lang", F.lit("words@2").alias("tokenizer"), counts["words@2"].alias("tokens"),
        F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit("words@1").alias("old_tokenizer"), counts["words@1"].alias("old_tokens"),
    )
    short = counted.where(counts["words@2"] < SHORT)
    deletes = [short.select(F.lit("delete").alias("op"), "source", "lang", F.lit(v).alias("tokenizer"), counts[v].alias("tokens"), *_no_old()) for v in ("words@2", "pieces@1")]
    for batch, changes in (("load words", inserts("words@1")), ("load pieces", inserts("pieces@1")), ("words to version 2", revisions), ("short documents", deletes[0].unionAll(deletes[1]))):
        if batch == "short documents":
            rollup.compact()
        rollup.commit(batch, changes)
        rollup.commit(batch, changes)
    discard(counted)
    return rollup.totals()


def _no_old() -> list:
    return [F.lit(None).cast(t).alias(f"old_{c}") for c, t in (("source", "string"), ("lang", "string"), ("tokenizer", "string"), ("tokens", "long"))]


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, counts=True)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.formatted(rows.unionByName(probe)))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(vectors, F.col("vec_id"), F.col("embedding"), label)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.branched(prefix_trie.turn_arrays(table(spark, sf_dir, "conversations"))))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(packing.tokenised(table(spark, sf_dir, "documents"), vocabulary))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_source_mixing, op2_edit_fingerprints, op3_simhash_near_dedup, op4_token_rollup, op5_toxicity, op6_quality,
        op7_license_scan, op8_pii_pseudonyms, op9_decontamination, op10_chat_windows, op11_hard_negatives, op12_prefix_trie,
        op13_best_fit_packing, pipeline,
    ]
    return {q.__name__: q for q in named}


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = r"""
WITH n AS (
  SELECT source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words1,
         len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+|[^\x00-\x7F]+')) AS words2,
         len(regexp_extract_all(coalesce(text, ''), '[0-9]|[A-Za-z]+|[^\x00-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) AS pieces1
  FROM documents)
SELECT source, lang, 'words@1' AS tokenizer, CAST(0 AS BIGINT) AS docs, CAST(0 AS BIGINT) AS tokens FROM n GROUP BY source, lang
UNION ALL
SELECT source, lang, 'words@2', CAST(count_if(words2 >= 20) AS BIGINT), CAST(sum(CASE WHEN words2 >= 20 THEN words2 ELSE 0 END) AS BIGINT) FROM n GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces@1', CAST(count_if(words2 >= 20) AS BIGINT), CAST(sum(CASE WHEN words2 >= 20 THEN pieces1 ELSE 0 END) AS BIGINT) FROM n GROUP BY source, lang
"""

OP9_SQL = f"""
WITH item AS (
  SELECT item_id, regexp_extract_all({_SMALL}, '{_WORDS}') AS w FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_SMALL}, '{_WORDS}') AS w FROM documents),
doc_window AS (
  SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS run
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM item_window) WHERE len(w) >= size)),
hit AS (
  SELECT r, i, size, item_id FROM doc_window JOIN item_window USING (size, run)),
places AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
positive AS (
  SELECT * FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) <= 5),
negative AS (
  SELECT p.anchor, p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank
  FROM positive p JOIN pair n ON p.anchor = n.anchor AND NOT n.same
   AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 10
"""

#: Unsigned crc32 of an id's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(c) + 1), lambda i: CAST(ascii(c[i]) AS BIGINT))),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP12_SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (
  SELECT conv_id, turns, CAST({_CRC} % 6 AS BIGINT) AS h FROM (SELECT *, CAST(conv_id AS VARCHAR) AS c FROM own)),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM cut a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
member AS (
  SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
node AS (
  SELECT turns[1:depth] AS path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM member GROUP BY path),
named AS (
  SELECT *, row_number() OVER () AS k, CASE WHEN depth > 0 THEN (n_convs - 1) * length(path[depth].text) ELSE 0 END AS saved FROM node),
child AS (
  SELECT b.k, p.k AS above, p.conv_id AS parent_conv_id FROM named b JOIN named p ON b.depth = p.depth + 1 AND b.path[1:p.depth] = p.path),
kids AS (SELECT above, count(*) AS n FROM child GROUP BY above),
under AS (
  SELECT top.k, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum(low.saved) AS saved_tokens
  FROM named low JOIN named top ON top.depth <= low.depth AND low.path[1:top.depth] = top.path LEFT JOIN kids ON kids.above = low.k GROUP BY top.k)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM named LEFT JOIN child USING (k) LEFT JOIN kids ON kids.above = named.k JOIN under USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_token_rollup": OP4_SQL, "op9_decontamination": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_prefix_trie": OP12_SQL}
