"""The registered queries of this subpackage, thin views of its operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarium.llm import hard_negatives, licenses, merkle, packing, quality_fm, quality_rules, secret_scan, simhash, spm, substrings, toxicity, voronoi, warc
from tessarium.llm.common import read
from tessarium.llm.training import fold

#: Score from which a row counts as label 1.
CUT = 0.7


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut(read(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("_m")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules.judged(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(m[n].alias(n) for n in names), F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(read(spark, sf_dir, "pages"))).drop("url", "payload")


def op8_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _labelled(spark: SparkSession, sf_dir: str, scored: Callable, modulus: int, held: int) -> DataFrame:
    found = scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold(modulus) != held)
    return found.select("doc_id", (fold(modulus) == held).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir, toxicity.scored, 3, 1)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir, quality_fm.scored, 4, 2)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(read(spark, sf_dir, "documents"), F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", relabelled), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_substring_dedup, op3_secret_scan, op4_simhash, op5_quality_rules, op6_packing, op7_warc, op8_voronoi_knn, op9_toxicity, op10_quality, op11_merkle, op12_licenses, op13_hard_negatives, pipeline)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)


def _field(value: str) -> str:
    """A field of a leaf: its length in bytes and itself."""
    return f"coalesce(strlen({value}) || ':' || ({value}), '-')"


#: CRC-32 of doc_id's digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: [ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))))"""
_FIELDS = " || ".join(_field(f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars"))

SQL: dict[str, str] = {
    "op2_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
keyed AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k FROM win),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM keyed) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + i AS word_at FROM again, (SELECT unnest(range(0, 20)) AS i)),
lists AS (SELECT doc_id, list(word_at) AS ats FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, d.w, l.ats, CASE WHEN l.ats IS NULL THEN d.w ELSE list_transform(list_filter(list_zip(d.w, range(1, len(d.w) + 1)), lambda x: NOT list_contains(l.ats, x[2])), lambda x: x[1]) END AS k
         FROM d LEFT JOIN lists l USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ats), 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept""",
    "op5_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM d WHERE len(w) >= 5),
keyed AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p + 4], ' ')) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT p + i) AS n_repeat_words FROM keyed, (SELECT unnest(range(0, 5)) AS i) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
             len(list_intersect(list_distinct(w), [{_STOP}])) AS stop_words FROM d LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 10 AND n_repeat_words / n <= 0.2 AND word_chars / n BETWEEN 2.0 AND 15.0 AND n_symbols / n <= 0.1
       AND n_dup_lines / greatest(n_lines, 1) <= 0.3 AND (n_words < 50 OR stop_words >= 2) AS kept FROM v""",
    "op8_voronoi_knn": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5""",
    "op11_merkle": f"""
WITH RECURSIVE docs AS (SELECT *, {_FIELDS} AS head, {_CRC} % 2 = 0 AS hit FROM documents),
leaves AS (SELECT doc_id, source, sha256(head || {_field("text")}) AS leaf, sha256(head || {_field("CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END")}) AS other FROM docs),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
up AS (SELECT tree, 0 AS level, i, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM placed
       UNION ALL
       SELECT tree, level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, level, i // 3),
tops AS (SELECT 0 AS tree, 0 AS level, tree - 1 AS i, d, (SELECT count(DISTINCT tree) FROM placed) AS n FROM up WHERE n = 1
         UNION ALL
         SELECT tree, level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY tree, level, i // 3),
nodes AS (SELECT * FROM up UNION ALL SELECT * FROM tops),
runs AS (SELECT tree, level, i // 3 AS p, list(d ORDER BY i) AS ds FROM nodes WHERE n > 1 GROUP BY ALL),
roots AS (SELECT tree, d, level FROM nodes WHERE n = 1),
walk AS (SELECT doc_id, leaf, tree AS own, tree, 0 AS level, i, other AS folded, '' AS proof FROM placed
         UNION ALL
         SELECT w.doc_id, w.leaf, w.own, CASE WHEN r.ds IS NULL THEN 0 ELSE w.tree END, CASE WHEN r.ds IS NULL THEN 0 ELSE w.level + 1 END, CASE WHEN r.ds IS NULL THEN w.own - 1 ELSE w.i // 3 END,
                CASE WHEN r.ds IS NULL THEN w.folded ELSE sha256(array_to_string(r.ds[:w.i % 3] || [w.folded] || r.ds[w.i % 3 + 2:], '')) END,
                w.proof || CASE WHEN r.ds IS NULL THEN '' ELSE array_to_string(r.ds[:w.i % 3] || r.ds[w.i % 3 + 2:], '') END
         FROM walk w LEFT JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.p = w.i // 3 WHERE w.tree > 0 OR r.ds IS NOT NULL)
SELECT w.doc_id, w.leaf, s.d AS subroot, t.d AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = t.d AS verified
FROM walk w JOIN roots s ON s.tree = w.own JOIN roots t ON t.tree = 0 AND w.tree = 0 AND w.level = t.level""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
