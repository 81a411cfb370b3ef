"""The driver's tables as a page collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dates are counted from here, so that results don't depend on the day of the run.
NOW = "2024-06-30 12:00:00"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as pages: type by language, status by labels, a date by doc_id."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    kind = F.when(F.col("lang") == "en", "concept").when(F.col("lang") == "fr", "entity").when(F.col("lang") == "de", "source").otherwise("index")
    status = F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 0, "stub").otherwise("active")
    modified = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 400) * 43200)
    return docs.select(F.col("doc_id").alias("page_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), kind.alias("type"), status.alias("status"), modified.alias("modified"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(90).alias("dormant_window"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source")).alias("source"))


PAGES = """pages_ AS (SELECT doc_id AS page_id, string_split(text, chr(10))[1] AS title,
 CASE lang WHEN 'en' THEN 'concept' WHEN 'fr' THEN 'entity' WHEN 'de' THEN 'source' ELSE 'index' END AS type,
 CASE WHEN toxic = 1 THEN 'deprecated' WHEN quality = 0 THEN 'stub' ELSE 'active' END AS status,
 1704067200 + (doc_id % 400) * 43200 AS m, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 90 END AS dormant_window, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS source
 FROM documents LEFT JOIN labels USING (doc_id))"""
NOW_SECONDS = 1719748800


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and their suppliers as links between documents' ids: src is a part, dst a supplier's multiple."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 7).alias("dst")).where("src <> dst").distinct()


EDGES = "edges_ AS (SELECT DISTINCT l_partkey AS src, l_suppkey * 7 AS dst FROM lineitem WHERE l_partkey <> l_suppkey * 7)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with tokens from their properties and value as cost."""
    found = read(spark, sf_dir, "events")
    return found.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("cost"))


EVENTS = "events_ AS (SELECT event_id, ts, user_id, event_type, json_extract_string(props, '$.k')::BIGINT AS tokens, value AS cost FROM events)"


#: A collection made of part names: up to eight spellings of each name for every 2,048 parts, whose number is part of the name from the second on, with links,
#: code, aliases and states. The text is SQL of both engines.
_WIKI = """SELECT k, base, variant, type, dir, dir || '/' || slug AS page_id, slug, replace(slug, '-', ' ') AS title,
 CASE WHEN k % 11 = 0 THEN 'deprecated' WHEN k % 13 = 1 THEN 'stub' WHEN k % 17 = 2 THEN 'dormant' WHEN k % 19 = 3 THEN 'archived' ELSE 'active' END AS status,
 1704067200 + (k % 400) * 43200 AS m, 1600000000 + (k * 7919 % 50) * 86400 AS c, CASE WHEN k % 3 = 0 THEN 0 ELSE 90 END AS dormant_window,
 k % 5 = 0 AS human_edited, k % 4 AS source_count, k % 23 = 0 AS promoted, CASE WHEN k % 9 < 3 THEN k % 9 ELSE 0 END AS n_contradictions,
 CASE WHEN k % 7 = 0 THEN '' ELSE 'About the ' || base || ', which has|bars' || chr(10) || 'and a second line' END AS summary, upper(base) AS alias1, base || ' no ' || k AS alias2,
 CASE WHEN variant <> 7 THEN (ascii(substr(base, 1, 1)) * 7 + length(base) * 31) % 100 END AS vec_id,
 '# ' || replace(slug, '-', ' ') || chr(10) || chr(10) || 'The ' || base || ' goes with [[' || dir || '/' || replace(base, ' ', '-') || '|the ' || base || ']] and   [[' || dir || '/' || replace(base, ' ', '-') || 's]].' || chr(10)
 || 'See [[gone/page-' || (k % 7) || ']] and [[concepts/red-bolt]] or [a link](http://x.y/z) now.' || chr(10) || CASE WHEN k % 3 = 0 THEN '`[[code/inline]]`' || chr(10) || '```' || chr(10) || '[[code/fenced]] blue gear' || chr(10) || '```' || chr(10) ELSE '' END
 || 'It beats the blue gear, a Small Ring and the green widgets, the blue gear again.' || chr(10) || CASE WHEN k % 4 = 0 THEN '<!-- generated -->' || chr(10) || chr(10) || 'Made text.' || chr(10) ELSE '' END AS body
FROM (SELECT *, CASE type WHEN 'entity' THEN 'entities' WHEN 'synthesis' THEN 'syntheses' WHEN 'source' THEN 'sources' ELSE 'concepts' END AS dir,
 CASE variant WHEN 0 THEN replace(base, ' ', '-') WHEN 1 THEN replace(base, ' ', '-') || 's' WHEN 2 THEN replace(base, ' ', '-') || '-kit' WHEN 3 THEN replace(base, ' ', '') WHEN 4 THEN replace(base, ' ', '-steel-')
  WHEN 5 THEN 'big-' || replace(base, ' ', '-') WHEN 6 THEN substr(base, 1, 1) || '-' || replace(substr(base, 2), ' ', '-') ELSE replace(base, ' ', '-x') END AS slug
 FROM (SELECT *, CASE WHEN length(base) % 4 = 1 THEN 'entity' WHEN length(base) % 4 = 2 THEN 'synthesis' WHEN variant = 7 AND k % 5 = 0 THEN 'source' ELSE 'concept' END AS type
  FROM (SELECT CASE WHEN part_of > 0 THEN concat(p_name, ' ', cast(part_of AS string)) ELSE p_name END AS base, variant, k
   FROM (SELECT p_name, p_partkey % 8 AS variant, cast(floor(p_partkey / 2048) AS bigint) AS part_of, min(p_partkey) AS k FROM {part} GROUP BY p_name, p_partkey % 8, cast(floor(p_partkey / 2048) AS bigint)) w) x) y) z"""
WIKI = "wiki_ AS (" + _WIKI.replace("{part}", "part") + ")"


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, page_id, title, type, status, summary, body, aliases, modified, created, inbound and outbound links aside, with vectors."""
    found = spark.sql(_WIKI, part=read(spark, sf_dir, "part"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    contradictions = F.transform(F.sequence(F.lit(1), F.col("n_contradictions")), lambda i: F.struct(F.concat(F.lit("old "), i.cast("string")).alias("existing"), F.lit("new").alias("new"), F.lit("s").alias("source")))
    out = found.join(vectors, "vec_id", "left").withColumns({
        "key": F.col("k"), "pos": F.col("k"), "modified": F.timestamp_seconds("m"), "created": F.timestamp_seconds("c"), "aliases": F.array("alias1", "alias2"),
        "contradictions": F.when(F.col("n_contradictions") > 0, contradictions).otherwise(F.expr("slice(array(named_struct('existing', '', 'new', '', 'source', '')), 1, 0)")),
    })
    return out


#: Links of the collection, as its SQL finds them: code first blanked, then targets; each once, with the text before its first place on its line.
_BLANK = r"regexp_replace(regexp_replace(body, '(?s)```.*?```', ' ', 'g'), '`[^`\n]+`', ' ', 'g')"
WIKI_EDGES = rf"""wiki_parts_ AS (SELECT page_id AS src, string_split({_BLANK}, '[[') AS p FROM wiki_),
wiki_links_ AS (SELECT src, i, trim(regexp_extract(p[i], '^([^\]|\n]+)(\|[^\]\n]+)?\]\]', 1)) AS dst, array_to_string(p[1:i - 1], '[[') AS before FROM (SELECT src, p, unnest(range(2, len(p) + 1)) AS i FROM wiki_parts_)),
wiki_edges_ AS (SELECT src, dst, trim(regexp_replace(trim(right(string_split(first(before ORDER BY i), chr(10))[-1], 60)), '\s+', ' ', 'g')) AS context FROM wiki_links_ WHERE dst <> '' AND dst <> src GROUP BY src, dst)"""


#: Chunks, routed pages and their bridge: documents as chunks, every fifth vector as a page.
CHUNKS = """chunk_ AS (SELECT doc_id AS chunk_id, text, greatest(1, length(coalesce(text, '')) // 4) AS tokens, (doc_id % 20) * 5 AS page_id, source AS source_path, lang AS heading, embedding::DOUBLE[] AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
route_ AS (SELECT vec_id AS page_id, 'page ' || vec_id AS title, CASE WHEN vec_id % 3 = 0 THEN 'source' ELSE 'concept' END AS type, CASE WHEN vec_id % 35 = 0 THEN 'deprecated' WHEN vec_id % 11 = 0 THEN 'dormant' ELSE 'active' END AS status, 'Summary of page ' || vec_id AS summary, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 5 = 0),
bridge_ AS (SELECT doc_id AS chunk_id, (doc_id % 20) * 5 AS page_id FROM documents UNION SELECT doc_id, (doc_id % 7) * 5 FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).alias("tokens"), ((F.col("doc_id") % 20) * 5).alias("page_id"), F.col("source").alias("source_path"), F.col("lang").alias("heading"))
    return docs.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), "chunk_id", "left")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks' texts without their vectors."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "embeddings").where("vec_id % 5 = 0")
    name = F.col("vec_id").cast("string")
    status = F.when(F.col("vec_id") % 35 == 0, "deprecated").when(F.col("vec_id") % 11 == 0, "dormant").otherwise("active")
    return found.select(F.col("vec_id").alias("page_id"), F.concat(F.lit("page "), name).alias("title"), F.when(F.col("vec_id") % 3 == 0, "source").otherwise("concept").alias("type"), status.alias("status"), F.concat(F.lit("Summary of page "), name).alias("summary"), F.col("embedding").alias("v"))


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), ((F.col("doc_id") % 20) * 5).alias("page_id")).unionByName(docs.select(F.col("doc_id").alias("chunk_id"), ((F.col("doc_id") % 7) * 5).alias("page_id"))).distinct()
