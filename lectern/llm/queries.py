"""The registered queries of the operators, over whole tables and with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, gray_index, hard_negatives, language_id, merkle, minhash, quality_mil, secret_scan, sharding, simhash, suffix_dedup, url_rules
from lectern.llm.store import cut, folder, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out quarter."""
    return language_id.identify(read(spark, sf_dir, "documents"), vocabulary_path())


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the known forms, and all spans."""
    return secret_scan.find(read(spark, sf_dir, "documents"))


@query("op3_minhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document, on shingles of two words."""
    return minhash.groups(read(spark, sf_dir, "documents"), width=2)


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited version, and their likeness.

    Every fiftieth document is also searched for among all: ``n_within`` counts what lies within three bits.
    """
    prints = cut(simhash.edited(read(spark, sf_dir, "documents")), "fingerprints")
    return simhash.with_counts(prints, F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False)))


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of every document's ids and of the text decoded from them."""
    return bpe.digests(read(spark, sf_dir, "documents"), vocabulary_path())


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that occur elsewhere."""
    return suffix_dedup.remove(read(spark, sf_dir, "documents"))


SHARDS = 8


@query("op7_virtual_slots")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes, by version 1 of a stored slot map.

    Version 2 is edited from it for one shard more; ``next_shard`` is where it puts a row.
    """
    recs = cut(sharding.records(read(spark, sf_dir, "documents")), "records")
    weights = cut(sharding.weigh(recs), "weights")
    path = f"{folder(spark)}/slot-map-{uuid.uuid4().hex}"
    sharding.store_map(sharding.first_map(weights, SHARDS), path)
    sharding.store_map(sharding.edit_map(sharding.load_map(spark, path, 1), weights, SHARDS + 1), path)
    placed = sharding.place(recs, sharding.load_map(spark, path, 1), weights)
    grown = sharding.load_map(spark, path, 2).select("virtual_slot", F.col("shard").cast("int").alias("next_shard"))
    return placed.join(F.broadcast(grown), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")


@query("op8_quality_mil")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held-out fifth."""
    return quality_mil.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
OP9_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
  FROM p
), r(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT n, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS k
  FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM q LEFT JOIN m ON q.n = m.n AND m.k = 1
"""


@query("op9_url_rules", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    # An inline table: no Python worker reads it.
    values = ", ".join(str(rule) for rule in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    urls = url_rules.parsed(read(spark, sf_dir, "pages"))
    return url_rules.judge(urls, rules).drop("n_tried")


@query("op10_decontaminate")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, copied or with other values filled in."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op11_gray_simhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: three words, two bits."""
    return gray_index.groups(read(spark, sf_dir, "documents"), width=3, radius=2)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector under its five best positives."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents
), l AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS other
  FROM d
), bits AS (  -- checksum tables: eight steps per byte
  SELECT n, n AS c, 0 AS k FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY n) AS cells FROM bits WHERE k = 8
), crc AS (
  SELECT doc_id, doc_id::VARCHAR AS s, 1 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, s, i + 1, xor(c // 256, cells[xor(c % 256, ascii(s[i])::BIGINT) + 1]) FROM crc, crc_table WHERE i <= length(s)
), marked AS (SELECT doc_id, xor(c, 4294967295) % 7 = 0 AS bad FROM crc WHERE i = length(s) + 1
), p AS (
  SELECT doc_id, lang, leaf, CASE WHEN bad THEN other ELSE leaf END AS used,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM l LEFT JOIN marked USING (doc_id)
), sub AS (  -- one list of nodes per language and level
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM sub WHERE len(nodes) > 1
), subroots AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM sub WHERE len(nodes) = 1
), upper AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM upper WHERE len(nodes) > 1
), steps AS (  -- L or R: the sibling stands before or after
  SELECT p.lang, p.pos, s.level AS step, CASE WHEN (p.pos >> s.level) % 2 = 1 THEN 'L' || s.nodes[p.pos >> s.level]
         ELSE 'R' || coalesce(s.nodes[(p.pos >> s.level) + 2], '') END AS sibling
  FROM p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang AND len(s.nodes) > 1
  UNION ALL
  SELECT p.lang, p.pos, 1000 + u.level, CASE WHEN (r.place >> u.level) % 2 = 1 THEN 'L' || u.nodes[r.place >> u.level]
         ELSE 'R' || coalesce(u.nodes[(r.place >> u.level) + 2], '') END
  FROM p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang JOIN upper u ON len(u.nodes) > 1
), path AS (SELECT lang, pos, list(sibling ORDER BY step) AS siblings FROM steps GROUP BY lang, pos
), fold AS (
  SELECT lang, pos, used AS node, 1 AS i FROM p
  UNION ALL
  SELECT f.lang, f.pos, CASE WHEN siblings[i][1] = 'L' THEN sha256(siblings[i][2:] || node) ELSE sha256(node || siblings[i][2:]) END, i + 1
  FROM fold f JOIN path ON f.pos = path.pos AND f.lang IS NOT DISTINCT FROM path.lang WHERE i <= len(siblings)
), folded AS (SELECT lang, pos, max_by(node, i) AS folded_root FROM fold GROUP BY lang, pos
), root AS (SELECT nodes[1] AS root FROM upper WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(siblings, lambda x: x[2:]), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang CROSS JOIN root
JOIN folded f ON p.pos = f.pos AND p.lang IS NOT DISTINCT FROM f.lang
LEFT JOIN path ON p.pos = path.pos AND p.lang IS NOT DISTINCT FROM path.lang
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the tampered table still folds to the root."""
    hashed = merkle.tampered_by_checksum(read(spark, sf_dir, "documents"))
    return merkle.proofs(hashed).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
