"""Registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksrisk.llm import byte_bpe, caps, convnet, fingerprints, licenses, merkle, minhash, mixing, token_files, toxicity, url_filters, warc, whitening
from worksrisk.llm.common import table
from worksrisk.session import Staging


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Staging(spark, "warc")
    written = warc.write_archives(table(spark, sf_dir, "pages"), stage)
    members = warc.normalise(written, stage)
    stage.drop("whole")
    return warc.read_back(members).drop("record_offset")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        Staging(spark, "tokens"))
    return token_files.read_tokens(manifest)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op5_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.similar_vectors(table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


URL_RULES = [
    url_filters.UrlRule("allow", "com", "/"),
    url_filters.UrlRule("block", "example.com", "/en/"),
    url_filters.UrlRule("allow", "www.example.com", "/en/"),
    url_filters.UrlRule("block", "net", "/es/"),
    url_filters.UrlRule("block", "net", "/fr/"),
]


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convnet.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), Staging(spark, "whitening"))
    return (found.select("vec_id", "n", "deviation", "identity_error", "explained",
                         F.posexplode("z").alias("place", "whitened"))
            .select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened",
                    F.get("explained", F.col("place")).alias("explained"), "identity_error"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = merkle.manifest(docs, Staging(spark, "merkle"), *merkle.tampered(
        F.col("text"), F.col("doc_id")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256"),
        F.col("version_root").alias("folded_root"),
        (F.col("version_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_winnowing, op2_warc, op3_token_files, op4_near_duplicates, op5_similar_vectors,
                            op6_license_scan, op7_byte_bpe, op8_toxicity, op9_url_templates, op10_source_mix,
                            op11_byte_convnet, op12_whitening, op13_merkle_manifest)
}

OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         length(coalesce(text, '')) AS chars
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('0|' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5)
                / 281474976710656.0)
    / greatest(0.25, coalesce(2.0 / (1.0 + abs(chars::DOUBLE / nullif(size, 0) - 6.0)), 0)) AS k
  FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
ranked AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         3.0 * source_size AS cap
  FROM sources),
filled AS (
  SELECT *, cap / w AS ratio, (SELECT sum(source_size) FROM sources)::DOUBLE
      - coalesce(sum(cap) OVER o, 0) AS cap_left,
    (SELECT sum(w) FROM ranked) - coalesce(sum(w) OVER o, 0) AS w_left
  FROM ranked
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(cap_left / w_left, ratio) AS lev FROM filled WHERE ratio > cap_left / w_left),
targets AS (
  SELECT source, source_size, CASE WHEN lev IS NULL THEN cap ELSE least(w * lev, cap) END AS target
  FROM filled, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole
  FROM targets),
running AS (
  SELECT doc_id, size, source_size, target, whole,
         target - whole * source_size AS rest,
         sum(size) OVER (PARTITION BY parts.source ORDER BY k, doc_id, size
                         ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed JOIN parts ON keyed.source IS NOT DISTINCT FROM parts.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""

OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT page_id, n AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM p JOIN f ON p.html = f.html
"""

OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
one AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION
  SELECT reach.doc_id, y FROM reach JOIN edges ON reach.other = x)
SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""

OP13_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS doc, doc_id, source,
    CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(
             string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda x, step: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 5 = 0
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
leaves AS (
  SELECT doc, doc_id, source, sha256(head || tail) AS leaf,
         sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other_leaf FROM docs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree(source, depth, pos, n, h) AS (
  SELECT source, 0, pos, n, leaf FROM placed UNION ALL
  SELECT source, depth + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY source, depth, pos // 16, n),
subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
         count(*) OVER () AS n FROM tree WHERE n = 1),
top(depth, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM subroots UNION ALL
  SELECT depth + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY depth, pos // 16, n),
nodes AS (SELECT false AS is_top, source, depth, pos, n, h FROM tree WHERE n > 1
          UNION ALL SELECT true, NULL, depth, pos, n, h FROM top WHERE n > 1),
steps AS (  -- every run on the way of a document to the root
  SELECT p.doc, k.is_top, k.depth, k.pos, k.h, k.pos = p.pos >> (4 * k.depth) AS own
  FROM placed p JOIN nodes k ON NOT k.is_top AND p.source IS NOT DISTINCT FROM k.source
    AND k.pos >> 4 = p.pos >> (4 * k.depth + 4)
  UNION ALL
  SELECT p.doc, k.is_top, k.depth, k.pos, k.h, k.pos = s.pos >> (4 * k.depth)
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
  JOIN nodes k ON k.is_top AND k.pos >> 4 = s.pos >> (4 * k.depth + 4)),
runs AS (
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY is_top, depth) AS step,
         coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE NOT own), '') AS others,
         coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < mine), '') AS head,
         coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > mine), '') AS tail
  FROM (SELECT *, max(CASE WHEN own THEN pos END) OVER (PARTITION BY doc, is_top, depth) AS mine FROM steps)
  GROUP BY doc, is_top, depth),
fold(doc, step, h) AS (
  SELECT doc, 0, other_leaf FROM placed UNION ALL
  SELECT doc, runs.step, sha256(head || h || tail)
  FROM fold JOIN runs USING (doc) WHERE runs.step = fold.step + 1),
proofs AS (SELECT doc, sha256(string_agg(others, '' ORDER BY step)) AS proof_sha256 FROM runs GROUP BY doc),
ends AS (SELECT doc, arg_max(h, step) AS folded_root FROM fold GROUP BY doc)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root,
       coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
       folded_root = (SELECT h FROM top WHERE n = 1) AS verified
FROM placed JOIN subroots ON placed.source IS NOT DISTINCT FROM subroots.source
JOIN ends USING (doc) LEFT JOIN proofs USING (doc)
"""

ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op4_near_duplicates": OP4_SQL,
                           "op10_source_mix": OP10_SQL, "op13_merkle_manifest": OP13_SQL}
