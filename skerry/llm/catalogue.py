"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, audio, bpe, langid, merkle, near_dup, packing, quality, records, secrets, topk, toxicity, warc
from ._shared import dealt


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages and read the archives back."""
    return warc.archive_pages(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all documents' bytes as sound and compute its features."""
    return audio.audio_features(audio.media_table(_read(spark, sf_dir, "documents"))).drop("tensor_file", "tensors")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 ids."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group all documents by three-word shingles at a similarity of 0.85."""
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"), width=3, threshold="0.85")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the quality of all documents."""
    return quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as record files and read them back."""
    return records.token_records(_read(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find secrets in all documents."""
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents with the rank file's merges and decode the ids."""
    return bpe.digests(bpe.encode_documents(_read(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the toxicity of all documents."""
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products among all embeddings for every hundredth one."""
    return topk.exact_top_k(_read(spark, sf_dir, "embeddings"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of all documents."""
    return langid.identify(_read(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, with proofs and a check of tampered rows."""
    return merkle.manifest(_read(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align two tokenizers' ids over all documents."""
    return alignment.align_documents(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_audio, op3_packing, op4_near_dup, op5_quality, op6_records, op7_secrets, op8_bpe, op9_toxicity, op10_topk, op11_language, op12_merkle, op13_alignment)}


def _leaf_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


_CRC_IS_EVEN = """list_reduce([CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
    lambda x, c: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(x, c)), 4294967295) % 2 = 1"""

ORACLE = {
    "op12_merkle": f"""
WITH RECURSIVE leaf AS (
  SELECT row_number() OVER () AS id, doc_id, source, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_CRC_IS_EVEN} THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS seen
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaf
), node AS (
  SELECT source, 0 AS lvl, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT source, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY source, lvl, i // 3, n
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM node WHERE n = 1
), top AS (
  SELECT 0 AS lvl, place AS i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 3, n
), step AS (
  SELECT 0 AS tree, source, lvl, i, coalesce(string_agg(h, '') OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef,
    coalesce(string_agg(h, '') OVER (a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft
  FROM node WHERE n > 1 WINDOW a AS (PARTITION BY source, lvl, i // 3 ORDER BY i)
  UNION ALL
  SELECT 1, NULL, lvl, i, coalesce(string_agg(h, '') OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
    coalesce(string_agg(h, '') OVER (a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')
  FROM top WHERE n > 1 WINDOW a AS (PARTITION BY lvl, i // 3 ORDER BY i)
), up AS (
  SELECT id, 0 AS lvl, p.i, seen AS h, '' AS proof, source FROM placed p
  UNION ALL
  SELECT u.id, u.lvl + 1, u.i // 3, sha256(bef || u.h || aft), proof || bef || aft, u.source
  FROM up u JOIN step s ON s.tree = 0 AND s.source IS NOT DISTINCT FROM u.source AND s.lvl = u.lvl AND s.i = u.i
), over AS (
  SELECT id, 0 AS lvl, r.place AS i, arg_max(u.h, u.lvl) AS h, arg_max(proof, u.lvl) AS proof
  FROM up u JOIN subroots r ON r.source IS NOT DISTINCT FROM u.source GROUP BY id, r.place
  UNION ALL
  SELECT o.id, o.lvl + 1, o.i // 3, sha256(bef || o.h || aft), proof || bef || aft
  FROM over o JOIN step s ON s.tree = 1 AND s.lvl = o.lvl AND s.i = o.i
), done AS (
  SELECT id, arg_max(h, lvl) AS folded_root, sha256(arg_max(proof, lvl)) AS proof_sha256 FROM over GROUP BY id
)
SELECT p.doc_id, p.leaf, r.subroot, t.h AS root, d.proof_sha256, d.folded_root, d.folded_root = t.h AS verified
FROM placed p JOIN done d USING (id) JOIN subroots r ON r.source IS NOT DISTINCT FROM p.source CROSS JOIN (SELECT h FROM top WHERE n = 1) t
""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""",
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
w AS (SELECT html, max(page_id) AS winner FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN w.winner IS NOT NULL AND w.winner IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN w.winner IS DISTINCT FROM p.page_id THEN w.winner END AS refers_to
FROM p LEFT JOIN w ON p.n >= 1000 AND p.html = w.html
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
