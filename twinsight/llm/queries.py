"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, jaccard, langid, lm, mixing, packing, passages, search, suffix


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> dict[str, str]:
    """Where the public byte-level BPE tokenizer lies, and its splitting pattern."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "pattern": public_tokenizers.PATTERN}


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_read(spark, sf_dir, "conversations"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), **vocabulary())


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "links", "copies")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return search.top_k(docs, docs.filter(F.col("doc_id") % 50 == 0))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_read(spark, sf_dir, "documents"))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.clusters(passages.repeated_passages(_read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_packing": op4_packing,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_topk_search": op6_topk_search,
        "op7_language_id": op7_language_id,
        "op8_source_mixing": op8_source_mixing,
        "op9_fingerprints": op9_fingerprints,
        "op10_paragraph_dedup": op10_paragraph_dedup,
    }


OP1_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations
), whole AS (
  SELECT conv_id, count(*) AS n, list(struct_pack(r := role, x := text) ORDER BY place) AS turns
  FROM t GROUP BY conv_id
), alone AS (
  SELECT min(conv_id) AS conv_id, n, turns, count(*) AS copies FROM whole GROUP BY n, turns
), kept AS (
  SELECT a.conv_id, a.n, a.copies FROM alone a
  WHERE NOT EXISTS (SELECT 1 FROM alone b WHERE b.n > a.n AND b.turns[1:a.n] = a.turns)
)
SELECT k.conv_id, CAST(k.n AS BIGINT) AS n_turns, CAST(k.copies AS BIGINT) AS copies,
       string_agg('<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10), '' ORDER BY t.place) AS text
FROM kept k JOIN t ON t.conv_id = k.conv_id
GROUP BY k.conv_id, k.n, k.copies
"""


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term
  FROM documents
), p AS (
  SELECT doc_id, term, count(*)::DOUBLE AS tf FROM w GROUP BY ALL
), len AS (
  SELECT doc_id, count(*)::DOUBLE AS n FROM w GROUP BY doc_id
), s AS (
  SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM w)::DOUBLE / (SELECT count(*) FROM documents) AS avg
), df AS (
  SELECT term, count(*)::DOUBLE AS n FROM p GROUP BY term
), hit AS (
  SELECT q.doc_id AS query_id, p.doc_id,
         round(sum(greatest(0.01::DOUBLE, ln(1 + (s.n - df.n + 0.5) / (df.n + 0.5))) * (p.tf * 2.2::DOUBLE) / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len.n / s.avg))), 9) AS score
  FROM p AS q JOIN p USING (term) JOIN df USING (term) JOIN len ON len.doc_id = p.doc_id CROSS JOIN s
  WHERE q.doc_id % 50 = 0 GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hit
)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op6_topk_search": OP6_SQL}
