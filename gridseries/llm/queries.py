"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridseries.llm.centroids import cluster_vectors
from gridseries.llm.common import read
from gridseries.llm.conversations import damage_and_repair
from gridseries.llm.exact_dedup import exact_groups
from gridseries.llm.language import languages
from gridseries.llm.line_dedup import line_report
from gridseries.llm.mixing import mix
from gridseries.llm.near_dedup import near_groups
from gridseries.llm.oracles import REPAIR_SQL, kmeans_sql
from gridseries.llm.packing import pack
from gridseries.llm.quality import judge_quality
from gridseries.llm.secrets import scan_secrets
from gridseries.llm.token_counts import token_counts
from gridseries.llm.toxicity import score_toxicity
from gridseries.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary ``name`` lies; it is read in place."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The word pattern as DuckDB writes it.
DUCK_WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT *, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM d WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner and group size of every document's text."""
    return exact_groups(read(spark, sf_dir, "documents"))


@query("op2_source_mixing", f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{DUCK_WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap, 1.5 * sum(source_size) OVER ()::DOUBLE AS total FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS c_before, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left
  FROM w WINDOW before AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * w_left <= w * (total - c_before) AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
    ELSE w * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()::DOUBLE) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()::DOUBLE END AS target FROM c),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS take,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-' || coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS rounds FROM p)
SELECT doc_id, source, size, source_size, target, (rounds * size + greatest(least(start + size, take - rounds * source_size) - start, 0))::BIGINT AS taken FROM q
""")
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mix(read(spark, sf_dir, "documents"))


@query("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_groups(read(spark, sf_dir, "documents"))


@query("op4_warc")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record of every page, as read from the archives."""
    return archive_pages(read(spark, sf_dir, "pages"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of the documents."""
    return pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return languages(read(spark, sf_dir, "documents"))


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring lines of every document."""
    return line_report(read(spark, sf_dir, "documents"))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every document with the forest's verdict."""
    return scan_secrets(read(spark, sf_dir, "documents"))


@query("op12_centroid_clustering", kmeans_sql())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector."""
    return cluster_vectors(read(spark, sf_dir, "embeddings"))


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op13_conversation_repair", REPAIR_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    return damage_and_repair(read(spark, sf_dir, "conversations"))
