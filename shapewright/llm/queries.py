"""Queries of the operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fim, kmeans, langid, media, mixing, packing, pii, quality, simhash, topk, toxicity, urls
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_telephony_media": over("documents", media.media_digests),
        "op2_url_digest_filter": over("pages", urls.judged_pages),
        "op3_mcd_outliers": over("documents", quality.judged_documents),
        "op4_poisson_mixing": over("documents", mixing.mixed_documents),
        "op5_string_kernel_language": over("documents", langid.identified_documents),
        "op6_snapshot_collapse": over("conversations", chat.render_chats),
        "op7_harmonic_packing": over("documents", packing.packed_documents),
        "op8_gray_simhash": over("documents", simhash.near_documents),
        "op9_pii_spans": over("documents", pii.pii_digests),
        "op10_weak_toxicity": lambda spark, sf_dir: toxicity.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op11_dual_tree_lloyd": over("embeddings", kmeans.clustered_embeddings),
        "op12_uniform_threshold_topk": over("embeddings", topk.nearest_documents),
        "op13_automaton_fim": over("documents", fim.filled_documents),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_digest_filter": urls.ORACLE_SQL,
        "op4_poisson_mixing": mixing.ORACLE_SQL,
        "op6_snapshot_collapse": chat.ORACLE_SQL,
        "op11_dual_tree_lloyd": kmeans.ORACLE_SQL,
        "op12_uniform_threshold_topk": topk.ORACLE_SQL,
        "op13_automaton_fim": fim.ORACLE_SQL,
    }
