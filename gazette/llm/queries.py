"""The queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from . import divergence, embeddings, exact, licenses, lm, negatives, pii, quality, simhash, suffix, urls
from .bpe import round_trip
from .common import table
from .packing import pack


def op1_embedding_dedup(spark, sf_dir):
    return embeddings.near_dedup(table(spark, sf_dir, "embeddings"))


def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    import public_tokenizers as p

    return round_trip(table(spark, sf_dir, "documents"), p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)


def op8_packing(spark, sf_dir):
    import public_tokenizers as p

    return pack(table(spark, sf_dir, "documents"), p.path("word_bpe_49k.json"))


def op9_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark, sf_dir):
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix.dedup_report(table(spark, sf_dir, "documents"), passage=suffix.PASSAGE)


def op7_lm_score(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_pii(spark, sf_dir):
    return pii.find_identifiers(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_bpe": op4_bpe,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_source_divergence": op11_source_divergence,
    "op12_pii": op12_pii,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {"op3_licenses": licenses.SQL, "op9_exact_dedup": exact.SQL, "op10_url_filter": urls.SQL, "op11_source_divergence": divergence.SQL, "op13_hard_negatives": negatives.SQL}
