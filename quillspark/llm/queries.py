"""Queries of the corpus operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from quillspark.llm import (
    lang_crf, lexical_search, line_chunks, line_rules, pareto_mix, pii, probminhash, quality_cnn, radix_dedup, template_decontam,
    trie_codes, unit_dedup, url_model,
)
from quillspark.sources.tables import read_table


def op1_probminhash(spark, sf_dir):
    return probminhash.near_duplicate_query(read_table(spark, sf_dir, "documents"))


def op2_quality_cnn(spark, sf_dir):
    return quality_cnn.quality_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_lang_crf(spark, sf_dir):
    return lang_crf.language_query(read_table(spark, sf_dir, "documents"))


def op4_unit_dedup(spark, sf_dir):
    return unit_dedup.unit_query(read_table(spark, sf_dir, "documents"))


def op5_line_chunks(spark, sf_dir):
    return line_chunks.chunk_query(read_table(spark, sf_dir, "documents"))


def op6_line_rules(spark, sf_dir):
    return line_rules.rules_query(read_table(spark, sf_dir, "documents"))


def op7_template_decontam(spark, sf_dir):
    return template_decontam.decontam_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_pareto_mix(spark, sf_dir):
    return pareto_mix.mix_query(read_table(spark, sf_dir, "documents"))


def op9_url_model(spark, sf_dir):
    return url_model.url_query(read_table(spark, sf_dir, "pages"))


def op10_pii(spark, sf_dir):
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op11_radix_dedup(spark, sf_dir):
    return radix_dedup.exact_query(read_table(spark, sf_dir, "documents"))


def op12_trie_codes(spark, sf_dir):
    return trie_codes.code_query(read_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_probminhash": (op1_probminhash, None),
    "op2_quality_cnn": (op2_quality_cnn, None),
    "op3_lang_crf": (op3_lang_crf, None),
    "op4_unit_dedup": (op4_unit_dedup, unit_dedup.UNIT_SQL),
    "op5_line_chunks": (op5_line_chunks, None),
    "op6_line_rules": (op6_line_rules, line_rules.RULES_SQL),
    "op7_template_decontam": (op7_template_decontam, None),
    "op8_pareto_mix": (op8_pareto_mix, pareto_mix.MIX_SQL),
    "op9_url_model": (op9_url_model, None),
    "op10_pii": (op10_pii, None),
    "op11_radix_dedup": (op11_radix_dedup, radix_dedup.EXACT_SQL),
    "op12_trie_codes": (op12_trie_codes, trie_codes.CODE_SQL),
    "op13_lexical_search": (op13_lexical_search, lexical_search.SEARCH_SQL),
}
