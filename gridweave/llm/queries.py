"""Registered queries of this subpackage: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from gridweave.llm import (
    best_two_fit,
    embed_dedup,
    hard_negatives,
    html_extract,
    langid,
    phrase_mining,
    quality_model,
    quality_rules,
    sentencepiece_viterbi,
    simhash,
    sos_packing,
    token_output,
    warc,
)

QUERIES = {
    "op1_sentencepiece": (sentencepiece_viterbi.query, None),
    "op2_quality_classifier": (quality_model.query, None),
    "op3_quality_rules": (quality_rules.query, quality_rules.SQL),
    "op4_simhash_dedup": (simhash.query, None),
    "op5_language_id": (langid.query, None),
    "op6_html_extraction": (html_extract.query, None),
    "op7_token_output": (token_output.query, None),
    "op8_warc_archive": (warc.query, warc.SQL),
    "op9_sos_packing": (sos_packing.query, None),
    "op10_embedding_dedup": (embed_dedup.query, embed_dedup.SQL),
    "op11_best_two_fit": (best_two_fit.query, None),
    "op12_phrase_mining": (phrase_mining.query, phrase_mining.SQL),
    "op13_hard_negatives": (hard_negatives.query, hard_negatives.SQL),
}


def queries():
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
