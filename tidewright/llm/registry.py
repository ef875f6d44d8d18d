"""Queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from . import ann, bpe, embeddings, fim, langid, lines, negatives, packing, pii, rules, simhash, unigram, urls

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_bpe": bpe.op2_bpe,
    "op3_url_filter": urls.op3_url_filter,
    "op4_token_counts": unigram.op4_token_counts,
    "op5_pii": pii.op5_pii,
    "op6_embedding_dedup": embeddings.op6_embedding_dedup,
    "op7_packing": packing.op7_packing,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_language_id": langid.op10_language_id,
    "op11_nearest_neighbours": ann.op11_nearest_neighbours,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op6_embedding_dedup": embeddings.ORACLE,
    "op8_line_dedup": lines.ORACLE,
    "op9_quality_rules": rules.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
