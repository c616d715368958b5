"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, fim, langid, line_dedup, merkle, ngram_join, packing, pieces, pii, quality, secrets, substring_dedup, variants
from .oracles import ORACLE_SQL

QUERIES = {
    f.__name__: f
    for f in (
        line_dedup.op1_line_dedup,
        secrets.op2_secret_scans,
        ann.op3_approximate_nearest_neighbours,
        merkle.op4_document_fingerprints,
        pii.op5_pii,
        pieces.op6_sentencepiece,
        langid.op7_language_id,
        ngram_join.op8_ngram_jaccard_join,
        packing.op9_best_fit_packing,
        substring_dedup.op10_substring_dedup,
        variants.op11_spelling_variants,
        quality.op12_quality_rules,
        fim.op13_fill_in_middle,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
