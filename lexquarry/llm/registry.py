"""Queries and oracle SQL of this package."""

from __future__ import annotations

from .ann import op4_collision_ann
from .bpe import op5_bpe_chunks
from .fingerprint import op10_lcp_fingerprints
from .langid import op6_language_spans
from .mixing import op9_mix_sources
from .neardup import op1_minhash_components
from .pii import op3_pii_surrogates
from .quality import op7_quality_rules
from .substrings import op8_suffix_dedup
from .toxicity import op2_toxicity_knn

QUERIES = {
    "op1_minhash_components": op1_minhash_components,
    "op2_toxicity_knn": op2_toxicity_knn,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_collision_ann": op4_collision_ann,
    "op5_bpe_chunks": op5_bpe_chunks,
    "op6_language_spans": op6_language_spans,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_lcp_fingerprints": op10_lcp_fingerprints,
}
ORACLES: dict[str, str] = {}
