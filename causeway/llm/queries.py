"""Registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from causeway.llm.alignment import op12_token_alignment
from causeway.llm.bpe import op9_byte_bpe
from causeway.llm.chat import op10_chat_formatting
from causeway.llm.fingerprints import op2_fingerprints
from causeway.llm.html_extract import op4_html_extraction
from causeway.llm.jaccard_join import op8_ngram_jaccard
from causeway.llm.language_id import op13_language_id
from causeway.llm.licenses import op1_license_scan
from causeway.llm.negatives import op11_hard_negatives
from causeway.llm.packing import op6_packing
from causeway.llm.quality_model import op3_quality_classifier
from causeway.llm.quality_rules import op7_quality_rules
from causeway.llm.sharding import op5_sharding

QUERIES = {f.__name__: f for f in (
    op1_license_scan,
    op2_fingerprints,
    op3_quality_classifier,
    op4_html_extraction,
    op5_sharding,
    op6_packing,
    op7_quality_rules,
    op8_ngram_jaccard,
    op9_byte_bpe,
    op10_chat_formatting,
    op11_hard_negatives,
    op12_token_alignment,
    op13_language_id,
)}

ORACLES: dict[str, str] = {}
