"""The queries of this subpackage, by name, and the SQL of those it can express."""

from __future__ import annotations

from wearhouse.llm import decontam, fim, urlfilter
from wearhouse.llm.fingerprint import op4_document_fingerprints
from wearhouse.llm.langid import op2_language_id
from wearhouse.llm.linededup import op3_line_dedup
from wearhouse.llm.neardup import op8_minhash_near_dedup
from wearhouse.llm.packing import op7_best_fit_packing
from wearhouse.llm.piececodec import op11_piece_codec
from wearhouse.llm.quality import op10_quality_classifier
from wearhouse.llm.tokencount import op9_token_counts
from wearhouse.llm.toxicity import op1_toxicity
from wearhouse.llm.whitening import op13_embedding_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_benchmark_decontamination": decontam.op5_benchmark_decontamination,
    "op6_url_filters": urlfilter.op6_url_filters,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_piece_codec": op11_piece_codec,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLE_SQL = {
    "op5_benchmark_decontamination": decontam.ORACLE_SQL,
    "op6_url_filters": urlfilter.ORACLE_SQL,
    "op12_fill_in_middle": fim.ORACLE_SQL,
}
