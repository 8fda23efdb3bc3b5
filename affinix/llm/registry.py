"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from affinix.llm.decontamination import OP9_SQL, op9_decontamination
from affinix.llm.language_id import op2_language_id
from affinix.llm.media_copies import op10_media_copies
from affinix.llm.ngram_jaccard import op1_ngram_jaccard
from affinix.llm.packing import op12_best_fit_packing
from affinix.llm.pii import op3_pii
from affinix.llm.prefix_trie import op11_prefix_trie
from affinix.llm.quality_classifier import op6_quality_classifier
from affinix.llm.run_detection import op13_run_detection
from affinix.llm.secret_scan import op8_secret_scan
from affinix.llm.source_mixing import OP5_SQL, op5_source_mixing
from affinix.llm.substring_dedup import op4_substring_dedup
from affinix.llm.token_output import op7_token_output

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_language_id": op2_language_id,
    "op3_pii": op3_pii,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_output": op7_token_output,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontamination": op9_decontamination,
    "op10_media_copies": op10_media_copies,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_run_detection": op13_run_detection,
}
ORACLE_SQL: dict[str, str] = {
    "op5_source_mixing": OP5_SQL,
    "op9_decontamination": OP9_SQL,
}
