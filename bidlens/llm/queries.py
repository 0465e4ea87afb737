"""The registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from .chat_format import OP8_SQL, op8_chat_format
from .collocations import OP12_SQL, op12_phrase_collocations
from .decontamination import op5_benchmark_decontamination
from .fingerprint import op3_document_fingerprints
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .license_scan import OP6_SQL, op6_license_scan
from .line_dedup import OP4_SQL, op4_line_dedup
from .ngram_join import op1_ngram_jaccard_join
from .pii import op7_pii
from .packing import op10_best_fit_packing
from .secret_scan import OP11_SQL, op11_secret_scan
from .token_counts import op9_token_counts
from .toxicity import op2_toxicity

QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_toxicity, op3_document_fingerprints, op4_line_dedup, op5_benchmark_decontamination, op6_license_scan, op7_pii, op8_chat_format, op9_token_counts, op10_best_fit_packing, op11_secret_scan, op12_phrase_collocations, op13_hard_negatives)}
SQL: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op6_license_scan": OP6_SQL, "op8_chat_format": OP8_SQL, "op11_secret_scan": OP11_SQL, "op12_phrase_collocations": OP12_SQL, "op13_hard_negatives": OP13_SQL}
