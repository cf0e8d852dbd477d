"""Queries of the pipeline operators, and their DuckDB SQL where it exists."""

from __future__ import annotations

from .decontaminate import op8_decontamination
from .divergence import OP13_SQL, op13_source_divergence
from .langid import op5_language_id
from .linededup import op2_line_dedup
from .lm import op7_lm_scoring
from .neardedup import op4_minhash_near_dedup
from .oracles import OP2_SQL, OP4_SQL, OP8_SQL
from .packing import op6_best_fit_packing
from .secrets import op3_secret_scan
from .spelling import OP11_SQL, op11_spelling_variants
from .suffixdedup import op10_suffix_dedup
from .tokencount import op9_token_counts
from .topk import OP1_SQL, op1_exact_topk
from .toxicity import op12_toxicity

REGISTRY = {f.__name__: f for f in (op1_exact_topk, op2_line_dedup, op3_secret_scan, op4_minhash_near_dedup, op5_language_id, op6_best_fit_packing, op7_lm_scoring, op8_decontamination, op9_token_counts, op10_suffix_dedup, op11_spelling_variants, op12_toxicity, op13_source_divergence)}

ORACLE: dict[str, str] = {"op1_exact_topk": OP1_SQL, "op2_line_dedup": OP2_SQL, "op4_minhash_near_dedup": OP4_SQL, "op8_decontamination": OP8_SQL, "op11_spelling_variants": OP11_SQL, "op13_source_divergence": OP13_SQL}
