"""Queries of this folder, by name."""

from __future__ import annotations

from quernel.llm.fill_middle import OP12_SQL, op12_fill_in_middle
from quernel.llm.html_blocks import op6_html_extraction
from quernel.llm.jaccard import OP5_SQL, op5_ngram_jaccard
from quernel.llm.licenses import op8_license_scans, oracle
from quernel.llm.line_dedup import OP4_SQL, op4_line_dedup
from quernel.llm.maxent import op1_maxent_scoring
from quernel.llm.media import op2_media_columns
from quernel.llm.merge_dropout import op3_merge_dropout
from quernel.llm.minhash import OP13_SQL, op13_minhash_dedup
from quernel.llm.packing import op10_best_fit_packing
from quernel.llm.resample import OP11_SQL, op11_importance_resampling
from quernel.llm.toxicity import op7_toxicity
from quernel.llm.vectors import OP9_SQL, op9_exact_top_k


def queries() -> dict:
    return {f.__name__: f for f in (op1_maxent_scoring, op2_media_columns, op3_merge_dropout, op4_line_dedup, op5_ngram_jaccard, op6_html_extraction, op7_toxicity, op8_license_scans, op9_exact_top_k, op10_best_fit_packing, op11_importance_resampling, op12_fill_in_middle, op13_minhash_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op5_ngram_jaccard": OP5_SQL, "op8_license_scans": oracle(), "op9_exact_top_k": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_minhash_dedup": OP13_SQL}
