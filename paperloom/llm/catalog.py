"""Queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op6_bpe_round_trip
from .deleted_interpolation import op1_deleted_interpolation
from .html_content import op7_html_content
from .kneser_ney import op3_kneser_ney_quality
from .line_dedup import op8_line_dedup
from .maxscore import SQL as TOP_K_SQL
from .maxscore import op5_maxscore_top_k
from .packing import op9_best_fit_packing
from .quality_rules import SQL as RULES_SQL
from .quality_rules import op10_quality_rules
from .secret_scan import op2_secret_scan
from .simhash import op4_simhash_near_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_deleted_interpolation,
        op2_secret_scan,
        op3_kneser_ney_quality,
        op4_simhash_near_dedup,
        op5_maxscore_top_k,
        op6_bpe_round_trip,
        op7_html_content,
        op8_line_dedup,
        op9_best_fit_packing,
        op10_quality_rules,
    )
} | {"pipeline": corpus_pipeline.run}

#: The others need a model, an iteration, a digest or a library that SQL lacks.
ORACLES: dict[str, str] = {"op5_maxscore_top_k": TOP_K_SQL, "op10_quality_rules": RULES_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
