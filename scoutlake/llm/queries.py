"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoutlake.llm import centroids, decontaminate, jaccard, repeats, spelling
from scoutlake.llm.bpe import op3_backtracking
from scoutlake.llm.centroids import op13_dual_tree
from scoutlake.llm.decontaminate import op2_winnowing
from scoutlake.llm.jaccard import op8_combination_prefixes
from scoutlake.llm.language import op10_kneser_ney
from scoutlake.llm.language_model import op5_log_bilinear
from scoutlake.llm.quality_model import op9_factorisation
from scoutlake.llm.quality_rules import op4_weak_supervision
from scoutlake.llm.repeats import op11_interval_tree
from scoutlake.llm.secrets import op6_blob_ledger
from scoutlake.llm.spelling import op12_rolling_deletions
from scoutlake.llm.token_store import op1_context_mixing
from scoutlake.llm.url_filter import op7_template_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_mixing": op1_context_mixing,
    "op2_winnowing": op2_winnowing,
    "op3_backtracking": op3_backtracking,
    "op4_weak_supervision": op4_weak_supervision,
    "op5_log_bilinear": op5_log_bilinear,
    "op6_blob_ledger": op6_blob_ledger,
    "op7_template_tree": op7_template_tree,
    "op8_combination_prefixes": op8_combination_prefixes,
    "op9_factorisation": op9_factorisation,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_interval_tree": op11_interval_tree,
    "op12_rolling_deletions": op12_rolling_deletions,
    "op13_dual_tree": op13_dual_tree,
}

SQL: dict[str, str] = {
    "op2_winnowing": decontaminate.sql(),
    "op8_combination_prefixes": jaccard.sql(),
    "op11_interval_tree": repeats.sql(),
    "op12_rolling_deletions": spelling.sql(),
    "op13_dual_tree": centroids.sql(),
}
