"""Queries and oracle SQL of the text operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .align import op13_align
from .decontam import OP1_SQL, op1_decontaminate
from .jaccard import op9_jaccard_join
from .langid import op10_language
from .lm import op8_lm_score
from .packing import op3_packing
from .phrases import OP12_SQL, op12_phrases
from .pii import op7_pii
from .quality import op6_quality
from .secrets import op11_secrets
from .topk import OP4_SQL, op4_topk
from .toxicity import op2_toxicity
from .urlfilter import OP5_SQL, op5_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_toxicity, op3_packing, op4_topk, op5_url_filter, op6_quality, op7_pii, op8_lm_score, op9_jaccard_join, op10_language, op11_secrets, op12_phrases, op13_align)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op4_topk": OP4_SQL, "op5_url_filter": OP5_SQL, "op12_phrases": OP12_SQL}
