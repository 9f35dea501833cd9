"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.alignment import op13_token_alignment
from brindle.llm.decontaminate import op10_decontamination
from brindle.llm.fingerprints import op5_fingerprints
from brindle.llm.jaccard_join import op4_jaccard_join
from brindle.llm.language import op7_language
from brindle.llm.licenses import op6_licenses
from brindle.llm.lm_scores import op11_lm_scores
from brindle.llm.packing import op8_packing
from brindle.llm.quality import op2_quality
from brindle.llm.spelling import op12_spelling_variants
from brindle.llm.sql import SQL
from brindle.llm.token_counts import op1_token_counts
from brindle.llm.token_files import op3_token_files
from brindle.llm.warc import op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_counts, op2_quality, op3_token_files, op4_jaccard_join, op5_fingerprints, op6_licenses, op7_language, op8_packing, op9_warc, op10_decontamination, op11_lm_scores, op12_spelling_variants, op13_token_alignment]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
