"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import oracles
from tillroll.llm.op01_suffix_dedup import op1_suffix_dedup
from tillroll.llm.op02_html_extraction import op2_html_extraction
from tillroll.llm.op03_url_filter import op3_url_filter
from tillroll.llm.op04_best_fit_packing import op4_best_fit_packing
from tillroll.llm.op05_jaccard_join import op5_jaccard_join
from tillroll.llm.op06_fingerprints import op6_fingerprints
from tillroll.llm.op07_quality_cotraining import op7_quality_cotraining
from tillroll.llm.op08_packed_matrices import op8_packed_matrices
from tillroll.llm.op09_decontamination import op9_decontamination
from tillroll.llm.op10_toxicity import op10_toxicity
from tillroll.llm.op11_whitening import op11_whitening
from tillroll.llm.op12_simhash import op12_simhash
from tillroll.llm.op13_collocations import op13_collocations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_url_filter": op3_url_filter,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality_cotraining": op7_quality_cotraining,
    "op8_packed_matrices": op8_packed_matrices,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op1_suffix_dedup": oracles.OP1, "op3_url_filter": oracles.OP3, "op5_jaccard_join": oracles.OP5,
                           "op12_simhash": oracles.OP12, "op13_collocations": oracles.OP13}
