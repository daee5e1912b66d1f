"""The corpus pipeline: documents -> packed token sequences, in five stages.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents:

1. toxicity: rows that the classifier rejects go;
2. near copies: one row (smallest doc_id) of each class of linked texts stays;
3. repeated passages: strings of PASSAGE bytes that start at two places are cut out of the texts; every row stays;
4. decontamination: rows that leak an item of the benchmark go;
5. packing: the token ids of what is left, in sequences of 2048.

``run`` applies them to the documents table; ORACLE_SQL is None, since models, components and tokens are beyond SQL: tests hold each stage
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import kit
from tillroll.llm.op01_suffix_dedup import without_repeats
from tillroll.llm.op04_best_fit_packing import best_fit_packing
from tillroll.llm.op05_jaccard_join import one_of_each
from tillroll.llm.op09_decontamination import without_leaks
from tillroll.llm.op10_toxicity import without_toxic


#: bytes of the shortest repeated string that the third stage cuts. Passages of just over 50 words are 250 to 350 bytes long, so the
#: 400 bytes of op1's own query would leave most of them; at 256 nearly all go, and 6 % of texts without one change (4 % at 400)
PASSAGE = 256


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, kit.table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs, PASSAGE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, kit.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("repeated_passages", repeated_passages),
          ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written below the shared scratch folder."""
    docs = kit.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kit.write(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
