"""From raw documents to token sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the one before it kept and
returns the columns of ``documents``, the last one the tokens. ``run`` writes the result of a
stage into the shared folder and reads it again for the next.

1. ``language``: rows whose language is not recognised go (a null text, no letter, or a posterior
   under one half).
2. ``lines``: a line that stands earlier in the corpus, exactly or within one edit, is cut out; a
   document left without any line goes.
3. ``near_duplicates``: of documents linked by SimHash the one with the smallest id stays.
4. ``decontamination``: documents of which a twentieth or more are benchmark passages go.
5. ``tokens``: SentencePiece tokens of the text.

Empty tables, nulls, repeated rows and extra columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetwatch.llm import decontamination, langid, lines, pieces, simhash
from fleetwatch.llm.common import stored, table

# no SQL form: XXH64 fingerprints and tokens are tested against brute-force versions instead
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.keep_first_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.report(docs)


STAGES = [("language", language), ("lines", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", clean_of_benchmarks), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
