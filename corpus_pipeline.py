"""A pipeline over documents, each stage an operator of placemill.llm.

Language ID drops texts without a language (null, empty or letterless ones); MinHash near-dedup keeps one document of each
class; decontamination drops documents that hold a benchmark item; PII replaces personal data by pseudonyms; mixing
says how often each document is taken. Every stage works on all rows that the one before it kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.llm import decontaminate, language, mixing, neardup, pii
from placemill.llm.common import cut, held_out, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text has no language. Ids, sources and labels may be null or repeat; a row goes by its own text."""
    model = language.learn(docs.filter(~held_out(F.col("doc_id"), 4, 2)))
    return docs.filter(language.identify(docs, model)["lang_pred"] != language.UNKNOWN)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays, one with the least id; rows of null ids and repeated rows are rows like any other."""
    return neardup.deduplicate(docs)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds an item of the benchmark, those of null or repeated ids included."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in the texts; null texts stay null. The key is that of the session (see pii.session_key)."""
    return pii.replace(docs, key=pii.session_key(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each row is taken; rows without words are taken 0 times."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", keep_one_of_each_class),
    ("benchmark decontamination", drop_benchmark_items),
    ("PII", replace_personal_data),
    ("mixing sources to target weights", mix),
]
#: The stages learn, hash and draw; SQL can't express them. tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
