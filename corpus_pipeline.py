"""The corpus pipeline: language ID, quality rules, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before kept; its
result is written and read again as the next one's docs. All but the last return the columns
of `documents`, and columns of any other name that docs has. A stage on an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonefold.llm import dedup, language, mixing, packing, quality
from tonefold.llm.common import table, word_count, written
from tonefold.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose bytes cost as much under the best language's model as without any model is in none of the languages.
MOST_BITS = 8.0
#: Jaccard similarity, in per cent, from which documents are near duplicates here; the 85 of op1 is that query's own.
PER_CENT = 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learnt language, with lang as identified; repeats of a row stay. Null texts, and texts without letters, go."""
    model = language.fit(docs)
    rows = language.with_language(docs, model)
    kept = rows.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_byte") < MOST_BITS))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose texts pass the full policy, repeats included. Null and empty texts have too few words, and go."""
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id, once if it is repeated. Texts without an id stay, once each."""
    return dedup.without_near_duplicates(docs, per_cent=PER_CENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; texts without words are never taken. Null sources are one source."""
    return mixing.mixed(docs, word_count(F.col("text")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences. A null or empty text is one id; repeated rows are documents of their own."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("language_id", language_stage), ("quality_rules", quality_stage), ("minhash_dedup", dedup_stage), ("mix_sources", mixing_stage), ("pack_sequences", packing_stage)]
#: No SQL can express trained models and tokenizers. Tests compare each stage's operator with a plain version: language (code
#: lengths), quality rules, near duplicates, mixing and packing (tests/llm/test_operators.py, test_odd_rows.py, test_packing.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
