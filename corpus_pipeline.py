"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontamination, packing, pii, quality, simhash
from lakeloom.llm.queries import PII_KEY, table, tokenizer_path
from lakeloom.llm.shared import written

#: Bits in which fingerprints of two documents' sets of words may differ to be candidates, and fingerprints of each
#: document. Of all pairs whose five-word shingles have a Jaccard similarity of 0.8 or more, these find 46 of 48 at sf0.1 and 99 % on the check tables.
RADIUS, PRINTS = 6, 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity, and that of their worst few characters, is within their language's limits.

    Null and empty texts stay, as all do where no labelled text is trusted. Null languages share the pooled limits. Repeated rows
    and null ids keep their rows; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id: five-word shingles alike by 0.8 or more.

    Null and empty texts are copies of one another. Rows with null ids stay; rows equal in id and text count once; an empty table stays empty.
    """
    return simhash.keep_one(docs, words=1, radius=RADIUS, repeats=False, shingle=5, similarity=0.8, prints=PRINTS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other names and numbers.

    Null and empty texts stay; repeated rows stay or go together; without items all stay; an empty table stays empty.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the new text.

    Null and empty texts stay as they are, as n_chars does where nothing is replaced. Each row keeps its row; an empty table stays empty.
    """
    found = "_entities_of_pipeline"
    out = pii.replace_pii(docs, PII_KEY, found)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: where each piece of each document lies, and its ids.

    Null and empty texts are one token, the end id. Each row is packed on its own; an empty table gives no rows.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL cannot express perplexities, fingerprints and tokenizers; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
