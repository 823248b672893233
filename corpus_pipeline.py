"""Five stages from raw documents to packed sequences, each a DataFrame of all that the one before kept.

run() writes each stage as Parquet into the shared folder and reads it again. ORACLE_SQL is None: forward-backward,
Kneser-Ney smoothing and packing can't be said in SQL; the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import langid, packing, pii, simhash, toxicity
from bitloom.llm.base import apart, drop_settled, settle, table

#: A document whose words hardly agree on any language is rejected below this share of posterior mass.
LEAST_SHARE = 0.3
#: Of the sets of 5-word shingles.
SIMILARITY = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language."""
    docs, cols, back = apart(docs, "lang_pred", "score", "n_words", "switches")
    found = langid.identify(docs, cols)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*back)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not toxic."""
    docs, cols, back = apart(docs, "score")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model, cols).where("score < 0.5").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares 0.8 or more of its 5-word shingles."""
    return simhash.deduplicate(docs, SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; personal spans become placeholders, and n_chars follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack(packing.pieces(docs, packing.tokenizer_path()))


STAGES = [("language_id", language), ("toxicity", toxic), ("simhash", near_duplicates), ("pii", personal_data), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        if k:  # the stage before is read no more
            drop_settled(before)
    return docs
