"""The corpus pipeline: language, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes the documents that the stage before it kept, works on all of them with one operator, and gives documents
back; the last one gives their tokens. Run over Parquet, stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, decontam, langid, nearcopies, pii
from rasterloom.llm.common import new_folder
from rasterloom.llm.queries import TOKENIZER, pseudonym_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes where its words are in no known language with a mean posterior of at least this. Of sf0.1 none goes; of
#: short texts in other scripts, in random letters and in unrelated languages, 0.9 or more do (tests/llm/test_language.py).
SURE = 0.75


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter, or whose words are in none of them, go."""
    known = langid.predict(docs.select(*COLUMNS), langid.train(docs, other=True))
    unsure = (F.col("score") > 0) & (F.col("score") < SURE)
    return known.where((F.col("lang_pred") != langid.UNKNOWN) | unsure).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id: SimHash, then Jaccard 0.8 of 5-word shingles.

    Rows without an id stay only where no row of their group has one, one of each group.
    """
    return nearcopies.one_of_each(docs.select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.leaks(docs.select(*COLUMNS), items).where(F.size("leaks") == 0).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced by pseudonyms; n_chars follows the text."""
    new = pii.pseudonyms(docs.select(*COLUMNS), pseudonym_key(spark))
    return new.withColumn("n_chars", F.when(F.col("n_private") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded documents, each with the digest of its decoded text."""
    return bpe.encode_documents(docs.select(*COLUMNS), TOKENIZER, keep=["doc_id", "lang", "source"], ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: A trained model, XXH64 and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
