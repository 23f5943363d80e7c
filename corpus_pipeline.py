"""From documents to encoded training rows, stage by stage.

Every stage takes what the one before it kept, as a table in the columns of
``documents``; the last returns the encoded rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelearn.functions.columns import quoted
from tablelearn.llm import bpe, jaccard, language, mixing, secrets
from tablelearn.session import store

# A document whose language the model holds less likely than this is rejected.
LEAST_SCORE = 0.5


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars counted again where the table has it."""
    names = [
        F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else quoted(c)
        for c in docs.columns
    ]
    return out.select(*names)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents of no language: without a letter, with no language that is at least likely, or out of
    the range of the texts that language was learned from."""
    model = language.fit_languages(docs)
    return language.of_known_language(docs, model, language.fit_ranges(docs, model), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates: the one with the smallest doc_id.

    Rows that share a doc_id or have none are documents like others.
    """
    return jaccard.one_of_each_class(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts; all documents stay."""
    return _same_columns(secrets.mask_secrets(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their target weights."""
    return mixing.replicate(docs).select(*[quoted(c) for c in docs.columns])


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes."""
    return bpe.encode(docs, decoded=True).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("encode", encode_texts),
]

# No SQL can express the language model or the vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
