"""Tables the queries run on and the shared derivations from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelearn.sources.readers import read_source


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_source(spark, f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, and zero without a sign, so that two engines can be compared."""
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def gappy_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with gaps: every 7th value and every 11th type is missing."""
    e = table(spark, folder, "events")
    return e.select(
        "event_id",
        "user_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
    )


GAPPY_EVENTS = """gappy AS (
  SELECT event_id, user_id,
         CASE WHEN event_id % 7 <> 0 THEN value END AS value,
         CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type
  FROM events)"""


def doubled_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric line items with a copy of the price, scaled, and a constant."""
    li = table(spark, folder, "lineitem")
    return li.select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        (F.col("l_extendedprice") * 2 + 1).alias("price2"),
        F.lit(5.0).alias("const"),
        "l_returnflag",
    )


DOUBLED_LINEITEM = """doubled AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax,
         l_extendedprice * 2 + 1 AS price2, 5.0::DOUBLE AS const, l_returnflag
  FROM lineitem)"""


def documents_measured(spark: SparkSession, folder: str) -> DataFrame:
    """Size and word statistics of every whole document."""
    d = table(spark, folder, "documents")
    words = F.split("text", " ")
    return d.select(
        "doc_id",
        "lang",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(words).cast("double").alias("words"),
        F.size(F.array_distinct(words)).cast("double").alias("distinct_words"),
        F.length(F.regexp_replace("text", "[A-Za-z]+", "")).cast("double").alias("non_letters"),
    ).select(
        "*",
        (F.col("distinct_words") / F.col("words")).alias("distinct_share"),
        (F.col("non_letters") / F.greatest(F.col("n_chars"), F.lit(1.0))).alias("non_letter_share"),
    )


DOCUMENT_FEATURES = ["n_chars", "words", "distinct_words", "non_letters", "distinct_share", "non_letter_share"]


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Document statistics with the quality label of the labelled ones."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return documents_measured(spark, folder).join(labels, "doc_id")


def judged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with the verdicts of two rules and a score."""
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    return docs.join(labels, "doc_id").select(
        "*",
        (F.col("n_chars") > 500).cast("int").alias("long_rule"),
        (F.col("n_chars") > 200).cast("int").alias("short_rule"),
        (F.col("n_chars") / (F.col("n_chars") + 500)).alias("score"),
    )


JUDGED_DOCUMENTS = """judged AS (
  SELECT doc_id, lang, n_chars::DOUBLE AS n_chars, quality, toxic,
         (n_chars > 500)::INTEGER AS long_rule, (n_chars > 200)::INTEGER AS short_rule,
         n_chars::DOUBLE / (n_chars::DOUBLE + 500) AS score
  FROM documents JOIN labels USING (doc_id))"""


def estimated_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with two simple estimates of their price."""
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_extendedprice").alias("label"),
        (F.col("l_quantity") * 2000).alias("by_quantity"),
        F.lit(52000.0).alias("flat"),
        "l_linenumber",
    )


ESTIMATED_PRICES = """estimated AS (
  SELECT l_extendedprice AS label, l_quantity * 2000 AS by_quantity, 52000.0::DOUBLE AS flat, l_linenumber
  FROM lineitem)"""
