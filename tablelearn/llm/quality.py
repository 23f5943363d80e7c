"""Quality rules on documents, and verdicts on the hosts they come from."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelearn.functions.columns import quoted
from tablelearn.llm.common import BLANKS, chunks, window_hashes, word_hashes, word_spans
from tablelearn.session import fit_table, store

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
WINDOW = 3

# A host goes when its shrunk failure rate is above this.
HOST_RATE = 0.5

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_BLANK_TEXT = BLANKS.decode()


def measure_text(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, and words in windows of three found twice."""
    if not text:
        return 0, 0, 0, 0, 0
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends = word_spans(data)
    blanks = sum(map(text.count, _BLANK_TEXT))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(_BLANK_TEXT)]
    windows = window_hashes(word_hashes(data, starts, ends), WINDOW)
    covered = np.zeros(len(starts), dtype=bool)
    if len(windows):
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(len(windows), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(WINDOW):
            covered[k : k + len(windows)] |= twice
    return len(starts), len(text) - blanks, symbols, len(lines) - len(set(lines)), int(covered.sum())


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures of every whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = [measure_text(t) for t in part.column("text").to_pylist()]
                found = np.array(rows, dtype=np.int64).reshape(-1, 5)
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("source"), *[pa.array(found[:, i]) for i in range(5)]],
                    names=["doc_id", "source", *[m.split()[0] for m in MEASURES.split(", ")]],
                )

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "source")}
    return docs.select("doc_id", "source", "text").mapInArrow(
        run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, {MEASURES}"
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class BetaPrior:
    """Prior of the failure rates of hosts, as earlier failures and passes."""

    failures: float
    passes: float


def beta_prior(hosts: DataFrame) -> BetaPrior:
    """Fit by moments to the rates of all hosts (columns n and failed).

    Hosts weigh alike. Where the rates do not vary, the prior is worth a thousand
    documents; where they vary more than any beta allows, it is worth one.
    """
    rate = F.col("failed") / F.col("n")
    mean, variance, count = hosts.agg(F.avg(rate), F.var_pop(rate), F.count(F.lit(1))).first()
    if not count:
        return BetaPrior(0.5, 0.5)
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    weight = mean * (1 - mean) / variance - 1 if variance else 1000.0
    weight = min(max(weight, 1.0), 1000.0)
    return BetaPrior(mean * weight, (1 - mean) * weight)


def host_verdicts(measured: DataFrame, most: float = HOST_RATE) -> DataFrame:
    """source, n, failed, host_rate (shrunk towards the prior), host_kept.

    Hosts' sums are formed before any shuffle, so a host with most of the
    documents is one row per task. A null source is no host.
    """
    hosts = (
        measured.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    )
    prior = beta_prior(hosts)
    shrunk = (F.col("failed") + prior.failures) / (F.col("n") + prior.failures + prior.passes)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", F.col("host_rate") <= most)


def judge(docs: DataFrame, most: float = HOST_RATE) -> DataFrame:
    """Measures and verdict of every document: doc_id, source, the measures, base_failed, host_rate, kept.

    A document goes if it fails the base rules or its host goes; one without a
    source is judged by itself. Repeated rows are judged each. The hosts' table is
    broadcast if it was found small; else it is joined by shuffle, with the rows of
    a host spread over the salts that its number of rows asks for.
    """
    measured = store(measure(docs).withColumn("base_failed", base_failed()), "measured")
    hosts = host_verdicts(measured, most)
    fitted = fit_table(hosts)
    if fitted.small:
        joined = measured.join(fitted.hinted().drop("n", "failed"), "source", "left")
    else:
        joined = spread_join(measured, fitted.df.drop("failed"), "source")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).drop("host_kept")


# Rows of one key that a task of a join may get.
SALT_ROWS = 200_000
# Only keys with more than this share of all rows are split, so at most so many are.
MOST_SPLIT = 10_000


def spread_join(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Left join on ``key`` with a table that has one row and the number of rows ``n`` per key.

    A key that holds more than 1 / MOST_SPLIT of the rows is split: its value is
    copied once per salt, and its rows draw a salt. There are less than MOST_SPLIT
    such keys, so their numbers of salts may be broadcast.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    salts = F.when(F.col("n") * MOST_SPLIT > total, F.ceil(F.col("n") / SALT_ROWS)).otherwise(1).cast("int")
    salted = values.withColumn("__salts", salts)
    large = salted.where("__salts > 1").select(key, "__salts")
    draw = F.pmod(F.xxhash64(*[quoted(c) for c in rows.columns]), F.coalesce("__salts", F.lit(1))).cast("int")
    marked = rows.join(F.broadcast(large), key, "left").withColumn("__salt", draw).drop("__salts")
    copies = salted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("n", "__salts")
    return marked.join(copies, [key, "__salt"], "left").drop("__salt")
