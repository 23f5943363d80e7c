"""The pipeline, stage by stage, each held against its own input."""

import base64
import random
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablelearn.llm import bpe, jaccard, language, secrets


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out.append((name, docs))
    return dict(out)


def test_stages_keep_the_columns(stages, spark, sf):
    columns = stages["documents"].dtypes
    for name in ("language", "near_duplicates", "secrets", "mix"):
        assert stages[name].dtypes == columns


def test_languages_reject_only_texts_without_one(stages):
    before = {r["doc_id"]: r["text"] for r in stages["documents"].collect()}
    after = {r["doc_id"] for r in stages["language"].collect()}
    for doc_id in set(before) - after:
        assert not any(c.isalpha() for c in before[doc_id])


def test_one_document_of_each_class_stays(stages):
    before = [(r["doc_id"], r["text"]) for r in stages["language"].collect()]
    after = {r["doc_id"] for r in stages["near_duplicates"].collect()}
    classes = {r["doc_id"]: r["class_id"] for r in jaccard.near_duplicates(stages["language"]).collect()}
    assert Counter(classes[i] for i in after) == Counter(set(classes.values()))
    assert len({t for i, t in before if i in after}) == len(after)


def test_no_secret_is_left(stages):
    scanner = secrets.Scanner(secrets.BASE_RULES)
    before = {r["doc_id"]: r["text"] for r in stages["near_duplicates"].collect()}
    rows = stages["secrets"].collect()
    assert {r["doc_id"] for r in rows} == set(before)
    assert not any(scanner.find([r["text"]])[0] for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    found = {i for i, t in before.items() if secrets.Scanner(secrets.RULES).find([t])[0]}
    assert {r["doc_id"] for r in rows if r["text"] != before[r["doc_id"]]} == found


def test_result_encodes_the_mix(stages, spark, sf):
    coder = bpe.ByteBpe(*bpe.vocabulary())
    texts = Counter((r["doc_id"], len(coder.encode(r["text"]))) for r in stages["mix"].collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in stages["encode"].collect()) == texts
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == texts


def test_odd_rows_pass(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string"
    rows = [(None, "some words here", None, None, None, "x"), (1, None, "en", "a", 0, None), (1, "", "en", "a", 0, None)]
    rows += [(2, "the same text " * 9, "en", "b", None, None)] * 3 + [(5, "all words are fine", "fr", None, 3, "y")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {None, 2, 5}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_texts_of_no_learned_language_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(4)
    noise = [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(80)) for _ in range(5)]
    foreign = ["日本語の文章はここにあります。" * 20, "Это русский текст, который никто не учил. " * 8, "Это русский текст", "日本語の文章"]
    foreign += noise + [base64.b64encode(rng.randbytes(600)).decode()]
    first = docs.first().asDict()
    planted = [{**first, "doc_id": 10**9 + i, "lang": None, "text": text} for i, text in enumerate(foreign)]
    both = docs.union(spark.createDataFrame(planted, docs.schema)).withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit(2))
    kept = corpus_pipeline.identify_languages(spark, both, sf)
    assert kept.columns == both.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter(r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))


def test_rows_of_one_id_or_none_are_documents(spark, sf):
    rng = random.Random(9)
    prose = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=120)) for _ in range(7)]
    near = [" ".join([*p.split()[:-1], "other"]) for p in prose]
    rows = [
        # Unrelated texts under one id, one of them near a smaller id.
        (5, prose[0]), (5, prose[1]), (5, near[2]), (1, prose[2]),
        # Without an id: unrelated texts, a copy, near copies of each other and of a row with an id.
        (None, prose[3]), (None, prose[3]), (None, prose[4]), (None, near[4]), (None, near[5]), (8, prose[5]),
        # A row twice, and rows without words.
        (9, prose[6]), (9, prose[6]), (None, ""), (3, None), (3, " "),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit("x"))
    found = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert found.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in found.collect())
    one = (None, prose[4]) if (None, prose[4]) in kept else (None, near[4])
    assert kept == Counter(
        [(5, prose[0]), (5, prose[1]), (1, prose[2]), (None, prose[3]), one, (8, prose[5]), (9, prose[6])]
        + [(None, ""), (3, None), (3, " ")]
    )


def test_language_counts_and_ranges_come_from_all_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcde ", k=rng.randint(3, 12))) + "x" for _ in range(6_000)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    model = language.fit_languages(docs.repartition(4))
    grams = language.Grams()
    known = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = grams.counts(known)
    assert len(known) > 4_400 and model.totals.tolist() == [counts.sum()]
    means, variances, extra = [], [], language.SMOOTHING * language.BUCKETS
    for text in known:
        own = grams.counts([text])
        used = np.flatnonzero(own)
        own, n = own[used], own.sum()
        logs = np.log(counts[used] - own + language.SMOOTHING) - np.log(counts.sum() - n + extra)
        means.append((own * logs).sum() / n)
        variances.append((own * (logs - means[-1]) ** 2).sum() / n)
    middle, low = np.quantile(means, 0.5), np.quantile(means, language.LOW, method="lower")
    ranges = language.fit_ranges(docs, model)
    assert ranges.deviation[0] == pytest.approx(np.mean(variances) ** 0.5)
    assert ranges.floor[0] == pytest.approx(middle - max(language.RANGES * (middle - low), ranges.deviation[0]))
