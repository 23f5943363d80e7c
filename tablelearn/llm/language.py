"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelearn.functions.columns import quoted
from tablelearn.functions.ordering import order_statistics
from tablelearn.llm.common import chunks, mixed
from tablelearn.session import store

UNDETERMINED = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
# A text is of no learned language if its mean log probability of an n-gram is further below the median of
# the language's fit texts than RANGES times their lowest hundredth is, and than the deviation of one n-gram;
# by chance, a text of n n-grams may fall short by DEVIATIONS of their mean besides.
LOW, RANGES, DEVIATIONS = 0.01, 4.0, 6.0
# Characters handled at a time, which bounds a task's memory for very long texts.
PIECE = 1 << 18


def held_out(key: str = "doc_id") -> Column:
    """True for the quarter of the keys that nothing is learned from; false for a null key."""
    return F.coalesce(F.crc32(quoted(key).cast("string")) % 4 == 2, F.lit(False))


class Grams:
    """Turns texts into the buckets of their character n-grams."""

    def __init__(self, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS):
        self.buckets, self.orders = buckets, orders
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)

    def pieces(self, text: str | None) -> Iterator[np.ndarray]:
        """Buckets of a text piece by piece; nothing if it has no letter.

        Text is lower-cased; what is no letter counts as one blank.
        """
        longest, rest = max(self.orders), np.zeros(0, dtype=np.uint32)
        for start in range(0, len(text or ""), PIECE):
            part = text[start : start + PIECE].lower().encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(part, dtype="<u4")
            is_letter = self.letter[codes]
            if start == 0 and not is_letter.any() and not any(c.isalpha() for c in text):
                return
            codes = np.where(is_letter, codes, 32).astype(np.uint32)
            before = np.concatenate([rest[-1:] if len(rest) else np.array([0], np.uint32), codes[:-1]])
            codes = np.concatenate([rest, codes[(codes != 32) | (before != 32)]]).astype(np.uint64)
            found = []
            for n in self.orders:
                count = len(codes) - n + 1
                # n-grams that end in the carried part were counted with the piece before.
                skip = max(0, len(rest) - n + 1)
                if count > skip:
                    grams = np.full(count - skip, n, dtype=np.uint64)
                    for k in range(n):
                        grams = grams * np.uint64(0x110000) + codes[skip + k : k + count]
                    found.append((mixed(grams) % np.uint64(self.buckets)).astype(np.int64))
            if found:
                yield np.concatenate(found)
            rest = codes[len(codes) - longest + 1 :].astype(np.uint32) if longest > 1 else rest

    def counts(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(self.buckets, dtype=np.int64)
        for text in texts:
            for found in self.pieces(text):
                total += np.bincount(found, minlength=self.buckets)
        return total


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities: one row per bucket, one column per language."""

    languages: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray
    orders: tuple[int, ...] = ORDERS
    # Per language: rows it was learned from by shares, and n-grams counted.
    sizes: tuple[int, ...] = ()
    totals: np.ndarray | None = None

    def judge(self, grams: Grams, text: str | None) -> tuple[int, float, float, int] | None:
        """(number of the best language, its probability, mean log probability of an n-gram under it, n-grams)."""
        if not self.languages:
            return None
        scores, seen = self.prior.copy(), 0
        for found in grams.pieces(text):
            scores += self.weights[found].sum(axis=0)
            seen += len(found)
        if not seen:
            return None
        shares = np.exp(scores - scores.max())
        best = int(scores.argmax())
        return best, float(shares[best] / shares.sum()), float(scores[best] - self.prior[best]) / seen, seen

    def predict(self, grams: Grams, text: str | None) -> tuple[str, float]:
        found = self.judge(grams, text)
        return (UNDETERMINED, 0.0) if found is None else (self.languages[found[0]], found[1])


@dataclass(frozen=True)
class Ranges:
    """Per language the least mean log probability of an n-gram of long texts, and the deviation of one n-gram."""

    floor: np.ndarray
    deviation: np.ndarray

    def hold(self, language: int, mean: float, n: int) -> bool:
        return mean >= self.floor[language] - DEVIATIONS * self.deviation[language] / np.sqrt(n)


def _fit_texts(docs: DataFrame, sizes: dict[str, int], fit_rows: int | None, seed: int) -> DataFrame:
    """lang, text of all rows that may teach, or if asked for of about ``fit_rows`` of each language, chosen by a hash of
    key, text and place in the table: rows that share a key, have none or are equal are drawn each for itself."""
    if fit_rows is None:
        return _known(docs).select("lang", "text")
    share = F.create_map(*[F.lit(x) for lang in sizes for x in (lang, min(1.0, fit_rows / sizes[lang]))])
    # A hash in [0, 1) for each key.
    hashed = F.xxhash64("doc_id", "text", F.monotonically_increasing_id(), F.lit(seed))
    draw = F.pmod(hashed, F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = docs.select("doc_id", "lang", "text", draw.alias("draw"))
    return _known(drawn).where(F.col("draw") < share[F.col("lang")]).select("lang", "text")


def _known(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())


def fit_languages(docs: DataFrame, fit_rows: int | None = None, buckets: int = BUCKETS, seed: int = 7) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of the rows that are not held out.

    Shares of the languages and counts of n-grams come from all these rows; with
    ``fit_rows`` the counts are those of about so many texts of each language. Rows
    whose language or text is null teach nothing. A table without such rows gives
    a model that determines nothing.
    """
    sizes = {r["lang"]: r["n"] for r in _known(docs).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((buckets, 0)))
    chosen = _fit_texts(docs, sizes, fit_rows, seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, totals = Grams(buckets), {}
        for batch in batches:
            for part in chunks(batch):
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for lang in set(langs):
                    found = grams.counts([t for t, name in zip(texts, langs) if name == lang])
                    totals[lang] = totals[lang] + found if lang in totals else found
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.record_batch(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])],
                names=["lang", "bucket", "n"],
            )

    # At most buckets x languages rows reach the driver.
    summed = (
        chosen.mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = np.zeros((buckets, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    columns = [place[x] for x in summed["lang"].to_pylist()]
    counts[summed["bucket"].to_numpy(), columns] = summed["n"].to_numpy()
    weights = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * buckets)
    prior = np.log(np.array([sizes[x] for x in languages], dtype=float)) - np.log(sum(sizes.values()))
    return LanguageModel(
        languages, prior, weights, sizes=tuple(sizes[x] for x in languages), totals=counts.sum(axis=0)
    )


def fit_ranges(docs: DataFrame, model: LanguageModel, fit_rows: int | None = None, seed: int = 7) -> Ranges:
    """What is usual for the texts that ``fit_languages`` learned from, with the same arguments.

    Every text is measured by the counts of the others, since a model knows the texts
    it was made of too well. Fewer than a hundredth of wrongly labelled texts do not
    move the ranges. A language with a single text has no range and holds everything.
    """
    shape = len(model.languages)
    ranges = Ranges(np.full(shape, -np.inf), np.zeros(shape))
    if not shape:
        return ranges
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        grams = Grams(len(known.weights), known.orders)
        place = {lang: i for i, lang in enumerate(known.languages)}
        extra = SMOOTHING * len(known.weights)
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    own = grams.counts([text])
                    used, k = np.flatnonzero(own), place[lang]
                    own, n = own[used], int(own.sum())
                    if not n:
                        continue
                    all_counts = np.exp(known.weights[used, k]) * (known.totals[k] + extra)
                    logs = np.log(np.maximum(all_counts - own, SMOOTHING)) - np.log(known.totals[k] - n + extra)
                    mean = float((own * logs).sum() / n)
                    rows.append((k, mean, float((own * (logs - mean) ** 2).sum() / n)))
                which, means, variances = zip(*rows) if rows else ((), (), ())
                yield pa.record_batch(
                    [pa.array(which, pa.int32()), pa.array(means, pa.float64()), pa.array(variances, pa.float64())],
                    names=["k", "mean", "variance"],
                )

    chosen = _fit_texts(docs, dict(zip(model.languages, model.sizes)), fit_rows, seed)
    found = store(chosen.mapInArrow(measure, "k int, mean double, variance double"), "language-ranges")
    sizes = {r["k"]: r for r in found.groupBy("k").agg(F.count("mean").alias("n"), F.avg("variance").alias("v")).collect()}
    own = {f"m{k}": r["n"] for k, r in sizes.items() if r["n"] > 1}
    # The middle one or two of a language's texts, and the highest of its lowest hundredth, counted from one.
    ranks = {c: sorted({(n + 1) // 2, n // 2 + 1, int(np.floor(LOW * (n - 1))) + 1}) for c, n in own.items()}
    wide = found.select(*[F.when(F.col("k") == int(c[1:]), F.col("mean")).alias(c) for c in own])
    values = order_statistics(wide, ranks, own) if own else {}
    for c, n in own.items():
        k = int(c[1:])
        middle = (values[c, (n + 1) // 2].value + values[c, n // 2 + 1].value) / 2
        low = values[c, int(np.floor(LOW * (n - 1))) + 1].value
        ranges.deviation[k] = np.sqrt(sizes[k]["v"])
        ranges.floor[k] = middle - max(RANGES * (middle - low), ranges.deviation[k])
    return ranges


def of_known_language(docs: DataFrame, model: LanguageModel, ranges: Ranges, least: float) -> DataFrame:
    """The rows, with all their columns, whose text is of a language of the model.

    The best language must have a probability of at least ``least`` and the text must
    be in the range of that language. A text that is null or without a letter goes.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, ranges))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, usual = shared.value
        grams = Grams(len(known.weights), known.orders)
        for batch in batches:
            for part in chunks(batch):
                found = [known.judge(grams, text) for text in part.column("text").to_pylist()]
                stay = [f is not None and f[1] >= least and bool(usual.hold(f[0], *f[2:])) for f in found]
                yield part.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def identify(docs: DataFrame, model: LanguageModel, keep: bool = False) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score (probability under the model).

    A text that is null or without a letter is ``und`` with score 0. With ``keep``
    all columns of ``docs`` stay in front, whatever they are called besides
    lang_pred and score, which must be free. The model is broadcast; its size is
    buckets x languages whatever the number of texts.
    """
    if keep and {"lang_pred", "score"} & set(docs.columns):
        raise ValueError("lang_pred and score must not be columns of the documents")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        grams = Grams(len(known.weights), known.orders)
        for batch in batches:
            for part in chunks(batch):
                found = [known.predict(grams, text) for text in part.column("text").to_pylist()]
                columns = part.columns if keep else [part.column("doc_id")]
                names = part.schema.names if keep else ["doc_id"]
                yield pa.record_batch(
                    [*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=[*names, "lang_pred", "score"],
                )

    chosen = docs if keep else docs.select("doc_id", "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema if keep else chosen.select("doc_id").schema)]
    return chosen.mapInArrow(score, ", ".join([*fields, "lang_pred string", "score double"]))
