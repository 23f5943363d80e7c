"""Collocations, importance resampling and the language model against brute force."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelearn.llm import blocks, hmm, phrases, queries, resampling
from test_llm_tables import DOCS, documents, prose

OPERATORS = {
    "phrases": lambda d: phrases.mine_phrases(d, least=2),
    "resampling": lambda d: resampling.resample(d, d.select("text")),
    "scores": hmm.score_texts,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", ["resampling", "scores"])
def test_odd_rows_are_all_kept(spark, name):
    rng = random.Random(3)
    long = prose(rng, 30_000)
    texts = [None, "", " \n\t", "one", long, long, "x" * 50_000, prose(rng, 40), prose(rng, 40), "# % 5"]
    ids = [0, 1, 2, 3, 4, 4, None, None, 8, 8]
    docs = documents(spark, texts, [None] * 10, [None, "en", "fr"] + ["en"] * 7, ids)
    docs = docs.selectExpr("*", "1 as n", "2 as block", "'k' as word", "3 as place", "'c' as c", "4 as ids", "0 as rank", "5 as row")
    found = OPERATORS[name](docs).select("doc_id").collect()
    assert Counter(r[0] for r in found) == Counter(ids)


def test_packed_numbers_come_back():
    for values in ([], [0], [1, 2, 70_000, 2**31 - 1]):
        assert blocks.unpack(blocks.pack(np.array(values, dtype=np.int32))).tolist() == values


# --- collocations -----------------------------------------------------------


def plain_phrases(rows, least, inside, top):
    runs, out = {}, []
    for lang, text in rows:
        found = runs.setdefault(lang or "und", Counter())
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for sep in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(sep, "\0BREAK\0")
        for piece in text.split("\0BREAK\0"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            for k in (1, 2, 3):
                found.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in runs.items():
        n = sum(v for w, v in f.items() if len(w) == 1)
        kept = []
        for w, a in f.items():
            if len(w) == 1 or a < least:
                continue
            if any(len(v) == 3 and b >= least and w in (v[:2], v[1:]) and 100 * b >= inside * a for v, b in f.items() if len(w) == 2):
                continue
            score, k = min((1_000_000 * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (s, a, w, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, w.decode(), -a, left, right, n, -s))
    return sorted(out)


def awkward_texts(rng, n):
    words = ["New", "york", "city", "the", "é", "\x1c", "of", " ", "x", " "] + [f"w{k}" for k in range(30)]
    joins = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "!"]
    return ["".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


@pytest.mark.parametrize("least, inside, top", [(2, 50, 2_000), (5, 90, 20)])
def test_phrases_are_those_of_a_plain_count(spark, least, inside, top):
    rng = random.Random(9)
    texts = awkward_texts(rng, 60) + [None, "", "new york city " * 400]
    langs = [rng.choice(["en", None, "und", "fr"]) for _ in texts]
    docs = documents(spark, texts, langs=langs).repartition(5)
    found = phrases.mine_phrases(docs, least, inside, top).collect()
    assert sorted(map(tuple, found)) == plain_phrases(zip(langs, texts), least, inside, top)


def test_small_containers_and_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(10)
    streams = [np.array([rng.randrange(40) for _ in range(3_000)]) for _ in range(3)]
    expected = Counter()
    trie, runs = phrases.HatTrie(41, burst=8, spill=200), Counter()

    def drain(upto):
        for first, rest, n in trie.runs(upto):
            assert sorted(zip(first.tolist(), rest.tolist())) is not None
            for f, r, k in zip(first.tolist(), rest.tolist(), n.tolist()):
                runs[f, r] += k

    for s in streams:
        phrases.count_stream(trie, s)
        for a, b in zip(s, s[1:]):
            if a and b:
                expected[a, b * 41] += 1
        for a, b, c in zip(s, s[1:], s[2:]):
            if a and b and c:
                expected[a, b * 41 + c] += 1
        assert trie.nodes
        if trie.full():
            drain(100)
            assert trie.entries <= 100
    drain(0)
    assert trie.entries == 0 and runs == expected


def test_subtrees_are_spilled_sorted():
    trie = phrases.HatTrie(50, burst=4)
    phrases.count_stream(trie, np.array([3, 2, 9, 1, 3, 2, 8, 3, 5, 4, 3, 1, 2, 3, 2, 9] * 3))
    for first, rest, _ in trie.runs():
        for head in set(first.tolist()):
            own = rest[first == head]
            assert (np.diff(own) > 0).all()


def test_wide_dictionaries_are_counted_alike():
    a, b = np.array([5, 5, 2, 5]), np.array([7, 7, 1, 6])
    packed, sorted_ = phrases._distinct(a, b, 10), phrases._distinct(a, b, 1 << 22)
    assert all((x == y).all() for x, y in zip(packed, sorted_))


# --- importance resampling --------------------------------------------------


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if ord(c) >= 128 or "0" <= c <= "9" or "a" <= c <= "z":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_runs_have_the_crc_of_their_own_bytes(longest):
    shifts = resampling.Shifts()
    rng = random.Random(4)
    texts = ["", "...", "One", "a" * 5_000 + " Zürich " + "b" * 70_000, prose(rng, 300) + " Ä-ß \U0001f600x y"]
    for text in texts:
        words = plain_words(text)
        n, found = resampling._text_features(text.encode(), longest, shifts)
        assert n == len(words)
        for k in range(1, longest + 1):
            runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
            got = found[k - 1].tolist() if k <= len(found) else []
            assert got == [zlib.crc32(r.encode()) for r in runs]


def test_draw_is_the_plain_one(spark):
    import hashlib

    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(5, 60), 50) for _ in range(120)] + [None, "", "same words " * 15, "same words " * 15]
    target = [prose(rng, 30, 10) for _ in range(10)] + [None]

    def buckets(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 500 for k in (1, 2) for i in range(len(w) - k + 1)]

    raw, aim = Counter(b for t in texts for b in buckets(t)), Counter(b for t in target for b in buckets(t))
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1.0) * (s_all + 500.0) / ((raw[b] + 1.0) * (t_all + 500.0))))
    expected = {}
    for i, t in enumerate(texts):
        found = buckets(t)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        expected[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    enough = sorted((i for i, t in enumerate(texts) if len(plain_words(t)) >= 20), key=lambda i: (-expected[i][2], i))
    for rank, i in enumerate(enough[: 30 * len(enough) // 100], 1):
        expected[i][3] = rank
    docs = documents(spark, texts).repartition(4)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(docs, aims, buckets=500, percent=30).collect()
    assert {r["doc_id"]: list(r[1:]) for r in found} == expected


def test_ranks_are_one_each_where_rows_are_equal(spark):
    rows = [(None, "a b " * 15)] * 40 + [(5, "a b " * 15)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = resampling.resample(docs, docs).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 21))
    assert len(found) == 80


# --- language model ---------------------------------------------------------


def small_chain(rng, words, states):
    start, moves = rng.random(states), rng.random((states, states))
    sums, counts = rng.random((words, states)) * 5, rng.integers(0, 6, words).astype(float)
    return hmm.Chain(
        start / start.sum(), moves / moves.sum(1, keepdims=True), sums.sum(0), int(counts.sum()), int((counts > 0).sum())
    ), counts, sums


def test_likelihood_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    chain, counts, sums = small_chain(rng, 7, 3)
    emit, _ = chain.emissions(counts, sums)
    texts = [rng.integers(0, 7, n) for n in (1, 4, 6, 2)]
    for chosen, batch in hmm.batches_of(texts, 6):
        for i, log in zip(chosen, hmm.log_probabilities(chain, batch, emit)):
            total = 0.0
            for path in itertools.product(range(3), repeat=len(texts[i])):
                p = chain.start[path[0]] * emit[texts[i][0], path[0]]
                for a, b, w in zip(path, path[1:], texts[i][1:]):
                    p *= chain.moves[a, b] * emit[w, b]
                total += p
            assert log == pytest.approx(math.log10(total), abs=1e-12)


def plain_expected(chain, emit, texts, words):
    states = len(chain.start)
    seen, moves, starts = np.zeros((words, states)), np.zeros((states, states)), np.zeros(states)
    for text in texts:
        paths = []
        for path in itertools.product(range(states), repeat=len(text)):
            p = chain.start[path[0]] * emit[text[0], path[0]]
            for a, b, w in zip(path, path[1:], text[1:]):
                p *= chain.moves[a, b] * emit[w, b]
            paths.append((path, p))
        total = sum(p for _, p in paths)
        for path, p in paths:
            starts[path[0]] += p / total
            for w, k in zip(text, path):
                seen[w, k] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
    return seen, moves, starts


@pytest.mark.parametrize("step", [1 << 18, 3])
def test_expected_counts_are_those_over_all_paths(monkeypatch, step):
    monkeypatch.setattr(hmm, "STEP_TOKENS", step)
    rng = np.random.default_rng(2)
    chain, counts, sums = small_chain(rng, 6, 3)
    emit, _ = chain.emissions(counts, sums)
    texts = [rng.integers(0, 6, n) for n in (1, 5, 7, 7, 3)]
    batch = next(b for _, b in hmm.batches_of(texts, 100))
    for got, wanted in zip(hmm.expected(chain, batch, emit, 6), plain_expected(chain, emit, texts, 6)):
        assert got == pytest.approx(wanted, abs=1e-10)


def test_words_of_a_state_are_a_distribution():
    chain, counts, sums = small_chain(np.random.default_rng(3), 9, 4)
    sums[counts == 0] = 0
    chain = hmm.Chain(chain.start, chain.moves, sums.sum(0), chain.tokens, chain.distinct)
    known = counts > 0
    emit, _ = chain.emissions(np.append(counts[known], 0), np.append(sums[known], np.zeros((1, 4)), axis=0))
    assert emit.sum(axis=0) == pytest.approx(np.ones(4))


def test_every_round_makes_the_training_texts_likelier(spark):
    rng = random.Random(8)
    texts = [prose(rng, 30, 20) if i % 2 else " ".join(f"v{rng.randrange(20)}" for _ in range(30)) for i in range(80)]
    docs = documents(spark, texts).repartition(3)
    sums = []
    for rounds in (1, 2, 4):
        rows = hmm.score_texts(docs, states=3, rounds=rounds).collect()
        sums.append(sum(r["score"] for r in rows if not r["held_out"]))
        base = sum(r["base_score"] for r in rows if not r["held_out"])
    assert base < sums[0] < sums[1] < sums[2]


def test_scores_of_the_query(spark, sf):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    words = {}
    for i, r in rows.items():
        words[i] = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "").translate(
            {c: 32 for c in range(9, 14)}
        ).split(" ") if w] + [""]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in rows}
    counts = Counter(w for i, t in words.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    found = queries.QUERIES["op13_lm_scores"](spark, sf).collect()
    assert len(found) == len(rows)
    for r in found:
        t = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(t), n)
        assert r["n_known"] == sum(w in counts for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), abs=1e-6)
    fresh = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in fresh) > sum(r["base_score"] for r in fresh)


def test_slices_and_groups_of_any_size_learn_alike(spark, monkeypatch):
    rng = random.Random(9)
    docs = documents(spark, [prose(rng, 60, 60) for _ in range(60)]).repartition(3)

    def scores():
        return {r["doc_id"]: r["score"] for r in hmm.score_texts(docs, states=3).collect()}

    monkeypatch.setattr(hmm, "SLICE_WORDS", 7)
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 300)
    whole = scores()
    monkeypatch.setattr(hmm, "GROUP_WORDS", 20)
    assert scores() == pytest.approx(whole, rel=1e-4)
    # Other blocks round their counts elsewhere, nothing more.
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 4_000_000)
    assert scores() == pytest.approx(whole, rel=1e-2)


def test_shares_as_they_travel():
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 9, 40)
    sums = rng.random((40, 3)) * counts[:, None] / 3
    back = hmm._unpack_shares(hmm._pack_shares(hmm._shares(sums, counts)), 3) * (counts[:, None] / 255)
    assert np.abs(back - sums).max() <= counts.max() / 510 + 1e-12
    index = np.unique(rng.integers(0, 10**6, 500))
    assert hmm._index(hmm._gaps(index)).tolist() == index.tolist()
    assert hmm._index(hmm._gaps(index[:0])).tolist() == []


def test_blocks_of_any_size_give_the_same_base(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(3)
    small = blocks.encode_blocks(docs, hmm.words_and_end, b"", ["doc_id"], tokens=500)
    large = blocks.encode_blocks(docs, hmm.words_and_end, b"", ["doc_id"])
    count = lambda b: b.where("place is not null").groupBy("word").agg(F.sum("n").alias("n"))
    assert count(small).exceptAll(count(large)).count() == 0
    assert small.select("block").distinct().count() > large.select("block").distinct().count()
