"""Operators on tables: odd rows, empty tables, clashing names, and results against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablelearn.llm import (
    bpe,
    embeddings,
    groups,
    jaccard,
    language,
    mixing,
    quality,
    queries,
    quotes,
    secrets,
    substrings,
    token_counts,
)
from tablelearn.session import store

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, langs=None, ids=None):
    n = len(texts)
    rows = [
        (
            (ids or range(n))[i],
            texts[i],
            (langs or ["en"] * n)[i],
            (sources or ["s"] * n)[i],
            None if texts[i] is None else len(texts[i]),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=400):
    return " ".join(rng.choice([f"w{k}" for k in range(words)]) for _ in range(n))


OPERATORS = {
    "secrets": secrets.scan_secrets,
    "masked": secrets.mask_secrets,
    "trees": lambda d: token_counts.edit_trees(token_counts.build_trees(d, token_counts.CLEANING)),
    "quality": quality.judge,
    "language": lambda d: language.identify(d, language.fit_languages(d)),
    "bpe": lambda d: bpe.decode(bpe.encode(d, offsets=True)),
    "bpe in one pass": lambda d: bpe.encode(d, decoded=True),
    "substrings": substrings.remove_repeats,
    "jaccard": jaccard.near_duplicates,
    "mixing": mixing.replicate,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"mixing"}))
def test_odd_rows_are_all_kept(spark, name):
    rng = random.Random(3)
    long = prose(rng, 30_000)
    texts = [None, "", " \n\t", "one", long, long, "x" * 50_000, prose(rng, 40), prose(rng, 40), "# % 5"]
    ids = [0, 1, 2, 3, 4, 4, None, None, 8, 8]
    docs = documents(spark, texts, [None, "a", "a", "b", None, "a", "a", "b", "b", "b"], [None, "en", "fr"] + ["en"] * 7, ids)
    docs = docs.selectExpr("*", "1 as n", "2 as node", "'k' as kept", "3 as spans", "'c' as cell", "4 as ids", "0 as did")
    found = OPERATORS[name](docs).select("doc_id" if name != "masked" else "text").collect()
    assert len(found) == len(texts)
    if name != "masked":
        assert Counter(r[0] for r in found) == Counter(ids)


# --- secrets, counts, BPE ---------------------------------------------------


def test_masked_rows_keep_their_columns(spark):
    docs = documents(spark, ["token = 'abcdefgh12' end", None]).selectExpr("*", "array(1, 2) as more")
    rows = secrets.mask_secrets(docs).orderBy("doc_id").collect()
    assert rows[0]["text"] == "[secret] end" or rows[0]["text"] == "[secret]' end"
    assert rows[1]["text"] is None and rows[0]["more"] == [1, 2]


def test_trees_can_be_edited_again(spark):
    docs = documents(spark, ["mail a@b.example now " * 50, "", None, "123456789012 x"])
    once = token_counts.edit_trees(token_counts.build_trees(docs, token_counts.CLEANING))
    again = token_counts.edit_trees(once.withColumn("edits", F.expr("array(named_struct('start', 0, 'end', 0, 'new', 'So '))")))
    coder = bpe.ByteBpe(*bpe.vocabulary())
    for r in again.collect():
        assert r["text"].startswith("So ")
        assert r["n_tokens"] == len(coder.encode(r["text"]))


def test_both_ways_of_decoding_give_the_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    for decoded in (bpe.decode(bpe.encode(docs)), bpe.encode(docs, decoded=True)):
        assert {r["doc_id"]: bytes(r["decoded"]) for r in decoded.collect()} == texts


def test_counts_of_the_query(spark, sf):
    coder = bpe.ByteBpe(*bpe.vocabulary())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    edited = token_counts.edit_trees(token_counts.build_trees(queries.read_table(spark, sf, "documents"), token_counts.CLEANING))
    after = {r["doc_id"]: r for r in edited.collect()}
    for r in queries.op2_token_counts(spark, sf).collect():
        assert r["n_tokens"] == len(coder.encode(texts[r["doc_id"]]))
        assert r["n_tokens_edited"] == len(coder.encode(after[r["doc_id"]]["text"]))
    assert any(r["n_edits"] for r in after.values())


# --- quality ----------------------------------------------------------------


def test_hosts_with_failing_documents_go(spark):
    good, bad = prose(random.Random(1), 80), "too short"
    texts = [good] * 30 + [bad] * 29 + [good] + [good, bad]
    sources = ["fine"] * 30 + ["poor"] * 30 + [None, None]
    rows = {r["doc_id"]: r for r in quality.judge(documents(spark, texts, sources)).collect()}
    assert all(rows[i]["kept"] for i in range(30))
    assert not rows[59]["kept"] and not rows[59]["base_failed"]
    assert rows[60]["kept"] and not rows[61]["kept"] and rows[60]["host_rate"] is None


def test_spread_join_splits_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(quality, "SALT_ROWS", 10)
    rows = spark.range(300).selectExpr("id", "if(id < 200, 'hot', concat('k', id % 50)) as key")
    values = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("value", F.length("key"))
    found = quality.spread_join(rows, values, "key").collect()
    assert len(found) == 300 and all(r["value"] == len(r["key"]) for r in found)


# --- language ---------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.fit_languages(docs, fit_rows=100))
    judged = found.join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out())
    right, total = judged.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert total > 200 and right >= 0.98 * total


def test_nothing_is_learned_from_held_out_rows(spark):
    docs = documents(spark, ["aaa"] * 40, langs=["xx"] * 40)
    marked = docs.withColumn("lang", F.when(language.held_out(), "secret").otherwise("xx"))
    assert language.fit_languages(marked).languages == ("xx",)


def test_texts_without_letters_are_undetermined(spark):
    docs = documents(spark, [None, "", "123 !?", "abc", "日本"])
    found = {r["doc_id"]: r for r in language.identify(docs, language.fit_languages(docs)).collect()}
    assert [found[i]["lang_pred"] for i in range(5)] == ["und", "und", "und", "en", "en"]
    assert found[0]["score"] == 0.0 and 0 <= found[3]["score"] <= 1


def test_pieces_of_long_texts_add_up(monkeypatch):
    text = "Der Hund, la niña! et un garçon " * 50
    whole = language.Grams().counts([text])
    monkeypatch.setattr(language, "PIECE", 7)
    assert (language.Grams().counts([text]) == whole).all()


# --- quotations -------------------------------------------------------------

MESSAGES = "conv_id long, turn long, role string, text string"


def test_nested_quotes_are_linked(spark):
    rows = [
        (1, 0, "a", "Hello all\nwho comes?"),
        (1, 1, "b", "> Hello  ALL\n> who comes?\nI do"),
        (1, 2, "c", "> > who comes?\n> I do\nMe too\n> nothing known\n"),
        (1, 3, "a", ">> Hello all\n>> who comes?\n"),
        (1, 4, "a", "no quote"),
        (2, 0, "a", None),
        (2, 1, "b", ""),
        (2, 2, "b", "> who comes?\nother conversation"),
        (None, 1, "a", "> x\ny"),
        (1, 1, "b", "> Hello  ALL\n> who comes?\nI do"),
    ]
    found = {(r["conv_id"], r["turn"]): r for r in quotes.reply_order(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert len(found) == 9
    assert found[1, 1]["parent"] == 0 and found[1, 1]["text"] == "I do"
    assert found[1, 2]["parent"] == 1 and (found[1, 2]["n_quotes"], found[1, 2]["n_linked"]) == (3, 2)
    assert found[1, 2]["text"] == "Me too" and (found[1, 2]["thread"], found[1, 2]["depth"]) == (0, 2)
    assert found[1, 3]["parent"] == 0 and found[1, 3]["text"] == ""
    assert found[1, 4]["parent"] is None and found[1, 4]["thread"] == 4
    assert found[2, 0]["text"] is None and found[2, 2]["parent"] is None
    assert found[None, 1]["text"] == "y" and found[None, 1]["thread"] is None


def test_a_quote_is_found_by_its_first_line(spark):
    rows = [(1, 0, "a", "first\nsecond\nthird"), (1, 1, "b", "> second\n> third, in other words\nyes")]
    found = quotes.link_quotes(spark.createDataFrame(rows, MESSAGES)).where("turn = 1").first()
    assert (found["parent"], found["n_quotes"], found["n_linked"]) == (0, 1, 1)


def test_long_chains_and_empty_tables(spark):
    rows = [(1, 0, "a", "m0")] + [(1, k, "a", f"> m{k - 1}\nm{k}") for k in range(1, 40)]
    found = quotes.reply_order(spark.createDataFrame(rows, MESSAGES)).collect()
    assert [r["turn"] for r in found] == list(range(40))
    assert all(r["thread"] == 0 and r["depth"] == r["turn"] for r in found)
    assert quotes.reply_order(spark.createDataFrame([], MESSAGES)).count() == 0


def test_quotes_run_no_python(spark, sf):
    plan = quotes.link_quotes(queries.as_mail(queries.read_table(spark, sf, "conversations")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


# --- repeated passages ------------------------------------------------------


def plain_removal(rows):
    """rows: (doc_id, text); equal ids are one document."""
    first = {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            first[window] = min(first.get(window, (doc_id, i)), (doc_id, i))
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - 19):
            if first[tuple(words[i : i + 20])] < (doc_id, i):
                gone.update(range(i, i + 20))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        out.append((doc_id, len(words), len(gone), kept))
    return sorted(out)


def passages(rng, n=60):
    shared = [prose(rng, rng.randint(15, 80), 30) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.6 else prose(rng, rng.randint(1, 50), 40) for _ in range(rng.randint(1, 6))]
        text = " ".join(parts)
        if rng.random() < 0.3:
            text = text.replace("w1 ", "w1x ", 2)
        texts.append(text)
    return texts + [texts[0], texts[0] + " " + texts[0], " ".join(["same"] * 90), "same " * 45, "", None]


@pytest.mark.parametrize("crowded", [2, 4, 2_000])
def test_repeats_match_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(substrings, "MANY_CONTENTS", crowded)
    monkeypatch.setattr(substrings, "SHARD_SEGMENTS", 20)
    texts = passages(random.Random(5))
    ids = random.Random(6).sample(range(1000), len(texts))
    found = substrings.remove_repeats(documents(spark, texts, ids=ids).repartition(3)).collect()
    expected = plain_removal(list(zip(ids, texts)))
    assert sorted(map(tuple, found)) == expected
    assert sum(r[2] for r in expected) > 500


def test_repeated_rows_share_their_places(spark):
    text = prose(random.Random(7), 30)
    found = substrings.remove_repeats(documents(spark, [text, text, text], ids=[5, 5, 6])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in found) == [(5, 0), (5, 0), (6, 30)]


@pytest.mark.parametrize("crowded", [2, 2_000])
def test_texts_without_or_of_one_id_are_apart(spark, monkeypatch, crowded):
    monkeypatch.setattr(substrings, "MANY_CONTENTS", crowded)
    rng = random.Random(12)
    repeat, first, second, third = (prose(rng, n, 5_000) for n in (30, 50, 50, 60))
    # A repeated passage at word 0 of one text, the others are clean; the same again under id 4.
    texts = [repeat, f"{repeat} {first}", second, third, f"{repeat} {second[::-1]}", first[::-1], None]
    ids = [-7, None, None, None, 4, 4, None]
    found = substrings.remove_repeats(documents(spark, texts, ids=ids).repartition(3)).collect()
    kept = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found}
    assert len(found) == len(texts)
    # Null ids come first, so the text of id -7 and the one of id 4 lose the passage.
    assert kept == {
        (-7, 30, 30, ""), (None, 80, 0, texts[1]), (None, 50, 0, second), (None, 60, 0, third),
        (4, 80, 30, second[::-1]), (4, 50, 0, first[::-1]), (None, 0, 0, ""),
    }
    texts = [f"{third} {repeat}", f"{repeat} {first}", second]
    found = substrings.remove_repeats(documents(spark, texts, ids=[None] * 3)).collect()
    assert sum(r["n_removed"] for r in found) == 30
    assert second in {r["kept"] for r in found}


def test_automaton_knows_first_places():
    a, b = [b"x", b"y", b"z"] * 8, [b"q"] + [b"x", b"y", b"z"] * 7
    automaton = substrings.SuffixAutomaton()
    automaton.add(a, 1, 0)
    automaton.add(b, 2, 10)
    found = list(automaton.matches(b, 20))
    assert found[-3:] == [(20, (2, 29)), (20, (1, 19)), (20, (1, 20))]
    assert list(automaton.matches([b"y", b"nowhere", b"x"], 20)) == [(1, None), (0, None), (1, None)]


# --- near duplicates --------------------------------------------------------


def plain_links(sets):
    return {
        (i, j)
        for i in range(len(sets))
        for j in range(len(sets))
        if i != j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    }


def plain_classes(n, links):
    root = list(range(n))
    for _ in range(n):
        for i, j in links:
            root[i] = min(root[i], root[j])
    return root


def word_sets(texts):
    out = []
    for text in texts:
        words = (text or "").split()
        out.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    return out


def near_copies(rng):
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randint(30, 200)).split()
        for _ in range(rng.choice([1, 2, 5, 14])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(999)}"
            texts.append(" ".join(copy))
    return texts + [texts[0]] * 3 + ["one two", "one two", "one", "", None]


@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(groups, "BLOCK", block)
    monkeypatch.setattr(groups.cells, "__defaults__", (block, True))
    monkeypatch.setattr(jaccard, "EXACT_BLOCK", block)
    texts = near_copies(random.Random(11))
    links = plain_links(word_sets(texts))
    classes = plain_classes(len(texts), links)
    counts = Counter(i for i, _ in links)
    found = jaccard.near_duplicates(documents(spark, texts).repartition(4)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in found) == [
        (i, classes[i], counts[i], classes[i] == i) for i in range(len(texts))
    ]
    assert len(links) > 50


def test_pruning_keeps_pairs_at_the_threshold():
    needed = jaccard.least_matches()
    rng = np.random.default_rng(1)
    draws = rng.random((20_000, jaccard.HASHES)) < jaccard.UPPER / jaccard.LOWER
    for n, least in needed.items():
        assert (draws[:, :n].sum(axis=1) < least).mean() < 1e-3
        assert least > 0


def test_min_hashes_agree_as_often_as_sets():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    same = jaccard.min_hashes(base[:2500]) == jaccard.min_hashes(base[500:])
    assert abs(same.mean() - 2000 / 3000) < 0.15


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(-5, 300), (7, 7)]
    rng.shuffle(edges)
    found = {r["node"]: r["component"] for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[100 + k] == 100 for k in range(40))
    assert found[300] == found[-5] == -5


# --- vectors ----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(rng, n=300, size=16):
    rows, centres = [], rng.normal(size=(20, size))
    for i in range(n):
        v = centres[rng.integers(20)] + rng.normal(size=size) * rng.choice([0.02, 0.1, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(3)]
    rows += [
        (2000, None, 1),
        (2001, [0.0] * size, 1),
        (2002, [], 1),
        (2003, [math.nan] + [1.0] * (size - 1), 1),
        (2004, [math.inf] + [1.0] * (size - 1), 1),
        (2005, [None] + [1.0] * (size - 1), 1),
        (2006, rows[0][1], None),
        (2007, [1.0, 2.0], 1),
        (2008, [2.0, 4.0], 1),
        (2009, [1e-30] * size, 2),
        (2010, [1e30] * size, 2),
        (None, rows[0][1], rows[0][2]),
    ]
    return rows


@pytest.mark.parametrize("block", [8, 512])
def test_near_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(groups.cells, "__defaults__", (block, True))
    rows = vectors(np.random.default_rng(3))

    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, dtype=float)
        return a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max())

    units = [unit(v) if i is not None else None for i, v, _ in rows]
    links = {
        (i, j)
        for i in range(len(rows))
        for j in range(len(rows))
        if i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and rows[i][2] is not None
        and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98
    }
    classes = plain_classes(len(rows), links)
    counts = Counter(i for i, _ in links)
    found = embeddings.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    order = lambda r: (r[0] is None, r)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=order) == sorted(
        ((rows[i][0], counts[i], rows[classes[i]][0]) for i in range(len(rows))), key=order
    )
    assert len(links) > 100


def test_no_vectors(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_forest_finds_the_links(spark):
    """Recall of the leaves alone, before clusters are completed."""
    rng, size = np.random.default_rng(9), 64
    centres = rng.normal(size=(150, size))
    noisy = [centres[i % 150] + rng.normal(size=size) * 0.13 for i in range(1500)]
    table = spark.createDataFrame([(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(noisy)], VECTORS)
    nodes = embeddings.vector_nodes(table)
    leaf = defaultdict(set)
    for r in embeddings.route(nodes, embeddings.fit_forest(nodes, fit_rows=800)).collect():
        leaf[r["node"]].add(r["group"])
    held = [(r["node"], r["label"], np.array(r["vector"])) for r in nodes.collect()]
    unit = np.array([v / np.linalg.norm(v) for _, _, v in held])
    close = np.argwhere(np.triu(unit @ unit.T >= 0.98, 1))
    pairs = [(i, j) for i, j in close if held[i][1] == held[j][1]]
    found = sum(bool(leaf[held[i][0]] & leaf[held[j][0]]) for i, j in pairs)
    assert len(pairs) > 1000 and found >= 0.99 * len(pairs)
    assert len({g for x in leaf.values() for g in x}) > 100


def test_pairs_per_vector_hardly_grow_while_the_sample_of_the_trees_stays(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SPLIT_FIT_ROWS", 500)
    monkeypatch.setattr(embeddings, "SPLIT_ABOVE", 64)
    rng = np.random.default_rng(11)
    per_vector = []
    for n in (2_000, 30_000):
        x = rng.normal(size=(n, 12))
        # A dense group, whose members cannot be told apart by any tree, beside pairs of near copies.
        x[:300] = x[0] + rng.normal(size=(300, 12)) * 1e-4
        x[400:500] = x[300:400] + rng.normal(size=(100, 12)) * 0.05
        ids = pa.array(range(n), pa.int64())
        table = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": x.tolist(), "label": pa.array([1] * n)}))
        nodes = store(embeddings.vector_nodes(table))
        names = {}
        for r in nodes.collect():
            names[r["node"]] = tuple(r["vector"])
        placed = embeddings.route(nodes, embeddings.fit_forest(nodes, fit_rows=400)).distinct()
        unsplit = placed.groupBy("group").count().agg(F.sum(F.col("count") ** 2)).first()[0] / n
        groups: dict[int, set] = {}
        for r in embeddings.split_large(placed, nodes).collect():
            groups.setdefault(r["group"], set()).add(names[r["node"]])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        keys = [tuple(v) for v in x.tolist()]
        pairs = [(i, i + 100) for i in range(300, 400) if unit[i] @ unit[i + 100] >= 0.98]
        pairs += [(0, i) for i in range(1, 300)]
        met = sum(any(keys[a] in g and keys[b] in g for g in groups.values()) for a, b in pairs)
        assert len(pairs) > 350 and met >= 0.99 * len(pairs)
        # Cells of the dense group aside, which are its answer.
        dense = set(keys[:300])
        per_vector.append(sum(len(g) ** 2 for g in groups.values() if not g & dense) / n)
    # Of 15 times the vectors, only the copies made by overlaps grow, with the depth of the trees.
    assert per_vector[1] < 3 * per_vector[0] and per_vector[1] < unsplit / 3


# --- mixing -----------------------------------------------------------------


def test_sources_meet_their_targets(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 6 < 4, 'large', if(id % 6 = 4, 'small', null)) as source")
    found = mixing.replicate(docs, weights={"large": 1.0, "small": 1.0, "absent": 5.0}).collect()
    counts = Counter(r["source"] for r in found)
    assert set(counts) == {"large", "small"}
    assert abs(counts["large"] - 3000) < 250 and abs(counts["small"] - 3000) < 250
    places = [(r["doc_id"], r["mix_copy"]) for r in found]
    assert len(set(places)) == len(places)


def test_counts_follow_the_poisson_distribution(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'s' as source")
    for epochs in (0.5, 3.0, 120.0):
        found = Counter(r["doc_id"] for r in mixing.replicate(docs.limit(2000), epochs=epochs).select("doc_id").collect())
        counts = np.array([found.get(i, 0) for i in range(2000)])
        assert abs(counts.mean() - epochs) < 5 * math.sqrt(epochs / 2000)
        assert abs(counts.var() / epochs - 1) < 0.2


def test_steps_are_the_distribution_function(spark):
    row = spark.range(1).select(mixing.steps(F.lit(2.5)).alias("s")).first()["s"]
    total = 0.0
    for k, step in enumerate(row):
        total += math.exp(-2.5) * 2.5**k / math.factorial(k)
        assert abs(step - total) < 1e-12


def test_names_of_the_mix_may_be_taken(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "'a' as source", "1 as mix_copy", "2 as MIX_place", "3 as _mix_name")
    found = mixing.replicate(docs)
    assert found.columns == [*docs.columns, "__mix_copy", "__mix_place"]
    plain = mixing.replicate(docs.select("doc_id", "source"))
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(r["doc_id"] for r in plain.collect())


@pytest.mark.parametrize("seed", [11, 12, 13])
@pytest.mark.parametrize("kind", ["no id", "one id", "equal rows"])
def test_rows_of_one_id_or_none_draw_for_themselves(spark, seed, kind):
    n = 20_000
    key = {"no id": "if(id % 2 = 0, null, id)", "one id": "if(id % 2 = 0, 5, id)", "equal rows": "null"}[kind]
    text = "'same'" if kind == "equal rows" else "concat('text ', id)"
    docs = spark.range(0, n, 1, 8).selectExpr(f"{key} as doc_id", f"{text} as text", "'a' as source")
    found = mixing.replicate(docs, seed=seed)
    # As dealt: by the hash of the place, not put together again where partitions are small.
    sizes = [r["count"] for r in found.groupBy(F.pmod(F.hash("mix_place"), F.lit(8))).count().collect()]
    assert abs(sum(sizes) - n) < 0.02 * n + 3 * n**0.5
    assert max(sizes) < 2 * n / 8
    if kind != "equal rows":
        assert sorted(map(repr, found.collect())) == sorted(map(repr, mixing.replicate(docs.repartition(3), seed=seed).collect()))
