"""Operators on single texts, against brute force."""

import random
import re
import string
from collections import Counter

import pytest
import tiktoken
import base64
import public_tokenizers
from hypothesis import given, settings, strategies as st

from tablelearn.llm import bpe, quality, secrets, token_counts

ODD = ["", " ", "\n", "a", "'", "'s", "  x", "\t\n x", "ſecret=abcdefgh1", "é ü", "日本語 テスト", " x", "a b", "🙂🙃", "\x1cx\x1f y"]
PIECES = ["password", "Secret", "api_key", "apikey", "token", " ", ":", "=", '"', "'", "AKIA", "ABCDEF0123", "0123456789abcdef", "x", "é", "\n", "=="]


# --- secrets ---------------------------------------------------------------


def plain_spans(text):
    rules = [
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ]
    found = []
    for k, (kind, pattern, group, least) in enumerate(rules):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=5))
def test_spans_match_a_plain_search(texts):
    scanner = secrets.Scanner(secrets.BASE_RULES)
    kinds = [r.kind for r in secrets.BASE_RULES]
    for text, spans in zip(texts, scanner.find(texts)):
        assert [(kinds[k], a, b) for a, b, k in spans] == plain_spans(text)


def test_dropped_matches_use_up_what_they_cover():
    text = "password:token: abcdefghij secret = 'abcdefgh'"
    assert plain_spans(text) == [("assign", 27, 45)]
    found = secrets.Scanner(secrets.BASE_RULES).find([text])[0]
    assert [(a, b) for a, b, _ in found] == [(27, 45)]


def test_trigram_queries():
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secrets.trigram_query(r"[0-9a-f]{32,}") is True
    assert secrets.trigram_query(r"(abc|xyz)\d") == ("or", ("abc", "xyz"))
    assert secrets.trigram_query(r"ab?cde") == ("or", (("and", ("abc", "bcd", "cde")), ("and", ("acd", "cde"))))
    assert secrets.trigram_query(r"a.b") is True


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_no_match_escapes_its_query(rule):
    """Every text with a match is a candidate, whatever surrounds it."""
    samples = {
        "assign": "api_KEY: 'abcdefgh99'",
        "access": "AKIA" + "Z9" * 8,
        "hex": "0f" * 20,
        "private": "-----BEGIN RSA PRIVATE KEY-----",
        "code_host": "ghp_" + "aB3" * 13,
        "chat": "xoxb-1234567890-abc",
        "web_token": "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12,
        "url_login": "https://user:hunter22@host.example",
    }
    texts = ["", "nothing here", "é" * 5 + samples[rule.kind] + "\n" + "z" * 5000]
    found = secrets.Scanner(secrets.RULES).find(texts)
    names = [r.kind for r in secrets.RULES]
    assert not found[0] and not found[1]
    assert rule.kind in {names[k] for _, _, k in found[2]}


def test_whole_keys_and_logins_are_masked():
    rng = random.Random(8)
    lines = ["".join(rng.choices(string.ascii_letters + string.digits + "+/", k=64)) for _ in range(25)] + ["aB3/x9Q="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    bodies = ["\n".join(lines), "\r\n".join(lines), "\\n".join(lines), "\n".join(f"> {x}" for x in lines)]
    bodies += ["Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n" + "\n".join(lines)]
    scanner = secrets.Scanner(secrets.RULES)

    def masked(text):
        return secrets.mask(text, [s[:2] for s in scanner.find([text])[0]])

    for body in bodies:
        gap = "\\n" if "\\n" in body else "\n"
        for footer in (end, ""):
            out = masked(f"Before it.{gap}{begin}{gap}{body}{gap}{footer}{gap}And words after it.")
            assert not any(x in out for x in lines)
            assert out.startswith("Before it.") and out.endswith("And words after it.")
    # Words between two keys stay, also after a header without a body.
    between = f"{begin}\n{lines[0]}\n{end}\nwords between\n{begin}\n{lines[1]}\n{end}"
    assert masked(between) == "[secret]\nwords between\n[secret]"
    assert masked(f"{begin}\nis a header.") == "[secret]\nis a header."
    for kind in ("RSA2 PRIVATE KEY", "PGP PRIVATE KEY BLOCK"):
        assert masked(f"a\n-----BEGIN {kind}-----\n{lines[0]}\n{lines[-1]}\n-----END {kind}-----\nb") == "a\n[secret]\nb"
    for user, password in (("u" * 80, "p" * 9), ("u", "p" * 200), ("u" * 65, "p" * 65), ("u" * 5_000, "p" * 5_000)):
        assert password not in masked(f"see ftp://{user}:{password}@host.org for it")


def test_spans_of_long_logins_and_keys_are_those_of_sql(spark, tmp_path):
    import duckdb

    from tablelearn.llm import queries

    rng = random.Random(9)
    line = lambda n: "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=n))
    begin, end = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    body = "\n".join(line(64) for _ in range(12))
    texts = [f"see postgres://{'u' * n}:{'p' * n}@host.org now" for n in (6, 64, 65, 5_000)]
    texts += [f"x {begin}\n{body}\n{line(9)}==\n{end} y", f"{begin}\n{body}\n{line(9)}\n", f"{begin}\n{body}\r\n{line(9)}=\r\nwords"]
    texts += [f"{begin} words {begin}\n{body}\n{end}", f"'{begin}\\n{line(64)}\\n{line(12)}=\\n' {end}", f"{begin}\n- a - b -- c\n{end}", begin]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = {r[0]: r[-1] for r in con.execute(queries.ORACLES["op1_secret_scan"]).fetchall()}
    found = {r["doc_id"]: r["spans"] for r in queries.QUERIES["op1_secret_scan"](spark, str(tmp_path)).collect()}
    assert found == wanted and all(f"url_login:4:{len(texts[i]) - 4}" in found[i] for i in range(4))
    assert found[4].endswith(f"private:2:{len(texts[4]) - 2}") or f"private:2:{len(texts[4]) - 2}" in found[4]


def test_mask_joins_overlaps():
    assert secrets.mask("abcdef", [(1, 3), (2, 4)]) == "a[secret]ef"
    assert secrets.mask("", []) == ""


# --- byte-level BPE --------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(*bpe.vocabulary())


@pytest.fixture(scope="module")
def tiktoken_coder():
    with open(bpe.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(ODD + PIECES), max_size=12).map("".join)))
def test_ids_are_those_of_the_rank_file(coder, tiktoken_coder, text):
    ids = coder.encode(text)
    assert ids == tiktoken_coder.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()
    assert "".join(coder.pieces_of(ids)) == text


def test_every_code_point_of_the_plain_range(coder, tiktoken_coder):
    for start in range(0, 0x3100, 16):
        text = "".join(f"a{chr(c)}1{chr(c)}{chr(c)}.{chr(c)} {chr(c)}b  {chr(c)}'s" for c in range(start, start + 16))
        assert coder.encode(text) == tiktoken_coder.encode_ordinary(text)


def test_special_names_are_ordinary_text(coder, tiktoken_coder):
    assert coder.encode("<|endoftext|>") == tiktoken_coder.encode_ordinary("<|endoftext|>")


def test_offsets_cover_split_characters(coder):
    text = "a🙂 bé日"
    ids = coder.encode(text)
    starts, ends = coder.offsets(text, ids)
    assert starts[0] == 0 and ends[-1] == len(text)
    for i, a, b in zip(ids, starts, ends):
        assert coder.bytes[i] in text[a:b].encode()


def test_cache_is_bounded(coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    other = bpe.ByteBpe(*bpe.vocabulary())
    text = "one two three four five six seven"
    assert other.encode(text) == coder.encode(text) and len(other.ids) <= 3


# --- token trees -----------------------------------------------------------

WORDS = [" the", " a", "  ", "\n", "'", "re", "'s", "!", "!!", "12", "é", " x", "ve", "日", "\t", " \n ", "l"]


@settings(max_examples=300, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(0, 400), st.integers(1, 6))
def test_edited_trees_count_like_a_new_count(coder, rng, size, rounds):
    text = "".join(rng.choice(WORDS) for _ in range(size))
    tree = token_counts.TokenTree.of(text, coder)
    assert tree.total == len(coder.encode(text))
    for _ in range(rounds):
        edits, plain, at = [], [], 0
        for _ in range(rng.randint(0, 4)):
            start = rng.randint(at, len(text))
            end = min(len(text), start + rng.choice([0, 1, 5, 300]))
            new = "".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 500])))
            edits.append((start, end, new))
            plain += [text[at:start], new]
            at = end
        expected = "".join([*plain, text[at:]])
        got, done, _ = tree.apply(text, edits, coder)
        if done == len(edits):
            assert got == expected
        text = got
        assert tree.total == len(coder.encode(text))
        assert sum(tree.leaf_chars()) == len(text)


def test_only_touched_leaves_are_encoded(coder):
    text = " word" * 20_000
    tree = token_counts.TokenTree.of(text, coder)
    edited, done, encoded = tree.apply(text, [(50_000, 50_004, "other")], coder)
    assert done == 1 and encoded <= 3 * token_counts.LEAF
    assert tree.total == len(coder.encode(edited))


def test_overlapping_and_outside_edits_are_left_out(coder):
    text = "abcdef"
    tree = token_counts.TokenTree.of(text, coder)
    got, done, _ = tree.apply(text, [(1, 3, "X"), (2, 4, "Y"), (5, 99, "Z")], coder)
    assert (got, done) == ("aXdef", 1)


def test_earlier_rule_wins():
    rules = [(re.compile("bc"), "1"), (re.compile("abcd"), "2"), (re.compile("d"), "3")]
    assert token_counts.edits_by_rules("abcd bcd", rules) == [(0, 4, "2"), (5, 7, "1"), (7, 8, "3")]


# --- quality measures ------------------------------------------------------


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", " ", "\n", "#", "\x0b", "\x1c", " ", "日", "%"]), max_size=60).map("".join))
def test_measures_match_a_plain_count(text):
    assert quality.measure_text(text) == plain_measures(text)


def test_measures_of_nothing_and_of_very_long_words():
    assert quality.measure_text(None) == (0, 0, 0, 0, 0)
    long = random.Random(1).choices("abc", k=20_000)
    text = "".join(long) + " " + "".join(long) + " x"
    assert quality.measure_text(text) == plain_measures(text)
