"""The operators on the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablelearn.llm import (
    bpe,
    embeddings,
    hmm,
    jaccard,
    language,
    mixing,
    phrases,
    quality,
    quotes,
    resampling,
    secrets,
    substrings,
    token_counts,
)
from tablelearn.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def _hex_digest(column: Column | str) -> Column:
    return F.sha2(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary"), 256)


def _either_case(pattern: str) -> str:
    """ASCII letters in either case spelled out: SQL's own folding would reach beyond ASCII."""
    words = re.compile(r"\(\?i:(.*?)\)(?=\[|$)")
    spelled = lambda m: re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1])
    return words.sub(spelled, pattern)


def _rule_sql(k: int, rule: secrets.Rule) -> str:
    """The spans of one rule: pieces of text and matches alternate, so their lengths give the places."""
    pattern = _either_case(rule.pattern).replace("'", "''")
    return f"""
  SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, stop - length(found) AS start, stop, measured
  FROM (
    SELECT *, sum(length(piece) + length(found)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
    FROM (
      SELECT doc_id, unnest(found) AS found, unnest(measured) AS measured, unnest(pieces[1:len(found)]) AS piece,
             generate_subscripts(found, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found,
                   regexp_extract_all(text, '{pattern}', {rule.group}) AS measured,
                   regexp_split_to_array(text, '{pattern}') AS pieces
            FROM documents)))
  WHERE length(measured) >= {rule.least}"""


_SECRETS_SQL = f"""
WITH found AS ({" UNION ALL ".join(_rule_sql(k, r) for k, r in enumerate(secrets.RULES))}
),
joined AS (
  SELECT doc_id,
         {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)},
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < {len(secrets.BASE_RULES)}) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
  FROM found GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN joined USING (doc_id)
"""


@query(_SECRETS_SQL)
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    kinds = [rule.kind for rule in secrets.BASE_RULES]
    found = secrets.scan_secrets(read_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[secrets.count_spans(kind).alias(f"n_{kind}") for kind in kinds],
        _hex_digest(secrets.joined_spans(kinds)).alias("base_sha256"),
        secrets.joined_spans().alias("spans"),
    )


@query()
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document before and after cleaning it, the latter from its tree."""
    trees = token_counts.build_trees(read_table(spark, folder, "documents"), token_counts.CLEANING)
    edited = token_counts.edit_trees(trees.withColumn("doc_id", F.struct("doc_id", F.col("n_tokens").alias("n"))))
    return edited.select(
        F.col("doc_id.doc_id").alias("doc_id"),
        F.col("doc_id.n").alias("n_tokens"),
        F.col("n_tokens").alias("n_tokens_edited"),
        "n_edits",
        "n_encoded",
        F.length("text").cast("long").alias("n_chars_edited"),
        _hex_digest("text").alias("edited_sha256"),
    )


_QUALITY_SQL = """
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
),
windows AS (
  SELECT doc_id, k, word AS a, lead(word) OVER d AS b, lead(word, 2) OVER d AS c
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY k)
),
twice AS (
  SELECT doc_id, k FROM (
    SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL)
  WHERE n > 1
),
repeated AS (
  SELECT doc_id, count(DISTINCT k + i) AS n_repeat_words FROM twice, range(3) AS r(i) GROUP BY doc_id
),
counted AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
),
measured AS (
  SELECT d.doc_id, d.source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM documents d LEFT JOIN counted USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
),
hosts AS (
  SELECT source, count(*) AS n, sum(base_failed::INTEGER) AS failed FROM judged WHERE source IS NOT NULL GROUP BY source
),
moments AS (
  SELECT least(greatest(avg(failed / n), 1e-6), 1 - 1e-6) AS mean, var_pop(failed / n) AS variance FROM hosts
),
prior AS (
  SELECT mean, least(greatest(CASE WHEN variance > 0 THEN mean * (1 - mean) / variance - 1 ELSE 1000 END, 1), 1000) AS weight
  FROM moments
),
verdicts AS (
  SELECT source, (failed + mean * weight) / (n + weight) AS host_rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_rate <= 0.5, true) AS kept,
       round(host_rate, 9) AS host_rate
FROM judged LEFT JOIN verdicts USING (source)
"""


@query(_QUALITY_SQL)
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(read_table(spark, folder, "documents"))
    return judged.select(
        "doc_id",
        *[m.split()[0] for m in quality.MEASURES.split(", ")],
        "base_failed",
        "kept",
        F.round("host_rate", 9).alias("host_rate"),
    )


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = language.identify(docs, language.fit_languages(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def as_mail(conversations: DataFrame) -> DataFrame:
    """Conversations as mail: every message quotes the one before it in full, and of
    the one before that, a level deeper, its last line.

    The given conversations hold no quotations. Rows that share conv_id and turn are
    quoted as one, the smallest text.
    """
    said = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    before, earlier = (
        said.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("said").alias(name))
        for k, name in ((1, "before"), (2, "earlier"))
    )
    quote = lambda text, mark: F.concat(F.lit(mark), F.regexp_replace(text, "\n", "\n" + mark))
    last_line = F.element_at(F.split("earlier", "\n", -1), -1)
    return (
        conversations.join(before, ["conv_id", "turn"], "left")
        .join(earlier, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            F.when(F.col("text").isNotNull(), F.concat_ws("\n", quote(last_line, "> > "), quote(F.col("before"), "> "), "text")).alias("text"),
        )
    )


# What quoting and linking must give back: texts, and the first message that says the same.
_QUOTES_SQL = """
WITH RECURSIVE messages AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
),
clean AS (
  SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS said,
         lower(trim(string_split(text, chr(10))[-1])) AS last_line
  FROM messages
),
units AS (
  SELECT conv_id, turn, said AS unit FROM clean
  UNION ALL
  SELECT conv_id, turn, lower(trim(unnest(string_split(text, chr(10))))) FROM messages
),
origins AS (
  SELECT conv_id, unit, min(turn) AS origin FROM units WHERE unit <> '' GROUP BY 1, 2
),
linked AS (
  SELECT m.conv_id, m.turn, m.role, m.text, o.origin AS parent, o2.origin AS other,
         (b.said IS NOT NULL AND b.said <> '')::BIGINT + (e.last_line IS NOT NULL AND e.last_line <> '')::BIGINT AS n_quotes
  FROM messages m
  LEFT JOIN clean b ON b.conv_id = m.conv_id AND b.turn = m.turn - 1
  LEFT JOIN clean e ON e.conv_id = m.conv_id AND e.turn = m.turn - 2
  LEFT JOIN origins o ON o.conv_id = m.conv_id AND o.unit = b.said AND o.origin < m.turn
  LEFT JOIN origins o2 ON o2.conv_id = m.conv_id AND o2.unit = e.last_line AND o2.origin < m.turn
),
answered AS (
  SELECT conv_id, turn, role, trim(text) AS text, n_quotes, (parent IS NOT NULL)::BIGINT + (other IS NOT NULL)::BIGINT AS n_linked,
         coalesce(parent, other) AS parent
  FROM linked
),
chain AS (
  SELECT conv_id, turn, turn AS thread, 0::BIGINT AS depth FROM answered WHERE parent IS NULL
  UNION ALL
  SELECT a.conv_id, a.turn, c.thread, c.depth + 1 FROM answered a JOIN chain c ON a.conv_id = c.conv_id AND a.parent = c.turn
)
SELECT a.*, c.thread, c.depth FROM answered a JOIN chain c ON a.conv_id = c.conv_id AND a.turn = c.turn
"""


@query(_QUOTES_SQL)
def op5_quote_links(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.reply_order(as_mail(read_table(spark, folder, "conversations")))


@query()
def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(read_table(spark, folder, "documents"), decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _hex_digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_SUBSTRING_SQL = """
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
),
windows AS (
  SELECT doc_id, k, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS content
  FROM words QUALIFY k <= n - 19
),
later AS (
  SELECT doc_id, k FROM windows QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, k) > 1
),
gone AS (
  SELECT DISTINCT doc_id, k + i AS k FROM later, range(20) AS r(i)
),
marked AS (
  SELECT w.doc_id, w.k, w.word, g.k IS NOT NULL AS removed
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.k = w.k
),
counted AS (
  SELECT doc_id, count(*) AS n_words, sum(removed::INTEGER)::BIGINT AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT removed), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN counted USING (doc_id)
"""


@query(_SUBSTRING_SQL)
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(read_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", _hex_digest("kept").alias("kept_sha256"))


_JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
),
shingles AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, n, k, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle
    FROM words)
  WHERE k <= greatest(n - 4, 1)
),
sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 5 * common.n >= 4 * (x.n + y.n - common.n)
),
reach AS (
  SELECT doc_id, doc_id AS class_id FROM documents
  UNION
  SELECT links.a, reach.class_id FROM reach JOIN links ON links.b = reach.doc_id
),
classes AS (
  SELECT doc_id, min(class_id) AS class_id FROM reach GROUP BY doc_id
)
SELECT c.doc_id, c.class_id, (SELECT count(*) FROM links WHERE links.a = c.doc_id) AS n_links, c.doc_id = c.class_id AS kept
FROM classes c
"""


@query(_JACCARD_SQL)
def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, folder, "documents"))


_EMBEDDING_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
),
reach AS (
  SELECT vec_id, vec_id AS component_id FROM embeddings
  UNION
  SELECT links.a, reach.component_id FROM reach JOIN links ON links.b = reach.vec_id
),
classes AS (
  SELECT vec_id, min(component_id) AS component_id FROM reach GROUP BY vec_id
)
SELECT c.vec_id, (SELECT count(*) FROM links WHERE links.a = c.vec_id) AS n_links, c.component_id,
       c.vec_id = c.component_id AS kept
FROM classes c
"""


@query(_EMBEDDING_SQL)
def op9_embedding_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_vectors(read_table(spark, folder, "embeddings"))


_MIXING_SQL = """
WITH counts AS (
  SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1
),
rates AS (
  SELECT source, n, sum(n) OVER () * sqrt(n) / sum(sqrt(n)) OVER () / n AS rate FROM counts
),
parts AS (
  SELECT source, greatest(ceil(rate / 50), 1)::INTEGER AS parts, rate / greatest(ceil(rate / 50), 1) AS rate FROM rates
),
masses AS (
  SELECT source, parts, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS mass FROM parts, range(160) AS r(k)
),
steps AS (
  SELECT source, parts, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS step FROM masses
),
docs AS (
  SELECT doc_id, coalesce(source, '') AS source, lang, text FROM documents
),
draws AS (
  SELECT doc_id, d.source, j, ('0x' || substr(md5(doc_id || ':11' || CASE WHEN j > 0 THEN ':' || j ELSE '' END), 1, 13))::BIGINT
         / 16.0 ** 13 AS draw
  FROM docs d JOIN parts p ON d.source = p.source, unnest(range(p.parts)) AS r(j)
),
copies AS (
  SELECT doc_id, sum((SELECT count(*) FROM steps s WHERE s.source = draws.source AND s.k < 140 AND s.step <= draw)) AS n
  FROM draws GROUP BY doc_id
),
repeated AS (
  SELECT doc_id, unnest(range(n::BIGINT))::INTEGER AS mix_copy FROM copies WHERE n > 0
)
SELECT d.doc_id, d.source, d.lang, d.text, r.mix_copy, md5('12:' || d.doc_id || ':' || r.mix_copy) AS mix_place
FROM repeated r JOIN docs d ON d.doc_id = r.doc_id
"""


@query(_MIXING_SQL)
def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    return mixing.replicate(docs)


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PHRASES_SQL = f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                 translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)
),
words AS (
  SELECT lang, id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT lang, w, row_number() OVER () AS id FROM pieces)
),
next_words AS (
  SELECT lang, word, lead(word) OVER d AS second, lead(word, 2) OVER d AS third FROM words
  WINDOW d AS (PARTITION BY id ORDER BY i)
),
runs AS (
  SELECT lang, 1 AS k, word AS phrase FROM next_words
  UNION ALL SELECT lang, 2, word || ' ' || second FROM next_words WHERE second IS NOT NULL
  UNION ALL SELECT lang, 3, word || ' ' || second || ' ' || third FROM next_words WHERE third IS NOT NULL
),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
parts AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {phrases.LEAST}
),
split AS MATERIALIZED (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS c FROM parts)
),
cuts AS (
  SELECT p.lang, p.phrase, p.a, c, x.a AS l, y.a AS r, (p.a::HUGEINT * p.a * 1000000 // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM split p JOIN f x ON x.lang = p.lang AND x.phrase = head JOIN f y ON y.lang = p.lang AND y.phrase = tail
),
candidates AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
),
inner_runs AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM parts WHERE k = 3) GROUP BY ALL
),
ranked AS (
  SELECT c.lang, phrase, a, l, r, score,
         row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM candidates c LEFT JOIN inner_runs USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < {phrases.INSIDE} * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {phrases.TOP}
"""


@query(_PHRASES_SQL)
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best 2,000 phrases of two and three words of each language, from all whole texts."""
    return phrases.mine_phrases(read_table(spark, folder, "documents"))


_RESAMPLING_SQL = f"""
WITH bytes AS (
  SELECT b, list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
  FROM range(256) AS r(b)
),
steps AS (SELECT list(t ORDER BY b) AS t FROM bytes),
texts AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
),
worded AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'),
                                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts
),
next_words AS (
  SELECT side, doc_id, word, lead(word) OVER (PARTITION BY side, doc_id ORDER BY i) AS second
  FROM (SELECT side, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM worded)
),
runs AS (
  SELECT side, doc_id, word AS run FROM next_words
  UNION ALL SELECT side, doc_id, word || ' ' || second FROM next_words WHERE second IS NOT NULL
),
distinct_runs AS (SELECT DISTINCT run, hex(encode(run)) AS h FROM runs),
digits AS (
  SELECT run, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INTEGER + 1, 2))::BIGINT) AS b
  FROM distinct_runs
),
bucketed AS (
  SELECT run, xor(list_reduce([4294967295] || b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)
              % {resampling.BUCKETS} AS bucket
  FROM digits, steps
),
found AS (SELECT side, doc_id, bucket FROM runs JOIN bucketed USING (run)),
sums AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM found GROUP BY bucket
),
totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + {resampling.BUCKETS})
                                 / ((s + 1)::DOUBLE * (all_t + {resampling.BUCKETS}))))::BIGINT AS gain
  FROM sums, totals
),
weights AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM found JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5)
                                                  / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (doc_id) WHERE side = 0
),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_words >= {resampling.LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {resampling.PERCENT} * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


@query(_RESAMPLING_SQL)
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the documents with enough words, drawn towards the benchmark's distribution of words."""
    return resampling.resample(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query()
def op13_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all documents under the hidden Markov model and under word frequencies."""
    return hmm.score_texts(read_table(spark, folder, "documents"))
