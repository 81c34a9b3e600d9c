"""Vocabulary learning, encoding, scoring and incremental consolidation on the documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rankcut.operators import backoff, encode, regress, scoring, suffixes, unigram, vocab
from rankcut.plans.catalog import on_documents, on_fixture
from rankcut.plans.fixtures import BASE, HALF_WIDTH
from rankcut.plans.relational import CONSOLIDATED, consolidated_summary
from rankcut.plans.workflow import cutoff_effects, regression_data
from rankcut.session import new_path, stage
from rankcut.sources import readers
from rankcut.streaming.consolidate import consolidate_available

# The smallest vocabulary size that is analysed, with a window of the usual share of it.
CUT, CUT_WIDTH = 8_064, 1_260
BPE_SIZE = CUT + CUT_WIDTH
WORDPIECE_SIZE = UNIGRAM_SIZE = CUT
BUDGET = 8192

# Whitespace of any kind becomes one space, so that both regex dialects see the same words.
_BLANKS = r"[\s\p{Z}\x{0B}\x{85}]+"
NORMAL = rf"trim(regexp_replace(text, '{_BLANKS}', ' ', 'g'), ' ')"
WORDS_SQL = rf"regexp_extract_all({NORMAL}, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+')"
COUNTS_SQL = f"(SELECT word, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS word FROM documents) q GROUP BY word)"


def normal(docs):
    return docs.withColumn("text", F.trim(F.regexp_replace("text", _BLANKS, " ")))


_LEARNED: dict[tuple, object] = {}


def learned(docs, kind: str):
    """Learn once per application and table, as a user would who stores the vocabulary."""
    key = (docs.sparkSession.sparkContext.applicationId, tuple(sorted(docs.inputFiles())), kind)
    if key not in _LEARNED:
        if kind == "bpe":
            _LEARNED[key] = vocab.learn_bpe(docs, BPE_SIZE)
        elif kind == "wordpiece":
            _LEARNED[key] = vocab.learn_wordpiece(docs, WORDPIECE_SIZE)
        else:
            counts = vocab.word_counts(docs)
            _LEARNED[key] = unigram.learn_unigram(counts, UNIGRAM_SIZE)
    return _LEARNED[key]


@on_documents("tok01_words", f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_types, w[1] AS first_word, w[-1] AS last_word FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents) q", costly=True)
def _(docs):
    rows = normal(docs).select("doc_id", vocab.words_of(F.col("text")).alias("w"))
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size(F.array_distinct("w")).cast("long").alias("n_types"),
        F.get("w", F.lit(0)).alias("first_word"),
        F.try_element_at("w", F.lit(-1)).alias("last_word"),
    )


@on_documents("tok02_word_counts", f"SELECT word, n FROM {COUNTS_SQL} WHERE n >= 2", costly=True)
def _(docs):
    return vocab.word_counts(normal(docs), min_frequency=2)


@on_documents(
    "tok03_first_pairs",
    f"""SELECT substr(h, 2 * i - 1, 4) AS pair, sum(n)::BIGINT AS n FROM (SELECT lower(hex(encode(word))) AS h, n FROM {COUNTS_SQL} c) q,
        LATERAL (SELECT unnest(range(1, len(h) // 2)) AS i) GROUP BY pair""",
    costly=True,
)
def _(docs):
    tokens, ids = vocab._initial_tokens([vocab.EOS_TOKEN])
    pairs = vocab.pair_counts(vocab._symbol_words(vocab.word_counts(normal(docs)), ids))
    back = F.translate("pair", "".join(vocab.symbol(i) for i in ids), "".join(map(chr, range(256))))
    return pairs.select(F.lower(F.hex(F.encode(back, "ISO-8859-1"))).alias("pair"), "n")


@on_documents("tok03_learn_bpe", costly=True)
def _(docs):
    return learned(docs, "bpe").merges_df(docs.sparkSession)


@on_documents("tok04_learn_wordpiece", costly=True)
def _(docs):
    return learned(docs, "wordpiece").merges_df(docs.sparkSession)


@on_documents("tok05_learn_unigram", costly=True)
def _(docs):
    return learned(docs, "unigram").pieces


@on_documents(
    "tok05_seed_substrings",
    f"""SELECT piece, count(*) AS n FROM (SELECT substr(s, p, k) AS piece, substr(s, p + k, 1) AS next FROM
          (SELECT s, p, unnest(range(2, 17)) AS k FROM (SELECT concat(word, chr(1)) AS s, unnest(range(1, length(word))) AS p FROM {COUNTS_SQL} c) w) x WHERE p + k <= length(s)) y
        GROUP BY piece HAVING min(next) < max(next)""",
    costly=True,
)
def _(docs):
    """Over characters, as SQL has no bytes; the learner takes the same over bytes."""
    return suffixes.repeated_substrings(vocab.word_counts(normal(docs)).select(F.col("word").alias("w")), 16)


@on_documents("tok06_encode_corpus", costly=True)
def _(docs):
    return encode.encode_corpus(docs, learned(docs, "bpe"), ["doc_id"])


def token_bytes(encoded, tokens):
    """Bytes covered by the ids of each document: every token is one byte per character."""
    lengths = F.split(F.lit(",".join(str(len(t)) for t in tokens)), ",").cast("array<int>")  # one constant, however many tokens
    return F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, t: a + F.get(lengths, t))


@on_documents("tok06_encode_unigram", "SELECT doc_id, text, octet_length(encode(text))::BIGINT AS n_bytes FROM documents", costly=True)
def _(docs):
    """Best paths over the learned pieces; what they spell is the text again."""
    vocabulary = learned(docs, "unigram")
    model = vocabulary.learned()
    rows = stage(encode.encode_docs(docs.select("doc_id", "text"), model, kind="unigram"), "unigram_ids")
    back = encode.decode_docs(rows, vocabulary.pieces.withColumnRenamed("piece", "token"), "doc_id")
    return back.join(rows.select("doc_id", token_bytes(rows, model.tokens).alias("n_bytes")), "doc_id")


@on_documents("tok06_encode_bytes", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, row_number() OVER (ORDER BY doc_id) - 1 AS uid FROM documents", costly=True)
def _(docs):
    model = learned(docs, "bpe")
    rows = encode.encode_corpus(docs, model, ["doc_id"], keep=["doc_id"])
    return rows.select("doc_id", token_bytes(rows, model.tokens).alias("n_bytes"), "uid")


@on_documents("tok07_longest_match", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes FROM documents", costly=True)
def _(docs):
    """Words over the length limit become one unknown token; their bytes are added back for the check."""
    model = learned(docs, "bpe")
    words = F.transform(vocab.words_of(F.col("text")), vocab.to_byte_chars)
    too_long = F.aggregate(
        F.filter(words, lambda w: F.length(w) > encode.MAX_WORD_CHARS), F.lit(0).cast("long"), lambda a, w: a + F.length(w) - len(model.tokens[0])
    )
    rows = docs.select("doc_id", too_long.alias("_long"), "text")
    rows = encode.encode_docs(rows, model, kind="longest")
    return rows.select("doc_id", (token_bytes(rows, model.tokens) + F.col("_long")).alias("n_bytes"))


@on_fixture(
    "tok08_cut_many",
    """SELECT 'bpe' || v || 'corpusa' AS tok_name, v AS vocab_size, count(*) AS n, max(id) AS last FROM
       (SELECT DISTINCT tok AS id FROM fx_docs UNION ALL SELECT tok FROM fx_merges) q, (SELECT unnest([520, 600, 700]) AS v) s WHERE id < v GROUP BY v""",
)
def _(fx):
    base = fx.docs.select(F.explode("input_ids").alias("id")).distinct().select("id", F.concat(F.lit("t"), "id").alias("token"))
    ranked = base.unionByName(fx.log.select(F.col("new_token_id").alias("id"), F.col("new_token").alias("token")))
    cut = vocab.cut_many(ranked, [520, 600, 700], "bpe", "corpusa", fx.merges_path)
    return cut.groupBy("tok_name", "vocab_size").agg(F.count("*").alias("n"), F.max("id").cast("long").alias("last"))


@on_documents("tok09_decode", "SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN '' ELSE text END AS text FROM documents", costly=True)
def _(docs):
    model = learned(docs, "bpe")
    some_empty = F.when(F.col("doc_id") % 50 == 7, F.lit("")).otherwise(F.col("text"))
    encoded = encode.encode_docs(docs.select("doc_id", some_empty.alias("text")), model)
    return encode.decode_docs(encoded, model.vocab_df(docs.sparkSession), "doc_id")


# --- scoring -------------------------------------------------------------------------------------

BATCHES = f"""ranked AS (SELECT uid, n AS len, row_number() OVER (ORDER BY n DESC, uid) - 1 AS rank FROM fx_len),
starts AS (SELECT 0::BIGINT AS batch_id, 0::BIGINT AS start, len FROM ranked WHERE rank = 0
  UNION ALL SELECT batch_id + 1, r.rank, r.len FROM starts s JOIN ranked r ON r.rank = s.start + greatest(1, {BUDGET} // s.len)),
packed AS (SELECT r.uid, r.len, r.rank, s.batch_id, s.len AS batch_len FROM ranked r JOIN starts s ON r.rank >= s.start AND r.rank < s.start + greatest(1, {BUDGET} // s.len))"""


@on_fixture("sco01_pack_batches", f"SELECT * FROM (WITH RECURSIVE {BATCHES} SELECT * FROM packed) q")
def _(fx):
    packed = scoring.pack_batches(fx.docs, BUDGET)
    return packed.select("uid", *[F.col(c).cast("long").alias(c) for c in ("len", "rank", "batch_id", "batch_len")])


@on_fixture("sco02_collate", f"SELECT uid, batch_id, batch_len AS len, batch_len - len AS n_pad FROM (WITH RECURSIVE {BATCHES} SELECT * FROM packed) q")
def _(fx):
    marked = fx.docs.withColumn("input_ids", F.transform("input_ids", lambda x: x + 1))
    rows = scoring.collate(marked, scoring.pack_batches(fx.docs, BUDGET))
    pads = F.size(F.filter("input_ids", lambda x: x == scoring.PAD_ID))
    return rows.select("uid", "batch_id", F.size("input_ids").cast("long").alias("len"), pads.cast("long").alias("n_pad"))


@on_fixture(
    "sco03_span_plan",
    """SELECT uid, i * 64 AS start, least(i * 64 + 128, n - 1) AS end, CASE WHEN i = 0 THEN least(128, n - 1) ELSE least(least(i * 64 + 128, n - 1) - least((i - 1) * 64 + 128, n - 1), 64) END AS scored
       FROM fx_len, LATERAL (SELECT unnest(range(0, 1 + greatest(0, ceil((n - 1 - 128) / 64e0)::BIGINT))) AS i) WHERE n > 1""",
)
def _(fx):
    return scoring.scoring_spans(fx.docs, 128, 64)


# Fitted on four fifths of the documents, so that unseen pairs and first tokens occur.
NGRAM = f"""b AS (SELECT uid, pos, tok, lag(tok) OVER (PARTITION BY uid ORDER BY pos) AS prev FROM fx_docs),
c2 AS (SELECT prev, tok, count(*) FILTER (uid % 2 = 0) AS half, count(*) AS n FROM b WHERE prev IS NOT NULL AND uid % 5 > 0 GROUP BY ALL),
c1 AS (SELECT prev, sum(half) AS half, sum(n) AS n FROM c2 GROUP BY prev),
lp AS (SELECT b.uid, b.pos, b.tok, -ln({BASE}e0) AS s0, ln((coalesce(c2.half, 0) + 1e0) / (coalesce(c1.half, 0) + {BASE}e0)) AS s1, ln((coalesce(c2.n, 0) + 1e0) / (coalesce(c1.n, 0) + {BASE}e0)) AS s2
  FROM b LEFT JOIN c2 ON b.prev = c2.prev AND b.tok = c2.tok LEFT JOIN c1 ON b.prev = c1.prev WHERE b.prev IS NOT NULL),
every AS (SELECT uid, step, s0, s1, s2, tok FROM (SELECT uid, step FROM fx_len CROSS JOIN fx_steps) e LEFT JOIN lp USING (uid))"""


def ngram_evals(fx):
    return scoring.score_ngram(fx.docs, scoring.fit_ngram(fx.docs.where(F.col("uid") % 5 > 0), BASE))


def per_doc(rows):
    total = F.aggregate("token_logprob", F.lit(0.0), lambda a, x: a + x)
    return rows.select("uid", "step", F.size("token_ids").cast("long").alias("n"), total.alias("total"))


@on_fixture(
    "sco04_score_bigram",
    f"SELECT uid, step, count(tok) AS n, round(coalesce(sum(CASE WHEN tok = 0 THEN 0e0 ELSE s2 END), 0e0), 6) AS total FROM (WITH {NGRAM} SELECT * FROM every WHERE step = 4000) q GROUP BY uid, step",
)
def _(fx):
    return per_doc(ngram_evals(fx).where(F.col("step") == 4000))


# Three quarters are subtracted from every count and go to the shorter context.
TRIGRAM = f"""g AS MATERIALIZED (SELECT uid, pos, tok, lag(tok) OVER d AS p1, lag(tok, 2) OVER d AS p2 FROM fx_docs WINDOW d AS (PARTITION BY uid ORDER BY pos)),
t AS (SELECT * FROM g WHERE uid % 5 > 0),
g1 AS MATERIALIZED (SELECT tok, count(*) AS c FROM t GROUP BY tok), n1 AS (SELECT sum(c) AS n, count(*) AS k FROM g1),
g2 AS MATERIALIZED (SELECT p1, tok, count(*) AS c FROM t WHERE p1 IS NOT NULL GROUP BY ALL), n2 AS MATERIALIZED (SELECT p1, sum(c) AS n, count(*) AS k FROM g2 GROUP BY p1),
g3 AS MATERIALIZED (SELECT p2, p1, tok, count(*) AS c FROM t WHERE p2 IS NOT NULL GROUP BY ALL), n3 AS MATERIALIZED (SELECT p2, p1, sum(c) AS n, count(*) AS k FROM g3 GROUP BY ALL),
s1 AS (SELECT g.*, coalesce(g1.c - 0.75e0, 0) / n1.n + 0.75e0 * n1.k / n1.n / {BASE} AS q1 FROM g CROSS JOIN n1 LEFT JOIN g1 ON g.tok = g1.tok WHERE pos > 0),
s2 AS (SELECT s1.*, CASE WHEN n2.n IS NULL THEN q1 ELSE coalesce(g2.c - 0.75e0, 0) / n2.n + 0.75e0 * n2.k / n2.n * q1 END AS q2
  FROM s1 LEFT JOIN n2 ON s1.p1 = n2.p1 LEFT JOIN g2 ON s1.p1 = g2.p1 AND s1.tok = g2.tok),
s3 AS (SELECT s2.*, CASE WHEN n3.n IS NULL THEN q2 ELSE coalesce(g3.c - 0.75e0, 0) / n3.n + 0.75e0 * n3.k / n3.n * q2 END AS q3
  FROM s2 LEFT JOIN n3 ON s2.p2 = n3.p2 AND s2.p1 = n3.p1 LEFT JOIN g3 ON s2.p2 = g3.p2 AND s2.p1 = g3.p1 AND s2.tok = g3.tok)"""


@on_fixture(
    "sco04_score_trigram",
    f"""SELECT l.uid, 7 AS step, count(tok) AS n, round(coalesce(sum(CASE WHEN tok = 0 THEN 0e0 ELSE ln(q3) END), 0e0), 6) AS total
        FROM (WITH {TRIGRAM} SELECT * FROM s3) q RIGHT JOIN fx_len l ON l.uid = q.uid GROUP BY l.uid""",
)
def _(fx):
    """Back-off over three orders, fitted on four fifths of the documents."""
    model = backoff.fit_backoff(fx.docs.where(F.col("uid") % 5 > 0), BASE, order=3)
    return per_doc(backoff.score_backoff(fx.docs, model, step=7))


@on_fixture(
    "sco05_checkpoints",
    f"""SELECT uid, step, count(tok) AS n, round(coalesce(sum(CASE WHEN tok = 0 THEN 0e0 WHEN step = 0 THEN s0 WHEN step = 2000 THEN s1 ELSE s2 END), 0e0), 6) AS total
        FROM (WITH {NGRAM} SELECT * FROM every) q GROUP BY uid, step""",
)
def _(fx):
    return per_doc(ngram_evals(fx))


@on_fixture("sco06_evaluate", "SELECT l.uid, 0 AS step, l.n - 1 AS n, round(coalesce(total, 0e0), 6) AS total FROM fx_len l LEFT JOIN (SELECT uid, sum(-ln(1e0 + tok)) AS total FROM fx_docs WHERE pos > 0 GROUP BY uid) q USING (uid)")
def _(fx):
    """A model without context scores the same whatever the batches and spans are."""
    return per_doc(scoring.evaluate(fx.docs, lambda inputs, targets: -np.log1p(targets), BUDGET, 128, 64))


# Evaluations of the bigram scorer: first tokens are unscored, so pairs begin at the second one.
SCORED = f"""(WITH {NGRAM},
tagged AS (SELECT *, coalesce(a, pa, tok) AS item, CASE WHEN pa IS NOT NULL THEN pos - 1 ELSE pos END AS place FROM (
  SELECT *, lag(a) OVER (PARTITION BY uid ORDER BY pos) AS pa FROM (
  SELECT x.*, m.tok AS a FROM (SELECT *, lead(tok) OVER (PARTITION BY uid ORDER BY pos) AS nx FROM lp) x LEFT JOIN fx_merges m ON x.tok = m.tok_a AND x.nx = m.tok_b) y) z),
occ AS (SELECT step, uid, item, place, sum(CASE WHEN tok = 0 THEN 0e0 WHEN step = 0 THEN s0 WHEN step = 2000 THEN s1 ELSE s2 END) AS s
  FROM tagged CROSS JOIN fx_steps WHERE item >= {BASE - HALF_WIDTH} AND item < {BASE + HALF_WIDTH} GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY step, item ORDER BY s) - 1 AS rn, count(*) OVER (PARTITION BY step, item) AS n FROM occ)
SELECT step, item AS tok, max(s) FILTER (rn = floor((n-1)*0.5e0 + 0.5e0)) AS median, avg(s) AS mean, stddev_samp(s) AS std,
  max(s) FILTER (rn = floor((n-1)*0.75e0 + 0.5e0)) - max(s) FILTER (rn = floor((n-1)*0.25e0 + 0.5e0)) AS iqr, count(*) AS num, item < {BASE} AS treat FROM ranked GROUP BY step, item)"""


def scored_regression_data(fx):
    return regression_data(fx.docs, stage(ngram_evals(fx), "evals", compression="zstd"), fx.log, BASE, HALF_WIDTH)


@on_fixture("aln07_scored_run", f"SELECT step, tok, round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std, round(iqr, 6) AS iqr, num, treat FROM {SCORED} q")
def _(fx):
    """Regression data of evaluations that the built-in scorer made."""
    return scored_regression_data(fx)


@on_fixture(
    "sta01_scored_run",
    f"""SELECT step, target, n, round((sty*sxx - sxy*sxt) / (sxx*stt - sxt*sxt), 6) AS ate FROM (
        SELECT step, target, count(*) AS n, var_pop(x) AS sxx, var_pop(t) AS stt, covar_pop(x, t) AS sxt, covar_pop(x, value) AS sxy, covar_pop(t, value) AS sty FROM (
        SELECT step, target, value, tok / 1000e0 AS x, CAST(treat AS DOUBLE) AS t FROM (UNPIVOT {SCORED} ON mean, median, std, iqr INTO NAME target VALUE value)) z GROUP BY ALL) y
        WHERE step > 0""",
)
def _(fx):
    """Effects of inclusion on these; before training all scores are equal, so step 0 has nothing to fit."""
    effects = regress.effect_table(scored_regression_data(fx).where(F.col("step") > 0), ["step"])
    return effects.select("step", "target", "n", "ate")


# --- from text to effects ------------------------------------------------------------------------

@on_documents("e2e_text_to_effects", costly=True)
def _(docs):
    """Learn a vocabulary, cut it, encode, score at three checkpoints, align, and estimate the effect of inclusion."""
    model = learned(docs, "bpe")
    encoded = stage(encode.encode_corpus(docs, model, ["doc_id"], vocab_size=CUT), "encoded", compression="zstd")
    evals = stage(scoring.score_ngram(encoded, scoring.fit_ngram(encoded, CUT)), "evals", compression="zstd")
    return cutoff_effects(encoded, evals, model.merges_df(docs.sparkSession), CUT, CUT_WIDTH)


# --- batched maps and streams --------------------------------------------------------------------


@on_fixture("udf01_map_batches", "SELECT uid, n AS length, max_tok AS largest FROM fx_len JOIN (SELECT uid, max(tok) AS max_tok FROM fx_docs GROUP BY uid) q USING (uid)")
def _(fx):
    def measure(batches):
        for batch in batches:
            yield pd.DataFrame(
                {"uid": batch["uid"], "length": batch["input_ids"].map(len), "largest": batch["input_ids"].map(np.max)}
            )

    return scoring.map_batches(fx.docs, measure, "uid long, length long, largest long")


@on_fixture("udf02_user_model", "SELECT uid, 0 AS step, count(*) AS n, round(sum(-ln(1e0 + tok)), 6) AS total FROM fx_docs WHERE pos > 0 GROUP BY uid")
def _(fx):
    def model(batches):
        for batch in batches:
            targets = batch["input_ids"].map(lambda ids: ids[1:])
            yield pd.DataFrame(
                {"uid": batch["uid"], "step": 0, "token_logprob": targets.map(lambda t: -np.log1p(t)), "token_ids": targets}
            )

    return per_doc(scoring.score(fx.docs, model).where(F.size("token_ids") > 0))


@on_fixture("udf02_predict_batch", "SELECT l.uid, 3 AS step, l.n - 1 AS n, round(coalesce(total, 0e0), 6) AS total FROM fx_len l LEFT JOIN (SELECT uid, sum(-ln(1e0 + tok)) AS total FROM fx_docs WHERE pos > 0 GROUP BY uid) q USING (uid)")
def _(fx):
    """A model that each worker loads once, in batches of context spans."""

    def load():
        table = -np.log1p(np.arange(BASE))
        return lambda inputs, targets: table[targets]

    return per_doc(scoring.score_spans(fx.docs, load, window=128, step=64, batch_size=256, at_step=3))


@on_fixture("stm01_incremental_consolidation", CONSOLIDATED)
def _(fx):
    spark = fx.spark
    out, checkpoint = new_path(spark, "stream_out"), new_path(spark, "stream_state")
    for _ in range(2):  # the second pass finds nothing new
        consolidate_available(spark, fx.evals_path, out, checkpoint).awaitTermination()
    return consolidated_summary(readers.scan_parquet(spark, out))
