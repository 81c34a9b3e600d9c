import math
import random

import pytest
from pyspark.sql import functions as F

from rankcut.operators import encode, lattice, suffixes, unigram, vocab

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "the cat sat on the mat, and the other cat's hat sat there too!",
    "Das Mädchen hört Töne — über 1,234 Bäume; naïve café  \n\n  tabs\tand   spaces   ",
    "don't we'll they're I'd she's x9y8 aaaa aaaaaa aaa  日本語のテキスト 🙂🙂 end ",
    "lower lowest newer newest wider widest low low low newer wide　wide  ",
    "",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    stems = ["low", "new", "wid", "fast", "slow", "hö", "na", "ban", "an"]
    ends = ["er", "est", "ing", "ly", "ana", "a", "", "ö"]
    made = [" ".join(rng.choice(stems) + rng.choice(ends) for _ in range(60)) for _ in range(20)]
    return spark.createDataFrame(list(enumerate(TEXTS + made)), "doc_id long, text string").persist()


def corpus(docs):
    return [r["text"] for r in docs.orderBy("doc_id").collect()]


def test_words_match_the_byte_level_pretokeniser(docs):
    pre = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    rows = docs.select("text", F.transform(vocab.words_of(F.col("text")), vocab.to_byte_chars).alias("w")).collect()
    for r in rows:
        assert r["w"] == [w for w, _ in pre.pre_tokenize_str(r["text"])], r["text"]


def test_byte_chars_round_trip(docs):
    assert sorted(vocab.byte_alphabet()) == sorted(tokenizers.pre_tokenizers.ByteLevel.alphabet())
    rows = docs.select("text", vocab.from_byte_chars(vocab.to_byte_chars(F.col("text"))).alias("back")).collect()
    assert all(r["text"] == r["back"] for r in rows)


def test_symbols_skip_surrogates():
    for i in (0, 1, 55_000, 0xD800 - 0x101, 0xD800 - 0x100, 60_000, 320_000):
        ch = vocab.symbol(i)
        assert vocab.symbol_id(ch) == i
        assert ch.encode("utf-8")
    assert vocab.symbol(1000) < vocab.symbol(60_000) < vocab.symbol(320_000)


def one_at_a_time(words, vocab_size):
    """Plain byte-pair learning: recount everything after every single merge."""
    tokens, ids = vocab._initial_tokens([vocab.EOS_TOKEN])
    table = [([ids[b] for b in w.encode()], n) for w, n in words]
    known, merges = {t: i for i, t in enumerate(tokens)}, []
    while len(tokens) < vocab_size:
        counts = {}
        for parts, n in table:
            for p in zip(parts, parts[1:]):
                counts[p] = counts.get(p, 0) + n
        best = min((p for p in counts if counts[p] >= 2), key=lambda p: (-counts[p], p), default=None)
        if best is None:
            break
        token = tokens[best[0]] + tokens[best[1]]
        if token not in known:
            known[token] = len(tokens)
            tokens.append(token)
        merges.append((list(best), token, counts[best]))
        for parts, _ in table:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == best:
                    parts[i : i + 2] = [known[token]]
                i += 1
    return tokens, merges


@pytest.mark.parametrize(("candidates", "max_segments", "merges"), [(64, 200_000, 90), (3, 40, 20), (1, 1, 6)])
def test_batched_merges_equal_one_at_a_time(spark, docs, candidates, max_segments, merges):
    words = [(r["word"], r["n"]) for r in vocab.word_counts(docs).collect()]
    tokens, expected = one_at_a_time(words, 257 + merges)
    got = vocab.learn_bpe(docs, 257 + merges, candidates=candidates, max_segments=max_segments)
    assert got.tokens == tokens
    assert [(m[0], m[1], m[5]) for m in got.merges] == expected


@pytest.mark.parametrize("seed", range(3))
def test_batched_merges_on_dense_random_words(spark, seed):
    rng = random.Random(seed)
    words = {}
    for _ in range(200):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        words[w] = words.get(w, 0) + rng.randrange(1, 4)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = vocab.learn_merges(table, 257 + 40)
    tokens, merges = one_at_a_time(list(words.items()), 257 + 40)
    assert got.tokens == tokens
    assert [(m[0], m[1], m[5]) for m in got.merges] == merges


def test_a_round_rewrites_words_by_its_stretches(spark):
    """Pairs, stretches and rewriting against plain string work; a stretch that is not listed is merged in order."""
    rng = random.Random(4)
    words = [("".join(rng.choice("abcd\U00012345") for _ in range(rng.randrange(0, 12))), rng.randrange(1, 5)) for _ in range(300)]
    table = spark.createDataFrame(words, "sym string, n long").repartition(3)
    pairs, stretches = {}, {}
    wanted = ["ab", "ba", "b\U00012345", "cc"]
    for w, n in words:
        for p in map("".join, zip(w, w[1:])):
            pairs[p] = pairs.get(p, 0) + n
        start = 0
        for i in range(1, len(w) + 1):
            if i == len(w) or w[i - 1 : i + 1] not in wanted:
                if i - start > 1:
                    stretches[w[start:i]] = stretches.get(w[start:i], 0) + n
                start = i
    assert {r["pair"]: r["n"] for r in vocab.pair_counts(table).collect()} == pairs
    assert {r["segment"]: r["n"] for r in vocab.segment_counts(table, wanted).collect()} == stretches
    merges = [("ab", "X"), ("Xb", "Y"), ("cc", "Z")]  # "Xb" lies in no stretch
    known = {t: vocab._merge_in_order(t, {p: (i, m) for i, (p, m) in enumerate(merges)}) for t in list(stretches)[::2]}
    got = sorted(tuple(r) for r in vocab._rewritten(table, wanted, [merges[0], merges[2]], {t: m for t, m in known.items() if "Y" not in m}).collect())
    assert got == sorted((w.replace("ab", "X").replace("cc", "Z"), n) for w, n in words)
    seen = []
    became = vocab.replay([("abab", 3), ("abb", 1)], 2, lambda pair, n: (seen.append((pair, n)) or "XY"[len(seen) - 1], len(seen) < 2))
    assert seen == [("ab", 7), ("XX", 3)] and became == ["Y", "Xb"]


def trained(docs, size):
    tok = tokenizers.Tokenizer(tokenizers.models.BPE())
    tok.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    trainer = tokenizers.trainers.BpeTrainer(
        vocab_size=size, special_tokens=[vocab.EOS_TOKEN], initial_alphabet=tokenizers.pre_tokenizers.ByteLevel.alphabet(), min_frequency=2, show_progress=False
    )
    tok.train_from_iterator(corpus(docs), trainer)
    return tok


def test_learned_vocabulary_and_ids_match_the_library(spark, docs):
    size = 257 + 90
    expected = trained(docs, size)
    got = vocab.learn_bpe(docs, size)
    assert {t: i for i, t in enumerate(got.tokens)} == expected.get_vocab()
    rows = encode.encode_docs(docs, got).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        assert list(r["input_ids"]) == expected.encode(texts[r["doc_id"]]).ids
    smaller = {r["doc_id"]: r["input_ids"] for r in encode.encode_docs(docs, got, 257 + 30).collect()}
    expected = trained(docs, 257 + 30)
    assert all(list(ids) == expected.encode(texts[d]).ids for d, ids in smaller.items())


def test_encode_decode_round_trip(spark, docs):
    got = vocab.learn_bpe(docs, 257 + 40)
    encoded = encode.encode_corpus(docs, got, ["doc_id"], keep=["doc_id"])
    rows = encoded.orderBy("doc_id").collect()
    assert [r["uid"] for r in rows] == list(range(len(rows)))
    back = {r["doc_id"]: r["text"] for r in encode.decode_docs(encoded, got.vocab_df(spark), "doc_id").collect()}
    assert all(back[r["doc_id"]] == r["text"] for r in docs.collect())
    odd = spark.createDataFrame([(1, []), (2, None)], "uid long, input_ids array<int>")
    assert {r["uid"]: r["text"] for r in encode.decode_docs(odd, got.vocab_df(spark)).collect()} == {1: "", 2: None}
    with pytest.raises(Exception, match="KeyError"):
        encode.decode_docs(spark.createDataFrame([(1, [10**6])], "uid long, input_ids array<int>"), got.vocab_df(spark)).collect()


def test_longest_match():
    ids = {"<|unk|>": 0, "a": 1, "b": 2, "ab": 3, "##b": 4, "##ab": 5, "abc": 6}
    assert encode.longest_match("abab", ids, 0) == [3, 3]
    assert encode.longest_match("aab", ids, 0, "##") == [1, 5]
    assert encode.longest_match("abx", ids, 0) == [0]
    assert encode.longest_match("a" * 101, ids, 0) == [0]
    assert encode.longest_match("", ids, 0) == []


def test_longest_match_equals_the_library(spark, docs):
    got = vocab.learn_bpe(docs, 257 + 60)
    model = tokenizers.models.WordPiece({t: i for i, t in enumerate(got.tokens)}, unk_token=vocab.EOS_TOKEN, continuing_subword_prefix="", max_input_chars_per_word=100)
    expected = tokenizers.Tokenizer(model)
    expected.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    long = spark.createDataFrame([(900, "x" * 100 + " " + "y" * 101 + " z")], "doc_id long, text string")
    every = docs.unionByName(long)
    texts = {r["doc_id"]: r["text"] for r in every.collect()}
    for r in encode.encode_docs(every, got, kind="longest").collect():
        assert list(r["input_ids"]) == expected.encode(texts[r["doc_id"]]).ids


def test_wordpiece_learner(spark, docs):
    got = vocab.learn_wordpiece(docs, 258 + 150)
    assert got.tokens[:2] == [vocab.EOS_TOKEN, vocab.UNK_TOKEN]
    assert len(got.tokens) == len(set(got.tokens)) == 258 + 150
    for pair, token, new_id, a, b, n in got.merges:
        assert got.tokens[new_id] == token == a + b.removeprefix("##") and n >= 2
        assert b.startswith("##") and token.startswith("##") == a.startswith("##")
    counts = [m[5] for m in got.merges]
    assert counts == sorted(counts, reverse=True)
    rows = encode.encode_docs(docs, got, kind="wordpiece", prefix="##").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    alphabet = vocab.byte_alphabet()
    for r in rows:
        spelled = "".join(got.tokens[i].removeprefix("##") for i in r["input_ids"])
        assert spelled == "".join(alphabet[b] for b in texts[r["doc_id"]].encode())


def test_repeated_substrings_equal_brute_force(spark):
    """Also when neighbours in the sorted suffixes lie in different partitions, and across the stretches of a long word."""
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 30))) for _ in range(200)} | {"ab" * 700, "z"})
    seen: dict[str, list[str]] = {}
    for w in words:
        closed = w + "\0"
        for i in range(len(w)):
            for k in range(2, 17):
                if i + k <= len(w):
                    seen.setdefault(w[i : i + k], []).append(closed[i + k])
    expected = {p: len(after) for p, after in seen.items() if len(set(after)) > 1}
    table = spark.createDataFrame([(w,) for w in words], "w string").repartition(7)
    got = [tuple(r) for r in suffixes.repeated_substrings(table, 16).collect()]
    assert len(got) == len(dict(got)) and dict(got) == expected
    assert suffixes.repeated_substrings(table.limit(0), 16).collect() == []


def test_unigram_learner(spark, docs):
    model = unigram.learn_unigram(vocab.word_counts(docs), 300, seed_size=400)
    rows = sorted(model.pieces.collect())
    pieces = [r["piece"] for r in rows]
    assert [r["id"] for r in rows] == list(range(300)) and len(set(pieces)) == 300
    assert set(vocab.byte_alphabet()) <= set(pieces) and pieces[:2] == unigram.SPECIALS
    scores = [r["logprob"] for r in rows[2:]]
    assert scores == sorted(scores, reverse=True) and max(scores) < 0
    assert model.history[1] >= model.history[0] - 1e-6 * abs(model.history[0])


def segmentations(w, logp):
    if not w:
        yield []
    for k in range(1, len(w) + 1):
        if w[:k] in logp:
            yield from ([w[:k], *rest] for rest in segmentations(w[k:], logp))


LOGP = {p: math.log(v) for p, v in {"a": 0.2, "b": 0.25, "c": 0.04, "ab": 0.3, "ba": 0.1, "abc": 0.01, "bb": 0.1}.items()}


@pytest.fixture(scope="module")
def small_lattice(spark):
    words = [("abab", 3), ("a", 1), ("bbabc", 2), ("cabba", 1), ("ab" * 8, 1), ("", 4)]
    scores = spark.createDataFrame([(p, s, len(p) == 1) for p, s in LOGP.items()], "piece string, logprob double, single boolean")
    lattice_of = lambda rows: lattice.build_lattice(spark.createDataFrame(rows, "w string, n long"), scores, 16)
    return words, scores, lattice_of(words), lattice_of([(p, 1) for p in LOGP if len(p) > 1])


def test_expected_counts_by_enumeration(small_lattice):
    words, scores, over_words, _ = small_lattice
    got = {r["piece"]: r["expected"] for r in unigram.expected_counts(over_words, scores).collect()}
    expected, loglik = dict.fromkeys(LOGP, 0.0), 0.0
    for w, n in words:
        ways = [(s, math.exp(sum(LOGP[p] for p in s))) for s in segmentations(w, LOGP)]
        z = sum(v for _, v in ways)
        loglik += n * math.log(z)
        for s, v in ways:
            for p in s:
                expected[p] += n * v / z
    assert got.pop("") == pytest.approx(loglik)
    assert got == pytest.approx({p: c for p, c in expected.items() if p in got}) and all(c == 0 for p, c in expected.items() if p not in got)


def best_of(w, logp, whole=True):
    ways = [s for s in segmentations(w, logp) if whole or len(s) > 1]
    return max(ways, key=lambda s: sum(logp[p] for p in s), default=None)


def test_best_paths_and_losses_by_enumeration(spark, small_lattice):
    words, scores, over_words, over_pieces = small_lattice
    used: dict[str, int] = {}
    for w, n in words:
        for p in best_of(w, LOGP) or []:
            used[p] = used.get(p, 0) + n
    counted = unigram.viterbi_counts(over_words, scores)
    assert {r["piece"]: r["n"] for r in counted.collect()} == used
    losses = {r["piece"]: r["loss"] for r in unigram.piece_losses(scores, counted, unigram.replacements(over_pieces, scores), 12).collect()}
    total, expected = sum(used.values()), {}
    for p in LOGP:
        n = used.get(p, 0)
        if len(p) == 1:
            continue
        if best_of(p, LOGP) != [p]:
            if n:
                expected[p] = math.inf
            continue
        instead = best_of(p, LOGP, whole=False)
        other = sum(math.log(used.get(q, 0) + n) for q in instead) - len(instead) * math.log(total + n * (len(instead) - 1)) if n else 0
        if n:
            expected[p] = n / 12 * (math.log(n) - math.log(total) - other)
    assert losses == pytest.approx(expected)
    kept = unigram.pruned(scores, unigram.piece_losses(scores, counted, unigram.replacements(over_pieces, scores), 12), 4)
    assert {r["piece"] for r in kept.collect()} == {"a", "b", "c", max(expected, key=expected.get)}


def test_digamma(spark):
    row = spark.range(1).select(*[unigram._digamma(F.lit(x)).alias(str(i)) for i, x in enumerate((0.5, 1.0, 6.999, 7.0, 1e6))]).first()
    assert list(row) == pytest.approx([-1.9635100260214235, -0.5772156649015329, 1.8726308, 1.8727843350984671, 13.815510057964191], rel=1e-6)


def test_unigram_ids_equal_the_library(spark, docs):
    """With the whole vocabulary, and cut so that single bytes are unknown."""
    model = unigram.learn_unigram(vocab.word_counts(docs), 700).learned()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for size in (len(model.tokens), 320):
        library = tokenizers.models.Unigram(list(zip(model.tokens, model.scores))[:size], unk_id=0)
        expected = tokenizers.Tokenizer(library)
        expected.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        rows = encode.encode_docs(docs, model, size, kind="unigram").collect()
        assert all(list(r["input_ids"]) == expected.encode(texts[r["doc_id"]]).ids for r in rows)


def test_cuts(spark):
    table = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id int, token string")
    assert vocab.cut_vocab(table, 4).count() == 4
    cut = vocab.cut_many(table, [3, 5], "bpe", "c", "src")
    assert {(r["tok_name"], r["n"]) for r in cut.groupBy("tok_name").agg(F.count("*").alias("n")).collect()} == {("bpe3c", 3), ("bpe5c", 5)}
    ranked = table.withColumnRenamed("id", "rank")
    assert vocab.cut_merges(ranked, 7, 4).count() == 3


def test_lattice_pieces_are_numbered_once(spark, monkeypatch):
    """Not per part: no table grows with parts times pieces, and the edges are those of brute force, also in long words."""
    monkeypatch.setattr(lattice, "PART_CHARS", 40)
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abcö") for _ in range(rnd.randrange(1, 25))) for _ in range(60)} | {"abz" * 300})
    pieces = sorted({*"abc", "ab", "aba", "bca", "öa", "cab" * 5, "zab", "abzabza"})
    scores = spark.createDataFrame([(p, -1.0) for p in pieces], "piece string, logprob double")
    built = lattice.build_lattice(spark.createDataFrame([(w, 1) for w in words], "w string, n long"), scores, 16)
    assert built.blocks.count() > 1
    assert sorted(tuple(r) for r in built.pieces.select("pid", "piece").collect()) == list(enumerate(pieces))
    text, at, length, piece = lattice.Trie(pieces).edges(words, 16)
    got = set(zip(text.tolist(), at.tolist(), length.tolist(), piece.tolist()))
    known = {p: i for i, p in enumerate(pieces)}
    assert got == {(k, i, n, known[w[i : i + n]]) for k, w in enumerate(words) for i in range(len(w)) for n in range(1, 17) if i + n <= len(w) and w[i : i + n] in known}
    assert len(got) == len(text)


@pytest.mark.parametrize("memo", [3, 10**6])
def test_words_are_looked_up_once_per_batch(spark, docs, memo, monkeypatch):
    """A word that stands everywhere costs one look-up per batch, and a full memory keeps its younger words."""
    monkeypatch.setattr(encode, "_MEMO_WORDS", memo)
    learned = vocab.learn_bpe(docs, 257 + 60)
    tokens, ranks = {t: i for i, t in enumerate(learned.tokens)}, {}
    for rank, m in enumerate(learned.merges):
        ranks.setdefault(tuple(m[0]), (rank, m[2]))

    def plain(word):
        parts = [tokens[c] for c in word]
        while found := [(ranks[p], p) for p in zip(parts, parts[1:]) if p in ranks]:
            (_, made), pair = min(found)
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == pair:
                    parts[i : i + 2] = [made]
                i += 1
        return parts

    alphabet = vocab.byte_alphabet()
    udf = encode.encode_words(F.col("words"), learned, spark)
    rows = docs.select(vocab.words_of(F.col("text")).alias("words")).where("size(words) % 2 = 1 or size(words) = 0 or size(words) > 20").select("words", udf.alias("ids")).collect()
    for r in rows:
        assert list(r["ids"]) == [i for w in r["words"] for i in plain("".join(alphabet[b] for b in w.encode()))]
    chosen = {w: plain(w) for w in ("aaaaa", "ananana", "aaaa", "lowlow", "")}
    assert {w: encode.merge_word(w, tokens, ranks) for w in chosen} == chosen


@pytest.mark.parametrize("memo", [3, 10**6])
def test_a_word_is_encoded_once_per_batch(spark, docs, memo, monkeypatch):
    """However small the memory: it made every use of a word beyond it an encoding."""
    made, calls = encode._word_encoder, spark.sparkContext.accumulator(0)

    def counting(*args):
        one = made(*args)

        def counted(word):
            calls.add(1)
            return one(word)

        return counted

    monkeypatch.setattr(encode, "_MEMO_WORDS", memo)
    monkeypatch.setattr(encode, "_word_encoder", counting)
    learned = vocab.learn_bpe(docs, 257 + 60)
    texts = spark.createDataFrame([(i, " ".join(f"w{k}" for k in "abcdefghij" * 20)) for i in range(5)], "doc_id long, text string").coalesce(1)
    rows = encode.encode_docs(texts, learned).collect()
    distinct = texts.select(F.explode(vocab.words_of(F.col("text"))).alias("w")).distinct().count()
    assert calls.value == distinct and len({tuple(r["input_ids"]) for r in rows}) == 1


def test_ids_outside_the_vocabulary_fail(spark):
    table = spark.createDataFrame([(0, "a"), (5, "b")], "id int, token string")
    for ids in ([3], [-1], [0, None]):
        with pytest.raises(Exception, match="KeyError"):
            encode.decode_docs(spark.createDataFrame([(1, ids)], "uid long, input_ids array<int>"), table).collect()
    kept = spark.createDataFrame([(1, [5, 0, 5]), (2, None), (3, []), (4, [0])], "uid long, input_ids array<int>").coalesce(1)
    assert {r["uid"]: r["text"] for r in encode.decode_docs(kept, table).collect()} == {1: "bab", 2: None, 3: "", 4: "a"}
