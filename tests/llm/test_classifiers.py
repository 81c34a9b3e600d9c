import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from rankcut.llm.linear import Features, char_windows, feature_parts, ftrl, margins, token_hashes
from rankcut.llm.quality import keep_good, score_quality
from rankcut.llm.rules import platt, quality_rules, text_statistics
from rankcut.llm.text import column_bytes
from rankcut.llm.toxicity import NEAR, SECOND_PERSON, SIGNS, STEMS, dense_features, interpolate, score_toxicity

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_tokens_are_runs_of_one_class_and_cross_no_text():
    data, offsets = column_bytes(pa.array(["ab ab!! ab", "ab", None, "!!"]))
    h, rows = token_hashes(data, offsets)
    assert rows.tolist() == [0, 0, 0, 0, 1, 3]
    assert h[0] == h[1] == h[3] == h[4] and h[2] == h[5] and h[0] != h[2]


def test_byte_windows_stay_inside_a_text():
    data, offsets = column_bytes(pa.array(["abcd", "bcde", "x"]))
    found = [(v.tolist(), r.tolist()) for v, r in char_windows(data, offsets, 3)]
    values, rows = found[0]
    assert rows == [0, 0, 1, 1] and values[1] == values[2]


def test_margin_is_the_mean_weight_of_all_occurrences():
    spec = Features(bits=10, words=(1, 2), chars=(3,))
    w = np.random.default_rng(0).normal(size=1 << 10)
    texts = ["the cat the cat", "", "a"]
    whole = margins(pa.array(texts), w, 0.25, spec)
    assert whole[1] == 0.25
    assert np.allclose(whole, [margins(pa.array([t]), w, 0.25, spec)[0] for t in texts])


def test_regularised_leader_separates_two_sorts():
    texts, y = ["good fine text here", "bad $$$ junk ***"] * 30, np.array([1.0, 0.0] * 30)
    w, b = ftrl(pa.array(texts), y, Features(bits=12))
    m = margins(pa.array(["fine good text", "junk *** $$$"]), w, b, Features(bits=12))
    assert m[0] > 0.5 > -0.5 > m[1]


def test_regularised_leader_equals_its_formulas():
    """One weight at a time, in plain Python: z and n per feature, weights from them before every example."""
    rnd = random.Random(3)
    spec = Features(bits=8, words=(1, 2))
    texts = [" ".join(rnd.choice(["a", "b", "c", "dd", "!!", "e"]) for _ in range(rnd.randrange(0, 9))) for _ in range(40)]
    y = [float(t.count("a") > t.count("b")) for t in texts]
    alpha, beta, l1, l2, scale = 0.7, 1.0, 0.05, 0.01, 32.0
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(2):
        for text, label in zip(texts, y):
            data, offsets = column_bytes(pa.array([text]))
            slots = Counter(s for part, _ in feature_parts(data, offsets, spec) for s in part.tolist())
            x = {i: c * scale / max(sum(slots.values()), 1) for i, c in slots.items()} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items()))) - label
            for i, v in x.items():
                sigma = (math.sqrt(n.get(i, 0.0) + (g * v) ** 2) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g * v - sigma * w[i]
                n[i] = n.get(i, 0.0) + (g * v) ** 2
    found, bias = ftrl(pa.array(texts), np.array(y), spec, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    expected = np.array([weight(i) * scale for i in range(1 << 8)])
    assert np.allclose(found, expected) and bias == pytest.approx(weight("bias")) and (expected != 0).sum() > 10


def test_statistics_equal_brute_force():
    rnd = random.Random(6)
    pool = ["a", "b", "ab", "é", "日本", "#", "x|y", "<z>", "%"]
    texts = ["".join(rnd.choice(pool) + rnd.choice([" ", "\n", "  ", "\t", "\n\n", "\x0b", " \n"]) for _ in range(rnd.randrange(0, 60))) for _ in range(300)]
    texts += [None, "", " \n\n ", "a\n" * 50, "x" * 5000]
    found = text_statistics(pa.array(texts))
    for i, text in enumerate(texts):
        text = text or ""
        w = re.findall("[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        thrice = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if thrice[tuple(w[k : k + 3])] > 1 for j in range(3)}
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(found[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected, text


def dense_by_hand(text, lexicon, stems):
    """The features of one text from its words; ``lexicon``: words, ``stems``: (size, beginning), both to log odds."""
    terms = [t.encode() for t in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text)]
    lower = [t.lower() for t in terms]
    n = max(len(terms), 1)
    whole = [t in lexicon for t in lower]
    begun = [[stems[k, t[:k]] for k in STEMS if len(t) > k and (k, t[:k]) in stems] for t in lower]
    hits = [a or bool(b) for a, b in zip(whole, begun)]
    second = [t.decode() in SECOND_PERSON for t in lower]
    near = [h and any(second[max(0, i - NEAR) : i + NEAR + 1]) for i, h in enumerate(hits)]
    strongest = max([0.0, *[lexicon[t] for t in lower if t in lexicon], *[o for b in begun for o in b]])
    data = text.encode()
    letters = sum(chr(b).isalpha() and b < 128 or b >= 128 for b in data)
    mixed = unmasked = 0
    for m in re.findall("[^\x20\x09-\x0D]+", text):
        b = m.encode()
        is_letter = lambda c: c >= 128 or chr(c).isalpha()
        if is_letter(b[0]) and is_letter(b[-1]) and not all(map(is_letter, b)):
            mixed += 1
            unmasked += bytes(ord(SIGNS[chr(c)]) if chr(c) in SIGNS else c for c in b).lower() in lexicon
    return [
        sum(whole) / n, sum(map(bool, begun)) / n, math.log1p(sum(hits)), strongest, sum(near) / n, sum(second) / n, sum(65 <= b <= 90 for b in data) / max(letters, 1),
        sum(len(t) > 1 and all(65 <= b <= 90 for b in t) for t in terms) / n, sum(33 <= b < 127 and not chr(b).isalnum() for b in data) / max(len(data), 1),
        data.count(b"!") / max(len(data), 1), mixed / n, unmasked / n, math.log1p(len(terms)),
    ]


def test_dense_features_equal_brute_force():
    """Many texts in one batch: nothing of a text counts for its neighbours."""
    rnd = random.Random(9)
    odds_of = {b"idiot": 2.0, b"fool": 1.5, b"du": 0.5}
    stems = {(STEMS[0], b"stupidity"[: STEMS[0]]): 1.25}
    from rankcut.llm.toxicity import _stem_hashes, hash_of_words
    from rankcut.llm.text import FOLDED_TERMS, words

    entries = {int(hash_of_words([w.decode()])[0]): o for w, o in odds_of.items()}
    for (size, beginning), o in stems.items():
        data, offsets = column_bytes(pa.array([beginning.decode() + "x"]))
        _, s, e = words(data, offsets, FOLDED_TERMS)
        entries[int(_stem_hashes(data, s, e, size)[0])] = o
    hashes = np.array(sorted(entries), np.uint64)
    odds = np.array([entries[int(h)] for h in hashes])
    pool = ["you", "Idiot", "FOOL", "fool!", "f00l", "i.d.i0t", "stupidity", "STUPID", "the", "cat", "DU", "1dog", "é", "a-b", "!!", "d@u", "x", "tes"]
    texts = [rnd.choice([" ", "\n"]).join(rnd.choice(pool) for _ in range(rnd.randrange(0, 25))) for _ in range(300)] + [None, "", "!", "idiot", "you", "idiot"]
    found = dense_features(pa.array(texts), hashes, odds)
    for text, row in zip(texts, found):
        assert row == pytest.approx(dense_by_hand(text or "", odds_of, stems)), text


def test_statistics_on_hand_made_texts():
    s = text_statistics(pa.array(["a b c\na b c\n\n \nx#", None, "é é", "a a a a"]))
    assert s["n_words"].tolist() == [7, 0, 2, 4]
    assert s["word_chars"].tolist() == [8, 0, 2, 4]
    assert s["n_symbols"].tolist() == [1, 0, 0, 0]
    assert s["n_dup_lines"].tolist() == [1, 0, 0, 0]
    assert s["n_repeat_words"].tolist() == [6, 0, 0, 4]


def test_calibration_follows_the_labels():
    m = np.linspace(-3, 3, 200)
    slope, shift = platt(m, (m > 1).astype(float))
    assert slope > 1 and abs(-shift / slope - 1) < 0.2
    assert platt(m, np.ones(200)) == (1.0, 0.0)


def test_steps_are_interpolated(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.25, 0.5, 2.0)], "p double")
    got = [r[0] for r in df.select(interpolate(df.p, [0.0, 0.5], [0.0, 1.0])).collect()]
    assert got == [0.0, 0.0, 0.5, 1.0, 1.0]


def test_dense_features_of_an_empty_text_are_zero():
    x = dense_features(pa.array(["", None, "You IDIOT!!"]), np.zeros(0, np.uint64), np.zeros(0))
    assert not x[:2].any() and x[2, 5] > 0 and x[2, 6] > 0 and x[2, 9] > 0


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_awkward_rows_are_all_scored(awkward, labels, score):
    rows = score(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)


@pytest.mark.parametrize("score", [score_quality, score_toxicity, quality_rules])
def test_empty_tables(nothing, awkward, labels, score):
    assert score(nothing, labels).count() == 0
    assert score(awkward, labels.limit(0)).count() == awkward.count()


def test_rules_judge_awkward_rows(awkward, labels):
    rows = quality_rules(awkward, labels).collect()
    assert len(rows) == awkward.count()
    assert all(r["base_failed"] for r in rows if r["n_words"] < 50) and not any(r["kept"] and r["base_failed"] for r in rows)


def test_good_documents_keep_every_column(awkward, labels):
    kept = keep_good(awkward, labels)
    assert kept.schema.names == awkward.schema.names and kept.count() <= awkward.count()


@needs_data
@pytest.mark.parametrize(("score", "target", "least"), [(score_quality, "quality", 0.9), (score_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, score, target, least):
    documents, labels = tables(spark)
    rows = score(documents, labels).where("held_out").join(labels, "doc_id").select("predicted", target).collect()
    assert len(rows) > 50 and sum(a == b for a, b in rows) / len(rows) >= least


@needs_data
def test_verdicts_follow_the_labels(spark):
    documents, labels = tables(spark)
    rows = quality_rules(documents, labels).where("not base_failed").join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").select("kept", "quality").collect()
    assert sum(a == bool(b) for a, b in rows) / len(rows) > 0.9
