import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rankcut.llm.runs import find_runs, run_digest, runs_of, with_cycled_tail

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, repeats=4, least=6):
    """Every maximal stretch by its definition."""
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        x = 0
        while x + q < n:
            if words[x] != words[x + q]:
                x += 1
                continue
            end = x
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - x + q
            stretch = words[x : x + length]
            smaller = any(all(stretch[i] == stretch[i + p] for i in range(length - p)) for p in range(1, q))
            if length >= max(least, repeats * q) and not smaller:
                out.append((x, length, q))
            x = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def cycled(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_text(rnd):
    """Few words, so that runs of many periods nest and touch."""
    words = []
    for _ in range(rnd.randrange(1, 6)):
        unit = [rnd.choice("ab") for _ in range(rnd.randrange(1, 9))]
        words += (unit * 9)[: rnd.randrange(1, 9 * len(unit))]
    return words


def test_runs_equal_brute_force_on_small_alphabets():
    rnd = random.Random(5)
    texts = [periodic_text(rnd) for _ in range(400)] + [["a"] * 5, ["a"] * 6, ["a"] * 1000, list("abcabcabcabc"), list("abcabcabcab")]
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    names = np.array([ord(w) for t in texts for w in t], dtype=np.uint64)
    firsts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = {i: [] for i in range(len(texts))}
    for start, length, period in runs_of(names, rows, 4, 6):
        found[rows[start]].append((start - firsts[rows[start]], length, period))
    expected = {i: brute_runs(t) for i, t in enumerate(texts)}
    assert {i: sorted(r, key=lambda x: (x[0], x[2])) for i, r in found.items()} == expected
    assert sum(map(len, expected.values())) > 300


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        words = [rnd.choice("alpha bravo charlie delta echo fox".split()) for _ in range(rnd.randrange(0, 60))]
        words += periodic_text(rnd) if i % 3 == 0 else []
        rows.append((i, rnd.choice([" ", "\n", " \t ", "\x0b"]).join(words) + rnd.choice(["", " ", "\n"])))
    rows += [(1000 + i, "Zürich  😀 ok no " * i) for i in range(9)]
    return rows


def test_query_equals_brute_force(spark, texts):
    got = run_digest(find_runs(with_cycled_tail(spark.createDataFrame(texts, "doc_id long, text string"))), ["doc_id"]).collect()
    assert len(got) == len(texts)
    text_of = dict(texts)
    for r in got:
        words = cycled(r["doc_id"], WORD.findall(text_of[r["doc_id"]]))
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapse(words, runs).encode()).hexdigest()


def test_some_texts_are_cycled(texts):
    changed = [i for i, t in texts if cycled(i, WORD.findall(t)) != WORD.findall(t)]
    assert 5 < len(changed) < 80


def test_awkward_rows(spark, awkward, nothing):
    out = find_runs(awkward)
    assert out.columns == [*awkward.columns, "n_words", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        words = WORD.findall(r["text"] or "")
        assert r["n_words"] == len(words) and r["runs"] == [] and r["collapsed"] == " ".join(words)
    assert find_runs(nothing).collect() == []
    assert run_digest(find_runs(with_cycled_tail(nothing)), ["doc_id"]).collect() == []
    digests = {r["doc_id"]: r for r in run_digest(find_runs(with_cycled_tail(awkward)), ["doc_id"]).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert digests[4]["n_runs"] == 0 and digests[4]["start"] is None and digests[4]["runs_sha256"] == digests[4]["collapsed_sha256"] == empty


def test_added_names_are_replaced_and_may_hold_the_text(spark):
    df = spark.createDataFrame([(1, "x " * 8, 5)], "runs int, collapsed string, n_words int")
    row = find_runs(df, text="collapsed").first()
    assert row["collapsed"] == "x" and row["n_words"] == 8 and [tuple(r) for r in row["runs"]] == [(0, 8, 1)]


def test_one_very_long_periodic_text(spark):
    unit = [f"w{i}" for i in range(5000)]
    df = spark.createDataFrame([(1, " ".join(unit * 60))], "doc_id long, text string")
    row = find_runs(df).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 300_000, 5000)] and row["collapsed"] == " ".join(unit)
