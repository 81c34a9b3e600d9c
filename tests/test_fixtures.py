import math
import os

import numpy as np
import pytest

from rankcut.plans import fixtures
from rankcut.session import scratch_dir

TEXTS = [(1, "b a b c"), (2, "a 12ab, b"), (2, "c c"), (3, None), (4, " ,"), (5, "b")]


@pytest.mark.parametrize("bound", [0, 100])
def test_token_arrays_in_place_and_by_join(spark, bound):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = {r["uid"]: list(r["input_ids"]) for r in fixtures.token_arrays(docs, bound).collect()}
    # b 3, c 3, a 2, 12 and ab once: ids by count, then word. Documents of equal number are one, by position.
    ids = {"b": 0, "c": 1, "a": 2, "12": 3, "ab": 4}
    assert got[1] == [ids[w] for w in "babc"] and got[5] == [0] and set(got) == {1, 2, 5}
    assert got[2] == [ids[w] for w in ("c", "a", "c", "12", "ab", "b")]


def test_token_arrays_in_place_do_not_shuffle_words(spark):
    docs = spark.createDataFrame([(1, "b a b c")], "doc_id long, text string")
    plan = fixtures.token_arrays(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_eval_arrays_follow_the_formula(spark):
    rows = [(u, np.arange(u, 2 * u).tolist()) for u in (1, 2, 3, 4, 6, 40)]
    docs = spark.createDataFrame(rows, "uid long, input_ids array<int>")
    got = {r["uid"]: r for r in fixtures.eval_arrays(docs, 2000, 1).collect()}
    for uid, ids in rows:
        scores = [-math.log(2 + (uid * 31 + p * 17 + t * 7 + 2000) % 997) * 1.1 for p, t in enumerate(ids)]
        pad, cut = uid % 3, int(uid % 3 == 0)
        assert list(got[uid]["token_ids"]) == [0] * pad + ids[cut:]
        assert list(got[uid]["token_logprob"]) == pytest.approx([0.0] * pad + scores[cut:])


def test_inputs_are_written_when_they_are_read(spark):
    docs = spark.createDataFrame([(i, "a b a c b") for i in range(9)], "doc_id long, text string")
    fx = fixtures.Fixture(docs)
    assert fx.log.count() > 0
    folder = fx._evals_path.removeprefix("file:")
    assert folder.startswith(scratch_dir(spark).removeprefix("file:")) and not os.path.exists(folder)
    assert fx.evals.count() == 27 and os.listdir(folder) == [f"{fixtures.RUNS[0]}_{fixtures.STAMP}"]
    fx.evals_path
    assert len(os.listdir(folder)) == 2


def test_only_uses_of_rare_words_are_joined(spark):
    rows = [*TEXTS, (None, "c b zz"), (None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = {r["uid"]: list(r["input_ids"]) for r in fixtures.token_arrays(docs, 100).collect()}
    for bound in (1, 2, 4):
        assert {r["uid"]: list(r["input_ids"]) for r in fixtures.token_arrays(docs, bound).collect()} == every
    texts = spark.createDataFrame([(1, ["b", "a", "c"]), (2, ["c"]), (3, ["b"])], "uid long, words array<string>")
    vocab = spark.createDataFrame([("b", 0), ("c", 1), ("a", 2)], "word string, id long")
    got = {r["uid"]: (list(r["input_ids"]), [tuple(x) for x in r["rest"]]) for r in fixtures._ids_in_place(texts.coalesce(1), vocab, 2).collect()}
    assert got == {1: ([0, None, 1], [(1, "a")]), 2: ([1], []), 3: ([0], [])}


def test_words_are_those_of_the_regular_expression(spark, monkeypatch):
    odd = [None, "", " ", "a", "12ab3 c", "é12½١٢日本語 x", "ª º. ŉ𝐀𝟘𐐷 👍🏽 m", "x\u0301y _z-9 \u200dq", "".join(map(chr, range(0x20, 0x3000, 7))), "".join(map(chr, range(0x1D400, 0x1D800))), "a", "b\x00c"]
    rows = [(i, t) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = docs.select("doc_id", fixtures.F.regexp_extract_all("text", fixtures.F.lit(fixtures.WORD), fixtures.F.lit(0)).alias("w")).collect()
    texts = fixtures.pa.array(["zz"] + odd, fixtures.pa.string()).slice(1)
    assert fixtures.split_words(texts, fixtures.char_classes(spark)).to_pylist() == [list(r["w"] or []) for r in sorted(expected)]
    monkeypatch.setattr(fixtures, "COUNTED_WORDS", 10)
    counts = {r["word"]: r["n"] for r in fixtures.count_words(docs).collect()}
    plain = [w for r in expected for w in r["w"] or []]
    assert counts == {w: plain.count(w) for w in plain}


def test_words_are_counted_before_they_are_handed_on(spark):
    docs = spark.createDataFrame([(1, "b a b c")], "doc_id long, text string")
    plan = fixtures.count_words(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
