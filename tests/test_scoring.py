import math
import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankcut.operators import backoff, ordering, scoring


def docs_of(spark, lengths):
    return spark.createDataFrame([(u, list(range(1, n + 1))) for u, n in enumerate(lengths)], "uid long, input_ids array<int>")


def generator_batches(lengths, budget):
    """Batches of the length-sorted documents, one document at a time."""
    batches, batch = [], []
    for n in sorted(lengths, reverse=True):
        batch.append(n)
        if max(batch) * (len(batch) + 1) > budget:
            batches.append(batch)
            batch = []
    return batches + [batch] if batch else batches


@pytest.mark.parametrize("seed", range(200))
def test_layout_equals_the_generator(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 3, 5, 8, 13, 60]) if rng.random() < 0.7 else rng.randrange(1, 100) for _ in range(rng.randrange(1, 60))]
    budget = rng.randrange(1, 200)
    histogram = [(n, lengths.count(n)) for n in set(lengths)]
    layout = {row[0]: row for row in scoring.batch_layout(histogram, budget)}
    sizes = {}
    for rank, n in enumerate(sorted(lengths, reverse=True)):
        _, open_batch, _, open_len, first_start, first_batch, size = layout[n]
        batch, width = (first_batch + (rank - first_start) // size, n) if rank >= first_start else (open_batch, open_len)
        sizes.setdefault(batch, []).append((n, width))
    expected = generator_batches(lengths, budget)
    assert [[n for n, _ in sizes[b]] for b in sorted(sizes)] == expected
    assert all(width == max(n for n, _ in members) for members in sizes.values() for _, width in members)


def test_pack_and_collate(spark):
    docs = docs_of(spark, [20, 60, 10, 50, 20])
    packed = scoring.pack_batches(docs, 100)
    rows = packed.orderBy("rank").collect()
    assert [(r["len"], r["batch_id"], r["batch_len"]) for r in rows] == [(60, 0, 60), (50, 1, 50), (20, 1, 50), (20, 2, 20), (10, 2, 20)]
    for r in scoring.collate(docs, packed).collect():
        ids = r["input_ids"]
        assert len(ids) == r["batch_len"] and [i for i in ids if i] == ids[ids.count(0) :]


def test_span_plan_example(spark):
    rows = scoring.scoring_spans(docs_of(spark, [10]), 4, 2).collect()
    assert [(r["start"], r["end"], r["scored"]) for r in rows] == [(0, 4, 4), (2, 6, 2), (4, 8, 2), (6, 9, 1)]
    with pytest.raises(ValueError):
        scoring.span_plan(F.lit(3), 2, 4)


@pytest.mark.parametrize("window, step", [(4, 2), (4, 4), (5, 1), (512, 256)])
def test_every_target_is_scored_once(spark, window, step):
    lengths = list(range(0, 40)) + [512, 513, 514, 769, 1500]
    spans = {}
    for r in scoring.scoring_spans(docs_of(spark, lengths), window, step).collect():
        spans.setdefault(r["uid"], []).append((r["start"], r["end"], r["scored"]))
    for uid, n in enumerate(lengths):
        targets = [t for start, end, scored in sorted(spans.get(uid, [])) for t in range(end - scored + 1, end + 1)]
        assert targets == list(range(1, n)), n
        assert all(end - start <= window for start, end, _ in spans.get(uid, []))


def test_ngram_scorer(spark):
    train = spark.createDataFrame([(1, [1, 2, 1, 2, 3]), (2, [2, 0])], "uid long, input_ids array<int>")
    docs = spark.createDataFrame([(1, [1, 2, 1, 2, 3]), (2, [2, 0]), (3, [4]), (4, []), (5, [1, 4, 3, 3])], "uid long, input_ids array<int>")
    model = scoring.fit_ngram(train, 5)
    rows = {(r["uid"], r["step"]): r for r in scoring.score_ngram(docs, model).collect()}
    assert set(rows) == {(u, s) for u in range(1, 6) for s in (0, 2000, 4000)}
    assert list(rows[1, 0]["token_ids"]) == [2, 1, 2, 3]
    assert rows[1, 0]["token_logprob"] == pytest.approx([-math.log(5)] * 4)
    # Half of the corpus is document 2: the pair 20. All pairs: 12 twice, 21, 23, 20 once each.
    assert rows[1, 2000]["token_logprob"] == pytest.approx([math.log(x) for x in (1 / 5, 1 / 6, 1 / 5, 1 / 6)])
    assert rows[1, 4000]["token_logprob"] == pytest.approx([math.log(x) for x in (3 / 7, 2 / 8, 3 / 7, 2 / 8)])
    assert rows[2, 4000]["token_logprob"] == [0.0]  # the padding id is not scored
    assert [list(rows[u, 4000]["token_ids"]) for u in (3, 4)] == [[], []]
    # Unseen pairs, and first tokens never seen, keep their places.
    assert list(rows[5, 4000]["token_ids"]) == [4, 3, 3]
    assert rows[5, 4000]["token_logprob"] == pytest.approx([math.log(x) for x in (1 / 7, 1 / 5, 1 / 5)])


def test_hot_pairs_are_split_without_loss(spark, monkeypatch):
    docs = spark.createDataFrame([(u, [1, 2] * 20 + [u % 7]) for u in range(40)], "uid long, input_ids array<int>")
    model = scoring.fit_ngram(docs, 9)
    whole = {(r["uid"], r["step"]): list(r["token_logprob"]) for r in scoring.score_ngram(docs, model).collect()}
    monkeypatch.setattr(scoring, "join_groups", lambda *a, **k: ordering.join_groups(*a, **k, bound=0))
    split = {(r["uid"], r["step"]): list(r["token_logprob"]) for r in scoring.score_ngram(docs, model).collect()}
    assert split.keys() == whole.keys() and all(split[k] == pytest.approx(whole[k]) for k in whole)


def test_user_model(spark):
    import pandas as pd

    def model(batches):
        for b in batches:
            ids = b["input_ids"].map(lambda x: x[1:])
            yield pd.DataFrame({"uid": b["uid"], "step": 7, "token_logprob": ids.map(lambda x: x * -0.5), "token_ids": ids})

    r = scoring.score(docs_of(spark, [3]), model).collect()[0]
    assert (r["uid"], r["step"], r["token_logprob"], r["token_ids"]) == (0, 7, [-1.0, -1.5], [2, 3])


@pytest.mark.parametrize(("budget", "window", "step"), [(30, 4, 2), (1000, 512, 256), (7, 3, 3)])
def test_evaluation_in_batches_and_spans(spark, budget, window, step):
    """Context-free scores equal those of whole documents; a score never comes from padding or another document."""
    rng = np.random.default_rng(4)
    ids = {u: rng.integers(1, 50, n).tolist() for u, n in enumerate([0, 1, 2, 3, 9, 9, 17, 30])}
    docs = spark.createDataFrame(list(ids.items()), "uid long, input_ids array<int>")
    rows = {r["uid"]: r for r in scoring.evaluate(docs, lambda inputs, targets: targets * -0.5, budget, window, step, at_step=7).collect()}
    assert {u: list(r["token_ids"]) for u, r in rows.items()} == {u: x[1:] for u, x in ids.items()}
    assert all(list(r["token_logprob"]) == [-0.5 * t for t in r["token_ids"]] and r["step"] == 7 for r in rows.values())


def backoff_by_definition(train, vocab_size, order, d=0.75):
    """P(w | h) by recursion over counts in Python."""
    counts: dict[tuple, dict[int, int]] = {}
    for ids in train:
        for i in range(len(ids)):
            for n in range(min(i, order - 1) + 1):
                seen = counts.setdefault(tuple(ids[i - n : i]), {})
                seen[ids[i]] = seen.get(ids[i], 0) + 1

    def p(w, h):
        lower = p(w, h[1:]) if h else 1 / vocab_size
        seen = counts.get(h)
        if not seen:
            return lower
        total = sum(seen.values())
        return max(seen.get(w, 0) - d, 0) / total + d * len(seen) / total * lower

    return p


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_scorer(spark, order):
    rng = random.Random(order)
    train = [[rng.choice([1, 1, 2, 3, 4, 5]) for _ in range(rng.randrange(0, 30))] for _ in range(12)]
    p = backoff_by_definition(train, 9, order)
    model = backoff.fit_backoff(spark.createDataFrame(list(enumerate(train)), "uid long, input_ids array<int>"), 9, order)
    docs = [[rng.randrange(1, 9) for _ in range(rng.randrange(0, 15))] for _ in range(20)] + [[3, 0, 1], [], [4]]
    rows = {r["uid"]: r for r in backoff.score_backoff(spark.createDataFrame(list(enumerate(docs)), "uid long, input_ids array<int>"), model, step=5).collect()}
    assert len(rows) == len(docs) and all(r["step"] == 5 for r in rows.values())
    for u, ids in enumerate(docs):
        assert list(rows[u]["token_ids"]) == ids[1:]
        expected = [0.0 if ids[i] == 0 else math.log(p(ids[i], tuple(ids[max(0, i - order + 1) : i]))) for i in range(1, len(ids))]
        assert rows[u]["token_logprob"] == pytest.approx(expected)


def test_backoff_probabilities_of_a_context_sum_to_one(spark):
    train = spark.createDataFrame([(1, [1, 2, 1, 2, 3]), (2, [2, 4, 1, 2])], "uid long, input_ids array<int>")
    model = backoff.fit_backoff(train, 6)
    contexts = [[1, 2], [2, 1], [5, 2], [5, 5], [3, 5]]
    docs = spark.createDataFrame([(100 * k + w, [*h, w]) for k, h in enumerate(contexts) for w in range(6)], "uid long, input_ids array<int>")
    sums: dict[int, float] = {}
    for r in backoff.score_backoff(docs, model, pad=-1).collect():
        sums[r["uid"] // 100] = sums.get(r["uid"] // 100, 0.0) + math.exp(r["token_logprob"][-1])
    assert sums == pytest.approx(dict.fromkeys(range(5), 1.0))
    empty = backoff.fit_backoff(train.limit(0), 6)
    assert [r["token_logprob"] for r in backoff.score_backoff(docs.limit(1), empty, pad=-1).collect()] == [pytest.approx([-math.log(6)] * 2)]


def test_span_scoring_loads_a_model_once_per_worker(spark, tmp_path):
    def load():
        (tmp_path / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return lambda inputs, targets: -0.5 * targets - 0.01 * inputs

    ids = {u: np.random.default_rng(u).integers(1, 50, n).tolist() for u, n in enumerate([0, 1, 2, 3, 9, 9, 17, 30] * 5)}
    docs = spark.createDataFrame(list(ids.items()), "uid long, input_ids array<int>").repartition(6)
    rows = {r["uid"]: r for r in scoring.score_spans(docs, load, window=4, step=2, batch_size=3, at_step=7).collect()}
    assert {u: list(r["token_ids"]) for u, r in rows.items()} == {u: x[1:] for u, x in ids.items()}
    for u, x in ids.items():
        assert rows[u]["step"] == 7 and rows[u]["token_logprob"] == pytest.approx([-0.5 * b - 0.01 * a for a, b in zip(x, x[1:])])
    workers = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert workers and len(workers) == len(set(workers))


def test_scored_documents_are_never_broadcast(spark):
    """Small files hold many tokens, so their size must not decide that all scores of the corpus go through the driver."""
    train = spark.createDataFrame([(1, [1, 2, 1, 2, 3]), (2, [2, 0])], "uid long, input_ids array<int>")
    docs = spark.createDataFrame([(1, [1, 2, 1, 2, 3]), (2, [2, 0]), (3, [4]), (4, []), (5, [1, 4, 3, 3]), (None, [1, 2])], "uid long, input_ids array<int>")
    model = scoring.fit_ngram(train, 5)
    by_join = scoring.score_ngram(docs, model, bound=0)
    in_place = scoring.score_ngram(docs, model)
    for scored in (by_join, in_place, backoff.score_backoff(docs, backoff.fit_backoff(train, 5))):
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin [uid" in x]
    rows = lambda df: sorted([(r["uid"] or 0, r["step"], list(r["token_logprob"]), list(r["token_ids"])) for r in df.collect()])
    assert rows(in_place) == rows(by_join)
    assert "Exchange" not in in_place._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_counted_by_batch(spark):
    rows = [(i, [1, 2, 1, 2, i % 3], i % 2 + 1) for i in range(20)] + [(20, [], 1), (21, None, 1), (22, [5], 2), (23, [-(1 << 31), (1 << 31) - 1, -1], 1)]
    for more in ([], [(24, [1, None, 2, 2], 1), (25, [3, 4], None)]):
        docs = spark.createDataFrame(rows + more, "uid long, input_ids array<int>, part int").repartition(3)
        got = scoring.pair_counts(docs, "part").groupBy("prev", "tok", "part").agg(F.sum("n").alias("n"))
        plain = scoring.transitions(docs, ["part"]).groupBy("prev", "tok", "part").agg(F.count("*").alias("n"))
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
        once = scoring.pair_counts(docs).groupBy("prev", "tok").agg(F.sum("n").alias("n"))
        assert sorted(map(str, once.collect())) == sorted(map(str, plain.groupBy("prev", "tok").agg(F.sum("n").alias("n")).collect()))
    assert "Generate" not in once._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [False, True])
def test_scores_by_blocks_equal_those_by_join(spark, monkeypatch, small):
    from rankcut.operators import blocks

    if small:  # a block per few documents, and parts of few n-grams
        monkeypatch.setattr(blocks, "BLOCK_TOKENS", 20)
        monkeypatch.setattr(blocks, "PART_ROWS", 3)
    rng = random.Random(9)
    rows = [(u if u else None, [rng.choice([0, 1, 2, 3, 3, 4, 70]) for _ in range(rng.randrange(0, 30))]) for u in range(60)]
    train = spark.createDataFrame(rows[:30], "uid long, input_ids array<int>")
    strange = [(100, [1, None, 2, 3]), (101, [-4, 1, 2]), (102, [2_000_000_000, 1, 2]), (103, None), (104, [0])]
    docs = spark.createDataFrame(rows + strange, "uid long, input_ids array<int>").repartition(3)
    result = lambda df: sorted(str((r["uid"], r["step"], [round(x, 9) for x in r["token_logprob"]], r["token_ids"])) for r in df.collect())
    for order in (2, 3):
        model = backoff.fit_backoff(train, 80, order)
        by_block = backoff.score_backoff(docs, model, step=3)
        assert "CoGroup" in by_block._jdf.queryExecution().executedPlan().toString()
        assert result(by_block) == result(backoff._score_by_join(docs, model, 3, 0))
    model = scoring.fit_ngram(train, 80)
    by_block = scoring.score_ngram(docs, model, bound=0)
    assert "CoGroup" in by_block._jdf.queryExecution().executedPlan().toString()
    assert result(by_block) == result(scoring._score_by_join(docs, model, 0))
    again = docs.union(docs.limit(1).withColumn("uid", F.lit(101).cast("long")))
    assert result(scoring.score_ngram(again, model, bound=0)) == result(scoring._score_by_join(again, model, 0))
    assert result(backoff.score_backoff(again, backoff.fit_backoff(train, 80))) == result(backoff._score_by_join(again, backoff.fit_backoff(train, 80), 0, 0))


def test_ngrams_with_missing_or_negative_tokens(spark):
    docs = spark.createDataFrame([(1, [1, None, 2, 1, None, 2]), (2, [None, 3]), (3, [1, 2, 1 << 18, 2])], "uid long, input_ids array<int>")
    model = backoff.fit_backoff(docs, 9)
    result = lambda df: sorted(str((r["uid"], [round(x, 9) for x in r["token_logprob"]], r["token_ids"])) for r in df.collect())
    assert result(backoff.score_backoff(docs, model)) == result(backoff._score_by_join(docs, model, 0, 0))
    for token in (-5, 1 << 30):  # negative, or too large for the numbers of three tokens
        other = docs.union(spark.createDataFrame([(4, [1, token, 2])], "uid long, input_ids array<int>"))
        scored = backoff.score_backoff(other, backoff.fit_backoff(other, 9))
        assert "CoGroup" not in scored._jdf.queryExecution().executedPlan().toString()
        assert {r["uid"]: len(r["token_logprob"]) for r in scored.collect()} == {1: 5, 2: 1, 3: 3, 4: 2}


def test_ngrams_of_many_different_tokens_are_counted(spark):
    rng = random.Random(3)
    rows = [(u, [rng.randrange(1 << 30) if rng.random() < 0.7 else None if rng.random() < 0.1 else 5 for _ in range(900)]) for u in range(6)]
    docs = spark.createDataFrame(rows, "uid long, input_ids array<int>").coalesce(1)
    for order in (2, 5, 7):  # more than a plain number holds
        names = [f"w{k}" for k in range(order)]
        got = backoff._gram_counts(docs, order).groupBy(*names).agg(F.sum("c").alias("c"))
        expected = backoff._grams(docs, order).groupBy(*names).agg(F.count("*").alias("c"))
        assert got.exceptAll(expected).count() == 0 and got.count() == expected.count()
