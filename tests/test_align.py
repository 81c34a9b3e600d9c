import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankcut.operators import align, ordering, outcomes, quality
from rankcut.plans.workflow import bucketed_regression_data, regression_data
from rankcut.session import bucketed


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "uid long, input_ids array<int>")


def evals_of(spark, rows):
    return spark.createDataFrame(rows, "uid long, step long, token_logprob array<double>, token_ids array<int>")


def merges_of(spark, rows):
    return spark.createDataFrame(rows, "tok_a long, tok_b long, tok long")


def tags(rows):
    return [(r["tok"], r["pos"]) for r in sorted(rows, key=lambda r: r["og_pos"])]


@pytest.mark.parametrize(
    "stream, merges, expected",
    [
        ([1, 1, 1], [(1, 1, 9)], [(9, 0), (9, 0), (9, 1)]),
        ([1, 2, 3], [(1, 2, 8), (2, 3, 9)], [(8, 0), (9, 0), (9, 1)]),
        ([1, 2, 1, 2], [(1, 2, 8)], [(8, 0), (8, 0), (8, 2), (8, 2)]),
        ([3], [(1, 2, 8)], [(3, 0)]),
    ],
)
@pytest.mark.parametrize("block", [1, 2, 1 << 16])
def test_overlapping_pairs(spark, stream, merges, expected, block):
    docs, table = docs_of(spark, [(7, stream)]), merges_of(spark, merges)
    assert tags(align.tag_pairs(align.token_rows(docs), table, block).collect()) == expected
    assert tags(align.tag_rows(align.token_rows_with_neighbours(docs), table).collect()) == expected


def greedy_by_scan(stream, pairs):
    """One walk from the left, as the rule says."""
    out, i = [], 0
    while i < len(stream):
        made = pairs.get(tuple(stream[i : i + 2]))
        out += [(made, i), (made, i)] if made else [(stream[i], i)]
        i += 2 if made else 1
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 8, 1 << 16])
def test_greedy_pairs(spark, block):
    """Chains of overlapping pairs, also across one and several borders of blocks."""
    rng = random.Random(block)
    streams = {1: [1, 1, 1], 2: [1, 2, 3], 3: [1] * 40, 4: [3], 5: [1] * 17 + [2] + [1] * 24, 6: []}
    streams |= {u: [rng.choice((1, 1, 1, 2, 3)) for _ in range(rng.randrange(1, 60))] for u in range(10, 40)}
    pairs = {(1, 1): 9, (1, 2): 8, (2, 3): 7}
    docs, table = docs_of(spark, list(streams.items())), merges_of(spark, [(a, b, c) for (a, b), c in pairs.items()])
    by_array = align.tag_rows_greedy(align.token_rows_with_neighbours(docs), table, block).collect()
    by_rows = align.tag_pairs(align.token_rows(docs), table, block, overlap="greedy").collect()
    assert sorted(map(tuple, by_array)) == sorted(map(tuple, by_rows))
    for uid, stream in streams.items():
        assert tags([r for r in by_array if r["uid"] == uid]) == greedy_by_scan(stream, pairs)
    with pytest.raises(ValueError):
        align.tag_pairs(align.token_rows(docs), table, overlap="none")


def test_tagging_equals_the_self_join_form(spark):
    rng = random.Random(3)
    docs = docs_of(spark, [(u, [rng.randrange(4) for _ in range(rng.randrange(0, 40))]) for u in range(60)])
    table = merges_of(spark, [(0, 1, 10), (1, 1, 11), (2, 0, 12)])
    w = W.partitionBy("uid").orderBy("pos")
    first = align.token_rows(docs).withColumn("next", F.lead("tok").over(w)).join(
        table.select(F.col("tok_a").alias("tok"), F.col("tok_b").alias("next"), F.col("tok").alias("a")), ["tok", "next"], "left"
    )
    second = first.where("a is not null").select("uid", F.col("next").alias("tok"), (F.col("pos") + 1).alias("pos"), F.col("a").alias("b"), F.col("pos").alias("pos_b"))
    joined = first.join(second, ["uid", "tok", "pos"], "left").select(
        "uid", F.col("pos").alias("og_pos"), F.col("tok").alias("og_tok"), F.coalesce("a", "b", "tok").alias("tok"), F.least("pos_b", "pos").alias("pos")
    )
    ours = align.tag_pairs(align.token_rows(docs), table, block=5)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, ours.collect()))


def test_trim(spark):
    docs = docs_of(spark, [(1, [10, 11, 12, 13, 14]), (2, [20, 21, 22]), (3, []), (4, [40])])
    evals = evals_of(
        spark,
        [
            (1, 0, [0.1, 0.2, 0.3, 0.4], [11, 12, 13, 14]),  # unpadded: the first token is context only
            (2, 0, [0.0, 0.1, 0.2, 0.3], [0, 20, 21, 22]),  # padded
            (3, 0, [0.0, 0.0], [0, 0]),
            (9, 0, [0.5, 0.6], [1, 2]),  # unknown document: stays as it is
        ],
    )
    got = {r["uid"]: (r["token_logprob"], r["token_ids"]) for r in align.trim_evals(evals, docs).collect()}
    assert got[1] == ([0.1, 0.2, 0.3, 0.4], [11, 12, 13, 14])
    assert got[2] == ([0.1, 0.2, 0.3], [20, 21, 22])
    assert got[3] == ([], [])
    assert got[9] == ([0.5, 0.6], [1, 2])
    trimmed = {r["uid"]: r["input_ids"] for r in align.trim_docs(docs, evals).collect()}
    assert trimmed == {1: [11, 12, 13, 14], 2: [20, 21, 22], 3: [], 4: [40]}


def test_a_pair_may_not_occur_twice(spark):
    table = merges_of(spark, [(1, 2, 500), (1, 2, 501)])
    with pytest.raises(PySparkException, match="pair occurs twice"):
        align.imputed_merges(table, 500).collect()


def test_component_audit(spark):
    table = merges_of(spark, [(1, 2, 98), (3, 4, 99), (98, 5, 100), (6, 98, 101), (99, 98, 102)])
    audit = sorted((r["tok"], r["tok_new"]) for r in align.component_audit(table, 100).collect())
    assert audit == [(98, 100), (98, 101), (98, 102), (99, 102)]
    assert {r["tok"] for r in align.drop_components(table, 100).collect()} == {100, 101, 102}
    # Items above the cutoff are the same with or without the exclusion.
    assert sorted(map(tuple, align.imputed_merges(table, 100).collect())) == sorted(map(tuple, align.imputed_merges(table, 100, True).collect()))


def test_regression_data_by_hand(spark):
    docs = docs_of(spark, [(1, [1, 2, 3]), (2, [1, 2, 1, 2])])
    log = spark.createDataFrame([([1, 2], "ab", 4, "a", "b", 5)], "pair array<int>, new_token string, new_token_id int, part_a string, part_b string, count long")
    evals = evals_of(
        spark,
        [
            (1, 0, [-2.0, -3.0], [2, 3]),  # first token unscored, hence the pair is lost
            (2, 0, [0.0, -1.0, -2.0, -4.0, -8.0], [0, 1, 2, 1, 2]),
        ],
    )
    rows = {r["tok"]: r for r in regression_data(docs, evals, log, cutoff=4, half_width=2).collect()}
    assert rows[4]["num"] == 2 and rows[4]["mean"] == -7.5 and rows[4]["treat"] is False
    # Quartiles of [-12, -3] by the nearest rule: index floor(q + 0.5).
    assert rows[4]["median"] == -3.0 and rows[4]["iqr"] == 9.0
    assert rows[2]["num"] == 1 and rows[2]["mean"] == -2.0 and rows[2]["std"] is None and rows[2]["treat"] is True
    assert rows[3]["mean"] == -3.0
    assert set(rows) == {2, 3, 4}


def test_imputation_drops_positions_where_the_tokens_disagree(spark):
    docs = docs_of(spark, [(1, [5, 6])])
    evals = evals_of(spark, [(1, 0, [-1.0, -2.0], [5, 7])])
    tagged = align.tag_rows(align.token_rows_with_neighbours(docs), merges_of(spark, [(90, 91, 99)]))
    scores = align.impute_scores(evals, tagged)
    assert [r["og_tok"] for r in scores.collect()] == [5]
    check = quality.alignment_completeness(scores, tagged).collect()[0]
    assert (check["joined"], check["tagged"], check["complete"]) == (1, 2, False)
    assert [(r["pos"], r["token_ids"]) for r in quality.disagreements(evals, docs).collect()] == [(1, 7)]


def test_equal_lengths_fails(spark):
    with pytest.raises(PySparkException, match="differ in length"):
        quality.equal_lengths(evals_of(spark, [(1, 0, [0.0], [1, 2])])).collect()


def test_neighbours_across_blocks_and_gaps(spark):
    rows = [("a", p, p * 10) for p in range(23)] + [("b", 0, 5), ("b", 2, 6)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    got = {(r["k"], r["pos"]): (r["prev"], r["next"]) for r in ordering.neighbours(df, ["k"], "pos", "v", block=4).collect()}
    assert len(got) == len(rows)
    for p in range(23):
        assert got["a", p] == ((p - 1) * 10 if p else None, (p + 1) * 10 if p < 22 else None)
    assert got["b", 0] == (None, None) and got["b", 2] == (None, None)


def test_row_index_is_contiguous(spark):
    rng = random.Random(5)
    values = [rng.randrange(50) for _ in range(1000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(7)
    got = ordering.row_index(df, [F.desc("v"), F.asc("i")], "rank", start=3).collect()
    expected = {i: k + 3 for k, (v, i) in enumerate(sorted(((-v, i) for i, v in enumerate(values))))}
    assert {r["i"]: r["rank"] for r in got} == expected


def test_group_aggregates_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", 5)], "k string, v long")
    got = ordering.with_group_aggregates(df, ["k"], [F.avg("v").alias("m")]).collect()
    assert sorted((str(r["k"]), r["v"], r["m"]) for r in got) == [("None", 1, 2.0), ("None", 3, 2.0), ("a", 5, 5.0)]


@pytest.mark.parametrize("bound", [0, 100])
def test_join_groups_equals_a_plain_join_with_a_hot_and_a_null_group(spark, bound):
    rows = [(None if i % 10 == 0 else ("hot" if i % 3 else f"k{i % 7}"), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    groups = df.groupBy("k").agg(F.count("*").alias("n"))
    counts = {r["k"]: r["n"] for r in groups.collect()}
    got = ordering.join_groups(df, groups, ["k"], salts=4, bound=bound)
    assert got.columns == ["k", "v", "n"]
    assert sorted((str(r["k"]), r["v"], r["n"]) for r in got.collect()) == sorted((str(k), v, counts[k]) for k, v in rows)


def test_number_rows(spark):
    df = spark.createDataFrame([("b", 2), ("a", 9), ("a", 3)], "s string, k long").withColumn("wide", F.lit("x"))
    got = {(r["s"], r["k"]): r["uid"] for r in ordering.number_rows(df, ["s", "k"], "uid").collect()}
    assert got == {("a", 3): 0, ("a", 9): 1, ("b", 2): 2}
    with_null = df.union(spark.createDataFrame([(None, 5, "x")], "s string, k long, wide string"))
    assert sorted(r["uid"] for r in ordering.number_rows(with_null, ["s", "k"], "uid").collect()) == [0, 1, 2, 3]
    with pytest.raises(Exception, match="equal s, k"):
        ordering.number_rows(df.union(df.limit(1)), ["s", "k"], "uid").collect()


def test_top_rows_beyond_one_task(spark):
    df = spark.range(500).withColumn("v", (F.col("id") * 7919) % 503)
    few = [r["id"] for r in ordering.top_k(df, [F.desc("v")], 60).collect()]
    numbered = ordering.top_k(df, [F.desc("v")], 60, bound=10)
    assert sorted(r["id"] for r in numbered.collect()) == sorted(few)
    assert "TakeOrdered" not in numbered._jdf.queryExecution().toString()


def test_cross_entropy_is_macro_averaged(spark):
    evals = evals_of(spark, [(1, 0, [0.0, -2.0, -4.0], [0, 1, 2]), (2, 0, [-1.0], [3])])
    assert outcomes.cross_entropy(evals, ["step"]).collect()[0]["token_logprob"] == 1.5
    docs = docs_of(spark, [(1, [1, 2]), (2, [3])])
    assert outcomes.cross_entropy(evals, ["step"], docs).collect()[0]["token_logprob"] == 2.0


def some_run(spark, n=40):
    rng = random.Random(2)
    ids = {u: [rng.randrange(1, 6) for _ in range(rng.randrange(2, 30))] for u in range(n)}
    docs = docs_of(spark, list(ids.items()))
    evals = evals_of(spark, [(u, s, [-rng.random() for _ in x], x) for u, x in ids.items() for s in (0, 10)])
    log = spark.createDataFrame([([1, 2], "ab", 6, "a", "b", 5), ([3, 3], "cc", 7, "c", "c", 4)], "pair array<int>, new_token string, new_token_id int, part_a string, part_b string, count long")
    return docs, evals, log


def test_bucketed_runs_are_not_shuffled_by_document(spark):
    docs, evals, log = some_run(spark)
    runs = {"r1": evals, "r2": evals.withColumn("token_logprob", F.transform("token_logprob", lambda x: x * 2))}
    got = bucketed_regression_data(docs, runs, log, 6, 3, buckets=3)
    for run, rows in runs.items():
        expected = sorted(map(tuple, regression_data(docs, rows, log, 6, 3).collect()))
        found = sorted(tuple(r)[:8] for r in got.where(F.col("run") == run).collect())
        assert len(found) == len(expected) > 5 and all(a == pytest.approx(b) for a, b in zip(found, expected))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        placed, scored = bucketed(docs, ["uid"], 3, "docs"), bucketed(evals, ["uid"], 3, "evals")
        merges = align.window_sized(align.imputed_merges(align.merges_window(log, 6, 3), 6), 3)
        tagged = align.tag_rows(align.token_rows_with_neighbours(align.trim_docs(placed, scored)), merges)
        summed = outcomes.occurrence_scores(align.impute_scores(align.score_offset(scored, placed), tagged))
        plan = summed._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "uid" in line]
    assert "SortMergeJoin" in plan and not exchanged


def test_checks_are_taken_while_the_data_is_written(spark):
    docs, evals, log = some_run(spark)
    wrong = evals.withColumn("token_ids", F.when(F.col("uid").between(3, 9) & (F.col("step") == 10), F.slice("token_ids", 1, 1)).otherwise(F.col("token_ids")))
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs(group, **options):
        context.setJobGroup(group, group)
        table = regression_data(docs, evals, log, 6, 3, **options)
        rows = sorted(map(tuple, table.collect()))
        context.setLocalProperty("spark.jobGroup.id", None)
        return rows, len(tracker.getJobIdsForGroup(group))

    checks = []
    plain, checked = jobs("plain"), jobs("checked", checks=checks, steps=[0, 10])
    assert checked == plain  # the same rows by the same number of jobs
    tagged = align.tag_rows(align.token_rows_with_neighbours(docs), align.imputed_merges(align.merges_window(log, 6, 3), 6)).where("tok >= 3 and tok < 9").count()
    assert checks[0].completeness() == [(0, tagged, tagged, True), (10, tagged, tagged, True)] and checks[0].unequal_lengths() == 0
    checks = []
    regression_data(docs, wrong, log, 6, 3, checks=checks, steps=[0, 10], complete=False).collect()
    assert checks[0].unequal_lengths() == 7 and [c[3] for c in checks[0].completeness()] == [True, False]


def test_large_group_tables_are_not_copied(spark, monkeypatch):
    """Copies of a table with more rows than its groups are hot would outgrow the rows that meet it."""
    monkeypatch.setattr(ordering, "COPIED_ROWS", 60)
    df = spark.createDataFrame([(i % 40, i) for i in range(200)], "k int, v int")
    groups = spark.createDataFrame([(i, i * 2) for i in range(40)], "k int, w int")
    got = ordering.join_groups(df, groups, ["k"], salts=4, bound=0)
    assert "_copy" not in got._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, got.collect())) == sorted((i % 40, i, i % 40 * 2) for i in range(200))


def test_copies_of_a_group_table_are_never_broadcast(spark):
    df = spark.createDataFrame([(i % 40, i) for i in range(200)], "k int, v int")
    groups = spark.createDataFrame([(i, i * 2) for i in range(40)], "k int, w int")
    got = ordering.join_groups(df, groups, ["k"], "left", bound=0)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 200


def odd_run(spark):
    """Equal numbers in both tables, missing, empty and unequal arrays, missing numbers, tokens and scores, arrays of other lengths than the document."""
    rng = random.Random(4)
    docs, evals = [], []
    for u in range(60):
        ids = [rng.choice([1, 2, 3, 3, 4, 5, None, 300]) for _ in range(rng.randrange(0, 25))]
        for _ in range(2 if u % 13 == 0 else 1):
            docs.append((None if u == 7 else u, None if u % 17 == 5 else ids))
        for step in (0, 10, None) if u % 9 else (10,):
            for _ in range(2 if u % 11 == 0 else 1):
                seen = ids[1:] if u % 3 == 0 else [0] * (u % 3) + ids
                if u % 4 == 1:
                    seen = [t if rng.random() < 0.9 else 2 for t in seen]
                scores = [None if rng.random() < 0.1 else -rng.random() for _ in seen]
                evals.append((None if u == 7 else u, step, None if u % 19 == 3 else scores[: len(scores) - (u % 5 == 2)], None if u == 8 else seen))
    log = [([1, 2], 6), ([3, 3], 7), ([2, 3], 8), ([3, 1], 9), ([300, 1], 6)]
    log = spark.createDataFrame([(p, "x", i, "x", "x", 1) for p, i in log], "pair array<int>, new_token string, new_token_id int, part_a string, part_b string, count long")
    return spark.createDataFrame(docs, "uid long, input_ids array<int>"), spark.createDataFrame(evals, "uid long, step long, token_logprob array<double>, token_ids array<int>"), log


@pytest.mark.parametrize("direct", [True, False])
def test_occurrences_of_whole_arrays_equal_those_by_row(spark, monkeypatch, direct):
    from rankcut.operators import occurrences as module

    if not direct:
        monkeypatch.setattr(module, "_DIRECT_IDS", 0)
        monkeypatch.setattr(module, "_DIRECT_PAIRS", 0)
    docs, evals, log = odd_run(spark)
    merges = align.imputed_merges(align.merges_window(log, 6, 4), 6)
    tagged = align.tag_rows(align.token_rows_with_neighbours(align.trim_docs(docs, evals)), merges).where("tok >= 2 and tok < 10")
    scores = align.impute_scores(align.score_offset(evals, docs), tagged)
    items = module.items_around(merges, 6, 4)
    found = module.staged_occurrences(*module.packed(docs, evals, items), items)
    order = lambda rows: sorted((str(r["step"]), r["tok"], -9.0 if r["logprob"] is None else round(r["logprob"], 9)) for r in rows)
    expected = order(outcomes.occurrence_scores(scores).collect())
    assert order(found.collect()) == expected and len(expected) > 500
    with pytest.raises(Exception, match="a tagged token has no score"):
        module.staged_occurrences(*module.packed(docs, evals, items), items, strict=True)


def test_regression_data_of_whole_arrays_equals_that_by_row(spark, monkeypatch):
    docs, evals, log = odd_run(spark)
    runs = [df.withColumn("run", F.explode(F.array(F.lit("r1"), F.lit("r2")))) for df in (docs, evals)]
    calls = [((docs, evals), {"base_step": 10}), (runs, {"run": "run"})]

    def rows(tables, **options):
        checks = []
        got = regression_data(*tables, log, 6, 4, complete=False, checks=checks, steps=[0, 10], **options).collect()
        as_text = sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in got)
        return as_text, checks[0].completeness()

    whole = [rows(t, **o) for t, o in calls]
    monkeypatch.setattr(align, "BROADCAST_ROWS", 0)
    assert [rows(t, **o) for t, o in calls] == whole and len(whole[0][0]) > 10


def test_long_gaps_between_tokens_are_packed(spark):
    from rankcut.operators import occurrences as module

    docs = docs_of(spark, [(1, [9] * 254 + [1, 2] + [9] * 255 + [3] + [9] * 1000 + [3, 3]), (2, [9]), (3, [1, 2])])
    log = spark.createDataFrame([([1, 2], "ab", 6, "a", "b", 5)], "pair array<int>, new_token string, new_token_id int, part_a string, part_b string, count long")
    items = module.items_around(align.imputed_merges(align.merges_window(log, 6, 4), 6), 6, 4)
    rows = docs.withColumns({"step": F.lit(0).cast("long"), "token_ids": F.col("input_ids"), "token_logprob": F.transform("input_ids", lambda _, i: i.cast("double"))})
    found = module.staged_occurrences(pack := module.pack_tokens(docs, items), module.pack_scores(rows, items), items, strict=True)
    assert sorted((r["tok"], r["logprob"]) for r in found.where("tok <> 9").collect()) == [(3, 511.0), (3, 1512.0), (3, 1513.0), (6, 1.0), (6, 509.0)]
    assert {r["uid"]: r["d"]["size"] for r in pack.collect()} == {1: 1514, 2: 1, 3: 2}


def test_packed_buckets_meet_where_they_lie(spark):
    from rankcut.operators import occurrences as module

    docs, evals, log = some_run(spark)
    items = module.items_around(align.imputed_merges(align.merges_window(log, 6, 3), 6), 6, 3)
    placed, scored = (bucketed(df, ["uid"], 3) for df in module.packed(docs, evals, items))
    plan = module.occurrences(placed, scored, items, 0, True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
