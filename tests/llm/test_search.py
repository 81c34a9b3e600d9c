import numpy as np

from rankcut.llm import search
from rankcut.llm.search import Sizes, build_index, search_embeddings, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, q long, shard long"


def brute(rows, every=50, k=5):
    """All scores of every query, by definition."""
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in fine if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def result(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3) for i, v in rows], SCHEMA)


# Several blocks, shards, stretches and chunks from a few hundred rows.
SMALL = Sizes(block=4, shard=16, stretch=3, chunk=8, pivots=5)


def vectors(n, seed, clusters=12, width=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, width))
    return [(int(i), (centres[rnd.integers(clusters)] + 0.2 * rnd.normal(size=width)).tolist()) for i in rnd.permutation(n * 3)[:n]]


def test_equal_to_brute_force(spark):
    rows = vectors(400, 1)
    rows += [(10_000 + i, rows[0][1]) for i in range(90)]  # a common vector: ties all over its blocks
    assert result(search_embeddings(frame(spark, rows), every=10, sizes=SMALL)) == brute(rows, 10)


def test_equal_to_brute_force_in_whole_blocks(spark):
    rows = vectors(700, 2, width=16)
    assert result(search_embeddings(frame(spark, rows))) == brute(rows)


def test_blocks_are_skipped(spark):
    """In clusters far apart, bounds leave few shards to visit, so what is searched stays below what there is."""
    rnd = np.random.default_rng(3)
    rows = [(i, (np.eye(8)[i % 8] * 4 + 0.01 * rnd.normal(size=8)).tolist()) for i in range(800)]
    df = frame(spark, rows)
    items = df.select("vec_id", search.quantised("embedding", 256).alias("codes")).toDF("id", "codes")
    numbered = search._numbered(items, np.eye(8) * 1024)
    index = build_index(numbered, SMALL)
    asked = numbered.where("id % 50 = 0").withColumnRenamed("n", "old").withColumn("q", (search.F.col("id") / 50).cast("long"))
    seeds = search._best_shards(asked, index, SMALL)
    nothing = search.F.lit(None).cast("long")
    known = asked.join(seeds.withColumnRenamed("shard", "seen"), "q").withColumns({"floor_score": nothing, "floor_id": nothing})
    floor = known.withColumns({"floor_score": search.F.lit(1_000_000).cast("long"), "floor_id": search.F.lit(0).cast("long")})
    everything, pruned = search._worth_visiting(known, index, SMALL).count(), search._worth_visiting(floor, index, SMALL).count()
    assert everything == 16 * (index.count() - 1) and pruned < everything / 3
    assert result(top_k(items, items.where("id % 50 = 0"), 5, SMALL)) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 4) + [(None, [1.0] * 6), (50, None), (100, [nan] * 6), (150, [1.0, inf, 0, 0, 0, 0]), (200, [1.0, None, 0, 0, 0, 0])]
    rows += [(250, []), (300, [2.0]), (350, [1.0] * 9), (351, [1.0] * 9), (350, [1.0] * 9), (352, [-3.0] * 9)]
    rows = [r for r in rows if r[0] not in (250, 300, 350)] + [(250, []), (300, [2.0]), (350, [1.0] * 9), (350, [1.0] * 9)]
    assert result(search_embeddings(frame(spark, rows), sizes=SMALL)) == brute(rows)


def test_large_components_stay_whole_numbers(spark):
    rows = [(50 * i, [(-1) ** i * (1 << 20) + i / 256, float(i), 3.5]) for i in range(12)]
    assert result(search_embeddings(frame(spark, rows))) == brute(rows)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (3, [1.0, -2.0]), (50, [0.0, 0.0])]
    assert result(search_embeddings(frame(spark, rows))) == brute(rows)
    assert result(search_embeddings(frame(spark, rows[:1]))) == []
    assert result(search_embeddings(frame(spark, rows[1:2]))) == []
    assert result(search_embeddings(frame(spark, []))) == []
