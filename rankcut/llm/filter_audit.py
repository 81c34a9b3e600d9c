"""What filters do to each other: for every order of several filters, what each step keeps, removes and costs.

Each filter is stored as a table of the ids that fail it. What a filter removes depends only on which filters ran before it,
not on their order, so one relation holds, for every filter and every set of predecessors, the ids removed: the ids that fail
the filter (left-semi join of the documents with its id table) less those that fail a predecessor (left-anti joins with the
predecessors' id tables, one join per filter for all sets at once). Label losses are left-semi joins of that relation with
the ids that carry a label. The report of all orders then reads its counts, a few rows per part.

Texts are read once; after that only ids move, and every join but the first exchange of a table is on the id.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankcut.operators.ordering import join_groups
from rankcut.session import stage

MAX_FILTERS = 6  # n filters have n! orders

SPACE = "[\\x20\\x09-\\x0D]+"


def text_conditions(text: str = "text", words: str = "words") -> dict[str, Column]:
    """Failure conditions of the four filters on one text: too short, repetitive, loud, symbols. ``words``: its words."""
    length = F.length(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * capitals > 10 * length,
        "D": F.col(text).rlike("[#$%&*|]"),
    }


def with_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """``text`` without null, and its ``words``."""
    rows = documents.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    return rows.withColumn("words", F.array_remove(F.split(text, SPACE), ""))


def judge(documents: DataFrame, conditions: dict[str, Column], part: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow staged row per document: ``id``, ``part``, ``fails`` (names of the failed conditions), ``digest`` of the text."""
    fails = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))
    digest = F.unhex(F.sha2(F.col(text).cast("binary"), 256))
    return stage(documents.select(F.col(doc_id).alias("id"), part.alias("part"), fails.alias("fails"), digest.alias("digest")), "judged")


def later_copies(judged: DataFrame) -> DataFrame:
    """Ids of the rows whose text a smaller id has, too. Copies are counted per text first; a text with many spreads over tasks."""
    first = judged.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    repeated = first.where(F.col("first") < F.col("last")).select("digest", "first")
    return join_groups(judged.select("id", "digest"), repeated, ["digest"]).where(F.col("id") > F.col("first")).select("id")


def store_failing(judged: DataFrame, extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """The failing-id tables, one folder per filter: ``filter``, ``id``. ``extra``: id tables of filters that are no condition on a row."""
    tables = [judged.select(F.explode("fails").alias("filter"), "id")]
    tables += [ids.select(F.lit(name).alias("filter"), "id") for name, ids in (extra or {}).items()]
    failing = reduce(DataFrame.unionByName, tables)
    return stage(failing.where(F.col("id").isNotNull()).select("id", "filter"), "failing", partition_by=["filter"])


def ids_failing(failing: DataFrame, name: str) -> DataFrame:
    return failing.where(F.col("filter") == name).select(F.col("id").alias("failed"))


def survivors(documents: DataFrame, failing: DataFrame, order: str | list[str], doc_id: str = "doc_id") -> DataFrame:
    """The documents that pass all filters of ``order``, with all their columns."""
    for name in order:
        failed = ids_failing(failing, name)
        documents = documents.join(failed, documents[doc_id] == failed["failed"], "left_anti")
    return documents


def prefix_removals(members: DataFrame, failing: DataFrame, filters: list[str]) -> DataFrame:
    """``id, part, filter, gone``: the ids a filter removes after the filters whose bits are set in ``gone``, in any order."""
    removed = []
    for name in filters:
        failed = ids_failing(failing, name)
        removed.append(members.join(failed, members["id"] == failed["failed"], "left_semi").select("id", "part", F.lit(name).alias("filter")))
    rows = reduce(DataFrame.unionByName, removed).withColumn("gone", F.lit(0))
    for k, name in enumerate(filters):
        without, after = F.col("gone"), F.col("gone") + (1 << k)
        rows = rows.withColumn("gone", F.explode(F.when(F.col("filter") == name, F.array(without)).otherwise(F.array(without, after))))
        failed = ids_failing(failing, name)
        hit = (rows["id"] == failed["failed"]) & (rows["gone"].bitwiseAND(1 << k) != 0)
        rows = rows.join(failed, hit, "left_anti")
    return stage(rows, "removals")


def audit_orders(judged: DataFrame, failing: DataFrame, filters: str | list[str], labels: dict[str, DataFrame]) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``part``, ``filter_order`` (names joined), ``step`` (from 1), then longs counted within the part: ``kept`` after the step,
    ``removed`` by it, ``redundant`` (fail its filter, but were removed earlier), ``unique_fails`` (fail its filter only),
    ``<label>_lost`` (removed by it and among the ids of that label), ``shapley`` (removed by its filter, summed over all
    orders). ``labels``: name to a table with ``id``.

    An id stands for all rows that carry it: repeated rows all fail what one of them fails, and count as rows. Rows without
    id fail nothing, as no id table can hold them. Ties between equal texts are settled by the id. An empty table has no
    parts, hence no rows. At most six filters.
    """
    filters = list(filters)
    if not 1 <= len(filters) <= MAX_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"give one to {MAX_FILTERS} different filters")
    spark = judged.sparkSession
    bit = {name: 1 << k for k, name in enumerate(filters)}
    members = judged.select("id", "part")
    removals = prefix_removals(members, failing, filters)
    keys = ["part", "filter", "gone"]
    lost = [f"{name}_lost" for name in labels]
    counted = [removals.groupBy(*keys).agg(F.count("*").alias("removed"))]
    for name, ids in labels.items():
        # The ids of a label stand once each in a left-semi join, however often they are labelled.
        counted.append(removals.join(ids.select("id"), "id", "left_semi").groupBy(*keys).agg(F.count("*").alias(f"{name}_lost")))
    sums = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counted)
    sums = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("removed", *lost)])

    steps = []
    for order in permutations(filters):
        gone = 0
        for step, name in enumerate(order, 1):
            steps.append((len(steps), "".join(order), step, name, gone))
            gone |= bit[name]
    table = spark.createDataFrame(steps, "number int, filter_order string, step int, filter string, gone int")
    parts = members.groupBy("part").agg(F.count("*").alias("total"))
    grid = parts.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).join(F.broadcast(table), "number")
    # Windows over one part: as many rows as orders, or filters.
    rows = grid.join(sums, keys, "left").fillna(0, ["removed", *lost])
    so_far = W.partitionBy("part", "filter_order").orderBy("step")
    same_filter = W.partitionBy("part", "filter")
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("removed").over(so_far)).alias("kept"),
        "removed",
        (F.max(F.when(F.col("step") == 1, F.col("removed"))).over(same_filter) - F.col("removed")).alias("redundant"),
        F.max(F.when(F.col("step") == len(filters), F.col("removed"))).over(same_filter).alias("unique_fails"),
        *lost,
        F.sum("removed").over(same_filter).alias("shapley"),
    )


def audit_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters on ``documents`` (``doc_id``, ``text``, ``lang``) by language, with losses by ``labels``.

    A: under 100 words; B: under 80 % of the words are distinct; C: over 10 % capitals A-Z; D: holds one of #$%&*|;
    E: a smaller id has the same text. Null texts count as empty, null languages as ''. Other columns are ignored.
    """
    rows = with_words(documents.select("doc_id", "text", "lang"))
    judged = judge(rows, text_conditions(), F.coalesce(F.col("lang"), F.lit("")))
    failing = store_failing(judged, {"E": later_copies(judged)})
    marked = {"good": labels.where(F.col("quality") == 1), "toxic": labels.where(F.col("toxic") == 1)}
    return audit_orders(judged, failing, "ABCDE", {name: ids.select(F.col("doc_id").alias("id")) for name, ids in marked.items()})


def oracle_sql() -> str:
    """The same report in SQL, from one row of failure flags per document."""
    words = "regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
flags AS MATERIALIZED (
  SELECT doc_id, part,
    CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS fails,
    CAST(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS INT) AS good,
    CAST(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS INT) AS toxic
  FROM (SELECT *, {words} AS w FROM texts)),
atoms AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders AS MATERIALIZED (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) AS upto
  FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM orders)),
rep AS MATERIALIZED (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & CAST(upto AS INT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & CAST(upto AS INT) = bit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & bit = bit AND fails & CAST(upto AS INT) <> bit THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & CAST(upto AS INT) = bit THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & CAST(upto AS INT) = bit THEN toxic ELSE 0 END) AS toxic_lost
  FROM atoms, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM rep"""
