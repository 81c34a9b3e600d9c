"""Exact top-k inner products by block-at-a-time pruning.

Vectors are ordered so that similar ones stand together, numbered, and cut into ranges: blocks of 64, shards of 32 blocks.
A shard keeps a forward index (its ids and components) and, per block, the maxima and minima of every component. With a
query's components as term weights, the sum over terms of weight times block maximum (minimum where the weight is negative)
bounds every score in the block. A query visits blocks by descending bound and stops where no bound reaches its k-th score.

1. Bounds of all blocks, query chunk by stretch of shards, give each query the shard that holds its best block.
2. That shard is searched, which gives each query a first k-th score as its floor.
3. The bounds are formed again; only shards with a block that can beat the floor are searched, from that floor on.
4. The best k of what was found are ranked.

Queries and vectors only ever meet as a chunk and a range, both bounded in size; a popular shard is searched once per chunk.
Where vectors do not cluster no bound can prune, and the search is a product of matrices in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankcut.operators.ordering import row_index
from rankcut.session import stage



class Sizes(NamedTuple):
    """Upper bounds of what one task handles at once."""

    block: int = 64  # vectors
    shard: int = 32 * 64  # vectors, a multiple of the block
    stretch: int = 256  # shards whose bounds are formed at once
    chunk: int = 2048  # queries
    pivots: int = 256  # vectors of a fixed sample that the order refers to; it changes the speed, never the result


NONE = np.iinfo(np.int64).min  # stands for a missing score or floor
_EXACT = float(1 << 53)  # sums of whole numbers below this are exact in floating point


def quantised(vector: str, scale: int) -> Column:
    """Whole components: ``floor(scale * x)``, in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _matrix(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows as one matrix, short ones filled up with zeros."""
    sizes = np.diff(offsets)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=values.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1], sizes)] = values
    return out


def _packed(matrix: np.ndarray) -> bytes:
    return np.ascontiguousarray(matrix, dtype="<i2" if not matrix.size or np.abs(matrix).max() < 1 << 15 else "<i8").tobytes()


def _unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    if not rows * width:
        return np.zeros((rows, width), dtype=np.int64)
    return np.frombuffer(data, "<i2" if len(data) == 2 * rows * width else "<i8").reshape(rows, width)


def _near_pivots(items: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id``, ``codes`` and ``near``: the two pivots with the largest inner product, as one number to order by."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _rows(batch.column(1))
            matrix = _matrix(values, offsets).astype(np.float64)
            near = np.zeros(len(matrix), dtype=np.int64)
            if len(pivots) > 1 and len(matrix):
                width = min(matrix.shape[1], pivots.shape[1])
                products = matrix[:, :width] @ pivots[:, :width].T
                two = np.argsort(-products, axis=1, kind="stable")[:, :2]
                near = two[:, 0] * len(pivots) + two[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], names=["id", "codes", "near"])

    return items.select("id", "codes").mapInArrow(assign, "id long, codes array<long>, near long")


def _numbered(items: DataFrame, pivots: np.ndarray) -> DataFrame:
    """All rows with a running number ``n`` in which similar vectors, and above all equal ones, follow each other."""
    rows = _near_pivots(items, pivots).withColumn("hash", F.xxhash64("codes"))
    return row_index(rows, [F.col("near"), F.col("hash"), F.col("id")], "n").select("n", "id", "codes")


_INDEX = "shard long, rows int, width int, ids binary, codes binary, highs binary, lows binary, firsts binary"


def build_index(numbered: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """One row per shard: its forward index, and per block the largest and smallest components and the smallest id."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        ids = table["id"].to_numpy()
        codes = _matrix(*_rows(table["codes"]))
        cuts = np.arange(0, len(ids), sizes.block)
        highs, lows = np.maximum.reduceat(codes, cuts, axis=0), np.minimum.reduceat(codes, cuts, axis=0)
        firsts = np.minimum.reduceat(ids, cuts)
        row = [key[0].as_py(), len(ids), codes.shape[1], ids.astype("<i8").tobytes(), _packed(codes), _packed(highs), _packed(lows), firsts.astype("<i8").tobytes()]
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.table([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in _INDEX.split(", ")])

    shards = numbered.withColumn("shard", F.floor(F.col("n") / sizes.shard)).groupBy("shard").applyInArrow(build, _INDEX)
    return stage(shards, "shards")


def _bounds(queries: np.ndarray, highs: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """Largest score that a row of a block may have, per query and block (rounded up where it is not exact)."""
    width = min(queries.shape[1], highs.shape[1])
    q = queries[:, :width].astype(np.float64)
    h, low = highs[:, :width].astype(np.float64), lows[:, :width].astype(np.float64)
    bounds = np.maximum(q, 0) @ h.T + np.minimum(q, 0) @ low.T
    if q.size and h.size and np.abs(q).max() * max(np.abs(h).max(), np.abs(low).max()) * width >= _EXACT:
        largest = np.maximum(np.abs(h), np.abs(low))
        bounds += 1e-9 * (np.abs(q) @ largest.T) + 1
    return bounds


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers."""
    width = min(queries.shape[1], rows.shape[1])
    q, r = queries[:, :width], rows[:, :width]
    if not q.size or not r.size:
        return np.zeros((len(q), len(r)), dtype=np.int64)
    if float(np.abs(q).max()) * float(np.abs(r).max()) * width < _EXACT:
        return (q.astype(np.float64) @ r.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ r.astype(np.int64).T


def _block_tables(table: pa.Table, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shard, maxima, minima and smallest id of every block of a stretch."""
    shards, parts = [], []
    width = max(table["width"].to_pylist(), default=0)
    for r in table.select(["shard", "rows", "width", "highs", "lows", "firsts"]).to_pylist():
        n = -(-r["rows"] // block)
        both = [np.pad(_unpacked(r[c], n, r["width"]).astype(np.int64), ((0, 0), (0, width - r["width"]))) for c in ("highs", "lows")]
        shards.append(np.full(n, r["shard"]))
        parts.append((*both, np.frombuffer(r["firsts"], "<i8")))
    highs, lows, firsts = (np.concatenate(p) for p in zip(*parts))
    return np.concatenate(shards), highs, lows, firsts


def _queries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return table["q"].to_numpy(), table["id"].to_numpy(), _matrix(*_rows(table["codes"]))


def _filled(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NONE).to_numpy()


def _chunks_by_stretch(queries: DataFrame, index: DataFrame, function, schema: str, sizes: Sizes) -> DataFrame:
    """``function(queries, shards)`` over every chunk of queries and every stretch of shards, all bounded in size."""
    chunks = -(-queries.count() // sizes.chunk)
    stretches = -(-index.count() // sizes.stretch)
    chunk = F.floor(F.col("q") / sizes.chunk)
    left = queries.withColumn("chunk", chunk).withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(stretches - 1, 0)).cast("long"))))
    narrow = index.select("shard", "rows", "width", "highs", "lows", "firsts").withColumn("stretch", F.floor(F.col("shard") / sizes.stretch))
    right = narrow.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(chunks - 1, 0)).cast("long"))))

    def cell(queries: pa.Table, shards: pa.Table) -> pa.Table:
        return function(queries, shards) if queries.num_rows and shards.num_rows else empty

    empty = _empty(schema)
    return left.groupBy("chunk", "stretch").cogroup(right.groupBy("chunk", "stretch")).applyInArrow(cell, schema)


_ARROW = {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}


def _empty(schema: str) -> pa.Table:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table([pa.array([], _ARROW[t]) for _, t in fields], names=[n for n, _ in fields])


def _best_shards(queries: DataFrame, index: DataFrame, sizes: Sizes) -> DataFrame:
    """``q, shard``: where each query's block of the largest bound lies (ties: the first shard)."""

    def best(table: pa.Table, shards: pa.Table) -> pa.Table:
        q, _, codes = _queries(table)
        shard, highs, lows, _ = _block_tables(shards, sizes.block)
        bounds = _bounds(codes, highs, lows)
        top = bounds.argmax(axis=1)
        return pa.table([pa.array(q), pa.array(bounds[np.arange(len(q)), top]), pa.array(shard[top])], names=["q", "bound", "shard"])

    found = _chunks_by_stretch(queries, index, best, "q long, bound double, shard long", sizes)
    return found.groupBy("q").agg((-F.max(F.struct("bound", (-F.col("shard")).alias("s")))["s"]).alias("shard"))


_VISIT = "shard long, q long, id long, codes array<long>, floor_score long, floor_id long"


def _worth_visiting(queries: DataFrame, index: DataFrame, sizes: Sizes) -> DataFrame:
    """The shards, but for the one already searched, that hold a block with a bound that can beat the query's floor."""

    def visits(table: pa.Table, shards: pa.Table) -> pa.Table:
        _, _, codes = _queries(table)
        shard, highs, lows, firsts = _block_tables(shards, sizes.block)
        score, first, seen = (_filled(table[c]) for c in ("floor_score", "floor_id", "seen"))
        bounds = _bounds(codes, highs, lows)
        open_ = (score == NONE)[:, None] | (bounds > score[:, None]) | ((bounds == score[:, None]) & (firsts[None, :] < first[:, None]))
        open_ &= shard[None, :] != seen[:, None]
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        at, which = np.nonzero(np.logical_or.reduceat(open_, cuts, axis=1))
        taken = table.select(["q", "id", "codes", "floor_score", "floor_id"]).take(pa.array(at))
        return taken.add_column(0, "shard", pa.array(shard[cuts][which])).combine_chunks()

    return _chunks_by_stretch(queries, index, visits, _VISIT, sizes)


def _search_shard(queries: np.ndarray, own: np.ndarray, floors: tuple[np.ndarray, np.ndarray], shard: dict, k: int, block_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query, id, score) of the k best of one shard that beat each query's floor."""
    ids = np.frombuffer(shard["ids"], "<i8")
    codes = _unpacked(shard["codes"], shard["rows"], shard["width"])
    blocks = -(-shard["rows"] // block_size)
    highs, lows = (_unpacked(shard[c], blocks, shard["width"]) for c in ("highs", "lows"))
    firsts = np.frombuffer(shard["firsts"], "<i8")
    bounds = _bounds(queries, highs, lows)
    order = np.lexsort((np.broadcast_to(firsts, bounds.shape), -bounds), axis=1)
    none = NONE
    best_score, best_id = np.full((len(queries), k), none), np.full((len(queries), k), np.iinfo(np.int64).max)
    # What a row has to beat: the floor, and later the k-th found.
    least_score, least_id, free = floors[0].copy(), floors[1].copy(), floors[0] == none
    live = np.arange(len(queries))
    for rank in range(blocks):
        block = order[live, rank]
        bound = bounds[live, block]
        # Blocks come by descending bound, so a query whose bound lies below its k-th score is done.
        live, block = (x[free[live] | (bound >= least_score[live])] for x in (live, block))
        if not len(live):
            break
        for b in np.unique(block):
            at = live[block == b]
            low, high = b * block_size, min((b + 1) * block_size, len(ids))
            scores = _scores(queries[at], codes[low:high])
            better = free[at, None] | (scores > least_score[at, None]) | ((scores == least_score[at, None]) & (ids[None, low:high] < least_id[at, None]))
            better &= ids[None, low:high] != own[at, None]
            hits = better.any(axis=1)
            if not hits.any():
                continue
            at, better, scores = at[hits], better[hits], scores[hits]
            all_scores = np.concatenate([best_score[at], np.where(better, scores, none)], axis=1)
            found = np.where(better, ids[None, low:high], np.iinfo(np.int64).max)
            all_ids = np.concatenate([best_id[at], found], axis=1)
            first = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
            best_score[at], best_id[at] = np.take_along_axis(all_scores, first, 1), np.take_along_axis(all_ids, first, 1)
            full = best_score[at, -1] != none
            full_at = at[full]
            least_score[full_at], least_id[full_at], free[full_at] = best_score[full_at, -1], best_id[full_at, -1], False
    q, place = np.nonzero(best_score != none)
    return q, best_id[q, place], best_score[q, place]


_FOUND = "q long, query_id long, vec_id long, score long"


def _searched(visits: DataFrame, index: DataFrame, k: int, sizes: Sizes) -> DataFrame:
    """The best rows of every shard that a query visits. ``visits``: see ``_VISIT``."""
    visits = stage(visits.withColumn("chunk", F.floor(F.col("q") / sizes.chunk)), "visits")
    cells = visits.select(F.col("shard").alias("at_shard"), F.col("chunk").alias("of_chunk")).distinct()
    cells = cells.join(index, F.col("at_shard") == F.col("shard")).drop("shard")
    empty = _empty(_FOUND)

    def search(table: pa.Table, shards: pa.Table) -> pa.Table:
        if not table.num_rows or not shards.num_rows:
            return empty
        q, own, codes = _queries(table)
        floors = (_filled(table["floor_score"]), _filled(table["floor_id"]))
        at, ids, scores = _search_shard(codes, own, floors, shards.to_pylist()[0], k, sizes.block)
        return pa.table([pa.array(q[at]), pa.array(own[at]), pa.array(ids), pa.array(scores)], names=["q", "query_id", "vec_id", "score"])

    return visits.groupBy("shard", "chunk").cogroup(cells.groupBy("at_shard", "of_chunk")).applyInArrow(search, _FOUND)


def top_k(items: DataFrame, queries: DataFrame, k: int, sizes: Sizes = Sizes()) -> DataFrame:
    """The ``k`` items with the largest inner product for every query, exactly: ``query_id, rank, vec_id, score``.

    ``items`` and ``queries`` have ``id`` (long) and ``codes`` (whole components). Ties go to the smaller id. Items with the
    query's own id are no candidates. Missing components of shorter vectors count as zero, so an empty vector scores 0 with
    everything. Repeated rows count each, as items and as queries. Scores must fit 64 bits. A query with fewer candidates
    gets them all; without items or queries there are no rows.
    """
    sample = items.orderBy(F.xxhash64("id", "codes"), "id").limit(sizes.pivots).collect()
    flat = np.array([x for r in sample for x in r["codes"]], dtype=np.float64)
    pivots = _matrix(flat, np.concatenate([[0], np.cumsum([len(r["codes"]) for r in sample])]).astype(np.int64))
    index = build_index(_numbered(items, pivots), sizes)
    asked = stage(_numbered(queries, pivots).withColumnRenamed("n", "q"), "queries")
    seeds = stage(_best_shards(asked, index, sizes), "seeds")
    nothing = F.lit(None).cast("long")
    first = asked.join(seeds, "q").select("shard", "q", "id", "codes", nothing.alias("floor_score"), nothing.alias("floor_id"))
    found = stage(_searched(first, index, k, sizes), "found")
    worst = F.min(F.struct("score", (-F.col("vec_id")).alias("i")))
    floors = found.groupBy("q").agg(F.count("*").alias("c"), worst.alias("w")).where(F.col("c") == k)
    floors = floors.select("q", F.col("w.score").alias("floor_score"), (-F.col("w.i")).alias("floor_id"))
    known = asked.join(seeds.withColumnRenamed("shard", "seen"), "q").join(floors, "q", "left")
    more = _searched(_worth_visiting(known, index, sizes), index, k, sizes)
    ranked = found.unionByName(more).withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256, vector: str = "embedding", sizes: Sizes = Sizes()) -> DataFrame:
    """``top_k`` over all rows of ``embeddings``, asked by the rows whose ``vec_id`` is divisible by ``every``.

    Components x become floor(scale * x). Rows without id and vectors that are null or hold a null or non-finite component
    take no part. Other columns are ignored.
    """
    items = embeddings.where(F.col("vec_id").isNotNull() & usable(vector)).select(F.col("vec_id").cast("long").alias("id"), quantised(vector, scale).alias("codes"))
    return top_k(items, items.where(F.col("id") % every == 0), k, sizes)


def oracle_sql(every: int = 50, k: int = 5, scale: int = 256) -> str:
    """The same ranking in SQL, by all scores of every query."""
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, [floor({scale} * x::DOUBLE) FOR x IN embedding] AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.c, d.c) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % {every} = 0) q JOIN v d ON d.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
