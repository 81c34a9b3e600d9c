"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

N-grams are ordered by class (found in one text only, found in several) and then by hash. The order is cut into fragments. Each fragment is
counted on its own: it learns which of its n-grams several texts share and hands these on as segments of the texts. Texts that share too
few n-grams over all fragments cannot link with anything. The rest meet in the prefixes of the order; for those that meet, the partial overlaps of
fragments are counted separately and summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankcut.llm.components import components
from rankcut.llm.frames import number_of, numbered, release
from rankcut.llm.text import FOLDED_WORDS, column_bytes, groups, mix, windows, words
from rankcut.operators.ordering import row_index
from rankcut.session import arrow_batches, stage

N = 5
PERCENT = 75
BLOCK = 1 << 21  # bytes of text whose n-grams are counted together before they are dealt out
BLOCK_ROWS = 60_000
BATCH_ROWS = 500  # texts that reach a task at a time
FRAGMENT = 1 << 24  # bytes of text whose n-grams make up one fragment
SALTS = 16  # tasks over which the segments of one text with copies everywhere are spread
PARTS = 4  # fragments in which the overlap of a pair is counted
CELL = 256  # texts in a block of those that are still apart
REMOVED = 1_000_000  # removed documents that are broadcast once counted

_SHARED_HERE = 0xFFFF  # in place of a text's number: several texts of the block hold this n-gram
_DEALT = "g int, kind int, node long, doc_id long, copy long, n long, nodes binary, sizes binary, high binary, low binary, owner binary"
_KEPT = "kind int, node long, doc_id long, copy long, n long, g int, nodes binary, sizes binary, counts binary, high binary, low binary"
_SET = "node long, n long, tokens array<long>"
_DOCUMENT, _SEGMENT, _BLOCK = 0, 1, 2


def shingle_sets(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every text with their rows, sorted by row and hash. A text of fewer words is one n-gram."""
    data, offsets = column_bytes(column)
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in groups(offsets):
        rel = offsets[low : high + 1] - offsets[low]
        h, starts, _ = words(data[offsets[low] : offsets[high]], rel, FOLDED_WORDS)
        owner = np.searchsorted(rel, starts, side="right") - 1
        found, first = windows(h, owner, n)
        found, who = [found], [owner[first]]
        size = np.bincount(owner, minlength=high - low)
        for k in range(1, n):
            short = size[owner] == k
            whole, first = windows(h[short], owner[short], k)
            found.append(whole)
            who.append(owner[short][first])
        g, r = np.concatenate(found), np.concatenate(who)
        order = np.lexsort((g, r))
        g, r = g[order], r[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        hashes.append(g[new])
        rows.append(r[new] + low)
    return np.concatenate(hashes), np.concatenate(rows)


def _signatures(hashes: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and 64-bit identity of the set of each row."""
    n = np.bincount(rows, minlength=count)
    total = np.append(np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
    ends = np.cumsum(n)
    return n, mix(total[ends] - total[ends - n] + n.astype(np.uint64)).view(np.int64)


def _steps(rising: np.ndarray) -> bytes:
    """Differences of a rising row, lower halves first: the upper ones are nearly all zero and compress away."""
    step = np.diff(rising, prepend=rising.dtype.type(0)).astype("<u4").view("<u2")
    return step[0::2].tobytes() + step[1::2].tobytes()


def _unstepped(data: bytes) -> np.ndarray:
    half = np.frombuffer(data, "<u2").reshape(2, -1).astype(np.uint32)
    return np.cumsum(half[0] | (half[1] << np.uint32(16)), dtype=np.uint32)


def _deal(fragments: int, n_words: int):
    """Texts -> their names and sizes, segments known to be shared, and one row per block and fragment."""

    schema = pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("node", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("n", pa.int64())] + [(c, pa.binary()) for c in ("nodes", "sizes", "high", "low", "owner")])

    def batch(kind: int, g: np.ndarray, **columns) -> pa.RecordBatch:
        columns |= {"g": g, "kind": np.full(len(g), kind)}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(g), f.type) for f in schema], schema=schema)

    def block(ids: pa.Array, copies: pa.Array, texts: pa.Array, number: int) -> Iterator[pa.RecordBatch]:
        hashes, rows = shingle_sets(texts, n_words)
        n, node = _signatures(hashes, rows, len(texts))
        yield batch(_DOCUMENT, fragments + (number + np.arange(len(node))) % fragments, node=node, doc_id=ids, copy=copies, n=n)
        _, first = np.unique(node, return_index=True)  # copies count once
        distinct = np.zeros(len(texts), bool)
        distinct[first] = True
        use = distinct[rows]
        token, owner = (hashes[use] >> np.uint64(16)).astype(np.int64), rows[use]
        del hashes, rows, use
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        if not len(token):
            return
        edge = np.ones(len(token) + 1, bool)
        edge[1:-1] = token[1:] != token[:-1]
        runs = np.flatnonzero(edge)
        several = np.repeat(np.diff(runs) > 1, np.diff(runs))
        shared, by = token[several], owner[several]
        if len(by):
            order = np.argsort(by, kind="stable")
            shared, by = shared[order], by[order]
            bounds = np.flatnonzero(np.diff(by, prepend=-1, append=-1))
            who = node[by[bounds[:-1]]]
            high = pa.BinaryArray.from_buffers(pa.binary(), len(who), [None, pa.py_buffer((8 * bounds).astype("<i4")), pa.py_buffer(shared.astype("<i8"))])
            yield batch(_SEGMENT, fragments + (who + number % SALTS) % fragments, node=who, n=n[by[bounds[:-1]]], high=high)
        keep = edge[:-1] | ~several
        token, mark = token[keep], np.where(several[keep], _SHARED_HERE, owner[keep])
        fragment = ((token >> 16) * fragments) >> 32
        dealt: dict[str, list] = {c: [] for c in ("g", "nodes", "sizes", "high", "low", "owner")}
        for f in np.unique(fragment).tolist():
            low, high = np.searchsorted(fragment, [f, f + 1])
            who = np.unique(mark[low:high])
            who = who[who != _SHARED_HERE]
            local = np.where(mark[low:high] == _SHARED_HERE, _SHARED_HERE, np.searchsorted(who, mark[low:high]))
            dealt["g"].append(f)
            dealt["nodes"].append(node[who].astype("<i8").tobytes())
            dealt["sizes"].append(n[who].astype("<u4").tobytes())
            dealt["high"].append(_steps((token[low:high] >> 16).astype("<u4")))
            dealt["low"].append(token[low:high].astype("<u2").tobytes())
            dealt["owner"].append(local.astype("<u2").tobytes())
        g = np.array(dealt.pop("g"))
        yield batch(_BLOCK, g, **dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() * 7919, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            yield from block(table["doc_id"], table["copy"], table["text"], number)
            number += 1
            del table
            release()

        for batch in batches:
            for low in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(low, BATCH_ROWS)
                held.append(part)
                size += part.nbytes
                if size >= BLOCK or sum(p.num_rows for p in held) >= BLOCK_ROWS:
                    yield from done()
        if held:
            yield from done()

    return run


def _distinct(node: np.ndarray, n: np.ndarray, token: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts, by text (``order`` goes before), and where each text begins, with the end."""
    by = np.lexsort((token, node, *order))
    node, n, token = node[by], n[by], token[by]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (token[1:] != token[:-1])
    node, n, token = node[new], n[new], token[new]
    return node, n, token, np.flatnonzero(np.diff(node, prepend=node[:1] - 1, append=node[-1:] + 1)) if len(node) else np.zeros(1, np.int64)


_PACKED = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("n", pa.int64()), ("g", pa.int32())] + [(c, pa.binary()) for c in ("nodes", "sizes", "counts", "high", "low")])


def _segments(node: np.ndarray, n: np.ndarray, token: np.ndarray, buckets: int) -> pa.Table:
    """Distinct shared n-grams of the texts, packed into one row per bucket of texts: there are no more rows than buckets, however many texts share n-grams."""
    bucket = (node.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    node, n, token, first = _distinct(node, n, token, bucket)
    who, sizes, counts = node[first[:-1]], n[first[:-1]], np.diff(first)
    g = (who.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    texts = np.flatnonzero(np.diff(g, prepend=-1, append=-1)) if len(g) else np.zeros(1, np.int64)

    def cut(values: np.ndarray, at: np.ndarray) -> pa.Array:
        offsets = (values.itemsize * at).astype("<i4")
        return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])

    rows = len(texts) - 1
    packed = {
        "kind": np.full(rows, _SEGMENT, np.int32), "g": g[texts[:-1]], "nodes": cut(who.astype("<i8"), texts), "sizes": cut(sizes.astype("<u4"), texts), "counts": cut(counts.astype("<u4"), texts),
        "high": cut((token >> 16).astype("<u4"), first[texts]), "low": cut(token.astype("<u2"), first[texts]),
    }
    return pa.table([pa.array(packed[f.name], f.type) if f.name in packed else pa.nulls(rows, f.type) for f in _PACKED], schema=_PACKED)


def _count_fragment(buckets: int):
    """Shared n-grams of one fragment, as segments of the texts that hold them; other rows pass through."""

    def run(table: pa.Table) -> pa.Table:
        release()  # what the last group left
        kinds = table["kind"].to_numpy()
        out = []
        docs = table.filter(pa.array(kinds == _DOCUMENT))
        if docs.num_rows:
            out.append(pa.table([docs[f.name].combine_chunks() if f.name in ("kind", "node", "doc_id", "copy", "n") else pa.nulls(docs.num_rows, f.type) for f in _PACKED], schema=_PACKED))
        known = table.filter(pa.array(kinds == _SEGMENT))
        if known.num_rows:
            parts = [np.frombuffer(b, "<i8") for b in known["high"].to_pylist()]
            size = [len(p) for p in parts]
            out.append(_segments(np.repeat(known["node"].to_numpy(), size), np.repeat(known["n"].to_numpy(), size), np.concatenate(parts), buckets))
        blocks = table.filter(pa.array(kinds == _BLOCK))
        if blocks.num_rows:
            cols = {c: blocks[c].to_pylist() for c in ("nodes", "sizes", "high", "low", "owner")}
            token, who, total = [], [], 0
            for high, low, owner, nodes in zip(cols["high"], cols["low"], cols["owner"], cols["nodes"], strict=True):
                token.append((_unstepped(high).astype(np.int64) << 16) | np.frombuffer(low, "<u2"))
                o = np.frombuffer(owner, "<u2").astype(np.int64)
                who.append(np.where(o == _SHARED_HERE, -1, o + total))
                total += len(nodes) // 8
            token, who = np.concatenate(token), np.concatenate(who)
            node = np.frombuffer(b"".join(cols["nodes"]), "<i8")
            n = np.frombuffer(b"".join(cols["sizes"]), "<u4")
            order = np.argsort(token, kind="stable")
            token, who = token[order], who[order]
            new = np.append(True, token[1:] != token[:-1])
            runs = np.append(np.flatnonzero(new), len(token))
            name = np.where(who < 0, 0, node[who]) if len(node) else np.zeros(len(who), np.int64)
            lowest, highest = np.minimum.reduceat(name, runs[:-1]), np.maximum.reduceat(name, runs[:-1])
            marked = np.minimum.reduceat(who, runs[:-1]) < 0
            shared = np.repeat(marked | (lowest != highest), np.diff(runs)) & (who >= 0)
            if shared.any():
                out.append(_segments(node[who[shared]], n[who[shared]], token[shared], buckets))
        return pa.concat_tables(out) if out else _PACKED.empty_table()

    return run


def _assemble(percent: int):
    """The packed segments of one bucket -> one row per text that shares enough n-grams for a link, with these in order."""

    def run(table: pa.Table) -> pa.Table:
        release()  # what the last bucket left
        column = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
        counts = column("counts", "<u4")
        token = (column("high", "<u4").astype(np.int64) << 16) | column("low", "<u2")
        node, n, token, first = _distinct(np.repeat(column("nodes", "<i8"), counts), np.repeat(column("sizes", "<u4"), counts), token)
        size = np.diff(first)
        able = size * 100 >= n[first[:-1]].astype(np.int64) * percent
        tokens = token[np.repeat(able, size)]
        ends = pa.array(np.append(0, np.cumsum(size[able])), pa.int32())
        who = first[:-1][able]
        return pa.table({"node": pa.array(node[who], pa.int64()), "n": pa.array(n[who].astype(np.int64), pa.int64()), "tokens": pa.ListArray.from_arrays(ends, pa.array(tokens, pa.int64()))})

    return run


def verify(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links among ``pairs``: the overlap in each fragment is counted separately and summed per pair."""
    spread = pairs.select("a", "b", "a_n", "b_n", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
    one = parts.select(F.col("node").alias("a"), "part", F.col("tokens").alias("a_tokens"))
    two = parts.select(F.col("node").alias("b"), "part", F.col("tokens").alias("b_tokens"))
    partial = spread.join(one, ["a", "part"]).join(two, ["b", "part"]).select("a", "b", "a_n", "b_n", F.size(F.array_intersect("a_tokens", "b_tokens")).alias("common"))
    overlap = partial.groupBy("a", "b", "a_n", "b_n").agg(F.sum("common").alias("overlap"))
    return overlap.where(100 * F.col("overlap") >= percent * (F.col("a_n") + F.col("b_n") - F.col("overlap"))).select("a", "b")


def _hub_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Each text with the one text that most of its prefix leads to: from every n-gram to the text that holds the largest share of shared n-grams.

    Among copies with edits that is the text they were made from. Pairs whose sizes or shared n-grams allow no link are left out.
    """
    rank = F.struct((F.col("s") / F.col("n")).alias("share"), (-F.col("node")).alias("first"), "node", "n", "s")
    hubs = postings.groupBy("token").agg(F.max(rank).alias("h"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    hubs = hubs.select("token", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.s").alias("hub_s"))
    able = (100 + percent) * F.least("s", "hub_s") >= percent * (F.col("n") + F.col("hub_n"))
    met = postings.join(hubs, "token").where((F.col("node") != F.col("hub")) & able).groupBy("node", "n", "hub", "hub_n").agg(F.count("*").alias("met"))
    best = met.groupBy("node", "n").agg(F.max(F.struct("met", "hub", "hub_n")).alias("m"))
    return best.select(F.col("m.hub").alias("a"), F.col("node").alias("b"), F.col("m.hub_n").alias("a_n"), F.col("n").alias("b_n"))


def _joined_cells(percent: int):
    """Links in one cell, a pair of blocks of texts; of these as many as join components."""

    def run(table: pa.Table) -> pa.Table:
        release()  # what the last cell left
        node, label, n, s = (table[c].to_numpy() for c in ("node", "label", "n", "s"))
        side = table["side"].to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: both, in the cell of a block with itself
        tokens = table["tokens"].combine_chunks()
        flat, counts = tokens.flatten().to_numpy(), np.diff(tokens.offsets.to_numpy())
        overlap = _overlaps(flat, np.repeat(np.arange(len(node)), counts), left, right)
        fits = (100 + percent) * overlap >= percent * (n[left][:, None] + n[right][None, :])
        fits &= label[left][:, None] != label[right][None, :]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out: list[tuple[int, int]] = []
        for i, j in zip(*np.nonzero(fits), strict=True):
            a, b = left[i], right[j]
            x, y = root(int(label[a])), root(int(label[b]))
            if x != y:
                parent[x] = y
                out.append((int(node[a]), int(node[b])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _overlaps(token: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Common n-grams of every left and right text, summed over ranges of the n-gram order."""
    on_left, on_right = np.full(owner.max(initial=-1) + 1, -1), np.full(owner.max(initial=-1) + 1, -1)
    on_left[left], on_right[right] = np.arange(len(left)), np.arange(len(right))
    distinct, code = np.unique(token, return_inverse=True)
    l, r = on_left[owner], on_right[owner]  # noqa: E741
    holds = (np.bincount(code[l >= 0], minlength=len(distinct)) > 0) & (np.bincount(code[r >= 0], minlength=len(distinct)) > 0)
    place = np.cumsum(holds) - 1
    keep = holds[code]
    code, l, r = place[code[keep]], l[keep], r[keep]
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    code, l, r = code[order], l[order], r[order]
    for low in range(0, int(holds.sum()), chunk):
        a, b = np.searchsorted(code, [low, low + chunk])
        c, li, ri = code[a:b] - low, l[a:b], r[a:b]
        one, two = np.zeros((len(left), chunk), np.float32), np.zeros((len(right), chunk), np.float32)
        one[li[li >= 0], c[li >= 0]] = 1
        two[ri[ri >= 0], c[ri >= 0]] = 1
        total += one @ two.T
    return total.astype(np.int64)


def _still_open(texts: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """``token, node, label``: prefixes of the texts that may link with one of another component.

    Two such texts only have n-grams in common that several components hold. So a text needs enough of these, and the order can begin anew among
    them: the rarest first, and of this order only the prefix.
    """
    names = texts.withColumnsRenamed({"node": "_node"})
    apart = stage(able.join(names, F.col("node") == F.col("_node")).select("node", "label", "n", "tokens"), "apart")
    held = apart.select("node", "label", "n", F.explode("tokens").alias("token"))
    mixed = held.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("df")).where("low <> high").select("token", "df")
    own = held.join(mixed, "token").groupBy("node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("m"))
    needed = F.ceil(F.col("n") * percent / F.lit(100.0))
    prefix = F.slice("m", F.lit(1), (F.size("m") - needed + 1).cast("int"))
    return own.where(F.size("m") >= needed).select("node", "label", F.explode(prefix).alias("t")).select("t.token", "node", "label")


def _found_links(postings: DataFrame, able: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """All components that links form: ``node, label`` of the texts with links.

    First every text is compared with one hub. Texts whose n-grams still lead to different components are ordered by
    hub, so that copies stand together, and cut into blocks; every pair of blocks that such an n-gram leads to is a cell, and a cell compares
    all its texts of different components. Neither the pairs nor all links are ever written out.
    """
    first = stage(_hub_pairs(postings, percent), "pairs")
    links = stage(verify(first, parts, percent), "links")
    labels = components(links)
    now = postings.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("token", "node", F.coalesce("label", "node").alias("label"))
    mixed = now.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    texts = now.join(mixed, "token").select("node", "label").distinct()
    open_ = stage(_still_open(texts, able, percent), "open")
    if open_.isEmpty():
        return labels
    hub = first.select(F.col("b").alias("_b"), F.col("a").alias("hub"))
    texts = open_.select("node", "label").distinct().join(hub, F.col("node") == F.col("_b"), "left").select("node", "label", F.coalesce("hub", "node").alias("hub"))
    blocks = row_index(texts, [F.col("hub"), F.col("node")], "place").select("node", "label", F.floor(F.col("place") / CELL).alias("block"))
    blocks = stage(blocks, "blocks")
    held = open_.select("token", "node").join(blocks.select("node", "block"), "node")
    spread = held.groupBy("token").agg(F.collect_set("block").alias("at"))  # one entry per block of texts
    # A text goes to the cells of its block with the blocks that its own n-grams lead to.
    reached = held.join(spread, "token").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    mine = blocks.join(reached.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).select("node", "label", "block", F.explode("at").alias("other"))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    dealt = mine.select("node", "label", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), side.alias("side"))
    dealt = stage(dealt, "cells")
    labels_of = dealt.groupBy("x", "y").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("x", "y")
    members = dealt.join(labels_of, ["x", "y"])
    sets = able.select(F.col("node").alias("_node"), "n", F.size("tokens").alias("s"), "tokens")
    filled = members.join(sets, F.col("node") == F.col("_node")).select("x", "y", "side", "node", "label", "n", "s", "tokens")
    more = filled.groupBy("x", "y").applyInArrow(_joined_cells(percent), "a long, b long")
    return components(links.union(stage(more, "links")))


def _in_part(part: int) -> Column:
    """The n-grams of one of ``PARTS`` fragments of the order."""
    return F.filter("tokens", lambda t: F.shiftright(t * PARTS, 48) == part)


def _components(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id, copy, n, label, component`` per row: ``copy`` is the hash of the text, ``label`` names the component (null without words)."""
    spark = documents.sparkSession
    # A fragment is handled in one piece, so their number follows the text.
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FRAGMENT))
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.mapInArrow(_deal(fragments, n), _DEALT)
    with arrow_batches(spark, BATCH_ROWS):  # executor and worker would both hold thousands of texts beside the block
        counted = stage(dealt.groupBy("g").applyInArrow(_count_fragment(fragments), _KEPT), "fragments")
    docs = counted.where(F.col("kind") == _DOCUMENT).select("doc_id", "copy", "node", "n")
    segments = counted.where(F.col("kind") == _SEGMENT).select("g", "nodes", "sizes", "counts", "high", "low")
    able = stage(segments.groupBy("g").applyInArrow(_assemble(percent), _SET), "able")
    needed = F.ceil(F.col("n") * percent / F.lit(100.0))
    prefix = F.slice("tokens", F.lit(1), (F.size("tokens") - needed + 1).cast("int"))  # what one text alone holds comes first in the order
    postings = stage(able.select("node", "n", F.size("tokens").alias("s"), F.explode(prefix).alias("token")), "postings")
    within = [_in_part(p) for p in range(PARTS)]
    parts = stage(able.select("node", F.posexplode(F.array(*within)).alias("part", "tokens")), "parts")
    labels = _found_links(postings, able, parts, percent)

    least = docs.where(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("least"))
    linked = least.join(labels, "node")  # texts with links only
    smallest = linked.groupBy("label").agg(F.min("least").alias("component"))
    of_node = linked.join(smallest, "label").select("node", "label", "component")
    named = least.join(of_node, "node", "left").select(F.col("node").alias("_node"), F.coalesce("label", "node").alias("label"), F.coalesce("component", "least").alias("component"))
    joined = docs.join(stage(named, "components"), (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", "copy", "n", "label", "component")


def near_duplicates(documents: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set are its distinct ``n``-word shingles (all its words, if
    fewer). Two documents link when ``100 * intersection >= percent * union``; ``component_id`` is the smallest doc_id reachable.
    Null, empty and blank texts have an empty set and link with nothing. Rows with equal sets are one text and are never paired. Rows with a null
    doc_id take part and get the smallest id of their component, null if it has none. Repeated rows stay. An empty table gives no rows.

    Texts and n-grams are known by hashes (64 bits for sets, 48 for n-grams). There are as many fragments as the session has shuffle partitions, and
    more if these would hold the n-grams of more than ``FRAGMENT`` bytes of text. Ids must be whole numbers. Other columns, whatever their names, are ignored.
    """
    found = _components(documents, n, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(documents: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that with the smallest id (null last, then by the text's hash), with all its columns.

    Documents without words all stay. Of repeated rows one stays.
    """
    found = stage(_components(documents, n, percent), "near_duplicates").where(F.col("n") > 0)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    chosen = found.groupBy("label").agg(F.min(order).alias("c")).select(F.col("label").alias("_label"), "c.doc_id", "c.copy").withColumnsRenamed({"doc_id": "_doc", "copy": "_copy"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("copy") == F.col("_copy"))
    decided = stage(found.join(chosen, F.col("label") == F.col("_label")).groupBy("doc_id", "copy", same.alias("kept")).agg(F.count("*").alias("rows")), "decided")
    gone, twice = decided.where(~F.col("kept")), decided.where(F.col("kept") & (F.col("rows") > 1))
    plain = numbered(documents)
    hashed = plain.withColumns({"_id": F.col(number_of(documents, "doc_id")), "_text": F.xxhash64(number_of(documents, "text"))})
    rest = _rows_of(hashed, gone, "left_anti")
    if not twice.isEmpty():
        rest = _rows_of(rest, twice, "left_anti").union(_rows_of(rest, twice, "left_semi").dropDuplicates(["_id", "_text"]))
    return rest.select(*plain.columns).toDF(*documents.columns)


def _rows_of(hashed: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows with one of the keys, or without; few keys (counted) are broadcast so that texts stay where they are."""
    named = keys.select(F.col("doc_id").alias("_doc"), F.col("copy").alias("_copy"))
    if named.count() <= REMOVED:
        named = F.broadcast(named)
    return hashed.join(named, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_copy")), how)
