"""Occurrence scores of items around a cutoff, computed from whole arrays.

The same rows as ``trim_docs``, ``tag_rows``, ``impute_scores`` and ``occurrence_scores`` give, without a row per token. Tokens that are neither in the
window nor a part of one of its merges can take no part; the others are packed with their positions before anything is shuffled. Documents and
evaluations then meet once by ``uid``, and whole batches of documents are tagged and summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankcut.operators.quality import AlignmentChecks
from rankcut.session import arrow_batches, stage

# Documents that reach a task at a time.
BATCH_ROWS = 1_000

# Ids up to this one are looked up in a table, and pairs of up to so many different tokens in a square of these.
_DIRECT_IDS, _DIRECT_PAIRS = 1 << 22, 1_500

MISSED = "a tagged token has no score, or that of another token"

_TOKENS = "size int, pos binary, tok binary"
_SCORES = "size int, width int, pos binary, tok binary, val binary, nul binary"


@dataclass
class Items:
    """The ids in the window of a cutoff and the merges that are imputed; built once, shipped to every task."""

    low: int
    high: int
    ids: np.ndarray  # all tokens that matter, rising
    keys: np.ndarray  # pairs of places in ``ids``, rising
    made: np.ndarray  # their merged ids

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Places in ``ids``; -1 for tokens that do not matter."""
        if len(self.ids) and 0 <= self.ids[0] and self.ids[-1] < _DIRECT_IDS:
            if not hasattr(self, "_table"):
                self._table = np.full(int(self.ids[-1]) + 2, -1, np.int32)
                self._table[self.ids] = np.arange(len(self.ids))
            return self._table[np.where((tokens < 0) | (tokens > self.ids[-1]), len(self._table) - 1, tokens)]
        at = np.minimum(np.searchsorted(self.ids, tokens), max(len(self.ids) - 1, 0))
        return np.where(self.ids[at] == tokens, at, -1) if len(self.ids) else np.full(len(tokens), -1)

    def merged(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Place among ``made`` of the pairs; -1 for others."""
        if not len(self.keys):
            return np.full(len(first), -1)
        wanted = first.astype(np.int64) * len(self.ids) + second
        if len(self.ids) <= _DIRECT_PAIRS:
            if not hasattr(self, "_square"):
                self._square = np.full(len(self.ids) ** 2, -1, np.int32)
                self._square[self.keys] = np.arange(len(self.keys))
            return self._square[wanted]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    @property
    def code(self) -> str:
        return "<u2" if len(self.ids) <= 1 << 16 else "<i4"


def items_around(merges: DataFrame, cutoff: int, half_width: int) -> Items:
    """``merges`` are those of ``imputed_merges``: a window's worth of rows, which passes through the driver."""
    rows = merges.where(F.col("tok_a").isNotNull() & F.col("tok_b").isNotNull()).select("tok_a", "tok_b", "tok").toArrow()
    a, b, made = (rows[c].to_numpy().astype(np.int64) for c in ("tok_a", "tok_b", "tok"))
    low, high = cutoff - half_width, cutoff + half_width
    ids = np.unique(np.concatenate([np.arange(low, high), a, b]))
    keys = np.searchsorted(ids, a) * len(ids) + np.searchsorted(ids, b)
    order = np.argsort(keys)
    return Items(low, high, ids, keys[order], made[order])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``counts[i]`` of them, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive ``counts`` of the values as bytes, one entry each."""
    offsets = (values.itemsize * np.append(0, np.cumsum(counts))).astype("<i4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column and their number in each entry."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    size = np.dtype(kind).itemsize
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, kind)
    return values, np.diff(offsets) // size


def _lists(column: pa.Array, fill) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list column without and with (``fill``) its NULL elements told apart, and the lengths (0 for NULL)."""
    flat = column.flatten()
    none = pc.is_null(flat).to_numpy(zero_copy_only=False)
    return pc.fill_null(flat, fill).to_numpy(zero_copy_only=False), none, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _kept(column: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[pa.Array]]:
    """Row, position and code of the tokens that matter, and the packed positions (steps, a byte each up to 254) and codes."""
    tokens, none, size = _lists(column, 0)
    place = items.places(tokens.astype(np.int64))
    at = np.flatnonzero((place >= 0) & ~none)
    ends = np.cumsum(size)
    row = np.searchsorted(ends, at, side="right")
    pos = at - (ends - size)[row]
    step = np.diff(pos, prepend=0)
    first = np.diff(row, prepend=-1) != 0
    step[first] = pos[first]
    taken = step // 255 + 1
    steps = np.full(taken.sum(), 255, np.uint8)
    steps[np.cumsum(taken) - 1] = step % 255
    counts = np.bincount(row, minlength=len(column))
    length = np.bincount(row, weights=taken, minlength=len(column)).astype(np.int64)
    return row, pos, counts, [_binary(steps, length), _binary(place[at].astype(items.code), counts)]


def _unpacked(packed: pa.StructArray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position and code of the tokens, and their number per row."""
    steps, length = _bytes(packed.field("pos"), "u1")
    code, counts = _bytes(packed.field("tok"), items.code)
    so_far = np.append(0, np.cumsum(steps, dtype=np.int64))
    base = so_far[np.cumsum(length) - length]
    pos = so_far[1:][steps < 255] - np.repeat(base, counts)
    return pos, code.astype(np.int64), counts


def _sizes(column: pa.Array) -> pa.Array:
    return pc.list_value_length(column).cast(pa.int32())


def pack_tokens(docs: DataFrame, items: Items) -> DataFrame:
    """``uid, d``: the tokens of each document that matter. A map, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("input_ids")
            packed = pa.StructArray.from_arrays([_sizes(ids), *_kept(ids, shared.value)[3]], ["size", "pos", "tok"])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), packed], ["uid", "d"])

    schema = T.StructType([docs.select("uid").schema[0], T.StructField("d", T._parse_datatype_string(_TOKENS))])
    return docs.select("uid", "input_ids").mapInArrow(run, schema)


def pack_scores(evals: DataFrame, items: Items) -> DataFrame:
    """``uid, step, e``: the tokens of each evaluation that matter, with their scores. A map, without a shuffle."""
    shared = evals.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = batch.column("token_ids"), batch.column("token_logprob")
            row, pos, counts, packed = _kept(ids, shared.value)
            value, none, size = _lists(scores.cast(pa.list_(pa.float64())), 0.0)
            known = pos < size[row]
            at = np.where(known, (np.cumsum(size) - size)[row] + pos, 0)
            val, nul = np.zeros(len(at)), ~known
            val[known] = value[at[known]]
            nul[known] = none[at[known]]
            val[nul] = 0.0
            missing = _binary(nul.astype(np.uint8), counts) if nul.any() else pa.nulls(len(ids), pa.binary())
            fields = [_sizes(scores), _sizes(ids), *packed, _binary(val, counts), missing]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("step"), pa.StructArray.from_arrays(fields, ["size", "width", "pos", "tok", "val", "nul"])], ["uid", "step", "e"])

    kept = evals.select("uid", "step").schema
    return evals.select("uid", "step", "token_logprob", "token_ids").mapInArrow(run, T.StructType([*kept, T.StructField("e", T._parse_datatype_string(_SCORES))]))


def _numbers(column: pa.Array, fill: int) -> np.ndarray:
    return pc.fill_null(column, fill).to_numpy(zero_copy_only=False).astype(np.int64)


def _met(docs: pa.ListArray, evals: pa.ListArray, items: Items, base_step: int, strict: bool) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array, np.ndarray, int]:
    """Group, step, item, score and number of parts of every occurrence in the groups, each a list of documents and one of evaluations; the number of tagged tokens."""
    nd, ne = (_numbers(pc.list_value_length(x), 0) for x in (docs, evals))
    dg, eg = np.repeat(np.arange(len(nd)), nd), np.repeat(np.arange(len(ne)), ne)
    docs, evals = docs.flatten(), evals.flatten()
    step, scored = evals.field("step"), evals.field("e")
    length = _numbers(docs.field("size"), -1)  # -1: no array
    size, width = _numbers(scored.field("size"), -1), _numbers(scored.field("width"), 0)
    dpos, dcode, dcount = _unpacked(docs, items)
    epos, ecode, ecount = _unpacked(scored, items)
    val, _ = _bytes(scored.field("val"), "<f8")
    nul = np.zeros(len(val), bool)
    flags, flagged = _bytes(scored.field("nul"), "u1")
    nul[_ranges(np.cumsum(ecount) - ecount, flagged)] = flags

    # A document is cut once per evaluation of the base step.
    base = np.flatnonzero(pc.fill_null(pc.equal(step, base_step), False).to_numpy(zero_copy_only=False))
    nb = np.bincount(eg[base], minlength=len(nd))
    times = np.maximum(nb[dg], 1)
    v = np.repeat(np.arange(len(dg)), times)
    vg = dg[v]
    turn = _ranges(np.zeros(len(dg), np.int64), times)
    whole = np.full(len(v), -1)
    cut = nb[vg] > 0
    whole[cut] = size[base[((np.cumsum(nb) - nb)[vg] + turn)[cut]]]
    gone = length[v] - np.where(whole < 0, length[v], np.minimum(length[v], whole))

    # Tag: both tokens of a pair take its id, the second one also the position of the first; a token's own pair comes first.
    some = _ranges((np.cumsum(dcount) - dcount)[v], dcount[v])
    of = np.repeat(np.arange(len(v)), dcount[v])
    pos, code = dpos[some] - gone[of], dcode[some]
    inside = pos >= 0
    of, pos, code = of[inside], pos[inside], code[inside]
    begins = np.full(len(pos), -1)
    near = np.flatnonzero((of[1:] == of[:-1]) & (pos[1:] == pos[:-1] + 1))
    begins[near] = items.merged(code[near], code[near + 1])
    ends = np.append(-1, begins[:-1])[: len(begins)]
    pair = np.where(begins >= 0, begins, ends)
    tok = items.ids[code] if len(items.ids) else code
    if len(items.made):
        tok = np.where(pair >= 0, items.made[pair], tok)
    place = pos - (ends >= 0)
    wanted = (tok >= items.low) & (tok < items.high)
    of, pos, code, tok, place = (x[wanted] for x in (of, pos, code, tok, place))

    tagged = len(tok)

    # Every evaluation with the length of every document of its number, and these with every cut document.
    w = np.repeat(np.arange(len(eg)), nd[eg])
    wd = (np.cumsum(nd) - nd)[eg[w]] + _ranges(np.zeros(len(eg), np.int64), nd[eg])
    shift = size[w] - np.where(length[wd] < 0, size[w], np.minimum(size[w], length[wd]))
    nw = ne * nd
    p = np.repeat(np.arange(len(v)), nw[vg])
    pw = _ranges((np.cumsum(nw) - nw)[vg], nw[vg])
    hits = np.bincount(of, minlength=len(v))
    h = _ranges((np.cumsum(hits) - hits)[p], hits[p])
    met = np.repeat(np.arange(len(p)), hits[p])
    e = w[pw][met]
    at = pos[h] + shift[pw][met]
    first = np.cumsum(width) - width
    held = np.full(width.sum(), -1, np.int32)
    held[np.repeat(first, ecount) + epos] = np.arange(len(epos))
    found = np.full(len(h), -1)
    there = (size[e] >= 0) & (at < width[e])
    found[there] = held[first[e[there]] + at[there]]
    agree = found >= 0
    agree[agree] = ecode[found[agree]] == code[h[agree]]
    if strict and not agree.all():
        raise ValueError(MISSED)
    h, met, e, found = h[agree], met[agree], e[agree], found[agree]
    tok, place = tok[h], place[h]

    # Parts of one occurrence follow each other, unless evaluations or documents repeat.
    _, steps = np.unique(_numbers(step, 0), return_inverse=True)
    steps = 2 * steps + pc.is_null(step).to_numpy(zero_copy_only=False)
    bucket = eg[w[pw]] * (2 * len(eg) + 2) + steps[w[pw]]
    if len(np.unique(bucket)) < len(bucket):
        which = bucket[met]
        order = np.lexsort((place, tok, which))
        which, tok, place, e, found = (x[order] for x in (which, tok, place, e, found))
    else:
        which = met
    new = np.ones(len(tok), bool)
    new[1:] = (which[1:] != which[:-1]) | (tok[1:] != tok[:-1]) | (place[1:] != place[:-1])
    starts = np.flatnonzero(new)
    if not len(starts):
        return eg[:0], step.slice(0, 0), tok, pa.array([], pa.float64()), starts, tagged
    total = np.add.reduceat(val[found], starts)
    none = np.logical_and.reduceat(nul[found], starts)
    one = e[starts]
    return eg[one], step.take(pa.array(one)), tok[starts], pa.array(total, pa.float64(), mask=none), np.diff(starts, append=len(tok)), tagged


def occurrences(tokens: DataFrame, scores: DataFrame, items: Items, base_step: int, strict: bool, keep: list[str] = (), counted: bool = False) -> DataFrame:
    """``keep..., step, tok, logprob``, a row per occurrence, of packed documents and evaluations; ``keep`` are fields of a structured ``uid``.

    ``strict`` fails the query where a tagged token has no score of its own. Both tables are grouped by ``uid`` and joined, so tables dealt by
    it stay where they are. ``counted`` adds ``parts`` of each occurrence, and rows without item that have the number of ``tagged`` tokens.
    """
    documents = tokens.groupBy("uid").agg(F.collect_list("d").alias("d"))
    evaluations = scores.groupBy("uid").agg(F.collect_list(F.struct("step", "e")).alias("e"))
    met = documents.join(evaluations.hint("merge"), "uid", "left" if counted else "inner").select(*[F.col(f"uid.{c}").alias(c) for c in keep], "d", "e")
    shared = tokens.sparkSession.sparkContext.broadcast(items)
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, step, tok, total, parts, tagged = _met(batch.column("d"), batch.column("e"), shared.value, base_step, strict)
            columns = [batch.column(c).take(pa.array(group)) for c in kept] + [step, pa.array(tok, pa.int64()), total]
            if counted:
                columns += [pa.array(parts, pa.int64()), pa.nulls(len(tok), pa.int64())]
            found = pa.RecordBatch.from_arrays(columns, names)
            yield found
            if counted:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in found.schema.types[:-1]], pa.array([tagged], pa.int64())], names)

    long = T.LongType()
    named = [*met.select(*kept).schema, *scores.select("step").schema]
    fields = [T.StructField(f.name, f.dataType) for f in named] + [T.StructField("tok", long), T.StructField("logprob", T.DoubleType())]
    fields = T.StructType(fields + ([T.StructField("parts", long), T.StructField("tagged", long)] if counted else []))
    names = fields.names
    return met.mapInArrow(run, fields)


def packed(docs: DataFrame, evals: DataFrame, items: Items) -> tuple[DataFrame, DataFrame]:
    return pack_tokens(docs, items), pack_scores(evals, items)


def staged_occurrences(tokens: DataFrame, scores: DataFrame, items: Items, base_step: int = 0, strict: bool = False, keep: list[str] = (), checks: AlignmentChecks | None = None) -> DataFrame:
    """``occurrences`` written once; the same job fills in the ``checks`` (``evals`` are observed by whoever packs them)."""
    found = occurrences(tokens, scores, items, base_step, strict, keep, checks is not None)
    if checks is not None:
        total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
        found = found.observe(checks.tagged, total("tagged").alias("n"))
        found = found.observe(checks.scores, *[total(F.when(F.col("step") == s, F.col("parts"))).alias(f"step{s}") for s in checks.steps])
        found = found.where(F.col("tagged").isNull()).drop("parts", "tagged")
    with arrow_batches(found.sparkSession, BATCH_ROWS):
        return stage(found, "occurrences", compression="zstd")
