"""Scoring: batches under a token budget, context spans, and a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankcut.functions.arrays import left_pad
from rankcut.operators.blocks import Block, base_of, evaluated, evaluations_schema, looked_up, repeats
from rankcut.operators.ordering import join_groups, row_index
from rankcut.session import stage

# Fixed value: the id that pads batches and is never scored.
PAD_ID = 0


def length_histogram(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.size("input_ids").alias("len")).agg(F.count("*").alias("docs"))


def batch_layout(histogram: list[tuple[int, int]], budget: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Where batches start among documents sorted by falling length.

    A batch that opens at length L holds ``max(1, budget // L)`` documents, so the layout depends only on
    the histogram: one entry per distinct length, whatever the number of documents. Returns per length
    ``(len, open_batch, open_start, open_len, first_start, first_batch, size)``: documents of the length before rank
    ``first_start`` still belong to ``open_batch``, later ones to batches of ``size`` counted from there.
    """
    layout, rank, start, batch = [], 0, 0, 0
    opened = (0, 0, 0)
    for length, docs in sorted(histogram, reverse=True):
        end = rank + docs
        size = max(1, budget // length) if length else max(1, budget)
        layout.append((length, *opened, start, batch, size))
        if start < end:
            new = -(-(end - start) // size)
            start += new * size
            batch += new
            opened = (batch - 1, start - size, length)
        rank = end
    return layout


def pack_batches(docs: DataFrame, budget: int) -> DataFrame:
    """Assign ``rank, batch_id, batch_len`` to documents, longest first, under a padded-token budget."""
    spark = docs.sparkSession
    histogram = [(r["len"], r["docs"]) for r in length_histogram(docs).collect()]
    layout = spark.createDataFrame(
        batch_layout(histogram, budget),
        "len int, open_batch long, open_start long, open_len int, first_start long, first_batch long, size long",
    )
    lengths = docs.select("uid", F.size("input_ids").alias("len"))
    ranked = row_index(lengths, [F.desc("len"), F.asc("uid")], "rank")
    fresh = F.col("rank") >= F.col("first_start")
    return join_groups(ranked, layout, ["len"]).select(
        "uid",
        "len",
        "rank",
        F.when(fresh, F.col("first_batch") + F.floor((F.col("rank") - F.col("first_start")) / F.col("size")))
        .otherwise(F.col("open_batch"))
        .cast("long")
        .alias("batch_id"),
        F.when(fresh, F.col("len")).otherwise(F.col("open_len")).alias("batch_len"),
    )


def collate(docs: DataFrame, packed: DataFrame, pad: int = PAD_ID) -> DataFrame:
    """Pad every document on the left to the length of its batch."""
    return docs.join(packed.select("uid", "batch_id", "batch_len"), "uid").withColumn(
        "input_ids", left_pad(F.col("input_ids"), F.col("batch_len"), F.lit(pad))
    )


def span_plan(length: Column, window: int = 512, step: int = 256) -> Column:
    """Array of ``(start, end, scored)``: context spans that score targets ``1 .. length-1`` once each.

    A span reads inputs ``[start, end)`` and scores the last ``scored`` of its targets.
    """
    if window < step:
        raise ValueError("window must not be smaller than step")
    last = length - 1
    more = F.greatest(F.ceil((last - window) / step), F.lit(0)).cast("int")

    def end_of(i: Column) -> Column:
        return F.least(i * step + window, last)

    def span(i: Column) -> Column:
        end = end_of(i)
        gained = F.least(end - end_of(i - 1), F.lit(step))
        return F.struct(
            (i * step).cast("long").alias("start"),
            end.cast("long").alias("end"),
            F.when(i == 0, end).otherwise(gained).cast("long").alias("scored"),
        )

    return F.when(last >= 1, F.transform(F.sequence(F.lit(0), more), span)).otherwise(
        F.array().cast("array<struct<start:long,end:long,scored:long>>")
    )


def scoring_spans(docs: DataFrame, window: int = 512, step: int = 256) -> DataFrame:
    return docs.select("uid", F.inline(span_plan(F.size("input_ids"), window, step)))


def transitions(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``(uid, keep..., pos, prev, tok)`` for every target position, read off the array without a shuffle."""
    ids = F.col("input_ids")
    n = F.size(ids)
    zipped = F.arrays_zip(
        F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("prev"),
        F.slice(ids, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("tok"),
    )
    return docs.where(n > 1).select("uid", *keep, F.posexplode(zipped).alias("pos", "_t")).select(
        "uid", *keep, F.col("pos").cast("long").alias("pos"), "_t.prev", "_t.tok"
    )


def pair_counts(docs: DataFrame, part: str | None = None) -> DataFrame:
    """``prev, tok, [part,] n``: how often two tokens follow each other, counted by tasks for batches of documents; rows of a pair are still to be summed.

    The same pairs as those of ``transitions``; ``part``, a whole number per document, is kept apart.
    """
    keys = ["prev", "tok"] + ([part] if part else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("input_ids")
            size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            flat = ids.flatten()
            begins = np.zeros(len(flat) + 1, bool)
            begins[np.cumsum(size) - size] = True
            second = np.flatnonzero(~begins[: len(flat)])
            of = np.zeros(0, np.int64) if not part else np.repeat(np.arange(len(size)), size)[second]
            if flat.null_count or (part and batch.column(part).null_count):
                columns = {"prev": flat.take(pa.array(second - 1)), "tok": flat.take(pa.array(second))} | ({part: batch.column(part).take(pa.array(of))} if part else {})
                found = pa.table(columns).group_by(keys).aggregate([([], "count_all")]).rename_columns([*keys, "n"])
                yield from found.combine_chunks().to_batches()
                continue
            tokens = flat.to_numpy().astype(np.int64)
            pairs = tokens[second - 1] * (1 << 32) + (tokens[second] + (1 << 31))
            parts = batch.column(part).to_numpy()[of] if part else None
            for value in np.unique(parts) if part else [None]:
                pair, n = np.unique(pairs if value is None else pairs[parts == value], return_counts=True)
                columns = [pa.array(pair >> 32, pa.int32()), pa.array((pair & 0xFFFFFFFF) - (1 << 31), pa.int32())]
                columns += [pa.array(np.full(len(pair), value), pa.int32())] if part else []
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], [*keys, "n"])

    ids = F.col("input_ids").cast("array<int>").alias("input_ids")
    return docs.select(ids, *([part] if part else [])).mapInArrow(run, "prev int, tok int, " + (f"`{part}` int, " if part else "") + "n long")


# Checkpoints of the built-in scorer: fitted on nothing, on the first half of the corpus, on all of it.
NGRAM_STEPS = (0, 2000, 4000)


@dataclass
class NgramModel:
    """Counts of pairs and of first tokens, as arrays with one entry per checkpoint; ``k`` is added to every pair."""

    pairs: DataFrame  # prev, tok, pair_n
    firsts: DataFrame  # prev, prev_n
    vocab_size: int
    k: float
    steps: tuple[int, ...]


def fit_ngram(train: DataFrame, vocab_size: int, add_k: float = 1.0, steps: tuple[int, ...] = NGRAM_STEPS, part: Column | None = None) -> NgramModel:
    """Fit a bigram model on growing parts of a corpus, one per checkpoint.

    ``part`` numbers the checkpoint (from 1) at which a document is first seen; by default documents are dealt out by ``uid``. The first
    checkpoint has seen nothing, hence every token is equally likely.
    """
    later = len(steps) - 1
    first = part if part is not None else F.pmod("uid", F.lit(max(later, 1))) + 1
    seen = pair_counts(train.select("input_ids", first.cast("int").alias("_part")), "_part")
    counts = [F.sum(F.when(F.col("_part") <= j, F.col("n")).otherwise(0)) for j in range(later + 1)]
    pairs = stage(seen.groupBy("prev", "tok").agg(F.array(*counts).alias("pair_n")), "pairs")
    firsts = pairs.groupBy("prev").agg(F.array(*[F.sum(F.get("pair_n", F.lit(j))) for j in range(later + 1)]).alias("prev_n"))
    return NgramModel(pairs, stage(firsts, "firsts"), vocab_size, add_k, steps)


# Pairs of up to this many rows are shipped to every Python worker as packed numbers (32 bytes a pair at three checkpoints).
SHIPPED_PAIRS = 2_000_000


def score_ngram(docs: DataFrame, model: NgramModel, pad: int = PAD_ID, bound: int = SHIPPED_PAIRS) -> DataFrame:
    """Evaluations ``(uid, step, token_logprob, token_ids)`` of every document at every checkpoint.

    A pair the model has not seen gets the score of count zero; documents of fewer than two tokens get empty arrays. Scores of the padding id are
    0. Up to ``bound`` pairs are counted and shipped, and documents are scored where they lie. Beyond that blocks of documents ask for their
    different pairs (``operators/blocks.py``). Where documents repeat, or pairs hold missing or negative tokens, the positions meet the pairs in a join and
    their documents in a sort; the scores of all checkpoints travel together and hot pairs are split over tasks.
    """
    if model.pairs.count() <= bound:
        return _score_in_place(docs, model, pad)
    base = base_of([(model.pairs, ["prev", "tok"])])
    if base is None or repeats(docs):
        return _score_by_join(docs, model, pad)
    return _score_in_blocks(docs, model, pad, base)


def _logs(model: NgramModel):
    """The scores of pair counts and first counts at every checkpoint, and counts of nothing."""
    k, v = F.lit(float(model.k)), F.lit(float(model.vocab_size))
    zero = F.array(*[F.lit(0).cast("long")] * len(model.steps))
    return zero, lambda pair_n, prev_n: F.zip_with(pair_n, prev_n, lambda n, m: F.log((n + k) / (m + k * v)))


def _score_in_blocks(docs: DataFrame, model: NgramModel, pad: int, base: int) -> DataFrame:
    steps = list(model.steps)
    zero, logs = _logs(model)
    names = [f"s{j}" for j in range(len(steps))]
    known = join_groups(model.pairs, model.firsts, ["prev"], staged=True).withColumn("l", logs(F.col("pair_n"), F.col("prev_n")))
    known = stage(known.select("prev", "tok", *[F.get("l", F.lit(j)).alias(n) for j, n in enumerate(names)]), "scores")
    # One row per token of the vocabulary.
    unseen = model.firsts.select("prev", logs(zero, F.col("prev_n")).alias("l")).toArrow()
    never = docs.sparkSession.range(1).select(logs(zero, zero)).first()[0]
    otherwise = np.tile(np.array(never, float), (base, 1))
    otherwise[unseen["prev"].to_numpy()] = pc.list_flatten(unseen["l"]).to_numpy().reshape(-1, len(steps))
    shared = docs.sparkSession.sparkContext.broadcast(otherwise)

    def use(uid: pa.Array, block: Block, values: list) -> Iterator[pa.RecordBatch]:
        ends, found = values[0]
        for j, step in enumerate(steps):
            scores = np.zeros(len(block.codes))
            scores[ends] = np.where(np.isnan(found[:, j]), shared.value[block.codes[ends - 1], j], found[:, j])
            yield evaluated(uid, block, step, scores, pad)

    return looked_up(docs, [(known, ["prev", "tok"], names)], base, use, evaluations_schema(docs))


def _pair_keys(prev: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return prev.astype(np.int64) * (1 << 32) + tok.astype(np.int64)


def _tokens(values: pa.Array) -> np.ndarray:
    """Ids as numbers; a missing one is the smallest integer, here and in the pairs."""
    return pc.fill_null(values.cast(pa.int64()), -(1 << 31)).to_numpy(zero_copy_only=False)


def _score_in_place(docs: DataFrame, model: NgramModel, pad: int) -> DataFrame:
    steps = list(model.steps)
    k, v = F.lit(float(model.k)), F.lit(float(model.vocab_size))
    zero = F.array(*[F.lit(0).cast("long")] * len(steps))

    def logs(pair_n: Column, prev_n: Column) -> Column:
        return F.zip_with(pair_n, prev_n, lambda n, m: F.log((n + k) / (m + k * v))).alias("logprobs")

    # The pairs were counted before and fit the bound; there are fewer first tokens than pairs.
    firsts = F.broadcast(model.firsts.withColumnRenamed("prev", "_prev"))
    known = model.pairs.join(firsts, F.col("prev").eqNullSafe(F.col("_prev"))).select("prev", "tok", logs(F.col("pair_n"), F.col("prev_n"))).toArrow()
    unseen = model.firsts.select("prev", logs(zero, F.col("prev_n"))).toArrow()
    never = docs.sparkSession.range(1).select(logs(zero, zero)).first()[0]

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return pc.list_flatten(column).to_numpy().reshape(-1, len(steps))

    pair_keys, prev_keys = _pair_keys(*[_tokens(known[c].combine_chunks()) for c in ("prev", "tok")]), _tokens(unseen["prev"].combine_chunks())
    by_pair, by_prev = np.argsort(pair_keys), np.argsort(prev_keys)
    packed = pair_keys[by_pair], matrix(known["logprobs"])[by_pair], prev_keys[by_prev], matrix(unseen["logprobs"])[by_prev], np.array(never)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, pair_scores, prevs, prev_scores, otherwise = shared.value

        def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

        for batch in batches:
            uid, ids = batch.column("uid"), batch.column("input_ids")
            size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = ids.flatten()
            begin = np.cumsum(size) - size
            scored = np.where(pc.is_valid(uid).to_numpy(zero_copy_only=False), np.maximum(size - 1, 0), 0)  # a document without uid is not met
            ends = np.cumsum(scored)
            target = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - scored, scored) + np.repeat(begin, scored) + 1
            tokens = _tokens(flat)
            prev, tok = tokens[target - 1], tokens[target]
            at, hit = found(pairs, _pair_keys(prev, tok))
            first, seen = found(prevs, prev)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            targets = pa.ListArray.from_arrays(offsets, flat.take(pa.array(target)).cast(pa.int32()))
            for j, step in enumerate(steps):
                values = np.full(len(target), otherwise[j])
                values[seen] = prev_scores[first[seen], j]
                values[hit] = pair_scores[at[hit], j]
                values[tok == pad] = 0.0
                logprob = pa.ListArray.from_arrays(offsets, pa.array(values))
                yield pa.RecordBatch.from_arrays([uid.cast(pa.int64()), pa.array([step] * len(uid), pa.int64()), logprob, targets], ["uid", "step", "token_logprob", "token_ids"])

    return docs.select("uid", "input_ids").mapInArrow(run, "uid long, step long, token_logprob array<double>, token_ids array<int>")


def _score_by_join(docs: DataFrame, model: NgramModel, pad: int) -> DataFrame:
    steps, k, v = model.steps, F.lit(float(model.k)), F.lit(float(model.vocab_size))
    seen = join_groups(transitions(docs), model.pairs, ["prev", "tok"], "left", staged=True)
    seen = join_groups(seen, model.firsts, ["prev"], "left", staged=True)
    none = F.array(*[F.lit(0).cast("long")] * len(steps))
    scores = F.zip_with(F.coalesce("pair_n", none), F.coalesce("prev_n", none), lambda n, m: F.log((n + k) / (m + k * v)))
    rows = F.sort_array(F.collect_list(F.struct("pos", "tok", scores.alias("logprobs"))))
    per_doc = seen.groupBy("uid").agg(rows.alias("r"))
    every = docs.select("uid", F.posexplode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("_j", "step"))
    # Every token is in there, however small the files were that it came from: never a broadcast.
    every = every.join(per_doc.hint("merge"), "uid", "left")
    logprob = F.transform("r", lambda x: F.when(x["tok"] == pad, 0.0).otherwise(F.get(x["logprobs"], F.col("_j"))))
    return every.select(
        "uid", "step",
        F.coalesce(logprob, F.array().cast("array<double>")).alias("token_logprob"),
        F.coalesce(F.col("r.tok"), F.array().cast("array<int>")).alias("token_ids"),
    )


def evaluate(
    docs: DataFrame, model: Callable[[np.ndarray, np.ndarray], np.ndarray], budget: int, window: int = 512, step: int = 256, at_step: int = 0, pad: int = PAD_ID
) -> DataFrame:
    """Score documents with a user model the way a padded evaluation run does: ``uid, step, token_logprob, token_ids`` without padding.

    Documents are packed into batches under a token budget and padded; every batch is read in context spans of ``window`` tokens that move by
    ``step``, and each target is scored once. ``model(inputs, targets)`` gets two arrays of documents by positions and returns the log probability of
    every target. Documents of fewer than two tokens get empty arrays. A batch is bounded by its budget, so it is one group.
    """
    packed = stage(pack_batches(docs, budget), "packed")
    padded = collate(docs.select("uid", "input_ids"), packed, pad).join(packed.select("uid", "len"), "uid")
    spans = F.col("spans")
    planned = padded.withColumn("spans", span_plan(F.col("batch_len"), window, step)).select(
        "batch_id", "uid", "len", "input_ids", *[spans.getField(c).alias(c) for c in ("start", "end", "scored")]
    )

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        ids = np.stack(batch["input_ids"].to_list()).astype(np.int64)
        targets = ids[:, 1:]
        out = np.zeros(targets.shape)
        for start, end, scored in zip(batch["start"].iloc[0], batch["end"].iloc[0], batch["scored"].iloc[0]):
            got = model(ids[:, start:end], targets[:, start:end])
            out[:, end - scored : end] = got[:, end - start - scored :]
        own = [max(n - 1, 0) for n in batch["len"]]
        return pd.DataFrame({
            "uid": batch["uid"], "step": at_step,
            "token_logprob": [row[len(row) - n :] for row, n in zip(out, own)],
            "token_ids": [row[len(row) - n :] for row, n in zip(targets, own)],
        })

    return planned.groupBy("batch_id").applyInPandas(run, "uid long, step long, token_logprob array<double>, token_ids array<int>")


def score_spans(
    docs: DataFrame, load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], window: int = 512, step: int = 256, batch_size: int = 64, at_step: int = 0, pad: int = PAD_ID
) -> DataFrame:
    """Score documents with a model that every Python worker loads once: ``uid, step, token_logprob, token_ids``.

    ``load()`` returns ``model(inputs, targets)``, which gets two arrays of ``batch_size`` spans (the last batch of a partition may be
    smaller) by ``window`` tokens, padded on the left, and returns the log probability of every target. Documents are cut into context
    spans and each target is scored once (``span_plan``). Spans are independent rows, so batches are filled whatever the
    documents' lengths; only scores meet again by ``uid``. Documents of fewer than two tokens get empty arrays.
    """

    def make_predict() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        model = load()
        return lambda inputs, targets: np.asarray(model(inputs.astype(np.int64), targets.astype(np.int64)), dtype=np.float64)

    shape = [window]
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[shape, shape])
    spans = docs.select("uid", "input_ids", F.inline(span_plan(F.size("input_ids"), window, step)))
    size, first = (F.col("end") - F.col("start")).cast("int"), F.col("start").cast("int")
    tokens = lambda at: left_pad(F.slice("input_ids", at, size), F.lit(window), F.lit(pad))
    rows = spans.select("uid", "start", F.col("scored").cast("int").alias("scored"), tokens(first + 1).alias("inputs"), tokens(first + 2).alias("targets"))
    scored = rows.withColumn("logprob", predict("inputs", "targets"))
    last = lambda c: F.slice(c, F.lit(window) - F.col("scored") + 1, F.col("scored"))
    parts = scored.select("uid", F.struct("start", last(F.col("logprob")).alias("logprob"), last(F.col("targets")).alias("ids")).alias("s"))
    per_doc = parts.groupBy("uid").agg(F.sort_array(F.collect_list("s")).alias("s"))
    joined = docs.select("uid").join(per_doc.hint("merge"), "uid", "left")
    return joined.select(
        "uid",
        F.lit(at_step).cast("long").alias("step"),
        F.coalesce(F.flatten("s.logprob"), F.array().cast("array<double>")).alias("token_logprob"),
        F.coalesce(F.flatten("s.ids"), F.array().cast("array<int>")).alias("token_ids"),
    )


def score(docs: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Score with a user model: batches of ``(uid, input_ids)`` in, ``(uid, step, token_logprob, token_ids)`` out."""
    schema = "uid long, step long, token_logprob array<double>, token_ids array<int>"
    return map_batches(docs.select("uid", "input_ids"), model, schema)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Batched map with a declared output schema."""
    return df.mapInPandas(fn, schema)
