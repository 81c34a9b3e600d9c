"""An n-gram scorer with interpolated back-off to shorter contexts (absolute discounting).

A table per order holds the n-grams that were seen, each with the log probability of its last token after the others, and
the log weight that the n-gram gives, as a context, to the next lower order. A token is found in the longest
context seen; the weights of contexts it was not found in come from the tables of the orders below.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.operators.blocks import Block, base_of, evaluated, evaluations_schema, looked_up, repeats
from rankcut.operators.ordering import join_groups
from rankcut.operators.scoring import PAD_ID
from rankcut.session import stage

DISCOUNT = 0.75

# Different tokens whose own scores are shipped to every task.
SHIPPED_TOKENS = 2_000_000


@dataclass
class BackoffModel:
    """``orders[k]``: ``w0..wk, logp, weight`` of the seen (k+1)-grams. ``unseen``: log probability of a token never seen."""

    orders: list[DataFrame]
    unseen: float


def _grams(docs: DataFrame, order: int, keep: list[str] = ()) -> DataFrame:
    """Every position with its token and the ``order - 1`` before it: ``uid, keep..., pos, w0..``, the token last, read off the array.

    ``w{order-1}`` is the token; earlier ones are NULL at the start of a document.
    """
    ids = F.col("input_ids")
    none = F.array(F.lit(None).cast("int"))
    parts = []
    for k in range(order):
        back = order - 1 - k
        shifted = F.slice(F.concat(*[none] * back, ids), F.lit(1), F.size(ids)) if back else ids
        parts.append(shifted.alias(f"w{k}"))
    rows = docs.where(F.size(ids) > 0).select("uid", *keep, F.posexplode(F.arrays_zip(*parts)).alias("pos", "_w"))
    return rows.select("uid", *keep, F.col("pos").cast("long").alias("pos"), *[F.col(f"_w.w{k}").alias(f"w{k}") for k in range(order)])


def _gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """``w0.., c``: the rows of ``_grams``, counted by tasks for batches of documents; rows of an n-gram are still to be summed."""
    names = [f"w{k}" for k in range(order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("input_ids")
            size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = ids.flatten().dictionary_encode()
            many = len(coded.dictionary)  # stands for no token
            codes = pc.fill_null(coded.indices, many).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
            key, distinct = np.zeros(len(codes), np.int64), []
            for k in range(order):
                back = order - 1 - k
                word = np.where(at >= back, codes[np.maximum(np.arange(len(codes)) - back, 0)], many)
                key = key * (many + 1) + word
                if (many + 1) ** (k + 2) >= 1 << 62 or k == order - 1:  # too many for a plain number: n-grams so far are numbered anew
                    found, key = np.unique(key, return_inverse=True)
                    distinct.append((k, found))
                    if k < order - 1 and len(found) * (many + 1) >= 1 << 62:
                        raise ValueError("too many different tokens in a batch")
            count = np.bincount(key, minlength=len(distinct[-1][1]))
            words: dict[int, np.ndarray] = {}
            rest = np.arange(len(distinct[-1][1]))
            for i in range(len(distinct) - 1, -1, -1):
                low = distinct[i - 1][0] + 1 if i else 0
                rest = distinct[i][1][rest]
                for k in range(distinct[i][0], low - 1, -1):
                    words[k] = rest % (many + 1)
                    rest = rest // (many + 1)
            table = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)]).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*[table.take(pa.array(words[k])) for k in range(order)], pa.array(count, pa.int64())], [*names, "c"])

    return docs.select("input_ids").mapInArrow(run, ", ".join(f"{w} int" for w in names) + ", c long")


def fit_backoff(train: DataFrame, vocab_size: int, order: int = 3, discount: float = DISCOUNT) -> BackoffModel:
    """Count all n-grams up to ``order`` in ``(uid, input_ids)`` and interpolate from the shortest context up.

    P(w | h) = max(c(hw) - d, 0) / c(h) + d t(h) / c(h) P(w | h'), where t(h) is the number of different tokens seen after h and h' is h
    without its first token; the last step is the uniform distribution over ``vocab_size`` tokens. Contexts do not cross documents.
    """
    if not 0 < discount < 1 or order < 1:
        raise ValueError("the discount lies between 0 and 1, the order is 1 at least")
    # Counted once: shorter n-grams are the ends of longer ones, which begin with NULL at the start of a document.
    ends = [f"w{k}" for k in range(order)]
    counted = stage(_gram_counts(train, order).groupBy(*ends).agg(F.sum("c").alias("c")), "counts")
    tables: list[DataFrame] = []
    unseen = 0.0
    for n in range(1, order + 1):
        words = [f"w{k}" for k in range(n)]
        own = [F.col(f"w{order - n + k}").alias(w) for k, w in enumerate(words)]
        counts = counted.select(*own, "c").where(F.col("w0").isNotNull())
        counts = counts if n == order else counts.groupBy(*words).agg(F.sum("c").alias("c"))
        if n == 1:
            total, types = counts.agg(F.sum("c"), F.count("*")).first()
            rest = discount * types / total if total else 1.0
            seen = counts.withColumn("p", (F.col("c") - F.lit(discount)) / F.lit(float(total or 1)) + F.lit(rest / vocab_size))
            unseen = rest / vocab_size
        else:
            context = words[:-1]
            contexts = stage(counts.groupBy(*context).agg(F.sum("c").alias("total"), F.count("*").alias("types")), "contexts")
            share = F.lit(discount) * F.col("types") / F.col("total")
            shorter = tables[-1].select(*[F.col(f"w{k}").alias(f"w{k + 1}") for k in range(n - 1)], F.exp("logp").alias("lower"))
            # A hot context, or a hot ending, is spread over tasks.
            seen = join_groups(join_groups(counts, contexts, context, staged=True), shorter, words[1:])
            seen = seen.withColumn("p", (F.col("c") - F.lit(discount)) / F.col("total") + share * F.col("lower"))
            # Now the contexts are known, the weights of the order below can be told.
            weights = contexts.select(*context, F.log(share).alias("weight"))
            below = join_groups(tables[-1], weights, context, "left", staged=False)
            tables[-1] = stage(below.select(*context, "logp", F.coalesce("weight", F.lit(0.0)).alias("weight")), "grams")
        tables.append(stage(seen.select(*words, F.log("p").alias("logp")), "grams"))
    tables[-1] = tables[-1].withColumn("weight", F.lit(0.0))
    return BackoffModel(tables, math.log(unseen))


def score_backoff(docs: DataFrame, model: BackoffModel, step: int = 0, pad: int = PAD_ID) -> DataFrame:
    """Evaluations ``(uid, step, token_logprob, token_ids)``: every target after all tokens before it, as far as the order reaches.

    Blocks of documents ask for their different n-grams (``operators/blocks.py``). Where documents repeat, or n-grams hold missing or negative tokens, there is a
    join per order with the n-grams, and one with the contexts below. Scores of the padding id are 0; documents of fewer than two tokens get empty arrays.
    """
    words = [[f"w{k}" for k in range(n + 1)] for n in range(len(model.orders))]
    base = base_of(list(zip(model.orders, words, strict=True)))
    if base is None or base > SHIPPED_TOKENS or repeats(docs):
        return _score_by_join(docs, model, step, pad)
    return _score_in_blocks(docs, model, step, pad, base)


def _score_in_blocks(docs: DataFrame, model: BackoffModel, step: int, pad: int, base: int) -> DataFrame:
    order = len(model.orders)
    single = model.orders[0].select("w0", "logp", "weight").toArrow()  # one row per token of the vocabulary
    alone = np.tile([model.unseen, 0.0], (base, 1))
    alone[single["w0"].to_numpy()] = np.stack([single[c].to_numpy() for c in ("logp", "weight")], axis=1)
    shared = docs.sparkSession.sparkContext.broadcast(alone)

    def use(uid: pa.Array, block: Block, values: list) -> Iterator[pa.RecordBatch]:
        first = shared.value[block.codes]
        out, weight = first[:, 0], first[:, 1]  # the weight of the n-gram that ends at a token
        for ends, found in values:
            passed = np.append(0.0, weight[:-1])  # of the context that ends before it
            passed[block.at == 0] = 0.0
            longer = passed + out
            longer[ends] = np.where(np.isnan(found[:, 0]), longer[ends], found[:, 0])
            out, weight = longer, np.zeros(len(out))
            weight[ends] = np.where(np.isnan(found[:, 1]), 0.0, found[:, 1])
        yield evaluated(uid, block, step, out, pad)

    tables = [(model.orders[n], [f"w{k}" for k in range(n + 1)], ["logp", "weight"]) for n in range(1, order)]
    if not tables:
        return _score_by_join(docs, model, step, pad)
    return looked_up(docs, tables, base, use, evaluations_schema(docs))


def _score_by_join(docs: DataFrame, model: BackoffModel, step: int, pad: int) -> DataFrame:
    order = len(model.orders)
    rows = _grams(docs, order).where(F.col("pos") > 0)
    for n, table in enumerate(model.orders, 1):
        names = [f"w{order - n + k}" for k in range(n)]
        known = table.select(*[F.col(f"w{k}").alias(w) for k, w in enumerate(names)], F.col("logp").alias(f"logp{n}"))
        rows = join_groups(rows, known, names, "left", staged=True)
        if n > 1:  # the context of a token is the n-gram that ends before it
            context = model.orders[n - 2].select(*[F.col(f"w{k}").alias(w) for k, w in enumerate(names[:-1])], F.col("weight").alias(f"weight{n - 1}"))
            rows = join_groups(rows, context, names[:-1], "left", staged=True)
    tok = F.col(f"w{order - 1}")
    out = F.coalesce("logp1", F.lit(model.unseen))
    for n in range(2, order + 1):
        out = F.coalesce(f"logp{n}", F.coalesce(f"weight{n - 1}", F.lit(0.0)) + out)
    out = F.when(tok == pad, 0.0).otherwise(out)
    per_doc = rows.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", tok.alias("tok"), out.alias("logprob")))).alias("r"))
    # Every token is in there, however small the files were that it came from: never a broadcast.
    every = docs.select("uid").join(per_doc.hint("merge"), "uid", "left")
    return every.select(
        "uid",
        F.lit(step).cast("long").alias("step"),
        F.coalesce("r.logprob", F.array().cast("array<double>")).alias("token_logprob"),
        F.coalesce("r.tok", F.array().cast("array<int>")).alias("token_ids"),
    )
