"""Alignment of scores with documents, and imputation of items above the cutoff from their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankcut.functions.arrays import explode_together, keep_last
from rankcut.operators.filters import cutoff_window
from rankcut.operators.ordering import join_groups, neighbours
from rankcut.operators.quality import require

# A merges table within this bound (three longs a row) is safe to ship to every executor.
BROADCAST_ROWS = 2_000_000


def merges_window(log: DataFrame, cutoff: int, half_width: int) -> DataFrame:
    """Merges log -> ``(tok, tok_a, tok_b)`` around the cutoff."""
    flat = log.select(
        F.col("new_token_id").cast("long").alias("tok"),
        F.get("pair", F.lit(0)).cast("long").alias("tok_a"),
        F.get("pair", F.lit(1)).cast("long").alias("tok_b"),
    )
    return cutoff_window(flat, "tok", cutoff, half_width)


def component_audit(merges: DataFrame, cutoff: int) -> DataFrame:
    """``(tok, tok_new)``: items below the cutoff that are a part of another merge in the window."""
    inside = merges.where(F.col("tok") < cutoff).select("tok")
    parts = [
        inside.join(merges.select(F.col(part).alias("tok"), F.col("tok").alias("tok_new")), "tok")
        for part in ("tok_a", "tok_b")
    ]
    return parts[0].unionByName(parts[1])


def drop_components(merges: DataFrame, cutoff: int) -> DataFrame:
    return merges.join(component_audit(merges, cutoff).select("tok").distinct(), "tok", "left_anti")


def imputed_merges(merges: DataFrame, cutoff: int, exclude_components: bool = False) -> DataFrame:
    """Merges at or above the cutoff; a pair that occurs twice fails, since it would double rows."""
    kept = drop_components(merges, cutoff) if exclude_components else merges
    oov = kept.where(F.col("tok") >= cutoff)
    return (
        oov.groupBy("tok_a", "tok_b")
        .agg(F.min("tok").alias("tok"), F.count("*").alias("_n"))
        .select(
            "tok_a",
            "tok_b",
            F.when(F.col("_n") == 1, F.col("tok")).otherwise(F.raise_error(F.lit("pair occurs twice")).cast("long")).alias("tok"),
        )
    )


def window_sized(merges: DataFrame, half_width: int) -> DataFrame:
    """Broadcast hint for a merges window: at most ``2 * half_width`` rows, checked against the bound."""
    return F.broadcast(merges) if 2 * half_width <= BROADCAST_ROWS else merges


def score_offset(evals: DataFrame, docs: DataFrame) -> DataFrame:
    """Evaluations with ``offset`` = the shorter of score count and document length (if it is known)."""
    lengths = docs.select("uid", F.size("input_ids").alias("len"))
    return evals.join(lengths, "uid", "left").withColumn("offset", F.least(F.size("token_logprob"), F.col("len"))).drop("len")


def trim_evals(evals: DataFrame, docs: DataFrame) -> DataFrame:
    """Keep the tail of both score arrays that the document also covers."""
    return (
        score_offset(evals, docs)
        .withColumn("token_logprob", keep_last(F.col("token_logprob"), F.col("offset")))
        .withColumn("token_ids", keep_last(F.col("token_ids"), F.col("offset")))
    )


def trim_docs(docs: DataFrame, evals: DataFrame, base_step: int = 0) -> DataFrame:
    """Keep the tail of each document that the evaluation of ``base_step`` also covers."""
    scored = evals.where(F.col("step") == base_step).select("uid", F.size("token_logprob").alias("_scored"))
    return (
        docs.join(scored, "uid", "left")
        .withColumn("input_ids", keep_last(F.col("input_ids"), F.least(F.size("input_ids"), F.col("_scored"))))
        .drop("_scored")
    )


def token_rows(docs: DataFrame) -> DataFrame:
    """Document arrays -> ``(uid, pos, tok)``."""
    return explode_together(docs.select("uid", "input_ids"), ["input_ids"], "pos").select(
        "uid", "pos", F.col("input_ids").cast("long").alias("tok")
    )


def token_rows_with_neighbours(docs: DataFrame) -> DataFrame:
    """Document arrays -> ``(uid, pos, tok, prev, next)``, read off the array, hence without a shuffle."""
    ids = F.col("input_ids")
    zipped = F.arrays_zip(
        ids.alias("tok"),
        F.slice(F.concat(F.array(F.lit(None).cast("int")), ids), F.lit(1), F.size(ids)).alias("prev"),
        F.concat(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), F.array(F.lit(None).cast("int"))).alias("next"),
    )
    return (
        docs.where(F.size(ids) > 0)
        .select("uid", F.posexplode(zipped).alias("pos", "_t"))
        .select(
            "uid",
            F.col("pos").cast("long").alias("pos"),
            *[F.col("_t").getField(c).cast("long").alias(c) for c in ("tok", "prev", "next")],
        )
    )


def tag_rows(stream: DataFrame, merges: DataFrame) -> DataFrame:
    """``(uid, pos, tok, prev, next)`` -> ``(uid, og_pos, og_tok, tok, pos)``.

    Both rows of a pair found in ``merges`` take the pair's id; the second row also takes the position
    of the first. Where pairs overlap, a row's own pair (as first part) decides the id.
    """
    return _with_pair_ids(stream, merges).select(
        "uid",
        F.col("pos").alias("og_pos"),
        F.col("tok").alias("og_tok"),
        F.coalesce("_as_first", "_as_second", "tok").alias("tok"),
        F.when(F.col("_as_second").isNotNull(), F.col("pos") - 1).otherwise(F.col("pos")).alias("pos"),
    )


def _with_pair_ids(stream: DataFrame, merges: DataFrame) -> DataFrame:
    """``(uid, pos, tok, prev, next)`` with the id of the pair a row begins (``_as_first``) and of the one it ends (``_as_second``)."""
    first = merges.select(F.col("tok_a").alias("tok"), F.col("tok_b").alias("next"), F.col("tok").alias("_as_first"))
    second = merges.select(F.col("tok_a").alias("prev"), F.col("tok_b").alias("tok"), F.col("tok").alias("_as_second"))
    return stream.join(first, ["tok", "next"], "left").join(second, ["prev", "tok"], "left")


def _carried(rows: DataFrame, block: int) -> DataFrame:
    """``uid, _block, _carry``: pairs that follow each other up to the start of a block, for blocks that a chain runs into.

    A block hands on the length of the chain at its end. Where the chain began in the block, that is known from the block
    alone; where it spans the block, the length that came in is added. So only the last rows of blocks are composed.
    """
    ends = rows.where((F.col("pos") % block == block - 1) & F.col("_as_first").isNotNull())
    ends = ends.select("uid", "_block", (F.col("pos") - F.col("_start") + 1).alias("_own"))
    w = W.partitionBy("uid").orderBy("_block")
    latest = F.last(F.when(F.col("_own").isNotNull(), F.struct(F.col("_block").alias("at"), F.col("_own").alias("n"))), ignorenulls=True).over(w)
    # A chain that spans blocks has a last row in every one of them, back to where it began.
    length = F.when(latest.isNotNull(), latest["n"] + (F.col("_block") - latest["at"]) * block)
    return ends.select("uid", (F.col("_block") + 1).alias("_block"), length.alias("_carry")).where(F.col("_carry") % 2 == 1)


def tag_rows_greedy(stream: DataFrame, merges: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``tag_rows``, but pairs are taken from the left and never overlap: ``A A A`` with (A, A) is one pair and one ``A``.

    Within a chain of pairs that each begin in the middle of the one before, every other pair is taken, from the first on. How
    far a row is from the start of its chain is found in blocks of ``block`` positions; a chain that crosses into a
    block brings its length along (``_carried``), so that a document of any length is spread over tasks. Rows that no pair touches take
    no part in that.
    """
    marked = _with_pair_ids(stream, merges)
    touched = F.col("_as_first").isNotNull() | F.col("_as_second").isNotNull()
    columns = ["uid", F.col("pos").alias("og_pos"), F.col("tok").alias("og_tok"), "tok", "pos"]
    plain = marked.where(~touched).select(*columns)
    rows = marked.where(touched).withColumn("_block", F.floor(F.col("pos") / block))
    so_far = W.partitionBy("uid", "_block").orderBy("pos")
    # Position where the present chain began; NULL if that was before the block.
    rows = rows.withColumn("_start", F.max(F.when(F.col("_as_second").isNull(), F.col("pos"))).over(so_far))
    rows = join_groups(rows, _carried(rows, block), ["uid", "_block"], "left")
    before = F.col("pos") - F.coalesce("_start", F.col("_block") * block - F.coalesce("_carry", F.lit(0)))
    odd = before % 2 == 1  # an odd number of pairs before: the last of them is taken, and this row is its second part
    taken = F.when(odd, F.col("_as_second")).otherwise(F.col("_as_first"))
    return rows.select(
        "uid",
        F.col("pos").alias("og_pos"),
        F.col("tok").alias("og_tok"),
        F.coalesce(taken, "tok").alias("tok"),
        (F.col("pos") - odd.cast("int")).alias("pos"),
    ).unionByName(plain)


def tag_pairs(stream: DataFrame, merges: DataFrame, block: int = 1 << 16, overlap: str = "independent") -> DataFrame:
    """``tag_rows``, or with ``overlap="greedy"`` ``tag_rows_greedy``, for a stream of plain ``(uid, pos, tok)`` rows."""
    rows = neighbours(stream, ["uid"], "pos", "tok", block)
    if overlap not in ("independent", "greedy"):
        raise ValueError(f"overlap is 'independent' or 'greedy', not {overlap!r}")
    return tag_rows_greedy(rows, merges, block) if overlap == "greedy" else tag_rows(rows, merges)


def impute_scores(evals: DataFrame, tagged: DataFrame, strict: bool = False) -> DataFrame:
    """Scores of tagged positions: ``(step, uid, tok, pos, og_tok, og_pos, logprob)``.

    ``evals`` carry the ``offset`` of ``score_offset`` (or of ``trim_evals``); without it, arrays count from their start.
    The tagged positions are packed per document and meet the score arrays in one join by ``uid``. Each score is read
    by its position before the end, so no array is sliced and only tagged positions are ever exploded, not every
    token of every step. A position counts only where document and evaluation agree on the token; ``strict`` fails the query
    where they do not.
    """
    hits = tagged.groupBy("uid").agg(F.collect_list(F.struct("og_pos", "og_tok", "tok", "pos")).alias("hits"))
    size = F.size("token_logprob")
    shift = size - F.coalesce(F.least(F.col("offset"), size), size) if "offset" in evals.columns else F.lit(0)
    at = (F.col("hit.og_pos") + F.col("_shift")).cast("int")
    met = (
        evals.withColumn("_shift", shift)
        .join(hits, "uid")
        .select("uid", "step", "token_logprob", "token_ids", "_shift", F.explode("hits").alias("hit"))
    )
    agree = F.get("token_ids", at).eqNullSafe(F.col("hit.og_tok"))
    met = require(met, agree, "a tagged token has no score, or that of another token") if strict else met.where(agree)
    return (
        met.select(
            "step",
            "uid",
            F.col("hit.tok").alias("tok"),
            F.col("hit.pos").alias("pos"),
            F.col("hit.og_tok").alias("og_tok"),
            F.col("hit.og_pos").alias("og_pos"),
            F.get("token_logprob", at).cast("double").alias("logprob"),
        )
    )


def treated(col: str, cutoff: int) -> Column:
    return F.col(col) < cutoff
