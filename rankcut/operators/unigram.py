"""Learning a unigram-LM vocabulary by expectation maximisation and pruning.

Pieces and their scores are a staged table from the seeds to the last cut. The lattices ship them as vectors, bounded by the number of seeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankcut.operators.lattice import Block, Lattice, build_lattice, over_parts
from rankcut.operators.ordering import join_groups, row_index, top_k
from rankcut.operators.suffixes import repeated_substrings
from rankcut.operators.vocab import EOS_TOKEN, UNK_TOKEN, Learned, byte_alphabet, to_byte_chars
from rankcut.session import stage, unstage

# Defaults of the usual unigram trainer.
MAX_PIECE_CHARS = 16
SEED_SIZE = 1_000_000
SHRINKING_FACTOR = 0.75
SUB_ITERATIONS = 2
MIN_EXPECTED = 0.5
# Pruning stops at this multiple of the wanted size; the last cut takes the best by score.
OVERSIZE = 1.1

SPECIALS = [UNK_TOKEN, EOS_TOKEN]


@dataclass
class Unigram:
    """A learned vocabulary: ``pieces`` (``id, piece, logprob``; specials first, then best first) and the log-likelihood of every EM step."""

    pieces: DataFrame
    history: list[float]

    def learned(self) -> Learned:
        """The vocabulary as a list, bounded by its size, for encoding."""
        rows = sorted(self.pieces.collect())
        return Learned([r["piece"] for r in rows], scores=[r["logprob"] for r in rows])


def seed_pieces(words: DataFrame, seed_size: int = SEED_SIZE, max_chars: int = MAX_PIECE_CHARS) -> DataFrame:
    """``(piece, score, single)``: every byte, and the repeated substrings that cover the most characters of distinct words.

    ``words``: distinct ``w`` with their counts ``n``. Bytes count by ``n``, once at least.
    """
    longer = repeated_substrings(words, max_chars).select("piece", (F.col("n") * F.length("piece")).alias("score"), F.lit(False).alias("single"))
    longer = top_k(longer, [F.desc("score"), F.asc("piece")], seed_size)
    chars = words.select(F.explode(F.split("w", "")).alias("piece"), "n").where("piece <> ''").groupBy("piece").agg(F.sum("n").alias("score"))
    alphabet = words.sparkSession.createDataFrame([(c,) for c in byte_alphabet()], "piece string")
    single = alphabet.join(chars, "piece", "left").select("piece", F.coalesce("score", F.lit(1)).alias("score"), F.lit(True).alias("single"))
    return single.unionByName(longer)


def expected_counts(lattice: Lattice, scores: DataFrame) -> DataFrame:
    """``(piece, expected)`` over all words; the row of the empty piece holds the log-likelihood."""

    def count(blocks: Iterator[Block], names: pa.Array) -> Iterator[pa.RecordBatch]:
        use, loglik = np.zeros(len(names)), 0.0
        for block in blocks:
            loglik += block.expected(use)
        yield _named(names, use, [("", loglik)])

    return over_parts(lattice, scores, count, "piece string, c double").groupBy("piece").agg(F.sum("c").alias("expected"))


def viterbi_counts(lattice: Lattice, scores: DataFrame) -> DataFrame:
    """``(piece, n)``: use of each piece in the best segmentations of all words."""

    def count(blocks: Iterator[Block], names: pa.Array) -> Iterator[pa.RecordBatch]:
        use = np.zeros(len(names), np.int64)
        for block in blocks:
            for words, edges in block.best():
                np.add.at(use, block.piece[edges], block.weights[words])
        yield _named(names, use, [])

    return over_parts(lattice, scores, count, "piece string, c long").groupBy("piece").agg(F.sum("c").alias("n"))


def _named(names: pa.Array, use: np.ndarray, more: list[tuple]) -> pa.RecordBatch:
    """``piece, c`` of the pieces with any use, and of ``more`` of them."""
    used = np.flatnonzero(use)
    pieces = pa.concat_arrays([names.take(pa.array(used)), pa.array([p for p, _ in more], pa.string())])
    return pa.RecordBatch.from_arrays([pieces, pa.array(np.append(use[used], np.array([c for _, c in more], use.dtype)))], names=["piece", "c"])


def replacements(lattice: Lattice, scores: DataFrame) -> DataFrame:
    """``(piece, own, instead)`` for a lattice of pieces: whether a piece is its own best path, and the best path without it (NULL: none)."""

    def paths(blocks: Iterator[Block], names: pa.Array) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            own = [False] * len(block.sizes)
            spelled: list[list[str]] = [[] for _ in own]
            instead: list[list[str]] = [[] for _ in own]
            for target, path in ((spelled, block.best()), (instead, block.best(whole=False))):
                for words, edges in path:
                    for k, piece in zip(words.tolist(), names.take(pa.array(block.piece[edges])).to_pylist()):
                        target[k].append(piece)
            for k, parts in enumerate(spelled):
                own[k] = len(parts) == 1
            whole = ["".join(reversed(p)) for p in spelled]
            columns = [pa.array(whole, pa.string()), pa.array(own, pa.bool_()), pa.array([p or None for p in instead], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "own", "instead"])

    return over_parts(lattice, scores, paths, "piece string, own boolean, instead array<string>")


def piece_losses(pieces: DataFrame, used: DataFrame, replaced: DataFrame, n_words: int) -> DataFrame:
    """``(piece, loss)``: the likelihood lost when a piece goes, against its best replacement by other pieces.

    Infinite for a piece that has no replacement or that is used without being its own best segmentation; other pieces
    that no word uses are left out.
    """
    total = used.agg(F.sum("n")).first()[0] or 1
    present = pieces.where(~F.col("single")).select("piece").join(used, "piece", "left").fillna(0, ["n"])
    rows = stage(present.join(replaced, "piece"), "replaced")
    parts = rows.where(F.col("own") & (F.col("n") > 0)).select("piece", "n", F.explode("instead").alias("part"))
    parts = join_groups(parts, used.select(F.col("piece").alias("part"), F.col("n").alias("others")), ["part"], "left")
    other = parts.groupBy("piece").agg(F.sum(F.log(F.coalesce("others", F.lit(0)) + F.col("n"))).alias("logs"))
    n, size = F.col("n"), F.size("instead")
    grown = n / n_words * (F.log(n) - F.log(F.lit(total)) - (F.col("logs") - size * F.log(total + n * (size - 1))))
    endless = F.lit(float("inf"))
    loss = F.when(~F.col("own"), F.when(n > 0, endless)).when(F.col("instead").isNull(), endless).when(n > 0, grown)
    return rows.join(other, "piece", "left").select("piece", loss.alias("loss")).where(F.col("loss").isNotNull())


def _digamma(x: Column) -> Column:
    """By the asymptotic series, after moving the argument to 7 or more."""
    shift, moved = F.lit(0.0), x
    for k in range(7):
        shift = shift - F.when(x + k < 7, 1.0 / (x + k)).otherwise(0.0)
        moved = F.when(x + k < 7, x + (k + 1)).otherwise(moved)
    x = moved - 0.5
    sq = 1.0 / (x * x)
    return shift + F.log(x) + sq * (1.0 / 24.0 - sq * (7.0 / 960.0 - sq * 31.0 / 8064.0))


def normalised(pieces: DataFrame, expected: DataFrame) -> DataFrame:
    """New scores from expected counts; rare pieces go, single bytes always stay."""
    counted = pieces.select("piece", "single").join(expected, "piece", "left").fillna(0.0, ["expected"])
    kept = counted.where(F.col("single") | (F.col("expected") >= MIN_EXPECTED)).select("piece", "single", F.greatest("expected", F.lit(MIN_EXPECTED)).alias("c"))
    kept = stage(kept, "kept")
    total = kept.agg(F.sum("c").alias("c")).select(_digamma(F.col("c"))).first()[0]
    return kept.select("piece", "single", (_digamma(F.col("c")) - total).alias("logprob"))


def pruned(pieces: DataFrame, losses: DataFrame, size: int) -> DataFrame:
    """Keep single bytes and the pieces with the largest losses; infinite losses stay whatever the size."""
    losses = stage(losses, "losses")
    needed = losses.where(F.col("loss") == float("inf")).select("piece")
    room = size - pieces.where("single").count() - needed.count()
    ranked = top_k(losses.where(F.col("loss") < float("inf")), [F.desc("loss"), F.asc("piece")], max(room, 0)).select("piece")
    return pieces.join(needed.unionByName(ranked), "piece", "left_semi").unionByName(pieces.where("single"))


def learn_unigram(
    counts: DataFrame,
    vocab_size: int,
    seed_size: int = SEED_SIZE,
    shrinking_factor: float = SHRINKING_FACTOR,
    sub_iterations: int = SUB_ITERATIONS,
    max_chars: int = MAX_PIECE_CHARS,
) -> Unigram:
    """Pieces with log-probabilities, best first, specials in front.

    ``counts`` is ``(word, n)``. Seeds are the repeated substrings of the words. Each round re-estimates the scores by
    expected counts, then prunes pieces by their loss until few enough are left. Words and pieces are segmented over lattices
    in parts; these are built anew once half of the pieces are gone.
    """
    words = stage(counts.select(to_byte_chars(F.col("word")).alias("w"), "n"), "unigram_words")
    n_words = words.agg(F.sum("n")).first()[0] or 1
    wanted = max(vocab_size - len(SPECIALS), len(byte_alphabet()))
    seeds = stage(seed_pieces(words, seed_size, max_chars), "seeds")
    scale = seeds.agg(F.log(F.sum("score"))).first()[0]
    pieces = seeds.select("piece", "single", (F.log("score") - scale).alias("logprob"))
    size, built = seeds.count(), 0
    over_words = over_pieces = None
    history: list[float] = []
    while True:
        if over_words is None or 2 * size <= built:
            for old in (over_words, over_pieces):
                if old is not None:
                    old.drop()
            over_words = build_lattice(words, pieces, max_chars)
            longer = pieces.where(~F.col("single")).select(F.col("piece").alias("w"), F.lit(1).cast("long").alias("n"))
            over_pieces, built = build_lattice(longer, pieces, max_chars), size
        for _ in range(sub_iterations):
            expected = stage(expected_counts(over_words, pieces), "expected")
            history.append(expected.where("piece = ''").agg(F.sum("expected")).first()[0] or 0.0)
            pieces = stage(normalised(pieces, expected), "pieces")
            unstage(expected)
        size = pieces.count()
        if size <= OVERSIZE * wanted:
            break
        keep = max(int(shrinking_factor * size), int(OVERSIZE * wanted))
        used = stage(viterbi_counts(over_words, pieces), "used")
        smaller = stage(pruned(pieces, piece_losses(pieces, used, replacements(over_pieces, pieces), n_words), keep), "pieces")
        left = smaller.count()
        if left == size:
            break  # everything left is needed; the last cut decides
        pieces, size = smaller, left
    best = top_k(pieces, [F.desc("single"), F.desc("logprob"), F.asc("piece")], wanted)
    ranked = row_index(best.select("piece", "logprob"), [F.desc("logprob"), F.asc("piece")], "id", len(SPECIALS))
    front = words.sparkSession.createDataFrame([(i, s, 0.0) for i, s in enumerate(SPECIALS)], "id long, piece string, logprob double")
    table = front.unionByName(ranked.select("id", "piece", "logprob")).select(F.col("id").cast("int").alias("id"), "piece", "logprob")
    return Unigram(stage(table, "unigram"), history)
