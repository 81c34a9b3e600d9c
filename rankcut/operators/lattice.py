"""Segmentation lattices: which pieces may stand where in a word, and sums and best paths over them.

Words are dealt into parts of a bounded number of characters. A part is one row, with the edges of its words as packed
numbers. Pieces are numbered once per lattice, so an edge names its piece by that number: the pieces (as a trie) and their scores are vectors
bounded by the number of pieces, shipped once per executor, and the edges stay where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.session import arrow_batches, stage, unstage

PART_CHARS = 50_000  # characters of the words of one part
PART_ROWS = 4  # parts that a task holds at a time

_BLOCK = "weights binary, sizes binary, at binary, length binary, piece binary"


@dataclass
class Lattice:
    """``blocks``: one row per part. ``pieces``: ``pid, piece``, numbered by the order of their characters; ``names`` the same as a vector."""

    blocks: DataFrame
    pieces: DataFrame
    names: Broadcast
    shared: list[Broadcast]

    def drop(self) -> None:
        unstage(self.blocks)
        unstage(self.pieces)
        for vector in (self.names, *self.shared):
            vector.destroy()


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, one after the other, and the length of each text."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.array([len(t) for t in texts], dtype=np.int64)


class Trie:
    """Pieces as one sorted row of ``node * symbols + symbol`` keys; the node behind key ``i`` is ``i + 1``."""

    def __init__(self, pieces: list[str]) -> None:
        """``pieces`` are distinct and in the order of their code points."""
        flat, sizes = _codes(pieces)
        self.symbols = np.unique(flat)
        self.width = len(self.symbols) + 1
        table = np.zeros((len(pieces), int(sizes.max(initial=0))), np.int32)
        row = np.repeat(np.arange(len(pieces)), sizes)
        table[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.searchsorted(self.symbols, flat) + 1
        node, keys, ends = np.zeros(len(pieces), np.int64), [], [np.array([-1])]
        other, made = np.zeros(len(pieces), bool), 0  # whether the first characters differ from those of the piece before
        for k in range(table.shape[1]):
            other[1:] |= table[1:, k] != table[:-1, k]
            other[:1] = True
            long = sizes > k
            first = np.flatnonzero(long & other)
            keys.append(node[first] * self.width + table[first, k])
            place = np.cumsum(long & other)
            node = np.where(long, made + place, 0)
            last = np.full(len(first), -1)
            whole = np.flatnonzero(sizes == k + 1)
            last[place[whole] - 1] = whole
            ends.append(last)
            made += len(first)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends).astype(np.int32)  # number of the piece that ends at a node, or -1

    def edges(self, texts: list[str], max_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, start, length and piece of every occurrence of up to ``max_chars`` characters."""
        flat, sizes = _codes(texts)
        code = np.searchsorted(self.symbols, flat)
        code = np.where(np.append(self.symbols, 0)[code] == flat, code + 1, -1)
        text = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - at  # characters from here to the end
        here, node, out = np.arange(len(flat)), np.zeros(len(flat), np.int64), []
        for k in range(max_chars):
            inside = left[here] > k
            here, node = here[inside], node[inside]
            symbol = code[here + k]
            key = node * self.width + symbol
            place = np.searchsorted(self.keys, key)
            found = (symbol > 0) & (np.append(self.keys, -1)[place] == key)
            here, node = here[found], place[found] + 1
            if not len(here):
                break
            pid = self.ends[node]
            hit = here[pid >= 0]
            out.append((text[hit], at[hit], np.full(len(hit), k + 1), pid[pid >= 0]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def build_lattice(words: DataFrame, pieces: DataFrame, max_chars: int) -> Lattice:
    """Lattice of ``words`` (distinct ``w``, weight ``n``) over ``pieces`` (distinct ``piece`` of up to ``max_chars`` characters).

    The pieces, bounded by the number of seeds whatever the corpus, reach the driver, which ships them as a trie.
    """
    context = words.sparkSession.sparkContext
    chars = words.agg(F.sum(F.length("w"))).first()[0] or 0
    parts = 1 + chars // PART_CHARS
    names = pieces.select("piece").orderBy("piece").toArrow()["piece"].combine_chunks()
    names = names.cast(pa.string())
    shared = context.broadcast(Trie(names.to_pylist()))
    numbers = words.sparkSession.createDataFrame(pa.table({"pid": pa.array(np.arange(len(names))), "piece": names}))

    def link(table: pa.Table) -> pa.Table:
        texts = table["w"].to_pylist()
        text, at, length, piece = shared.value.edges(texts, max_chars)
        order = np.lexsort((length, text, at))  # by start, then word, then end
        weights, sizes = table["n"].to_numpy().astype("<i8"), np.array([len(w) for w in texts], dtype="<i4")
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        packed = [weights, sizes, (first[text] + at)[order].astype("<i4"), length[order].astype("<u2"), piece[order].astype("<i4")]
        return pa.table([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in packed], names=[c.split()[0] for c in _BLOCK.split(", ")])

    dealt = words.where(F.length("w") > 0).select("w", "n", F.pmod(F.xxhash64("w"), F.lit(parts)).alias("part"))
    blocks = dealt.groupBy("part").applyInArrow(link, _BLOCK)
    return Lattice(stage(blocks, "lattice"), stage(numbers, "lattice_pieces"), context.broadcast(names), [shared])


class Block:
    """The edges of a part's words, with scores. Nodes are the places between characters, words one after the other."""

    def __init__(self, row: dict, scores: np.ndarray) -> None:
        unpack = lambda c, t="<i4": np.frombuffer(row[c], t).astype(np.int64)
        self.n_pieces = len(scores)
        self.weights, self.sizes = unpack("weights", "<i8"), unpack("sizes")
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]).astype(np.int64)
        self.last = self.first + self.sizes
        a, length, piece = (np.frombuffer(row[c], t) for c, t in (("at", "<i4"), ("length", "<u2"), ("piece", "<i4")))
        score = scores[piece]
        there = score > -np.inf  # pieces that are gone keep their edges, which no path takes
        self.a, self.piece, self.score = a[there].astype(np.int64), piece[there].astype(np.int64), score[there]
        self.b = self.a + length[there]
        self.word = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)[self.a]
        at = self.a - self.first[self.word]
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        self.steps = list(zip(cuts, np.append(cuts[1:], len(at))))  # edges by start

    def _forward(self) -> np.ndarray:
        """Log-sum of all paths from the start of a word to every node."""
        out = np.full(int(self.last[-1]) + 1 if len(self.last) else 0, -np.inf)
        out[self.first] = 0.0
        for low, high in self.steps:  # no two edges of a step end at the same node
            to = self.b[low:high]
            out[to] = np.logaddexp(out[to], out[self.a[low:high]] + self.score[low:high])
        return out

    def _backward(self) -> np.ndarray:
        """Log-sum of all paths from every node to the end of the word."""
        out = np.full(int(self.last[-1]) + 1 if len(self.last) else 0, -np.inf)
        out[self.last] = 0.0
        for low, high in self.steps[::-1]:  # the edges of a step that begin at the same node lie together
            at = self.a[low:high]
            runs = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[runs]] = np.logaddexp.reduceat(out[self.b[low:high]] + self.score[low:high], runs)
        return out

    def expected(self, use: np.ndarray) -> float:
        """Adds the expected use of every piece over all weighted words (forward-backward); returns their log-likelihood."""
        forward, backward = self._forward(), self._backward()
        share = np.exp(forward[self.a] + self.score + backward[self.b] - forward[self.last][self.word])
        np.add.at(use, self.piece, share * self.weights[self.word])
        return float((forward[self.last] * self.weights).sum())

    def best(self, whole: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
        """Edges of the best path of every word, last ones first: steps of (words, edges). Ties go to the longer last piece.

        With ``whole=False`` no path consists of the whole word; words that then have none are left out.
        """
        score = self.score
        if not whole:
            score = np.where((self.a == self.first[self.word]) & (self.b == self.last[self.word]), -np.inf, score)
        best = np.full(int(self.last[-1]) + 1 if len(self.last) else 0, -np.inf)
        back = np.full(len(best), -1)
        best[self.first] = 0.0
        for low, high in self.steps:
            reached = best[self.a[low:high]] + score[low:high]
            better = np.flatnonzero(reached > best[self.b[low:high]])
            best[self.b[low + better]], back[self.b[low + better]] = reached[better], low + better
        path = []
        words = np.flatnonzero(best[self.last] > -np.inf)
        node = self.last[words]
        while len(words):
            left = node > self.first[words]
            words, node = words[left], node[left]
            edges = back[node]
            path.append((words, edges))
            node = self.a[edges]
        return path


def over_parts(lattice: Lattice, scores: DataFrame, function: Callable[[Iterator[Block], pa.Array], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``function(blocks, names of the pieces)`` over the parts of every task, staged. ``scores``: ``piece, logprob``."""
    spark = lattice.blocks.sparkSession
    present = lattice.pieces.join(scores.select("piece", "logprob"), "piece").select("pid", "logprob").toArrow()
    vector = np.full(len(lattice.names.value), -np.inf)
    vector[present["pid"].to_numpy()] = present["logprob"].to_numpy()
    shared, names = spark.sparkContext.broadcast(vector), lattice.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({c: batch.column(c)[i].as_py() for c in batch.schema.names} for batch in batches for i in range(batch.num_rows))
        yield from function((Block(row, shared.value) for row in rows), names.value)

    with arrow_batches(spark, PART_ROWS):
        found = stage(lattice.blocks.mapInArrow(run, schema), "parts")
    shared.destroy()
    return found


class PieceTrie:
    """Pieces with scores, for segmenting one word at a time as the usual unigram model does.

    A character that no piece consists of may stand alone, as the unknown token, at ten less than the lowest score;
    unknown characters in a row are one token.
    """

    UNKNOWN_PENALTY = 10.0  # fixed value of the usual model

    def __init__(self, pieces: list[tuple[str, float]], unknown: int) -> None:
        self.unknown = unknown
        self.floor = min((s for _, s in pieces), default=0.0) - self.UNKNOWN_PENALTY
        self.ids: dict[str, int] = {}
        self.root: dict = {}
        for i, (piece, score) in enumerate(pieces):
            if not piece:
                continue
            node = self.root
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = (i, score)
            self.ids[piece] = i

    def encode(self, word: str) -> list[int]:
        """Ids of the most probable segmentation."""
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, int | None]] = [(0, None)] * (n + 1)
        for i in range(n):
            node, j, alone = self.root, i, False
            here = best[i]
            while j < n and (node := node.get(word[j])) is not None:
                j += 1
                if "" in node:
                    pid, score = node[""]
                    alone |= j == i + 1
                    if best[j] is None or here + score > best[j]:
                        best[j], back[j] = here + score, (i, pid)
            if not alone and (best[i + 1] is None or here + self.floor > best[i + 1]):
                best[i + 1], back[i + 1] = here + self.floor, (i, None)
        out: list[int] = []
        j = n
        while j > 0:
            i, pid = back[j]
            if pid is None:
                end = j
                while i > 0 and back[i][1] is None:
                    i = back[i][0]
                pid = self.ids.get(word[i:end], self.unknown)
            out.append(pid)
            j = i
        return out[::-1]
