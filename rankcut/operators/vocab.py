"""Learning and cutting ranked vocabularies."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankcut.session import stage, unstage

# Special tokens and the word pattern of a GPT-2 style byte-level pre-tokeniser.
EOS_TOKEN = "<|endoftext|>"
UNK_TOKEN = "<|unk|>"
WORD_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTINUING_PREFIX = "##"

_HELD = 2_000_000  # pairs that a task adds up before it hands them on

MERGES_SCHEMA = "pair array<int>, new_token string, new_token_id int, part_a string, part_b string, count long"
VOCAB_SCHEMA = "id int, token string"


def byte_alphabet() -> list[str]:
    """Printable stand-in of each byte 0..255: Latin-1 printables stand for themselves, the rest follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def words_of(text: Column) -> Column:
    """Array of words whose concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def _latin(word: Column) -> Column:
    """The UTF-8 bytes of a string, one Latin-1 character per byte."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


_LATIN = "".join(map(chr, range(256)))


def to_byte_chars(word: Column) -> Column:
    return F.translate(_latin(word), _LATIN, "".join(byte_alphabet()))


def from_byte_chars(chars: Column) -> Column:
    """Inverse of ``to_byte_chars``."""
    return F.decode(F.encode(F.translate(chars, "".join(byte_alphabet()), _LATIN), "ISO-8859-1"), "UTF-8")


def word_counts(docs: DataFrame, text: str = "text", min_frequency: int = 1) -> DataFrame:
    """``(word, n)`` over the corpus."""
    words = docs.select(F.explode(words_of(F.col(text))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_frequency) if min_frequency > 1 else counts


# Symbols of a word are single characters while merges are learned, so that a pair is a two-character
# substring and a merge is a plain string replacement. U+0100 upwards, without the surrogate block.
def symbol(i: int) -> str:
    code = i + 0x100
    return chr(code if code < 0xD800 else code + 0x800)


def symbol_id(ch: str) -> int:
    code = ord(ch)
    return (code if code < 0xD800 else code - 0x800) - 0x100


@dataclass
class Learned:
    """A learned vocabulary: ``tokens[id]`` and the ranked merges log, or the scores of unigram pieces."""

    tokens: list[str]
    merges: list[tuple] = field(default_factory=list)
    n_initial: int = 0
    scores: list[float] = field(default_factory=list)

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens)), VOCAB_SCHEMA)

    def merges_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.merges, MERGES_SCHEMA)


def _initial_tokens(specials: list[str]) -> tuple[list[str], list[int]]:
    """Specials, then the byte alphabet by code point; also the id of every byte."""
    alphabet = byte_alphabet()
    ranked = sorted(range(256), key=lambda b: ord(alphabet[b]))
    ids = [0] * 256
    for i, b in enumerate(ranked):
        ids[b] = len(specials) + i
    return [*specials, *[alphabet[b] for b in ranked]], ids


def _symbol_words(words: DataFrame, ids: list[int]) -> DataFrame:
    sym = F.translate(_latin(F.col("word")), _LATIN, "".join(symbol(i) for i in ids))
    return words.select(sym.alias("sym"), "n")


def _with_continuing(words: DataFrame, tokens: list[str], ids: list[int], prefix: str) -> tuple[DataFrame, list[str]]:
    """Give non-initial bytes their own, prefixed symbols; only bytes that occur there get one."""
    rest = F.substring("sym", 2, 1 << 30)
    seen = words.select(F.explode(F.array_distinct(F.split(rest, ""))).alias("c")).where("c <> ''").distinct()
    present = sorted(r["c"] for r in seen.collect())  # at most 256 symbols
    tokens = list(tokens)
    target = []
    for c in present:
        target.append(symbol(len(tokens)))
        tokens.append(prefix + tokens[symbol_id(c)])
    moved = F.concat(F.substring("sym", 1, 1), F.translate(rest, "".join(present), "".join(target)))
    return words.select(moved.alias("sym"), "n"), tokens


def _stage_words(words: DataFrame) -> DataFrame:
    """Stage the word table in enough slices to keep every core busy: rows are few but costly."""
    return stage(words.repartition(max(words.sparkSession.sparkContext.defaultParallelism, 1)), "words")


class _Batch:
    """The symbols of a batch of words, one word after the other; ``inner`` marks the places whose next symbol is of the same word."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        words = batch.column("sym").to_pylist()
        self.text = "".join(words)
        codes = np.frombuffer(self.text.encode("utf-32-le"), "<u4").astype(np.int64)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.sizes)
        self.n = batch.column("n").to_numpy()
        self.pairs = (codes[:-1] << 21) | codes[1:]
        inner = np.ones(len(self.pairs), bool)
        inner[self.ends[(self.ends > 0) & (self.ends < len(codes))] - 1] = False
        self.inner = np.flatnonzero(inner)

    def word_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, place, side="right")

    def stretches(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the longest stretches begin and end whose adjacent symbols are all among ``pairs``, in order."""
        hit = np.zeros(len(self.pairs) + 1, np.int8)
        here = self.pairs[self.inner]
        place = np.searchsorted(pairs, here)
        hit[self.inner[np.append(pairs, -1)[place] == here]] = 1
        step = np.diff(hit, prepend=np.int8(0))
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1


def _pair_numbers(pairs: list[str]) -> np.ndarray:
    return np.array(sorted((ord(p[0]) << 21) | ord(p[1]) for p in pairs), np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def pair_counts(words: DataFrame) -> DataFrame:
    """``(pair, n)`` of adjacent symbols over the word table; a task adds up its own pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys, n = _summed(np.concatenate(held[0]), np.concatenate(held[1]))
            text = np.stack([keys >> 21, keys & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
            return pa.RecordBatch.from_arrays([pa.array([text[i : i + 2] for i in range(0, len(text), 2)], pa.string()), pa.array(n, pa.int64())], names=["pair", "n"])

        held: tuple[list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        size = 0
        for batch in batches:
            b = _Batch(batch)
            keys, n = _summed(b.pairs[b.inner], b.n[b.word_of(b.inner)])
            held[0].append(keys)
            held[1].append(n)
            size += len(keys)
            if size > _HELD:
                yield out()
                held, size = ([], []), 0
        if held[0]:
            yield out()

    return words.select("sym", "n").mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def segment_counts(words: DataFrame, pairs: list[str]) -> DataFrame:
    """``(segment, n)``: the longest stretches of words whose adjacent symbols are all among ``pairs``, over the word table."""
    wanted = _pair_numbers(pairs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["segment", "n"])

        counts: dict[str, int] = {}
        for batch in batches:
            b = _Batch(batch)
            starts, ends = b.stretches(wanted)
            for start, end, n in zip(starts.tolist(), ends.tolist(), b.n[b.word_of(starts)].tolist()):
                segment = b.text[start:end]
                counts[segment] = counts.get(segment, 0) + n
            if len(counts) > _HELD // 10:
                yield out()
                counts = {}
        yield out()

    return words.select("sym", "n").mapInArrow(cut, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def replay(segments: list[tuple[str, int]], least: int, merge: Callable[[str, int], tuple[str, bool]]) -> list[str]:
    """One-at-a-time byte-pair merging on weighted segments, most frequent pair first (ties by symbols), down to count ``least``.

    ``merge(pair, n)`` names the symbol that replaces a pair and says whether to go on. A pair's count is kept with the segments
    that hold it, so a merge only looks at those. Returns what became of the segments.
    """
    words = [list(s) for s, _ in segments]
    weight = [n for _, n in segments]
    counts: dict[str, int] = {}
    where: dict[str, set[int]] = {}
    for i, w in enumerate(words):
        for pair in map("".join, zip(w, w[1:])):
            counts[pair] = counts.get(pair, 0) + weight[i]
            where.setdefault(pair, set()).add(i)
    heap = [(-n, pair) for pair, n in counts.items() if n >= least]
    heapq.heapify(heap)
    while heap:
        n, pair = heapq.heappop(heap)
        if counts.get(pair, 0) != -n:  # an old entry; the pair is listed under its present count as well
            continue
        made, go_on = merge(pair, -n)
        touched: set[str] = set()
        for i in where.pop(pair):
            old, new, k = words[i], [], 0
            while k < len(old):
                hit = k + 1 < len(old) and old[k] + old[k + 1] == pair
                new.append(made if hit else old[k])
                k += 2 if hit else 1
            for sign, parts in ((-1, old), (1, new)):
                for p in map("".join, zip(parts, parts[1:])):
                    counts[p] = counts.get(p, 0) + sign * weight[i]
                    touched.add(p)
                    if sign > 0:
                        where.setdefault(p, set()).add(i)
            words[i] = new
        for p in touched:
            if counts[p] >= least:
                heapq.heappush(heap, (-counts[p], p))
        if not go_on:
            break
    return list(map("".join, words))


def _rewritten(words: DataFrame, pairs: list[str], merges: list[tuple[str, str]], known: dict[str, str]) -> DataFrame:
    """Words after a run of merges in this order. All that changes are their stretches over ``pairs``, and ``known`` says what becomes of these; the rest
    of a word stays, and words without any pass through.
    """
    ranks = {pair: (rank, made) for rank, (pair, made) in enumerate(merges)}
    wanted = _pair_numbers(pairs)
    shared = words.sparkSession.sparkContext.broadcast(known)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            b = _Batch(batch)
            starts, ends = b.stretches(wanted)
            out, done, now = [], 0, []
            for start, end in zip(starts.tolist(), ends.tolist()):
                segment = b.text[start:end]
                made = table.get(segment)
                if made is None:
                    made = _merge_in_order(segment, ranks)
                out += (b.text[done:start], made)
                done = end
                now.append(len(made))
            text = "".join([*out, b.text[done:]])
            sizes = b.sizes.copy()
            np.add.at(sizes, b.word_of(starts), np.array(now, np.int64) - (ends - starts))
            cuts = np.append(0, np.cumsum(sizes)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([text[i:j] for i, j in zip(cuts, cuts[1:])], pa.string()), batch.column("n")], names=["sym", "n"])

    return words.select("sym", "n").mapInArrow(rewrite, "sym string, n long")


def _merge_in_order(word: str, ranks: dict[str, tuple[int, str]]) -> str:
    last = -1
    while True:
        found = [ranks[p] + (p,) for p in {word[i : i + 2] for i in range(len(word) - 1)} if p in ranks and ranks[p][0] > last]
        if not found:
            return word
        last, made, pair = min(found)
        word = word.replace(pair, made)


def _round_of(ranked: list, candidates: int, min_frequency: int, frequent: DataFrame, most: int) -> tuple[list[str], int, bool]:
    """Pairs of a round, the least count of its merges, and whether it may only take the first pair.

    The pairs must hold every pair of at least that count. Where too many pairs share the highest count, they are all taken if there are at
    most ``most``, else the first one alone.
    """
    top = ranked[:candidates]
    if len(ranked) <= candidates:
        return [r["pair"] for r in top], min_frequency, False
    least = ranked[candidates]["n"] + 1
    highest = top[0]["n"]
    if least <= highest:
        return [r["pair"] for r in top], least, False
    tied = frequent.where(F.col("n") == highest).limit(most + 1).collect() if candidates > 1 else ranked
    if candidates > 1 and len(tied) <= most:
        return [r["pair"] for r in tied], highest, False
    return [top[0]["pair"]], highest, True


def learn_merges(
    words: DataFrame,
    vocab_size: int,
    specials: list[str] | None = None,
    continuing_prefix: str = "",
    min_frequency: int = 2,
    candidates: int = 64,
    max_segments: int = 200_000,
) -> Learned:
    """Byte-pair merges in order of frequency until ``vocab_size`` tokens exist, hundreds of them per pass over the words.

    A round takes the ``candidates`` most frequent pairs. While merges are as frequent as the last of them, no other pair can
    come up: counts of present pairs only fall, and a new pair is at most as frequent as the pairs it comes from. So
    all that happens until then happens inside the stretches of words whose adjacent symbols are candidates. These stretches, counted over
    all words in Spark, are replayed one merge at a time; then the words are rewritten in one pass. The number of candidates is
    doubled or halved so that at most ``max_segments`` distinct stretches reach the driver, nothing that grows with the corpus. A merge
    that makes a token which exists already ends its round, since it can raise other counts.
    """
    tokens, ids = _initial_tokens([EOS_TOKEN] if specials is None else specials)
    table = _symbol_words(words, ids)
    if continuing_prefix:
        table = _stage_words(table)
        table, tokens = _with_continuing(table, tokens, ids, continuing_prefix)
    table = _stage_words(table.where(F.length("sym") > 1))
    learned = Learned(tokens, [], len(tokens))
    known = {t: i for i, t in enumerate(tokens)}
    while len(learned.tokens) < vocab_size:
        frequent = pair_counts(table).where(F.col("n") >= min_frequency)
        ranked = frequent.orderBy(F.desc("n"), F.asc("pair")).limit(candidates + 1).collect()
        if not ranked:
            break
        while True:
            pairs, least, single = _round_of(ranked, candidates, min_frequency, frequent, max_segments)
            segments = [(r["segment"], r["n"]) for r in segment_counts(table, pairs).limit(max_segments + 1).collect()]
            if len(segments) <= max_segments or single:
                break
            candidates = max(1, candidates // 2)
        done: list[tuple[str, str]] = []

        def merge(pair: str, n: int) -> tuple[str, bool]:
            a, b = symbol_id(pair[0]), symbol_id(pair[1])
            part_a, part_b = learned.tokens[a], learned.tokens[b]
            token = part_a + part_b.removeprefix(continuing_prefix)
            fresh = token not in known
            if fresh:
                known[token] = len(learned.tokens)
                learned.tokens.append(token)
            learned.merges.append(([a, b], token, known[token], part_a, part_b, n))
            done.append((pair, symbol(known[token])))
            return done[-1][1], fresh and len(learned.tokens) < vocab_size and not single

        became = dict(zip((segment for segment, _ in segments), replay(segments, least, merge)))
        before, table = table, stage(_rewritten(table, pairs, done, became).where(F.length("sym") > 1), "words")
        unstage(before)
        if 4 * len(segments) < max_segments:
            candidates *= 2
    return learned


def learn_bpe(docs: DataFrame, vocab_size: int, **options) -> Learned:
    return learn_merges(word_counts(docs), vocab_size, [EOS_TOKEN], **options)


def learn_wordpiece(docs: DataFrame, vocab_size: int, **options) -> Learned:
    """The merge learner with an unknown token and prefixed continuation symbols."""
    return learn_merges(word_counts(docs), vocab_size, [EOS_TOKEN, UNK_TOKEN], CONTINUING_PREFIX, **options)


def cut_vocab(vocab: DataFrame, vocab_size: int) -> DataFrame:
    """First ``vocab_size`` entries by id."""
    return vocab.where(F.col("id") < vocab_size)


def cut_merges(ranked: DataFrame, vocab_size: int, n_initial: int) -> DataFrame:
    """First ``vocab_size - n_initial`` merges of a list with a 0-based ``rank``."""
    return ranked.where(F.col("rank") < vocab_size - n_initial)


def cut_many(vocab: DataFrame, sizes: list[int], kind: str, corpus: str, source: str) -> DataFrame:
    """Vocabularies of several sizes from one learned list, named ``{kind}{size}{corpus}``, with their source."""
    fitting = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: F.col("id") < s)
    return vocab.withColumn("vocab_size", F.explode(fitting)).select(
        F.concat(F.lit(kind), F.col("vocab_size").cast("string"), F.lit(corpus)).alias("tok_name"),
        "vocab_size",
        "id",
        "token",
        F.lit(source).alias("source"),
    )
