"""Text to token ids and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankcut.operators.lattice import PieceTrie
from rankcut.operators.ordering import number_rows
from rankcut.operators.vocab import UNK_TOKEN, Learned, byte_alphabet, from_byte_chars, words_of

# Fixed value: longer words become the unknown token under longest-match encoding.
MAX_WORD_CHARS = 100
_MEMO_WORDS = 250_000  # in either generation


def merge_word(word: str, ids: dict[str, int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the lowest-ranked applicable merge everywhere, until none applies."""
    parts = [ids[c] for c in word]
    while len(parts) > 1:
        ranked = [ranks.get(pair) for pair in zip(parts, parts[1:])]
        found = [r for r in ranked if r is not None]
        if not found:
            break
        best = min(found)
        out, i = [], 0
        for k, r in enumerate(ranked):
            if r is best and k >= i:
                out.extend(parts[i:k])
                out.append(best[1])
                i = k + 2
        parts = out + parts[i:]
    return parts


def longest_match(word: str, ids: dict[str, int], unk: int, prefix: str = "") -> list[int]:
    """Greedy longest match from the left; one unknown token when the word is too long or a part is missing."""
    if len(word) > MAX_WORD_CHARS:
        return [unk]
    parts, start = [], 0
    while start < len(word):
        end = len(word)
        lead = prefix if start else ""
        while end > start and lead + word[start:end] not in ids:
            end -= 1
        if end == start:
            return [unk]
        parts.append(ids[lead + word[start:end]])
        start = end
    return parts


def _word_encoder(learned: Learned, vocab_size: int, kind: str, prefix: str):
    tokens = {t: i for i, t in enumerate(learned.tokens[:vocab_size])}
    if kind == "bpe":
        ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(m for m in learned.merges if m[2] < vocab_size):
            ranks.setdefault(tuple(m[0]), (rank, m[2]))
        return lambda word: merge_word(word, tokens, ranks)
    unk = tokens.get(UNK_TOKEN, 0)
    if kind == "unigram":
        return PieceTrie(list(zip(learned.tokens, learned.scores))[:vocab_size], unk).encode
    return lambda word: longest_match(word, tokens, unk, prefix)


def encode_words(words: Column, learned: Learned, spark, vocab_size: int | None = None, kind: str = "bpe", prefix: str = "") -> Column:
    """Array of words -> array of ids, by merges (``bpe``), best path (``unigram``) or else the longest match.

    The vocabulary is bounded by its size parameter and shipped once per executor. A batch of documents looks each of its distinct words up
    once; a task remembers the words it has encoded, in two generations of bounded size.
    """
    size = vocab_size or len(learned.tokens)
    shared = spark.sparkContext.broadcast((learned, size))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, limit = shared.value
        one = _word_encoder(table, limit, kind, prefix)
        alphabet = byte_alphabet()
        young: dict[str, bytes] = {}
        old: dict[str, bytes] = {}
        for batch in batches:
            if batch.null_count:
                raise TypeError("documents without text cannot be encoded")
            coded = batch.flatten().dictionary_encode()
            spelled = []
            for word in coded.dictionary.to_pylist():  # each word of the batch once
                found = young.get(word)
                if found is None:
                    if len(young) >= _MEMO_WORDS:
                        old, young = young, {}
                    found = old.get(word)
                    if found is None:
                        found = np.array(one("".join([alphabet[b] for b in word.encode()])), "<i4").tobytes()
                    young[word] = found
                spelled.append(found)
            ids = np.frombuffer(b"".join(spelled), "<i4")
            sizes = np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4
            use = coded.indices.to_numpy()
            sizes, starts = sizes[use], (np.cumsum(sizes) - sizes)[use]
            ends = np.append(0, np.cumsum(sizes))
            where = np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])
            bounds = batch.offsets.to_numpy()
            yield pa.ListArray.from_arrays(pa.array(ends[bounds - bounds[0]], pa.int32()), pa.array(ids[where], pa.int32()))

    return encode(words)


def encode_docs(
    docs: DataFrame, learned: Learned, vocab_size: int | None = None, kind: str = "bpe", prefix: str = "", text: str = "text"
) -> DataFrame:
    """Replace ``text`` by ``input_ids``: a map over rows, without a shuffle."""
    ids = encode_words(words_of(F.col(text)), learned, docs.sparkSession, vocab_size, kind, prefix)
    return docs.withColumn("input_ids", ids).drop(text)


def encode_corpus(
    docs: DataFrame,
    learned: Learned,
    order: list[str],
    vocab_size: int | None = None,
    kind: str = "bpe",
    prefix: str = "",
    keep: list[str] = (),
) -> DataFrame:
    """``(uid, keep..., input_ids)`` with ``uid`` contiguous in ``order``.

    ``order`` must identify a document (with splits: the position of the split first, see ``split_order``).
    """
    columns = list(dict.fromkeys([*order, *keep]))
    encoded = encode_docs(docs.select(*columns, "text"), learned, vocab_size, kind, prefix)
    return number_rows(encoded, order, "uid").select("uid", *keep, "input_ids")


def split_order(split: Column, splits: list[str]) -> Column:
    """Position of a split in the order in which splits are numbered."""
    return F.array_position(F.array(*[F.lit(s) for s in splits]), split).cast("int")


def decode_docs(tokenised: DataFrame, vocab: DataFrame, key: str = "uid") -> DataFrame:
    """Ids back to text: a map over rows, since a vocabulary is bounded by its size parameter and shipped once per executor.

    No ids give the empty text, NULL gives NULL, and an id outside the vocabulary fails the query.
    """
    tokens = {r["id"]: r["token"] for r in vocab.select("id", "token").collect()}
    shared = tokenised.sparkSession.sparkContext.broadcast(tokens)

    @F.arrow_udf("string")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = np.array(sorted(shared.value), np.int64)
        table = pa.array([shared.value[i] for i in known.tolist()], pa.string())
        for batch in batches:
            ids = batch.flatten()
            if ids.null_count:
                raise KeyError(None)
            ids = ids.to_numpy()
            place = np.searchsorted(known, ids)
            strange = ids[np.append(known, -1)[place] != ids] if len(known) else ids
            if len(strange) or (ids < 0).any():
                raise KeyError(int(strange[0]) if len(strange) else int(ids.min()))
            size = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
            parts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), table.take(pa.array(place)))
            text = pc.binary_join(parts, "")
            yield pc.if_else(batch.is_valid(), text, None) if batch.null_count else text

    return tokenised.select(key, from_byte_chars(joined("input_ids")).alias("text"))
