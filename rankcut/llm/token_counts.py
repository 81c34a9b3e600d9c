"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers count the tokens of a byte-pair tokenizer without building them. The first reads character
classes and finds where pre-tokens begin. It is run over chunks from all of its states at once; a chunk is then a map from states to states, and
these maps compose through a prefix scan, which gives every chunk its entry state. The second reads the bytes of a pre-token; each of
its transitions is annotated with the number of tokens by which the count changes. It is compiled from vocabulary and merges, a
transition when it is first taken. The tokenizer library only tells the classes of characters; it encodes nothing.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.llm.linear import map_batches
from rankcut.llm.text import span_hashes
from rankcut.operators.vocab import byte_alphabet

LIMIT = 1024
PIECE = 1 << 19  # characters read at once
STEPS = 256  # characters per chunk
LEXICON = 1_000_000  # pre-tokens a worker remembers
STATES = 150_000  # compiled states a worker keeps
PAIRS = 300_000  # judged pairs of tokens a worker keeps

# Character classes. The letters that can end a contraction have classes of their own.
LETTER, NUMBER, SPACE, WHITE, APOSTROPHE, OTHER, STOP, S_M_T_D, R, V, L, E = range(12)
# States: beginning of a text, inside runs, blank runs by their last character, apostrophe, half and whole contractions.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, AFTER_APOSTROPHE, AFTER_R, AFTER_V, AFTER_L, DONE = range(11)
# Outputs: a pre-token begins at the character read, at the one before it.
HERE, BEFORE = 1, 2
_LETTERS = {LETTER, S_M_T_D, R, V, L, E}
_BLANKS = {SPACE, WHITE}


def _fresh(c: int) -> int:
    """State after the first character of a pre-token."""
    if c in _LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, SPACE: AFTER_SPACE, WHITE: AFTER_WHITE, APOSTROPHE: AFTER_APOSTROPHE, OTHER: IN_OTHERS, STOP: START}[c]


def _transition(q: int, c: int) -> tuple[int, int]:
    """Next state and output. Pre-tokens are contractions, runs of letters, of numbers or of others with one space before them, and blank runs."""
    half = {AFTER_R: E, AFTER_V: E, AFTER_L: L}
    if c == STOP:
        return START, HERE | (BEFORE if q in half else 0)
    if q in half:
        if c == half[q]:
            return DONE, 0
        return (IN_LETTERS, BEFORE) if c in _LETTERS else (_fresh(c), HERE | BEFORE)
    if q == IN_LETTERS and c in _LETTERS or q == IN_NUMBERS and c == NUMBER or q == IN_OTHERS and c in (OTHER, APOSTROPHE):
        return q, 0
    if q in (AFTER_SPACE, AFTER_WHITE):
        if c in _BLANKS:
            return _fresh(c), 0
        if q == AFTER_SPACE:  # the space belongs to what follows
            return (IN_OTHERS if c == APOSTROPHE else _fresh(c)), BEFORE
        return _fresh(c), HERE | BEFORE
    if q == AFTER_APOSTROPHE:
        if c == S_M_T_D:
            return DONE, 0
        if c in (R, V, L):
            return {R: AFTER_R, V: AFTER_V, L: AFTER_L}[c], 0
        if c in (OTHER, APOSTROPHE):
            return IN_OTHERS, 0
    return _fresh(c), HERE


_TABLE = [[_transition(q, c) for c in range(12)] for q in range(11)]
NEXT = np.array([[t[0] for t in row] for row in _TABLE], dtype=np.uint8)
OUT = np.array([[t[1] for t in row] for row in _TABLE], dtype=np.uint8)
_NEXT_OF_CLASS = np.ascontiguousarray(NEXT.T)


def character_classes() -> np.ndarray:
    """Class of every code point, as the pattern engine of the tokenizer library sees it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for low in range(0, 0x110000, 0x10000):
        points = np.array([p for p in range(low, low + 0x10000) if not 0xD800 <= p < 0xE000])  # without surrogates
        text = "".join(map(chr, points))
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
            for piece, (start, _) in Split(Regex(f"[^{pattern}]+"), "removed").pre_tokenize_str(text):
                table[points[start : start + len(piece)]] = kind
    table[ord(" ")], table[ord("'")] = SPACE, APOSTROPHE
    for c in "stmd":
        table[ord(c)] = S_M_T_D
    table[ord("r")], table[ord("v")], table[ord("l")], table[ord("e")] = R, V, L, E
    return table


def pre_token_starts(classes: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Where pre-tokens begin, as flags over characters (STOP characters begin one as well).

    Chunks of ``steps`` characters are read side by side from all states; their state maps are composed in a prefix scan of doubling
    distance; then every chunk is read once more from its entry state, for the outputs.
    """
    n = len(classes)
    chunks = max(-(-n // steps), 1)
    grid = np.full(chunks * steps, STOP, dtype=np.uint8)
    grid[:n] = classes
    grid = grid.reshape(chunks, steps)
    maps = np.tile(np.arange(len(NEXT), dtype=np.uint8), (chunks, 1))
    for k in range(steps):
        maps = _NEXT_OF_CLASS[grid[:, k, None], maps]
    reach = 1
    while reach < chunks:  # maps[i] becomes the map of all chunks up to i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
        reach *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    out = np.empty((chunks, steps), dtype=np.uint8)
    for k in range(steps):
        out[:, k] = OUT[state, grid[:, k]]
        state = NEXT[state, grid[:, k]]
    out = out.ravel()[:n]
    starts = (out & HERE).astype(bool)
    starts[:-1] |= (out[1:] & BEFORE).astype(bool)
    return starts


class Emitter:
    """Transducer of one byte-pair vocabulary: reads bytes, counts tokens.

    The last token of a prefix's encoding is the one token that ends there and may follow the last token of the prefix before it. A token that
    ends further on begins at a place from which all that was read since begins some token. So a state lists
    these places, farthest first: what was read since, the last token before it, and the tokens counted since (negative).
    """

    def __init__(self, path: str, states: int = STATES, pairs: int = PAIRS) -> None:
        with open(path) as f:
            model = json.load(f)["model"]
        if model.get("type") != "BPE" or model.get("ignore_merges") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("only plain byte-level pair vocabularies can be compiled")
        shown = {c: b for b, c in enumerate(byte_alphabet())}
        self.ids = {bytes([b]): b for b in range(256)}  # tokens by their rank: bytes first, then merges in order
        self.parts = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"], 256):
            left, right = (bytes(map(shown.__getitem__, t)) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            if left + right in self.ids:
                raise ValueError("a token is made by two merges")
            self.ids[left + right] = rank
            self.parts.append((self.ids[left], self.ids[right]))
            self.merged[self.parts[-1]] = rank
        self.begins = {t[:k] for t in self.ids for k in range(1, len(t) + 1)}
        self.most_states, self.most_pairs = states, pairs
        self.judged: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.transitions: dict[int, tuple[int, int]] = {}
        self._number(((b"", -1, 0),))

    def _number(self, state: tuple) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging keeps the border between ``a`` and ``b``: their outermost parts are taken apart, latest merge first."""
        known = self.judged.get((a, b))
        if known is not None:
            return known
        pair, limit, kept = (a, b), 1 << 60, True
        while a >= 256 or b >= 256 or self.merged.get((a, b), limit) < limit:
            if self.merged.get((a, b), limit) < limit:
                kept = False
                break
            if a > b:
                limit, a = a, self.parts[a][1]
            else:
                limit, b = b + 1, self.parts[b][0]
        if len(self.judged) >= self.most_pairs:
            self.judged.clear()
        self.judged[pair] = kept
        return kept

    def _compile(self, number: int, byte: int) -> tuple[int, int]:
        read, places, token, change = bytes([byte]), [], -1, 0
        for piece, last, counted in self.states[number]:
            piece += read
            if piece in self.begins:
                places.append((piece, last, counted))
                if token < 0:
                    ending = self.ids.get(piece)
                    if ending is not None and (last < 0 or self._may_follow(last, ending)):
                        token, change = ending, counted + 1
        return self._number((*[(p, last, counted - change) for p, last, counted in places], (b"", token, 0))), change

    def count(self, data: bytes) -> int:
        """Tokens of one pre-token."""
        if len(self.states) >= self.most_states:
            self._clear()
        state, total, transitions = 0, 0, self.transitions
        for byte in data:
            key = state << 8 | byte
            step = transitions.get(key)
            if step is None:
                step = transitions[key] = self._compile(state, byte)
            state, change = step
            total += change
        return total


class Lexicon:
    """Emitted tokens of every pre-token seen so far, by hash, and the transducer that counts those of new ones."""

    def __init__(self, path: str, size: int = LEXICON) -> None:
        self.emitter, self.size = Emitter(path), size
        self.classes = character_classes()
        with open(path) as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def emitted(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """Counts of the pre-tokens with these distinct, sorted hashes; ``text_of(i)`` is the i-th one's text."""
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            counts = np.where(known, self.counts[at], 0)
        else:
            known, counts = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        new = np.flatnonzero(~known)
        counts[new] = [self.emitter.count(text_of(i).encode()) for i in new]
        if len(new):
            if len(self.hashes) + len(new) > self.size:
                self.hashes, self.counts = hashes[-self.size :], counts[-self.size :]
            else:
                order = np.argsort(merged := np.concatenate([self.hashes, hashes[new]]), kind="stable")
                self.hashes, self.counts = merged[order], np.concatenate([self.counts, counts[new]])[order]
        return counts

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. Special strings inside a text are one token and part what stands around them."""
        totals = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            pieces = [text]
            for mark in self.special:
                if mark in text:
                    totals[i] += sum(p.count(mark) for p in pieces)
                    pieces = [q for p in pieces for q in p.split(mark)]
            parts += pieces
            owner += [i] * len(pieces)
        low = 0
        while low < len(parts):
            high, size = low, 0
            while high < len(parts) and (high == low or size + len(parts[high]) <= PIECE):
                size += len(parts[high]) + 1
                high += 1
            np.add.at(totals, np.array(owner[low:high]), self._count_group(parts[low:high]))
            low = high
        return totals

    def _count_group(self, parts: list[str]) -> np.ndarray:
        joined = "\0".join(parts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        stops = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = self.classes[points]
        classes[stops] = STOP
        starts = np.flatnonzero(pre_token_starts(classes))
        ends = np.append(starts[1:], len(points))
        real = classes[starts] != STOP
        starts, ends = starts[real], ends[real]
        if not len(starts):
            return np.zeros(len(parts), np.int64)
        hashes = span_hashes(points.astype(np.uint64) + np.uint64(1), starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        emitted = self.emitted(distinct, lambda i: joined[starts[first[i]] : ends[first[i]]])
        return np.bincount(np.searchsorted(stops, starts, side="right"), emitted[back], len(parts)).astype(np.int64)


_LEXICONS: dict[str, Lexicon] = {}


def lexicon(path: str) -> Lexicon:
    """The transducers of this Python worker (kept between tasks)."""
    if path not in _LEXICONS:
        _LEXICONS[path] = Lexicon(path)
    return _LEXICONS[path]


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document, as the tokenizer library counts them.

    For byte-level pair encoders with the usual contraction pattern. Null and empty texts have no bytes and no tokens.
    Repeated rows are counted each. Other columns, whatever their names, are ignored. An empty table gives no rows. Long texts are read in one piece of characters; work arrays take about 40 bytes per character of the longest text.
    """

    def run(batch: dict) -> dict:
        table = lexicon(tokenizer_path)
        texts = [t or "" for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": pa.array(table.count(texts), pa.int64())}

    rows = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = map_batches(rows, rows.columns, run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
