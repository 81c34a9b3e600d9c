"""Packing: documents into training sequences whose attention costs are balanced."""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.llm.frames import release
from rankcut.session import stage

CAPACITY = 4096
BLOCK = 1 << 20  # tokens packed together
END = 2  # id that closes a document
SEQUENCE_BITS = 33  # sequences are numbered inside their task
TASKS = 256  # tasks whose last, unfilled sequences are packed together

CACHE = 120_000  # words whose ids a worker remembers, in either of two generations
_STATE: dict[str, tuple] = {}


def _shown_bytes() -> list[str]:
    """The character by which byte-level vocabularies show each byte: itself where it is printable in Latin-1, else one from 256 on."""
    shown, more = [], 0
    for b in range(256):
        printable = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
        shown.append(chr(b) if printable else chr(256 + more))
        more += not printable
    return shown


_SHOWN = _shown_bytes()


class WordIds:
    """Token ids of texts, looked up word by word.

    For tokenizers that drop white space: a text is cut at ASCII white space, where no rule of such a tokenizer looks across. New plain
    words go straight to the tokenizer's encoding model (once it is seen to give the same ids), others through the whole
    tokenizer in batches. Two generations of words are remembered, so memory is bounded.
    """

    def __init__(self, path: str, size: int = CACHE) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.size = Tokenizer.from_file(path), size
        self.model = self.tokenizer.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}  # ids of the punctuation after words
        self.plain = self._reads_plain_words()

    def _reads_plain_words(self) -> bool:
        """Whether a plain word's ids are those of its lower-cased letters and of its punctuation, as its encoding model gives them."""
        return all(self._plain(w.encode()) == self._whole([w])[0] for w in ("Word", "word,", "éÀß", "Ça...", "x!!", "***"))

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ids(self, letters: str) -> bytes:
        shown = letters if letters.isascii() else "".join(map(_SHOWN.__getitem__, letters.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])

    def _plain(self, word: bytes) -> bytes | None:
        """Ids of a word of Latin letters with or without punctuation after it; None for any other word."""
        core = word.rstrip(b".,;:!?*#$%&|")
        letters = core.decode()
        if core and not (letters.isalpha() and (letters.isascii() or max(letters) < "\u0130")):
            return None
        ids = self._ids(letters.lower()) if core else b""
        if len(core) == len(word):
            return ids
        tail = word[len(core) :]
        if tail not in self.tails:
            if len(self.tails) >= 4096:
                self.tails.clear()
            self.tails[tail] = self._ids(tail.decode())
        return ids + self.tails[tail]

    def learn(self, words: set[bytes]) -> None:
        new = []
        for w in words:
            ids = self.old.get(w)
            if ids is None and self.plain:
                ids = self._plain(w)
            if ids is None:
                new.append(w)
            else:
                self.young[w] = ids
        for low in range(0, len(new), 4096):
            part = new[low : low + 4096]
            self.young.update(zip(part, self._whole([w.decode() for w in part]), strict=True))

    def encode(self, text: str) -> np.ndarray:
        words, known = text.encode().split(), self.young
        try:
            return np.frombuffer(b"".join([known[w] for w in words]), "<u4")
        except KeyError:
            pass
        if len(known) > self.size:
            self.old, self.young = known, {}
        ids = []
        for low in range(0, len(words), 1 << 18):  # very long texts in parts
            part = words[low : low + (1 << 18)]
            self.learn({w for w in part if w not in self.young})
            ids.append(b"".join([self.young[w] for w in part]))
        return np.frombuffer(b"".join(ids), "<u4")


def word_ids(path: str) -> WordIds:
    """The encoder of this Python worker (kept between tasks)."""
    if path not in _STATE:
        _STATE[path] = (WordIds(path),)
    return _STATE[path][0]


def balance(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pack a block of documents: ``(document, start, length, sequence, offset)`` of each piece.

    The cost of a piece is ``linear * tokens + quadratic * tokens ** 2``. Just enough sequences are opened to hold all tokens; documents in
    descending length go to the sequence of lowest cost with remaining capacity. A document longer than what remains there is cut,
    and its rest is put back in line. Ties: the smaller document number, the smaller sequence number.
    """
    total = sum(lengths)
    line = [(-n, i, 0) for i, n in enumerate(lengths) if n > 0]
    heapq.heapify(line)
    open_ = [(0.0, s, 0) for s in range(-(-total // capacity))]  # cost, sequence, filled
    pieces = []
    while line:
        n, i, start = heapq.heappop(line)
        cost, s, filled = heapq.heappop(open_)
        take = min(-n, capacity - filled)
        pieces.append((i, start, take, s, filled))
        if filled + take < capacity:
            heapq.heappush(open_, (cost + linear * take + quadratic * take * take, s, filled + take))
        if take < -n:
            heapq.heappush(line, (n + take, i, start + take))
    return pieces


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_PIECE = ", ".join(f"{c} long" for c in _COLUMNS) + ", ids array<int>, task int"


def _table(pieces: list[tuple], with_ids: bool) -> pa.RecordBatch:
    """Rows of ``_PIECE`` from (doc, start, ids, tokens of the document, sequence, offset, task); ids go along where wanted or still needed."""
    cols = list(zip(*pieces)) if pieces else [[]] * 7
    doc, start, ids, total, sequence, offset, task = cols
    numbers = [doc, start, [len(x) for x in ids], [zlib.crc32(x) for x in ids], total, sequence, offset]
    kept = [x.astype(np.int32) if with_ids or s is None else None for x, s in zip(ids, sequence)]
    arrays = [pa.array(c, pa.int64()) for c in numbers] + [pa.array(kept, pa.list_(pa.int32())), pa.array(task, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=[*_COLUMNS, "ids", "task"])


def _packed(held: list[tuple], capacity: int, first: int) -> list[tuple]:
    """Pieces of ``held`` (doc, start, ids, total) in sequences numbered from ``first``."""
    out = []
    for i, start, n, s, offset in balance([len(ids) for _, _, ids, _ in held], capacity):
        doc, begin, ids, total = held[i]
        out.append((doc, begin + start, ids[start : start + n], total, first + s, offset, None))
    return out


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block: int = BLOCK, with_ids: bool = True, tasks: int = TASKS) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens, one row per piece.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, ``with_ids``, the piece's ``ids``. A document is its
    token ids and a closing id, and may be cut anywhere. Every task packs the documents of its partition in blocks of about
    ``block`` tokens, so no text is shuffled and memory is bounded. Full sequences of documents
    longer than ``capacity`` are cut off first. A block only packs as many tokens as fill whole sequences and hands the rest to the next; what a
    task has left at its end, less than one sequence, is packed together with the rests of ``tasks`` tasks in a second pass. So less
    than one sequence per ``tasks`` tasks is padding, however small partitions are. Sequence ids hold the number of the partition in their upper bits, those of the second pass are above them.

    Null and empty texts are one closing id. Repeated rows are packed each; a null ``doc_id`` stays null, other ids must be whole numbers.
    Ties in length go by the order of the input. Other columns, whatever their names, are ignored. An empty table gives no rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer_path)
        task = TaskContext.get().partitionId()
        sequence = task << SEQUENCE_BITS
        held: list[tuple] = []
        out: list[tuple] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield _table(out, with_ids)
                out.clear()

        def close() -> None:
            """Pack whole sequences; ``held`` keeps what does not fill one."""
            nonlocal sequence, waiting, held
            rest, spare = [], waiting % capacity
            while spare:
                doc, start, ids, total = held.pop()
                cut = max(len(ids) - spare, 0)
                rest.append((doc, start + cut, ids[cut:], total))
                if cut:
                    held.append((doc, start, ids[:cut], total))
                spare -= len(ids) - cut
            out.extend(_packed(held, capacity, sequence))
            sequence += waiting // capacity
            held, waiting = rest, waiting % capacity

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.encode(text.as_py() or ""), np.array([END], "<u4"))
                done = 0
                while len(ids) - done > capacity:
                    out.append((doc, done, ids[done : done + capacity], len(ids), sequence, 0, None))
                    sequence, done = sequence + 1, done + capacity
                    if len(out) * capacity > 4 * block:
                        yield from flush()
                held.append((doc, done, ids[done:], len(ids)))
                waiting += len(ids) - done
                if waiting >= block:
                    close()
                    yield from flush()
        close()
        yield from flush()
        out.extend((doc, start, ids, total, None, None, task) for doc, start, ids, total in held)
        yield from flush()
        encoder.old = {}  # words not met for long need not be held between tasks
        release()

    def again(table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        ids = [np.array(x, "<u4") for x in table["ids"].to_pylist()]
        held = list(zip(table["doc_id"].to_pylist(), table["start"].to_pylist(), ids, table["doc_tokens"].to_pylist()))
        first = (1 << 62) + ((table["task"][0].as_py() // tasks) << SEQUENCE_BITS)
        return pa.Table.from_batches([_table(_packed(held, capacity, first), with_ids)])

    pieces = stage(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, _PIECE), "pieces")
    loose = pieces.where(F.col("task").isNotNull())
    rest = loose.groupBy(F.floor(F.col("task") / tasks)).applyInArrow(again, _PIECE)
    columns = [*_COLUMNS, "ids"] if with_ids else _COLUMNS
    return pieces.where(F.col("task").isNull()).select(*columns).unionByName(rest.select(*columns))
