"""Scores of n-grams looked up for whole blocks of documents.

A table of scores may be too large to ship, and a row per position, out and back, outgrows the documents many times over. So documents are cut into blocks, a
block asks for each of its different n-grams once, the questions meet the table in parts by hash, and the answers, in the order of the
questions, return to the block. Questions and answers travel as compressed bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankcut.session import stage

BLOCK_TOKENS = 1 << 21
PART_ROWS = 500_000  # rows of the table in one part
PART_TOKENS = 4_000_000  # tokens of the documents per part

_DOCUMENTS, _QUESTIONS = 0, 1


def _squeezed(values: np.ndarray) -> bytes:
    """Eight-byte numbers, compressed byte by byte."""
    plain = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _restored(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    plain = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(plain.reshape(8, -1).T).reshape(-1).view(kind)


def _next_prime(n: int, base: int) -> int:
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)) or base % n == 0:
        n += 1
    return n


class Block:
    """Tokens of some documents as codes below ``base - 1``, and the keys of their n-grams. Any other token is ``base - 1``, which no table has."""

    def __init__(self, ids: pa.ListArray, base: int) -> None:
        self.size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat = ids.flatten()
        tokens = pc.fill_null(self.flat.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
        self.codes = np.where((tokens < 0) | (tokens >= base - 1), base - 1, tokens)
        self.at = np.arange(len(tokens)) - np.repeat(np.cumsum(self.size) - self.size, self.size)  # place in the document
        self.base = base

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where an n-gram ends, and its keys."""
        ends = np.flatnonzero(self.at >= n - 1)
        key = np.zeros(len(ends), np.int64)
        for k in range(n):
            key = key * self.base + self.codes[ends - n + 1 + k]
        return ends, key


def _asked(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys by part, rising in each, and where the parts begin."""
    key = np.unique(key)
    part = key % parts
    order = np.argsort(part, kind="stable")
    return key[order], np.searchsorted(part[order], np.arange(parts + 1))


def key_of(words: list[str], base: int):
    key = F.lit(0).cast("long")
    for w in words:
        key = key * F.lit(base).cast("long") + F.col(w).cast("long")
    return key


def base_of(tables: list[tuple[DataFrame, list[str]]]) -> int | None:
    """One more than the number of codes that n-grams of the tables need; None if their keys would not be plain numbers (a missing or negative token, or too many)."""
    base = 2
    for table, words in tables:
        least, most, none = table.agg(F.min(F.least(*words, F.lit(0))), F.max(F.greatest(*words, F.lit(0))), F.max(F.greatest(*[F.col(w).isNull().cast("int") for w in words], F.lit(0)))).first()
        if none or (least or 0) < 0:
            return None
        base = max(base, (most or 0) + 2)
    return base if all(base ** len(words) < 1 << 62 for _, words in tables) else None


def looked_up(
    docs: DataFrame, tables: list[tuple[DataFrame, list[str], list[str]]], base: int, use: Callable[[pa.Array, Block, list[tuple[np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    """``use`` is called for every block of ``docs``: with the ``uid`` of its documents, the block, and for each table the places where n-grams end and their values.

    ``tables`` are staged, each with its words and its columns of scores; values are a row per place, NaN where the table has no such n-gram.
    """
    spark = docs.sparkSession
    rows = sum(table.count() for table, _, _ in tables)
    tokens = docs.agg(F.sum(F.size("input_ids"))).first()[0] or 0
    parts = _next_prime(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PART_ROWS + 1, tokens // PART_TOKENS + 1), base)
    orders = [len(words) for _, words, _ in tables]
    width = [len(values) for _, _, values in tables]
    named = ["kind", "b", "t", "g", "data"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column("input_ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // BLOCK_TOKENS, prepend=-1, append=-1))
            for low, high in zip(cut[:-1].tolist(), cut[1:].tolist()):
                part = batch.slice(low, high - low)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                found: dict[str, list] = {"t": [-1], "g": [-1], "data": [sink.getvalue().to_pybytes()]}
                block = Block(part.column("input_ids"), base)
                for t, n in enumerate(orders):
                    key, starts = _asked(block.grams(n)[1], parts)
                    for g in np.flatnonzero(np.diff(starts)).tolist():
                        found["t"].append(t)
                        found["g"].append(g)
                        found["data"].append(_squeezed(np.diff(key[starts[g] : starts[g + 1]], prepend=0)))
                kind = [_DOCUMENTS] + [_QUESTIONS] * (len(found["t"]) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array([number] * len(kind), pa.int64()), pa.array(found["t"], pa.int32()), pa.array(found["g"], pa.int32()), pa.array(found["data"], pa.binary())], named)
                number += 1

    # Written once: a repeated task could cut other blocks.
    dealt = stage(docs.select("uid", "input_ids").mapInArrow(deal, "kind int, b long, t int, g int, data binary"), "blocks", ["kind"])
    questions = dealt.where(F.col("kind") == _QUESTIONS).select("b", "t", "g", "data")
    none = F.lit(None).cast("double")
    known = None
    for t, (table, words, values) in enumerate(tables):
        columns = [F.col(values[i]).cast("double") if i < len(values) else none for i in range(max(width))]
        one = table.select(F.lit(t).alias("t"), key_of(words, base).alias("key"), *[c.alias(f"v{i}") for i, c in enumerate(columns)])
        known = one if known is None else known.union(one)
    known = known.withColumn("g", F.pmod("key", F.lit(parts).cast("long")).cast("int"))

    def answer(table: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"b": [], "t": [], "g": [], "data": []}
        of = table["t"].to_numpy()
        held = {}
        for t in range(len(orders)):
            own = table.filter(pa.array(of == t))
            key = own["key"].to_numpy()
            order = np.argsort(key)
            held[t] = key[order], [pc.fill_null(own[f"v{i}"], np.nan).to_numpy()[order] for i in range(width[t])]
        for b, t, g, data in zip(*(asked[c].to_pylist() for c in ("b", "t", "g", "data"))):
            key, values = held[t]
            wanted = np.cumsum(_restored(data, "<i8"))
            at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
            hit = key[at] == wanted if len(key) else np.zeros(len(wanted), bool)
            found = [np.where(hit, v[at], np.nan) if len(key) else np.full(len(wanted), np.nan) for v in values]
            out["b"].append(b)
            out["t"].append(t)
            out["g"].append(g)
            out["data"].append(_squeezed(np.concatenate(found)))
        return pa.table([pa.array(out["b"], pa.int64()), pa.array(out["t"], pa.int32()), pa.array(out["g"], pa.int32()), pa.array(out["data"], pa.binary())], ["b", "t", "g", "data"])

    answers = known.groupBy("g").cogroup(questions.groupBy("g")).applyInArrow(answer, "b long, t int, g int, data binary")

    def score(documents: pa.Table, answered: pa.Table) -> pa.Table:
        out = []
        got = {(t, g): data for t, g, data in zip(*(answered[c].to_pylist() for c in ("t", "g", "data")))}
        for data in documents["data"].to_pylist():
            for part in pa.ipc.open_stream(data):
                block = Block(part.column("input_ids"), base)
                values = []
                for t, n in enumerate(orders):
                    ends, key = block.grams(n)
                    asked, starts = _asked(key, parts)
                    pieces = [_restored(got[t, g], "<f8").reshape(width[t], -1).T for g in np.flatnonzero(np.diff(starts)).tolist()]
                    flat = np.concatenate(pieces) if pieces else np.zeros((0, width[t]))
                    order = np.argsort(asked)
                    values.append((ends, flat[order[np.searchsorted(asked[order], key)]]))
                out.extend(use(part.column("uid"), block, values))
        return pa.Table.from_batches(out) if out else pa.table({f.name: [] for f in schema})

    documents = dealt.where(F.col("kind") == _DOCUMENTS).select("b", "data")
    return documents.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(score, schema)


def repeats(docs: DataFrame) -> bool:
    """Whether two documents have the same number."""
    return not docs.where(F.col("uid").isNotNull()).groupBy("uid").agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty()


def evaluated(uid: pa.Array, block: Block, step: int, values: np.ndarray, pad: int) -> pa.RecordBatch:
    """Evaluations of a block's documents from a value per token: those of first tokens are left out, as are all of a document without number."""
    targets = (block.at > 0) & np.repeat(pc.is_valid(uid).to_numpy(zero_copy_only=False), block.size)
    counts = np.where(pc.is_valid(uid).to_numpy(zero_copy_only=False), np.maximum(block.size - 1, 0), 0)
    ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    tokens = block.flat.filter(pa.array(targets)).cast(pa.int32())
    scores = np.where(pc.fill_null(pc.equal(tokens, pad), False).to_numpy(zero_copy_only=False), 0.0, values[targets])
    columns = [uid, pa.array(np.full(len(uid), step), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(scores, pa.float64())), pa.ListArray.from_arrays(ends, tokens)]
    return pa.RecordBatch.from_arrays(columns, ["uid", "step", "token_logprob", "token_ids"])


def evaluations_schema(docs: DataFrame) -> T.StructType:
    long, ids = T.LongType(), T.ArrayType(T.IntegerType())
    return T.StructType([T.StructField("uid", docs.schema["uid"].dataType), T.StructField("step", long), T.StructField("token_logprob", T.ArrayType(T.DoubleType())), T.StructField("token_ids", ids)])
