"""Inputs of the registered queries, derived from the ``documents`` table by Spark.

The words of the documents, ranked by frequency and folded onto a base vocabulary of ``BASE`` ids, form the token
stream; the most frequent adjacent pairs are the ranked merges above the cutoff. Evaluations are scored by a formula
of (uid, pos, tok, step), with the same array shapes a padded scoring run leaves behind. ``ORACLE``
holds the same tables as SQL.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankcut.operators.align import imputed_merges, impute_scores, merges_window, score_offset, tag_rows, token_rows_with_neighbours, trim_docs, trim_evals, window_sized
from rankcut.operators.filters import cutoff_window
from rankcut.operators.occurrences import items_around, packed, staged_occurrences
from rankcut.operators.ordering import row_index
from rankcut.operators.outcomes import occurrence_outcomes
from rankcut.operators.scoring import pair_counts
from rankcut.session import new_path, stage
from rankcut.sources.readers import REGDATA_SCHEMA, read_checkpoints, read_merges_log, spread_scan

BASE = 500
HALF_WIDTH = 200
STEPS = [0, 2000, 4000]
WORD = r"[\p{L}]+|[\p{N}]+"
STAMP = "2026-01-01T00-00-00"
RUNS = ["me57M-tied_corpusa_bpe500", "me57M-tied_corpusa_wordpiece500", "me57M-tied_corpusa_bpe2wp500", "me100M_corpusb-20B_bpe500corpusa"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Up to this many words, the most frequent ones, are shipped to every Python worker.
SHIPPED_WORDS = 1_000_000


# Different words that a task counts before it hands them on.
COUNTED_WORDS = 500_000

_CLASSES: list[np.ndarray] = []


def char_classes(spark: SparkSession) -> np.ndarray:
    """What the engine's own ``WORD`` takes every code point for: 1 a letter, 2 a number, 0 neither."""
    if not _CLASSES:
        one = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        letter, number = (one.rlike(part) for part in WORD.split("+|"))
        points = spark.range(0x110000).where(~F.col("id").between(0xD800, 0xDFFF))  # halves of others
        found = points.select("id", F.when(letter, 1).when(number, 2).alias("c")).where("c > 0").toArrow()
        table = np.zeros(0x110000, np.uint8)
        table[found["id"].to_numpy()] = found["c"].to_numpy()
        _CLASSES.append(table)
    return _CLASSES[0]


def split_words(texts: pa.Array, classes: np.ndarray) -> pa.ListArray:
    """The words of every text; none for a null."""
    none = [pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.string())]
    if not len(texts) or texts.buffers()[2] is None:
        return pa.ListArray.from_arrays(*none)
    offsets = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return pa.ListArray.from_arrays(*none)
    kind = np.where(data < 128, classes[np.minimum(data, 127)], 0).astype(np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    more = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
    point = (data[lead] & (0x3F >> more)).astype(np.int64)
    for k in (1, 2, 3):  # bytes that follow
        at = more >= k
        point[at] = (point[at] << 6) | (data[lead[at] + k] & 0x3F)
    of_lead = classes[point]
    for k in (0, 1, 2, 3):
        kind[lead[more >= k] + k] = of_lead[more >= k]
    word = kind > 0
    first = word.copy()
    first[1:] &= kind[1:] != kind[:-1]
    begin = offsets[:-1][np.diff(offsets) > 0]
    first[begin] = word[begin]
    starts = np.flatnonzero(first)
    before = np.cumsum(word)
    ends = np.append(before[starts] - 1, before[-1]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[word]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets), pa.int32()), words)


def count_words(documents: DataFrame) -> DataFrame:
    """``word, n`` of all texts. Tasks hand on their words with counts, not a row per word."""
    shared = documents.sparkSession.sparkContext.broadcast(char_classes(documents.sparkSession))

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            coded = split_words(batch.column("text"), shared.value).flatten().dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            held.append(pa.table({"word": coded.dictionary, "n": pa.array(n, pa.int64())}))
            if sum(map(len, held)) > COUNTED_WORDS:
                held = [summed(held)]
                if len(held[0]) > COUNTED_WORDS // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from summed(held).to_batches()

    counts = documents.select("text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _ids_in_place(texts: DataFrame, vocab: DataFrame, bound: int) -> DataFrame:
    """``uid, input_ids, rest``: ids of the ``bound`` most frequent words, NULL for the others, which ``rest`` has with their positions.

    ``texts`` have their ``words``, or a ``text`` that is split; texts without words are left out."""
    spark = texts.sparkSession
    known = vocab.where(F.col("id") < bound).select("word", (F.col("id") % BASE).cast("int").alias("tok")).toArrow().combine_chunks()
    split = "words" not in texts.columns
    shared = spark.sparkContext.broadcast((known["word"].combine_chunks(), known["tok"].combine_chunks(), char_classes(spark) if split else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, toks, classes = shared.value
        for batch in batches:
            uid = batch.column("uid").cast(pa.int64())
            found = split_words(batch.column("text"), classes) if split else batch.column("words")
            size = pc.list_value_length(found).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(size[size > 0])])
            coded = found.flatten().dictionary_encode()
            at = pc.index_in(coded.dictionary.cast(names.type), value_set=names).take(coded.indices)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), toks.take(at))
            rare = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
            pos = rare - ends[np.searchsorted(ends, rare, side="right") - 1]
            words = coded.dictionary.take(coded.indices.take(pa.array(rare))).cast(pa.string())
            pairs = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), words], ["pos", "word"])
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, ends), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([uid.filter(pa.array(size > 0)), ids, rest], ["uid", "input_ids", "rest"])

    return texts.mapInArrow(run, "uid long, input_ids array<int>, rest array<struct<pos:int,word:string>>")


def token_arrays(documents: DataFrame, bound: int = SHIPPED_WORDS) -> DataFrame:
    """Words as ids by frequency. The ``bound`` most frequent words are shipped and texts stay where they are; only uses of rarer ones are joined."""
    vocab = stage(row_index(count_words(documents), [F.desc("n"), F.asc("word")], "id"), "vocab")
    rows = _ids_in_place(documents.select(F.col("doc_id").alias("uid"), "text"), vocab, bound)
    none = F.lit(None).cast("array<int>")
    if vocab.count() <= bound:
        parts = rows.select("uid", none.alias("at"), F.col("input_ids").alias("ids"))
    else:
        rows = stage(rows, "known")
        rare = vocab.where(F.col("id") >= bound).select("word", (F.col("id") % BASE).cast("int").alias("tok"))
        uses = rows.select("uid", F.inline("rest")).join(rare.hint("merge"), "word")
        parts = rows.select("uid", none.alias("at"), F.col("input_ids").alias("ids")).unionByName(uses.select("uid", F.array("pos").alias("at"), F.array("tok").alias("ids")))
    # Rare words go to their positions. Documents of equal number are one, by position, then token.
    placed = F.transform("parts", lambda p: F.transform(p["ids"], lambda t, i: F.struct(F.coalesce(F.get(p["at"], i), i).alias("pos"), t.alias("tok"))))
    merged = F.sort_array(F.filter(F.flatten(placed), lambda x: x["tok"].isNotNull()))["tok"]
    merged = F.when(F.size("parts") == 1, F.get("parts", F.lit(0))["ids"]).otherwise(merged)
    return parts.groupBy("uid").agg(F.collect_list(F.struct("at", "ids")).alias("parts")).select("uid", merged.alias("input_ids"))


def pair_merges(docs: DataFrame) -> DataFrame:
    """The most frequent adjacent pairs as a merges log."""
    pairs = pair_counts(docs).groupBy("prev", "tok").agg(F.sum("n").alias("count"))
    best = pairs.orderBy(F.desc("count"), "prev", "tok").limit(HALF_WIDTH)
    rank = F.row_number().over(W.orderBy(F.desc("count"), "prev", "tok"))  # over at most HALF_WIDTH rows
    part_a, part_b = F.concat(F.lit("t"), F.col("prev")), F.concat(F.lit("t"), F.col("tok"))
    return best.withColumn("rank", rank).select(
        F.array("prev", "tok").alias("pair"),
        F.concat(part_a, part_b).alias("new_token"),
        (F.lit(BASE - 1) + F.col("rank")).alias("new_token_id"),
        part_a.alias("part_a"),
        part_b.alias("part_b"),
        "count",
    )


def score_table(spark: SparkSession, step: int, scale: float) -> np.ndarray:
    """The score for every remainder from -996 to 996 of (uid, pos, tok, step); NaN where there is none."""
    mixed = F.col("id")
    score = -(F.log(F.lit(2.0) + mixed) + F.lit(1.0 if step == 0 else 0.0)) * scale
    rows = spark.range(-996, 997).select("id", score.alias("score")).collect()
    return np.array([np.nan if r["score"] is None else r["score"] for r in sorted(rows)])


def eval_arrays(docs: DataFrame, step: int, run_no: int) -> DataFrame:
    """Score arrays of one checkpoint: every third document unpadded (first token unscored), the others padded by 1 or 2."""
    known = score_table(docs.sparkSession, step, 1.0 + 0.1 * run_no)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, ids = batch.column("uid"), batch.column("input_ids")
            uid, missing = pc.fill_null(named, 1 << 40).to_numpy(), pc.is_null(named).to_numpy(zero_copy_only=False)
            size = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = ids.flatten().to_numpy()
            shift = np.where(missing, -1, np.fmod(uid, 3))  # a document without number is neither cut nor padded
            pad, cut = np.maximum(shift, 0), (shift == 0).astype(np.int64)
            length = size - cut + pad
            ends = np.cumsum(length)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length + pad - cut, length)  # place in the document
            real = at >= 0
            tok = np.where(real, flat[np.maximum(np.repeat(np.cumsum(size) - size, length) + at, 0)], 0)
            mixed = np.fmod(np.repeat(uid, length) * 31 + at * 17 + tok.astype(np.int64) * 7 + step, 997)
            score = np.where(real, known[mixed + 996], 0.0)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            none = np.isnan(score) | np.repeat(missing, length)
            scores = pa.ListArray.from_arrays(offsets, pa.array(score, pa.float64(), mask=none))
            yield pa.RecordBatch.from_arrays([named, scores, pa.ListArray.from_arrays(offsets, pa.array(tok, pa.int32()))], ["uid", "token_logprob", "token_ids"])

    return docs.select("uid", "input_ids").mapInArrow(run, "uid long, token_logprob array<double>, token_ids array<int>")


class Fixture:
    """Staged inputs of one data folder; every member is a table on disk, written when it is first read."""

    def __init__(self, documents: DataFrame) -> None:
        self.documents, self.spark = documents, documents.sparkSession
        self._evals_path = new_path(self.spark, "evals")
        self._run_paths: list[str] = []  # score files by run, as far as they have been written

    @cached_property
    def docs(self) -> DataFrame:
        return stage(token_arrays(spread_scan(self.documents)), "docs")

    @cached_property
    def merges_path(self) -> str:
        path = new_path(self.spark, "merges.jsonl")
        pair_merges(self.docs).write.json(path)
        return path

    def _write_runs(self, runs: int) -> None:
        for run_no in range(len(self._run_paths), runs):
            path = f"{self._evals_path}/{RUNS[run_no]}_{STAMP}"
            for step in STEPS:
                eval_arrays(self.docs, step, run_no).write.parquet(f"{path}/step{step}_{STAMP}")
            self._run_paths.append(path)

    @property
    def evals_path(self) -> str:
        """Evaluations of two runs."""
        self._write_runs(2)
        return self._evals_path

    @cached_property
    def regdata_path(self) -> str:
        path = new_path(self.spark, "regdata")
        items = items_around(self.merges, BASE, HALF_WIDTH)
        base = stage(occurrence_outcomes(staged_occurrences(*packed(self.docs, self.evals, items), items), BASE), "outcomes")
        for run_no, run in enumerate(RUNS):
            shifted = base.withColumn("mean", F.col("mean") + F.when(F.col("treat"), 0.25 * run_no).otherwise(0.0))
            shifted.write.parquet(f"{path}/{run}.parquet")
        return path

    @property
    def log(self) -> DataFrame:
        return read_merges_log(self.spark, self.merges_path)

    @property
    def evals(self) -> DataFrame:
        """Evaluations of the first run."""
        self._write_runs(1)
        return read_checkpoints(self.spark, f"{self._run_paths[0]}/*/*.parquet")

    @property
    def merges(self) -> DataFrame:
        return imputed_merges(merges_window(self.log, BASE, HALF_WIDTH), BASE)

    @property
    def trimmed(self) -> DataFrame:
        return trim_evals(self.evals, self.docs)

    @property
    def aligned_docs(self) -> DataFrame:
        return trim_docs(self.docs, self.evals)

    @property
    def tagged(self) -> DataFrame:
        return self.tagged_tokens(self.docs)

    def tagged_tokens(self, docs: DataFrame) -> DataFrame:
        """``docs`` as tagged tokens; a layout by ``uid`` is kept."""
        return tag_rows(token_rows_with_neighbours(trim_docs(docs, self.evals)), window_sized(self.merges, HALF_WIDTH))

    @property
    def scores(self) -> DataFrame:
        return impute_scores(score_offset(self.evals, self.docs), cutoff_window(self.tagged, "tok", BASE, HALF_WIDTH))

    @property
    def outcomes(self) -> DataFrame:
        """Regression data of the first run."""
        return self.spark.read.schema(REGDATA_SCHEMA).parquet(f"{self.regdata_path}/{RUNS[0]}.parquet")


_BUILT: dict[tuple[str, str], Fixture] = {}


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    """Once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = Fixture(table(spark, sf_dir, "documents"))
    return _BUILT[key]


_SCORE = (
    "-(ln(2e0 + (uid*31 + pos*17 + tok*7 + step) % 997) + CASE WHEN step = 0 THEN 1e0 ELSE 0e0 END)"
)

# The same tables for the SQL check: name -> SQL over the given tables and the names before it.
ORACLE: dict[str, str] = {
    "fx_words": r"""SELECT doc_id AS uid, CAST(i-1 AS BIGINT) AS pos, ws[i] AS word
      FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}]+|[\p{N}]+') ws FROM documents),
      LATERAL (SELECT unnest(range(1, len(ws)+1)) AS i)""",
    "fx_vocab": "SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS id, count(*) AS n FROM fx_words GROUP BY word",
    "fx_docs": f"SELECT w.uid, w.pos, CAST(v.id % {BASE} AS BIGINT) AS tok FROM fx_words w JOIN fx_vocab v ON w.word = v.word",
    "fx_len": "SELECT uid, count(*) AS n FROM fx_docs GROUP BY uid",
    "fx_merges": f"""SELECT tok_a, tok_b, {BASE - 1} + rk AS tok, n AS count FROM (
      SELECT tok AS tok_a, nx AS tok_b, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tok, nx) AS rk
      FROM (SELECT tok, lead(tok) OVER (PARTITION BY uid ORDER BY pos) AS nx FROM fx_docs) q
      WHERE nx IS NOT NULL GROUP BY tok, nx) z WHERE rk <= {HALF_WIDTH}""",
    "fx_steps": "SELECT unnest([0, 2000, 4000]) AS step",
    "fx_raw": f"""SELECT uid, step, pos - 1 AS i, tok, {_SCORE} AS logprob FROM fx_docs CROSS JOIN fx_steps WHERE uid % 3 = 0 AND pos > 0
      UNION ALL SELECT uid, step, pos + uid % 3, tok, {_SCORE} FROM fx_docs CROSS JOIN fx_steps WHERE uid % 3 > 0
      UNION ALL SELECT uid, step, k, 0, 0e0 FROM fx_len CROSS JOIN fx_steps, LATERAL (SELECT unnest(range(0, uid % 3)) AS k) WHERE uid % 3 > 0""",
    "fx_trim": "SELECT uid, CASE WHEN uid % 3 = 0 THEN pos - 1 ELSE pos END AS pos, pos AS doc_pos, tok FROM fx_docs WHERE NOT (uid % 3 = 0 AND pos = 0)",
    "fx_ev": f"""SELECT uid, step, tpos AS pos, tok, {_SCORE} AS logprob
      FROM (SELECT uid, pos AS tpos, doc_pos AS pos, tok FROM fx_trim) t CROSS JOIN fx_steps""",
    "fx_tag": """SELECT uid, pos AS og_pos, tok AS og_tok, coalesce(a, pa, tok) AS tok, CASE WHEN pa IS NOT NULL THEN pos-1 ELSE pos END AS pos
      FROM (SELECT *, lag(a) OVER (PARTITION BY uid ORDER BY pos) AS pa FROM (
      SELECT d.uid, d.pos, d.tok, m.tok AS a
      FROM (SELECT *, lead(tok) OVER (PARTITION BY uid ORDER BY pos) AS nx FROM fx_trim) d
      LEFT JOIN fx_merges m ON d.tok = m.tok_a AND d.nx = m.tok_b) x) y""",
    "fx_imp": f"""SELECT e.step, t.uid, t.tok, t.pos, t.og_tok, t.og_pos, e.logprob
      FROM fx_ev e JOIN fx_tag t ON e.uid = t.uid AND e.pos = t.og_pos AND e.tok = t.og_tok
      WHERE t.tok >= {BASE - HALF_WIDTH} AND t.tok < {BASE + HALF_WIDTH}""",
    "fx_occ": "SELECT step, uid, tok, pos, sum(logprob) AS s FROM fx_imp GROUP BY step, uid, tok, pos",
    "fx_out": f"""SELECT step, tok, max(s) FILTER (rn = floor((n-1)*0.5e0 + 0.5e0)) AS median, avg(s) AS mean, stddev_samp(s) AS std,
      max(s) FILTER (rn = floor((n-1)*0.75e0 + 0.5e0)) - max(s) FILTER (rn = floor((n-1)*0.25e0 + 0.5e0)) AS iqr,
      count(*) AS num, tok < {BASE} AS treat
      FROM (SELECT *, row_number() OVER (PARTITION BY step, tok ORDER BY s) - 1 AS rn, count(*) OVER (PARTITION BY step, tok) AS n FROM fx_occ) q
      GROUP BY step, tok""",
    "fx_runs": """SELECT * FROM (VALUES (0, 'me57M-tied_corpusa_bpe500', '57M-tied', 'bpe'), (1, 'me57M-tied_corpusa_wordpiece500', '57M-tied', 'wordpiece'),
      (2, 'me57M-tied_corpusa_bpe2wp500', '57M-tied', 'bpe2wp'), (3, 'me100M_corpusb-20B_bpe500corpusa', '100M', 'bpe')) t(run_no, run, model_size, tokenizer)""",
    "fx_reg": """SELECT run, model_size, tokenizer, 500 AS vocab_size, step, tok, median,
      mean + CASE WHEN treat THEN 0.25e0 * run_no ELSE 0e0 END AS mean, std, iqr, num, treat FROM fx_out CROSS JOIN fx_runs""",
    "fx_long": """SELECT model_size, vocab_size, tokenizer, step, tok, treat, target, value,
      tok / 1000e0 AS x, CAST(treat AS DOUBLE) AS t FROM
      (UNPIVOT (SELECT * FROM fx_reg) ON mean, median, std, iqr INTO NAME target VALUE value) WHERE value IS NOT NULL""",
    "fx_mid": """SELECT *, x - avg(x) OVER c AS dx, t - avg(t) OVER c AS dt, value - avg(value) OVER c AS dy, count(*) OVER c AS n FROM fx_long
      WINDOW c AS (PARTITION BY model_size, vocab_size, tokenizer, step, target)""",
    "fx_sums": """SELECT model_size, vocab_size, tokenizer, step, target, count(*) AS n, avg(x) AS mx, avg(t) AS mt, avg(value) AS my,
      sum(dx*dx) AS sxx, sum(dx*dt) AS sxt, sum(dt*dt) AS stt, sum(dx*dy) AS sxy, sum(dt*dy) AS sty, sum(dy*dy) AS syy
      FROM fx_mid GROUP BY ALL""",
    "fx_coef": """SELECT *, (sxy*stt - sty*sxt)/(sxx*stt - sxt*sxt) AS slope, (sty*sxx - sxy*sxt)/(sxx*stt - sxt*sxt) AS ate,
      sxx*stt - sxt*sxt AS det FROM fx_sums""",
    "fx_eff": """SELECT c.model_size, c.vocab_size, c.tokenizer, c.step, c.target, any_value(c.n) AS n, any_value(c.slope) AS slope, any_value(c.ate) AS ate,
      any_value(c.my - c.slope*c.mx - c.ate*c.mt) AS intercept,
      1 - sum(e*e)/any_value(c.syy) AS r2,
      sqrt(sum(e*e*z*z) * any_value(c.n)/(any_value(c.n)-3)) AS se
      FROM (SELECT m.*, c.slope, c.ate, c.sxx, c.syy, c.mx, c.mt, c.my, m.dy - c.slope*m.dx - c.ate*m.dt AS e, (c.sxx*m.dt - c.sxt*m.dx)/c.det AS z
      FROM fx_mid m JOIN fx_coef c USING (model_size, vocab_size, tokenizer, step, target)) c GROUP BY ALL""",
    "fx_ce": """SELECT r.tokenizer, 500 AS vocab_size, step, r.model_size, -avg(m * (1 + 0.1e0 * r.run_no)) AS token_logprob
      FROM (SELECT uid, step, avg(logprob) AS m FROM fx_raw GROUP BY uid, step) q, fx_runs r WHERE r.run_no < 2 GROUP BY ALL""",
}


_SHARED = {"fx_docs", "fx_tag", "fx_occ", "fx_out", "fx_reg", "fx_long", "fx_mid", "fx_coef", "fx_eff"}


def with_tables(sql: str) -> str:
    """Prepend the fixture tables a statement needs, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in ORACLE.items():
            if name not in needed and _mentions(text, name):
                needed.add(name)
                visit(body)

    visit(sql)
    # The large tables are computed once, however often a statement reads them.
    ctes = [f"{name} AS {'MATERIALIZED ' if name in _SHARED else ''}({body})" for name, body in ORACLE.items() if name in needed]
    if not ctes:
        return sql
    head = "WITH RECURSIVE " + ",\n".join(ctes)
    return f"{head}\n{sql}"


def _mentions(text: str, name: str) -> bool:
    at = text.find(name)
    while at >= 0:
        end = at + len(name)
        if end == len(text) or not (text[end].isalnum() or text[end] == "_"):
            return True
        at = text.find(name, end)
    return False
