"""Sources, sinks, projections, filters, joins, aggregates, windows, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.functions import arrays as A
from rankcut.functions import names as N
from rankcut.functions import strings as S
from rankcut.operators import align, filters, ordering, outcomes, quantiles, regress, vocab
from rankcut.operators.encode import split_order
from rankcut.operators.labels import TOKENIZER_NAMES
from rankcut.plans.catalog import on_documents, on_fixture
from rankcut.plans.fixtures import BASE, HALF_WIDTH, RUNS, STAMP, Fixture
from rankcut.session import layouts_kept, new_path, stage
from rankcut.sources import arrow_folder, readers, writers

KEYS = ["model_size", "vocab_size", "tokenizer", "step"]
SIZES = {500: "0.5k"}
SPLITS = ["train", "validation", "test"]
SPLIT_SQL = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"


def runs(fx: Fixture) -> DataFrame:
    """Regression data of all runs, labelled from the file names."""
    return readers.read_runs(fx.spark, *[f"{fx.regdata_path}/{r}.parquet" for r in RUNS], schema=readers.REGDATA_SCHEMA)


def effects(fx: Fixture) -> DataFrame:
    return regress.effect_table(runs(fx), KEYS)


def losses(fx: Fixture) -> DataFrame:
    rows = writers.consolidated(fx.spark, fx.evals_path)
    labelled = rows.withColumn("_l", N.parse_run_name(F.col("run"))).select("*", "_l.*").drop("_l")
    return outcomes.cross_entropy(labelled, ["tokenizer", "vocab_size", "step", "model_size"])


def chain(fx: Fixture) -> DataFrame:
    """Merges where every fifth one is built from an earlier merge."""
    rank = F.col("tok") - (BASE - 1)
    built = (F.lit(BASE) + F.floor((F.col("tok") - BASE) / 5)).cast("long")
    return align.merges_window(fx.log, BASE, HALF_WIDTH).withColumn("tok_a", F.when(rank % 5 == 0, built).otherwise(F.col("tok_a")))


CHAIN = "(SELECT tok, CASE WHEN (tok - 499) % 5 = 0 THEN 500 + (tok - 500) // 5 ELSE tok_a END AS tok_a, tok_b FROM fx_merges)"
PARTS = f"""(SELECT m.tok, n.tok AS tok_new FROM {CHAIN} m JOIN {CHAIN} n ON m.tok = n.tok_a WHERE m.tok < 600
  UNION ALL SELECT m.tok, n.tok FROM {CHAIN} m JOIN {CHAIN} n ON m.tok = n.tok_b WHERE m.tok < 600)"""
RUN_ROWS = "(SELECT run, model_size, tokenizer, run_no FROM fx_runs)"


# --- sources and sinks ---------------------------------------------------------------------------


@on_documents("src01_parquet_scan", "SELECT doc_id, lang, source FROM documents WHERE n_chars >= 1000")
def _(docs):
    return docs.where(F.col("n_chars") >= 1000).select("doc_id", "lang", "source")


@on_fixture(
    "src02_glob_with_path",
    "SELECT run, tokenizer, CAST(vocab_size AS BIGINT) AS vocab_size, model_size, count(*) AS n_rows FROM fx_reg GROUP BY ALL",
)
def _(fx):
    rows = readers.read_runs(fx.spark, f"{fx.regdata_path}/*.parquet", schema=readers.REGDATA_SCHEMA)
    return rows.groupBy("run", "tokenizer", F.col("vocab_size").cast("long").alias("vocab_size"), "model_size").agg(F.count("*").alias("n_rows"))


@on_fixture(
    "src03_merges_log",
    "SELECT tok, tok_a, tok_b, 't' || tok_a || 't' || tok_b AS new_token, count AS n FROM fx_merges",
)
def _(fx):
    return fx.log.select(
        F.col("new_token_id").cast("long").alias("tok"),
        F.col("pair")[0].cast("long").alias("tok_a"),
        F.col("pair")[1].cast("long").alias("tok_b"),
        "new_token",
        F.col("count").alias("n"),
    )


@on_documents("src04_arrow_folder", "SELECT doc_id, lang, n_chars, octet_length(encode(text))::BIGINT AS n_bytes FROM documents")
def _(docs):
    """Written as Arrow files; of the columns only those of the schema are read back."""
    path = new_path(docs.sparkSession, "arrow")
    arrow_folder.write_arrow_folder(docs, path)
    rows = arrow_folder.read_arrow_folder(docs.sparkSession, path, "doc_id long, lang string, n_chars long, text string")
    return rows.select("doc_id", "lang", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"))


@on_documents("src05_bounded_read", "SELECT text FROM documents ORDER BY doc_id LIMIT 500")
def _(docs):
    return readers.read_corpus(docs, [F.col("doc_id")], 500)


@on_documents("src06_splits", f"SELECT {SPLIT_SQL} AS split, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ALL")
def _(docs):
    rest = F.col("doc_id") % 10
    named = {"train": docs.where(rest > 1), "validation": docs.where(rest == 1), "test": docs.where(rest == 0)}
    return readers.with_splits(named).groupBy("split").agg(
        F.count("*").alias("n_docs"), F.sum("n_chars").cast("long").alias("n_chars")
    )


@on_fixture(
    "src07_vocab_document",
    """SELECT 'vocab' AS kind, tok AS idx, 't' || tok AS entry FROM (SELECT DISTINCT tok FROM fx_docs)
       UNION ALL SELECT 'vocab', tok, 't' || tok_a || 't' || tok_b FROM fx_merges
       UNION ALL SELECT 'merges', tok - 500, 't' || tok_a || ' t' || tok_b FROM fx_merges""",
)
def _(fx):
    base = align.token_rows(fx.docs).select("tok").distinct().select(F.concat(F.lit("t"), "tok").alias("token"), F.col("tok").cast("int").alias("id"))
    log = fx.log.select(F.col("new_token").alias("token"), F.col("new_token_id").alias("id"))
    # The document lists one vocabulary, at most BASE + HALF_WIDTH entries.
    entries = base.unionByName(log).agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("vocab"))
    ranked = F.sort_array(F.collect_list(F.struct("new_token_id", F.concat_ws(" ", "part_a", "part_b").alias("m"))))
    merges = fx.log.agg(ranked["m"].alias("merges"))
    model = F.struct(F.lit("BPE").alias("type"), F.lit(entries.scalar()).alias("vocab"), F.lit(merges.scalar()).alias("merges"))
    path = new_path(fx.spark, "tokenizer.json")
    fx.spark.range(1).select(F.to_json(F.struct(model.alias("model")))).write.text(path)
    vocab_rows, merge_rows = readers.read_vocab_document(fx.spark, path)
    return vocab_rows.select(F.lit("vocab").alias("kind"), F.col("id").cast("long").alias("idx"), F.col("token").alias("entry")).unionByName(
        merge_rows.select(F.lit("merges").alias("kind"), F.col("rank").cast("long").alias("idx"), F.col("merge").alias("entry"))
    )


@on_fixture("snk01_parquet_write", "SELECT step, tok, round(mean, 6) AS mean, num FROM fx_out")
def _(fx):
    path = new_path(fx.spark, "regdata.parquet")
    writers.write_parquet(fx.outcomes, path)
    return readers.scan_parquet(fx.spark, path).select("step", "tok", "mean", "num")


@on_fixture("snk02_streamed_sink", "SELECT step, count(DISTINCT uid) AS n_docs, count(*) AS n_scores FROM fx_ev GROUP BY step")
def _(fx):
    path = new_path(fx.spark, "trimmed.parquet")
    writers.write_parquet(fx.trimmed, path, partition_by=["step"])
    n = F.size("token_ids")
    return (
        readers.scan_parquet(fx.spark, path)
        .groupBy(F.col("step").cast("long").alias("step"))
        .agg(F.count(F.when(n > 0, 1)).alias("n_docs"), F.sum(n).cast("long").alias("n_scores"))
    )


CONSOLIDATED = f"""SELECT r.run, e.step, count(DISTINCT uid) FILTER (n > 0) AS n_docs, sum(n)::BIGINT AS n_scores, round(sum(s * (1 + 0.1e0 * run_no)), 6) AS total
  FROM (SELECT step, uid, count(*) AS n, sum(logprob) AS s FROM fx_raw GROUP BY step, uid) e, {RUN_ROWS} r WHERE run_no < 2 GROUP BY ALL"""


def consolidated_summary(rows: DataFrame) -> DataFrame:
    n = F.size("token_ids")
    total = F.aggregate("token_logprob", F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("run", F.col("step").cast("long").alias("step")).agg(
        F.count(F.when(n > 0, 1)).alias("n_docs"), F.sum(n).cast("long").alias("n_scores"), F.sum(total).alias("total")
    )


@on_fixture("snk03_consolidate_checkpoints", CONSOLIDATED)
def _(fx):
    path = new_path(fx.spark, "evals")
    writers.export_evals(fx.spark, fx.evals_path, path)
    return consolidated_summary(readers.scan_parquet(fx.spark, path))


@on_fixture(
    "snk04_write_configurations",
    "SELECT 'bpe500corpusa' AS tok_name, CASE WHEN uid % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM fx_len GROUP BY ALL",
)
def _(fx):
    path = new_path(fx.spark, "corpus")
    split = F.when(F.col("uid") % 10 == 0, "test").otherwise("train")
    writers.write_config(fx.docs.withColumn("split", split), path, "bpe500corpusa")
    rows = readers.scan_parquet(fx.spark, path)
    return rows.groupBy("tok_name", "split").agg(F.count("*").alias("n_docs"), F.sum(F.size("input_ids")).cast("long").alias("n_tokens"))


@on_fixture("snk05_append_batches", "SELECT step, count(*) AS n_rows FROM (SELECT DISTINCT uid, step FROM fx_len CROSS JOIN fx_steps) GROUP BY step")
def _(fx):
    path = new_path(fx.spark, "appended")
    for step in (0, 2000, 4000):
        writers.append_batches(fx.evals.where(F.col("step") == step), path)
    return readers.scan_parquet(fx.spark, path).groupBy("step").agg(F.count("*").alias("n_rows"))


# --- projections and filters ---------------------------------------------------------------------


@on_fixture("prj01_select_rename", "SELECT step, tok AS item, round(mean, 6) AS outcome FROM fx_out")
def _(fx):
    return fx.outcomes.drop("median", "std", "iqr", "num", "treat").withColumnsRenamed({"tok": "item", "mean": "outcome"})


@on_fixture("prj02_computed_columns", "SELECT step, tok, round(mean * num, 6) AS total, round(std / sqrt(num), 6) AS mean_error FROM fx_out")
def _(fx):
    return fx.outcomes.withColumns({"total": F.col("mean") * F.col("num"), "mean_error": F.col("std") / F.sqrt("num")}).select(
        "step", "tok", "total", "mean_error"
    )


@on_fixture("prj03_cast", "SELECT step, CAST(tok AS INTEGER) AS tok_int, CAST(treat AS VARCHAR) AS treat, CAST(num AS DOUBLE) AS num FROM fx_out")
def _(fx):
    return fx.outcomes.select("step", F.col("tok").cast("int").alias("tok_int"), F.col("treat").cast("string").alias("treat"), F.col("num").cast("double").alias("num"))


@on_fixture(
    "prj04_conditional_override",
    "SELECT model_size, vocab_size, tokenizer, step, target, round(CASE WHEN step = 0 AND ate < 3 THEN 12 ELSE ate END, 6) AS ate FROM fx_eff",
)
def _(fx):
    rows = effects(fx).select(*KEYS, "target", "ate")
    return filters.override(rows, "ate", (F.col("step") == 0) & (F.col("ate") < 3), F.lit(12.0))


@on_fixture("flt01_conjunction", "SELECT tokenizer, step, tok, round(mean, 6) AS mean FROM fx_reg WHERE tokenizer = 'bpe' AND step = 2000 AND model_size = '57M-tied'")
def _(fx):
    rows = runs(fx).where((F.col("tokenizer") == "bpe") & (F.col("step") == 2000) & (F.col("model_size") == "57M-tied"))
    return rows.select("tokenizer", "step", "tok", "mean")


@on_fixture("flt02_cutoff_window", "SELECT step, tok, num FROM fx_out WHERE tok >= 450 AND tok < 550")
def _(fx):
    return filters.cutoff_window(fx.outcomes, "tok", BASE, 50).select("step", "tok", "num")


@on_fixture("flt03_above_cutoff", "SELECT step, tok, num FROM fx_out WHERE tok >= 500")
def _(fx):
    return filters.above_cutoff(fx.outcomes, "tok", BASE).select("step", "tok", "num")


@on_fixture("flt04_literal_list", "SELECT run, step, tok FROM fx_reg WHERE tokenizer IN ('bpe', 'bpe2wp') AND model_size NOT IN ('100M-tied', '100M')")
def _(fx):
    rows = runs(fx).where(F.col("tokenizer").isin("bpe", "bpe2wp") & ~F.col("model_size").isin("100M-tied", "100M"))
    return rows.select("run", "step", "tok")


SPARSE = """(SELECT step, uid, tok, stddev_samp(s) AS std, max(s) - min(s) AS width, CASE WHEN count(*) > 2 THEN avg(s) END AS mean FROM fx_occ GROUP BY ALL)"""


def sparse(fx: Fixture) -> DataFrame:
    """Spread per document and item: NULL where an item occurs once, a mean only from three occurrences on."""
    v = F.col("logprob")
    rows = outcomes.occurrence_scores(fx.scores).groupBy("step", "uid", "tok")
    return rows.agg(F.stddev_samp(v).alias("std"), (F.max(v) - F.min(v)).alias("width"), F.when(F.count("*") > 2, F.avg(v)).alias("mean"))


@on_fixture("flt05_null_test", f"SELECT step, uid, tok FROM {SPARSE} q WHERE std IS NOT NULL")
def _(fx):
    return sparse(fx).where(F.col("std").isNotNull()).select("step", "uid", "tok")


@on_fixture("flt06_drop_incomplete", f"SELECT step, uid, tok, round(std, 6) AS std FROM {SPARSE} q WHERE std IS NOT NULL AND width > 0")
def _(fx):
    # An item without spread gets NaN here, so that both kinds of gaps occur.
    ratio = F.when(F.col("width") > 0, F.col("std") / F.col("width")).otherwise(F.lit(float("nan")))
    return filters.drop_incomplete(sparse(fx).withColumn("ratio", ratio), ["std", "ratio"]).select("step", "uid", "tok", "std")


@on_fixture("flt07_global_max", "SELECT run, step, tok, num FROM fx_reg WHERE step = (SELECT max(step) FROM fx_reg) AND tokenizer = 'bpe'")
def _(fx):
    return filters.at_global_max(runs(fx), "step").where(F.col("tokenizer") == "bpe").select("run", "step", "tok", "num")


# --- joins and sets ------------------------------------------------------------------------------


@on_fixture("joi01_inner_renamed_key", f"SELECT m.tok, n.tok AS tok_new FROM {CHAIN} m JOIN {CHAIN} n ON m.tok = n.tok_a WHERE m.tok < 600")
def _(fx):
    m = chain(fx)
    return m.where(F.col("tok") < 600).select("tok").join(m.select(F.col("tok_a").alias("tok"), F.col("tok").alias("tok_new")), "tok")


@on_fixture(
    "joi02_left_join",
    "SELECT e.uid, e.step, l.n AS len FROM (SELECT DISTINCT uid, step FROM fx_len CROSS JOIN fx_steps) e LEFT JOIN (SELECT * FROM fx_len WHERE n >= 20 AND uid % 7 > 0) l ON e.uid = l.uid",
)
def _(fx):
    lengths = fx.docs.select("uid", F.size("input_ids").cast("long").alias("len")).where("len >= 20 and uid % 7 > 0")
    return fx.evals.select("uid", "step").join(lengths, "uid", "left")


@on_fixture(
    "joi03_pair_lookup",
    """SELECT d.tok, count(*) AS n, count(m.tok) AS n_pairs FROM (SELECT *, lead(tok) OVER (PARTITION BY uid ORDER BY pos) AS nx FROM fx_docs) d
       LEFT JOIN fx_merges m ON d.tok = m.tok_a AND d.nx = m.tok_b GROUP BY d.tok""",
)
def _(fx):
    pairs = align.window_sized(fx.merges.select(F.col("tok_a").alias("tok"), F.col("tok_b").alias("next"), F.col("tok").alias("merged")), HALF_WIDTH)
    rows = align.token_rows_with_neighbours(fx.docs).join(pairs, ["tok", "next"], "left")
    return rows.groupBy("tok").agg(F.count("*").alias("n"), F.count("merged").alias("n_pairs"))


@on_fixture(
    "joi04_shifted_self_join",
    "SELECT tok, count(*) AS n, count(*) FILTER (pos <> og_pos) AS n_second FROM fx_tag GROUP BY tok",
)
def _(fx):
    stream = align.token_rows(fx.aligned_docs)
    rows = align.tag_pairs(stream, align.window_sized(fx.merges, HALF_WIDTH))
    return rows.groupBy("tok").agg(F.count("*").alias("n"), F.count(F.when(F.col("pos") != F.col("og_pos"), 1)).alias("n_second"))


@on_fixture("joi05_three_keys", "SELECT step, tok, count(*) AS n, round(sum(logprob), 6) AS total FROM fx_imp GROUP BY step, tok")
def _(fx):
    # Arrays are dealt by uid, once; their tokens then meet by all three keys where they lie.
    docs, evals = fx.docs.repartition("uid"), fx.evals.repartition("uid")
    wanted = filters.cutoff_window(fx.tagged_tokens(docs), "tok", BASE, HALF_WIDTH)
    scored = A.explode_together(align.trim_evals(evals, fx.docs).drop("offset"), ["token_logprob", "token_ids"], "og_pos")
    on = ["uid", "og_tok", "og_pos"]
    rows = scored.withColumn("og_tok", F.col("token_ids").cast("long")).join(wanted, on)
    totals = rows.groupBy("step", "tok").agg(F.count("*").alias("n"), F.sum("token_logprob").alias("total"))
    with layouts_kept(fx.spark):
        return stage(totals, "totals")


@on_fixture(
    "joi06_four_keys",
    "SELECT model_size, tokenizer, step, target, round(ate, 6) AS ate, round(token_logprob, 6) AS loss FROM fx_ce JOIN fx_eff USING (model_size, vocab_size, tokenizer, step)",
)
def _(fx):
    rows = losses(fx).join(effects(fx), ["tokenizer", "vocab_size", "step", "model_size"])
    return rows.select("model_size", "tokenizer", "step", "target", "ate", F.col("token_logprob").alias("loss"))


@on_fixture(
    "joi07_left_four_keys",
    "SELECT model_size, tokenizer, step, target, round(ate, 6) AS ate, round(token_logprob, 6) AS loss FROM fx_eff LEFT JOIN fx_ce USING (model_size, vocab_size, tokenizer, step)",
)
def _(fx):
    rows = effects(fx).join(losses(fx), ["tokenizer", "vocab_size", "step", "model_size"], "left")
    return rows.select("model_size", "tokenizer", "step", "target", "ate", F.col("token_logprob").alias("loss"))


@on_fixture("joi08_anti_join", f"SELECT tok, tok_a, tok_b FROM {CHAIN} c WHERE NOT EXISTS (SELECT 1 FROM {PARTS} p WHERE p.tok = c.tok)")
def _(fx):
    return align.drop_components(chain(fx), 600).select("tok", "tok_a", "tok_b")


@on_fixture("set01_union_all", f"SELECT tok, tok_new FROM {PARTS}")
def _(fx):
    return align.component_audit(chain(fx), 600)


# --- aggregation ---------------------------------------------------------------------------------


@on_fixture("agg01_group_sum", "SELECT step, uid, tok, pos, round(s, 6) AS logprob FROM fx_occ")
def _(fx):
    return outcomes.occurrence_scores(fx.scores)


@on_fixture("agg02_mean", "SELECT step, tok, round(avg(s), 6) AS mean FROM fx_occ GROUP BY step, tok")
def _(fx):
    return outcomes.occurrence_scores(fx.scores).groupBy("step", "tok").agg(F.avg("logprob").alias("mean"))


@on_fixture("agg03_sample_std", f"SELECT step, uid, tok, round(std, 6) AS std FROM {SPARSE} q")
def _(fx):
    return sparse(fx).select("step", "uid", "tok", "std")


@on_fixture("agg04_quantile_nearest", "SELECT step, tok, n, round(max(s) FILTER (rn = floor((n-1)*0.25e0 + 0.5e0)), 6) AS q25, round(max(s) FILTER (rn = floor((n-1)*0.5e0 + 0.5e0)), 6) AS q50, round(max(s) FILTER (rn = floor((n-1)*0.75e0 + 0.5e0)), 6) AS q75 FROM (SELECT *, row_number() OVER (PARTITION BY step, tok ORDER BY s) - 1 AS rn, count(*) OVER (PARTITION BY step, tok) AS n FROM fx_occ) q GROUP BY step, tok, n")
def _(fx):
    rows = stage(outcomes.occurrence_scores(fx.scores), "occurrences")
    return quantiles.nearest_quantiles(rows, ["step", "tok"], "logprob", {"q25": 0.25, "q50": 0.5, "q75": 0.75})


@on_fixture(
    "agg04_quantile_linear",
    """SELECT step, tok, n, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.9), 6) AS q90
       FROM (SELECT *, count(*) OVER (PARTITION BY step, tok) AS n FROM fx_occ) q GROUP BY step, tok, n""",
)
def _(fx):
    rows = stage(outcomes.occurrence_scores(fx.scores), "occurrences")
    return quantiles.linear_quantiles(rows, ["step", "tok"], "logprob", {"median": 0.5, "q25": 0.25, "q90": 0.9})


@on_fixture("agg05_count", "SELECT step, tok, count(*) AS num FROM fx_occ GROUP BY step, tok")
def _(fx):
    return outcomes.occurrence_scores(fx.scores).groupBy("step", "tok").agg(F.count("*").alias("num"))


@on_fixture("agg06_iqr", "SELECT step, tok, round(iqr, 6) AS iqr FROM fx_out")
def _(fx):
    scores = stage(outcomes.occurrence_scores(fx.scores), "occurrences")
    rows = quantiles.nearest_quantiles(scores, ["step", "tok"], "logprob", {"q25": 0.25, "q75": 0.75})
    return rows.select("step", "tok", (F.col("q75") - F.col("q25")).alias("iqr"))


@on_fixture("agg07_min_max", "SELECT step, treat, min(tok) AS lo, max(tok) AS hi, round(min(mean), 6) AS worst, round(max(mean), 6) AS best FROM fx_out GROUP BY step, treat")
def _(fx):
    return fx.outcomes.groupBy("step", "treat").agg(F.min("tok").alias("lo"), F.max("tok").alias("hi"), F.min("mean").alias("worst"), F.max("mean").alias("best"))


@on_fixture("agg08_distinct_list", "SELECT run, string_agg(step, ',' ORDER BY step) AS steps FROM (SELECT DISTINCT run, step FROM fx_reg) GROUP BY run")
def _(fx):
    steps = runs(fx).select("run", "step").distinct()
    return steps.groupBy("run").agg(F.array_join(F.sort_array(F.collect_set("step")), ",").alias("steps"))


@on_fixture("agg09_first", "SELECT step, treat, arg_min(num, tok) AS first_num FROM fx_out GROUP BY step, treat")
def _(fx):
    return fx.outcomes.groupBy("step", "treat").agg(F.min_by("num", "tok").alias("first_num"))


@on_fixture("agg10_two_level", "SELECT step, tok, round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std, round(iqr, 6) AS iqr, num, treat FROM fx_out")
def _(fx):
    return outcomes.outcome_table(fx.scores, BASE)


@on_fixture(
    "agg11_pivot",
    """SELECT tokenizer, step, count(*) FILTER (model_size = '57M-tied') AS small, nullif(count(*) FILTER (model_size = '100M'), 0) AS large
       FROM fx_reg GROUP BY tokenizer, step""",
)
def _(fx):
    counts = runs(fx).groupBy("tokenizer", "step", "model_size").agg(F.count("*").alias("len"))
    wide = counts.groupBy("tokenizer", "step").pivot("model_size", ["57M-tied", "100M"]).agg(F.first("len"))
    return wide.withColumnsRenamed({"57M-tied": "small", "100M": "large"})


@on_fixture("agg12_distinct_sorted", "SELECT DISTINCT model_size, tokenizer, step FROM fx_reg ORDER BY ALL")
def _(fx):
    return runs(fx).select("model_size", "tokenizer", "step").distinct().orderBy("model_size", "tokenizer", "step")


@on_fixture(
    "agg13_cell_lists",
    "SELECT run, step, count(*) AS n, string_agg(tok, ',' ORDER BY tok) AS toks, string_agg(num, ',' ORDER BY tok) AS nums FROM fx_reg GROUP BY run, step",
)
def _(fx):
    # A cell has one row per item of the cutoff window, at most 2 * HALF_WIDTH.
    rows = F.sort_array(F.collect_list(F.struct("tok", "num")))
    cells = runs(fx).groupBy("run", "step").agg(F.count("*").alias("n"), rows.alias("r"))
    return cells.select("run", "step", "n", F.array_join("r.tok", ",").alias("toks"), F.array_join("r.num", ",").alias("nums"))


@on_fixture("agg14_unpivot", "SELECT step, tok, target, round(value, 6) AS value FROM (UNPIVOT (SELECT step, tok, mean, median, std, iqr FROM fx_out) ON mean, median, std, iqr INTO NAME target VALUE value)")
def _(fx):
    return outcomes.unpivot_targets(fx.outcomes, ["step", "tok"]).where(F.col("value").isNotNull())


@on_fixture("agg15_cross_entropy", "SELECT tokenizer, CAST(vocab_size AS BIGINT) AS vocab_size, step, model_size, round(token_logprob, 6) AS token_logprob FROM fx_ce")
def _(fx):
    return losses(fx).withColumn("vocab_size", F.col("vocab_size").cast("long"))


@on_fixture("agg15_cross_entropy_trimmed", "SELECT step, round(-avg(m), 6) AS token_logprob FROM (SELECT uid, step, avg(logprob) AS m FROM fx_ev GROUP BY uid, step) q GROUP BY step")
def _(fx):
    return outcomes.cross_entropy(fx.evals, ["step"], fx.docs)


# --- windows and sorts ---------------------------------------------------------------------------


@on_fixture("win01_lead", "SELECT tok, count(*) AS n, count(nx) AS n_next, sum(nx)::BIGINT AS sum_next FROM (SELECT tok, lead(tok) OVER (PARTITION BY uid ORDER BY pos) AS nx FROM fx_docs) q GROUP BY tok")
def _(fx):
    rows = ordering.neighbours(align.token_rows(fx.docs), ["uid"], "pos", "tok", block=256)
    return rows.groupBy("tok").agg(F.count("*").alias("n"), F.count("next").alias("n_next"), F.sum("next").alias("sum_next"))


@on_fixture("win02_partition_aggregate", "SELECT run, step, tok, min(tok) OVER (PARTITION BY run) AS lo, round(min(mean) OVER (PARTITION BY run), 6) AS floor FROM fx_reg")
def _(fx):
    rows = ordering.with_group_aggregates(runs(fx), ["run"], [F.min("tok").alias("lo"), F.min("mean").alias("floor")])
    return rows.select("run", "step", "tok", "lo", "floor")


@on_fixture("win03_centre", "SELECT run, step, tok, round(tok - avg(tok) OVER (PARTITION BY run), 6) AS rel FROM fx_reg")
def _(fx):
    rows = ordering.with_group_aggregates(runs(fx), ["run"], [F.avg("tok").alias("mid")])
    return rows.select("run", "step", "tok", (F.col("tok") - F.col("mid")).alias("rel"))


@on_documents(
    "win04_running_id",
    f"SELECT doc_id, split, row_number() OVER (ORDER BY list_position(['train', 'validation', 'test'], split), doc_id) - 1 AS uid FROM (SELECT doc_id, {SPLIT_SQL} AS split FROM documents)",
)
def _(docs):
    rest = F.col("doc_id") % 10
    split = F.when(rest == 0, "test").when(rest == 1, "validation").otherwise("train")
    rows = docs.select("doc_id", split.alias("split"))
    return ordering.row_index(rows, [split_order(F.col("split"), SPLITS), F.col("doc_id")], "uid")


@on_fixture("win05_positions", "SELECT uid, count(*) AS n, sum(pos)::BIGINT AS sum_pos, max(pos) AS last FROM fx_docs GROUP BY uid")
def _(fx):
    rows = align.token_rows(fx.docs)
    return rows.groupBy("uid").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"), F.max("pos").alias("last"))


@on_fixture("srt01_sort", "SELECT step, tok, num FROM fx_out ORDER BY step, tok")
def _(fx):
    return fx.outcomes.select("step", "tok", "num").orderBy("step", "tok")


@on_fixture("srt02_by_length", "SELECT uid, n AS len, row_number() OVER (ORDER BY n DESC, uid) - 1 AS rank FROM fx_len")
def _(fx):
    lengths = fx.docs.select("uid", F.size("input_ids").cast("long").alias("len"))
    return ordering.row_index(lengths, [F.desc("len"), F.asc("uid")], "rank")


@on_fixture("srt03_head", "SELECT uid, n AS len FROM fx_len ORDER BY n DESC, uid LIMIT 10")
def _(fx):
    lengths = fx.docs.select("uid", F.size("input_ids").cast("long").alias("len"))
    return ordering.top_k(lengths, [F.desc("len"), F.asc("uid")], 10)


@on_fixture("srt04_cut_ranked_list", "SELECT tok AS id, tok - 500 AS rank FROM fx_merges WHERE tok - 500 < 620 - 500")
def _(fx):
    ranked = fx.log.select(F.col("new_token_id").cast("long").alias("id"), (F.col("new_token_id") - BASE).cast("long").alias("rank"))
    return vocab.cut_merges(ranked, 620, BASE)


# --- scalar functions ----------------------------------------------------------------------------


@on_documents("str01_split", "SELECT page_id, split_part(url, '/', -1) AS last, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages", source="pages")
def _(pages):
    behind = S.split_last(F.col("url"), "//")
    return pages.select("page_id", S.split_last(F.col("url"), "/").alias("last"), S.split_first(behind, "/").alias("host"))


@on_fixture(
    "str02_regex_extract",
    f"SELECT 'step' || step || '_{STAMP}' AS folder, CAST(step AS BIGINT) AS step, count(*) AS n FROM fx_len CROSS JOIN fx_steps GROUP BY ALL",
)
def _(fx):
    rows = readers.scan_with_path(fx.spark, f"{fx.evals_path}/{RUNS[0]}_{STAMP}/*/*.parquet", schema=readers.EVALS_SCHEMA)
    folder = F.element_at(F.split("filename", "/"), -2)
    return rows.select(folder.alias("folder")).groupBy("folder").agg(F.count("*").alias("n")).withColumn("step", N.step_of_path(F.col("folder")))


@on_documents("str03_extract_all_last", "SELECT page_id, TRY_CAST(regexp_extract_all(url, '[0-9]+')[-1] AS INTEGER) AS last_number FROM pages", source="pages")
def _(pages):
    return pages.select("page_id", S.extract_last(F.col("url"), "[0-9]+").cast("int").alias("last_number"))


@on_documents(
    "str04_strip_affixes",
    """SELECT page_id, CASE WHEN starts_with(u, 'https://') THEN substr(u, 9) ELSE u END AS bare
       FROM (SELECT page_id, CASE WHEN ends_with(url, '/') THEN left(url, -1) ELSE url END AS u FROM pages) q""",
    source="pages",
)
def _(pages):
    return pages.select("page_id", S.strip_prefix(S.strip_suffix(F.col("url"), "/"), "https://").alias("bare"))


@on_documents(
    "str05_longest_digit_run",
    """SELECT doc_id, list_sort([{'k': -len(runs[i]), 'i': i, 'v': runs[i]} FOR i IN range(1, len(runs) + 1)])[1].v AS digits
       FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS runs FROM documents) q""",
)
def _(docs):
    return docs.select("doc_id", S.longest_digit_run(F.col("text")).alias("digits"))


@on_fixture("str06_format", "SELECT step, tok, 'item ' || tok || ': ' || num || ' uses' AS label, concat_ws(' ', step, tok) AS pair FROM fx_out")
def _(fx):
    label = F.format_string("item %d: %d uses", "tok", "num")
    return fx.outcomes.select("step", "tok", label.alias("label"), F.concat_ws(" ", F.col("step").cast("string"), F.col("tok").cast("string")).alias("pair"))


@on_fixture("str07_strict_lookup", "SELECT run, CASE tokenizer WHEN 'bpe' THEN 'BPE' WHEN 'wordpiece' THEN 'WordPiece' ELSE 'BPE2WP' END AS name, '0.5k' AS size, count(*) AS n FROM fx_reg GROUP BY ALL")
def _(fx):
    rows = runs(fx).select("run", S.strict_lookup(F.col("tokenizer"), TOKENIZER_NAMES).alias("name"), S.strict_lookup(F.col("vocab_size"), SIZES).alias("size"))
    return rows.groupBy("run", "name", "size").agg(F.count("*").alias("n"))


@on_fixture("str08_ordered_category", "SELECT run, CAST(CASE model_size WHEN '57M-tied' THEN 0 WHEN '100M' THEN 2 END AS INTEGER) AS model_order, count(*) AS n FROM fx_reg GROUP BY ALL")
def _(fx):
    order = S.ordinal(F.col("model_size"), ["57M-tied", "100M-tied", "100M", "340M-tied", "850M"])
    return runs(fx).groupBy("run", order.alias("model_order")).agg(F.count("*").alias("n"))


NAMED = """SELECT doc_id, (1 + doc_id % 900) || 'M' || CASE WHEN doc_id % 2 = 0 THEN '-tied' ELSE '' END AS model_size, source AS dataset,
  CASE doc_id % 3 WHEN 0 THEN 'bpe' WHEN 1 THEN 'wordpiece' ELSE 'bpe2wp' END AS tokenizer, n_chars, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS corpus FROM documents"""


@on_documents(
    "str09_run_name",
    f"""SELECT doc_id, model_size, dataset, tokenizer || n_chars || corpus AS tok_name, tokenizer, n_chars::INTEGER AS vocab_size,
        CASE WHEN tokenizer = 'bpe2wp' AND n_chars < 10 THEN 2 ELSE n_chars END::INTEGER AS cutoff FROM ({NAMED}) q""",
)
def _(docs):
    """Names as runs have them, built from the columns of the documents and taken apart again."""
    rest = F.col("doc_id") % 3
    tokenizer = F.when(rest == 0, "bpe").when(rest == 1, "wordpiece").otherwise("bpe2wp")
    tied = F.when(F.col("doc_id") % 2 == 0, "-tied").otherwise("")
    corpus = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang"))
    run = F.concat(F.lit("me"), 1 + F.col("doc_id") % 900, F.lit("M"), tied, F.lit("_"), "source", F.lit("_"), tokenizer, "n_chars", corpus)
    rows = docs.select("doc_id", N.parse_run_name(N.run_of_path(F.concat(F.lit("evals/"), run, F.lit(".parquet")))).alias("l"))
    return rows.select("doc_id", "l.model_size", "l.dataset", "l.tok_name", "l.tokenizer", "l.vocab_size", "l.cutoff")


@on_fixture("mth01_arithmetic", "SELECT step, tok, round(tok / 1000e0, 6) AS x, round(-mean, 6) AS cost, round(mean + std, 6) AS upper, round(mean * 2 - 1, 6) AS lin FROM fx_out")
def _(fx):
    m = F.col("mean")
    return fx.outcomes.select("step", "tok", (F.col("tok") / 1000).alias("x"), (-m).alias("cost"), (m + F.col("std")).alias("upper"), (m * 2 - 1).alias("lin"))


@on_fixture("mth02_round", "SELECT step, tok, round(mean, 2) AS mean FROM fx_out")
def _(fx):
    return fx.outcomes.select("step", "tok", F.round("mean", 2).alias("mean"))


@on_fixture("mth03_horizontal_min", f"SELECT step, uid, tok, round(least(mean, std, width), 6) AS least FROM {SPARSE} q")
def _(fx):
    return sparse(fx).select("step", "uid", "tok", F.least("mean", "std", "width").alias("least"))


@on_fixture("mth04_coalesce", f"SELECT step, uid, tok, round(coalesce(mean, std, -1e0), 6) AS spread FROM {SPARSE} q")
def _(fx):
    return sparse(fx).select("step", "uid", "tok", F.coalesce("mean", "std", F.lit(-1.0)).alias("spread"))


@on_fixture("arr01_element", "SELECT tok, tok_a, tok_b FROM fx_merges")
def _(fx):
    get = lambda i: F.get("pair", F.lit(i)).cast("long")
    return fx.log.select(F.col("new_token_id").cast("long").alias("tok"), get(0).alias("tok_a"), get(1).alias("tok_b"))


@on_fixture("arr02_length", "SELECT uid, n AS len FROM fx_len")
def _(fx):
    return fx.docs.select("uid", F.size("input_ids").cast("long").alias("len"))


@on_fixture("arr03_keep_last", "SELECT uid, string_agg(tok, ',' ORDER BY pos) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY pos DESC) AS back FROM fx_docs) q WHERE back <= 3 GROUP BY uid")
def _(fx):
    return fx.docs.select("uid", F.array_join(A.keep_last(F.col("input_ids"), F.lit(3)), ",").alias("tail"))


@on_fixture("arr04_range", "SELECT uid, sum(pos)::BIGINT AS total, count(*) AS n FROM fx_docs GROUP BY uid")
def _(fx):
    positions = A.index_range(F.col("input_ids"))
    total = F.aggregate(positions, F.lit(0).cast("long"), lambda a, x: a + x)
    return fx.docs.select("uid", total.alias("total"), F.size(positions).cast("long").alias("n"))


@on_fixture("arr05_explode_together", "SELECT step, tok, count(*) AS n, round(sum(logprob), 6) AS total FROM fx_raw GROUP BY step, tok")
def _(fx):
    rows = A.explode_together(fx.evals, ["token_logprob", "token_ids"], "pos")
    return rows.groupBy("step", F.col("token_ids").cast("long").alias("tok")).agg(F.count("*").alias("n"), F.sum("token_logprob").alias("total"))


@on_fixture("arr06_explode", "SELECT tok, count(*) AS n FROM fx_docs GROUP BY tok")
def _(fx):
    return fx.docs.select(F.explode("input_ids").alias("tok")).groupBy(F.col("tok").cast("long").alias("tok")).agg(F.count("*").alias("n"))


@on_fixture("arr07_mean", "SELECT l.uid, s.step, round(avg(r.logprob), 6) AS mean FROM fx_len l CROSS JOIN fx_steps s LEFT JOIN fx_raw r ON r.uid = l.uid AND r.step = s.step GROUP BY ALL")
def _(fx):
    return fx.evals.select("uid", "step", A.array_mean(F.col("token_logprob")).alias("mean"))


@on_fixture("arr08_left_pad", "SELECT uid, greatest(n, 100) AS len, greatest(100 - n, 0) AS n_pad FROM fx_len")
def _(fx):
    padded = A.left_pad(F.col("input_ids"), F.lit(100), F.lit(-1))
    return fx.docs.select(
        "uid",
        F.size(padded).cast("long").alias("len"),
        F.size(F.filter(padded, lambda x: x == -1)).cast("long").alias("n_pad"),
    )
