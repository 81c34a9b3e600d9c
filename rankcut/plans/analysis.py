"""Alignment, statistics and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankcut.operators import align, labels, outcomes, quality, regress, smooth
from rankcut.plans.catalog import on_fixture
from rankcut.plans.fixtures import BASE, HALF_WIDTH, RUNS, STEPS
from rankcut.plans.relational import KEYS, PARTS, SIZES, chain, effects, losses, runs
from rankcut.plans.workflow import bucketed_regression_data, regression_data
from rankcut.sources import writers

CELL = [*KEYS, "target"]
CELL_SQL = "model_size, vocab_size, tokenizer, step, target"


# --- alignment -----------------------------------------------------------------------------------


@on_fixture(
    "aln01_trim_pair",
    """SELECT l.uid, s.step, CASE WHEN l.uid % 3 = 0 THEN n - 1 ELSE n END AS n, round(coalesce(sum(e.logprob), 0), 6) AS total,
       min(e.tok) FILTER (e.pos = 0) AS first_tok, min(e.tok) FILTER (e.pos = 0) AS first_doc_tok
       FROM fx_len l CROSS JOIN fx_steps s LEFT JOIN fx_ev e ON e.uid = l.uid AND e.step = s.step GROUP BY l.uid, s.step, l.n""",
)
def _(fx):
    head = lambda c: F.get(c, F.lit(0)).cast("long")
    doc_heads = fx.aligned_docs.select("uid", head("input_ids").alias("first_doc_tok"))
    return fx.trimmed.join(doc_heads, "uid", "left").select(
        "uid",
        "step",
        F.size("token_logprob").cast("long").alias("n"),
        F.aggregate("token_logprob", F.lit(0.0), lambda a, x: a + x).alias("total"),
        head("token_ids").alias("first_tok"),
        "first_doc_tok",
    )


@on_fixture("aln02_merges_window", "SELECT tok, tok_a, tok_b FROM fx_merges WHERE tok >= 550 - 40 AND tok < 550 + 40 ORDER BY tok")
def _(fx):
    return align.merges_window(fx.log, 550, 40).orderBy("tok")


@on_fixture("aln03_component_audit", f"SELECT tok, count(*) AS n_parents, min(tok_new) AS first_parent FROM {PARTS} GROUP BY tok")
def _(fx):
    audit = align.component_audit(chain(fx), 600)
    return audit.groupBy("tok").agg(F.count("*").alias("n_parents"), F.min("tok_new").alias("first_parent"))


@on_fixture("aln04_tag_pairs", "SELECT uid, og_pos, og_tok, tok, pos FROM fx_tag")
def _(fx):
    return fx.tagged


@on_fixture(
    "aln04_tag_pairs_greedy",
    """SELECT * FROM (WITH RECURSIVE m AS MATERIALIZED (SELECT d.uid, d.pos, d.tok, g.tok AS made
         FROM (SELECT *, lead(tok) OVER (PARTITION BY uid ORDER BY pos) AS nx FROM fx_trim) d LEFT JOIN fx_merges g ON d.tok = g.tok_a AND d.nx = g.tok_b),
       hit AS MATERIALIZED (SELECT uid, pos, made FROM m WHERE made IS NOT NULL),
       taken AS (
         SELECT uid, pos, made FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit p WHERE p.uid = h.uid AND p.pos = h.pos - 1)
         UNION ALL
         SELECT h.uid, h.pos, h.made FROM taken t JOIN hit between_them ON between_them.uid = t.uid AND between_them.pos = t.pos + 1
           JOIN hit h ON h.uid = t.uid AND h.pos = t.pos + 2)
       SELECT m.uid, m.pos AS og_pos, m.tok AS og_tok, coalesce(a.made, b.made, m.tok) AS tok, coalesce(a.pos, b.pos, m.pos) AS pos
       FROM m LEFT JOIN taken a ON a.uid = m.uid AND a.pos = m.pos LEFT JOIN taken b ON b.uid = m.uid AND b.pos = m.pos - 1) q""",
)
def _(fx):
    return align.tag_rows_greedy(align.token_rows_with_neighbours(fx.aligned_docs), align.window_sized(fx.merges, HALF_WIDTH))


@on_fixture("aln05_impute_scores", "SELECT step, uid, count(*) AS n, round(sum(logprob), 6) AS total, sum(tok)::BIGINT AS toks, sum(pos)::BIGINT AS places FROM fx_imp GROUP BY step, uid")
def _(fx):
    return fx.scores.groupBy("step", "uid").agg(
        F.count("*").alias("n"), F.sum("logprob").alias("total"), F.sum("tok").alias("toks"), F.sum("pos").alias("places")
    )


@on_fixture("aln06_treatment_flag", "SELECT step, tok < 500 AS treat, count(*) AS items, sum(num)::BIGINT AS uses FROM fx_out GROUP BY ALL")
def _(fx):
    rows = fx.outcomes.withColumn("treat", align.treated("tok", BASE))
    return rows.groupBy("step", "treat").agg(F.count("*").alias("items"), F.sum("num").alias("uses"))


@on_fixture(
    "aln07_regression_data",
    "SELECT step, tok, round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std, round(iqr, 6) AS iqr, num, treat FROM fx_out",
)
def _(fx):
    return regression_data(fx.docs, fx.evals, fx.log, BASE, HALF_WIDTH)


@on_fixture(
    "aln07_all_runs",
    """SELECT run, step, tok, round(median * f, 6) AS median, round(mean * f, 6) AS mean, round(std * f, 6) AS std, round(iqr * f, 6) AS iqr, num, treat
       FROM fx_out, (SELECT run, 1 + 0.1e0 * run_no AS f FROM fx_runs WHERE run_no < 2) r""",
)
def _(fx):
    """Two runs whose scores differ by a factor, in one pass."""
    evals = writers.consolidated(fx.spark, fx.evals_path)
    docs = fx.docs.withColumn("run", F.explode(F.array(*[F.lit(r) for r in RUNS[:2]])))
    return regression_data(docs, evals, fx.log, BASE, HALF_WIDTH, run="run")


@on_fixture(
    "aln07_bucketed_runs",
    """SELECT run, step, tok, round(median * f, 6) AS median, round(mean * f, 6) AS mean, round(std * f, 6) AS std, round(iqr * f, 6) AS iqr, num, treat
       FROM fx_out, (SELECT run, 1 + 0.1e0 * run_no AS f FROM fx_runs WHERE run_no < 2) r""",
)
def _(fx):
    """Two runs from tables bucketed by document."""
    rows = writers.consolidated(fx.spark, fx.evals_path)
    evals = {r: rows.where(F.col("run") == r).drop("run") for r in RUNS[:2]}
    return bucketed_regression_data(fx.docs, evals, fx.log, BASE, HALF_WIDTH, buckets=8)


# --- statistics ----------------------------------------------------------------------------------


def predicted(fx):
    long = outcomes.unpivot_targets(runs(fx), [*KEYS, "tok", "treat"])
    return regress.predictions(long, effects(fx), CELL, F.col("tok") / 1000)


PREDICTED = f"""(SELECT {CELL_SQL}, tok, treat, value, x, intercept + slope * x + ate * t AS fitted, intercept + slope * x AS fitted_off,
  intercept + slope * x + ate AS fitted_on, ate FROM fx_long JOIN fx_eff USING ({CELL_SQL}))"""


@on_fixture("sta01_grouped_ols", f"SELECT {CELL_SQL}, n, round(intercept, 6) AS intercept, round(slope, 6) AS slope, round(ate, 6) AS ate FROM fx_eff")
def _(fx):
    return effects(fx).select(*CELL, "n", "intercept", "slope", "ate")


@on_fixture("sta02_hc1_errors", f"SELECT {CELL_SQL}, round(se, 6) AS se FROM fx_eff")
def _(fx):
    return effects(fx).select(*CELL, "se")


@on_fixture("sta03_effect_rows")
def _(fx):
    return regress.with_inference(effects(fx)).select(*CELL, "ate", "lower", "upper", "r2", "pvalue")


@on_fixture("sta03_effect_fit", f"SELECT {CELL_SQL}, n, round(ate, 6) AS ate, round(se, 6) AS se, round(r2, 6) AS r2, 'ok' AS status FROM fx_eff")
def _(fx):
    return effects(fx).select(*CELL, "n", "ate", "se", "r2", "status")


@on_fixture("sta04_fitted_values", f"SELECT {CELL_SQL}, tok, round(value, 6) AS value, round(fitted, 6) AS fitted FROM {PREDICTED}")
def _(fx):
    return predicted(fx).select(*CELL, "tok", "value", "fitted")


@on_fixture("sta05_counterfactuals", f"SELECT {CELL_SQL}, tok, treat, round(fitted_off, 6) AS fitted_off, round(fitted_on, 6) AS fitted_on FROM {PREDICTED}")
def _(fx):
    return predicted(fx).select(*CELL, "tok", "treat", "fitted_off", "fitted_on")


_WIN = f"""w AS (SELECT unnest({regress.WINDOW_SIZES}) AS window_size),
r AS (SELECT window_size, {CELL_SQL}, x, t, value FROM fx_long, w WHERE step = (SELECT max(step) FROM fx_reg) AND tok >= vocab_size - window_size AND tok < vocab_size + window_size),
m AS (SELECT *, x - avg(x) OVER c AS dx, t - avg(t) OVER c AS dt, value - avg(value) OVER c AS dy FROM r WINDOW c AS (PARTITION BY window_size, {CELL_SQL})),
s AS (SELECT window_size, {CELL_SQL}, count(*) AS n, sum(dx*dx) AS sxx, sum(dx*dt) AS sxt, sum(dt*dt) AS stt, sum(dx*dy) AS sxy, sum(dt*dy) AS sty, sum(dy*dy) AS syy FROM m GROUP BY ALL),
k AS (SELECT *, sxx*stt - sxt*sxt AS det, (sxy*stt - sty*sxt)/(sxx*stt - sxt*sxt) AS slope, (sty*sxx - sxy*sxt)/(sxx*stt - sxt*sxt) AS ate FROM s),
e AS (SELECT m.*, k.n, k.syy, k.ate, m.dy - k.slope*m.dx - k.ate*m.dt AS e, (k.sxx*m.dt - k.sxt*m.dx)/k.det AS z FROM m JOIN k USING (window_size, {CELL_SQL}))"""


@on_fixture(
    "sta06_window_sensitivity",
    f"""SELECT window_size, {CELL_SQL}, n, round(any_value(ate), 6) AS ate, round(sqrt(sum(e*e*z*z) * n / (n - 3)), 6) AS se, round(1 - sum(e*e)/any_value(syy), 6) AS r2
        FROM (WITH {_WIN} SELECT * FROM e) q GROUP BY window_size, {CELL_SQL}, n""",
)
def _(fx):
    rows = regress.window_sensitivity(runs(fx), KEYS, vocab_sizes=[BASE])
    return rows.select("window_size", *CELL, "n", "ate", "se", "r2")


@on_fixture("sta06_window_intervals")
def _(fx):
    rows = regress.with_inference(regress.window_sensitivity(runs(fx), KEYS, vocab_sizes=[BASE]))
    return rows.select("window_size", "model_size", "step", "target", "ate", "lower", "upper", "r2", "pvalue", "vocab_size", "tokenizer")


@on_fixture(
    "sta07_line_smoother",
    """SELECT run, step, tok, round(a + b * tok, 6) AS line, round(b, 6) AS slope FROM fx_reg JOIN
       (SELECT run, step, regr_slope(mean, tok) AS b, regr_intercept(mean, tok) AS a FROM fx_reg GROUP BY run, step) q USING (run, step)""",
)
def _(fx):
    rows = regress.line_smoother(runs(fx).select("run", "step", "tok", "mean"), ["run", "step"], "tok", "mean")
    return rows.select("run", "step", "tok", "line", "slope")


@on_fixture("sta07_line_band")
def _(fx):
    rows = regress.line_smoother(runs(fx).select("run", "step", "tok", "mean"), ["run", "step"], "tok", "mean")
    return rows.select("run", "step", "tok", "line", "line_lower", "line_upper")


_LOESS = """rows AS (SELECT step, target, treat, tok::DOUBLE AS x, value AS y FROM fx_long WHERE model_size = '57M-tied' AND tokenizer = 'bpe'),
edges AS (SELECT step, target, treat, min(x) AS lo, max(x) AS hi, count(*) AS n FROM rows GROUP BY ALL),
grid AS (SELECT *, lo + g * ((hi - lo) / 79) AS x0 FROM edges, LATERAL (SELECT unnest(range(0, 80)) AS g)),
meet AS (SELECT r.*, g.g, g.x0, g.n, abs(r.x - g.x0) AS d FROM rows r JOIN grid g USING (step, target, treat)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY step, target, treat, g ORDER BY d) AS rk FROM meet),
width AS (SELECT *, max(d) FILTER (rk = least(greatest(ceil(n * 0.1e0), 2), n)) OVER (PARTITION BY step, target, treat, g) AS h FROM ranked),
w AS (SELECT *, (x - x0) / h AS u, pow(1 - pow(d / h, 3), 3) AS wt FROM width WHERE d < h),
s AS (SELECT step, target, treat, g, x0, sum(wt) s0, sum(wt*u) s1, sum(wt*u*u) s2, sum(wt*y) b0, sum(wt*u*y) b1 FROM w GROUP BY ALL)"""


@on_fixture(
    "sta08_loess_linear",
    f"SELECT step, target, treat, CAST(g AS INTEGER) AS g, round(x0, 6) AS x0, round((s2*b0 - s1*b1)/(s0*s2 - s1*s1), 6) AS fit FROM (WITH {_LOESS} SELECT * FROM s) q",
)
def _(fx):
    return smooth.loess(loess_rows(fx), ["step", "target", "treat"], "tok", "value", degree=1).drop("lower", "upper")


@on_fixture("sta08_loess_quadratic")
def _(fx):
    return smooth.loess(loess_rows(fx), ["step", "target", "treat"], "tok", "value")


def loess_rows(fx):
    rows = runs(fx).where((F.col("model_size") == "57M-tied") & (F.col("tokenizer") == "bpe"))
    return outcomes.unpivot_targets(rows, ["step", "tok", "treat"])


@on_fixture(
    "sta09_effect_labels",
    f"""SELECT target, tokenizer, round(any_value(lo), 6) AS xpos, round(any_value(bottom), 6) AS ypos, 'ATE: ' || r AS label FROM
       (SELECT target, tokenizer, round(ate, 2) AS r, min(x) OVER (PARTITION BY target) AS lo, min(value) OVER (PARTITION BY target) AS bottom FROM {PREDICTED} p
        WHERE step = 4000 AND model_size = '57M-tied') q GROUP BY target, tokenizer, r""",
)
def _(fx):
    last = predicted_with_effect(fx).where((F.col("step") == 4000) & (F.col("model_size") == "57M-tied"))
    return labels.effect_labels(last, ["target", "tokenizer"], "x", "value", ["target"]).select("target", "tokenizer", "xpos", "ypos", "label")


def predicted_with_effect(fx):
    rows = predicted(fx).withColumn("x", F.col("tok") / 1000)
    return rows.join(effects(fx).select(*CELL, "ate"), CELL)


@on_fixture(
    "sta10_relative_axis",
    f"SELECT {CELL_SQL}, tok, round(x - avg(x) OVER (PARTITION BY vocab_size), 6) AS rel, round(fitted, 6) AS fitted FROM {PREDICTED}",
)
def _(fx):
    rows = predicted(fx).withColumn("rel", F.col("tok") / 1000)
    return labels.relative_axis(rows, "rel", ["vocab_size"]).select(*CELL, "tok", "rel", "fitted")


@on_fixture(
    "sta11_effect_vs_loss",
    """SELECT model_size, tokenizer, step, round(ate, 6) AS ate, round(token_logprob, 6) AS loss,
       CASE tokenizer WHEN 'bpe' THEN 'BPE' WHEN 'wordpiece' THEN 'WordPiece' ELSE 'BPE2WP' END || ' 0.5k ' || model_size AS label
       FROM fx_ce JOIN fx_eff USING (model_size, vocab_size, tokenizer, step) WHERE step > 0 AND target = 'mean'""",
)
def _(fx):
    rows = labels.effect_vs_loss(effects(fx), losses(fx), ["tokenizer", "vocab_size", "step", "model_size"], SIZES)
    return rows.select("model_size", "tokenizer", "step", "ate", F.col("token_logprob").alias("loss"), "label")


@on_fixture(
    "sta11_scaling_table",
    """SELECT vocab_size, tokenizer, model_size, step, round(ate, 6) AS ate, round(token_logprob, 6) AS loss, 0 AS model_order
       FROM fx_eff LEFT JOIN fx_ce USING (model_size, vocab_size, tokenizer, step) WHERE step > 0 AND target = 'mean' AND model_size NOT IN ('100M-tied', '100M')""",
)
def _(fx):
    keys = ["vocab_size", "tokenizer", "model_size", "step"]
    rows = labels.scaling_table(effects(fx), losses(fx), keys, ["57M-tied", "340M-tied", "850M"], ["100M-tied", "100M"])
    return rows.withColumnRenamed("token_logprob", "loss")


# --- quality -------------------------------------------------------------------------------------


@on_fixture(
    "qa01_alignment_complete",
    "SELECT step, count(*) AS joined, (SELECT count(*) FROM fx_tag WHERE tok >= 300 AND tok < 700) AS tagged, true AS complete FROM fx_imp GROUP BY step",
)
def _(fx):
    from rankcut.operators.filters import cutoff_window

    return quality.alignment_completeness(fx.scores, cutoff_window(fx.tagged, "tok", BASE, HALF_WIDTH))


@on_fixture(
    "qa01_observed",
    """SELECT step, count(*) AS joined, (SELECT count(*) FROM fx_tag WHERE tok >= 300 AND tok < 700) AS tagged, true AS complete,
       (SELECT count(*) FROM fx_out) AS items, 0 AS unequal FROM fx_imp GROUP BY step""",
)
def _(fx):
    """The job that writes the data also checks it."""
    checks = []
    table = regression_data(fx.docs, fx.evals, fx.log, BASE, HALF_WIDTH, checks=checks, steps=STEPS)
    items = table.count()
    rows = [(*row, items, checks[0].unequal_lengths()) for row in checks[0].completeness()]
    return fx.spark.createDataFrame(rows, "step long, joined long, tagged long, complete boolean, items long, unequal int")


@on_fixture(
    "qa02_grid_complete",
    """SELECT vocab_size, tokenizer, max(l) FILTER (model_size = '57M-tied') AS small, max(l) FILTER (model_size = '100M') AS large FROM
       (SELECT vocab_size, tokenizer, model_size, string_agg(DISTINCT n, ',' ORDER BY n) AS l FROM
       (SELECT vocab_size, tokenizer, model_size, step, count(*) AS n FROM fx_reg GROUP BY ALL) q GROUP BY ALL) z GROUP BY ALL""",
)
def _(fx):
    wide = quality.grid_completeness(runs(fx), ["vocab_size", "model_size", "tokenizer"], "model_size")
    return wide.select("vocab_size", "tokenizer", F.array_join("57M-tied", ",").alias("small"), F.array_join("100M", ",").alias("large"))


@on_fixture(
    "qa03_token_agreement",
    """SELECT uid, pos, tok + 1 AS token_ids, step FROM fx_ev WHERE uid % 11 = 3 AND uid % 13 <> 5 AND step = 2000 AND tok % 4 = 1
       UNION ALL SELECT uid, pos, tok, step FROM fx_ev WHERE uid % 13 = 5""",
)
def _(fx):
    """Some tokens are changed and some documents are missing."""
    wrong = (F.col("uid") % 11 == 3) & (F.col("step") == 2000) & (F.col("uid") % 13 != 5)
    changed = F.when(wrong, F.transform("token_ids", lambda t: F.when(t % 4 == 1, t + 1).otherwise(t))).otherwise(F.col("token_ids"))
    evals, docs = fx.trimmed.withColumn("token_ids", changed), fx.aligned_docs.where(F.col("uid") % 13 != 5)
    return quality.disagreements(evals, docs).select("uid", "pos", F.col("token_ids").cast("long").alias("token_ids"), "step")


@on_fixture("qa04_equal_lengths", "SELECT l.uid, s.step, CASE WHEN uid % 3 = 0 THEN n - 1 ELSE n + uid % 3 END AS n FROM fx_len l CROSS JOIN fx_steps s")
def _(fx):
    return quality.equal_lengths(fx.evals).select("uid", "step", F.size("token_ids").cast("long").alias("n"))
