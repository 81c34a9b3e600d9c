"""Checks that return tables (empty or all-true when the data is sound)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def alignment_completeness(scores: DataFrame, tagged: DataFrame) -> DataFrame:
    """Per step: joined rows, tagged rows, and whether they agree."""
    per_step = scores.groupBy("step").agg(F.count("*").alias("joined"))
    expected = tagged.agg(F.count("*")).scalar()
    return per_step.withColumn("tagged", expected).withColumn("complete", F.col("joined") == F.col("tagged"))


@dataclass
class AlignmentChecks:
    """Counts taken while aligned scores are written; they are there once a job over the scores has ended.

    A job that is repeated in part, after an executor was lost, may count rows of the repeated tasks again.
    """

    steps: list[int]
    evals: Observation
    tagged: Observation
    scores: Observation

    def unequal_lengths(self) -> int:
        """Evaluations whose score and id arrays differ in length."""
        return self.evals.get["unequal"]

    def completeness(self) -> list[tuple[int, int, int, bool]]:
        """Per step: joined rows, tagged rows, and whether they agree (as ``alignment_completeness``)."""
        tagged, joined = self.tagged.get["n"], self.scores.get
        return [(s, joined[f"step{s}"], tagged, joined[f"step{s}"] == tagged) for s in self.steps]


def observed_evaluations(evals: DataFrame, steps: list[int]) -> tuple[DataFrame, AlignmentChecks]:
    """Evaluations whose lengths are compared while they are read, and the checks that are to be filled in."""
    checks = AlignmentChecks(list(steps), Observation(), Observation(), Observation())
    return evals.observe(checks.evals, F.count(F.when(F.size("token_logprob") != F.size("token_ids"), 1)).alias("unequal")), checks


def observed_alignment(impute: Callable[[DataFrame, DataFrame], DataFrame], evals: DataFrame, tagged: DataFrame, steps: list[int]) -> tuple[DataFrame, AlignmentChecks]:
    """``impute(evals, tagged)`` with checks that the same job fills in: nothing is read or joined a second time."""
    evals, checks = observed_evaluations(evals, steps)
    scores = impute(evals, tagged.observe(checks.tagged, F.count("*").alias("n")))
    per_step = [F.count(F.when(F.col("step") == s, 1)).alias(f"step{s}") for s in steps]
    return scores.observe(checks.scores, *per_step), checks


def grid_completeness(outcomes: DataFrame, run_keys: list[str], across: str) -> DataFrame:
    """Distinct row counts per step, per run, one column per value of ``across``."""
    per_step = outcomes.groupBy(*run_keys, "step").agg(F.count("*").alias("len"))
    counts = per_step.select(*run_keys, "len").distinct()
    index = [k for k in run_keys if k != across]
    lists = counts.groupBy(*run_keys).agg(F.sort_array(F.collect_set("len")).alias("len"))
    return lists.groupBy(*index).pivot(across).agg(F.first("len"))


def disagreements(evals: DataFrame, docs: DataFrame) -> DataFrame:
    """Scored positions whose token differs from the document, or that it does not have (trimmed inputs; empty when sound).

    Arrays meet by ``uid`` and are compared in place; only what differs is exploded.
    """
    met = evals.select("uid", "step", "token_ids").join(docs.select("uid", "input_ids"), "uid", "left")
    own = F.transform("token_ids", lambda t, i: F.struct(i.cast("long").alias("pos"), t.alias("token_ids"), F.get("input_ids", i).alias("known")))
    wrong = F.filter(own, lambda x: ~x["token_ids"].eqNullSafe(x["known"]))
    return met.select("uid", "step", F.explode(wrong).alias("w")).select("uid", "w.pos", "w.token_ids", "step")


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fail the query on the first row that breaks ``condition``."""
    return df.where(F.assert_true(condition, message).isNull())


def equal_lengths(evals: DataFrame) -> DataFrame:
    """Both arrays of an evaluation have the same length."""
    return require(evals, F.size("token_logprob") == F.size("token_ids"), "score and id arrays differ in length")
