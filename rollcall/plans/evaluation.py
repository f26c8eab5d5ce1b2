"""Scoring labelling systems against the gold set, and planning what is left to label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.functions import decide, replies
from rollcall.operators import joins as J
from rollcall.operators import ranking as R
from rollcall.operators import scoring


def pending(gold: DataFrame, answers: DataFrame, split: str) -> DataFrame:
    """Gold rows of the split that the run has not answered yet."""
    return J.todo(gold.filter(F.col("split") == split), answers, "id")


def request_batches(todo: DataFrame, n: int = 15) -> DataFrame:
    """Pending rows in request batches, in id order."""
    return R.to_batches(todo, [F.col("id")], n, ["id", "company", "title"], "id")


def record_answers(todo: DataFrame, answers: DataFrame) -> DataFrame:
    """One line per asked row: the answer, or "no answer" where there is none."""
    said = J.lookup(todo.select("id"), answers.select("id", "label"), "id")
    return said.select("id", replies.answer_or("label").alias("label"))


def mock_answers(todo: DataFrame) -> DataFrame:
    """Answers without a model: the rule's own label."""
    return todo.select("id", F.col("rule_label").alias("label"))


def systems(gold: DataFrame, runs: DataFrame, split: str) -> DataFrame:
    """One row per system and item: the rules, every complete run, and rules backed by that run.

    ``runs`` holds run ("model__prompt"), id and label. Runs that do not cover the whole
    split are left out. Systems are told apart by run; where several complete runs share
    a prompt, the name of a combined system holds the model too.
    """
    wanted = gold.filter(F.col("split") == split).withColumnRenamed("label", "truth")
    complete = J.covers(wanted, runs, "run", "id").filter("complete").select("run")
    parts = F.split("run", "__")
    model, prompt = F.element_at(parts, 1), F.element_at(parts, 2)
    # One row per prompt: a handful, and a join that Spark sizes itself.
    shared = complete.groupBy(prompt.alias("prompt")).agg((F.count(F.lit(1)) > 1).alias("several"))
    said = wanted.join(runs.join(complete, "run"), "id").withColumn("prompt", prompt).join(shared, "prompt")
    name = F.when(F.col("several"), F.concat(model, F.lit(" / "), prompt)).otherwise(prompt)

    def rows(df: DataFrame, system: Column, answer: Column) -> DataFrame:
        return df.select(system.alias("system"), "id", "company", "title", "truth", answer.alias("said"))

    rules = rows(wanted, F.lit(V.RULES_SYSTEM), F.col("rule_label"))
    models = rows(said, F.concat(model, F.lit(" / "), prompt), F.col("label"))
    both = rows(
        said,
        F.concat(F.lit("Rules, then "), name, F.lit(" where rules are unclear")),
        decide.hybrid("rule_label", "label"),
    )
    return rules.unionByName(models).unionByName(both)


def scores(answers: DataFrame) -> DataFrame:
    """Metrics per system, as percents rounded half to even to one digit."""
    table = scoring.binary_metrics(answers, ["system"], "truth", "said")
    shown = [
        c if c in ("system", "proposals") else (F.rint(F.col(c) * 100 * 10) / 10).alias(c) for c in table.columns
    ]
    return table.select(*shown)


def confusion(answers: DataFrame, other: str | None = None) -> DataFrame:
    """Truth against what each system said; any other answer is counted under ``other``, or fails the query."""
    return scoring.confusion(answers, ["system"], "truth", "said", [*V.MODEL_LABELS, V.NO_ANSWER], other)


def errors(answers: DataFrame, names: list[str]) -> DataFrame:
    """Items that at least one of the named systems got wrong, one column per system."""
    wide = (
        answers.groupBy("id", "company", "title", F.col("truth").alias("label"))
        .pivot("system", names)
        .agg(F.max("said"))
    )
    return wide.filter(decide.any_wrong("label", [F.col(f"`{n}`") for n in names]))


def evaluate(gold: DataFrame, runs: DataFrame, split: str) -> dict[str, DataFrame]:
    """Scores, confusion tables and errors of every system on one split."""
    answers = systems(gold, runs, split)
    names = [row["system"] for row in answers.select("system").distinct().orderBy("system").collect()]
    return {"scores": scores(answers), "confusion": confusion(answers, "other"), "errors": errors(answers, names)}
