"""Quality classifier: a sparse ensemble of rules over a text's statistics.

Boosted trees over the statistics of labelled texts propose rules: each path from a root
is a conjunction of thresholds. A logistic regression with a lasso penalty weighs the
rules' indicators, most weights become zero, and what is left is compiled into one Spark
column expression over the statistics. Statistics and scores are DataFrame expressions,
and fitting runs on Spark over all labelled rows, so nothing is sampled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.llm.shared import column, plain, remainder
from casegrain.workspace import written

THRESHOLD = 0.3
FOLDS = 5
TREES, DEPTH, STEP, LEAST_ROWS = 12, 3, 0.3, 5
LASSO = 0.002
SEED = 42

#: A condition is (statistic, "<=" or ">", threshold), a rule all of its conditions.
Condition = tuple[str, str, float]
Rule = tuple[Condition, ...]

#: Statistics by name, over ``t`` (the text), ``n`` (its length), ``words`` and ``lines``.
STATISTICS = {
    "log_chars": "ln(1 + n)",
    "log_words": "ln(1 + size(words))",
    "word_length": "n / greatest(1, size(words))",
    "line_length": "n / greatest(1, size(lines))",
    "distinct_words": "size(array_distinct(words)) / greatest(1, size(words))",
    "distinct_lines": "size(array_distinct(lines)) / greatest(1, size(lines))",
    "upper": r"(n - char_length(regexp_replace(t, '\\p{Lu}+', ''))) / greatest(1, n)",
    "digits": r"(n - char_length(regexp_replace(t, '[0-9]+', ''))) / greatest(1, n)",
    "marks": r"(n - char_length(regexp_replace(t, '[.,;:!?]+', ''))) / greatest(1, n)",
    "symbols": r"""(n - char_length(regexp_replace(t, '[^\\p{L}\\p{N}\\s.,;:!?]+', ''))) / greatest(1, n)""",
    "commas": "(n - char_length(replace(t, ',', ''))) / greatest(1, n)",
    "exclamations": "(n - char_length(replace(t, '!', ''))) / greatest(1, n)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the statistics of each row's whole text; null is the empty text, whose shares are 0."""
    rows = plain(docs, id_col, text_col).select(
        "doc_id", F.col("text").alias("t"), F.char_length("text").alias("n"),
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.split("text", r"\n").alias("lines"),
    )
    return rows.select("doc_id", *[F.expr(e).cast("double").alias(name) for name, e in STATISTICS.items()])


def paths(tree: str) -> Iterator[Rule]:
    """The path to each node below the root, read from a tree's printed form."""
    above: list[Condition] = []
    for line in tree.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            depth = len(found[1]) - 2
            above = [*above[:depth], (list(STATISTICS)[int(found[2])], found[3], float(found[4]))]
            yield tuple(above)


def merged(rule: Rule) -> Rule:
    """One condition per statistic and direction: the narrowest, in a fixed order."""
    kept: dict[tuple[str, str], float] = {}
    for name, way, value in rule:
        known = kept.get((name, way), value)
        kept[name, way] = min(known, value) if way == "<=" else max(known, value)
    return tuple(sorted((name, way, value) for (name, way), value in kept.items()))


def distinct_rules(rules: Sequence[Rule]) -> list[Rule]:
    """Each rule once; of a single condition and its opposite only one, since they carry the same."""
    found = set(map(merged, rules))
    return sorted(
        r for r in found if not (len(r) == 1 and r[0][1] == ">" and ((r[0][0], "<=", r[0][2]),) in found))


def holds(rule: Rule) -> Column:
    """The rule as a column over the statistics."""
    column_ = F.lit(True)
    for name, way, value in rule:
        column_ = column_ & (F.col(name) <= value if way == "<=" else F.col(name) > value)
    return column_


@dataclass(frozen=True)
class RuleModel:
    """Rules with a weight other than zero, and what a text scores that no rule fits."""

    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def score(self) -> Column:
        """All rules compiled into one column over the statistics, in [0, 1]."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(holds(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def train(
    stats: DataFrame, labels: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO,
    folds: int = FOLDS, label: str = "quality",
) -> RuleModel:
    """Fit on the rows of :func:`statistics` that have a label and are not held out.

    Of several labels of one id the lowest counts; null and other values are no labels. Both
    labels weigh the same. With one label only the model is a constant: the log odds of the
    counts plus a half each. ``stats`` is read several times, so it should be a written table.
    """
    given = (
        labels.select(column("doc_id").cast("long").alias("doc_id"), column(label).cast("double").alias("y"))
        .where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
        .where(remainder(F.col("doc_id"), folds) != 0)
    )
    rows = written(
        stats.join(given, "doc_id").withColumn("features", array_to_vector(F.array(*STATISTICS))), "labelled")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # two rows at most
    good, bad = counts.get(1.0, 0), counts.get(0.0, 0)
    if not good or not bad:
        return RuleModel((), log((good + 0.5) / (bad + 0.5)))
    weighed = rows.withColumn("weight", F.when(F.col("y") == 1, (good + bad) / 2 / good).otherwise((good + bad) / 2 / bad))
    boosted = GBTClassifier(
        labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=STEP,
        minInstancesPerNode=LEAST_ROWS, seed=SEED,
    ).fit(weighed)
    rules = distinct_rules([rule for tree in boosted.trees for rule in paths(tree.toDebugString)])
    if not rules:
        return RuleModel((), 0.0)
    indicators = weighed.select(
        "y", "weight", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features"))
    fitted = LogisticRegression(
        labelCol="y", weightCol="weight", elasticNetParam=1.0, regParam=lasso, maxIter=100,
    ).fit(indicators)
    kept = tuple((r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray()) if w != 0)
    return RuleModel(kept, float(fitted.intercept))


def scored(stats: DataFrame, model: RuleModel, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of :func:`statistics`; equal texts score alike.

    Empty and null texts have a score too; repeated rows are scored each; an empty table gives no rows.
    """
    return stats.select(
        "doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), model.score().alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
