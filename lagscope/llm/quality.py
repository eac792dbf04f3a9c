"""Quality score by a sparse rule ensemble.

Every whole text becomes a row of statistics. A forest of shallow trees
(Spark ML) is grown on a bounded sample of labelled rows; each path from a
root to a node is a rule, a conjunction of bounds on statistics. A lasso
logistic regression picks few rules and their weights, and the rules that are
left are compiled into one Spark column over the statistics.

Defined results: null and empty texts, and those of white space, have every
statistic 0 and the score that the rules give to that row. Rows are scored
one by one, so repeated rows get equal scores. Rows labelled twice count
twice. With labels of one class only, or none, the score is constant (the
class, or 0.5). An empty table gives an empty result. Columns are taken by
name; ids, sources, languages and labels are no statistics."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from lagscope.llm import forest
from lagscope.llm.common import bounded_sample, fold, settle
from lagscope.llm.linear import fit_lasso

#: Labelled rows of a class that are learned from, at most.
SAMPLE_PER_CLASS = 3000
TREES, DEPTH = 20, 3
L1 = 0.002
THRESHOLD = 0.3

STATISTICS = ("words", "word_length", "unique", "adjacent", "commonest", "lines", "repeated_lines",
              "line_words", "letters", "upper", "digits", "spaces", "marks", "symbols", "pipes",
              "exclaims", "long_words", "non_ascii")

_CLASSES = ("other", "lower", "upper", "digit", "space", "mark", "symbol")
_MARKS = ".,;:?!'\"()-"


def _class_of(c: str) -> int:
    if c.isdigit():
        return 3
    if c.isspace():
        return 4
    if c.isalpha():
        return 2 if c.isupper() else 1
    return 5 if c in _MARKS else 6 if c.isprintable() else 0


_TABLE = np.array([_class_of(chr(c)) for c in range(0x3000)], np.uint8)


def statistics(text: str | None) -> tuple[float, ...]:
    words = text.split() if text else []
    if not words:
        return (0.0,) * len(STATISTICS)
    n, chars = len(words), len(text)
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_TABLE[np.minimum(x, len(_TABLE) - 1)], minlength=len(_CLASSES)) / chars
    count = Counter(words)
    lines = [s for s in text.split("\n") if s.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    return (
        float(np.log1p(n)), float(lengths.mean()), len(count) / n,
        sum(map(operator.eq, words, words[1:])) / n, max(count.values()) / n,
        float(np.log1p(len(lines))), 1.0 - len(set(lines)) / len(lines), n / len(lines),
        float(kinds[1] + kinds[2]), float(kinds[2]), float(kinds[3]), float(kinds[4]), float(kinds[5]),
        float(kinds[6]), text.count("|") / n, text.count("!") / n, float((lengths > 15).mean()),
        float((x > 127).mean()))


def with_statistics(df: DataFrame, id_col: str = "doc_id", text: str = "text",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``keep`` and a column for every statistic."""
    types = dict(df.dtypes)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = pd.DataFrame([statistics(t) for t in b["text"]], columns=list(STATISTICS), index=b.index)
            yield pd.concat([b.drop(columns="text"), s], axis=1)

    fields = ["id string", *(f"{c} {types[c]}" for c in keep), *(f"{c} double" for c in STATISTICS)]
    return df.select(F.col(id_col).cast("string").alias("id"), *keep, F.col(text).alias("text")).mapInPandas(
        each, ", ".join(fields)).withColumn("id", F.col("id").cast(types[id_col]))


@dataclass(frozen=True)
class Rules:
    bias: float
    rules: tuple[tuple[tuple[forest.Condition, ...], float], ...]

    def score(self) -> Column:
        """The rules as one column over the statistics."""
        z = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for feature, below, at in conditions:
                x = F.col(STATISTICS[feature])
                holds = holds & ((x <= at) if below else (x > at))
            z = z + F.when(holds, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))

    def explain(self) -> list[str]:
        """The rules as text, heaviest first."""
        return [f"{w:+.3f}: " + " and ".join(f"{STATISTICS[f]} {'<=' if b else '>'} {t:.6g}" for f, b, t in c)
                for c, w in sorted(self.rules, key=lambda r: -abs(r[1]))]


def _rules_of(model) -> list[tuple[forest.Condition, ...]]:
    """Every different conjunction on a path from a root to a node."""
    found = {}
    for leaves in forest.paths(model):
        for conditions, _ in leaves:
            for k in range(1, len(conditions) + 1):
                found[frozenset(conditions[:k])] = tuple(sorted(set(conditions[:k])))
    return sorted(found.values())


def _constant(classes) -> Rules:
    """What can be said from one class, or none."""
    seen = set(classes)
    return Rules(0.0 if not seen else 30.0 if 1.0 in seen else -30.0, ())


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Rules:
    """Learn from at most ``per_class`` labelled rows of each class."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
             .select(F.col(key).alias("key"), F.col(label).cast("double").alias("label")))
    prior = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(prior) < 2:
        return _constant(prior)
    chosen = bounded_sample(known, "key", "label", per_class)
    rows = (documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .join(F.broadcast(chosen), "key"))   # 2 * per_class rows at most
    sample = settle(with_statistics(rows, "key", "text", ("label",)).repartition(4, "id"))
    data = sample.orderBy("id", "label").toPandas()
    y = data["label"].to_numpy()
    if len(set(y)) < 2:
        return _constant(y)
    grown = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, seed=3,
                                   featureSubsetStrategy="onethird").fit(
        sample.select(array_to_vector(F.array(*STATISTICS)).alias("features"), "label"))
    rules = _rules_of(grown)
    x = data[list(STATISTICS)].to_numpy(float)
    on = np.column_stack([forest.holds(x, r) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    w, b = fit_lasso(on, y, L1)
    # the sample has other class shares than the labels
    shift = np.log(prior[1.0] / prior[0.0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Rules(b + float(shift), tuple((r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6))


def score(df: DataFrame, rules: Rules, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, score)`` of every row."""
    return with_statistics(df, id_col, text).select("id", rules.score().alias("score"))


def op2(documents: DataFrame, labels: DataFrame) -> DataFrame:
    rules = fit(documents, labels.where(fold(F.col("doc_id"), 5) != 0))
    return score(documents, rules).select(
        F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
