"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models over
the words and word beginnings that a text contains; every later model also
sees the earlier categories' probabilities. It is trained with out-of-fold
predictions of the earlier models, so it learns from probabilities as wrong
as those it will meet, and applied with those of the models fitted on all
folds. For each fold the terms and marked words are chosen anew, from the
other folds alone; near copies are in one fold.

``labels`` marks one category, ``toxic``. Two more are read off the rows it
marks: ``dense`` (marked words are a fiftieth of the words or more) and
``repeated`` (three marked words or more); marked words are those whose share
of toxic rows is significantly above their share of the others.

Defined results: null and empty texts, and those without a letter, have no
terms and get the scores of a text in which nothing speaks for a category.
Rows are scored one by one, so repeated rows get equal scores. Without toxic
labels every score is 0. Equal texts and near copies of one label are learned
from once, so a document labelled twice alike is one row, and one labelled both
ways is a row of either class; near copies are texts whose word pairs agree in
``MINIMA`` minima, each of a hash of its own. An empty table gives an empty
result. Columns are taken by name. Ids may have any type."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from lagscope.llm.common import bounded_sample, settle
from lagscope.llm.linear import fit_sparse, sigmoid

#: Labelled rows of a class that are learned from, at most.
SAMPLE_PER_CLASS = 4000
MAX_TERMS = 6000
MIN_Z = 4.0
MIN_ROWS = 3
MINIMA = 4
FOLDS = 3
CATEGORIES = ("dense", "repeated", "toxic")
DENSE, REPEATED = 0.02, 3
THRESHOLD = 0.5

_WORDS = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6)


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def terms(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(f"{word[:k]}*" for k in _STEMS if len(word) > k)]


def _kin(found: list[str], text: str | None) -> str:
    """Equal for equal texts, and mostly for near copies alone: the word pairs
    of least hash by several hashes. A text without words is its own kind."""
    if not found:
        return xxhash.xxh3_128_hexdigest((text or "").encode("utf-8", "surrogatepass"))
    encoded = [f"{a} {b}".encode("utf-8", "surrogatepass") for a, b in set(zip(found, [*found[1:], ""]))]
    return " ".join(f"{min(xxhash.xxh3_64_intdigest(w, seed) for w in encoded):x}" for seed in range(MINIMA))


@dataclass(frozen=True)
class Chain:
    terms: dict[str, int]
    models: tuple[tuple[np.ndarray, float], ...]   # weights: terms, then earlier categories
    categories: tuple[str, ...]

    def row(self, text: str | None) -> np.ndarray:
        get = self.terms.get
        return np.unique(np.array([i for w in set(words(text)) for t in terms(w)
                                   if (i := get(t)) is not None], np.int64))

    def predict(self, text: str | None) -> list[float]:
        at, earlier = self.row(text), []
        n = len(self.terms)
        for w, b in self.models:
            earlier.append(float(sigmoid(w[at].sum() + w[n:n + len(earlier)] @ np.array(earlier) + b)))
        return earlier or [0.0] * len(self.categories)


def _term_counts(sample: DataFrame) -> DataFrame:
    """``(term, pos, neg)``: rows of either class that have the term, by fold."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(t, y, f) for text, y, f in zip(b["text"], b["label"], b["fold"])
                                for t in {t for w in set(words(text)) for t in terms(w)}],
                               columns=["term", "label", "fold"])

    by_fold = lambda v: F.array(*[F.sum(F.when(F.col("fold") == f, v).otherwise(0)) for f in range(FOLDS)])
    return (sample.select("text", "label", "fold").mapInPandas(each, "term string, label int, fold int")
            .groupBy("term").agg(by_fold(F.col("label")).alias("pos"), by_fold(1 - F.col("label")).alias("neg")))


def _marked(counts: DataFrame, sizes: dict[tuple[int, int], int], folds: list[int]) -> pd.DataFrame:
    """``(term, pure)``: what speaks for toxic rows in these folds; a pure word
    is nearly always in toxic rows."""
    n1, n0 = (sum(sizes.get((y, f), 0) for f in folds) for y in (1, 0))
    if not n1 or not n0:
        return pd.DataFrame({"term": [], "pure": []})
    p, q = (sum(F.col(c)[f] for f in folds) for c in ("pos", "neg"))
    share = (p + q) / (n1 + n0)
    z = (p / n1 - q / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    return (counts.where(p >= MIN_ROWS).select("term", z.alias("z"), (p / n1 > 20 * q / n0).alias("pure"))
            .where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "term").limit(MAX_TERMS).toPandas())


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Chain:
    """Learn from at most ``per_class`` labelled rows of each class."""
    chosen = bounded_sample(labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
                            .select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")),
                            "key", "label", per_class)

    def kin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(kin=[_kin(words(t), t) for t in b["text"]])

    rows = (documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .join(F.broadcast(chosen), "key")   # 2 * per_class rows at most
            .where(F.col("text").isNotNull()).withColumn("key", F.col("key").cast("string"))
            .mapInPandas(kin, "key string, text string, label int, kin string"))
    sample = settle(rows.groupBy("label", "kin").agg(F.min_by("text", "key").alias("text"), F.min("key").alias("key"))
                    .withColumn("fold", F.pmod(F.xxhash64("kin"), F.lit(FOLDS)).cast("int")))
    sizes = {(r[0], r[1]): r[2] for r in sample.groupBy("label", "fold").count().collect()}
    if len({y for y, _ in sizes}) < 2:
        return Chain({}, (), CATEGORIES)
    counts = settle(_term_counts(sample))
    every = list(range(FOLDS))
    # one choice of terms for all folds, then one for each fold, without it
    choices = [_marked(counts, sizes, every), *(_marked(counts, sizes, [g for g in every if g != f]) for f in every)]
    index: dict[str, int] = {}
    for choice in choices:
        for t in choice["term"]:
            index.setdefault(t, len(index))
    n, total = len(choices[0]), len(index)   # the first n terms are those of all folds
    allowed = [np.isin(np.arange(total), [index[t] for t in choice["term"]]) for choice in choices]
    pure = [set(choice["term"][choice["pure"].astype(bool)]) for choice in choices]
    vocabulary = Chain(index, (), CATEGORIES)

    def row(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, y, f in zip(b["text"], b["label"], b["fold"]):
                found = [terms(w) for w in words(t)]
                hits = [sum(1 for w in found if not some.isdisjoint(w)) for some in pure]
                out.append((y, f, vocabulary.row(t).tolist(), hits, len(found)))
            yield pd.DataFrame(out, columns=["label", "fold", "at", "hits", "words"])

    data = (sample.orderBy("key", "label", "kin").select("text", "label", "fold")
            .mapInPandas(row, "label int, fold int, at array<int>, hits array<int>, words int").toPandas())
    y, fold, size = (data[c].to_numpy() for c in ("label", "fold", "words"))
    y, hits = y.astype(bool), np.array(data["hits"].tolist(), np.int64)
    base = [np.asarray(a, np.int64) for a in data["at"]]
    oof, models = np.zeros((len(base), 0)), []

    def features(choice: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of every row: the terms of this choice, then the earlier categories."""
        more = total + np.arange(oof.shape[1])
        own = [a[allowed[choice][a]] for a in base]
        return [(np.concatenate((a, more)), np.concatenate((np.ones(len(a)), p))) for a, p in zip(own, oof)]

    for category in CATEGORIES:
        def target(choice: int) -> np.ndarray:
            marked = hits[:, choice]
            return y & {"toxic": True, "repeated": marked >= REPEATED, "dense": marked >= DENSE * size}[category]

        held, k = np.zeros(len(base)), oof.shape[1]
        for f in every:
            learn, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            known, aim = features(f + 1), target(f + 1)
            w, b = fit_sparse([known[i] for i in learn], aim[learn], total + k, epochs=6, l2=1e-3)
            held[out] = sigmoid(np.array([v @ w[a] + b for a, v in (known[i] for i in out)]))
        w, b = fit_sparse(features(0), target(0), total + k, epochs=6, l2=1e-3)
        models.append((np.concatenate((w[:n], w[total:])), b))
        oof = np.column_stack((oof, held))
    return Chain({t: i for t, i in index.items() if i < n}, tuple(models), CATEGORIES)


def score(df: DataFrame, model: Chain, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and the probability of every category."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    id_type = dict(df.dtypes)[id_col]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [shared.value.predict(t) for t in b["text"]]
            yield pd.DataFrame(p, columns=list(model.categories), index=b.index).assign(id=b["id"])

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(
        each, ", ".join(["id string", *(f"{c} double" for c in model.categories)])).withColumn(
        "id", F.col("id").cast(id_type))


def op1(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, fit(documents, labels)).select(
        F.col("id").alias("doc_id"), (F.col("toxic") >= THRESHOLD).cast("int").alias("toxic"),
        F.col("toxic").alias("score"), F.col("repeated").alias("score_repeated"),
        F.col("dense").alias("score_dense"))
