"""Language identification by hierarchical discrimination.

A text becomes the relative weights of its hashed letter 1-, 2- and 3-grams.
A linear support vector machine first separates the language families; inside
the family it picks, one-versus-one machines separate the close languages.
The machines are trained on a bounded sample of labelled rows, whose profiles
Spark computes.

Defined results: a null text, an empty text and a text without a letter give
``und`` with score 0. Rows are scored one by one, so ties and repeated rows
give equal answers, and the columns of the input are read by name only. A
family or the set of families with one member needs no machine. Without any
labelled row every text is ``und``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lagscope.llm.common import bounded_sample, fold, fresh, settle
from lagscope.llm.linear import fit_sparse

# ---------------------------------------------------------------------------
# Language families by ISO 639-1 code. A code that is not
# listed is a family of its own.
# ---------------------------------------------------------------------------
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms su tl",
}
# ---------------------------------------------------------------------------
UNDETERMINED = "und"
#: Rows of a language that the machines learn from, at most.
SAMPLE_PER_LANGUAGE = 700
#: Code points of the short passage learned beside each whole sample text.
SHORT = 60
DIMENSIONS = 1 << 12

_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.lower().split("-")[0], language)


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def profile(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(indices, values) of the hashed letter n-grams, of length 1; None
    without a letter."""
    if not text:
        return None
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(_is_letter()[x], x, np.uint32(32))
    x = np.concatenate(([np.uint32(32)], x, [np.uint32(32)]))
    space = x == 32
    x = x[np.concatenate(([True], ~(space[1:] & space[:-1])))]
    if len(x) < 2:
        return None
    x = x * np.uint32(0x9E3779B1)
    two = (x[:-1] ^ (x[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (x[2:] >> np.uint32(11))) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    h = np.concatenate((x[1:-1] >> shift, two >> shift, three >> shift))
    n = np.bincount(h, minlength=DIMENSIONS)
    at = np.flatnonzero(n)
    v = np.sqrt(n[at])
    return at, v / np.sqrt(n.sum())


@dataclass(frozen=True)
class LanguageModel:
    """``families``: family -> languages. ``machines``: (group, first, second)
    -> row of ``weights``; a margin above 0 speaks for ``first``."""
    families: dict[str, tuple[str, ...]]
    machines: dict[tuple[str, str, str], int]
    weights: np.ndarray
    bias: np.ndarray

    def _winner(self, group: str, names: tuple[str, ...], margin: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for a, b in combinations(names, 2):
            m = float(margin[self.machines[group, a, b]])
            p = 1.0 / (1.0 + np.exp(-4.0 * m))
            votes[a if m > 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            least[a], least[b] = min(least[a], p), min(least[b], 1.0 - p)
        best = min(names, key=lambda x: (-votes[x], -sums[x], x))
        return best, float(least[best])

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = profile(text) if self.families else None
        if grams is None:
            return UNDETERMINED, 0.0
        at, v = grams
        margin = v @ self.weights[at] + self.bias
        family, p = self._winner("", tuple(self.families), margin)
        language, q = self._winner(family, self.families[family], margin)
        return language, p * q


def fit(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
        per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn every language that has a row, from at most ``per_language`` rows
    of each. The machines grow with the square of the families and of a
    family's languages; each is fitted in a task, from the profiles of its two
    sides, and only its weights (16 kB) come to the driver."""
    rows = bounded_sample(df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"),
                                    F.col(label).alias("label")), "key", "label", per_language,
                          max_classes=None)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, t, lang in zip(b["key"], b["text"], b["label"]):
                for piece in (t, t[len(t) // 2:][:SHORT]) if t else ():
                    if (g := profile(piece)) is not None:
                        out.append((key, lang, g[0].astype("<u2").tobytes(), g[1].astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["key", "label", "at", "v"])

    sample = settle(rows.select("key", "text", "label").mapInPandas(
        grams, "key string, label string, at binary, v binary"))
    languages = [r[0] for r in sample.select("label").distinct().orderBy("label").collect()]
    families: dict[str, tuple[str, ...]] = {}
    for x in languages:
        families[family_of(x)] = (*families.get(family_of(x), ()), x)
    sides = [("", a, b, families[a], families[b]) for a, b in combinations(families, 2)]
    sides += [(family, a, b, (a,), (b,)) for family, members in families.items()
              for a, b in combinations(members, 2)]
    if not sides:
        return LanguageModel(families, {}, np.zeros((DIMENSIONS, 0)), np.zeros(0))
    roles = sample.sparkSession.createDataFrame(
        [(x, i, y) for i, (_, _, _, ins, outs) in enumerate(sides)
         for y, members in ((True, ins), (False, outs)) for x in members], "label string, machine int, side boolean")

    def machine(b: pd.DataFrame) -> pd.DataFrame:
        """One machine from the rows of its two sides, in a fixed order."""
        b = b.sort_values(["key", "label", "at"], kind="stable")
        y = b["side"].to_numpy(bool)
        each = np.where(y, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (~y).sum())))
        rows = [(np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(float))
                for at, v in zip(b["at"], b["v"])]
        w, bias = fit_sparse(rows, y, DIMENSIONS, "hinge", each)
        return pd.DataFrame({"machine": [int(b["machine"].iloc[0])], "w": [w.astype("<f4").tobytes()], "bias": [bias]})

    fitted = (sample.join(roles, "label").groupBy("machine")
              .applyInPandas(machine, "machine int, w binary, bias double").orderBy("machine").collect())
    return LanguageModel(
        families, {side[:3]: i for i, side in enumerate(sides)},
        np.stack([np.frombuffer(r.w, "<f4") for r in fitted], axis=1), np.array([r.bias for r in fitted]))


def predictor(model: LanguageModel):
    """Pandas UDF text -> struct(lang_pred, score)."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in text], columns=["lang_pred", "score"])
    return predict


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """Column struct(lang_pred, score) for the whole of ``text``."""
    return predictor(model)(df[text])


def learnable(documents: DataFrame, folds: int = 3, out: int = 1) -> DataFrame:
    """Rows the contract lets the model learn from."""
    return documents.where((fold(F.col("doc_id"), folds) != out) & F.col("lang").isNotNull())


def op9(documents: DataFrame) -> DataFrame:
    model = fit(learnable(documents))
    return documents.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        identify(documents, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def stage(documents: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Rejects a document without a determined language, and one whose
    language is less likely than ``min_score``; keeps all columns."""
    model = fit(documents.where(F.col("lang").isNotNull()))
    p, = fresh(documents, "p")
    return (documents.withColumn(p, identify(documents, model))
            .where((F.col(f"{p}.lang_pred") != UNDETERMINED) & (F.col(f"{p}.score") >= min_score))
            .drop(p))
