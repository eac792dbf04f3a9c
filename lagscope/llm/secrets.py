"""Secret scan with false-positive removal by a random forest.

Candidates are runs of key-like characters, values after an assignment and
private-key blocks, in whole texts. A random forest of Spark ML decides from
length, character classes and transitions, letter-pair likelihood, dictionary
coverage, path-likeness and neighbouring words which ones are secrets. It is
trained from labelled findings; ``labelled_findings`` makes them where no
reviewed ones are at hand: strings of known kinds, secret or harmless, set
among the words of sampled documents, and the corpus' own long words, numbers
and addresses as harmless ones. Words and letter pairs are counted over all
documents; the sample gives labelled findings only, and its texts stay in the
tasks.

Defined results: null and empty texts have no candidates. A string that
occurs several times is reported at every place. Rows are scanned one by one,
so repeated rows give equal findings; a null id is reported as null. An empty
table gives an empty result (and, if it is what the forest should learn from,
a forest learned from the made findings alone). Columns are taken by name."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from lagscope.llm import forest
from lagscope.llm.common import bounded_sample, fresh, settle

#: Documents that labelled findings are set in and taken from, at most.
SAMPLE_DOCUMENTS = 1500
#: Made findings, about; they are dealt out over the sample.
MADE = 4000
#: The dictionary: so many of the words that most documents have.
DICTIONARY_WORDS = 30_000
#: Words that a task counts before it sends them on.
HELD = 300_000
LEAST_LENGTH = 16          # of a run without an assignment
LEAST_VALUE = 8            # of a value after an assignment
THRESHOLD = 0.5
#: Tasks that label the sample.
TASKS = 16
MASK = "[SECRET]"

# ---------------------------------------------------------------------------
# Words beside secrets and beside harmless strings, and public
# prefixes of issued keys.
# ---------------------------------------------------------------------------
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key",
                "access_key", "auth", "bearer", "credential", "private_key", "client_secret", "authorization")
HARMLESS_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "etag", "uuid",
                  "guid", "revision", "version", "build", "file", "path", "image", "example", "isbn",
                  "integrity", "request", "trace")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "xoxb-",
            "xoxp-", "AIza", "SG.", "npm_", "eyJ", "-----BEGIN")
# ---------------------------------------------------------------------------
_RUN = re.compile(rf"[A-Za-z0-9+/_=.~@:%-]{{{LEAST_LENGTH},}}")
_SPLIT = re.compile(rf"^[A-Za-z_.-]{{2,30}}[=:]+(?=[^/=:]{{{LEAST_VALUE},}}$)")
_NAME = re.compile(r"([A-Za-z_-]{2,30})[\"']?\s{0,3}$")
_VALUE = re.compile(rf"\s{{0,3}}[\"']?([^\s\"',;<>()\[\]{{}}]{{{LEAST_VALUE},}})")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
_LETTERS = re.compile(r"[^\W\d_]+")
_END = "-----END"


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans of the candidates, in order and apart from each other."""
    if not text:
        return []
    spans, at = [], 0
    for word in text.split():
        if len(word) < LEAST_LENGTH:
            continue
        at = text.find(word, at)
        for m in _RUN.finditer(word):
            a, b = m.span()
            if cut := _SPLIT.match(m[0]):
                a += cut.end()
            run = word[a:b].rstrip(".:")
            if any(c.isdigit() for c in run) or len(run) >= LEAST_LENGTH:
                spans.append((at + a, at + a + len(run)))
        at += len(word)
    for sign in "=:":
        at = text.find(sign)
        while at >= 0:
            name = _NAME.search(text, max(0, at - 36), at)
            if name and any(w in name[1].lower() for w in SECRET_WORDS) and (v := _VALUE.match(text, at + 1)):
                spans.append(v.span(1))
            at = text.find(sign, at + 1)
    at = text.find("-----BEGIN")
    while at >= 0:
        if "PRIVATE KEY" in text[at:at + 64]:
            end = text.find(_END, at)
            stop = text.find("-----", end + len(_END)) if end >= 0 else -1
            spans.append((at, stop + 5 if stop >= 0 else at + len(text[at:].split("\n", 1)[0])))
        at = text.find("-----BEGIN", at + 1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass(frozen=True)
class Language:
    """What ordinary words look like: letter-pair log frequencies and words."""
    pairs: dict[str, float]
    words: frozenset[str]

    @staticmethod
    def of(df: DataFrame, text: str = "text") -> Language:
        """Counted over all of ``text``: the words of three letters or more
        that most rows have, up to ``DICTIONARY_WORDS`` (none of those that are
        as common as the first one too many), and the pairs of a-z in the
        words of all rows, once a row."""
        def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: Counter[str] = Counter()
            pairs: Counter[str] = Counter()

            def sent() -> pd.DataFrame:
                for w, n in held.items():
                    for i in range(len(w) - 1):
                        if "a" <= w[i] <= "z" and "a" <= w[i + 1] <= "z":
                            pairs[w[i:i + 2]] += n
                out = pd.DataFrame([(True, w, n) for w, n in held.items() if len(w) >= 3],
                                   columns=["word", "item", "n"])
                held.clear()
                return out

            for b in batches:
                for t in b["text"]:
                    held.update(set(_LETTERS.findall(t.lower())))
                    if len(held) > HELD:
                        yield sent()
            yield sent()
            yield pd.DataFrame([(False, p, n) for p, n in pairs.items()], columns=["word", "item", "n"])

        counts = settle(df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
                        .mapInPandas(runs, "word boolean, item string, n bigint")
                        .groupBy("word", "item").agg(F.sum("n").alias("n")))
        least = _least_kept(counts.where("word").select("n"), DICTIONARY_WORDS)
        top = counts.where(F.col("word") & (F.col("n") >= least)).select("item").collect()
        pairs = {r.item: r.n for r in counts.where("not word").collect()}  # 26 * 26 at most
        n = sum(pairs.values()) or 1
        return Language({p: math.log(c / n) for p, c in sorted(pairs.items())}, frozenset(r.item for r in top))

    def coverage(self, s: str) -> float:
        """Share of the characters in dictionary words, longest first."""
        covered = 0
        for run in _LETTERS.findall(s.lower()):
            i = 0
            while i < len(run):
                k = next((k for k in range(min(16, len(run) - i), 2, -1) if run[i:i + k] in self.words), 0)
                covered += k
                i += k or 1
        return covered / max(1, len(s))


def _least_kept(counts: DataFrame, most: int, parts: int = 1024) -> int:
    """The least ``n`` such that at most ``most`` rows have it or more. Looks
    at ``parts`` ranges of ``n`` at a time; only their sizes reach the driver."""
    low, high, above = 1, (counts.agg(F.max("n")).first()[0] or 0) + 1, 0
    while low < high:   # ``above`` rows have ``high`` or more
        width = -(-(high - low) // parts)
        sizes = dict(counts.where((F.col("n") >= low) & (F.col("n") < high))
                     .groupBy(F.floor((F.col("n") - low) / width)).count().collect())
        for part in sorted(sizes, reverse=True):
            if above + sizes[part] > most:
                low, high = low + part * width, min(high, low + (part + 1) * width)
                break
            above += sizes[part]
        else:
            return low
        if width == 1:
            return high
    return low


FEATURES = ("length", "entropy", "distinct", "digits", "upper", "lower", "hex", "transitions", "pairs",
            "dictionary", "path", "extension", "separators", "run", "prefix", "secret_word",
            "harmless_word", "assigned", "quoted", "letters_only", "digits_only")


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(text: str, a: int, b: int, language: Language) -> list[float]:
    s = text[a:b]
    n = len(s)
    count = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    kinds = [_kind(c) for c in s]
    low = s.lower()
    pairs = [language.pairs.get(low[i:i + 2], -14.0) for i in range(n - 1) if low[i:i + 2].isalpha()]
    longest = run = 1
    for x, y in zip(s, s[1:]):
        run = run + 1 if x == y else 1
        longest = max(longest, run)
    before = [w.lower() for w in _WORD.findall(text[max(0, a - 60):a])[-3:]]
    before += re.split(r"[_-]", before[-1]) if before else []
    lead = text[max(0, a - 4):a].rstrip("\"' ")
    return [
        float(n), entropy, len(count) / n, kinds.count(0) / n, kinds.count(2) / n, kinds.count(1) / n,
        float(all(c in string.hexdigits for c in s)),
        sum(x != y for x, y in zip(kinds, kinds[1:])) / n,
        sum(pairs) / len(pairs) if pairs else -14.0, language.coverage(s),
        float(s.count("/") + s.count("\\")), float(bool(re.search(r"\.[A-Za-z]{2,5}$", s))),
        sum(c in "-_.@:" for c in s) / n, longest / n, float(s.startswith(PREFIXES)),
        float(any(w in SECRET_WORDS for w in before)), float(any(w in HARMLESS_WORDS for w in before)),
        float(lead.endswith(("=", ":"))), float(a > 0 and text[a - 1] in "\"'"),
        float(s.isalpha()), float(s.isdigit()),
    ]


def _made(rng: random.Random, words: list[str]) -> tuple[str, str, str, int]:
    """(text before, string, text after, 1 for a secret) of one made finding."""
    def some(alphabet: str, lo: int, hi: int | None = None) -> str:
        return "".join(rng.choices(alphabet, k=rng.randint(lo, hi or lo)))

    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: rng.choice(words)
    name = rng.choice(("token", "secret", "password", "api_key", "apikey", "access_key", "auth_token",
                       "client_secret", "API_KEY", "SECRET", "passwd", "credential"))
    lead = rng.choice((f'{name} = "', f"{name}: ", f'"{name}": "', f"{name}=", f"export {name.upper()}=",
                       "Authorization: Bearer "))
    close = '"' if lead.endswith('"') else ""
    uuid = "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))
    path = "/".join(word() for _ in range(rng.randint(2, 5)))
    secret = [
        (lead, some(hexa, 32), close), (lead, some(hexa, 40), close), (lead, some(hexa, 64), close),
        (lead, some(alnum, 20, 44), close), (lead, some(alnum + "+/", 40, 64) + rng.choice(("", "=", "==")), close),
        (lead, some(alnum + "!@#$%^&*", 10, 20), close),
        ("", "AKIA" + some(string.ascii_uppercase + string.digits, 16), ""), ("", "ghp_" + some(alnum, 36), ""),
        ("", "sk_live_" + some(alnum, 24, 32), ""), ("", f"xoxb-{some(string.digits, 11)}-{some(alnum, 24)}", ""),
        ("", f"eyJ{some(alnum, 20, 40)}.eyJ{some(alnum, 40, 80)}.{some(alnum + '_-', 43)}", ""),
        ("", "-----BEGIN RSA PRIVATE KEY-----\n" + some(alnum + "+/", 64) + "\n-----END RSA PRIVATE KEY-----", ""),
    ]
    harmless = [
        (rng.choice(("commit ", "sha1: ", "revision ", "checksum = ", "md5 ", "digest: ", "etag: ", "build ")),
         some(hexa, rng.choice((32, 40, 64))), ""),
        (rng.choice(("", "id ", "uuid: ", "request ", "trace=")), uuid, ""),
        (rng.choice(("", "file ", "path: ")), f"/{path}.{rng.choice(('py', 'txt', 'html', 'json', 'png'))}", ""),
        ("", f"https://www.{word()}.example.com/{path}", ""), ("", f"{word()}.{word()}@mail.example.com", ""),
        (rng.choice(("", "image ")), f"data:image/png;base64,{some(alnum + '+/', 40, 80)}", ""),
        ("", "".join(w.capitalize() for w in (word(), word(), word(), word())), ""),
        ("", "_".join((word(), word(), word(), word())), ""), ("", "-".join((word(), word(), word(), word())), ""),
        ("", some(string.digits, 16, 20), ""), ("", word() + word() + word() + word(), ""),
        (lead, rng.choice(("x", "*", "0", ".")) * rng.randint(16, 40), close),
        (lead, rng.choice(("your_{}_here", "example-{}-value", "replace_with_{}", "insert-your-{}"))
         .format(name.lower()) + word(), close),
        (f"{word()} = ", f"{word()}.{word()}.{word()}_{word()}", ""),
        (rng.choice(("", "date ", "version ")), f"20{some(string.digits, 2)}-01-{some('012', 2)}T10:{some('012345', 2)}:00.000Z", ""),
    ]
    label = rng.random() < 0.45
    return (*rng.choice(secret if label else harmless), int(label))


def labelled_findings(df: DataFrame, language: Language, made: int = MADE, key: str = "doc_id",
                      text: str = "text", seed: int = 5) -> DataFrame:
    """``(x, label)``: features and labels of made findings set in the rows of
    ``df``, a bounded sample, and of all harmless strings of those rows
    themselves. Without a row, made findings alone."""
    words = sorted(w for w in language.words if w.isascii()) or list(HARMLESS_WORDS)
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.length("text") > 40)
    n = rows.count()
    if not n:
        rows = df.sparkSession.createDataFrame([("", " ".join(words[:500]))], "key string, text string")
    each, shared = math.ceil(made / max(1, n)), df.sparkSession.sparkContext.broadcast((language, words))

    def findings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        language, words = shared.value
        for b in batches:
            out: list[tuple[list[float], float]] = []
            for key, t in zip(b["key"], b["text"]):
                rng = random.Random(f"{seed} {key} {len(t)}")
                for _ in range(each):
                    cut = rng.randrange(len(t))
                    left, right = t[max(0, cut - 80):cut], t[cut:cut + 40]
                    before, s, after, label = _made(rng, words)
                    whole = f"{left} {before}{s}{after} {right}"
                    at = len(left) + 1 + len(before)
                    for a, z in candidates(whole):
                        if a < at + len(s) and z > at:
                            out.append((features(whole, a, z, language), float(label)))
                            break
                for a, z in candidates(t) if n else ():
                    if t[a:z].isalpha() or t[a:z].isdigit() or "@" in t[a:z]:
                        out.append((features(t, a, z, language), 0.0))
            yield pd.DataFrame(out, columns=["x", "label"])

    found = settle(rows.repartition(TASKS, "key").sortWithinPartitions("key", "text")
                   .mapInPandas(findings, "x array<double>, label double"))
    shared.destroy()
    return found


@dataclass(frozen=True)
class SecretModel:
    language: Language
    trees: list

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """(start, end, score) of the secrets of each text."""
        spans = [(k, a, b) for k, t in enumerate(texts) for a, b in candidates(t)]
        out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        for at in range(0, len(spans), 4096):
            part = spans[at:at + 4096]
            score = forest.vote(self.trees, np.array([features(texts[k], a, b, self.language)
                                                      for k, a, b in part]))
            for (k, a, b), p in zip(part, score):
                if p >= THRESHOLD:
                    out[k].append((a, b, float(p)))
        return out


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", trees: int = 30) -> SecretModel:
    """Train from labelled findings in at most ``SAMPLE_DOCUMENTS`` texts."""
    language = Language.of(df, text)
    rows = bounded_sample(df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"),
                                    F.lit(1).alias("all")), "key", "all", SAMPLE_DOCUMENTS)
    data = labelled_findings(rows, language, key="key").select(array_to_vector("x").alias("features"), "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=7, minInstancesPerNode=3, seed=3,
                                   featureSubsetStrategy="sqrt").fit(data)
    return SecretModel(language, forest.paths(model))


def scan(df: DataFrame, model: SecretModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, start, n_chars, score, finding)`` of every secret; ``start``
    counts code points from 0."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            yield pd.DataFrame(
                [(key, s, e - s, p, t[s:e]) for key, t, found in zip(b["id"], texts, shared.value.find(texts))
                 for s, e, p in found], columns=["id", "start", "n_chars", "score", "finding"])

    id_type = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).where(
        F.col("text").isNotNull()).mapInPandas(
        find, "id string, start long, n_chars long, score double, finding string").withColumn(
        "id", F.col("id").cast(id_type))


def op8(documents: DataFrame) -> DataFrame:
    return scan(documents, fit(documents)).select(
        F.col("id").alias("doc_id"), "start", "n_chars", "score",
        F.sha2("finding", 256).alias("finding_sha256"))


def stage(documents: DataFrame) -> DataFrame:
    """Masks every secret in the texts; ``n_chars`` follows the text where it
    was masked. All documents stay."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents))

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        """The text with secrets masked; null where it has none."""
        values = texts.tolist()
        out = []
        for t, found in zip(values, shared.value.find(values)):
            for s, e, _ in reversed(found):
                t = t[:s] + MASK + t[e:]
            out.append(t if found else None)
        return pd.Series(out, dtype=object)

    m, = fresh(documents, "masked")
    rows = documents.withColumn(m, masked("text"))
    changed = F.col(m).isNotNull()
    put = {"text": F.coalesce(m, "text")}
    if "n_chars" in documents.columns:
        put["n_chars"] = F.when(changed, F.length(m).cast("bigint")).otherwise(F.col("n_chars"))
    return rows.select(*[put.get(c, F.col(c)).alias(c) for c in documents.columns])
