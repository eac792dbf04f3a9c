"""Rows with nulls, empty and long texts, ties, repeats and clashing names."""

import random

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_documents(spark):
    rng = random.Random(3)
    long_ = " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) + str(rng.randrange(50)) for _ in range(30_000))
    rows = [(1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, None, None, None), (None, None, "fr", "a", None),
            (None, "one two three four", "en", None, 18), (3, " \t\n ", "de", "b", 4), (4, "x", "en", "a", 1),
            (5, "x y z", "en", None, 5), (5, "x y z", "en", None, 5), (6, long_, "en", "a", len(long_)),
            (7, "12345 ### 678", "es", "c", 13), (8, "Été 😀 naïve   end", "fr", "c", 20)]
    return spark.createDataFrame(rows, DOCUMENTS)


def clashing(df):
    """The same rows with extra columns that operators use names like."""
    from pyspark.sql import functions as F
    out = df
    for name in ("id", "key", "fp", "p", "size", "row", "n", "rank", "score", "masked", "bucket", "label", "pick"):
        out = out.withColumn(name, F.lit(7))
    return out


def table(spark, name, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
