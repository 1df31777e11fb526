import random

from pyspark.sql import DataFrame, SparkSession

#: A documents table with columns of clashing names beside the usual ones.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs string, k long, node long, _doc long, grade string, kind string"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", "s1", len(t or ""), "r", 7, 8, 9, "g", "k") for i, t in rows], SCHEMA)


def odd_texts() -> list[tuple]:
    """Nulls, blanks, very long and repeated texts, odd characters."""
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "ñandú", "日本", "x"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(0, 90))) for _ in range(40)]
    long = " ".join(r.choice(words) + str(r.randint(0, 5)) for _ in range(30_000))
    rows = base + base[:10] + [None, "", " ", "\n\t ", long, long + " end", "one", "a b c d", "\u00a0only\u00a0", "emoji 😀 here", "x" * 5000, "the same " * 200]
    rows += [" ".join(f"u{r.randint(0, 10**9)}" for _ in range(30)) + " " + b for b in base[:10]]
    return list(enumerate(rows))
