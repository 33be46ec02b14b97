"""Documents with all the awkward cases, and random ones with planted copies."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators would like to use themselves.
CLASHES = ("text_digest", "bloom_hash", "bloom_repeated", "mix_rate", "mix_n", "mix_copy", "row_key", "maybe_grouped", "group_d", "log_weight", "gumbel_key", "c0", "key", "g", "r", "node", "root", "toxic_share")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def awkward(spark):
    rng = random.Random(1)
    long = words(rng, 40_000)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "", "en", "a", 0), (4, "   \n", "en", None, 4), (5, "!!! ???", "en", "a", 7), (6, "Ünïcode 日本 \U0001f600 ▁ x", "de", "b", 1),
        (7, "same text here", "en", "a", 1), (8, "same text here", "en", "b", 1), (8, "same text here", "en", "b", 1), (9, "same text here", "en", "a", 1), (None, "no id at all", "en", "a", 1), (None, "no id at all", "en", "a", 1), (10, long, "en", "c", len(long)), (11, "x" * 30_000, "en", "c", 30_000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def planted(seed=0, n=60, copies=12, size=80):
    """(rows, groups): documents, and ids of the near copies of each original."""
    rng, rows, groups = random.Random(seed), [], []
    for i in range(n):
        rows.append((i, words(rng, size), "en", f"s{i % 3}", 0))
    for k in range(copies):
        w = rows[k][1].split()
        for at in rng.sample(range(size), 3):
            w[at] = words(rng, 1)
        rows.append((n + k, " ".join(w), "en", "s0", 0))
        groups.append({k, n + k})
    return rows, groups


def empty(df):
    return df.where("1 = 0")


def plain(rows):
    return sorted(map(repr, rows))
