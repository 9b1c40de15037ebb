"""Agreement of orders by inversions, against all pairs."""

import random

import numpy as np
from gradus.operators import ranking as R
from pyspark.sql import functions as F


def brute(rows):
    signs = [(b[1] > a[1]) - (b[1] < a[1]) for a in rows for b in rows if a[0] < b[0]]
    return (sum(signs) / len(signs) + 1) / 2 if signs else 1.0


def test_greater_before():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 300):
        groups, values = np.sort(rng.integers(0, 4, n)), rng.integers(0, 12, n)
        want = [sum(groups[j] == groups[i] and values[j] > values[i] for j in range(i)) for i in range(n)]
        assert R.greater_before(groups, values).tolist() == want


def test_order_scores_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(0, i // 2, rng.randrange(50)) for i in range(1000)] + [(1 + i % 40, i // 90, rng.randrange(5)) for i in range(200)] + [(99, 1, 1), (None, 1, 1), (98, None, 1), (97, 1, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, o int, v int")
    by = {}
    for k, o, v in sorted(r for r in rows if None not in r):
        by.setdefault(k, []).append((o, v))
    got = {r.k: r.score for r in R.order_scores(df, "k", "o", "v").collect()}
    assert set(got) == set(by) and all(abs(got[k] - brute(v)) < 1e-12 for k, v in by.items())


def test_one_key_of_a_million_rows(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("o"), F.when(F.col("id") < n // 2, F.col("id") + n).otherwise(F.col("id")).alias("v"))
    half = n // 2
    assert abs(R.order_scores(df, "k", "o", "v").first().score - (1 - half * half / (n * (n - 1) / 2))) < 1e-12
