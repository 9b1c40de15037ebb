"""Dashboards from changes equal to recomputation."""

import random

import pytest
from gradus.operators import rollups as R

ROWS = "day string, kind string, value double, user int, times int"


def recomputed(rows):
    out = {}
    for day, kind, value, user in rows:
        out.setdefault((day, kind), []).append((value, user))
    return {k: (len(v), round(sum(x or 0 for x, _ in v), 6), len({u for _, u in v})) for k, v in out.items()}


def test_any_batches_equal_recomputation(spark, tmp_path):
    rng = random.Random(4)
    store = R.Rollups(spark, f"file://{tmp_path}/r", ["day", "kind"])
    there, after = [], {}
    for number in range(1, 6):
        changes = []
        for _ in range(40):
            row = (f"d{rng.randrange(3)}", rng.choice(["a", "b", None]), rng.choice([None, round(rng.random() * 10, 3)]), rng.choice([1, 2, 3, None]))
            there.append(row)
            changes.append((*row, 1))
        for _ in range(15):  # deletions, and corrections: the old row goes, a new one comes
            old = there.pop(rng.randrange(len(there)))
            changes.append((*old, -1))
            if rng.random() < 0.5:
                new = (*old[:2], 5.25, old[3])
                there.append(new)
                changes.append((*new, 1))
        df = spark.createDataFrame(changes, ROWS)
        store.apply(number, df, "value", "user")
        if number == 2:
            store.apply(number, df, "value", "user")  # done again
        if number == 3:
            store.compact(3)
        after[number] = recomputed(there)
    for number in (1, 2, 3, 4, 5, None):
        got = {(r.day, r.kind): (r.n, round(r.total, 6), r.members) for r in R.dashboard(store.read(number), store.keys).collect()}
        assert got == after[number or 5], number
    assert store._there("base") == [3]


def test_no_version(spark, tmp_path):
    with pytest.raises(ValueError):
        R.Rollups(spark, f"file://{tmp_path}/none", ["day"]).read()
