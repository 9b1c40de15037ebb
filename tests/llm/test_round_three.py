"""Manifest, BPE and hard negatives against brute force; rows told apart; ids at both ends; texts longer than the operators' blocks."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradus.llm import bpe_codec, exact_dedup, hard_negatives, language_id, lattice_lm, merkle, minhash_dedup, queries, recompression, sentencepiece_codec
from gradus.llm.common import stored_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW, HIGH = -(2**63), 2**63 - 1


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha(*found[-1][i : i + 8]) for i in range(0, len(found[-1]), 8)])
    return found


def siblings(tree, at):
    for level in tree[:-1]:
        first = at - at % 8
        yield level[first:at], level[at + 1 : first + 8]
        at //= 8


def manifest_of(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by[lang].sort(key=lambda x: x[:3])
    trees = {lang: levels([x[2] for x in by[lang]]) for lang in langs}
    top = levels([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, (_, _, own, r) in enumerate(by[lang]):
            beside = [*siblings(trees[lang], at), *siblings(top, k)]
            hit = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            node = leaf(r, r.text.translate(lower)) if hit else own
            for left, right in beside:
                node = sha(*left, node, *right)
            out.append((r.doc_id, own, trees[lang][-1][0], top[-1][0], sha(*(x for pair in beside for side in pair for x in side)), node, node == top[-1][0]))
    return out


def test_manifest_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i if i % 50 else None, rng.choice(["Text", "lower", None, "", "Ä Ö " * 9]), rng.choice(["en", "en", "en", None, "de"]), rng.choice(["a", None]), rng.choice([1, None])) for i in range(1500)]
    rows += [(LOW, "Long " * 500_000, "xx", None, 0), (HIGH, "e", "en", "a", 1), (7, "Same", "en", "a", 4), (7, "Same", "en", "a", 4), (7, "Same", "en", "a", 4)]
    rows += [(i, "T", f"l{i:03d}", "s", i) for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    found = merkle.document_manifest(docs.withColumn("tree", F.lit(1)).withColumn("id", F.lit(2)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(manifest_of(docs.collect()), key=str)
    assert merkle.document_manifest(docs.limit(0)).count() == 0
    one = merkle.document_manifest(docs.filter(f"doc_id = {HIGH}")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha()


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 513, 4097])
def test_manifest_of_any_size(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("Aa").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(2).cast("long").alias("n_chars"))
    assert sorted(map(tuple, merkle.document_manifest(docs).collect())) == sorted(manifest_of(docs.collect()))


def library(rows):
    t = bpe_codec.Codec.load(bpe_codec.MODEL).tokenizer
    ids = [t.encode(text or "", add_special_tokens=False).ids for _, text in rows]
    return sorted((i, x, t.decode(x, skip_special_tokens=False)) for (i, _), x in zip(rows, ids, strict=True))


BITS = ["the", "ing", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startof", "'s", "'S", "''", "==", "你好", "́", "K", "　", "İ", ",", "≠", "\x01", "9", "é", "\x1f", "|>", "_", "\n", "ll", " "]


def test_bpe_equals_the_library(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randrange(60)))) for i in range(800)] + [(1000, None), (1001, ""), (1002, " \t\x0b"), (LOW, "ends"), (5, "twice"), (5, "twice"), (1003, "word, " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_found": F.lit(1), "_body": F.lit(2), "_ids": F.lit(3)})
    found = bpe_codec.encoded(docs)
    assert sorted(map(tuple, found.select("doc_id", "_ids", "_decoded").collect())) == library(rows)
    assert sorted(map(tuple, found.select("doc_id", "_ids", bpe_codec.decode(spark, F.coalesce("_ids", F.array().cast("array<int>")))).collect())) == library(rows)
    assert bpe_codec.encoded(docs.limit(0)).count() == 0 and found.columns == ["doc_id", "text", "_found", "_body", "_ids", "_decoded"]


def unsplit(rng, n):
    kinds = [lambda: "a" * n, lambda: "".join(rng.choices("ab", k=n)), lambda: "".join(rng.choices("theinanr", k=n)), lambda: "".join(rng.choices("!=-", k=n)), lambda: "".join(rng.choices(BITS, k=n // 3)), lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé你", k=n))]
    return rng.choice(kinds)()


def test_tree_concatenation_equals_the_library():
    rng = random.Random(1)
    for long in (8, 20, 50):
        codec = bpe_codec.Codec.load(bpe_codec.MODEL, long)
        for _ in range(300):
            text = " ".join(unsplit(rng, rng.randrange(1, 300)) for _ in range(rng.randrange(1, 3)))
            ids, halves = [], []
            for kind, body in bpe_codec.parts(text, codec):
                if kind in ("cut", "end"):
                    halves.append(bpe_codec.merged(body, codec))
                    if kind == "end":
                        ids += bpe_codec.concatenated(halves, codec).ids
                        halves = []
                else:
                    ids += (codec.tokenizer if kind == "text" else codec.plain).encode(body, add_special_tokens=False).ids
            assert ids == codec.ids(text), (long, text)


def test_long_unsplit_texts_are_dealt_out(spark, tmp_path):
    rng = random.Random(3)
    rows = [(1, "a" * 200_000), (2, "".join(rng.choices("abcdefghij", k=150_001)) + " x y<|endoftext|>z"), (3, None), (4, "short"), (6, "=" * 120_000 + "'s"), (6, "=" * 120_000 + "'s"), (7, "9" * 60_000 + "é" * 60_000 + " tail, and"), (8, "<|endoftext|>" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = bpe_codec.encoded(docs)
    assert sorted(map(tuple, found.select("doc_id", "_ids", "_decoded").collect())) == library(rows)
    docs.write.parquet(str(tmp_path / "t"))
    again = bpe_codec.encoded(spark.read.parquet(str(tmp_path / "t")).filter("doc_id <> 3"))
    assert again.count() == len(rows) - 1


def test_bpe_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, len(x), sha(" ".join(map(str, x))), sha(t)) for i, x, t in library(rows))
    assert sorted(map(tuple, queries.op12_bpe(spark, small).collect())) == want


def test_hard_negatives_equal_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = con.sql(hard_negatives.SQL)
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, small).select(want.columns).collect())) == sorted(want.fetchall())


VECTORS = "vec_id long, embedding array<float>, label int, score string, rank int"


def mined_of(rows):
    rows = [(i, np.floor(256 * np.array(v, np.float64)).astype(object), (y + 1) % 10 if i % 7 == 0 else y) for i, v, y, *_ in rows if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=False))
    anchors = {}
    for i, v, y in rows:
        if i % 100 == 0 and (i not in anchors or (y, list(v)) < (anchors[i][1], list(anchors[i][0]))):
            anchors[i] = (v, y)
    for i, (v, y) in anchors.items():
        scored = sorted(((-dot(v, w), j, z) for j, w, z in rows if j != i))
        for pos, p in sorted({(s, j) for s, j, z in [x for x in scored if x[2] == y][:5]}):
            some = [(s, j) for s, j, z in scored if z != y and -30 * pos <= -100 * s <= -90 * pos][:10]
            out += [(i, p, r, j, -pos, -s) for r, (s, j) in enumerate(some, 1)]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "STRIPE", 100)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 20))
    rows = [(i, [float(x) for x in np.float32(centers[i % 12] + 0.4 * rng.normal(size=20))], int(rng.integers(0, 3)), "mine", 7) for i in range(900)]
    rows += [(1000, [float("nan")] * 20, 1, None, None), (1001, None, 1, None, None), (1100, rows[0][1], None, None, None), (1002, [None, 1.0], 1, None, None), (None, rows[1][1], 1, None, None), (1200, [], 1, None, None), (1300, [0.0] * 20, 1, None, None)]
    rows += [(800, rows[3][1], 0, None, None), (803, rows[5][1], 1, None, None), (803, rows[5][1], 1, None, None), (901, rows[7][1][:5], 2, None, None), (1400, [1e6] * 20, 2, None, None), (-1500, rows[8][1], 9, None, None), (1501, [float("inf")], 1, None, None)]
    found = hard_negatives.mined(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert sorted(map(tuple, found.collect())) == mined_of(rows)
    assert hard_negatives.mined(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mined(spark.createDataFrame(rows[:1], VECTORS)).count() == 0


def test_bounds_hold_every_score():
    rng = np.random.default_rng(8)
    for size, scale in ((3, 10), (64, 300), (100, 1e6)):
        width = max(64, 1 << (size - 1).bit_length())
        values = np.floor(rng.normal(size=(300, size)) * scale).astype(np.int64)
        values[5:60] = values[4] + rng.integers(-2, 3, size=(55, size))
        code, length, align = hard_negatives.coded(values, width)
        low, high = hard_negatives.Queries(values[:40], width).bounds(slice(0, 40), code, length, align)
        exact = hard_negatives.products(values[:40], values)
        assert (low <= exact).all() and (exact <= high).all()
        assert (high - low)[4, 5:60].max() < 2.0 * length[4] ** 2
    big = np.array([[2**62, 1]])
    assert hard_negatives.products(big, big)[0, 0] == HIGH and hard_negatives.products(np.array([[3 * 2**30, 1]]), np.array([[2**30, 7]]))[0, 0] == 3 * 2**60 + 7


def test_rows_of_files_are_told_apart_only_as_they_are(spark, tmp_path):
    place = str(tmp_path / "Join, Union and Expand")
    spark.range(100).select("id", (F.col("id") % 7).alias("Join")).write.parquet(place)
    df = spark.read.parquet(place)
    df.createOrReplaceTempView("of_files")
    for plain in (df, df.filter("Join > 2"), df.select("id"), df.withColumn("x", F.col("id") + 1).filter("x > 3")):
        assert stored_rows(plain) is not None
    other = [df.distinct(), df.dropDuplicates(["Join"]), df.limit(5), df.sample(0.5, seed=1), df.repartition(3), df.coalesce(1), df.orderBy("id"), df.union(df), df.join(df.select("Join"), "Join"), df.groupBy("Join").count()]
    other += [spark.table("of_files"), df.filter(F.rand() > 0.5), df.select("id", F.explode(F.array("Join"))), spark.range(5), df.mapInPandas(lambda x: x, df.schema)]
    for changed in other:
        assert stored_rows(changed) is None, changed._jdf.queryExecution().analyzed().toString()


def test_exact_dedup_at_both_ends_and_of_derived_rows(spark, tmp_path):
    rows = [(LOW, "same text", "en", "a", 1), (HIGH, "same  text", "en", "a", 1), (LOW, "other", "en", "a", 1), (HIGH, "other", "en", "a", 1), (0, None, None, None, None), (LOW, "", None, None, None), (None, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {(LOW, sha("sametext")): (HIGH, 2, False), (HIGH, sha("sametext")): (HIGH, 2, True), (LOW, sha("other")): (LOW, 2, True), (HIGH, sha("other")): (LOW, 2, False), (0, sha()): (LOW, 3, False), (LOW, sha()): (LOW, 3, True), (None, sha()): (LOW, 3, False)}
    spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 40).alias("text")).repartition(6).write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t"))
    assert exact_dedup.exact_dedup(files.distinct()).count() == exact_dedup.exact_dedup(files.dropDuplicates(["text"])).count() == 40
    few = exact_dedup.exact_dedup(files.limit(100))
    assert 1 <= few.count() <= 40 and few.groupBy("text").count().filter("count > 1").isEmpty()
    assert exact_dedup.exact_dedup(files.sample(0.5, seed=3)).groupBy("text").count().filter("count > 1").isEmpty()


def test_texts_longer_than_a_block(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(30_000)]
    long = " ".join(rng.choices(vocabulary, k=350_000))
    copied = long[:40_000].rsplit(" ", 1)[0]
    near = long + " tail of its own"
    assert len(long) > max(2_000_000, sentencepiece_codec.CHARS)
    rows = [(1, long, "en", "a", 0), (2, near, "en", "a", 0), (3, copied, "de", "a", 0), (4, "a short text that stands alone", "en", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    repeats = {r.doc_id: (r.n_words, r.n_removed) for r in recompression.without_repeats(docs).collect()}
    n = {i: len(t.split()) for i, t, *_ in rows}
    assert repeats == {1: (n[1], n[1]), 2: (n[2], n[1]), 3: (n[3], n[3]), 4: (n[4], 0)}
    assert sentencepiece_codec.encoded(docs).filter("NOT _lossless").count() == 0
    groups = {r.doc_id: r.component_id for r in minhash_dedup.near_groups(docs).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4}
    assert language_id.predicted(docs, language_id.fit(docs)).count() == 4
    scores = {r.doc_id: r["_lm"] for r in lattice_lm.scored(docs.select("doc_id", "text"), F.lit(True)).collect()}
    assert scores[1].n_tokens == n[1] + 1 and scores[1].score < scores[3].score < 0


def test_arrow_batches_of_any_shape():
    codec = bpe_codec.Codec.load(bpe_codec.MODEL)
    assert bpe_codec.encoded_batch(pa.array([], pa.string()), codec).to_pylist() == []
    assert bpe_codec.encoded_batch(pa.array([None, "a"]).slice(1), codec).to_pylist() == [codec.ids("a")]
