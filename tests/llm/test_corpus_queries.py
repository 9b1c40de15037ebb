"""The registered queries and the pipeline on the small tables."""

import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
from gradus.llm import lattice_lm, queries
from gradus.llm.common import crc_mod
from pyspark.sql import functions as F


def test_queries_equal_their_sql(spark, small):
    con = duckdb.connect()
    for name in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        want = con.sql(sql)
        got = queries.queries()[name](spark, small).select(want.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str), name


def test_query_columns(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    for name, columns in {
        "op1_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op3_sentencepiece": ["doc_id", "ids", "n_pieces", "lossless"],
        "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op5_sharding": ["doc_id", "shard"],
        "op6_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "word_score"],
        "op8_lz_fingerprint": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op9_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    }.items():
        found = queries.queries()[name](spark, small)
        assert set(columns) <= set(found.columns) and found.count() == n, name
    lz = queries.op8_lz_fingerprint(spark, small).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert lz[0] > lz[1] + 0.2


def test_lm_scores_beside_the_base(spark, small):
    """The base gives a word that no training text has the mass of one kind of word, whatever its letters; no model that spells can. So its bound is asked of word_score, where few words
    are new (sf0.1: 7 in 100; sf0.001: 29). score is exact (see the brute-force test); what the training texts teach it is worth two digits a token at least."""
    mean = lambda c: F.avg(F.col(c) / F.col("n_tokens"))
    lm = queries.op6_lm_scoring(spark, "/root/testdata/sf0.1").filter("held_out").agg(mean("word_score"), mean("base_score"), mean("score")).first()
    assert 1.15 * lm[1] < lm[0] < 0 and lm[2] < 0
    # What a model that spells may lose against the base, in digits a token: at most these margins at both sizes.
    least = queries.op6_lm_scoring(spark, small).filter("held_out").agg(mean("score"), mean("base_score")).first()
    assert lm[2] > lm[1] - 1.25 and least[0] > least[1] - 1.7
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False))
    docs = queries.table(spark, small, "documents").select("doc_id", "text")
    scores = [lattice_lm.scored(docs, ~held_out, lattice_lm.Settings(rounds=n)).filter(held_out).select("_lm.*").agg(mean("score")).first()[0] for n in (0, 3)]
    assert scores[0] + 2 < scores[1] < 0


def test_pipeline(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "exact_dedup":
            texts = [hashlib.sha256("".join(r.text.split()).encode()).digest() for r in docs.collect()]
            assert max(Counter(texts).values()) == 1
    assert sizes[0] == sizes[1] > sizes[2] >= sizes[3] > 0
    assert docs.filter("NOT lossless").count() == 0
    assert corpus_pipeline.run(spark, small).count() == sizes[-1]


def test_pipeline_drops_texts_without_language(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "x", 0), (-2, "123 456", None, None, None)], docs.schema)
    left = corpus_pipeline.identify(spark, docs.unionByName(odd), small)
    assert left.count() == docs.count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, _mix string, _lang_pred string, _ids int, `a.b` int"


def staged(spark, docs, tmp_path):
    """What each stage of the pipeline keeps of docs."""
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    return kept


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert [d.count() for d in staged(spark, spark.createDataFrame([], ODD), tmp_path)] == [0] * 5


def test_pipeline_without_labels_with_nulls_repeated_rows_and_clashing_names(spark, tmp_path):
    rows = [(i, t, None, s, None, "mine", "own", 7, i) for i, t, s in [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, "one  two three four five six ", None), (3, None, "a"), (4, "", "a"), (5, "12 34", "b"), (None, "seven words of a text that stays", "b"), (6, "long " * 60_000, "b")]]
    docs = spark.createDataFrame(rows, ODD)
    kept = staged(spark, docs, tmp_path)
    assert all(d.columns == docs.columns for d in kept[:4])
    assert sorted(kept[0].toPandas().doc_id.fillna(0)) == [0, 1, 1, 2, 6]
    assert sorted(kept[1].toPandas().doc_id.fillna(0)) == [0, 2, 6]
    assert {(r["_mix"], r["_lang_pred"], r["_ids"]) for r in kept[3].collect()} == {("mine", "own", 7)}
    assert kept[4].filter("NOT lossless").count() == 0
