"""Each operator against a brute-force version or hand-made rows, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradus.llm import exact_dedup, language_id, lattice, lattice_lm, lz_fingerprint, minhash_dedup, mixing, quotation, recompression, sentencepiece_codec, sharding
from gradus.llm.common import crc_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, kinds=200):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, n) for n in (0, 1, 3, 5, 34, 35, 36, 60, 80, 120, 400)]
    passage = words(random.Random(9), 50, 10_000)
    texts = [*base, *base[3:7], None, "", " \t\n", base[7].upper(), base[8] + " tail", f"{base[9]} {passage}", f"{passage} {base[8]}", "x " * 3000, "日本語 😀 é ▁ \x00", passage]
    out = [(i, t, ("en", "de", None)[i % 3], ("a", "a", "b", None)[i % 4], len(t or "")) for i, t in enumerate(texts)]
    out += [(3, base[5], "en", "a", 0), (3, base[5], "en", "a", 0), (None, base[6], None, None, 7777), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows, DOCS).coalesce(3).write.parquet(place)
    return spark.read.parquet(place)


@pytest.fixture(scope="module")
def clashing(docs):
    names = ["_metadata", "_file", "_text", "_training", "_row", "_source", "_order", "_block", "_plan0", "_epoch", "_lang", "_both", "_gone_id", "_kept_id", "_place", "_merge", "path", "row", "n", "bucket", "hash", "norm", "sha", "a.b"]
    return docs.withColumns({n: F.lit(i) for i, n in enumerate(names)})


def test_substring_dedup(docs, rows):
    counts, split = Counter(), [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for _, ws in split:
        counts.update(tuple(ws[k : k + 35]) for k in range(len(ws) - 34))
    want = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - 34):
            if counts[tuple(ws[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        want.append((i, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in recompression.without_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert recompression.without_repeats(docs.filter("doc_id = -1")).count() == 0


def test_substring_dedup_on_periodic_texts(spark, tmp_path):
    texts = ["a " * 90, "a " * 50, "a b " * 40, "b a b " * 30, "a b c " * 13, " ".join(str(i) for i in range(40)), "z " + " ".join(str(i) for i in range(36))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = {r.doc_id: r.n_removed for r in recompression.without_repeats(spark.read.parquet(str(tmp_path / "t")), texts_too=True).collect()}
    split = [t.split() for t in texts]
    counts = Counter(tuple(ws[k : k + 35]) for ws in split for k in range(len(ws) - 34))
    for i, ws in enumerate(split):
        assert got[i] == len({p for k in range(len(ws) - 34) if counts[tuple(ws[k : k + 35])] > 1 for p in range(k, k + 35)})


CHAT = [
    (1, 0, "user", "Where is the station?\nI have a map."),
    (1, 1, "assistant", "> where is  the STATION?\nTwo streets down."),
    (1, 2, "user", "A new subject."),
    (1, 3, "user", "> Two streets down.\n> > Where is the station?\nThanks!"),
    (1, 4, "assistant", ">> A new subject.\n>Thanks!\nWelcome.\n"),
    (1, 5, None, None),
    (1, 6, "user", ""),
    (2, 0, "user", "> Two streets down.\nNothing to find here."),
    (2, 0, "user", "> Two streets down.\nNothing to find here."),
    (None, 1, "user", "> Thanks!"),
    (2, None, "user", "late"),
]


def test_quotation_linking(spark):
    found = quotation.linked(spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn): r for r in found.collect()}
    assert found.count() == len(CHAT)
    assert (got[1, 1].parent_turn, got[1, 1].thread_turn, got[1, 1].depth, got[1, 1].content) == (0, 0, 1, "Two streets down.")
    assert (got[1, 2].parent_turn, got[1, 2].thread_turn, got[1, 2].depth) == (None, 2, 0)
    assert (got[1, 3].parent_turn, got[1, 3].thread_turn, got[1, 3].depth, got[1, 3].max_level) == (1, 0, 2, 2)
    assert (got[1, 4].parent_turn, got[1, 4].thread_turn, got[1, 4].depth) == (3, 0, 3)
    assert (got[1, 5].role, got[1, 5].content, got[1, 6].n_quoted) == ("unknown", "", 0)
    assert got[2, 0].parent_turn is None and got[2, 0].content == "Nothing to find here."
    assert got[1, 3].formatted == "<|user|>\nThanks!\n<|end|>\n"
    order = [r.turn for r in found.filter("conv_id = 1").orderBy("thread_turn", "turn").collect()]
    assert order == [0, 1, 3, 4, 2, 5, 6]
    assert quotation.linked(found.sparkSession.createDataFrame([], "conv_id long, turn long, role string, text string, lines int")).count() == 0


def test_quotation_of_rewrapped_and_partial_passages(spark):
    chat = [
        (1, 0, "The station is near. It was built in stone and it has\ntwo platforms. Trains leave hourly."),
        (1, 1, "Something else was said here. Nobody knows why."),
        (1, 2, "> It was built in\n> stone and it has two\n> platforms.\nGood."),
        (1, 3, "> Nobody knows why.\nI do."),
        (1, 4, "> Trains leave   HOURLY.\n> > Something else was\n> > said here.\nNot on Sundays."),
        (1, 5, "> Not a sentence of\n> this conversation.\nOh."),
        (1, 6, "> Good.\n> It was built in stone and it has two platforms. The\n> station is near.\nBoth."),
        (2, 0, "> Nobody knows why.\nAnother conversation."),
    ]
    rows = [(c, t, "user", x) for c, t, x in chat]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn) for r in quotation.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): (None, 0), (1, 1): (None, 1), (1, 2): (0, 0), (1, 3): (1, 1), (1, 4): (0, 0), (1, 5): (None, 5), (1, 6): (0, 0), (2, 0): (None, 0)}


def test_quotation_of_passages_and_nearest_originals(spark):
    chat = [
        (1, 0, "Thanks"),
        (1, 1, "A long\npassage here"),
        (1, 2, "Thanks"),
        (1, 3, "> A long passage\n> here\nYes."),
        (1, 4, "> Thanks\nWelcome."),
        (1, 5, "> Yes.\n>> A long\n>> passage\n>> here\nNo."),
        (1, 2000, "> thanks\nLate."),
        (1, 2001, "> Nothing of the kind\nOh."),
        (None, 7, "> Thanks"),
    ]
    found = quotation.linked(spark.createDataFrame([(c, t, "user", x) for c, t, x in chat], "conv_id long, turn long, role string, text string"))
    got = {r.turn: (r.parent_turn, r.thread_turn, r.depth, r.position) for r in found.collect()}
    assert got == {0: (None, 0, 0, 0), 1: (None, 1, 0, 1), 3: (1, 1, 1, 2), 5: (3, 1, 2, 3), 2: (None, 2, 0, 4), 4: (2, 2, 1, 5), 2000: (2, 2, 1, 6), 2001: (None, 2001, 0, 7), 7: (None, 7, 0, None)}


def test_quotation_linking_equals_sql(spark):
    import duckdb
    import pandas as pd

    conversations = pd.DataFrame(CHAT, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    want = duckdb.sql(quotation.SQL)
    got = quotation.linked(spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")).select(want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_sentencepiece_round_trip_and_seed(docs, clashing):
    got = sentencepiece_codec.encoded(docs).collect()
    assert all(r._lossless is (None if r.text is None else True) for r in got)
    assert [r._ids for r in got if r.text is None] == [None, None]
    again = {(r.doc_id, r.text): r._ids for r in sentencepiece_codec.encoded(docs.repartition(7)).collect()}
    assert all(again[r.doc_id, r.text] == r._ids for r in got)
    assert set(clashing.columns) <= set(sentencepiece_codec.encoded(clashing).columns)
    assert sentencepiece_codec.encoded(docs.filter("doc_id = -1")).count() == 0


def test_sentencepiece_samples_by_weight():
    vocab = lattice.Vocabulary.load(sentencepiece_codec.MODEL).prepare()
    ids, counts = sentencepiece_codec.sample([" then"] * 20_000, np.arange(20_000).astype(np.uint64), vocab)
    seen = Counter(map(tuple, np.split(ids, np.cumsum(counts)[:-1])))
    by_text = {p: i for i, p in enumerate(vocab.pieces) if p}

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in by_text:
                yield from ((by_text[s[:k]], *rest) for rest in ways(s[k:]))

    weight = {w: math.exp(sum(vocab.log_w[list(w)])) for w in ways("▁then")}
    total = sum(weight.values())
    assert len(weight) > 3 and all(abs(seen[w] / 20_000 - x / total) < 0.015 for w, x in weight.items())


def test_language_id(spark, small, docs, clashing):
    table = spark.read.parquet(f"{small}/documents.parquet")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = language_id.fit(table.filter(~held))
    found = language_id.predicted(table.filter(held), model).collect()
    assert sum(r.lang == r._lang_pred for r in found) >= 0.97 * len(found)
    odd = {r.doc_id: r for r in language_id.predicted(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the")], "doc_id int, text string"), model).collect()}
    assert [odd[i]._lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[1]._lang_score == 0 and odd[4]._lang_pred in model.languages and 0 < odd[4]._lang_score <= 1
    assert set(clashing.columns) <= set(language_id.predicted(clashing, model).columns)
    none = language_id.fit(docs.filter("doc_id = -1"))
    assert {r._lang_pred for r in language_id.predicted(docs, none).collect()} == {"und"}


def test_language_id_against_brute_force(spark):
    rng = random.Random(3)
    alphabets = [("aa", "abcde"), ("bb", "cdefg"), ("cc", "Éfghi")]
    rows = [(i, alphabets[i % 3][0], " ".join("".join(rng.choice(alphabets[i % 3][1]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30)))) for i in range(180)]
    train, asked = rows[:120], [*rows[120:], (998, None, "12"), (999, None, None)]
    settings = language_id.Settings(bits=10, docs_a_language=1000, length_scale=1e9)
    schema = "doc_id long, lang string, text string"
    counts = {x: np.full(1 << 10, settings.alpha) for x in ("aa", "bb", "cc")}
    for _, lang, text in train:
        np.add.at(counts[lang], language_id.grams([text], settings)[0], 1)
    log_p = {x: np.log(c / c.sum()) for x, c in counts.items()}
    for part in (256, 2, 1):
        model = language_id.fit(spark.createDataFrame(train, schema), language_id.Settings(bits=10, docs_a_language=1000, length_scale=1e9, languages_a_part=part))
        got = {r.doc_id: r for r in language_id.predicted(spark.createDataFrame(asked, schema), model).collect()}
        assert model.languages == ("aa", "bb", "cc") and got[998]._lang_pred == got[999]._lang_pred == "und"
        for i, _, text in asked[:-2]:
            total = {x: p[language_id.grams([text], settings)[0]].sum() for x, p in log_p.items()}
            best = max(total, key=total.get)
            share = 1 / sum(math.exp(v - total[best]) for v in total.values())
            assert got[i]._lang_pred == best and abs(got[i]._lang_score - share) < 1e-3


def test_language_id_holds_few_ngrams_at_a_time(monkeypatch):
    """Neither a batch of texts nor one long text takes much more memory than CHARS characters."""
    rng = random.Random(8)
    long = words(rng, 150_000)
    batch = pa.record_batch([pa.array(["aa"] * 300 + ["bb"]), pa.array([long[k * 2000 : k * 2000 + 2000] for k in range(300)] + [long])], names=["lang", "text"])
    settings = language_id.Settings(bits=10)
    language_id.letters()
    tracemalloc.start()
    found = [r for b in language_id.counted(settings)(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    want = Counter((lang, int(k)) for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k in language_id.grams([text], settings)[0])
    assert {(r["lang"], r["bucket"]): r["n"] for r in found} == want
    texts = ["", "12 !?", None, "ΣΑΣ ς", *(words(rng, n) for n in (1, 5, 80, 300)), "a,,b  c" * 9]
    part = language_id.Part(("aa", "bb", "cc"), np.log(np.random.default_rng(1).random((1 << 10, 3))).astype(np.float32), settings)
    whole = language_id.evidence(pa.array(texts), part)
    for chars in (1, 3, 4, 50):
        monkeypatch.setattr(language_id, "CHARS", chars)
        cut = language_id.evidence(pa.array(texts), part)
        assert cut[0] == whole[0] and np.allclose(cut[1], whole[1]) and np.allclose(cut[2], whole[2])


def test_sharding(spark, docs, clashing, tmp_path):
    store = sharding.Shards(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan=4, rows_a_shard=5)
    for part in (clashing, clashing.limit(7), clashing.filter("doc_id = -1")):
        store.append(part)
    assert store.version() == 3
    before = store.manifest()
    assert before.filter("n_rows > 5").count() == 0 and before.count() >= 8
    version = store.compact(clashing.schema)
    after = store.manifest(version)
    assert version == 4 and after.count() < before.count()
    assert after.agg(F.sum("n_rows")).first()[0] == before.agg(F.sum("n_rows")).first()[0] == clashing.count() + 7
    count = lambda v: Counter(map(str, store.read(clashing.schema, v).drop("_shard").collect()))
    assert count(3) == count(4)
    assert store.compact(clashing.schema) == 4
    with pytest.raises(sharding.Conflict):
        store._commit(after, 3)
    assert sharding.Shards(spark, f"file://{tmp_path}/none").compact(docs.schema) == 0


def test_lattice_likelihood(docs, rows, clashing):
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    got = {(r.doc_id, r.n_chars): r._lm for r in lattice_lm.scored(docs, ~held).collect()}
    tokens = [(i, n, (t or "").encode().lower().split()) for i, t, _, _, n in rows]
    train = [x for x in tokens if x[0] is None or x[0] % 5 != 1]
    counts = Counter(w for _, _, ws in train for w in ws) + Counter({"end": len(train)})
    total, kinds = sum(counts.values()), len(counts)
    for i, n, ws in tokens:
        own = got[i, n]
        assert (own.n_tokens, own.n_known, own.train_tokens) == (len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, total)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in [*ws, "end"])
        assert abs(own.base_score - base) < 1e-6 * abs(base) and own.score < 0
    assert lattice_lm.scored(docs.filter("doc_id = -1"), F.lit(True)).count() == 0
    assert lattice_lm.scored(docs, F.lit(False)).count() == len(rows)
    assert set(clashing.columns) - {"text"} <= set(lattice_lm.scored(clashing, ~held).columns)
    tail = {(r.doc_id, r.n_chars): r._lm for r in lattice_lm.scored(docs, ~held, lattice_lm.Settings(head=3)).collect()}
    assert all(abs(tail[k].score - got[k].score) < 1e-6 * abs(got[k].score) and tail[k].n_known == got[k].n_known for k in got)


def test_lattice_score_against_brute_force(spark):
    """Weights by the existing scores and expected counts over all segmentations, then marginals, all by enumeration."""
    texts = [(0, "the thin man in the inn"), (1, "then they went in"), (2, "thin thin ink"), (3, "ét ink zq"), (4, None)]
    settings = lattice_lm.Settings(rounds=2, prior=50.0)
    got = {r.doc_id: r._lm for r in lattice_lm.scored(spark.createDataFrame(texts, "doc_id long, text string"), F.col("doc_id") < 3, settings).collect()}
    vocab = lattice.Vocabulary.load(lattice_lm.MODEL)
    by_text = {p: i for i, p in enumerate(vocab.pieces) if p}
    first = np.exp(vocab.log_w)
    weight, end = first, 0.5

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in by_text:
                yield from ((by_text[s[:k]], *rest) for rest in ways(s[k:]))
        if s and s[0] not in by_text:
            yield from ((*(int(vocab.byte_ids[b]) for b in s[0].replace("▁", " ").encode()), *rest) for rest in ways(s[1:]))

    found = {w: list(ways("▁" + w)) for _, t in texts for w in (t or "").split()}
    train = Counter(w for i, t in texts if i < 3 for w in t.split())
    for _ in range(settings.rounds):
        counts = settings.prior * first
        for w, n in train.items():
            chances = np.array([np.prod(weight[list(x)]) for x in found[w]])
            for x, c in zip(found[w], chances / chances.sum(), strict=True):
                np.add.at(counts, list(x), n * c)
        weight, end = counts / (counts.sum() + 3), 3 / (counts.sum() + 3)
    for i, t in texts:
        want = math.log10(end) + sum(math.log10(sum(np.prod(weight[list(x)]) for x in found[w])) for w in (t or "").split())
        assert abs(got[i].score - want) < 1e-9 * abs(want), i


def test_lattice_sums_all_segmentations():
    vocab = lattice.Vocabulary.load(lattice_lm.MODEL).prepare()
    by_text = {p: i for i, p in enumerate(vocab.pieces) if p}

    def total(s):
        if not s:
            return 1.0
        known = sum(math.exp(vocab.log_w[by_text[s[:k]]]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in by_text)
        spelled = 0.0 if s[0] in by_text else math.exp(sum(vocab.log_w[vocab.byte_ids[b]] for b in s[0].replace("▁", " ").encode()))
        return known + (spelled * total(s[1:]) if spelled else 0.0)

    built, _, last = lattice_lm.word_lattice(["then", "in", "thousand"], vocab)
    for alpha, word in zip(built.alpha[last], ("▁then", "▁in", "▁thousand"), strict=True):
        assert abs(math.exp(alpha) / total(word) - 1) < 1e-9


def test_exact_dedup(spark, docs, rows, clashing):
    groups = {}
    for k, (i, t, *_) in enumerate(rows):
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i is None, i or 0, k))
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect())
    want = Counter()
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            want[rows[m[3]][0], rows[best[3]][0], len(members), m == best, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert got == want
    left = exact_dedup.exact_dedup(clashing)
    assert left.count() == len(groups) and left.columns == clashing.columns
    assert exact_dedup.exact_groups(docs.filter("doc_id = -1")).count() == 0


def test_fingerprints(docs, rows):
    got = lz_fingerprint.fingerprints(docs, ranges=5).collect()
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = Counter()
    for k, (i, t, *_) in enumerate(order):
        own, other = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(own) // 2
        want[i, len(own), hashlib.sha256((own[: len(own) - half] + other[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(next(t for i, t, *_ in rows if i == r.doc_id and len(t or "") == r.n_chars), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert lz_fingerprint.fingerprints(docs.filter("doc_id = -1")).count() == 0
    one = lz_fingerprint.fingerprints(docs.filter("doc_id = 10")).first()
    assert one.near_next == 1.0


def phrases_of(text):
    plain, i = {}, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j] in plain:
            j += 1
        plain[text[i:j]] = None
        i = j
    return list(plain)


def estimate(a, b):
    """The share of common ones among the 128 smallest hashes of both phrase sets."""
    x, y = (set(sorted(set(lz_fingerprint.hashes(phrases_of(t)).tolist()))[:128]) for t in (a, b))
    both = sorted(x | y)[:128]
    return sum(h in x and h in y for h in both) / len(both) if both else 1.0


def test_fingerprints_of_large_and_null_ids_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    rows = [((1 << 62) + i if i % 7 else None, words(rng, rng.randrange(60), 40) if i % 11 else None) for i in range(300)]
    rows += [(5, words(rng, 12)) for _ in range(200)] + [(-(1 << 63), "low"), ((1 << 63) - 1, "high")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        own, other = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        want[i, len(own), hashlib.sha256(edited.encode()).hexdigest(), round(estimate(own, edited), 9), round(estimate(own, other), 9)] += 1
    for ranges in (1, 9, None):
        got = lz_fingerprint.fingerprints(frame, ranges=ranges).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_phrases_are_lempel_ziv():
    rng = random.Random(2)
    for text in ["", "a", "aaaaaaaaaa", "abababab", *("".join(rng.choice("ab c") for _ in range(rng.randrange(300))) for _ in range(50))]:
        assert lz_fingerprint.Parsed(text).phrases == phrases_of(text)
        other = "".join(rng.choice("ab c") for _ in range(300))
        parsed = lz_fingerprint.Parsed(text)
        edited, signature = parsed.edited(other)
        assert (signature == lz_fingerprint.Parsed(edited).signature).all()


def test_phrases_take_few_slices():
    """A phrase costs less than three slices of prose, the one that it is itself included."""

    class Counted(str):
        slices = 0

        def __getitem__(self, at):
            Counted.slices += 1
            return str.__getitem__(self, at)

    text = words(random.Random(6), 600, 150)
    parsed = lz_fingerprint.Parsed(Counted(text))
    assert parsed.phrases == phrases_of(text)
    assert Counted.slices < 3 * len(parsed.phrases)


def near_brute(rows):
    sets = {}
    for i, t, *_ in rows:
        ws = (t or "").encode().lower().split()
        sets.setdefault(i, frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_dedup(spark, tmp_path):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = words(rng, rng.choice([4, 5, 12, 60, 150]), 5000).split()
        for _ in range(rng.choice([1, 3, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"v{rng.random()}"
            texts.append(" ".join(copy))
    texts += [None, "", "Short", "short", "x " * 4000]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("n", "bucket", "_gone_id", "rep", "root")})
    frame.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_groups(table).collect()}
    want = near_brute(rows)
    assert got == want
    left = minhash_dedup.near_dedup(table)
    assert left.count() == sum(w[2] for w in want.values()) and left.columns == table.columns
    assert minhash_dedup.near_groups(table.filter("doc_id = -1")).count() == 0


def test_near_dedup_with_nulls_and_repeated_rows(docs, rows):
    got = minhash_dedup.near_groups(docs).collect()
    assert len(got) == len(rows)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_near_dedup_defines_repeated_ids(spark):
    a, b = words(random.Random(1), 40, 9999), words(random.Random(2), 60, 9999)
    rows = [(7, a), (7, b), (8, b), (9, a), (9, a), (10, a + " more")]
    for k in (1, 3, 6):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(k)).collect())
        assert got == Counter([(7, 36, 7), (7, 56, 7), (8, 56, 8), (9, 36, 7), (9, 36, 7), (10, 37, 7)])


def test_near_dedup_of_clusters_beyond_whole_comparison(spark, monkeypatch):
    """Families that share most shingles: many are almost links, and buckets of several groups hang together."""
    rng = random.Random(6)
    base = words(rng, 90, 9999).split()
    texts = []
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(len(copy))] = f"v{rng.random()}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    monkeypatch.setattr(minhash_dedup, "WHOLE", 1)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    monkeypatch.setattr(minhash_dedup, "SHARE", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_brute(rows)


def test_superminhash_equals_the_sequential_form():
    rng = random.Random(8)
    sets = [[rng.getrandbits(64) for _ in range(n)] for n in (1, 2, 7, 150)]
    found = minhash_dedup.superminhash(np.array([x for s in sets for x in s], np.uint64), np.array([len(s) for s in sets]))
    m = minhash_dedup.REGISTERS
    for s, row in zip(sets, found, strict=True):
        best = [None] * m
        for e in s:
            p = list(range(m))
            for j in range(m):
                draw = int(minhash_dedup.mix(np.array([(e + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
                k = j + ((draw & 0xFFFFFFFF) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                value = draw >> 40 | j << 24
                best[p[j]] = value if best[p[j]] is None else min(best[p[j]], value)
        assert row.tolist() == best


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.root for r in minhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert minhash_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def mixed_brute(rows, mix):
    """Draws by the same hashes, in plain Python."""
    tokens, blocks = Counter(), {}
    for r in rows:
        tokens[r.key] += r.tokens
        blocks.setdefault((r.key, r.block), []).append(r)
    names = sorted(tokens)
    everything = sum(tokens.values())
    shares = [tokens[n] / everything for n in names]
    exponent = mixing.solve_exponent(shares, mix)
    drawn = Counter()
    for name, weight in zip(names, mixing.weights_at(shares, exponent), strict=True):
        quota = weight * everything
        passes = int(quota // tokens[name]) if tokens[name] else 0
        rest = quota - passes * tokens[name]
        own = sorted((b for k, b in blocks if k == name), key=lambda b: (blocks[name, b][0].keys[passes], b))
        used = 0
        for b in own:
            size = sum(r.tokens for r in blocks[name, b])
            for r in blocks[name, b]:
                before = sum(x.tokens for x in blocks[name, b] if x.order <= r.order)
                drawn[r.doc_id, r.n_chars] += passes + (used + (size if used + size <= rest else before) <= rest)
            used += size
    return +drawn, exponent


def test_mixing(docs, clashing):
    for mix in (mixing.Mix(max_repeats=1.5, blocks=3), mixing.Mix(entropy=0.6, max_repeats=None, blocks=2)):
        got = mixing.mixed(clashing, mix)
        order = F.xxhash64(F.lit(mix.seed), F.col("doc_id"), F.col("text"))
        block = F.pmod(order, F.lit(mix.blocks)).cast("int")
        count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
        keys = F.array(*[F.xxhash64(F.lit(mix.seed), F.lit("block"), block, F.lit(p)) for p in range(9)])
        rows = docs.select("doc_id", "n_chars", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("key"), order.alias("order"), block.alias("block"), count.alias("tokens"), keys.alias("keys")).collect()
        want, exponent = mixed_brute(rows, mix)
        drawn = got.collect()
        assert Counter((r.doc_id, r.n_chars) for r in drawn) == want
        assert all(abs(r._mix.exponent - exponent) < 1e-9 for r in drawn)
        assert got.columns == [*clashing.columns, "_mix"]
    assert mixing.mixed(docs.filter("doc_id = -1")).count() == 0


def test_mixing_of_many_sources(docs, monkeypatch):
    """The bisection over a table gives what that over the driver's list gives."""
    for mix in (mixing.Mix(max_repeats=1.5, blocks=3), mixing.Mix(entropy=0.6, max_repeats=None, blocks=2)):
        listed = mixing.mixed(docs, mix).collect()
        monkeypatch.setattr(mixing, "WEIGHED", 0)
        tabled = mixing.mixed(docs, mix).collect()
        monkeypatch.undo()
        assert Counter((r.doc_id, r.n_chars) for r in listed) == Counter((r.doc_id, r.n_chars) for r in tabled)
        assert abs(listed[0]._mix.exponent - tabled[0]._mix.exponent) < 1e-9


def test_exponent():
    shares = [0.6, 0.3, 0.1]
    for target in (0.2, 0.7, 1.0):
        w = mixing.weights_at(shares, mixing.solve_exponent(shares, mixing.Mix(entropy=target, max_repeats=None)))
        assert abs(-sum(x * math.log(x) for x in w) - target) < 1e-6
    e = mixing.solve_exponent(shares, mixing.Mix(max_repeats=1.5))
    assert 0 < e < 1 and abs(mixing.weights_at(shares, e)[2] / 0.1 - 1.5) < 1e-6
    assert mixing.solve_exponent([], mixing.Mix()) == 1.0 and mixing.solve_exponent([0.5, 0.5, 0.0], mixing.Mix()) == 0.0
