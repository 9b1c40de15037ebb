"""Language-model scoring by subword lattices: the probability of a text over all segmentations of its words into pieces."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, pieces
from .lattice import SPELLED, Vocabulary, build, codes_of, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that a task counts before it passes the counts on.
HELD = 400_000
CHARS = 500_000
LN10 = float(np.log(10))


@dataclass(frozen=True)
class Settings:
    """rounds: of re-estimation. prior: pseudo-counts that the existing scores share out. head: most frequent words that every task knows; the rest is joined."""

    model: str = MODEL
    rounds: int = 3
    prior: float = 1000.0
    head: int = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """Bytes' lower() and split() know A-Z and [\\x20\\x09-\\x0D] only."""
    return (text or "").encode().lower().split()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, training) -> (word, n, seen): n counts the training texts only, seen all."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("seen", pa.int64())])
    counts: Counter[bytes] = Counter()
    trained: Counter[bytes] = Counter()

    def flushed() -> pa.RecordBatch:
        out = [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array([trained[w] for w in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        trained.clear()
        return pa.RecordBatch.from_arrays(out, schema=schema)

    for batch in batches:
        for text, training in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            counts.update(words)
            if training:
                trained.update(words)
            if len(counts) > HELD:
                yield flushed()
    yield flushed()


def word_lattice(words: list[str], vocab: Vocabulary):
    """The lattice over words, each with the mark of a space before it; also the first and last node of each."""
    code, lengths = codes_of([" " + w for w in words])
    starts = np.cumsum(lengths) - lengths
    first = starts + np.arange(len(words))
    return build(code, starts, lengths, vocab), first, first + lengths


def piece_counts(sent):
    """(word, n) -> (piece, n): how often each piece is expected in so many of each word, over all segmentations as the weights have them."""
    schema = pa.schema([("piece", pa.int32()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = sent.value.prepare()
        total = np.zeros(len(vocab.pieces))
        for batch in batches:
            words, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for i, j in pieces([len(w) + 1 for w in words], CHARS):
                lattice, _, last = word_lattice(words[i:j], vocab)
                passed = lattice.expected(last, times[i:j])
                plain = lattice.piece < SPELLED
                total += np.bincount(lattice.piece[plain], passed[plain], minlength=len(total))
                cols, size = utf8(lattice.piece[~plain] - SPELLED)
                for k in range(4):
                    total += np.bincount(vocab.byte_ids[cols[size > k, k]], passed[~plain][size > k], minlength=len(total))
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], schema=schema)

    return run


def word_scores(sent, tokens: int, kinds: int):
    """(word, n, seen) -> (word, n, seen, score, word_score), both log10: score is the marginal probability of the word over all segmentations into pieces. word_score
    mixes it, by the share kinds / (tokens + kinds), with the word's own share of the training tokens."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("seen", pa.int64()), ("score", pa.float64()), ("word_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = sent.value.prepare()
        for batch in batches:
            words = batch.column(0).to_pylist()
            for i, j in pieces([len(w) + 1 for w in words], CHARS):
                lattice, _, last = word_lattice(words[i:j], vocab)
                marginal = lattice.alpha[last]
                with np.errstate(divide="ignore"):
                    mixed = np.logaddexp(np.log(batch.column(1).to_numpy()[i:j]), np.log(kinds) + marginal) - np.log(tokens + kinds) if tokens else marginal
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(marginal / LN10), pa.array(mixed / LN10)], schema=schema)

    return run


#: What a document's frequent words and its end add up to, and one row for each of its other words.
PART = pa.schema([("row", pa.int64()), ("word", pa.string()), ("times", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word_score", pa.float64())])


def parts(sent, end: tuple[int, float, float, float]):
    """(row, text) -> one part with what the frequent words and the end add, and one for each other word, to be joined.

    The first has a line feed and the row as its word, which no text has: it meets nothing, and its rows spread over all tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in pieces([len(t or "") for t in texts], 4 * CHARS):
                out: list[tuple] = []
                for row, text in zip(batch.column(0).slice(i, j - i).to_pylist(), texts[i:j], strict=True):
                    tokens = 1
                    known, base, score, word_score = end
                    for word, times in Counter(words_of(text)).items():
                        found = head.get(word)
                        if found is None:
                            out.append((row, word, times, 0, 0, 0.0, 0.0, 0.0))
                        else:
                            known += times * found[0]
                            base += times * found[1]
                            score += times * found[2]
                            word_score += times * found[3]
                        tokens += times
                    out.append((row, b"\n%d" % row, 0, tokens, known, base, score, word_score))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(pa.string()) if f.name == "word" else pa.array(c, f.type) for c, f in zip(cols, PART, strict=True)], schema=PART)

    return run


def scored(docs: DataFrame, training: Column, settings: Settings | None = None, text_col: str = "text") -> DataFrame:
    """docs without their texts, with a struct _lm: n_tokens, n_known, train_tokens, base_score, score, word_score.

    Tokens are words [^\\x20\\x09-\\x0D]+, A-Z lower-cased, and one end; null text is empty. base_score is the smoothed word unigram,
    log10((c + 0.5) / (N + 0.5 (V + 1))) summed over the tokens, of counts in the rows for which `training` holds (null: it doesn't).

    score is log10 of the text's marginal probability: each word is a space mark and its characters, and the forward recursion adds up, in log space,
    all segmentations into pieces of an existing vocabulary; characters that are no piece are spelled in bytes, and the end is one more piece. As no piece has a
    space mark inside, the lattice of the text is that of its words in a row, so each distinct word is scored once. The pieces' weights are the existing
    scores', as pseudo-counts, and what the backward recursion expects of each piece in all training words, as often as they come; so are the next round's.
    word_score is a looser model beside it, in which a word of the training texts is also a piece of its own (see word_scores).

    The scores of the words that are most frequent in all texts, of a bounded number, are broadcast; the others' are joined, so no word's rows meet in a task uncounted. With no training
    rows the existing weights stand and the end has probability 0.5. An empty table gives an empty one; repeated rows get equal scores; columns may have
    any names, but one called _lm is replaced. A text of any length is scored whole, by one task; longer ones than CHARS make a batch of their own. The rows are written once, so numbers hold at each reading.
    """
    settings = settings or Settings()
    scratch = Scratch(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    row, own, training_col = (fresh(docs, n) for n in ("_row", "_text", "_training"))
    keep = [f"`{c}`" for c in docs.columns if c not in (text_col, "_lm")]
    rows = docs.select(*keep, F.monotonically_increasing_id().alias(row), F.col(text_col).cast("string").alias(own), F.coalesce(training, F.lit(False)).alias(training_col))
    rows = scratch.written(rows, "lm-rows")
    words = scratch.written(rows.select(own, training_col).mapInArrow(count_words, "word string, n long, seen long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "lm-words")
    ends = rows.filter(F.col(training_col)).count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    tokens, kinds = total + ends, distinct + (ends > 0)
    vocab = Vocabulary.load(settings.model)
    prior = np.exp(vocab.log_w)
    end_share = 0.5
    for _ in range(settings.rounds if tokens else 0):
        sent = context.broadcast(vocab)
        found = words.filter("n > 0").select("word", "n").mapInArrow(piece_counts(sent), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        counts = settings.prior * prior
        counts[found["piece"].to_numpy()] += found["n"].to_numpy()
        end_share = ends / (counts.sum() + ends)
        with np.errstate(divide="ignore"):
            vocab = Vocabulary(vocab.pieces, vocab.byte_ids, np.log(counts / (counts.sum() + ends)))
    table = scratch.written(words.mapInArrow(word_scores(context.broadcast(vocab), tokens, kinds), "word string, n long, seen long, score double, word_score double"), "lm-scores")
    below = tokens + 0.5 * (kinds + 1)
    base = lambda n: float(np.log10((n + 0.5) / below))
    top = table.orderBy(F.col("seen").desc(), "word").limit(settings.head).toArrow()
    head = {w.encode(): (int(n > 0), base(n), s, t) for w, n, s, t in zip(*(top[c].to_pylist() for c in ("word", "n", "score", "word_score")), strict=True)}
    end_word = ends / (tokens + kinds) if tokens else 0.5
    log10 = lambda x: float(np.log10(x)) if x else 0.0
    end = (int(ends > 0), base(ends), log10(end_share), log10(end_word))
    part = rows.select(F.col(row).alias("row"), own).mapInArrow(parts(context.broadcast(head), end), "row long, word string, times long, n_tokens long, n_known long, base double, score double, word_score double")
    found = part.join(table.select("word", "n", F.col("score").alias("of_word"), F.col("word_score").alias("mixed")), "word", "left")
    rest = F.coalesce(F.col("times") * F.log10((F.col("n") + 0.5) / below), F.lit(0.0))
    sums = found.groupBy("row").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + rest).alias("base_score"),
        F.sum(F.col("score") + F.coalesce(F.col("times") * F.col("of_word"), F.lit(0.0))).alias("score"),
        F.sum(F.col("word_score") + F.coalesce(F.col("times") * F.col("mixed"), F.lit(0.0))).alias("word_score"),
    )
    lm = F.struct("n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score", "word_score")
    scratch.close(rows, table)
    return rows.select(*keep, row).join(sums.select(F.col("row").alias(row), lm.alias("_lm")), row).select(*keep, "_lm")
