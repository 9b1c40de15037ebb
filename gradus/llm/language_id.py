"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, pieces

#: Fixed value: the answer for a text that is null or has no letter.
UNKNOWN = "und"
#: Characters whose n-grams are held at a time, about 240 bytes for each.
CHARS = 1 << 17


@dataclass(frozen=True)
class Settings:
    """orders: lengths of the n-grams. bits: log2 of the hash buckets. docs_a_language: labelled rows to learn each language from, about
    that many are chosen by a hash of their id (all where there are fewer). languages_a_part: a matrix that is broadcast has so many columns at most, of 2 ** bits * 4 bytes; more languages make more matrices.
    length_scale: evidence of longer texts is scaled down to that of so many n-grams, or every score would be 0 or 1."""

    orders: tuple[int, ...] = (1, 2, 3, 4)
    bits: int = 15
    docs_a_language: int = 3000
    languages_a_part: int = 256
    alpha: float = 0.1
    length_scale: float = 200.0


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(code: np.ndarray, settings: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """Each length of n-grams, and the bucket of the n-gram that begins at each place."""
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(settings.orders) + 1):
        h = (h[: len(code) - n + 1] if n > 1 else h) * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n)
        if n in settings.orders:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield n, (mixed >> np.uint64(64 - settings.bits)).astype(np.int64)


def grams(texts: list[str | None], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text that each comes from, and which texts have a letter. Letters count in lower case, with one space for what is between them."""
    low = [" " + (t or "").lower() + " " for t in texts]
    code = codes_of("".join(low))
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = letters()[code]
    has = np.bincount(owner[letter], minlength=len(low)) > 0
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    code, owner, letter = code[keep], owner[keep], letter[keep]
    code = np.where(letter, code, 32).astype(np.uint64)
    out, own = [], []
    for n, bucket in hashed(code, settings):
        same = owner[: len(bucket)] == owner[n - 1 :]
        out.append(bucket[same])
        own.append(owner[: len(bucket)][same])
    return np.concatenate(out), np.concatenate(own), has


def tallied(text: str, settings: Settings) -> tuple[np.ndarray, bool]:
    """How often each bucket is met among all n-grams of one text of any length, CHARS characters at a time, and whether it has a letter."""
    low = " " + text.lower() + " "
    count, has, after_letter, tail = np.zeros(1 << settings.bits, np.int64), False, True, np.zeros(0, np.uint64)
    for at in range(0, len(low), CHARS):
        code = codes_of(low[at : at + CHARS])
        letter = letters()[code]
        keep = letter.copy()
        keep[0] |= after_letter
        keep[1:] |= letter[:-1]
        has, after_letter = has or bool(letter.any()), bool(letter[-1])
        run = np.concatenate([tail, np.where(letter, code, 32).astype(np.uint64)[keep]])
        for n, bucket in hashed(run, settings):
            count += np.bincount(bucket[max(0, len(tail) - n + 1) :], minlength=len(count))
        tail = run[max(0, len(run) - max(settings.orders) + 1) :]
    return count, has


def counted(settings: Settings):
    """(lang, text) -> (lang, bucket, n), summed within a batch."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
                total = np.zeros(1 << settings.bits, np.int64)
                sizes = pc.utf8_length(texts).to_pylist()
                for i, j in pieces(sizes, CHARS):
                    some = texts.slice(i, j - i).to_pylist()
                    total += tallied(some[0], settings)[0] if sizes[i] > CHARS else np.bincount(grams(some, settings)[0], minlength=len(total))
                at = np.nonzero(total)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)

    return run


@dataclass(frozen=True)
class Part:
    """The log probabilities of the n-gram buckets in some of the languages."""

    languages: tuple[str, ...]
    log_p: np.ndarray
    settings: Settings


@dataclass(frozen=True)
class Model:
    """Broadcast parts. The driver keeps the names of the languages only."""

    languages: tuple[str, ...]
    parts: tuple[Broadcast, ...]


def fit(labelled: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts n-grams of a bounded, hash-chosen sample of each language, on the executors; languages weigh the same. Rows without a language or a text don't count; without any
    row that counts, the model knows no language. Of repeated rows all or none are chosen. Texts of any length count whole."""
    settings = settings or Settings()
    spark = labelled.sparkSession
    rows = labelled.select(F.xxhash64(id_col).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()
    parts = []
    for start in range(0, len(sizes), settings.languages_a_part):
        some = sizes[start : start + settings.languages_a_part]
        at = {r["lang"]: i for i, r in enumerate(some)}
        share = spark.createDataFrame([(r["lang"], min(1.0, settings.docs_a_language / r["count"])) for r in some], "lang string, share double")
        chosen = rows.join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text")
        counts = chosen.mapInArrow(counted(settings), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        table = np.full((1 << settings.bits, len(some)), settings.alpha)
        table[counts["bucket"].to_numpy(), [at[x] for x in counts["lang"].to_pylist()]] += counts["n"].to_numpy()
        parts.append(spark.sparkContext.broadcast(Part(tuple(at), np.log(table / table.sum(axis=0)).astype(np.float32), settings)))
    return Model(tuple(r["lang"] for r in sizes), tuple(parts))


def evidence(texts: pa.Array, part: Part) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The likeliest of the part's languages for each text, its scaled log likelihood, and the logarithm of the sum of all its languages' likelihoods. UNKNOWN for a text without a letter."""
    langs, best, whole = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    columns = range(len(part.languages))
    for i, j in pieces(sizes, CHARS):
        some = texts.slice(i, j - i).to_pylist()
        if sizes[i] > CHARS:
            count, has = tallied(some[0], part.settings)
            n, has = np.array([count.sum()]), np.array([has])
            total = np.array([[count @ part.log_p[:, k].astype(np.float64) for k in columns]])
        else:
            bucket, own, has = grams(some, part.settings)
            n = np.bincount(own, minlength=j - i)
            total = np.stack([np.bincount(own, part.log_p[:, k][bucket], minlength=j - i) for k in columns], axis=1)
        total *= np.minimum(1.0, part.settings.length_scale / np.maximum(n, 1))[:, None]
        top = total.argmax(axis=1)
        best[i:j] = total[np.arange(j - i), top]
        whole[i:j] = best[i:j] + np.log(np.exp(total - best[i:j, None]).sum(axis=1))
        for k in np.nonzero(has)[0]:
            langs[i + k] = part.languages[top[k]]
    return langs, best, whole


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with _lang_pred (a learned language; `und` for a text that is null or without letters, or if nothing was learned) and _lang_score (0 to 1; 0 for `und`).

    Ties go to the language that is first in order. Each part of the model is broadcast; a text meets one after the other. Columns may have any names; one called _lang_pred or
    _lang_score is replaced. A text of any length is read whole, in one task, CHARS characters at a time; repeated rows get the same answer; an empty table gives an empty one.
    """
    both = fresh(docs, "_lang")
    found = docs.withColumn(both, F.lit(None).cast("struct<lang:string,best:double,whole:double>"))

    def better_of(sent: Broadcast):
        @F.arrow_udf("struct<lang:string,best:double,whole:double>")
        def better(texts: pa.Array, before: pa.Array) -> pa.Array:
            langs, best, whole = evidence(texts, sent.value)
            known = before.is_valid().to_numpy(zero_copy_only=False)
            old_lang = pc.struct_field(before, "lang")
            old_best, old_whole = (pc.fill_null(pc.struct_field(before, c), -np.inf).to_numpy(zero_copy_only=False) for c in ("best", "whole"))
            whole = np.where(known, np.logaddexp(old_whole, whole), whole)
            stays = known & (old_best >= best)
            return pa.StructArray.from_arrays([pc.if_else(pa.array(stays), old_lang, pa.array(langs, old_lang.type)), pa.array(np.where(stays, old_best, best)), pa.array(whole)], ["lang", "best", "whole"])

        return better

    for sent in model.parts:
        found = found.withColumn(both, better_of(sent)(F.col(text_col).cast("string"), F.col(both)))
    lang = F.coalesce(F.col(f"{both}.lang"), F.lit(UNKNOWN))
    score = F.when(lang == UNKNOWN, 0.0).otherwise(F.exp(F.col(f"{both}.best") - F.col(f"{both}.whole")))
    return found.withColumns({"_lang_pred": lang, "_lang_score": score}).drop(both)
