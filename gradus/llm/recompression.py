"""Substring deduplication by recompression: equal passages get equal symbols inside, and shared symbols reveal them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered, pieces

CHARS = 1_000_000
ROUNDS = 8
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Level:
    """Symbols in order: name, first word, and the words [low, high) that decide that the symbol stands there."""

    def __init__(self, name: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, wall: np.ndarray):
        self.name, self.start, self.low, self.high, self.wall = name, start, low, high, wall


def name_runs(a: Level, words: np.ndarray) -> Level:
    """Names each maximal run of one symbol by the symbol and the run's length. What a symbol is depends on both neighbours then: on the one word next to it if that
    isn't what another such symbol would have there, else on all of the neighbour."""
    same = (a.name[1:] == a.name[:-1]) & ~a.wall[1:] & ~a.wall[:-1]
    first_word, last_word = words[a.start], words[np.append(a.start[1:], len(words)) - 1]
    low, high = a.low.copy(), a.high.copy()
    before = np.where(last_word[:-1] != last_word[1:], a.start[1:] - 1, a.low[:-1])
    after = np.where(first_word[1:] != first_word[:-1], a.start[1:] + 1, a.high[1:])
    low[1:] = np.where(a.wall[1:], low[1:], np.minimum(low[1:], before))
    high[:-1] = np.where(a.wall[:-1], high[:-1], np.maximum(high[:-1], after))
    first = np.nonzero(np.concatenate([[True], ~same]))[0]
    last = np.append(first[1:], len(a.name)) - 1
    length = last - first + 1
    name = np.where(length > 1, mix(a.name[first] * ODD + length.astype(np.uint64)), a.name[first])
    return Level(name, a.start[first], low[first], high[last], a.wall[first])


def name_pairs(a: Level, turn: int) -> Level:
    """Names each pair of a left symbol and a right one after it; a bit of a symbol's name says which it is. A left symbol depends on the one after it, a right one on that before."""
    left = (mix(a.name ^ np.uint64(turn + 1)) & np.uint64(1)).astype(bool)
    right = ~left & ~a.wall
    left &= ~a.wall
    pair = left[:-1] & right[1:]
    low, high = a.low.copy(), a.high.copy()
    low[1:] = np.where(right[1:], a.low[:-1], low[1:])
    high[:-1] = np.where(left[:-1], a.high[1:], high[:-1])
    stays = np.concatenate([[True], ~pair])
    at = np.nonzero(stays)[0]
    merged = np.concatenate([pair, [False]])[at]
    name, high = a.name[at], high[at]
    name[merged] = mix(name[merged] * ODD + a.name[at[merged] + 1] + np.uint64(turn))
    high[merged] = a.high[at[merged] + 1]
    low = np.where(merged, a.low[at], low[at])
    return Level(name, a.start[at], low, high, a.wall[at])


class Parsed:
    """Texts as one row of words with a wall before, between and behind them, and a symbol for each window of `width` words.

    A window's symbol is one of the highest level that has symbols which the window alone decides; of several the one whose name has the lowest hash, so that neighbouring windows mostly
    share theirs. So equal windows have the same symbol at the same place, wherever they stand; a single word is always decided.
    """

    def __init__(self, texts: list[str | None], width: int):
        self.words = [(t or "").encode().split() for t in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.width = width
        total = int(self.counts.sum()) + len(texts) + 1
        self.begins = np.cumsum(self.counts + 1) - self.counts
        wall = np.zeros(total, bool)
        wall[0] = True
        wall[self.begins + self.counts] = True
        name = np.empty(total, np.uint64)
        name[wall] = 0
        flat = np.array([w for ws in self.words for w in ws], dtype=object)
        name[~wall] = pd.util.hash_array(flat, categorize=True) if len(flat) else 0
        self.names = name
        windows = np.maximum(self.counts - width + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), windows)
        self.place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        self.at = self.begins[self.text] + self.place
        level = Level(name, np.arange(total), np.arange(total), np.arange(1, total + 1), wall)
        levels = [level]
        for turn in range(ROUNDS if len(self.at) else 0):
            level = name_pairs(name_runs(level, name), turn)
            levels.append(level)
        self.symbol, self.anchor = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), np.int64)
        left = np.arange(len(self.at))
        for k in range(len(levels) - 1, -1, -1):
            if not len(left):
                break
            fits, chosen = self.lowest(levels[k], self.at[left])
            self.symbol[left[fits]] = mix(levels[k].name[chosen] ^ np.uint64(k + 1))
            self.anchor[left[fits]] = levels[k].start[chosen] * (ROUNDS + 1) + k
            left = left[~fits]

    def lowest(self, level: Level, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which windows decide a symbol of the level, and the one of the lowest hash in each of these."""
        first, last = np.searchsorted(level.low, at), len(level.name) - 1
        fits = (first <= last) & (level.high[np.minimum(first, last)] <= at + self.width)
        chosen, end = first[fits], at[fits] + self.width
        order = mix(level.name ^ ODD)
        key, further = order[chosen], np.arange(len(chosen))
        for step in range(1, self.width):
            place = first[fits][further] + step
            further = further[(place <= last) & (level.high[np.minimum(place, last)] <= end[further])]
            if not len(further):
                break
            place = first[fits][further] + step
            lower = order[place] < key[further]
            chosen[further[lower]], key[further[lower]] = place[lower], order[place[lower]]
        return fits, chosen

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, each once where it stands: name, text and place (a number that tells level and first word)."""
        _, first = np.unique(self.anchor, return_index=True)
        text = self.text[first]
        return self.symbol[first], text, self.anchor[first] - self.begins[text] * (ROUNDS + 1)

    def candidates(self, lone: list[np.ndarray | None]) -> np.ndarray:
        """Which windows have a symbol that stands elsewhere too. lone: each text's places of symbols that don't."""
        return ~self.listed(self.anchor - self.begins[self.text] * (ROUNDS + 1), lone)

    def listed(self, place: np.ndarray, lists: list[np.ndarray | None]) -> np.ndarray:
        """Which of the windows' places are in their text's list."""
        sizes = np.array([0 if x is None else len(x) for x in lists], np.int64)
        if not sizes.sum() or not len(place):
            return np.zeros(len(place), bool)
        span = int(self.counts.max() + 1) * (ROUNDS + 1)
        keys = np.repeat(np.arange(len(lists)), sizes) * span + np.concatenate([x for x in lists if x is not None and len(x)])
        keys.sort()
        own = self.text * span + place
        return keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own

    def contents(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of the words of each chosen window, each by differences of sums of powers of its own base: 35 multiplications a window are not needed."""
        at = self.at[which]
        out = []
        for base, names in ((0xD6E8FEB86659FD93, self.names), (0xA0761D6478BD642F, mix(self.names + ODD))):
            power, back = (np.full(len(names) + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
            power[0] = back[0] = 1
            power, back = np.cumprod(power), np.cumprod(back)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(names * power[:-1])])
            out.append(mix((sums[at + self.width] - sums[at]) * back[at]))
        return out[0], (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def cleaned(self, repeated: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Words removed from each text, and what is left of it."""
        edge = np.zeros(len(self.names) + self.width + 1, np.int64)
        at = self.at[repeated]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.width, -1)
        covered = np.cumsum(edge) > 0
        gone, kept = np.zeros(len(self.words), np.int64), []
        for i, words in enumerate(self.words):
            own = covered[self.begins[i] : self.begins[i] + len(words)]
            gone[i] = own.sum()
            kept.append(b" ".join(words if not gone[i] else [w for w, c in zip(words, own.tolist(), strict=True) if not c]))
        return gone, kept


def lists_of(column: pa.Array) -> list[np.ndarray | None]:
    return [x.values.to_numpy() if x.is_valid else None for x in column]


def emitted(width: int, windows: bool):
    """(row, text[, lone]) -> (hash[, hash2], row, place) of symbols, or of windows that may repeat."""
    schema = pa.schema([("hash", pa.int64()), *[("hash2", pa.int32())] * windows, ("row", pa.int64()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rows, texts = cols["row"].to_numpy(), cols["text"].to_pylist()
            for i, j in pieces([len(t or "") for t in texts], CHARS):
                parsed = Parsed(texts[i:j], width)
                if windows:
                    which = np.nonzero(parsed.candidates(lists_of(cols["lone"].slice(i, j - i))))[0]
                    name, second = parsed.contents(which)
                    text, place = parsed.text[which], parsed.place[which]
                else:
                    name, text, place = parsed.anchors()
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *([pa.array(second)] if windows else []), pa.array(rows[i:j][text]), pa.array(place.astype(np.int32))], schema=schema)

    return run


def finished(width: int, texts_too: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts_too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = cols["text"].to_pylist()
            for i, j in pieces([len(t or "") for t in texts], CHARS):
                parsed = Parsed(texts[i:j], width)
                lone, once = (lists_of(cols[c].slice(i, j - i)) for c in ("lone", "once"))
                repeated = np.nonzero(parsed.candidates(lone) & ~parsed.listed(parsed.place, once))[0]
                gone, kept = parsed.cleaned(repeated)
                out = [cols["doc_id"].slice(i, j - i), pa.array(parsed.counts), pa.array(gone), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary()).cast(pa.string())] * texts_too, names=names)

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, texts_too: bool = False) -> DataFrame:
    """Removes each word of a text that lies in a window of `width` words whose word sequence also starts anywhere else, in the same text or another.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Recompression names runs and pairs of symbols, round after round. A name is a hash of
    what it names, so that all tasks give equal names to equal passages without asking each other. Each window has one symbol of several words on average (see Parsed).
    Spark counts symbols over all texts; windows of symbols that stand once can't repeat. The rest are verified by the content of their words, as 96 bits of two hashes, by another
    count over all texts: of 1e13 windows, two different ones are taken for equal with a chance of one in 1,500. Both counts combine within tasks first and return what was
    counted once, so a passage in a third of all texts costs its task one row. Rows are told apart by
    a hash of their file with their place in it (64 bits; of 100,000 files of a million rows, two share numbers with a chance of one in 2,000); rows that don't come from files are written first.

    Null text has no words; repeated rows repeat each other, and with `width` words or more both lose them. A text of any length is parsed whole, by one task; longer ones
    than CHARS make a batch of their own. Other columns are ignored; an empty table gives an empty one.

    Returns (id, n_words, n_removed, kept_sha256 of the rest joined by single spaces), and the rest itself as kept_text on demand.
    """
    rows, (file, row) = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), Scratch(docs.sparkSession))
    rows = rows.select(F.col(file).bitwiseXOR(F.col(row)).alias("row"), "doc_id", "text")
    counted = [F.count("*").alias("n"), F.max("row").alias("row"), F.max("place").alias("place")]

    def once(found: DataFrame, keys: list[str], name: str) -> DataFrame:
        alone = found.groupBy(*keys).agg(*counted).filter("n = 1")
        return alone.groupBy("row").agg(F.collect_list("place").alias(name))

    lone = once(rows.select("row", "text").mapInArrow(emitted(width, False), "hash long, row long, place int"), ["hash"], "lone")
    known = rows.join(lone, "row", "left")
    single = once(known.mapInArrow(emitted(width, True), "hash long, hash2 int, row long, place int"), ["hash", "hash2"], "once")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts_too
    return known.join(single, "row", "left").mapInArrow(finished(width, texts_too), out).withColumnRenamed("doc_id", id_col)
