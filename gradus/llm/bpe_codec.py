"""BPE encoding with a word vocabulary, decoding, and tree concatenation of what the tokenizer doesn't split."""

from __future__ import annotations

import bisect
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, Scratch, fresh, numbered, pieces

MODEL = "/opt/tokenizers/word_bpe_49k.json"
#: Characters of an unsplit word that are encoded as they are; beyond, the word is dealt out. Characters of a batch; distinct words that a worker remembers; words that are
#: encoded in one text, and the mark between them there (a text that has it itself is encoded word by word).
UNSPLIT, CHARS, WORDS, TOGETHER, MARK = 50_000, 2_000_000, 300_000, 256, "\x01"

#: Fixed value: the pattern of the word vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def quiet() -> None:
    """Spark's tasks are the parallelism; the tokenizer's own threads would compete with them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


@dataclass
class Codec:
    """A tokenizer file's content, sent to the tasks. `long` is the length from which a word's parts are encoded apart."""

    source: str
    long: int = UNSPLIT
    _own: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str, long: int = UNSPLIT) -> Codec:
        with open(path, encoding="utf-8") as f:
            made = cls(f.read(), long)
        both, one, two = made.ids("a  b"), made.ids("a"), made.ids("b")
        if both != one + two:
            raise ValueError("the tokenizer must drop the white space between words")
        return made

    def __getstate__(self):
        return {"source": self.source, "long": self.long, "_own": {}}

    @property
    def tokenizer(self):
        if "tokenizer" not in self._own:
            from tokenizers import Tokenizer

            quiet()
            made = self._own["tokenizer"] = Tokenizer.from_str(self.source)
            made.no_truncation()
            made.no_padding()
        return self._own["tokenizer"]

    @property
    def plain(self):
        """The tokenizer for text that is normalised and has no added tokens."""
        if "plain" not in self._own:
            from tokenizers import Tokenizer

            quiet()
            self._own["plain"] = Tokenizer.from_str(json.dumps(json.loads(self.source) | {"normalizer": None, "added_tokens": []}))
        return self._own["plain"]

    @property
    def bare(self):
        """The tokenizer for text that has no added tokens."""
        if "bare" not in self._own:
            from tokenizers import Tokenizer

            quiet()
            self._own["bare"] = Tokenizer.from_str(json.dumps(json.loads(self.source) | {"added_tokens": [], "truncation": None, "padding": None}))
        return self._own["bare"]

    @property
    def fine(self) -> bool:
        """Whether the tokenizer lower-cases and splits by SPLIT, so that words may be cut finer before it sees them."""
        if "fine" not in self._own:
            known = json.loads(self.source)
            normal = known["normalizer"] or {}
            first = (known["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
            self._own["fine"] = first.get("pattern", {}).get("Regex") == SPLIT and any(x["type"] == "Lowercase" for x in normal.get("normalizers", [normal]) if x)
        return self._own["fine"]

    @property
    def added(self) -> set[str]:
        """Tokens that are found in a text before it is normalised."""
        if "added" not in self._own:
            self._own["added"] = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        return self._own["added"]

    @property
    def suffix(self) -> str:
        """What the vocabulary adds to the last letter of a stretch."""
        if "suffix" not in self._own:
            self._own["suffix"] = json.loads(self.source)["model"].get("end_of_word_suffix") or ""
        return self._own["suffix"]

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def spelled(self) -> pa.Array:
        """The token of each id."""
        if "spelled" not in self._own:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            out: list[str | None] = [None] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                out[i] = token
            self._own["spelled"] = pa.array(out, pa.string())
        return self._own["spelled"]

    def of_words(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of tokens, ids) of consecutive words. Many are encoded at once, with a mark between them whose id tells where a word ends."""
        mark = self.bare.encode(MARK, add_special_tokens=False).ids
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            text = f" {MARK} ".join(part)
            if len(mark) == 1 and text.count(MARK) == len(part) - 1:
                found = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
                ends = np.append(np.flatnonzero(found == mark[0]), len(found))
                yield np.diff(ends, prepend=-1) - 1, found[found != mark[0]]
            else:
                for e in self.bare.encode_batch_fast(part, add_special_tokens=False):
                    yield np.array([len(e.ids)]), np.array(e.ids, np.int32)

    def by_word(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: the offset of its ids and their number; and ids. Words are remembered from batch to batch, up to about WORDS of them."""
        if len(self._own.get("known", ())) > WORDS:
            del self._own["known"]
        known = self._own.setdefault("known", {})
        if not known:
            self._own["counts"], self._own["flat"] = array("q"), array("i")
        counts, flat = self._own["counts"], self._own["flat"]
        listed = words.to_pylist()
        new = [w for w in listed if w not in known]
        for n, ids in self.of_words(new):
            counts.frombytes(n.astype(np.int64).tobytes())
            flat.frombytes(ids.tobytes())
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        which = np.fromiter(map(known.__getitem__, listed), np.int64, len(listed))
        n = np.array(counts, np.int64)
        return (np.cumsum(n) - n)[which], n[which], np.array(flat, np.int32)


def split_encoded(texts: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like Codec.by_word for texts of several words: each distinct word is encoded once."""
    split = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(split.flatten())
    which = coded.indices.to_numpy().astype(np.int64)
    at, counts, ids = encode(coded.dictionary)
    n = counts[which]
    ends = np.cumsum(n)
    flat = ids[np.arange(n.sum()) - np.repeat(ends - n - at[which], n)]
    upto = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return upto[:-1], np.diff(upto), flat


def words_encoded(words: pa.Array, codec: Codec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of distinct words. Those with added tokens are left to the tokenizer; the others are cut between an ASCII letter and ASCII punctuation, where its pattern splits for certain
    (no letter goes on there, and only an apostrophe takes letters after it)."""
    has = np.zeros(len(words), bool)
    for token in codec.added:
        has |= pc.match_substring(words, token).to_numpy(zero_copy_only=False)
    cut = pc.if_else(pa.array(has), "", words)
    if codec.fine:
        cut = pc.ascii_lower(pc.replace_substring_regex(pc.replace_substring_regex(cut, r"([A-Za-z])([!-/:-@\[-`{-~])", r"\1 \2"), r"([!-&(-/:-@\[-`{-~])([A-Za-z])", r"\1 \2"))
    at, counts, ids = split_encoded(cut, codec.by_word)
    for k in np.flatnonzero(has):
        own = np.array(codec.ids(words[int(k)].as_py()), np.int32)
        at[k], counts[k], ids = len(ids), len(own), np.concatenate([ids, own])
    return at, counts, ids


def encoded_batch(texts: pa.Array, codec: Codec) -> pa.Array:
    """list<int> for each text, none of whose words is a long one; null is empty. White space is all that stands between words, and it is dropped."""
    out: list[pa.Array] = []
    for i, j in pieces(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), CHARS):
        part = pc.fill_null(texts.slice(i, j - i), "").cast(pa.large_string())
        at, counts, flat = split_encoded(part, lambda words: words_encoded(words, codec))
        out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)).astype(np.int32)), pa.array(flat, pa.int32())))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


def unsplit(text: str, codec: Codec, block: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ends of the stretches that the pre-tokenizer makes of normalised text without white space, and their starts.

    It reads a block at a time. Where a stretch begins, what follows doesn't depend on what went before; the last two stretches of a block may go on behind it, so they are read again.
    """
    start, size = 0, block
    while start < len(text):
        found = [span for _, span in codec.plain.pre_tokenizer.pre_tokenize_str(text[start : start + size])]
        last = start + size >= len(text)
        if not last and len(found) <= 2:
            size *= 2
            continue
        for a, b in found if last else found[:-2]:
            yield start + a, start + b
        start, size = len(text) if last else start + found[-2][0], block


def parts(text: str, codec: Codec) -> Iterator[tuple[str, str]]:
    """A text as (kind, part) in order: 'text' is whole words or added tokens, 'cut' a part of an unsplit stretch in the vocabulary's letters, 'end' the last of these.

    Where parts of any kind but 'cut' end, the tokenizer splits for certain.
    """
    held: list[str] = []
    size = 0
    marks = re.compile("(" + "|".join(map(re.escape, sorted(codec.added, key=len, reverse=True))) + ")") if codec.added else None
    for m in re.finditer(rf"[^{SPACE}]+", text):
        word = m[0]
        if len(word) <= codec.long:
            held.append(word)
            size += len(word)
        else:
            for piece in filter(None, marks.split(word) if marks else [word]):
                if piece in codec.added or len(piece) <= codec.long:
                    held.append(piece)
                    size += len(piece)
                    if size > CHARS:
                        yield "text", " ".join(held)
                        held, size = [], 0
                    continue
                for clean in (codec.tokenizer.normalizer.normalize_str(piece) if codec.tokenizer.normalizer else piece).split(" "):
                    begin = 0
                    for a, b in unsplit(clean, codec):
                        if b - a <= codec.long:
                            continue
                        if held or a > begin:
                            yield "text", " ".join(held)
                            yield "plain", clean[begin:a]
                            held, size = [], 0
                        begin = b
                        letters = codec.plain.pre_tokenizer.pre_tokenize_str(clean[a:b])[0][0]
                        halves = cuts(len(letters), codec.long)
                        for k, (x, y) in enumerate(zip([0, *halves], [*halves, len(letters)], strict=True)):
                            yield "end" if k == len(halves) else "cut", letters[x:y]
                    if held:
                        yield "text", " ".join(held)
                        held, size = [], 0
                    yield "plain", clean[begin:]
        if size > CHARS:
            yield "text", " ".join(held)
            held, size = [], 0
    if held:
        yield "text", " ".join(held)


def cuts(n: int, most: int) -> list[int]:
    """Where n letters are halved, again and again, until no part has more than `most`."""
    if n <= most:
        return []
    half = n // 2
    return [*cuts(half, most), half, *(half + c for c in cuts(n - half, most))]


class Half:
    """Tokens of a part of an unsplit stretch, and where each begins."""

    def __init__(self, letters: str, ids: list[int], ends: list[int]):
        self.letters, self.ids, self.ends = letters, ids, ends

    def start(self, k: int) -> int:
        return self.ends[k - 1] if k else 0


def merged(letters: str, codec: Codec) -> Half:
    """An unsplit stretch, or a part taken for one, by the model alone."""
    tokens = codec.plain.model.tokenize(letters)
    ends, at, tail = [], 0, codec.suffix
    for t in tokens:
        at += len(t.value)
        ends.append(at)
    if ends and tail and tokens[-1].value.endswith(tail):
        ends[-1] -= len(tail)
    return Half(letters, [t.id for t in tokens], ends)


def joined(left: Half, right: Half, codec: Codec, window: int = 4) -> Half:
    """The tokens of left and right as one stretch.

    The tokens around the join are encoded anew, twice as many each time, until the window begins with a token of the left half and has one of the right half, as they are. Each
    pair of neighbours is then one that the merges leave apart, which makes the whole sequence theirs. The last tokens of the left half and of the window took a word's end
    for granted, so they never count as agreeing. A window that covers both halves is the whole stretch.
    """
    base = len(left.letters)
    while True:
        first, end = max(0, len(left.ids) - window), min(len(right.ids), window)
        low, high = left.start(first), base + right.start(end) if end < len(right.ids) else base + len(right.letters)
        found = merged((left.letters[low:] + right.letters)[: high - low] if low or end < len(right.ids) else left.letters + right.letters, codec)
        whole_right, whole_left = end == len(right.ids), first == 0
        if whole_left or (found.ids[0] == left.ids[first] and low + found.ends[0] == left.ends[first] and first < len(left.ids) - 1):
            if whole_right:
                return Half(left.letters + right.letters, left.ids[:first] + found.ids, left.ends[:first] + [low + e for e in found.ends])
            for t in range(len(found.ids) - 2, 0, -1):
                at = low + found.start(t) - base
                if at < 0:
                    break
                s = bisect.bisect_left(right.ends, at + 1)
                if s < end and right.start(s) == at and right.ids[s] == found.ids[t] and base + right.ends[s] == low + found.ends[t]:
                    return Half(left.letters + right.letters, left.ids[:first] + found.ids[:t] + right.ids[s:], left.ends[:first] + [low + e for e in found.ends[:t]] + [base + e for e in right.ends[s:]])
        window *= 2


def concatenated(halves: list[Half], codec: Codec) -> Half:
    """All parts of a stretch, neighbours first."""
    while len(halves) > 1:
        halves = [joined(halves[i], halves[i + 1], codec) if i + 1 < len(halves) else halves[i] for i in range(0, len(halves), 2)]
    return halves[0]


PARTS = "_f long, _p long, part int, kind string, body string"
CODED = "_f long, _p long, part int, kind string, body string, ids array<int>, ends array<int>"


def of_long(rows: DataFrame, sent) -> DataFrame:
    """rows (_f, _p, text) with long words -> (_f, _p, ids). Parts are dealt out and encoded apart; a text's parts meet where its ids are put together."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.value
        for batch in batches:
            for f, p, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for k, (kind, body) in enumerate(parts(text, codec)):
                    yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([p]), pa.array([k], pa.int32()), pa.array([kind]), pa.array([body])], ["_f", "_p", "part", "kind", "body"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.value
        for batch in batches:
            ids, ends = [], []
            for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if kind in ("cut", "end"):
                    half = merged(body, codec)
                    ids.append(half.ids)
                    ends.append(half.ends)
                else:
                    ids.append((codec.tokenizer if kind == "text" else codec.plain).encode(body, add_special_tokens=False).ids)
                    ends.append([])
            columns = [*batch.columns[:4], pa.array([b if e else "" for b, e in zip(batch.column("body").to_pylist(), ends, strict=True)]), pa.array(ids, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["_f", "_p", "part", "kind", "body", "ids", "ends"])

    def together(table: pa.Table) -> pa.Table:
        codec, out, open_ = sent.value, [], []
        table = table.sort_by("part")
        for k in range(table.num_rows):
            kind, ids = table["kind"][k].as_py(), table["ids"][k].as_py()
            if kind in ("cut", "end"):
                open_.append(Half(table["body"][k].as_py(), ids, table["ends"][k].as_py()))
                if kind == "end":
                    out += concatenated(open_, codec).ids
                    open_ = []
            else:
                out += ids
        return pa.table({"_f": table["_f"].slice(0, 1), "_p": table["_p"].slice(0, 1), "ids": pa.array([out], pa.list_(pa.int32()))})

    split = rows.mapInArrow(cut, PARTS)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = split.repartition(n, "_f", "_p", "part").mapInArrow(code, CODED)
    return dealt.groupBy("_f", "_p").applyInArrow(together, "_f long, _p long, ids array<int>")


def spelled(ids: pa.ListArray, codec: Codec) -> pa.Array:
    """What the tokenizer decodes of each row's ids, special tokens included. Without a decoder of its own it puts a space between tokens."""
    if codec.tokenizer.decoder is not None:
        return pa.array([None if r is None else codec.tokenizer.decode(r, skip_special_tokens=False) for r in ids.to_pylist()], pa.string())
    n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), codec.spelled().take(ids.flatten()))
    return pc.if_else(ids.is_null(), None, pc.binary_join(words, " "))


def decode(spark, ids: Column, model: str = MODEL, codec: Codec | None = None) -> Column:
    """The text of token ids as the tokenizer decodes them, special tokens included; null gives null."""
    sent = spark.sparkContext.broadcast(codec or Codec.load(model))

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_pylist()
        out = [spelled(rows.slice(i, j - i), sent.value) for i, j in pieces(sizes, CHARS)]
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return run(ids)


def encoded(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: str = MODEL, codec: Codec | None = None) -> DataFrame:
    """docs (or the columns `keep` of it) with _ids, the token ids of each whole text as the tokenizer gives them without special tokens of its own making, and _decoded, what they spell.

    A null or empty text, or one of white space alone, has no ids. The tokenizer drops white space, so words are encoded apart, each distinct one once. A text with a word of
    over `long` characters (UNSPLIT) goes another way: what the tokenizer itself doesn't split is halved until no part is longer, the parts are encoded in tasks of
    their own, and halves are joined as joined() states. Repeated rows get equal ids, an empty table gives an empty one; columns _ids and _decoded of the table's own are replaced.

    The vocabulary (some MB) is read on the driver and broadcast. A task holds CHARS characters at a time, or one text. Only texts with long words are shuffled.
    """
    spark = docs.sparkSession
    codec = codec or Codec.load(model)
    sent = spark.sparkContext.broadcast(codec)
    docs = docs.drop("_ids", "_decoded")
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sizes = F.transform(F.split(text, r"[\x20\x09-\x0D]+"), F.char_length)
    long = F.when(F.char_length(text) > codec.long, F.array_max(sizes) > codec.long).otherwise(F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.value
        for batch in batches:
            for i, j in pieces(pc.utf8_length(batch.column(0)).to_pylist(), CHARS):
                part = batch.slice(i, j - i)
                ids = encoded_batch(part.column(0), codec)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids, spelled(ids, codec)], [*batch.schema.names[1:], "_ids", "_decoded"])

    def plain(rows: DataFrame) -> DataFrame:
        schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("_ids", T.ArrayType(T.IntegerType())), T.StructField("_decoded", T.StringType())])
        return rows.select(text.alias(fresh(rows, "_body")), *kept).mapInArrow(run, schema)

    if docs.filter(long).isEmpty():
        return plain(docs)
    rows, (file, place) = numbered(docs, Scratch(spark))
    found = of_long(rows.filter(long).select(F.col(file).alias("_f"), F.col(place).alias("_p"), text.alias("text")), sent)
    ids = fresh(rows, "_found")
    found = found.select(F.col("_f").alias(file), F.col("_p").alias(place), F.col("ids").alias(ids))
    back = rows.filter(long).join(found, [file, place]).select(*kept, F.col(ids).alias("_ids"), decode(spark, F.col(ids), codec=codec).alias("_decoded"))
    return plain(docs.filter(~long)).unionByName(back)
