"""SentencePiece encoding by forward-filtering backward-sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, pieces
from .lattice import SPELLED, Vocabulary, build, chunk_hashes, chunk_starts, codes_of, mix, taken, utf8

#: Characters whose lattice is held at a time.
CHARS = 500_000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def sample(texts: list[str], keys: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts' pieces and the number of each text. Each random number comes from the row's key, the chunk's place in its text and the step: it doesn't depend on the batch."""
    code, lengths = codes_of(texts)
    if not len(code):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    starts = chunk_starts(code, lengths, vocab)
    sizes = np.diff(starts, append=len(code))
    _, first, which = np.unique(chunk_hashes(code, starts, sizes), return_index=True, return_inverse=True)
    own_code, own_starts, own_sizes = taken(code, starts[first], sizes[first])
    lattice = build(own_code, own_starts, own_sizes, vocab)
    zero = own_starts + np.arange(len(first))
    text = np.repeat(np.arange(len(texts)), lengths)[starts]
    place = np.arange(len(starts)) - np.searchsorted(text, text)
    seed = mix(keys[text] + mix(place.astype(np.uint64)))
    at = np.argsort(which, kind="stable")  # equal chunks together: their arcs are near each other
    node, goal = (zero + own_sizes)[which[at]], zero[which[at]]
    steps, count = [], np.zeros(len(starts), np.int64)
    step = 0
    while len(at):
        chance = (mix(seed[at] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        arc = np.searchsorted(lattice.upto, node + chance * (1 - 1e-9), side="right")
        steps.append((at, lattice.piece[arc]))
        count[at] += 1
        node = lattice.source[arc]
        left = node != goal
        node, goal, at = node[left], goal[left], at[left]
        step += 1
    offset = np.cumsum(count)
    found = np.empty(count.sum(), np.int64)
    for k, (at, piece) in enumerate(steps):
        found[offset[at] - 1 - k] = piece
    owner = np.repeat(text, count)
    spelled = found >= SPELLED
    if not spelled.any():
        return found.astype(np.int32), np.bincount(owner, minlength=len(texts))
    cols, n = utf8(found[spelled] - SPELLED)
    width = np.ones(len(found), np.int64)
    width[spelled] = n
    to = np.cumsum(width) - width
    out = np.empty(width.sum(), np.int32)
    out[to[~spelled]] = found[~spelled]
    for k in range(4):
        has = n > k
        out[to[spelled][has] + k] = vocab.byte_ids[cols[has, k]]
    return out, np.bincount(np.repeat(owner, width), minlength=len(texts))


def joined(ids: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> list[str]:
    """The texts that these ids spell."""
    size = vocab.sizes[ids]
    at = np.cumsum(size) - size
    raw = vocab.bytes[np.arange(size.sum()) - np.repeat(at - vocab.offsets[ids], size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(counts)), counts), size, minlength=len(counts)))]).astype(np.int64)
    return [raw[i:j].decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:], strict=True)]


def drawn(texts: pa.Array, keys: pa.Array, vocab: Vocabulary, check: bool) -> tuple[pa.Array, pa.Array]:
    """Ids of each text (null for null) and, with check, whether they spell the text again."""
    ids, counts, same = [], [], []
    seeds = mix(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    for i, j in pieces(sizes, CHARS):
        part = [t or "" for t in texts.slice(i, j - i).to_pylist()]
        found, n = sample(part, seeds[i:j], vocab)
        ids.append(found)
        counts.append(n)
        if check:
            same += [a == b for a, b in zip(joined(found, n, vocab), part, strict=True)]
    null = texts.is_null()
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64))]).astype(np.int32)
    values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=null), pc.if_else(null, None, pa.array(same, pa.bool_())) if check else null


def encode(spark, text: Column, key: Column, model: str = MODEL, vocab: Vocabulary | None = None) -> Column:
    """array<int>: piece ids of a segmentation, drawn with the probability that the vocabulary's weights give it among all of them.

    `key` seeds it: the same key, text and model give the same ids anywhere; a null key counts as 0. Spaces become the piece mark; nothing is
    normalised, and characters that are no piece, or are the mark itself, are spelled in bytes, so decode(encode(x)) = x. Null gives null, '' no ids.
    The vocabulary (some MB at most) is read on the driver and broadcast.
    """
    sent = spark.sparkContext.broadcast(vocab or Vocabulary.load(model))

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return drawn(texts, keys, sent.value.prepare(), False)[0]

    return run(text, F.xxhash64(key))


def decode(spark, ids: Column, model: str = MODEL, vocab: Vocabulary | None = None) -> Column:
    """The text of piece ids; null gives null. Ids of control pieces spell nothing; bytes that are no UTF-8 become U+FFFD, which encode() never gives."""
    sent = spark.sparkContext.broadcast(vocab or Vocabulary.load(model))

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        known = sent.value.prepare()
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out: list[str] = []
        for i, j in pieces(sizes.tolist(), CHARS):
            out += joined(pc.list_flatten(rows.slice(i, j - i)).to_numpy(zero_copy_only=False).astype(np.int64), sizes[i:j], known)
        return pc.if_else(rows.is_null(), None, pa.array(out, pa.string()))

    return run(ids)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """docs with _ids, _n_pieces and _lossless (whether the decoded ids are the text; null for null), from one pass.

    A null text has null ids, an empty one none. Texts of any length are encoded whole, CHARS characters or one text at a time. A null id seeds as any id does, so rows of one id and text, repeated ones too, get equal
    ids. Columns _ids, _n_pieces and _lossless of the table's own are replaced; other columns are kept. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    @F.arrow_udf("struct<ids:array<int>,lossless:boolean>")
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        ids, same = drawn(texts, keys, sent.value.prepare(), True)
        return pa.StructArray.from_arrays([ids, same], ["ids", "lossless"])

    both = fresh(docs, "_both")
    found = docs.withColumn(both, run(F.col(text_col).cast("string"), F.xxhash64(id_col)))
    ids = F.col(f"{both}.ids")
    return found.withColumns({"_ids": ids, "_n_pieces": F.when(ids.isNotNull(), F.size(ids)), "_lossless": F.col(f"{both}.lossless")}).drop(both)
