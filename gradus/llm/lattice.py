"""Lattices of the pieces of a SentencePiece vocabulary over texts, for whole batches at once in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Fixed value: the mark that stands for a space in pieces.
SPACE_MARK = 0x2581
#: Code of a character of the text that is that mark itself; no piece has it.
LITERAL_MARK = 0x110000
#: Arcs at or above it stand for one character, spelled in byte pieces.
SPELLED = 1 << 24
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Vocabulary:
    """pieces: text by id, None for ids that no lattice uses. byte_ids: id of each of the 256 byte pieces. log_w: natural log weight by id."""

    pieces: list[str | None]
    byte_ids: np.ndarray
    log_w: np.ndarray

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Reads a model file. Its scores fall with rank; a weight is that of Zipf's law at the rank, normalised. Byte pieces weigh as much as the last rank."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        score = np.array([model.get_score(i) for i in range(n)])
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.get_score(i) < -1e8 for i in range(n)])
        byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        rank = np.where(special, 0.0, -score)
        rank[byte_ids] = rank.max()
        weight = 1 / (rank + 2.7)
        weight[special] = 0
        weight[byte_ids] = 1 / (rank.max() + 2.7)
        with np.errstate(divide="ignore"):
            return Vocabulary([None if special[i] else model.id_to_piece(i) for i in range(n)], byte_ids, np.log(weight / weight.sum()))

    def prepare(self) -> Vocabulary:
        """Builds the tables, once in each worker: prefixes by hash, characters that join others in a piece, bytes of each piece."""
        if hasattr(self, "keys"):
            return self
        prefixes: dict[int, int] = {}
        self.joins = np.zeros(LITERAL_MARK + 1, bool)
        self.single = np.zeros(LITERAL_MARK + 1, bool)
        mask, base = (1 << 64) - 1, int(BASE)
        self.longest = max(len(p) for p in self.pieces if p)
        for i, p in enumerate(self.pieces):
            if p is None:
                continue
            h = 0
            for c in p:
                h = (h * base + ord(c) + 1) & mask
                prefixes.setdefault(h, -1)
            prefixes[h] = i
            if len(p) == 1:
                self.single[ord(p)] = True
            else:
                self.joins[[ord(c) for c in p]] = True
        self.bits = max(4, (4 * len(prefixes)).bit_length())
        self.keys, self.values, self.probes = np.zeros((1 << self.bits) + 64, np.uint64), np.full((1 << self.bits) + 64, -2, np.int32), 1
        for h, slot in zip(prefixes, (mix(np.array(list(prefixes), np.uint64)) >> np.uint64(64 - self.bits)).tolist(), strict=True):
            k = slot
            while self.keys[k]:
                k += 1
            self.keys[k], self.values[k] = h, prefixes[h]
            self.probes = max(self.probes, k - slot + 1)
        spelled = [b"" if p is None else p.replace("▁", " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            spelled[i] = bytes([b])
        self.sizes = np.array([len(b) for b in spelled], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        return self

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece with this hash; -1: a prefix only, -2: neither."""
        slot = (mix(h) >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        hit = key == h
        out = np.full(len(h), -2, np.int32)
        out[hit] = self.values[slot[hit]]
        left = np.nonzero(~hit & (key != 0))[0]
        for d in range(1, self.probes):
            if not len(left):
                break
            key = self.keys[slot[left] + d]
            hit = key == h[left]
            out[left[hit]] = self.values[slot[left[hit]] + d]
            left = left[~hit & (key != 0)]
        return out


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with spaces as marks, and the length of each."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    code[code == SPACE_MARK] = LITERAL_MARK
    code[code == 32] = SPACE_MARK
    return code, np.array([len(t) for t in texts], np.int64)


def utf8(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the characters that codes stand for, four columns, and how many of them count."""
    c = np.where(code == LITERAL_MARK, SPACE_MARK, np.where(code == SPACE_MARK, 32, code))
    n = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    lead = np.choose(n - 1, [c, 0xC0 | c >> 6, 0xE0 | c >> 12, 0xF0 | c >> 18])
    rest = [0x80 | (c >> s & 0x3F) for s in (0, 6, 12)]
    cols = [lead, np.choose(n - 1, [c, rest[0], rest[1], rest[2]]), np.choose(n - 1, [c, c, rest[0], rest[1]]), rest[0]]
    return np.stack(cols, axis=1), n


@dataclass
class Lattice:
    """Arcs, sorted by the node at their end. Node k of a chunk that begins at `first` is first + k + its number, as each chunk has one node more than characters."""

    source: np.ndarray
    piece: np.ndarray
    upto: np.ndarray  # number of the end node + share of the arcs into it up to this one
    alpha: np.ndarray  # log weight of all ways from the chunk's start to the node
    target: np.ndarray
    share: np.ndarray  # share of the arc in all ways into its end node
    order: np.ndarray  # arcs by the depth of their end node
    bounds: np.ndarray  # where each depth begins in order

    def expected(self, ends: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each arc is passed, on average over all segmentations, if the chunk that ends in each of the nodes comes so many times: the backward recursion."""
        flow, passed = np.zeros(len(self.alpha)), np.zeros(len(self.source))
        flow[ends] = times
        for lo, hi in zip(self.bounds[-2:0:-1], self.bounds[:1:-1], strict=True):
            arc = self.order[lo:hi]
            passed[arc] = flow[self.target[arc]] * self.share[arc]
            np.add.at(flow, self.source[arc], passed[arc])
        return passed


def build(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> Lattice:
    """Forward recursion, in log space, over all segmentations of each chunk."""
    total, chunks = len(code), len(starts)
    chunk = np.repeat(np.arange(chunks), sizes)
    end = np.repeat(starts + sizes, sizes)
    node = np.arange(total) + chunk
    at, h = np.arange(total), np.zeros(total, np.uint64)
    source, target, piece, weight = [], [], [], []
    for n in range(1, vocab.longest + 1):
        fits = at + n <= end[at]
        at, h = at[fits], h[fits]
        if not len(at):
            break
        h = h * BASE + code[at + n - 1].astype(np.uint64) + np.uint64(1)
        found = vocab.find(h)
        hit = found >= 0
        source.append(node[at[hit]])
        target.append(node[at[hit]] + n)
        piece.append(found[hit].astype(np.int64))
        weight.append(vocab.log_w[found[hit]])
        alive = found >= -1
        at, h = at[alive], h[alive]
    spell = np.nonzero(~vocab.single[code])[0]
    cols, n = utf8(code[spell])
    source.append(node[spell])
    target.append(node[spell] + 1)
    piece.append(SPELLED + code[spell])
    weight.append((vocab.log_w[vocab.byte_ids[cols]] * (np.arange(4) < n[:, None])).sum(axis=1))
    source, target, piece, weight = map(np.concatenate, (source, target, piece, weight))
    nodes = total + chunks
    first = starts + np.arange(chunks)
    order = np.argsort(target, kind="stable")  # quick, as the arcs of each length are in order already
    source, target, piece, weight = source[order], target[order], piece[order], weight[order]
    depth = np.zeros(nodes, np.int32)
    depth[node + 1] = np.arange(total) - np.repeat(starts, sizes) + 1
    deepest = int(depth.max(initial=0))
    level = depth[target].astype(np.int16 if deepest < 1 << 15 else np.int32)
    order = np.argsort(level, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(level, minlength=deepest + 1))])
    froms, tos, weights = source[order], target[order], weight[order]
    alpha = np.full(nodes, -np.inf)
    alpha[first] = 0
    for lo, hi in zip(bounds[1:-1], bounds[2:], strict=True):
        if lo == hi:
            continue
        value, to = alpha[froms[lo:hi]] + weights[lo:hi], tos[lo:hi]
        head = np.nonzero(np.diff(to, prepend=-1))[0]
        top = np.maximum.reduceat(value, head)
        alpha[to[head]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, np.diff(head, append=hi - lo))), head))
    share = np.exp(alpha[source] + weight - alpha[target])
    run = np.cumsum(share)
    head = np.nonzero(np.diff(target, prepend=-1))[0]
    counts = np.diff(head, append=len(target))
    before = np.repeat(run[head] - share[head], counts)
    inside = np.minimum(run - before, 1.0)
    inside[head + counts - 1] = 1.0
    return Lattice(source, piece, target + inside, alpha, target, share, order, bounds)


def chunk_starts(code: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Where no piece can reach across: at the start of a text or of a run of spaces, and around characters that join no other."""
    if not len(code):
        return np.zeros(0, np.int64)
    space, joins = code == SPACE_MARK, vocab.joins[code]
    cut = np.zeros(len(code), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | ~joins[1:] | ~joins[:-1]
    begins = np.cumsum(sizes) - sizes
    cut[begins[sizes > 0]] = True
    return np.nonzero(cut)[0]


def chunk_hashes(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each chunk's characters."""
    out = np.add.reduceat(mix(code.astype(np.uint64) + mix((np.arange(len(code)) - np.repeat(starts, sizes)).astype(np.uint64) + BASE)), starts)
    return mix(out + sizes.astype(np.uint64))


def taken(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen chunks' characters in a row, with their starts and sizes there."""
    at = np.cumsum(sizes) - sizes
    return code[np.arange(sizes.sum()) - np.repeat(at - starts, sizes)], at, sizes
