"""The lattice of vocabulary pieces over a word, shared by sampled segmentation and lattice scoring.

A text is cut before every space into units; the space in front of a unit is written as the piece mark. No piece
reaches into the next unit, so a text's lattice is the chain of its units' lattices and equal units have equal
lattices. A character that no piece covers, and a mark character that stands in the text itself, become byte pieces.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np

MARK = "▁"
RAW_MARK = "\ud800"
#: Rank offset of Zipf's law as Mandelbrot has it (fixed value).
ZIPF_OFFSET = 2.7


class Vocabulary(NamedTuple):
    pieces: dict[str, int]  # ordinary pieces, mark only in front
    prefixes: frozenset[str]
    byte_ids: list[int]
    size: int
    scores: np.ndarray  # as the model file has them
    raw: list[bytes]  # what each id decodes to


@lru_cache(2)
def load(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, byte_ids, raw = {}, [0] * 256, [b""] * n
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:-1], 16)
            byte_ids[value] = i
            raw[i] = bytes([value])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and MARK not in piece[1:]:
            pieces[piece] = i
            raw[i] = piece.replace(MARK, " ").encode()
    prefixes = frozenset(p[:k] for p in pieces for k in range(1, len(p) + 1))
    return Vocabulary(pieces, prefixes, byte_ids, n, np.array([model.get_score(i) for i in range(n)]), raw)


def rank_weights(vocabulary: Vocabulary) -> np.ndarray:
    """Log probabilities of the ids from the file's scores. This kind of file scores a piece by minus its rank among the
    merges; Zipf's law makes a rank a probability. Byte pieces are ranked behind all others."""
    rank = np.where(vocabulary.scores <= 0, -vocabulary.scores, 0.0)
    rank = np.minimum(rank, vocabulary.size)
    rank[vocabulary.byte_ids] = vocabulary.size
    weight = 1.0 / (rank + ZIPF_OFFSET)
    usable = np.zeros(vocabulary.size, bool)
    usable[list(vocabulary.pieces.values())] = True
    usable[vocabulary.byte_ids] = True
    weight[~usable] = 0
    with np.errstate(divide="ignore"):
        return np.log(weight / weight.sum())


def shown(text: str) -> str:
    """The text with a surrogate for every mark that stands in it; text from a table is valid Unicode and has none."""
    return text.replace(MARK, RAW_MARK) if MARK in text else text


def units(text: str) -> list[str]:
    """The units of a text: joined they are the text with each space as a mark and each mark as RAW_MARK."""
    first, *rest = shown(text).split(" ")
    return ([first] if first else []) + [MARK + w for w in rest]


def _bytes_of(char: str) -> bytes:
    return (MARK if char == RAW_MARK else char).encode()


SHORT = 32  # characters; longer units are worked on one by one, as LongUnit
BLOCK = 1 << 15  # characters of a long unit whose arcs are held at a time
_EMPTY = np.int64(-1)


class Trie(NamedTuple):
    """The pieces as a trie in an open-addressing table: (node << 21 | character) -> node."""

    keys: np.ndarray
    nodes: np.ndarray
    piece: np.ndarray  # id of the piece that ends at a node, or -1
    shift: np.uint64

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node behind each (node, character), -1 where there is none."""
        key = node.astype(np.int64) << 21 | char
        with np.errstate(over="ignore"):
            at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == key, self.nodes[at], -1)
        more = np.flatnonzero((held != key) & (held != _EMPTY))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            held = self.keys[at[more]]
            hit = held == key[more]
            out[more[hit]] = self.nodes[at[more[hit]]]
            more = more[~hit & (held != _EMPTY)]
        return out


@lru_cache(2)
def trie(path: str) -> Trie:
    number = {"": 0}
    edges: list[tuple[int, int]] = []
    vocabulary = load(path)
    for prefix in sorted(vocabulary.prefixes, key=len):
        number[prefix] = len(number)
        edges.append((number[prefix[:-1]] << 21 | ord(prefix[-1]), number[prefix]))
    piece = np.full(len(number), -1, np.int64)
    for p, i in vocabulary.pieces.items():
        piece[number[p]] = i
    bits = (2 * len(edges)).bit_length() + 1
    keys, nodes = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, np.int64)
    for key, node in edges:
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - bits)
        while keys[at] != _EMPTY:
            at = at + 1 & (1 << bits) - 1
        keys[at], nodes[at] = key, node
    return Trie(keys, nodes, piece, np.uint64(64 - bits))


class Lattices:
    """The lattices of many short units at once, forward log probabilities included.

    Units are ranked by falling length, and nodes numbered by position, then rank: the nodes at a position are
    consecutive, arcs sorted by the node they enter are grouped by position, and each position is one vector step.
    An id below zero is the byte pieces of the character -1 - id."""

    def __init__(self, units: list[str], path: str, prob: np.ndarray):
        model, table, n = load(path), trie(path), len(units)
        length = np.fromiter(map(len, units), np.int64, n)
        order = np.argsort(-length, kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        ranked = length[order]
        codes = np.frombuffer("".join(map(units.__getitem__, order.tolist())).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        longest = int(ranked[0]) if n else 0
        at_least = np.searchsorted(-ranked, -np.arange(longest + 1), side="right")
        self.start = np.concatenate([[0], np.cumsum(at_least)])
        unit = np.repeat(np.arange(n), ranked)
        offset = np.arange(len(codes)) - np.repeat(np.cumsum(ranked) - ranked, ranked)
        left = ranked[unit] - offset  # characters from here to the unit's end
        place, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        src, dst, ids = [], [], []
        for k in range(longest):
            node = table.step(node, codes[place + k])
            on = node >= 0
            if k == 0:
                bare = ~on
                bare[on] = table.piece[node[on]] < 0
                u, o = unit[bare], offset[bare]
                src.append(self.start[o] + u)
                dst.append(self.start[o + 1] + u)
                ids.append(-1 - codes[bare])
            place, node = place[on], node[on]
            ends = table.piece[node] >= 0
            u, o = unit[place[ends]], offset[place[ends]]
            src.append(self.start[o] + u)
            dst.append(self.start[o + k + 1] + u)
            ids.append(table.piece[node[ends]])
            go = left[place] > k + 1
            place, node = place[go], node[go]
            if not len(place):
                break
        none = np.zeros(0, np.int64)
        src, dst, ids = (np.concatenate(x or [none]).astype(np.int32) for x in (src, dst, ids))
        by_end = np.argsort(dst, kind="stable")
        self.src, self.dst, self.ids = src[by_end], dst[by_end], ids[by_end]
        with np.errstate(divide="ignore"):
            log_prob = np.log(prob)
        log_p = log_prob[np.maximum(self.ids, 0)]
        in_bytes = np.flatnonzero(self.ids < 0)
        if len(in_bytes):
            which, back = np.unique(self.ids[in_bytes], return_inverse=True)
            log_p[in_bytes] = np.array([log_prob[byte_pieces(int(w), model)].sum() for w in which])[back]
        self.n, self.longest = n, longest
        self.first = np.searchsorted(self.dst, np.arange(self.start[-1] + 1))
        self.alpha = np.full(self.start[-1], -np.inf)  # natural logs: a word in bytes alone would underflow
        self.alpha[:n] = 0.0
        self.share = np.zeros(len(self.src))  # of the paths into an arc's end, the part that enters by it
        with np.errstate(divide="ignore", invalid="ignore"):
            for t in range(1, longest + 1):
                a, b = self.start[t], self.start[t + 1]
                lo, hi = self.first[a], self.first[b]
                group, into = self.first[a:b] - lo, self.dst[lo:hi] - a
                w = self.alpha[self.src[lo:hi]] + log_p[lo:hi]
                most = np.maximum.reduceat(w, group)
                part = np.exp(w - np.where(most > -np.inf, most, 0.0)[into])
                total = np.add.reduceat(part, group)
                self.alpha[a:b] = most + np.log(total)
                self.share[lo:hi] = np.nan_to_num(part / total[into])
        self.end = self.start[length] + self.rank  # by unit, in the order given

    def marginals(self) -> np.ndarray:
        """Natural log of each unit's probability."""
        return self.alpha[self.end]

    def expectations(self, times: np.ndarray, size: int, model: Vocabulary) -> np.ndarray:
        """By id, the expected use over all segmentations of all units, each unit counted `times`."""
        through = np.zeros(len(self.alpha))  # expected passages of each node, from the ends backwards
        through[self.end] = times
        used = np.zeros(len(self.src))
        for t in range(self.longest, 0, -1):
            lo, hi = self.first[self.start[t]], self.first[self.start[t + 1]]
            used[lo:hi] = self.share[lo:hi] * through[self.dst[lo:hi]]
            np.add.at(through, self.src[lo:hi], used[lo:hi])
        whole = self.ids >= 0
        total = np.bincount(self.ids[whole], used[whole], size)
        if not whole.all():
            which, back = np.unique(self.ids[~whole], return_inverse=True)
            for w, x in zip(which, np.bincount(back, used[~whole])):
                np.add.at(total, byte_pieces(int(w), model), x)
        return total

    def edges(self) -> np.ndarray:
        """For drawing an arc into a node with a 32-bit random number r: the first edge above (node << 32) + r is that of
        the arc. The shares of a node are added up by themselves, so its edges depend on nothing but its unit."""
        first, count = self.first[:-1], np.diff(self.first)
        share, live, j = self.share.copy(), np.flatnonzero(np.diff(self.first) > 1), 1
        while len(live):
            at = first[live] + j
            share[at] += share[at - 1]
            j += 1
            live = live[count[live] > j]
        part = np.minimum(share, 1.0) * 2.0**32
        part[self.first[1:][count > 0] - 1] = 2.0**32
        return (self.dst.astype(np.uint64) << np.uint64(32)) + part.astype(np.uint64)


def byte_pieces(code: int, vocabulary: Vocabulary) -> list[int]:
    """The ids of the bytes that an id below zero stands for."""
    return [vocabulary.byte_ids[b] for b in _bytes_of(chr(-1 - code))]


def _log_sums(log: list[float], other: list[int], log_p: list[float], first: list[int], nodes: range, at: int) -> list[float]:
    """log with log[at + i] = the log of the sum over node i's arcs of exp(log[other end] + log_p), for i in nodes, one after another."""
    for i in nodes:
        lo, hi = first[i], first[i + 1]
        if hi == lo + 1:
            log[at + i] = log[other[lo]] + log_p[lo]
        elif hi > lo:
            ways = [log[other[k]] + log_p[k] for k in range(lo, hi)]
            most = max(ways)
            if most > -math.inf:
                log[at + i] = most + math.log(sum([math.exp(w - most) for w in ways]))
    return log


class LongUnit:
    """The lattice of one unit of any length, block by block, in log space: what is held is a number for each character
    and the arcs of one block."""

    def __init__(self, unit: str, path: str, prob: np.ndarray, block: int = BLOCK):
        self.model, self.trie, self.block = load(path), trie(path), block
        self.codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.reach = max(map(len, self.model.pieces))
        with np.errstate(divide="ignore"):
            self.log_prob = np.log(prob)
        self.in_bytes: dict[int, float] = {}

    def arcs(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(src, dst, id, natural log of the probability) of the arcs out of [begin, end), by src; an id below zero is
        the bytes of the character -1 - id."""
        place, node = np.arange(begin, end), np.zeros(end - begin, np.int64)
        src, dst, ids = [], [], []
        for k in range(self.reach):
            on = place + k < len(self.codes)
            place, node = place[on], node[on]
            if not len(place):
                break
            node = self.trie.step(node, self.codes[place + k].astype(np.int64))
            on = node >= 0
            if k == 0:
                bare = ~on
                bare[on] = self.trie.piece[node[on]] < 0
                src.append(place[bare])
                dst.append(place[bare] + 1)
                ids.append(-1 - self.codes[place[bare]].astype(np.int64))
            place, node = place[on], node[on]
            ends = self.trie.piece[node] >= 0
            src.append(place[ends])
            dst.append(place[ends] + k + 1)
            ids.append(self.trie.piece[node[ends]])
        src, dst, ids = (np.concatenate(x) for x in (src, dst, ids))
        order = np.argsort(src, kind="stable")
        src, dst, ids = src[order], dst[order], ids[order]
        log_p = self.log_prob[np.maximum(ids, 0)]
        for i in np.flatnonzero(ids < 0):
            code = int(ids[i])
            if code not in self.in_bytes:
                self.in_bytes[code] = float(self.log_prob[byte_pieces(code, self.model)].sum())
            log_p[i] = self.in_bytes[code]
        return src, dst, ids, log_p

    def _into(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The arcs into (begin, end], by dst."""
        src, dst, ids, log_p = self.arcs(max(0, begin - self.reach), end)
        inside = (dst > begin) & (dst <= end)
        order = np.flatnonzero(inside)[np.argsort(dst[inside], kind="stable")]
        return src[order], dst[order], ids[order], log_p[order]

    def forward(self) -> np.ndarray:
        """Natural log of the summed probability of all ways to each place between characters."""
        n = len(self.codes)
        log = np.full(n + 1, -np.inf)
        log[0] = 0.0
        for begin in range(0, n, self.block):
            end, low = min(n, begin + self.block), max(0, begin - self.reach)
            src, dst, _, log_p = self._into(begin, end)
            first = np.searchsorted(dst, np.arange(begin + 1, end + 2)).tolist()
            log[low : end + 1] = _log_sums(log[low : end + 1].tolist(), (src - low).tolist(), log_p.tolist(), first, range(end - begin), begin + 1 - low)
        return log

    def expectations(self, times: float, into: np.ndarray) -> None:
        """Add times x the expected use of each id over all segmentations."""
        n = len(self.codes)
        alpha, beta = self.forward(), np.full(n + 1, -np.inf)
        beta[n] = 0.0
        if alpha[n] == -np.inf:
            return
        for end in range(n, 0, -self.block):
            begin, high = max(0, end - self.block), min(n, end + self.reach)
            src, dst, ids, log_p = self.arcs(begin, end)
            first = np.searchsorted(src, np.arange(begin, end + 1)).tolist()
            beta[begin : high + 1] = _log_sums(beta[begin : high + 1].tolist(), (dst - begin).tolist(), log_p.tolist(), first, range(end - begin - 1, -1, -1), 0)
            used = np.exp(alpha[src] + log_p + beta[dst] - alpha[n]) * times
            whole = ids >= 0
            np.add.at(into, ids[whole], used[whole])
            for code, x in zip(ids[~whole].tolist(), used[~whole].tolist()):
                np.add.at(into, byte_pieces(code, self.model), x)

    def sample(self, streams, uniforms) -> list[np.ndarray]:
        """One segmentation for each stream of random numbers, last arc drawn first; uniforms(stream, steps)."""
        n, alpha = len(self.codes), self.forward()
        at, steps, drawn = [n] * len(streams), [0] * len(streams), [[] for _ in streams]
        for end in range(n, 0, -self.block):
            begin = max(0, end - self.block)
            src, dst, ids, log_p = self._into(begin, end)
            share = np.exp(alpha[src] + log_p - alpha[dst]).tolist()
            first = np.searchsorted(dst, np.arange(begin, end + 2)).tolist()
            src, ids = src.tolist(), ids.tolist()
            for i, stream in enumerate(streams):
                most = at[i] - begin
                random = uniforms(stream, np.arange(steps[i], steps[i] + most)).tolist() if most > 0 else []
                k = 0
                while at[i] > begin:
                    lo, hi = first[at[i] - begin], first[at[i] - begin + 1]
                    left, arc = random[k], lo
                    while arc < hi - 1 and left >= share[arc]:
                        left -= share[arc]
                        arc += 1
                    drawn[i].append(ids[arc])
                    at[i] = src[arc]
                    k += 1
                steps[i] += k
        return [np.array(d[::-1], np.int64) for d in drawn]


def log_marginal(unit: str, path: str, prob: np.ndarray) -> float:
    """Natural log of the summed probability of all segmentations of a unit of any length. prob: by id."""
    return float(LongUnit(unit, path, prob).forward()[-1])


def expected_counts(unit: str, times: float, path: str, prob: np.ndarray, into: np.ndarray) -> None:
    """Add times x the expected use of each id over all segmentations of a unit of any length (forward-backward)."""
    LongUnit(unit, path, prob).expectations(times, into)
