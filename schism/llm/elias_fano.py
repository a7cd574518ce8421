"""Elias-Fano sequences and the n-gram trie made of them."""

from __future__ import annotations

import numpy as np

#: Elements decoded at a time by a forward search.
PIECE = 1 << 16
_ONE = np.uint64(1)


class EliasFano:
    """A monotone sequence of n integers below `universe`: low bits packed, high bits in unary, in one uint64 array.

    The array may be a memory map.  `access` picks single values; `successors` answers ascending targets in one
    forward pass that decodes a piece at a time, so a batch of queries costs bounded memory whatever the size.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.n, self.universe, self.l = (int(x) for x in words[:3])
        lows = (self.n * self.l + 63) // 64 + 1
        self.low = words[3 : 3 + lows]
        self.bits = self.n + (self.universe >> self.l) + 1
        highs = (self.bits + 63) // 64
        self.high = words[3 + lows : 3 + lows + highs]
        self.rank = words[3 + lows + highs : 3 + lows + 2 * highs + 1]  # ones before each word

    @staticmethod
    def build(values: np.ndarray, universe: int | None = None) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if universe is None and n else int(universe or 1)
        l = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * l + 63) // 64 + 1, np.uint64)
        if l and n:
            at = np.arange(n, dtype=np.uint64) * np.uint64(l)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = values & ((_ONE << np.uint64(l)) - _ONE)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(l) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        bits = np.zeros((n + (universe >> l) + 1 + 63) // 64 * 64, bool)
        bits[(values >> np.uint64(l)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.uint64)
        return EliasFano(np.concatenate([np.array([n, universe, l], np.uint64), low, high, rank]))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.l)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        carry = (self.low[word + 1] << (np.uint64(63) - shift)) << _ONE
        return ((self.low[word] >> shift) | carry) & ((_ONE << np.uint64(self.l)) - _ONE)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at these positions, a piece of them at a time."""
        i = np.asarray(i, np.int64)
        out = np.empty(len(i), np.uint64)
        for at in range(0, len(i), PIECE):
            own = i[at : at + PIECE]
            word = np.searchsorted(self.rank, own, "right") - 1
            left = (own - self.rank[word].astype(np.int64)).astype(np.uint8)
            spread = np.unpackbits(self.high[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            place = word * 64 + (np.cumsum(spread, 1, np.uint8) <= left[:, None]).sum(1)
            out[at : at + PIECE] = ((place - own).astype(np.uint64) << np.uint64(self.l)) | self._low(own)
        return out

    def decode(self, start: int, stop: int) -> np.ndarray:
        """Values from start to stop."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        a = int(np.searchsorted(self.rank, start, "right")) - 1
        b = int(np.searchsorted(self.rank, stop, "left"))
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high[a:b]).view(np.uint8), bitorder="little")) + a * 64
        i = np.arange(start, stop)
        return ((ones[start - int(self.rank[a]) :][: stop - start] - i).astype(np.uint64) << np.uint64(self.l)) | self._low(i)

    def successors(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending targets: position of the first value >= each (n if none), and whether it is equal."""
        where, same = np.full(len(targets), self.n), np.zeros(len(targets), bool)
        at = 0
        for start in range(0, self.n, PIECE):
            if at == len(targets):
                break
            values = self.decode(start, min(start + PIECE, self.n))
            to = int(np.searchsorted(targets, values[-1], "right"))
            if to > at:
                own = np.searchsorted(values, targets[at:to])
                where[at:to], same[at:to] = start + own, values[own] == targets[at:to]
                at = to
        return where, same


#: Codes of probabilities, two bytes: 0 for none, else 10 ** (-(code - 1) * STEP).
STEP = 0.0005


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.rint(np.minimum(-np.log10(p) / STEP, 65533)) + 1
    return np.where(p > 0, code, 0).astype(np.uint16)


_VALUES = np.concatenate([[0.0], 10.0 ** (-np.arange(65535) * STEP)])


class Level:
    """Children of the nodes above: monotone pointers, and child keys made monotone by adding up each parent's range."""

    def __init__(self, pointers: EliasFano, keys: EliasFano):
        self.pointers, self.keys = pointers, keys

    @staticmethod
    def build(parents: np.ndarray, children: np.ndarray, n_parents: int) -> Level:
        """parents ascending, children ascending within each parent."""
        ends = np.searchsorted(parents, np.arange(n_parents + 1))
        last = ends[1:] - 1
        width = np.where(ends[1:] > ends[:-1], children[np.maximum(last, 0)] + 1 if len(children) else 0, 0).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(width)])
        return Level(EliasFano.build(ends, len(parents) + 1), EliasFano.build(children + base[parents], int(base[-1]) + 1))

    def find(self, parents: np.ndarray, children: np.ndarray) -> np.ndarray:
        """Position of each (parent, child), or -1; queries in any order, parents of -1 aren't there."""
        out = np.full(len(parents), -1)
        ok = np.flatnonzero(parents >= 0)
        order = ok[np.lexsort((children[ok], parents[ok]))]
        p, c = parents[order], children[order]
        new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, int)
        which = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(p))))
        ends = self.pointers.decode(0, self.pointers.n).astype(np.int64)
        lo, hi = ends[p[new]], ends[p[new] + 1]
        base = np.zeros(len(new), np.int64)
        base[lo > 0] = self.keys.access(lo[lo > 0] - 1).astype(np.int64) + 1
        top = np.zeros(len(new), np.int64)
        top[hi > lo] = self.keys.access(hi[hi > lo] - 1).astype(np.int64)
        target = base[which] + c
        inside = (hi > lo)[which] & (target <= top[which])  # a larger key would belong to a later parent
        where, same = self.keys.successors(target[inside].astype(np.uint64))
        out[order[inside]] = np.where(same, where, -1)
        return out


class Trie:
    """Trigram trie by middle word: v -> following words w, v -> words before u, (u, v) -> w as its rank after v.

    Codes hold the quantised parts of the smoothed probabilities:
    p(w|v) = a2 + g2 * p(w), p(w|u,v) = a3 + g3 * p(w|v), with a = c / (C + mu) and g = mu / (C + mu).
    """

    NAMES = ("roots", "succ_ptr", "succ", "ctx_ptr", "ctx", "leaf_ptr", "leaf")

    def __init__(self, sequences: dict, codes: dict):
        self.roots = sequences["roots"]
        self.succ, self.ctx, self.leaf = (Level(sequences[k + "_ptr"], sequences[k]) for k in ("succ", "ctx", "leaf"))
        self.codes = codes

    @staticmethod
    def build(u: np.ndarray, v: np.ndarray, w: np.ndarray, mu2: float, mu3: float) -> Trie:
        """From the word ids of every training trigram occurrence."""
        roots, root = np.unique(v, return_inverse=True)
        top = np.int64(1) << np.int64(40)  # words; a shard has far fewer than 2**23 roots and pairs of words
        if len(v) >> 23 or (len(v) and max(int(u.max()), int(w.max())) >= top):
            raise ValueError("too many positions in a shard, or words")
        pairs, succ, n_succ = np.unique(root * top + w, return_inverse=True, return_counts=True)
        befores, ctx, n_ctx = np.unique(root * top + u, return_inverse=True, return_counts=True)
        parent = pairs // top
        first = np.searchsorted(parent, np.arange(len(roots)))
        leaves, n_leaf = np.unique(ctx * top + (succ - first[root]), return_counts=True)
        n_root = np.bincount(root, minlength=len(roots))
        levels = {"succ": Level.build(parent, pairs % top, len(roots)), "ctx": Level.build(befores // top, befores % top, len(roots)), "leaf": Level.build(leaves // top, leaves % top, len(befores))}
        sequences = {"roots": EliasFano.build(roots)}
        for name, level in levels.items():
            sequences |= {name + "_ptr": level.pointers, name: level.keys}
        codes = {
            "a2": quantise(n_succ / (n_root[parent] + mu2)), "g2": quantise(mu2 / (n_root + mu2)),
            "a3": quantise(n_leaf / (n_ctx[leaves // top] + mu3)), "g3": quantise(mu3 / (n_ctx + mu3)),
        }
        return Trie(sequences, codes)

    def save(self, path: str) -> None:
        levels = {"roots": self.roots, "succ_ptr": self.succ.pointers, "succ": self.succ.keys, "ctx_ptr": self.ctx.pointers, "ctx": self.ctx.keys, "leaf_ptr": self.leaf.pointers, "leaf": self.leaf.keys}
        parts = [levels[k].words.tobytes() for k in self.NAMES] + [self.codes[k].tobytes() for k in ("a2", "g2", "a3", "g3")]
        with open(path, "wb") as f:
            f.write(np.array([len(p) for p in parts], "<u8").tobytes())
            for p in parts:
                f.write(p + b"\0" * (-len(p) % 8))

    @staticmethod
    def load(path: str) -> Trie:
        """The trie over a read-only memory map of the file."""
        data = np.memmap(path, np.uint8, "r")
        sizes = data[:88].view("<u8").astype(np.int64)
        at, parts = 88, []
        for s in sizes:
            parts.append(data[at : at + s])
            at += s + (-s % 8)
        return Trie({k: EliasFano(p.view(np.uint64)) for k, p in zip(Trie.NAMES, parts)}, {k: p.view(np.uint16) for k, p in zip(("a2", "g2", "a3", "g3"), parts[7:])})

    def interpolation(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, g) of each query, with p(w|u,v) = a + g * p(w)."""
        order = np.argsort(v, kind="stable")
        where, same = self.roots.successors(v[order].astype(np.uint64))
        root = np.full(len(v), -1)
        root[order] = np.where(same, where, -1)
        succ, ctx = self.succ.find(root, w), self.ctx.find(root, u)
        known = np.flatnonzero(succ >= 0)
        rank = np.zeros(len(v), np.int64)
        starts = self.succ.pointers.decode(0, self.succ.pointers.n).astype(np.int64)
        rank[known] = succ[known] - starts[root[known]]
        leaf = self.leaf.find(np.where(succ >= 0, ctx, -1), rank)
        pick = lambda name, i, none: np.where(i >= 0, _VALUES[self.codes[name][np.maximum(i, 0)]] if len(self.codes[name]) else none, none)
        a2, g2, a3, g3 = pick("a2", succ, 0.0), pick("g2", root, 1.0), pick("a3", leaf, 0.0), pick("g3", ctx, 1.0)
        return a3 + g3 * a2, g3 * g2
