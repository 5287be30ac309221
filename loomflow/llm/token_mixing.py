"""Online logistic context mixing over the token stream of each document.

A token's class is a byte of its word's hash. The class's eight bits are predicted by
hashed contexts that reach into the words before: none (the class's own share), the
last word, the last two, and the last but one. A context counts the values of the
class's high half, and those of its low half for each high half, in groups of sixteen;
sums over a group are what a bit's zeros and ones were. The stretched predictions are
combined by weights that a gate selects (which bit, and how often the contexts of the
last word and of the last two were seen); a table of final corrections refines the
result.
"""

from __future__ import annotations

import numpy as np

from loomflow.llm import arrays as A

#: Powers of two of each context's slots, for either half; together they are two tables of fixed size.
SLOT_BITS = (8, 19, 20, 19)
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])]).astype(np.int64)
SLOTS = int(OFFSETS[-1])
CLASSES, CONTEXTS, LEVELS, STEPS = 256, len(SLOT_BITS), 4, 48
GATES = 8 * LEVELS * LEVELS
LIMIT = 12.0
#: Times a context was seen from which its level of trust is 1, 2 and 3.
SEEN = (0.5, 4.0, 32.0)
#: Tokens of a slab of learning and of scoring.
SLAB = 1 << 14
#: What the weights that learning begins with weigh against what is seen, and the most that a weight becomes; those weights, by level.
PRIOR, MOST = 4.0, 4.0
START = np.tile([
    [0.1, 0.3, 0.5, 0.2], [0.2, 0.3, 0.3, 0.2], [0.2, 0.3, 0.1, 0.2], [0.2, 0.3, 0.2, 0.2], [0.3, 0.2, 0.5, 0.2], [0.3, 0.2, 0.3, 0.2], [0.3, 0.1, 0.2, 0.2], [0.3, 0.1, 0.2, 0.2],
    [0.4, 0.2, 0.5, 0.2], [0.3, 0.1, 0.2, 0.2], [0.5, 0.2, 0.1, 0.4], [0.3, 0.5, 0.1, 0.5], [0.2, 0.3, 0.5, 0.1], [0.4, 0.3, 0.2, 0.2], [0.4, 0.4, 0.2, 0.3], [0.2, 0.4, 0.4, 0.3],
], (8, 1))
#: Steps where all is learned in one process.
STEPS_OF_ONE = 3
#: Pairs of contexts, of which the second derivatives are.
PAIRS = [(k, m) for k in range(CONTEXTS) for m in range(k, CONTEXTS)]
#: Tokens whose counts are added at once.
COUNT_SLAB = 1 << 19
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def classes(words: np.ndarray) -> np.ndarray:
    """The class of each word hash."""
    return (A.mix(words ^ _ODD[1]) >> np.uint64(56)).astype(np.int64)


def contexts(tokens: np.ndarray, end: np.uint64) -> np.ndarray:
    """(3, n) hashed contexts of documents end to end, each closed by `end`; the words before a document are `end`."""
    last = np.concatenate([[end], tokens[:-1]])[: len(tokens)]
    before = np.concatenate([[end, end], tokens[:-2]])[: len(tokens)]
    before[np.flatnonzero(last == end)] = end
    one, two = A.mix(last * _ODD[0] + np.uint64(1)), A.mix(before * _ODD[1] + np.uint64(2))
    return np.stack([one, A.mix(one + two * _ODD[2]), two])


def halves(found: np.ndarray, cls: np.ndarray):
    """(half, first slot (CONTEXTS, n) of each context's group, value) for the high and the low half of all classes."""
    high = cls >> 4
    for half, value in enumerate((high, cls & 15)):
        first = np.empty((CONTEXTS, len(cls)), dtype=np.int64)
        first[0] = half * high << 4
        step = (half * high).astype(np.uint64) * _ODD[2]
        for k in range(1, CONTEXTS):
            group = ((found[k - 1] + step) * _ODD[3]) >> np.uint64(68 - SLOT_BITS[k])
            first[k] = (group.astype(np.int64) << 4) + OFFSETS[k]
        yield half, first, value


def bits(found: np.ndarray, cls: np.ndarray):
    """(half, bit number, slots (CONTEXTS, n) of the bit's nodes, bit) for each of the eight bits of all classes."""
    for half, first, value in halves(found, cls):
        node = np.ones(len(cls), dtype=np.int64)
        for j in range(4):
            bit = (value >> (3 - j)) & 1
            yield half, 4 * half + j, first + node, bit
            node = node * 2 + bit


def count(tokens: np.ndarray, end: np.uint64, table: np.ndarray) -> None:
    """Adds the halves of some documents' tokens to the counts (2, SLOTS)."""
    found, cls = contexts(tokens, end), classes(tokens)
    for at in range(0, len(tokens), COUNT_SLAB):
        for half, first, value in halves(found[:, at : at + COUNT_SLAB], cls[at : at + COUNT_SLAB]):
            for k, (lo, hi) in enumerate(zip(OFFSETS, OFFSETS[1:])):
                table[half, lo:hi] += np.bincount(first[k] - lo + value, minlength=hi - lo).astype(table.dtype)


def nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The zeros and the ones of the fifteen nodes of each group's tree; the first slot of a group has no node."""
    left = counts.reshape(-1, 16)
    zeros, ones = np.zeros_like(left), np.zeros_like(left)
    for j in range(3, -1, -1):
        pairs = left.reshape(len(left), 1 << j, 2)
        zeros[:, 1 << j : 2 << j], ones[:, 1 << j : 2 << j] = pairs[:, :, 0], pairs[:, :, 1]
        left = pairs.sum(axis=2)
    return zeros.ravel(), ones.ravel()


def class_counts(table: np.ndarray) -> np.ndarray:
    """How often each class was counted: the low halves of the context without words."""
    return table[1, :CLASSES].astype(np.float64)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _terms(table: np.ndarray, own: np.ndarray, slots: np.ndarray, groups: np.ndarray | None, j: int, width: int):
    """(groups, their packed predictions at the slots): a group is one line of memory and holds four bits' nodes."""
    if j % 4 == 0:
        groups = table.reshape(-1, width).take(slots >> 4, axis=0).reshape(CONTEXTS, -1)
    return groups, groups.take(own + (slots[0] & 15), axis=1)


class Sums:
    """What a step of Newton's method over all training tokens needs, at given weights: for each gate the gradient of the
    likelihood and its second derivatives, and how often a bit was zero and one where it was predicted so. Sums of a fixed size."""

    def __init__(self):
        self.first, self.second = np.zeros((CONTEXTS, GATES)), np.zeros((len(PAIRS), GATES))
        self.times = np.zeros((2 * CLASSES, STEPS, 2), dtype=np.int64)

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in vars(self).values()]).astype(np.float64)

    @classmethod
    def of_vector(cls, vector: np.ndarray) -> Sums:
        out, at = cls(), 0
        for own in vars(out).values():
            own[...] = vector[at : at + own.size].reshape(own.shape)
            at += own.size
        return out


class Learner:
    """Predictions of all slots without the occurrence that is learned from, and weights from which a step begins."""

    def __init__(self, table: np.ndarray, end: np.uint64, weights: np.ndarray):
        self.end, self.weights = end, weights
        self.packed = np.stack([np.stack([Mixer._packed(np.maximum(zeros - 1, 0), ones), Mixer._packed(zeros, np.maximum(ones - 1, 0))]) for zeros, ones in (nodes(counts) for counts in table)])
        self.packed = self.packed.reshape(2, 2, -1, 16).transpose(0, 2, 1, 3).copy()  # both of a group beside each other

    def learn(self, tokens: np.ndarray, sums: Sums) -> None:
        """Adds documents end to end."""
        found, cls = contexts(tokens, self.end), classes(tokens)
        for k in range(0, len(tokens), SLAB):
            self._learn(found[:, k : k + SLAB], cls[k : k + SLAB], sums)

    def _learn(self, found: np.ndarray, cls: np.ndarray, sums: Sums) -> None:
        weights = (self.weights.reshape(8, LEVELS * LEVELS, CONTEXTS) / 256).astype(np.float32).transpose(0, 2, 1).copy()
        own, groups = np.arange(len(cls)) << 5, None
        for half, j, slots, bit in bits(found, cls):
            groups, got = _terms(self.packed[half], own + (bit << 4), slots, groups, j, 32)
            gate = ((got[1] & 3) * np.int16(LEVELS) + (got[2] & 3)).astype(np.intp)
            st = (got >> 2).astype(np.float32)
            x = weights[j, 0].take(gate) * st[0]
            for k in range(1, CONTEXTS):
                x += weights[j, k].take(gate) * st[k]
            np.clip(x, -LIMIT, LIMIT, out=x)
            at = (((slots[0] & (CLASSES - 1)) + half * CLASSES) * STEPS + Mixer._step(x) << 1) + bit
            np.add.at(sums.times.reshape(-1), at, 1)
            p = _squash(x)
            st *= np.float32(1 / 256)
            err, curve = bit - p, p * (1 - p)
            gates = slice(j * LEVELS * LEVELS, (j + 1) * LEVELS * LEVELS)
            for k in range(CONTEXTS):
                sums.first[k, gates] += np.bincount(gate, weights=err * st[k], minlength=LEVELS * LEVELS)
            bent = curve * st
            for n, (k, m) in enumerate(PAIRS):
                sums.second[n, gates] += np.bincount(gate, weights=bent[k] * st[m], minlength=LEVELS * LEVELS)


def stepped(weights: np.ndarray, sums: Sums) -> np.ndarray:
    """The weights after a step, toward START where little was seen; rounded, so that the order of sums doesn't matter."""
    out = np.empty_like(weights)
    for g in range(GATES):
        bend = np.zeros((CONTEXTS, CONTEXTS))
        for (k, m), x in zip(PAIRS, sums.second[:, g]):
            bend[k, m] = bend[m, k] = x
        out[g] = weights[g] + np.linalg.solve(bend + PRIOR * np.eye(CONTEXTS), sums.first[:, g] + PRIOR * (START[g] - weights[g]))
    return np.rint(out.clip(-MOST, MOST) * 4096) / 4096


class Mixer:
    """Stretched predictions of each slot, gated weights and final corrections, all of a fixed size."""

    def __init__(self, table: np.ndarray, texts: list[np.ndarray], end: np.uint64):
        """Learned by some steps over texts of tokens, in one process."""
        weights, sums = START, Sums()
        for _ in range(STEPS_OF_ONE if texts else 0):
            learner, sums = Learner(table, end, weights), Sums()
            learner.learn(np.concatenate(texts), sums)
            weights = stepped(weights, sums)
        self._set(table, end, weights, sums)

    @classmethod
    def of_sums(cls, table: np.ndarray, end: np.uint64, weights: np.ndarray, sums: Sums) -> Mixer:
        out = cls.__new__(cls)
        out._set(table, end, weights, sums)
        return out

    def _set(self, table: np.ndarray, end: np.uint64, weights: np.ndarray, sums: Sums) -> None:
        self.end, self.weights, self.seen, self.ones = end, weights, sums.times.sum(axis=2).astype(np.float64), sums.times[:, :, 1].astype(np.float64)
        self.packed = np.stack([self._packed(zeros, ones) for zeros, ones in (nodes(counts) for counts in table)])

    @classmethod
    def _packed(cls, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        return np.concatenate([cls._pack(zeros[k : k + (1 << 18)].astype(np.float64), ones[k : k + (1 << 18)].astype(np.float64)) for k in range(0, SLOTS, 1 << 18)])

    @staticmethod
    def _inputs(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = n0 + n1
        level = np.zeros(total.shape, dtype=np.int64)
        for least in SEEN:
            level += total >= least
        return np.log((n1 + 0.2) / (n0 + 0.2)).clip(-LIMIT, LIMIT), level

    @classmethod
    def _pack(cls, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        st, level = cls._inputs(n0, n1)
        return (np.rint(st * 256).astype(np.int16) << 2) | level.astype(np.int16)

    @staticmethod
    def _step(x: np.ndarray) -> np.ndarray:
        return ((x + LIMIT) * (STEPS / (2 * LIMIT))).astype(np.int64).clip(0, STEPS - 1)

    def log10(self, tokens: np.ndarray) -> np.ndarray:
        """log10 probability of the class of each token of documents end to end, given the words before."""
        found, cls = contexts(tokens, self.end), classes(tokens)
        return np.concatenate([self._log10(found[:, k : k + SLAB], cls[k : k + SLAB]) for k in range(0, len(tokens), SLAB)] or [np.zeros(0)])

    def _log10(self, found: np.ndarray, cls: np.ndarray) -> np.ndarray:
        weights = (self.weights.reshape(8, LEVELS * LEVELS, CONTEXTS) / 256).astype(np.float32).transpose(0, 2, 1).copy()
        trust = (8 / (self.seen + 8)).astype(np.float32).ravel()
        ones = (self.ones / (self.seen + 8)).astype(np.float32).ravel()
        out = np.ones(len(cls))
        own = np.arange(len(cls)) << 4
        groups = None
        for half, j, slots, bit in bits(found, cls):
            groups, got = _terms(self.packed[half], own, slots, groups, j, 16)
            gate = (got[1] & 3) * np.int16(LEVELS) + (got[2] & 3)
            st = (got >> 2).astype(np.float32)
            x = weights[j, 0].take(gate) * st[0]
            for k in range(1, CONTEXTS):
                x += weights[j, k].take(gate) * st[k]
            np.clip(x, -LIMIT, LIMIT, out=x)
            p = _squash(x)
            at = (slots[0] + half * CLASSES) * STEPS + self._step(x)
            p = (p * (1 + trust.take(at)) + ones.take(at)) / 2
            out *= np.where(bit == 1, p, 1 - p).clip(1e-7, 1)
        return np.log10(out)
