"""Online logistic context mixing over the bytes of words.

Hashed-context predictors (the last one to four bytes, and all of the word so far)
hold counts of zero and one bits. Their stretched predictions are combined by weights
that a gate selects (how many contexts are known, and the place in the word), learned
online; a table of final corrections refines the result adaptively. A word's
probability is the product over its bits, the end of the word included.
"""

from __future__ import annotations

import numpy as np

from loomflow.llm import arrays as A

#: Bytes of context of each predictor (WHOLE: all of the word so far) and the power of two of its slots.
WHOLE = 99
ORDERS, SLOT_BITS = (1, 2, 3, 4, WHOLE), (16, 18, 19, 19, 20)
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])]).astype(np.int64)
SLOTS = int(OFFSETS[-1])
PLACES, STEPS = 4, 48
GATES = (len(ORDERS) + 1) * PLACES
END = 0x20
LIMIT = 12.0
#: Occurrences that damp a step, so that a gate with few words in a batch hardly moves.
DAMPING = 512.0


def _stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Stretched predictions of counts; zero where nothing was counted, and only there."""
    out = np.log((np.maximum(n1, 0) + np.float32(0.05)) / (np.maximum(n0, 0) + np.float32(0.05)))
    out[(out == 0) & (n0 + n1 > 0)] = 1e-30
    return out


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Words:
    """Words of similar length as rows of bytes, longest first, each with its end."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order] + 1
        longest = int(self.sizes[0]) if len(sizes) else 0
        self.bytes = np.full((len(sizes), longest), END, dtype=np.uint8)
        for i in range(longest - 1):
            n = int(np.searchsorted(-self.sizes, -(i + 2), side="right"))
            self.bytes[:n, i] = buf[starts[self.order[:n]] + i]

    def bits(self):
        """(place, edges, slots of each order, node, bit) for each bit of each place, over the beginnings that its words have, each once.

        `edges` has for each word that reaches the place which of the beginnings is its own.
        """
        n_all, longest = self.bytes.shape
        whole = np.full(n_all, np.uint64(0x1234567), dtype=np.uint64)
        shared = True
        for i in range(longest):
            reach = int(np.searchsorted(-self.sizes, -(i + 1), side="right"))
            byte = self.bytes[:reach, i].astype(np.uint64)
            after = A.mix(whole[:reach] * np.uint64(0x100000001B3) + byte + np.uint64(1))
            rows = edges = np.arange(reach)
            if shared:
                _, rows, edges = np.unique(after, return_index=True, return_inverse=True)
                shared = len(rows) < reach
            n, byte = len(rows), byte[rows]
            contexts = []
            for k, order in enumerate(ORDERS):
                if order == WHOLE:
                    h = whole[rows]
                else:
                    h = np.full(n, np.uint64(i + 1 if i < order else 0), dtype=np.uint64)
                    for b in range(max(0, i - order), i):
                        h = h * np.uint64(0x100) + self.bytes[rows, b] + np.uint64(1)
                contexts.append(A.mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)))
            node = np.ones(n, dtype=np.uint64)
            for j in range(7, -1, -1):
                slots = np.empty((len(ORDERS), n), dtype=np.uint64)
                step = node * np.uint64(0xD6E8FEB86659FD93)
                for k, h in enumerate(contexts):
                    x = slots[k]
                    np.add(h, step, out=x)
                    x *= np.uint64(0xFF51AFD7ED558CCD)
                    x >>= np.uint64(64 - SLOT_BITS[k])
                    x += np.uint64(OFFSETS[k])
                bit = (byte >> np.uint64(j)) & np.uint64(1)
                yield i, edges, slots.view(np.int64), node.view(np.int64), bit.view(np.int64)
                node = node * np.uint64(2) + bit
            whole[:reach] = after


def count(batch: Words, weights: np.ndarray, table: np.ndarray) -> None:
    """Adds the words' bits to the counts (2, SLOTS)."""
    w, last, own = weights[batch.order].astype(np.float64), -1, None
    flat = table.reshape(-1)
    for i, edges, slots, _, bit in batch.bits():
        if i != last:
            last, own = i, np.bincount(edges, weights=w[: len(edges)]).astype(table.dtype)
        at = slots + bit * SLOTS
        for k in range(len(ORDERS)):
            np.add.at(flat, at[k], own)


class Mixer:
    """Gated weights and the table of final corrections."""

    def __init__(self):
        self.weights = np.full((GATES, len(ORDERS)), 0.05)
        for known in range(len(ORDERS) + 1):  # at first the longest known context leads
            self.weights[known * PLACES : (known + 1) * PLACES, max(0, known - 1)] = 0.8
        self.seen = np.zeros((PLACES, 256, STEPS))
        self.ones = np.zeros((PLACES, 256, STEPS))
        self.mass = 0.0
        self.made: dict[bool, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"made": {}}

    def predictions(self, table: np.ndarray, left_out: bool) -> np.ndarray:
        """Stretched predictions of all slots, made once for a table; with an occurrence left out, those without a zero, then those without a one."""
        if left_out not in self.made or self.made[left_out][0] is not table:
            n0, n1 = table
            self.made[left_out] = table, np.concatenate([_stretched(n0 - 1, n1), _stretched(n0, n1 - 1)]) if left_out else _stretched(n0, n1)
        return self.made[left_out][1]

    @staticmethod
    def predict(weights: np.ndarray, st: np.ndarray, i: int):
        """(gate, stretched prediction) from those of all orders, by weights (orders, GATES)."""
        gate = (st != 0).sum(axis=0, dtype=np.int8).astype(np.intp)
        gate *= PLACES
        gate += min(i, PLACES - 1)
        x = weights[0].take(gate) * st[0]
        for k in range(1, len(ORDERS)):
            x += weights[k].take(gate) * st[k]
        return gate, np.clip(x, -LIMIT, LIMIT, out=x)

    @staticmethod
    def step(x: np.ndarray) -> np.ndarray:
        return ((x + LIMIT) * (STEPS / (2 * LIMIT))).astype(np.int64).clip(0, STEPS - 1)

    def learn(self, batch: Words, weights: np.ndarray, table: np.ndarray, rate: float) -> None:
        """One online pass over a batch; each word weighs as often as it occurs."""
        w = weights[batch.order].astype(np.float64)
        stretched = self.predictions(table, True)
        last, own = -1, None
        for i, edges, slots, node, bit in batch.bits():
            if i != last:
                last, own = i, np.bincount(edges, weights=w[: len(edges)])
            st = stretched.take(slots + bit * SLOTS)
            gate, x = self.predict(self.weights.T.astype(np.float32), st, i)
            place = min(i, PLACES - 1)
            at = node * STEPS + self.step(x)
            np.add.at(self.seen[place].reshape(-1), at, own)
            np.add.at(self.ones[place].reshape(-1), at, own * bit)
            err = (bit - _squash(x)) * own
            norm = np.bincount(gate, weights=own, minlength=GATES) + DAMPING
            for k in range(len(ORDERS)):
                self.weights[:, k] += rate * np.bincount(gate, weights=err * st[k], minlength=GATES) / norm
        self.mass += float(w.sum())

    def log10(self, batch: Words, table: np.ndarray) -> np.ndarray:
        """log10 probability of each word, in the order given."""
        stretched, weights = self.predictions(table, False), self.weights.T.astype(np.float32)
        trust, ones = ((y / (self.seen + 8)).astype(np.float32).reshape(PLACES, -1) for y in (8, self.ones))
        out, product, own, last = np.zeros(len(batch.order)), np.ones(0), np.zeros(0, np.intp), -1
        for i, edges, slots, node, bit in batch.bits():
            if i != last:
                out[: len(own)] += np.log10(product)[own]
                product, own, last = np.ones(len(bit)), edges, i
            _, x = self.predict(weights, stretched.take(slots), i)
            at, place = node * STEPS + self.step(x), min(i, PLACES - 1)
            p = (_squash(x) * (1 + trust[place].take(at)) + ones[place].take(at)) / 2
            product *= np.where(bit == 1, p, 1 - p).clip(1e-7, 1 - 1e-7)
        out[: len(own)] += np.log10(product)[own]
        back = np.empty_like(out)
        back[batch.order] = out
        return back


def merged(mixers: list[Mixer]) -> Mixer:
    """The mean of mixers by mass, their corrections added up."""
    out = Mixer()
    total = sum(m.mass for m in mixers)
    if total:
        out.weights = sum(m.weights * (m.mass / total) for m in mixers)
        out.seen, out.ones = sum(m.seen for m in mixers), sum(m.ones for m in mixers)
    return out
