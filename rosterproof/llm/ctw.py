"""Context-tree weighting over bytes: the numpy core.

A byte is eight binary decisions; the decisions before it in the byte select one of 255
context trees. A tree's node at depth d is the last d bytes; it holds how often the
decision went either way there and the Krichevsky-Trofimov estimate of that. Weighting
mixes a node's own estimate with the product of its children's, half and half, from the
deepest contexts up to the root (Willems, Shtarkov, Tjalkens, "The context-tree weighting
method"). The conditional probability of a decision is then mixed on its path: own
estimate with weight w, the deeper mixture with 1 - w, w being the node's posterior.

A gram is the ``depth`` context bytes and the byte itself in one number, newest byte
lowest, so a shorter context is the same number under a mask.
"""

from __future__ import annotations

import numpy as np

LN2 = float(np.log(2.0))


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2) for whole n >= 0."""
    table = np.concatenate([[0.5 * np.log(np.pi)], np.log(np.arange(63) + 0.5)]).cumsum()
    x = np.maximum(n, 16) + 0.5
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi)
    series += 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return np.where(n < 64, table[np.minimum(n, 63).astype(np.int64)], series)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    table = np.concatenate([[0.0], np.log(np.arange(1, 64))]).cumsum()
    x = np.maximum(n, 16) + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi)
    series += 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return np.where(n < 64, table[np.minimum(n, 63).astype(np.int64)], series)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the KT estimate of a sequence with n0 zeros and n1 ones."""
    return _log_gamma_half(n0) + _log_gamma_half(n1) - np.log(np.pi) - _log_factorial(n0 + n1)


def weigh(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, posterior of the node's own estimate)."""
    log_w = np.logaddexp(own, children) - LN2
    return log_w, np.exp(own - LN2 - log_w)


def deep(grams: np.ndarray, counts: np.ndarray, depth: int, stop: int):
    """The levels ``depth`` .. ``stop`` of all trees over sorted distinct ``grams``.

    ``counts`` are training counts, 0 for a gram that is only asked for. All grams of a
    context of ``stop`` bytes must be given. Returns p (gram x 8: probability of each of
    the byte's decisions, mixed from the deepest level up to ``stop``) and the nodes of
    level ``stop`` - 1 that they belong to: (context and decision as one number, sum of
    the children's log weighted probabilities, zeros, ones).
    """
    keys, cnt = grams.astype(np.uint64), counts.astype(np.float64)
    at = np.arange(len(keys))
    p = np.empty((len(keys), 8))
    below: list[tuple[np.ndarray, np.ndarray]] = []  # (row of the first, log weighted) by decision
    for d in range(depth, stop - 1, -1):
        if d < depth:
            mask = np.uint64((1 << 8 * (d + 1)) - 1)
            keys, inverse = np.unique(keys & mask, return_inverse=True)
            cnt = np.bincount(inverse, cnt, len(keys))
            at = inverse[at]
        levels = []
        for j in range(8):
            node_key = keys >> np.uint64(8 - j)
            new = np.r_[True, node_key[1:] != node_key[:-1]]
            node = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            bit = ((keys >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
            ones = np.bincount(node, cnt * bit, len(first))
            zeros = np.bincount(node, cnt, len(first)) - ones
            own = log_kt(zeros, ones)
            if d == depth:
                log_w, w = own, np.ones(len(own))
            else:
                row, log_below = below[j]
                log_w, w = weigh(own, np.bincount(node[inverse[row]], log_below, len(first)))
            kt = (np.where(bit == 1, ones[node], zeros[node]) + 0.5) / (zeros + ones + 1)[node]
            w = w[node]
            p[:, j] = kt[at] if d == depth else (w * kt)[at] + (1 - w)[at] * p[:, j]
            levels.append((first, log_w, zeros, ones))
        below = [x[:2] for x in levels]
    index, total, zeros, ones = [], [], [], []
    for j, (first, log_w, z, o) in enumerate(levels):
        index.append(node_index(keys[first], stop - 1, j))
        total.append(log_w)
        zeros.append(z)
        ones.append(o)
    index = np.concatenate(index)
    nodes, inverse = np.unique(index, return_inverse=True)
    sums = [np.bincount(inverse, np.concatenate(x), len(nodes)) for x in (total, zeros, ones)]
    return p, (nodes, *sums)


def node_index(keys: np.ndarray, d: int, j: int) -> np.ndarray:
    """Context of d bytes and the j decisions so far as one number: context * 256 + 1bits."""
    context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
    prefix = np.uint64(1 << j) | ((keys & np.uint64(255)) >> np.uint64(8 - j))
    return (context * np.uint64(256) + prefix).astype(np.int64)


class Top:
    """Levels 1 and 0 of all trees, at most 65,536 and 256 nodes, as dense tables."""

    def __init__(self, nodes: np.ndarray, below: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        def dense(x: np.ndarray) -> np.ndarray:
            out = np.zeros(65_536)
            out[nodes] = x
            return out

        zeros, ones, below = dense(zeros), dense(ones), dense(below)
        log_w, self.w1 = weigh(log_kt(zeros, ones), below)
        self.one1 = (ones + 0.5) / (zeros + ones + 1)
        z0, o0 = (x.reshape(256, 256).sum(0) for x in (zeros, ones))
        _, self.w0 = weigh(log_kt(z0, o0), log_w.reshape(256, 256).sum(0))
        self.one0 = (o0 + 0.5) / (z0 + o0 + 1)

    def log10(self, grams: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte in its context; p from ``deep(stop=2)``."""
        out = np.zeros(len(grams))
        for j in range(8):
            n1 = node_index(grams, 1, j)
            n0 = n1 & 255
            bit = ((grams >> np.uint64(7 - j)) & np.uint64(1)) == 1
            kt1 = np.where(bit, self.one1[n1], 1 - self.one1[n1])
            kt0 = np.where(bit, self.one0[n0], 1 - self.one0[n0])
            mixed = self.w1[n1] * kt1 + (1 - self.w1[n1]) * p[:, j]
            out += np.log10(self.w0[n0] * kt0 + (1 - self.w0[n0]) * mixed)
        return out


def table(grams: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """log10 probabilities of all grams in one go, for small inputs and tests."""
    p, nodes = deep(grams, counts, depth, 2)
    return Top(*nodes).log10(grams, p)


def _windows(data: np.ndarray, n: int) -> np.ndarray:
    """Every run of n bytes as one number, from runs of half the length."""
    if n == 1:
        return data.astype(np.uint64)
    left, right = _windows(data, n - n // 2), _windows(data, n // 2)
    size = len(data) - n + 1
    return (left[:size] << np.uint64(8 * (n // 2))) | right[n - n // 2 : n - n // 2 + size]


def grams(texts: list[bytes], depth: int, end: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """(gram at each byte of the texts, each with its end byte; bytes of each text).

    A text starts in the context of ``depth`` end bytes.
    """
    pad = end * depth
    sizes = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b"".join([x for t in texts for x in (pad, t, end)]), np.uint8)
    codes = _windows(data, depth + 1)
    starts = np.cumsum(sizes + depth) - sizes - depth
    real = np.ones(len(codes), bool)
    for s in starts[1:]:
        real[s - depth : s] = False
    return codes[real], sizes
