"""Two-state linear-chain conditional random field in numpy.

Many documents are one long chain: at a document's first word the transition
is replaced by one that forgets the state before.  Forward and backward
vectors are running products of 2 x 2 matrices; they are found by a blocked
scan (products of blocks, then the starts of the blocks by the same scan, then
all blocks in step), so the number of numpy calls grows with the logarithm of
the chain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 64


def _scan(m: np.ndarray) -> np.ndarray:
    """Row vectors v[i] = (1, 1) m[0] ... m[i-1], each scaled to sum 1; m: (2, 2, n)."""
    n = m.shape[2]
    if n <= BLOCK:
        out = np.empty((2, n))
        a = b = 0.5
        for i in range(n):
            out[0, i], out[1, i] = a, b
            a, b = a * m[0, 0, i] + b * m[1, 0, i], a * m[0, 1, i] + b * m[1, 1, i]
            s = a + b
            a, b = a / s, b / s
        return out
    blocks = -(-n // BLOCK)
    full = np.ones((2, 2, blocks * BLOCK))
    full[:, :, :n] = m
    full = np.ascontiguousarray(full.reshape(2, 2, blocks, BLOCK).transpose(3, 0, 1, 2))
    p = full[0].copy()
    for k in range(1, BLOCK):
        q = full[k]
        p = np.stack([
            np.stack([p[0, 0] * q[0, 0] + p[0, 1] * q[1, 0], p[0, 0] * q[0, 1] + p[0, 1] * q[1, 1]]),
            np.stack([p[1, 0] * q[0, 0] + p[1, 1] * q[1, 0], p[1, 0] * q[0, 1] + p[1, 1] * q[1, 1]]),
        ])
        p /= p.max(axis=(0, 1))
    v = _scan(p)
    out = np.empty((BLOCK, 2, blocks))
    for k in range(BLOCK):
        out[k] = v
        q = full[k]
        v = np.stack([v[0] * q[0, 0] + v[1] * q[1, 0], v[0] * q[0, 1] + v[1] * q[1, 1]])
        v /= v[0] + v[1]
    return out.transpose(1, 2, 0).reshape(2, -1)[:, :n]


@dataclass
class Chain:
    """Weights: one per observation feature (for state 1), and transitions (from, to)."""

    weights: np.ndarray
    transitions: np.ndarray

    def _matrices(self, unary: np.ndarray, first: np.ndarray) -> np.ndarray:
        step = np.exp(self.transitions)
        emit = np.stack([np.ones(len(unary)), np.exp(np.clip(unary, -30, 30))])
        m = step[:, :, None] * emit[None, :, :]
        m[:, :, first] = emit[None, :, first]
        return m

    def marginals(self, observed: np.ndarray, first: np.ndarray, pairs: bool = False,
                  weights: np.ndarray | None = None):
        """P(state 1) of every word; with ``pairs`` also the expected transitions.

        ``observed`` holds the numbers of each word's active features, one row
        per word; ``first`` marks the words that begin a document; ``weights``
        are the words' weights in the expected transitions.
        """
        unary = self.weights[observed].sum(axis=1)
        n = len(unary)
        if not n:
            return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
        m = self._matrices(unary, first)
        before = _scan(m)  # state of the word before
        ahead = before[0] * m[0] + before[1] * m[1]
        after = np.ones((2, n))
        if n > 1:
            # Backward: the same scan over transposed matrices from the end.
            back = _scan(np.ascontiguousarray(m.transpose(1, 0, 2)[:, :, ::-1]))
            after = back[:, ::-1]
        both = ahead * after
        p = both[1] / (both[0] + both[1])
        if not pairs:
            return p
        joint = before[:, None, :] * m * after[None, :, :]
        joint /= joint.sum(axis=(0, 1))
        if weights is not None:
            joint *= weights
        return p, joint[:, :, ~first].sum(axis=2)


def fit(
    observed: np.ndarray, first: np.ndarray, labels: np.ndarray, n_features: int,
    steps: int = 80, rate: float = 0.2, decay: float = 1e-3, weights: np.ndarray | None = None,
) -> Chain:
    """Likelihood ascent (Adam, whole batch) on labelled words; ``weights``: one per word."""
    if weights is None:
        weights = np.ones(len(labels))
    chain = Chain(np.zeros(n_features), np.zeros((2, 2)))
    known = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(known, (labels[inner - 1], labels[inner]), weights[inner])
    have = np.bincount(observed.ravel(), np.repeat(labels * weights, observed.shape[1]), n_features)
    scale = 1.0 / max((labels * weights).sum(), 1)
    m = np.zeros(n_features + 4)
    v = np.zeros(n_features + 4)
    for t in range(1, steps + 1):
        p, moves = chain.marginals(observed, first, pairs=True, weights=weights)
        expected = np.bincount(observed.ravel(), np.repeat(p * weights, observed.shape[1]), n_features)
        slope = np.concatenate([have - expected, (known - moves).ravel()]) * scale
        slope -= decay * np.concatenate([chain.weights, chain.transitions.ravel()])
        m = 0.9 * m + 0.1 * slope
        v = 0.98 * v + 0.02 * slope**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)
        chain.weights += move[:n_features]
        chain.transitions += move[n_features:].reshape(2, 2)
    return chain
