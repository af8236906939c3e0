"""Linear-chain conditional random fields over many sequences at once, with numpy.

Sequences are cut into chunks of CHUNK positions. The product of a chunk's step matrices carries messages across it, so
forward-backward takes a few hundred vectorised steps for any mix of lengths, and stays exact.
"""

from __future__ import annotations

import numpy as np

CHUNK = 64


def _unit(x: np.ndarray) -> np.ndarray:
    """x with its last axis summing to one."""
    return x / x.sum(-1, keepdims=True)


def posterior(emit: np.ndarray, at: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State marginals (n, s), and the forward and backward messages (each normalised), of each position.

    emit: (n, s) log scores of positions; at: where each sequence begins, and n at the end; trans: (s, s) log scores.
    """
    n, s = emit.shape
    lengths = np.diff(at)
    if not n:
        return emit, emit, emit
    step = np.exp(trans)
    score = np.exp(emit - emit.max(1, keepdims=True))
    per = -(-lengths // CHUNK)
    first = np.concatenate([[0], np.cumsum(per)])  # first chunk of each sequence
    chunks = int(first[-1])
    of = np.repeat(np.arange(len(lengths)), per)
    begin = at[:-1][of] + (np.arange(chunks) - first[:-1][of]) * CHUNK
    size = np.minimum(CHUNK, at[1:][of] - begin)
    by_size = np.argsort(-size, kind="stable")
    begin, back = begin[by_size], np.argsort(by_size, kind="stable")
    size = size[by_size]
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(CHUNK + 1)]  # chunks longer than t

    total = np.broadcast_to(np.eye(s), (chunks, s, s)).copy()
    for t in range(int(size[0])):
        k = active[t]
        total[:k] = (total[:k] @ step) * score[begin[:k] + t][:, None, :]
        total[:k] /= total[:k].sum((1, 2), keepdims=True)
    total = total[back]

    # messages into each chunk, from the left and from the right; sequences with most chunks first
    order = np.argsort(-per, kind="stable")
    live = [int(np.searchsorted(-per[order], -j, "left")) for j in range(int(per.max()) + 1)]
    left, right = np.full((chunks, s), 1.0 / s), np.full((chunks, s), 1.0 / s)
    head = np.linalg.solve(step.T, np.ones(s)) if abs(np.linalg.det(step)) > 1e-12 else None
    for j in range(1, int(per.max())):
        rows = first[:-1][order[: live[j]]] + j
        if j == 1:  # the first position has no step into it
            left[rows] = _unit(_first_message(total, rows - 1, score, begin[back], head, step))
        else:
            left[rows] = _unit(np.einsum("ci,cij->cj", left[rows - 1], total[rows - 1]))
        ends = first[1:][order[: live[j]]] - 1 - j
        right[ends] = _unit(np.einsum("cij,cj->ci", total[ends + 1], right[ends + 1]))

    left, right = left[by_size], right[by_size]
    is_first = (np.arange(chunks) == first[:-1][of])[by_size]
    alpha, beta = np.empty((n, s)), np.empty((n, s))
    now = left
    for t in range(int(size[0])):
        k = active[t]
        into = now[:k] @ step
        if t == 0:
            into[is_first[:k]] = 1.0
        now = _unit(into * score[begin[:k] + t])
        alpha[begin[:k] + t] = now
    now = right.copy()
    for t in range(int(size[0]) - 1, -1, -1):
        k = active[t]
        beta[begin[:k] + t] = now[:k]
        now[:k] = _unit((now[:k] * score[begin[:k] + t]) @ step.T)
    return _unit(alpha * beta), alpha, beta


def _first_message(
    total: np.ndarray,
    rows: np.ndarray,
    score: np.ndarray,
    begin: np.ndarray,
    head: np.ndarray | None,
    step: np.ndarray,
) -> np.ndarray:
    """The message out of a sequence's first chunk: its product begins with a step that the sequence doesn't have."""
    if head is not None:
        out = np.einsum("i,cij->cj", head, total[rows])
        if np.isfinite(out).all() and (out > 0).all():
            return out
    out = np.empty((len(rows), total.shape[1]))
    for i, r in enumerate(rows):  # a singular or badly conditioned transition matrix
        v = _unit(score[begin[r]])
        for t in range(1, CHUNK):
            v = _unit((v @ step) * score[begin[r] + t])
        out[i] = v
    return out


def transition_counts(alpha: np.ndarray, beta: np.ndarray, emit: np.ndarray, at: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected number of each transition."""
    inner = np.ones(len(emit), bool)
    inner[at[:-1][np.diff(at) > 0]] = False
    to = np.flatnonzero(inner)
    score = np.exp(emit[to] - emit[to].max(1, keepdims=True)) * beta[to]
    z = np.einsum("ni,ij,nj->n", alpha[to - 1], np.exp(trans), score)
    return np.einsum("ni,nj->ij", alpha[to - 1] / z[:, None], score) * np.exp(trans)


def true_transitions(y: np.ndarray, at: np.ndarray, s: int) -> np.ndarray:
    inner = np.ones(len(y), bool)
    inner[at[:-1][np.diff(at) > 0]] = False
    to = np.flatnonzero(inner)
    return np.bincount(y[to - 1] * s + y[to], minlength=s * s).reshape(s, s).astype(float)


class Adam:
    def __init__(self, rate: float):
        self.rate, self.k, self.state = rate, 0, {}

    def step(self, name: str, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        m, v = self.state.get(name, (np.zeros_like(g), np.zeros_like(g)))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        self.state[name] = m, v
        k = self.k + 1
        return x - self.rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
