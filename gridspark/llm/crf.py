"""Two-label linear-chain conditional random field on flat arrays.

Many sequences lie one after another in one array; ``first`` marks where each
begins. Label 1 is the one looked for. The potential of step ``t`` is
``emission[t]`` for label 1 (0 for label 0) plus ``trans[i, j]``, or
``start[j]`` where a sequence begins. A step is then a 2 x 2 matrix, and the
forward and backward passes are prefix products of these matrices: they are
taken in about sqrt(n) vectorised steps, whatever the length of the longest
sequence.
"""

from __future__ import annotations

import numpy as np

CLIP = 30.0


def _times(a: np.ndarray, b: np.ndarray, best: bool) -> np.ndarray:
    """Product of 2 x 2 matrices held in the last two axes (max-plus for ``best``), scaled against overflow."""
    if best:
        out = np.maximum(a[..., :, 0, None] + b[..., None, 0, :], a[..., :, 1, None] + b[..., None, 1, :])
        return out - out.max(axis=(-1, -2), keepdims=True)
    out = a[..., :, 0, None] * b[..., None, 0, :] + a[..., :, 1, None] * b[..., None, 1, :]
    return out / out.max(axis=(-1, -2), keepdims=True)


def _prefix_rows(m: np.ndarray, best: bool) -> np.ndarray:
    """Row vectors v0 m[0] ... m[t] for all t, each up to a factor; m[0] forgets what comes before it."""
    n = len(m)
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    unit = np.array([[0.0, -np.inf], [-np.inf, 0.0]]) if best else np.eye(2)
    p = np.empty((blocks * width, 2, 2))
    p[:n], p[n:] = m, unit
    p = p.reshape(blocks, width, 2, 2)
    for t in range(1, width):
        p[:, t] = _times(p[:, t - 1], p[:, t], best)
    carry = np.empty((blocks, 1, 2, 2))
    carry[0, 0] = unit
    for b in range(1, blocks):
        carry[b, 0] = _times(carry[b - 1, 0], p[b - 1, width - 1], best)
    return _times(carry, p, best).reshape(-1, 2, 2)[:n, 0]


def _passes(emission: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray, best: bool):
    """Step matrices, forward rows and backward rows."""
    e = np.zeros((len(emission), 1, 2))
    e[:, 0, 1] = np.clip(emission, -CLIP, CLIP)
    m = np.where(first[:, None, None], np.broadcast_to(start, (2, 2)), trans) + e
    if not best:
        m = np.exp(m)
    after = np.empty_like(m)
    after[:-1] = m[1:]
    last = np.append(first[1:], True)
    after[last] = 0.0 if best else 1.0
    forward = _prefix_rows(m, best)
    backward = _prefix_rows(after[::-1].transpose(0, 2, 1), best)[::-1]
    return m, forward, backward


def marginals(emission: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of label 1 at each step, by forward-backward."""
    if not len(emission):
        return np.zeros(0)
    _, a, b = _passes(emission, first, start, trans, False)
    ab = a * b
    return ab[:, 1] / ab.sum(1)


def viterbi(emission: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Labels of the best path, from max-marginals; equal scores give label 0."""
    if not len(emission):
        return np.zeros(0, np.int8)
    _, a, b = _passes(emission, first, start, trans, True)
    ab = a + b
    return (ab[:, 1] > ab[:, 0] + 1e-9).astype(np.int8)


def fit(features: list[np.ndarray] | np.ndarray, size: int, labels: np.ndarray, first: np.ndarray, steps: int = 60, l2: float = 1e-3):
    """(weights, start, trans) of highest regularised conditional likelihood.

    ``features`` is either a dense matrix (one row per step) or a list of index
    arrays (each step has the sum of the weights at its indices). The optimiser
    is Adam on the whole sample; the likelihood is concave, so the result does
    not hang on a random start.
    """
    dense = isinstance(features, np.ndarray)
    n = max(1, len(labels))
    w, start, trans = np.zeros(size), np.zeros(2), np.zeros((2, 2))
    theta = np.zeros(size + 6)
    mom, var = np.zeros_like(theta), np.zeros_like(theta)
    last = np.append(first[1:], True) if len(first) else first
    y = labels.astype(np.int64)
    inner = np.flatnonzero(~last)
    seen_start = np.bincount(y[first], minlength=2)
    seen_trans = np.bincount(2 * y[inner] + y[inner + 1], minlength=4).reshape(2, 2)
    for k in range(1, steps + 1) if len(labels) else ():
        emission = features @ w if dense else sum(w[f] for f in features)
        m, a, b = _passes(emission, first, start, trans, False)
        ab = a * b
        p = ab[:, 1] / ab.sum(1)
        pair = a[inner, :, None] * m[inner + 1] * b[inner + 1, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        miss = y - p
        g_w = features.T @ miss if dense else sum(np.bincount(f, miss, size) for f in features)
        p0 = np.stack([1 - p[first], p[first]], 1).sum(0)
        g = np.concatenate([g_w, seen_start - p0, (seen_trans - pair.sum(0)).ravel()]) / n - l2 / n * theta
        mom, var = 0.9 * mom + 0.1 * g, 0.99 * var + 0.01 * g * g
        theta = theta + 0.3 * (mom / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.99**k)) + 1e-9)
        w, start, trans = theta[:size], theta[size : size + 2], theta[size + 2 :].reshape(2, 2)
    return w, start, trans


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression (the first column of ``x`` is 1), by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -CLIP, CLIP)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - l2 * w)
    return w
