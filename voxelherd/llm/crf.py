"""A linear-chain conditional random field with two labels, trained in numpy.

A sequence is a list of items, each with features (any hashable names). A label's score is the
sum of its features' weights; transitions have a table for each kind of pair. Training
maximizes the likelihood of labelled sequences with a quadratic penalty, by full gradients
from the forward-backward recursions; decoding is Viterbi.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np

# Steps and size of the gradient steps, strength of the penalty, and how often a feature has
# to occur to get a weight.
STEPS = 120
RATE = 0.15
PENALTY = 0.2
LEAST_SEEN = 3


@dataclass
class Chain:
    """Weights of the label 1 against 0, and transition scores [kind][before][after]."""

    weights: dict[Hashable, float]
    transitions: np.ndarray
    start: np.ndarray
    end: np.ndarray


def marginals(
    unary: np.ndarray, kinds: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of labels (n, t, 2) and of label pairs (n, t - 1, 2, 2), and log Z, of padded sequences."""
    n, t, _ = unary.shape
    forward = np.zeros((n, t, 2))
    backward = np.zeros((n, t, 2))
    forward[:, 0] = unary[:, 0] + start
    moves = transitions[kinds]
    for i in range(1, t):
        reached = forward[:, i - 1, :, None] + moves[:, i - 1]
        forward[:, i] = unary[:, i] + np.logaddexp(reached[:, 0], reached[:, 1])
    last = sizes - 1
    rows = np.arange(n)
    total = np.logaddexp(*(forward[rows, last] + end).T)
    for i in range(t - 1, -1, -1):
        if i + 1 < t:
            ahead = moves[:, i] + (unary[:, i + 1] + backward[:, i + 1])[:, None, :]
            backward[:, i] = np.logaddexp(ahead[:, :, 0], ahead[:, :, 1])
        backward[:, i] = np.where((last == i)[:, None], end, backward[:, i])
    single = np.exp(forward + backward - total[:, None, None])
    pair = forward[:, :-1, :, None] + moves + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
    inside = np.arange(t)[None] < sizes[:, None]
    single *= inside[:, :, None]
    pair = np.exp(np.where(inside[:, 1:, None, None], pair, -np.inf))
    return single, pair, total


def train(
    sequences: Sequence[Sequence[Iterable[Hashable]]], kinds: Sequence[Sequence[int]], labels: Sequence[Sequence[int]],
    steps: int = STEPS,
) -> Chain:
    """Fit a chain; ``kinds`` has the kind (0 or 1) of each pair of neighbours."""
    used = [i for i, s in enumerate(sequences) if s]
    if not used:
        return Chain({}, np.zeros((2, 2, 2)), np.zeros(2), np.zeros(2))
    sequences, kinds, labels = ([x[i] for i in used] for x in (sequences, kinds, labels))
    seen = Counter(f for s in sequences for item in s for f in item)
    names = sorted((f for f, n in seen.items() if n >= LEAST_SEEN), key=str)
    number = {f: i for i, f in enumerate(names)}
    sizes = np.array([len(s) for s in sequences])
    n, t = len(sequences), sizes.max()
    item_of, feature_of = [], []
    for i, s in enumerate(sequences):
        for j, item in enumerate(s):
            own = [number[f] for f in item if f in number]
            feature_of += own
            item_of += [i * t + j] * len(own)
    item_of, feature_of = np.array(item_of, dtype=np.int64), np.array(feature_of, dtype=np.int64)
    kind, truth = np.zeros((n, t - 1), dtype=np.int64), np.zeros((n, t))
    for i in range(n):
        kind[i, : sizes[i] - 1] = kinds[i]
        truth[i, : sizes[i]] = labels[i]
    inside = np.arange(t)[None] < sizes[:, None]
    both = inside[:, 1:] & inside[:, :-1]
    chosen = truth.astype(np.int64)
    # Pairs, starts and ends as they are in the labelled sequences.
    real = np.zeros((2, 2, 2))
    np.add.at(real, (kind[both], chosen[:, :-1][both], chosen[:, 1:][both]), 1)
    real_start = np.bincount(chosen[:, 0], minlength=2)
    real_end = np.bincount(chosen[np.arange(n), sizes - 1], minlength=2)

    w = len(names)
    theta = np.zeros(w + 8 + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        unary = np.zeros((n, t, 2))
        unary[:, :, 1] = np.bincount(item_of, theta[:w][feature_of], n * t).reshape(n, t)
        moves = theta[w : w + 8].reshape(2, 2, 2)
        single, pair, _ = marginals(unary, kind, sizes, moves, theta[w + 8 : w + 10], theta[w + 10 :])
        gap = (single[:, :, 1] - truth * inside).ravel()
        expected = np.zeros((2, 2, 2))
        for k in (0, 1):
            expected[k] = pair[both & (kind == k)].sum(axis=0)
        gradient = np.concatenate([
            np.bincount(feature_of, gap[item_of], w), (expected - real).ravel(),
            single[:, 0].sum(axis=0) - real_start, single[np.arange(n), sizes - 1].sum(axis=0) - real_end,
        ]) + PENALTY * theta
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = dict(zip(names, theta[:w].tolist()))
    return Chain(weights, theta[w : w + 8].reshape(2, 2, 2), theta[w + 8 : w + 10], theta[w + 10 :])


def decode(chain: Chain, scores: Sequence[float], kinds: Sequence[int]) -> list[int]:
    """Best labels for the scores of label 1 of each item; of equal paths, label 0 is preferred late."""
    if not scores:
        return []
    moves = chain.transitions.tolist()
    (off, on), (end_off, end_on) = chain.start.tolist(), chain.end.tolist()
    on += scores[0]
    back = []
    for score, kind in zip(scores[1:], kinds):
        (a, b), (c, d) = moves[kind]
        to_off, to_on = (0, off + a) if off + a >= on + c else (1, on + c), (0, off + b) if off + b >= on + d else (1, on + d)
        back.append((to_off[0], to_on[0]))
        off, on = to_off[1], to_on[1] + score
    label = int(on + end_on > off + end_off)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]
