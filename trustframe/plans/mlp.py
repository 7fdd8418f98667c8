"""Numpy helper for the neural local learner: one small network, trained on the rows of one Spark group.

The network is two ReLU layers with dropout and one output logit; a state is a flat vector, layer by layer, weights
before offsets. Spark partitions, shuffles and merges; these functions only see one group's arrays.
"""

import numpy as np

DROPOUT = 0.1
# Moment decay and stability constants of the Adam method.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def layer_shapes(n_features: int, hidden: tuple[int, int]) -> list[tuple[int, int]]:
    first, second = hidden
    return [(n_features, first), (first, second), (second, 1)]


def state_size(n_features: int, hidden: tuple[int, int]) -> int:
    return sum((rows + 1) * columns for rows, columns in layer_shapes(n_features, hidden))


def initial_state(n_features: int, hidden: tuple[int, int], seed: int) -> np.ndarray:
    """Uniform in +-1/sqrt(inputs), for weights and offsets."""
    rng = np.random.default_rng(seed)
    parts = []
    for rows, columns in layer_shapes(n_features, hidden):
        parts.append(rng.uniform(-1.0, 1.0, (rows + 1) * columns) / np.sqrt(rows))
    return np.concatenate(parts)


def _unpack(state: np.ndarray, n_features: int, hidden: tuple[int, int]):
    layers, at = [], 0
    for rows, columns in layer_shapes(n_features, hidden):
        weights = state[at : at + rows * columns].reshape(rows, columns)
        at += rows * columns
        layers.append((weights, state[at : at + columns]))
        at += columns
    return layers


def logits(state: np.ndarray, x: np.ndarray, hidden: tuple[int, int]) -> np.ndarray:
    (w1, b1), (w2, b2), (w3, b3) = _unpack(state, x.shape[1], hidden)
    return (np.maximum(np.maximum(x @ w1 + b1, 0) @ w2 + b2, 0) @ w3 + b3)[:, 0]


def mean_loss(state: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: tuple[int, int]) -> float:
    z = logits(state, x, hidden)
    return float(np.mean(np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))))


def gradient(state, x, y, hidden, rng=None, dropout=DROPOUT) -> np.ndarray:
    """Gradient of the mean loss; with ``rng``, hidden units are dropped at random and the rest scaled up."""
    (w1, b1), (w2, b2), (w3, b3) = _unpack(state, x.shape[1], hidden)
    keep1 = keep2 = 1.0
    a1 = x @ w1 + b1
    if rng is not None:
        keep1 = (rng.random(a1.shape) >= dropout) / (1.0 - dropout)
    h1 = np.maximum(a1, 0) * keep1
    a2 = h1 @ w2 + b2
    if rng is not None:
        keep2 = (rng.random(a2.shape) >= dropout) / (1.0 - dropout)
    h2 = np.maximum(a2, 0) * keep2
    z = (h2 @ w3 + b3)[:, 0]
    d3 = ((1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - y) / len(y))[:, None]
    d2 = (d3 @ w3.T) * keep2 * (a2 > 0)
    d1 = (d2 @ w2.T) * keep1 * (a1 > 0)
    return np.concatenate(
        [(x.T @ d1).ravel(), d1.sum(0), (h1.T @ d2).ravel(), d2.sum(0), (h2.T @ d3).ravel(), d3.sum(0)]
    )


def train(state, x, y, hidden, epochs, batch_size, lr, weight_decay, seed) -> np.ndarray:
    """Shuffled mini-batches with a fresh optimizer."""
    rng = np.random.default_rng(seed)
    state = state.copy()
    mean, square, step = np.zeros_like(state), np.zeros_like(state), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch_size):
            rows = order[at : at + batch_size]
            slope = gradient(state, x[rows], y[rows], hidden, rng) + weight_decay * state
            step += 1
            mean = BETA1 * mean + (1 - BETA1) * slope
            square = BETA2 * square + (1 - BETA2) * slope * slope
            state -= lr * (mean / (1 - BETA1**step)) / (np.sqrt(square / (1 - BETA2**step)) + EPSILON)
    return state
