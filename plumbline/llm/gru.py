"""A bidirectional gated recurrent network over bytes, in numpy.

Arrays are (features, sequences), one step at a time over the sequence, so that
a step is one small matrix product and a few passes over contiguous memory.
Gates use the clipped-linear sigmoid and candidates tanh. Every position gets a
class distribution from both directions' states.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 8


def init(classes: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    model = {}
    for d in "fb":
        model[f"E{d}"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        model[f"E{d}"][: 2 * hidden] += 0.5  # gates start half open
        model[f"U{d}"] = (rng.normal(0, 1, (3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32) * 0.5
        model[f"V{d}"] = rng.normal(0, 0.3, (classes, hidden)).astype(np.float32)
    model["c"] = np.zeros((classes, 1), np.float32)
    return model


def _run(E: np.ndarray, U: np.ndarray, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, hidden, B) of one direction; ``keep`` collects what backpropagation needs."""
    hidden = U.shape[1]
    T, B = steps.shape
    states = np.empty((T, hidden, B), np.float32)
    h = np.zeros((hidden, B), np.float32)
    g, x = np.empty((3 * hidden, B), np.float32), np.empty((3 * hidden, B), np.float32)
    for t in range(T):
        np.take(E, steps[t], axis=1, out=x, mode="clip")
        np.matmul(U, h, out=g)
        gates = g[: 2 * hidden]
        gates += x[: 2 * hidden]
        np.minimum(gates, 1, out=gates)
        np.maximum(gates, 0, out=gates)
        z, r = gates[:hidden], gates[hidden:]
        n = g[2 * hidden :]
        if keep is not None:
            keep.append([h, gates.copy(), n.copy()])
        n *= r
        n += x[2 * hidden :]
        np.tanh(n, out=n)
        if keep is not None:
            keep[-1].append(n.copy())
        out = states[t]
        np.subtract(h, n, out=out)
        out *= z
        out += n
        h = out
    return states


def probabilities(model: dict[str, np.ndarray], steps: np.ndarray) -> np.ndarray:
    """Class distribution (T, classes, B) of every position of ``steps`` (T, B), bytes."""
    forward = _run(model["Ef"], model["Uf"], steps)
    backward = _run(model["Eb"], model["Ub"], steps[::-1])[::-1]
    logits = np.matmul(model["Vf"], forward)
    logits += np.matmul(model["Vb"], backward)
    logits += model["c"]
    np.exp(np.minimum(logits, 40, out=logits), out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _backward(E, U, steps, kept, d_states, grads, d):
    """Backpropagation through time of one direction; adds to ``grads``."""
    hidden = U.shape[1]
    T, B = steps.shape
    dh = np.zeros((hidden, B), np.float32)
    for t in range(T - 1, -1, -1):
        h, gates, un, n = kept[t]
        z, r = gates[:hidden], gates[hidden:]
        dh = dh + d_states[t]
        dz, dn = dh * (h - n), dh * (1 - z) * (1 - n * n)
        open_ = (gates > 0) & (gates < 1)
        dg = np.concatenate([dz, dn * un]) * open_
        da = np.concatenate([dg, dn])  # of the inputs
        du = np.concatenate([dg, dn * r])  # of the products with the state
        grads[f"U{d}"] += du @ h.T
        np.add.at(grads[f"E{d}"].T, steps[t], da.T)
        dh = dh * z + U.T @ du


def train(windows: np.ndarray, labels: np.ndarray, classes: int, epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit on byte windows (N, T) with one class each, by Adam on the mean position loss."""
    model = init(classes, seed=seed)
    if not len(windows):
        return model
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step, total = 0, epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            steps = np.ascontiguousarray(windows[rows].T)
            T, B = steps.shape
            kept_f, kept_b = [], []
            forward = _run(model["Ef"], model["Uf"], steps, kept_f)
            backward = _run(model["Eb"], model["Ub"], steps[::-1], kept_b)[::-1]
            logits = np.matmul(model["Vf"], forward) + np.matmul(model["Vb"], backward) + model["c"]
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[:, labels[rows], np.arange(B)] -= 1
            p /= T * B
            grads = {k: np.zeros_like(v) for k, v in model.items()}
            grads["Vf"] = np.einsum("tcb,thb->ch", p, forward, optimize=True)
            grads["Vb"] = np.einsum("tcb,thb->ch", p, backward, optimize=True)
            grads["c"] = p.sum(axis=(0, 2))[:, None]
            _backward(model["Ef"], model["Uf"], steps, kept_f, np.matmul(model["Vf"].T, p), grads, "f")
            _backward(model["Eb"], model["Ub"], steps[::-1], kept_b, np.matmul(model["Vb"].T, p)[::-1], grads, "b")
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            pace = rate * min(1.0, 2 * (1 - step / (total + 1)))
            for k, g in grads.items():
                g *= min(1.0, 1.0 / (norm + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                model[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model
