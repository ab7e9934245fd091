"""Gated recurrent layers in numpy, forward and by backpropagation through time, and the Adam rule."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tanh(x: np.ndarray) -> np.ndarray:
    return 2 * sigmoid(2 * x) - 1


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def forward(inputs: np.ndarray, mask: np.ndarray, weights: np.ndarray, reverse: bool, keep: bool = False):
    """States ``[time, sequence, hidden]`` of one direction.

    ``inputs`` are the projected inputs ``[time, sequence, 3 * hidden]`` (update, reset, new); where
    ``mask`` is 0 the state stays. ``keep`` also returns what :func:`backward` needs.
    """
    steps, n, wide = inputs.shape
    hidden = wide // 3
    h = np.zeros((n, hidden), np.float32)
    states = np.empty((steps, n, hidden), np.float32)
    tape = []
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        inner = h @ weights
        gates = sigmoid(inputs[t, :, : 2 * hidden] + inner[:, : 2 * hidden])
        z, r = gates[:, :hidden], gates[:, hidden:]
        own = inner[:, 2 * hidden :]
        new = tanh(inputs[t, :, 2 * hidden :] + r * own)
        m = mask[t][:, None]
        if keep:
            tape.append((t, h, z, r, own, new, m))
        h = h + m * (1 - z) * (new - h)
        states[t] = h
    return (states, tape) if keep else states


def backward(tape: list, grads: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of projected inputs and of ``weights`` from those of the states."""
    hidden = grads.shape[2]
    d_inputs = np.zeros((*grads.shape[:2], 3 * hidden), np.float32)
    d_weights = np.zeros_like(weights)
    dh = np.zeros(grads.shape[1:], np.float32)
    for t, h, z, r, own, new, m in reversed(tape):
        dh = dh + grads[t]
        d_new = dh * m * (1 - z) * (1 - new * new)
        d_z = dh * m * (h - new) * z * (1 - z)
        d_r = d_new * own * r * (1 - r)
        d_inner = np.concatenate([d_z, d_r, d_new * r], axis=1)
        d_inputs[t] = np.concatenate([d_z, d_r, d_new], axis=1)
        d_weights += h.T @ d_inner
        dh = dh * (1 - m * (1 - z)) + d_inner @ weights.T
    return d_inputs, d_weights


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.step = params, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            self.params[k] -= (scale * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)).astype(np.float32)


def random(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
