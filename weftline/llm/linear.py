"""Hashed text features and small linear models in NumPy, fitted on bounded samples."""

from __future__ import annotations

import re

import numpy as np

NOT_LETTERS = re.compile(rb"[^a-z\x80-\xff]+")


def gram_counts(data: bytes, size: int) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams; linear in the text, of fixed size."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(size, np.int64)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - (size.bit_length() - 1))
    return np.bincount((two * np.uint32(0x2545F491)) >> shift, minlength=size) + np.bincount(((three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift, minlength=size)


def letter_grams(text: str, size: int) -> np.ndarray:
    """Square roots of the counts of hashed letter n-grams, of length 1."""
    v = np.sqrt(gram_counts(b" " + NOT_LETTERS.sub(b" ", text.lower().encode("utf-8", "replace")).strip() + b" ", size)).astype(np.float32)
    norm = float(np.linalg.norm(v))
    return v / norm if norm else v


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 200) -> np.ndarray:
    """Weights (the last one the shift) of a linear support vector machine with squared hinge loss, by accelerated gradient descent. y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * c
    w = np.zeros(x.shape[1], np.float32)
    z, t, rate = w.copy(), 1.0, 1.0 / (1.0 + 2 * c * 2.0)
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ z))
        new = z - rate * (z * 0.01 - 2 * (x.T @ (share * y * gap)))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + np.float32((before - 1) / t) * (new - w), new
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights (the last one the shift) of a ridge logistic regression by accelerated gradient descent. y is 1 or 0."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    s = np.ones(len(y), np.float32) if weight is None else weight.astype(np.float32)
    s = s / max(float(s.sum()), 1e-9)
    rate = 1.0 / (0.25 * float((s[:, None] * x * x).sum()) + ridge)
    w = np.zeros(x.shape[1], np.float32)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        new = z - np.float32(rate) * (x.T @ (s * (sigmoid(x @ z) - y)) + np.float32(ridge) * z)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + np.float32((before - 1) / t) * (new - w), new
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of y (1 or 0) on scores, with smoothed targets; Newton's method."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = float(np.std(scores)) or 1.0
    x = np.stack([scores / scale, np.ones(len(scores))], 1).astype(np.float64)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-3 * w)
        w = w - np.clip(step, -2, 2)
    return float(max(w[0], 0.0) / scale), float(w[1])
