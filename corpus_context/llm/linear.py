"""Sparse rows as (row, column, value) arrays, and the two linear fits made on them."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Sparse:
    """n x d matrix in coordinate form."""

    def __init__(self, rows, cols, values, n: int, d: int):
        self.rows, self.cols, self.values, self.n, self.d = rows, cols, values, n, d

    def dot(self, w):
        return np.bincount(self.rows, self.values * w[self.cols], self.n)

    def t_dot(self, g):
        return np.bincount(self.cols, self.values * g[self.rows], self.d)

    def norm2(self, weight) -> float:
        """Largest eigenvalue of X' diag(weight) X, by power iteration from a positive start."""
        v, top = np.ones(self.d), 1.0
        for _ in range(20):
            v = self.t_dot(weight * self.dot(v))
            top = float(np.linalg.norm(v))
            if top == 0:
                return 1.0
            v /= top
        return top


def accelerated(gradient, prox, x, step: float, rounds: int):
    """Proximal gradient steps with momentum that restarts when it points uphill."""
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        g = gradient(y)
        new = prox(y - step * g, step)
        if np.dot(y - new, new - x) > 0:
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        if np.abs(new - x).max(initial=0) < 1e-6:
            return new
        x, t = new, t2
    return x


def fit_ordinal(x: Sparse, grade, weight, k: int, l1: float, rounds: int):
    """Cumulative-link (proportional odds) fit: P(grade > j) = sigmoid(x w - cut_j), one weight vector
    for all cuts, cuts in order. Returns (w, cuts). ``weight`` sums to 1."""
    prior = np.array([weight[grade > j].sum() for j in range(k - 1)]).clip(1e-4, 1 - 1e-4)
    cuts = -np.log(prior / (1 - prior))
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    start = np.concatenate([np.zeros(x.d), cuts[:1], gaps])
    everything = np.arange(x.n)

    def split(p):
        return p[: x.d], np.cumsum(np.r_[p[x.d], np.exp(np.minimum(p[x.d + 1 :], 5))])

    def gradient(p):
        w, cut = split(p)
        above = sigmoid(x.dot(w)[:, None] - np.r_[-1e9, cut, 1e9][None, :])  # P(grade >= j), from 1 down to 0
        chance = np.maximum(above[everything, grade] - above[everything, grade + 1], 1e-12)
        slope = above * (1 - above)
        g_eta = -weight * (slope[everything, grade] - slope[everything, grade + 1]) / chance
        g_cut = np.zeros(k + 1)
        np.add.at(g_cut, grade, weight * slope[everything, grade] / chance)
        np.add.at(g_cut, grade + 1, -weight * slope[everything, grade + 1] / chance)
        inner = g_cut[1:k]
        tail = np.cumsum(inner[::-1])[::-1]  # a gap moves every later cut
        return np.concatenate([x.t_dot(g_eta), tail[:1], tail[1:] * np.exp(np.minimum(p[x.d + 1 :], 5))])

    def prox(p, step):
        out = p.copy()
        out[: x.d] = np.sign(p[: x.d]) * np.maximum(np.abs(p[: x.d]) - step * l1, 0)
        return out

    step = 1 / (0.5 * (x.norm2(weight) + k))
    return split(accelerated(gradient, prox, start, step, rounds))


def fit_logistic(x: Sparse, target, weight, l2: float, rounds: int):
    """Logistic fit to soft targets in [0, 1]. Returns (w, bias). ``weight`` sums to 1."""

    def gradient(p):
        g = weight * (sigmoid(x.dot(p[:-1]) + p[-1]) - target)
        return np.r_[x.t_dot(g) + l2 * p[:-1], g.sum()]

    p = accelerated(gradient, lambda p, _: p, np.zeros(x.d + 1), 1 / (0.25 * (x.norm2(weight) + 1) + l2), rounds)
    return p[:-1], p[-1]
