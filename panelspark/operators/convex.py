"""A small convex solver for books: quadratic cost, trading cost, linear bands, bounds, one norm limit.

    minimise   sum q_i w_i + sum d_i w_i^2 + |F w|^2 + c |w - centre|_1
    subject to low <= A w <= high, lower <= w <= upper, |B w| <= radius

By splitting (ADMM, as in OSQP and SCS): w solves a linear system that is factored once per penalty; each block of the split has a
closed projection. The answer is the block that keeps the bounds exactly.

Where no w keeps the limits, the multipliers drift along a line that proves it (Farkas); each check tries their last steps as such a proof, so an infeasible problem ends
early, and no feasible one can.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Problem:
    q: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    a: np.ndarray
    low: np.ndarray
    high: np.ndarray
    d: np.ndarray | None = None
    f: np.ndarray | None = None
    cost: float = 0.0
    centre: np.ndarray | None = None
    b: np.ndarray | None = None
    radius: float = np.inf


@dataclass
class Answer:
    w: np.ndarray
    feasible: bool
    gap: float
    rounds: int


def solve(p: Problem, rounds: int = 4000, tol: float = 1e-7, feasible: float = 2e-5) -> Answer:
    n = len(p.q)
    if n == 0:
        ok = bool(np.all(p.low <= 1e-9) and np.all(p.high >= -1e-9))
        return Answer(np.zeros(0), ok, 0.0 if ok else np.inf, 0)
    centre = np.zeros(n) if p.centre is None else p.centre
    norm = np.sqrt((p.a**2).sum(1))
    norm[norm == 0] = 1.0
    a, low, high = p.a / norm[:, None], p.low / norm, p.high / norm
    b = None
    if p.b is not None and np.isfinite(p.radius):
        scale = max(1e-12, float(np.linalg.norm(p.b, 2)))
        b, radius = p.b / scale, p.radius / scale
    unit = max(1e-9, float(np.abs(p.q).max()))  # objective in units of its largest slope
    quad = np.zeros((n, n))
    if p.f is not None:
        quad += 2 * p.f.T @ p.f
    if p.d is not None:
        quad[np.diag_indices(n)] += 2 * p.d
    quad, q, cost = quad / unit, p.q / unit, p.cost / unit
    blocks = a.T @ a + np.eye(n) + (b.T @ b if b is not None else 0)
    rho = max(1.0, float(np.trace(quad)) / n) * 10.0
    inverse = np.linalg.inv(quad + rho * blocks)
    w = np.clip(centre, p.lower, p.upper)
    za, zw = np.clip(a @ w, low, high), w.copy()
    zb = b @ w if b is not None else None
    ua, uw = np.zeros(len(a)), np.zeros(n)
    ub = np.zeros(len(b)) if b is not None else None
    drift = [np.zeros(len(a)), np.zeros(0) if b is None else np.zeros(len(b))]

    def hopeless() -> bool:
        """Whether the multipliers' steps since the last check tell limits (loosened by ``feasible``) and bounds apart: then no w within the bounds keeps the limits."""
        ya, yb = ua - drift[0], ub - drift[1] if b is not None else drift[1]
        drift[:] = ua.copy(), ub.copy() if b is not None else yb
        up = ya > 0
        most = float((np.where(up, high + feasible, low - feasible)[ya != 0] * ya[ya != 0]).sum())
        slope = a.T @ ya
        if b is not None:
            slope, most = slope + b.T @ yb, most + (radius + feasible) * float(np.linalg.norm(yb))
        least = float(np.where(slope > 0, slope * p.lower, slope * p.upper).sum())
        return least > most + 1e-12 * (1 + abs(most)) and bool(np.isfinite(least))

    k = 0
    for k in range(1, rounds + 1):
        rhs = -q + rho * (a.T @ (za - ua) + zw - uw)
        if b is not None:
            rhs += rho * (b.T @ (zb - ub))
        w = inverse @ rhs
        aw = a @ w
        ra, rw = 1.6 * aw - 0.6 * za, 1.6 * w - 0.6 * zw
        before = zw
        za = np.clip(ra + ua, low, high)
        ua += ra - za
        v = rw + uw
        step = v - centre
        zw = np.clip(centre + np.sign(step) * np.maximum(np.abs(step) - cost / rho, 0), p.lower, p.upper)
        uw += rw - zw
        if b is not None:
            rb = 1.6 * (b @ w) - 0.6 * zb
            v = rb + ub
            size = float(np.sqrt(v @ v))
            zb = v if size <= radius else v * (radius / size)
            ub += rb - zb
        if k % 25 == 0:
            primal = max(float(np.abs(aw - za).max(initial=0)), float(np.abs(w - zw).max()), float(np.abs(b @ w - zb).max()) if b is not None else 0.0)
            dual = rho * float(np.abs(zw - before).max())
            if primal < tol and dual < tol * 100:
                break
            if hopeless():
                break
            if k % 200 == 0 and k < rounds * 3 // 4:
                ratio = np.sqrt((primal / max(1e-9, np.abs(w).max())) / max(1e-12, dual))
                if ratio > 5 or ratio < 0.2:
                    change = float(np.clip(ratio, 0.1, 10.0))
                    rho *= change
                    ua, uw = ua / change, uw / change
                    ub = ub / change if b is not None else None
                    inverse = np.linalg.inv(quad + rho * blocks)
    gap = max(float(np.maximum(low - a @ zw, a @ zw - high).max(initial=0)), (float(np.sqrt(((b @ zw) ** 2).sum())) - radius) if b is not None else 0.0)
    return Answer(zw, bool(np.isfinite(zw).all() and gap <= feasible), gap, k)
