"""Plain single-series loops the Spark operators are compared with."""

import numpy as np


def quantile(scores, alpha):
    n = len(scores)
    return 0.0 if n == 0 else float(np.quantile(scores, min(1.0, np.ceil((n + 1) * (1.0 - alpha)) / n)))


def wasserstein(a, b):
    values = np.sort(np.concatenate([a, b]))
    f = np.searchsorted(np.sort(a), values[:-1], side="right") / len(a)
    g = np.searchsorted(np.sort(b), values[:-1], side="right") / len(b)
    return float(np.sum(np.abs(f - g) * np.diff(values)))


def detector(scores, reference, window, reference_length):
    ref = np.asarray(reference)[-reference_length:]
    out = []
    for t in range(len(scores)):
        buffer = scores[max(0, t + 1 - window): t + 1]
        ready = len(buffer) >= max(24, window // 4)
        out.append(wasserstein(buffer, ref) / max(np.std(ref), 1e-6) if ready else None)
    return out


def rolling(cal, y, p, alpha, window, block):
    fifo = list(cal[-window:])
    bounds = []
    for s in range(0, len(y), block):
        q = quantile(fifo, alpha)
        bounds += [(max(0.0, v - q), v + q) for v in p[s: s + block]]
        fifo = (fifo + list(np.abs(y[s: s + block] - p[s: s + block])))[-window:]
    return np.array(bounds)


def aci(cal, y, p, alpha, gamma, block, low=0.01, high=0.5):
    a, bounds, alphas = alpha, [], []
    for s in range(0, len(y), block):
        q = quantile(cal, a)
        yy, pp = y[s: s + block], p[s: s + block]
        lo, hi = np.maximum(0.0, pp - q), pp + q
        bounds += list(zip(lo, hi, strict=True))
        alphas += [a] * len(yy)
        a = float(np.clip(a + gamma * (alpha - (1 - np.mean((yy >= lo) & (yy <= hi)))), low, high))
    return np.array(bounds), np.array(alphas)


def shift_aware(cal, y, p, shifts, alpha, slow, fast, eta, threshold, block, enabled=True, low=0.01, high=0.5):
    a, bounds, alphas, gammas = alpha, [], [], []
    for s in range(0, len(y), block):
        q = quantile(cal, a)
        for t in range(s, min(s + block, len(y))):
            lo, hi = max(0.0, p[t] - q), p[t] + q
            miss = 0.0 if lo <= y[t] <= hi else 1.0
            delta = shifts[t] if enabled and shifts[t] is not None else 0.0
            flag = enabled and shifts[t] is not None and delta >= threshold
            gamma = fast if flag else slow
            bounds.append((lo, hi))
            alphas.append(a)
            gammas.append(gamma)
            a = float(np.clip(a + gamma * (alpha - miss) - (eta * delta * miss if flag else 0.0), low, high))
    return np.array(bounds), np.array(alphas), np.array(gammas)
