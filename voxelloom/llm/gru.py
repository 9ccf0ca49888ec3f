"""A small bidirectional gated recurrent network with attention pooling, forward and backward in numpy.

A token's input is the sum of an embedding of the word (row 0, of zeros, if the word is not in the vocabulary) and the
mean embedding of its character trigrams (hashed). Two recurrent layers read a window in both directions; attention weighs their states into one vector.
"""

from __future__ import annotations

import numpy as np
import xxhash

GRAM_ROWS, WIDTH, HIDDEN, KEYS = 4096, 12, 8, 8

Params = dict[str, np.ndarray]


def start(rng: np.random.Generator, vocabulary: int) -> Params:
    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    out = {"words": draw(vocabulary + 1, WIDTH, scale=0.1), "grams": draw(GRAM_ROWS, WIDTH, scale=0.1),
           "keys": draw(2 * HIDDEN, KEYS, scale=0.3), "query": draw(KEYS, scale=0.3),
           "out": draw(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
    out["words"][0] = 0
    for side in ("f", "b"):
        out |= {f"w{side}": draw(WIDTH, 3 * HIDDEN, scale=0.3), f"c{side}": np.zeros(3 * HIDDEN, np.float32),
                f"u{side}": draw(HIDDEN, 3 * HIDDEN, scale=0.3)}
    return out


def trigrams(word: str) -> list[int]:
    """Rows of the word's character trigrams, with marks for both ends."""
    marked = f"<{word}>".encode("utf-8", "replace")
    return [xxhash.xxh32_intdigest(marked[i:i + 3]) % GRAM_ROWS for i in range(max(1, len(marked) - 2))]


def inputs(p: Params, rows: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Input vectors of tokens: word rows, and their trigram rows with the token each belongs to."""
    total = np.zeros((len(rows), WIDTH), np.float32)
    np.add.at(total, owner, p["grams"][grams])
    return p["words"][rows] + total / np.bincount(owner, minlength=len(rows))[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def layer(at, length: int, n: int, mask: np.ndarray, u: np.ndarray, order: range, keep: bool):
    """States (n, length, H); ``at(t)`` gives the projected inputs of step t, already with their bias."""
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.zeros((n, length, HIDDEN), np.float32)
    cache = []
    for t in order:
        x, g = at(t), h @ u
        gates = _sigmoid(x[:, :2 * HIDDEN] + g[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
        new = c + z * (h - c)
        if keep:
            cache.append((t, h, z, r, c, g[:, 2 * HIDDEN:]))
        h = np.where(mask[:, t, None], new, h)
        states[:, t] = h
    return states, cache


def pool(p: Params, states: np.ndarray, mask: np.ndarray):
    """Attention over the states of a window: logit, and what the backward pass needs."""
    k = np.tanh(states @ p["keys"])
    a = np.where(mask, k @ p["query"], -1e9)
    a = np.exp(a - a.max(axis=1, keepdims=True)) * mask
    a = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-9)
    pooled = np.einsum("nt,nth->nh", a, states)
    return pooled @ p["out"] + p["bias"][0], k, a, pooled


def forward(p: Params, ids: np.ndarray, mask: np.ndarray, table: dict[str, np.ndarray]) -> np.ndarray:
    """Logit of every window; ``table`` holds the projected inputs of all tokens for both directions."""
    n, length = ids.shape
    f, _ = layer(lambda t: table["f"][ids[:, t]], length, n, mask, p["uf"], range(length), False)
    b, _ = layer(lambda t: table["b"][ids[:, t]], length, n, mask, p["ub"], range(length - 1, -1, -1), False)
    return pool(p, np.concatenate([f, b], axis=2), mask)[0]


def project(p: Params, x: np.ndarray) -> dict[str, np.ndarray]:
    return {s: x @ p[f"w{s}"] + p[f"c{s}"] for s in ("f", "b")}


def _back_layer(u: np.ndarray, cache, d_states: np.ndarray, mask: np.ndarray):
    n, length, _ = d_states.shape
    dx = np.zeros((n, length, 3 * HIDDEN), np.float32)
    du, carry = np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
    for t, h, z, r, c, q in reversed(cache):
        d = d_states[:, t] + carry
        live = mask[:, t, None]
        new = d * live
        dc = new * (1 - z) * (1 - c * c)
        dz = new * (h - c) * z * (1 - z)
        dr = dc * q * r * (1 - r)
        dx[:, t] = np.concatenate([dz, dr, dc], axis=1)
        dg = np.concatenate([dz, dr, dc * r], axis=1)
        du += h.T @ dg
        carry = d * ~live + new * z + dg @ u.T
    return dx, du


def gradients(p: Params, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Loss, gradients of the recurrent and attention parameters, and of the tokens' input vectors ``x``."""
    n, length = ids.shape
    table = project(p, x)
    f, cache_f = layer(lambda t: table["f"][ids[:, t]], length, n, mask, p["uf"], range(length), True)
    b, cache_b = layer(lambda t: table["b"][ids[:, t]], length, n, mask, p["ub"], range(length - 1, -1, -1), True)
    states = np.concatenate([f, b], axis=2)
    logit, k, a, pooled = pool(p, states, mask)
    prob = _sigmoid(logit)
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / weight.sum())
    d = (weight * (prob - y) / weight.sum()).astype(np.float32)
    grads = {"bias": np.array([d.sum()], np.float32), "out": pooled.T @ d}
    d_pooled = d[:, None] * p["out"]
    d_a = np.einsum("nh,nth->nt", d_pooled, states)
    d_score = a * (d_a - (a * d_a).sum(axis=1, keepdims=True))
    d_states = a[:, :, None] * d_pooled[:, None, :]
    grads["query"] = np.einsum("nt,ntk->k", d_score, k)
    d_k = d_score[:, :, None] * p["query"] * (1 - k * k)
    grads["keys"] = np.einsum("nth,ntk->hk", states, d_k)
    d_states = d_states + d_k @ p["keys"].T
    d_x = np.zeros_like(x)
    for side, cache, part in (("f", cache_f, d_states[:, :, :HIDDEN]), ("b", cache_b, d_states[:, :, HIDDEN:])):
        dx, grads[f"u{side}"] = _back_layer(p[f"u{side}"], cache, part, mask)
        per_token = np.zeros((len(x), 3 * HIDDEN), np.float32)
        np.add.at(per_token, ids[mask], dx[mask])
        grads[f"w{side}"], grads[f"c{side}"] = x.T @ per_token, per_token.sum(axis=0)
        d_x += per_token @ p[f"w{side}"].T
    return loss, grads, d_x


class Adam:
    def __init__(self, p: Params, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grads: dict[str, np.ndarray], rows: dict[str, np.ndarray], decay: float = 1e-4) -> None:
        """``rows`` names, for the embedding tables, the rows that the gradients belong to; others stay as they are."""
        self.t += 1
        for k, g in grads.items():
            at = rows.get(k, slice(None))
            if k in rows:
                g = g + decay * self.p[k][at]
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            v = self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.p[k][at] -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)


def gathered(rows: np.ndarray, grads: np.ndarray, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows with the sums of their gradients."""
    distinct, place = np.unique(rows, return_inverse=True)
    total = np.zeros((len(distinct), grads.shape[1]), np.float32)
    np.add.at(total, place, grads)
    keep = distinct != skip if skip is not None else np.ones(len(distinct), bool)
    return distinct[keep], total[keep]
