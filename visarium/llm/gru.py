"""A bidirectional gated recurrent network over bytes, in numpy: forward pass, backpropagation through time, Adam.

Arrays are units x batch, so that each gate is a contiguous block. Codes are bytes, or EDGE before a text's first byte
and behind its last.
"""

from __future__ import annotations

import numpy as np

CODES, EDGE = 257, 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(s: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(s - s.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


class BiGRU:
    """Labels every byte: class probabilities from the states of both directions at that byte."""

    def __init__(self, classes: int, units: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(units)
        draw = lambda *shape, s=scale: rng.normal(0, s, shape).astype(np.float32)
        self.units = units
        # Of each direction: input weights by code and recurrent weights, each of the gates z, r and the candidate; the output's.
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("w", draw(3 * units, CODES, s=0.3)), ("u", draw(3 * units, units)))}
        self.p |= {"o": draw(classes, 2 * units), "bias": np.zeros(classes, np.float32)}

    def _states(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of one direction, time x units x batch, and what the way back needs."""
        n, w, u = self.units, self.p[f"w{d}"], self.p[f"u{d}"]
        h = np.zeros((n, x.shape[1]), w.dtype)
        out, kept = np.empty((len(x), n, x.shape[1]), w.dtype), []
        for t in range(len(x)):
            a, g = w[:, x[t]], u @ h
            zr = _sigmoid(a[: 2 * n] + g[: 2 * n])
            z, r, q = zr[:n], zr[n:], g[2 * n :]
            c = np.tanh(a[2 * n :] + r * q)
            kept.append((h, z, r, q, c))
            h = c + z * (h - c)
            out[t] = h
        return out, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of every code (time x classes x batch) of whole sequences (time x batch)."""
        hf, hb = self._states(x, "f")[0], self._states(x[::-1], "b")[0][::-1]
        return _softmax(self.p["o"] @ np.concatenate([hf, hb], 1) + self.p["bias"][:, None], 1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes (not edges), and its gradients; y: the class of each sequence."""
        n, rows = self.units, np.arange(x.shape[1])
        hf, kf = self._states(x, "f")
        hb, kb = self._states(x[::-1], "b")
        both = np.concatenate([hf, hb[::-1]], 1)
        q = _softmax(self.p["o"] @ both + self.p["bias"][:, None], 1)
        weight = (x != EDGE) / max(int((x != EDGE).sum()), 1)
        loss = float((-np.log(q[:, y, rows] + 1e-9) * weight).sum())
        q[:, y, rows] -= 1
        q *= weight[:, None]
        grad = {"o": np.einsum("tcb,tib->ci", q, both, optimize=True), "bias": q.sum((0, 2))}
        back = self.p["o"].T @ q
        for d, kept, dh, xs in (("f", kf, back[:, :n], x), ("b", kb, back[::-1, n:], x[::-1])):
            u = self.p[f"u{d}"]
            gu, carry = np.zeros_like(u), np.zeros((n, x.shape[1]), u.dtype)
            da = np.empty((len(xs), 3 * n, x.shape[1]), u.dtype)
            for t in range(len(xs) - 1, -1, -1):
                h, z, r, hq, c = kept[t]
                dt = dh[t] + carry
                dc = dt * (1 - z) * (1 - c * c)
                da[t, :n] = dt * (h - c) * z * (1 - z)
                da[t, n : 2 * n] = dc * hq * r * (1 - r)
                da[t, 2 * n :] = dc
                dg = da[t].copy()
                dg[2 * n :] *= r
                gu += dg @ h.T
                carry = dt * z + u.T @ dg
            # The input weights' gradients: sums by code.
            code = xs.ravel()
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            gw = np.zeros_like(self.p[f"w{d}"])
            gw[:, code[order][first]] = np.add.reduceat(da.transpose(1, 0, 2).reshape(3 * n, -1)[:, order], first, axis=1)
            grad |= {f"w{d}": gw, f"u{d}": gu}
        return loss, grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 128, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over random batches of windows (sequence x time) in which all classes weigh the same. Returns the last losses' mean."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(y == k) for k in np.unique(y)]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        losses = []
        for t in range(1, steps + 1):
            pick = np.concatenate([g[rng.integers(0, len(g), -(-batch // len(groups)))] for g in groups])
            loss, grad = self.gradients(np.ascontiguousarray(x[pick].T), y[pick])
            losses.append(loss)
            now = rate * (1 - 0.95 * t / steps)
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:])) if losses else 0.0

    def sums(self, codes: np.ndarray, lens: np.ndarray, warm: int) -> np.ndarray:
        """Sums of class probabilities over each chunk's bytes (chunks x classes).

        codes (warm + longest chunk + warm, chunks): a chunk's bytes from position warm on, and what stands around them; lens
        falls. A direction reads the bytes around before the chunk's own, so its state runs on from there.
        """
        n, longest, many = self.units, int(lens[0]), len(lens)
        classes, dtype = len(self.p["bias"]), np.float32
        half = np.where(np.arange(3 * n) < 2 * n, 0.5, 1).astype(dtype)[:, None]  # sigmoid(x) = tanh(x / 2) / 2 + 1/2
        alive = np.searchsorted(-lens, -np.arange(longest), "left")  # chunks that have a byte at this place
        part = np.empty((longest, classes, many), dtype)
        total = np.zeros((classes, many), dtype)
        a, g, c = np.empty((3 * n, many), dtype), np.empty((3 * n, many), dtype), np.empty((n, many), dtype)

        def step(h: np.ndarray, w: np.ndarray, u: np.ndarray, x: np.ndarray, m: int) -> None:
            am, gm, cm, h = a[:, :m], g[:, :m], c[:, :m], h[:, :m]
            np.take(w, x[:m], axis=1, out=am, mode="clip")
            np.matmul(u, h, out=gm)
            zr = am[: 2 * n]
            zr += gm[: 2 * n]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(am[n : 2 * n], gm[2 * n :], out=cm)
            cm += am[2 * n :]
            np.tanh(cm, out=cm)
            h -= cm
            h *= am[:n]
            h += cm

        for d in "fb":
            w, u = np.ascontiguousarray(self.p[f"w{d}"] * half), np.ascontiguousarray(self.p[f"u{d}"] * half)
            o = np.ascontiguousarray(self.p["o"][:, :n] if d == "f" else self.p["o"][:, n:])
            h = np.zeros((n, many), dtype)
            if d == "f":
                for t in range(-warm, longest):
                    m = many if t < 0 else int(alive[t])
                    step(h, w, u, codes[warm + t], m)
                    if t >= 0:
                        np.matmul(o, h[:, :m], out=part[t][:, :m])
                continue
            for t in range(longest + warm - 1, -1, -1):
                m = int(alive[max(t - warm, 0)])
                step(h, w, u, codes[warm + t], m)
                if t < longest:
                    k = int(alive[t])
                    s = o @ h[:, :k]
                    s += part[t][:, :k]
                    s += self.p["bias"][:, None]
                    s -= s.max(0)
                    np.exp(s, out=s)
                    s /= s.sum(0)
                    total[:, :k] += s
        return total.T
