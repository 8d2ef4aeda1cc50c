"""Two small networks in numpy: a bidirectional LSTM with CRF transitions, and a character CNN."""

from __future__ import annotations

import numpy as np

PAD = 0
#: Characters with an id of their own; the rest share one for each class.
ALPHABET = "".join(map(chr, range(0x20, 0x7F))) + "\n\t"
OTHER_LETTER, OTHER = len(ALPHABET) + 1, len(ALPHABET) + 2
SYMBOLS = len(ALPHABET) + 3
_IDS = {c: i for i, c in enumerate(ALPHABET, 1)}


def char_ids(text: str) -> np.ndarray:
    return np.array([_IDS.get(c) or (OTHER_LETTER if c.isalpha() else OTHER) for c in text], np.int64)


def batch_ids(texts: list[str], size: int) -> np.ndarray:
    out = np.zeros((len(texts), size), np.int64)
    for i, t in enumerate(texts):
        t = t[:size]
        out[i, : len(t)] = char_ids(t)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, clip / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            a, b = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.p[k] -= (self.rate * a / (np.sqrt(b) + 1e-8)).astype(self.p[k].dtype)


class LstmCrf:
    """Tags of characters. ``params`` is plain arrays, so a trained model is small and portable.

    Both directions run side by side: index 0 reads forwards, 1 backwards. Gates
    are input, forget and output, then the candidate.
    """

    def __init__(self, tags: int, embed: int = 12, hidden: int = 20, seed: int = 7, params: dict | None = None) -> None:
        r = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden
        small = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = params or {"e": small(SYMBOLS, embed) * 3, "x": small(2, embed, 4 * hidden), "h": small(2, hidden, 4 * hidden), "b": np.zeros((2, 1, 4 * hidden), np.float32), "o": small(2 * hidden, tags), "c": np.zeros(tags, np.float32), "t": np.zeros((tags, tags), np.float32)}
        if params is None:
            self.p["b"][:, :, hidden : 2 * hidden] = 1
        self.scale = np.r_[np.full(3 * hidden, 0.5), np.ones(hidden)].astype(np.float32)

    def _run(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hidden states (steps, 2, n, hidden), each direction in its own order, and what the gradient needs of every step."""
        p, k = self.p, self.hidden
        n, steps = ids.shape
        one = p["e"][ids.T]  # steps, n, embed
        x = np.stack([one, one[::-1]])
        a = (np.matmul(x.reshape(2, steps * n, -1), p["x"]) + p["b"]).reshape(2, steps, n, 4 * k).transpose(1, 0, 2, 3) * self.scale
        w = p["h"] * self.scale
        gates = np.empty((steps, 2, n, 4 * k), a.dtype)
        cells, hs = np.zeros((steps + 1, 2, n, k), a.dtype), np.zeros((steps + 1, 2, n, k), a.dtype)
        for s in range(steps):
            g = np.tanh(a[s] + np.matmul(hs[s], w), out=gates[s])
            g[:, :, : 3 * k] *= 0.5
            g[:, :, : 3 * k] += 0.5
            c = cells[s + 1]
            np.multiply(g[:, :, k : 2 * k], cells[s], out=c)
            c += g[:, :, :k] * g[:, :, 3 * k :]
            np.multiply(g[:, :, 2 * k : 3 * k], np.tanh(c), out=hs[s + 1])
        return x, gates, cells, hs

    def _joined(self, hs: np.ndarray) -> np.ndarray:
        return np.concatenate([hs[1:, 0], hs[:0:-1, 1]], 2)  # steps, n, 2 hidden

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return (self._joined(self._run(ids)[3]) @ self.p["o"] + self.p["c"]).transpose(1, 0, 2)

    def _forward_backward(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward and backward sums of (steps, n, tags), exponentials of the emissions, and log of the normaliser."""
        t = np.exp(self.p["t"])
        top = em.max(2, keepdims=True)
        e = np.exp(em - top)
        alpha, beta = np.empty_like(e), np.empty_like(e)
        scale = np.empty(e.shape[:2], e.dtype)
        now = e[0]
        for s in range(len(e)):
            if s:
                now = (now @ t) * e[s]
            scale[s] = now.sum(1)
            now = now / scale[s][:, None]
            alpha[s] = now
        beta[-1] = 1
        back = np.ascontiguousarray(t.T)
        for s in range(len(e) - 2, -1, -1):
            beta[s] = ((e[s + 1] * beta[s + 1]) @ back) / scale[s + 1][:, None]
        return alpha, beta, e / scale[:, :, None], np.log(scale.astype(np.float64)).sum(0) + top[:, :, 0].sum(0)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window, and the marginal probability of each of them."""
        em = np.ascontiguousarray(self.emissions(ids).transpose(1, 0, 2)).astype(np.float64)
        t = self.p["t"].astype(np.float64)
        steps, n, _ = em.shape
        score, back = em[0], np.empty(em.shape, np.int8)
        for s in range(1, steps):
            every = score[:, :, None] + t
            back[s] = every.argmax(1)
            score = every.max(1) + em[s]
        best = np.empty((steps, n), np.int64)
        best[-1] = score.argmax(1)
        rows = np.arange(n)
        for s in range(steps - 1, 0, -1):
            best[s - 1] = back[s, rows, best[s]]
        alpha, beta, _, _ = self._forward_backward(em)
        sure = np.take_along_axis(alpha * beta, best[:, :, None], 2)[:, :, 0]
        return best.T, np.minimum(sure.T, 1.0)

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.01, seed: int = 7) -> None:
        adam, r = Adam(self.p, rate), np.random.default_rng(seed)
        for epoch in range(epochs):
            adam.rate = rate * (1 - epoch / epochs) + 1e-4
            order = r.permutation(len(ids))
            for at in range(0, len(ids), batch):
                pick = order[at : at + batch]
                adam.step(self._gradient(ids[pick], tags[pick]))

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> float:
        """Mean negative log-likelihood of the tags."""
        em = self.emissions(ids).transpose(1, 0, 2)
        z = self._forward_backward(em)[3]
        path = np.take_along_axis(em, tags.T[:, :, None], 2).sum((0, 2)) + self.p["t"][tags[:, :-1], tags[:, 1:]].sum(1)
        return float((z - path).mean())

    def _gradient(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        p, n, steps, k = self.p, *ids.shape, self.hidden
        x, gates, cells, hs = self._run(ids)
        h = self._joined(hs)
        em = h @ p["o"] + p["c"]
        alpha, beta, e, _ = self._forward_backward(em)
        d = alpha * beta
        now, rows = tags.T, np.arange(n)[None]
        pair = np.exp(p["t"]) * (alpha[:-1].reshape(-1, self.tags).T @ (e[1:] * beta[1:]).reshape(-1, self.tags))
        np.subtract.at(pair, (now[:-1], now[1:]), 1)
        d[np.arange(steps)[:, None], rows, now] -= 1
        d /= n
        dh = d @ p["o"].T
        both = np.stack([dh[:, :, :k], dh[::-1, :, k:]], 1)  # steps, 2, n, hidden
        c = np.tanh(cells[1:])
        i, f, o, u = (gates[..., j * k : (j + 1) * k] for j in range(4))
        into = o * (1 - c * c)  # from a state to its cell
        parts = np.stack([u * i * (1 - i), cells[:-1] * f * (1 - f), c * o * (1 - o), i * (1 - u * u)], 3)
        da = np.empty_like(parts)
        back = np.ascontiguousarray(p["h"].transpose(0, 2, 1))
        gh, gc = np.zeros_like(cells[0]), np.zeros_like(cells[0])
        held = np.empty_like(parts[0])
        for s in range(steps - 1, -1, -1):
            gh += both[s]
            gc += gh * into[s]
            held[:] = gc[:, :, None]
            held[:, :, 2] = gh
            np.multiply(parts[s], held, out=da[s])
            gh = np.matmul(da[s].reshape(2, n, 4 * k), back)
            gc *= f[s]
        flat = da.transpose(1, 0, 2, 3, 4).reshape(2, steps * n, 4 * k)
        dx = np.matmul(flat, p["x"].transpose(0, 2, 1)).reshape(2, steps, n, -1)
        de = np.zeros_like(p["e"])
        np.add.at(de, ids.T, dx[0] + dx[1, ::-1])
        before = hs[:-1].transpose(1, 0, 2, 3).reshape(2, steps * n, k)
        return {"e": de, "x": np.matmul(x.reshape(2, steps * n, -1).transpose(0, 2, 1), flat), "h": np.matmul(before.transpose(0, 2, 1), flat), "b": flat.sum(1, keepdims=True), "o": h.reshape(-1, 2 * k).T @ d.reshape(-1, self.tags), "c": d.sum((0, 1)), "t": (pair / n).astype(p["t"].dtype)}


class CharCnn:
    """One probability for a window of characters: convolution, maximum over time, one hidden layer."""

    def __init__(self, size: int, embed: int = 12, width: int = 5, filters: int = 32, hidden: int = 24, marks: int = 2, seed: int = 7, params: dict | None = None) -> None:
        r = np.random.default_rng(seed)
        self.size, self.width = size, width
        small = lambda *s: (r.standard_normal(s) * np.sqrt(1.5 / s[0])).astype(np.float32)
        self.p = params or {"e": small(SYMBOLS, embed) * 3, "k": small(width * (embed + marks), filters), "kb": np.zeros(filters, np.float32), "w": small(2 * filters, hidden), "wb": np.zeros(hidden, np.float32), "o": small(hidden, 1), "ob": np.zeros(1, np.float32)}

    def _columns(self, ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.p["e"][ids], mark], 2)
        steps = x.shape[1] - self.width + 1
        return np.concatenate([x[:, j : j + steps] for j in range(self.width)], 2)

    def _run(self, ids: np.ndarray, mark: np.ndarray) -> tuple:
        cols = self._columns(ids, mark)
        a = np.maximum(cols @ self.p["k"] + self.p["kb"], 0)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None, :], 1)[:, 0], a.mean(1)], 1)
        h = np.maximum(pooled @ self.p["w"] + self.p["wb"], 0)
        return cols, a, top, pooled, h, (h @ self.p["o"] + self.p["ob"])[:, 0]

    def logits(self, ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
        parts = [self._run(ids[i : i + 256], mark[i : i + 256])[-1] for i in range(0, len(ids), 256)]
        return np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)

    def train(self, ids: np.ndarray, mark: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.004, seed: int = 7) -> None:
        adam, r = Adam(self.p, rate), np.random.default_rng(seed)
        for epoch in range(epochs):
            adam.rate = rate * (1 - epoch / epochs) + 1e-5
            order = r.permutation(len(ids))
            for at in range(0, len(ids), batch):
                pick = order[at : at + batch]
                adam.step(self._gradient(ids[pick], mark[pick], y[pick]))

    def _gradient(self, ids: np.ndarray, mark: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        cols, a, top, pooled, h, logit = self._run(ids, mark)
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)[:, None]
        dh = (d @ p["o"].T) * (h > 0)
        dpool = dh @ p["w"].T
        f, steps = a.shape[2], a.shape[1]
        da = np.repeat(dpool[:, None, f:] / steps, steps, 1)
        rows = np.arange(len(ids))[:, None]
        da[rows, top, np.arange(f)[None, :]] += dpool[:, :f]
        da *= a > 0
        dcols = da @ p["k"].T
        dx = np.zeros((len(ids), ids.shape[1], p["e"].shape[1] + mark.shape[2]), np.float32)
        e = dx.shape[2]
        for j in range(self.width):
            dx[:, j : j + steps] += dcols[:, :, j * e : (j + 1) * e]
        de = np.zeros_like(p["e"])
        np.add.at(de, ids, dx[:, :, : p["e"].shape[1]])
        return {"e": de, "k": np.einsum("nsc,nsf->cf", cols, da), "kb": da.sum((0, 1)), "w": pooled.T @ dh, "wb": dh.sum(0), "o": h.T @ d, "ob": d.sum(0)}
