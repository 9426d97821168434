"""A bidirectional LSTM over characters with CRF transitions, in numpy: forward, gradients, training and decoding."""

from __future__ import annotations

import numpy as np

LENGTH, STRIDE = 64, 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    def __init__(self, chars: int, tags: int, width: int = 20, hidden: int = 40, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p = {"E": (r.standard_normal((chars, width)) * 0.3).astype(np.float32), "W": g(2 * hidden, tags), "c": np.zeros(tags, np.float32), "A": np.zeros((tags, tags), np.float32), "S": np.zeros(tags, np.float32)}
        for d in "fb":
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1
            self.p |= {"x" + d: g(width, 4 * hidden), "h" + d: g(hidden, 4 * hidden), "b" + d: b}

    def _lstm(self, x: np.ndarray, d: str, keep: bool):  # noqa: ANN202
        """x: steps, batch, width in reading order of the direction."""
        n, batch, _ = x.shape
        hd = self.hidden
        z0 = (x.reshape(n * batch, -1) @ self.p["x" + d]).reshape(n, batch, -1) + self.p["b" + d]
        h, c = np.zeros((batch, hd), np.float32), np.zeros((batch, hd), np.float32)
        out = np.empty((n, batch, hd), np.float32)
        tape = []
        for t in range(n):
            z = z0[t] + h @ self.p["h" + d]
            s = _sigmoid(z[:, : 3 * hd])
            i, f, o, u = s[:, :hd], s[:, hd : 2 * hd], s[:, 2 * hd :], np.tanh(z[:, 3 * hd :])
            before = c
            c = f * c + i * u
            tc = np.tanh(c)
            if keep:
                tape.append((h, before, i, f, o, u, tc))
            h = o * tc
            out[t] = h
        return out, tape

    def emissions(self, ids: np.ndarray, keep: bool = False):  # noqa: ANN201
        """Tag scores, steps x batch x tags, of windows of character ids (batch x steps)."""
        x = self.p["E"][ids.T]
        f, tf = self._lstm(x, "f", keep)
        b, tb = self._lstm(x[::-1], "b", keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        e = h @ self.p["W"] + self.p["c"]
        return (e, (x, h, tf, tb)) if keep else e

    def _lstm_back(self, x: np.ndarray, d: str, tape: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        n, batch, _ = x.shape
        hd = self.hidden
        dz = np.empty((n, batch, 4 * hd), np.float32)
        dh, dc = np.zeros((batch, hd), np.float32), np.zeros((batch, hd), np.float32)
        wh = self.p["h" + d]
        gh = np.zeros_like(wh)
        for t in range(n - 1, -1, -1):
            h, before, i, f, o, u, tc = tape[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            z = dz[t]
            z[:, :hd] = dc * u * i * (1 - i)
            z[:, hd : 2 * hd] = dc * before * f * (1 - f)
            z[:, 2 * hd : 3 * hd] = dh * tc * o * (1 - o)
            z[:, 3 * hd :] = dc * i * (1 - u * u)
            gh += h.T @ z
            dh = z @ wh.T
            dc = dc * f
        flat = dz.reshape(n * batch, -1)
        grad["h" + d], grad["b" + d], grad["x" + d] = gh, flat.sum(0), x.reshape(n * batch, -1).T @ flat
        return (flat @ self.p["x" + d].T).reshape(x.shape)

    def loss(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of the tags per window, and its gradients."""
        e, (x, h, tf, tb) = self.emissions(ids, True)
        n, batch, k = e.shape
        a, s, yt = self.p["A"], self.p["S"], y.T
        rows = np.arange(batch)
        alpha = np.empty_like(e)
        alpha[0] = s + e[0]
        for t in range(1, n):
            m = alpha[t - 1][:, :, None] + a
            top = m.max(1)
            alpha[t] = top + np.log(np.exp(m - top[:, None]).sum(1)) + e[t]
        top = alpha[-1].max(1)
        logz = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        beta = np.zeros((batch, k), np.float32)
        de = np.empty_like(e)
        da = np.zeros_like(a)
        de[-1] = np.exp(alpha[-1] - logz[:, None])
        for t in range(n - 2, -1, -1):
            m = a + (e[t + 1] + beta)[:, None, :]
            da += np.exp(alpha[t][:, :, None] + m - logz[:, None, None]).sum(0)
            top = m.max(2)
            beta = top + np.log(np.exp(m - top[:, :, None]).sum(2))
            de[t] = np.exp(alpha[t] + beta - logz[:, None])
        gold = s[yt[0]] + e[0, rows, yt[0]]
        for t in range(n):
            if t:
                gold = gold + a[yt[t - 1], yt[t]] + e[t, rows, yt[t]]
                np.add.at(da, (yt[t - 1], yt[t]), -1)
            de[t, rows, yt[t]] -= 1
        grad = {"A": da / batch, "S": de[0].sum(0) / batch}
        de /= batch
        flat = de.reshape(n * batch, k)
        grad["W"], grad["c"] = h.reshape(n * batch, -1).T @ flat, flat.sum(0)
        dh = (flat @ self.p["W"].T).reshape(h.shape)
        dx = self._lstm_back(x, "f", tf, dh[:, :, : self.hidden], grad) + self._lstm_back(x[::-1], "b", tb, dh[::-1, :, self.hidden :], grad)[::-1]
        grad["E"] = np.zeros_like(self.p["E"])
        np.add.at(grad["E"], ids.T.ravel(), dx.reshape(n * batch, -1))
        return float((logz - gold).mean()), grad

    def fit(self, ids: np.ndarray, y: np.ndarray, epochs: int, batch: int = 96, rate: float = 6e-3, seed: int = 5) -> list[float]:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses, step, total = [], 0, epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order, sum_ = r.permutation(len(ids)), 0.0
            for lo in range(0, len(ids), batch):
                at = order[lo : lo + batch]
                loss, grad = self.loss(ids[at], y[at])
                sum_ += loss * len(at)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                shrink, lr = min(1.0, 5.0 / (size + 1e-9)), rate * (1 - 0.95 * step / total)
                for k, g in grad.items():
                    g = g * shrink
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            losses.append(sum_ / len(ids))
        return losses

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """emissions without a tape: what a character gives a gate is looked up, and one tanh is taken a step."""
        n, hd = ids.shape[1], self.hidden
        half = np.ones(4 * hd, np.float32)
        half[: 3 * hd] = 0.5  # a sigmoid is half a tanh of half, and a half
        e = self.p["c"].astype(np.float32)
        for d in "fb":
            given, wh = (self.p["E"] @ self.p["x" + d] + self.p["b" + d]) * half, self.p["h" + d] * half
            h, c = np.zeros((len(ids), hd), np.float32), np.zeros((len(ids), hd), np.float32)
            out = np.empty((n, len(ids), hd), np.float32)
            z, more = np.empty((len(ids), 4 * hd), np.float32), np.empty((len(ids), 4 * hd), np.float32)
            for t in range(n) if d == "f" else range(n - 1, -1, -1):
                np.take(given, ids[:, t], axis=0, out=z, mode="clip")
                z += np.matmul(h, wh, out=more)
                np.tanh(z, out=z)
                s = z[:, : 3 * hd]
                s *= 0.5
                s += 0.5
                c *= s[:, hd : 2 * hd]
                c += s[:, :hd] * z[:, 3 * hd :]
                h = np.multiply(s[:, 2 * hd :], np.tanh(c), out=out[t])
            e = e + out @ (self.p["W"][:hd] if d == "f" else self.p["W"][hd:])
        return e

    def decode(self, texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Best tags of each text of character ids, and how sure the averaged scores are of each.

        Texts are read in windows of LENGTH that overlap by LENGTH - STRIDE; where windows overlap their scores are
        averaged, weighing a character by its distance from the window's end, and one best path is taken over the whole text.
        """
        of = []
        for k, x in enumerate(texts):
            starts = [0] if len(x) <= LENGTH else sorted({*range(0, len(x) - LENGTH, STRIDE), len(x) - LENGTH})
            of += [(k, s) for s in starts]
        weight = np.minimum(np.arange(LENGTH) + 1, LENGTH - np.arange(LENGTH)).astype(np.float32)
        sums = [np.zeros((len(x), self.tags), np.float32) for x in texts]
        norm = [np.zeros(len(x), np.float32) for x in texts]
        for lo in range(0, len(of), 512):
            part = of[lo : lo + 512]
            windows = np.zeros((len(part), LENGTH), np.int64)
            for b, (k, s) in enumerate(part):
                w = texts[k][s : s + LENGTH]
                windows[b, : len(w)] = w
            e = np.ascontiguousarray((self.scores(windows) * weight[:, None, None]).transpose(1, 0, 2))
            for b, (k, s) in enumerate(part):
                n = min(LENGTH, len(texts[k]) - s)
                sums[k][s : s + n] += e[b, :n]
                norm[k][s : s + n] += weight[:n]
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0))] * len(texts)
        order = sorted((k for k in range(len(texts)) if len(texts[k])), key=lambda k: len(texts[k]))
        a = self.p["A"]
        for lo in range(0, len(order), 256):
            part = order[lo : lo + 256]
            lens = np.array([len(texts[k]) for k in part])
            longest, rows = int(lens[-1]), np.arange(len(part))
            e = np.zeros((longest, len(part), self.tags), np.float32)
            for b, k in enumerate(part):
                e[: lens[b], b] = sums[k] / norm[k][:, None]
            score, step = np.empty_like(e), np.empty((self.tags, len(part), self.tags), np.float32)
            score[0] = self.p["S"] + e[0]
            for t in range(1, longest):
                live = int(np.searchsorted(lens, t, "right"))  # the texts of more than t characters
                np.add(score[t - 1, live:].T[:, :, None], a[:, None, :], out=step[:, live:])
                np.add(step[:, live:].max(0), e[t, live:], out=score[t, live:])
            path, tag = np.zeros((longest, len(part)), int), np.zeros(len(part), int)
            for t in range(longest - 1, -1, -1):
                live = np.searchsorted(lens, t, "right")
                last = lens == t + 1
                if t + 1 < longest:
                    tag[live:] = (score[t, live:] + a[:, tag[live:]].T).argmax(1)
                tag[last] = score[t, last].argmax(1)
                path[t, live:] = tag[live:]
            odds = np.exp(e - e.max(2, keepdims=True))
            odds = odds[np.arange(longest)[:, None], rows, path] / odds.sum(2)
            for b, k in enumerate(part):
                out[k] = path[: lens[b], b].copy(), odds[: lens[b], b].copy()
        return out
