"""A character-level bidirectional LSTM with a CRF over its outputs, in numpy: training by backpropagation, decoding by Viterbi."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: O, then B and I of each kind.
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
ALPHABET = 130  # padding, ASCII, anything else
FORBIDDEN = -1e4


def codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(raw < 128, raw + 1, 129).astype(np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _barred() -> np.ndarray:
    """Where a tag cannot follow another: I follows B or I of its kind only."""
    n = len(TAGS)
    out = np.zeros((n, n), bool)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            out[:, j] = True
            out[[TAGS.index("B" + t[1:]), j], j] = False
    return out


BARRED = _barred()
BARRED_FIRST = np.array([t[0] == "I" for t in TAGS])


class Tagger:
    def __init__(self, embed: int = 12, hidden: int = 24, seed: int = 5):
        r = np.random.default_rng(seed)
        n = len(TAGS)
        self.hidden = hidden
        self.p = {"e": r.normal(0, 0.3, (ALPHABET, embed)), "wo": r.normal(0, 0.2, (2 * hidden, n)), "bo": np.zeros(n), "a": np.zeros((n, n)), "first": np.zeros(n)}
        for d in "fb":
            self.p |= {f"wx{d}": r.normal(0, 0.3, (embed, 4 * hidden)), f"wh{d}": r.normal(0, 0.3 / np.sqrt(hidden), (hidden, 4 * hidden)), f"c{d}": np.zeros(4 * hidden)}
            self.p[f"c{d}"][hidden:2 * hidden] = 1.0  # forget gates start open

    def _lstm(self, x, d):
        """x: (time, rows, embed), in the order of reading."""
        p, h = self.p, self.hidden
        steps, rows, _ = x.shape
        inner = x @ p[f"wx{d}"] + p[f"c{d}"]
        hs, cs, gates = np.zeros((steps + 1, rows, h)), np.zeros((steps + 1, rows, h)), np.empty((steps, rows, 4 * h))
        for t in range(steps):
            g = inner[t] + hs[t] @ p[f"wh{d}"]
            g[:, :3 * h] = _sigmoid(g[:, :3 * h])
            g[:, 3 * h:] = np.tanh(g[:, 3 * h:])
            gates[t] = g
            cs[t + 1] = g[:, h:2 * h] * cs[t] + g[:, :h] * g[:, 3 * h:]
            hs[t + 1] = g[:, 2 * h:3 * h] * np.tanh(cs[t + 1])
        return hs, cs, gates

    def _back(self, x, d, hs, cs, gates, dout, grad):
        p, h = self.p, self.hidden
        dh, dc = np.zeros_like(hs[0]), np.zeros_like(cs[0])
        dg = np.empty_like(gates)
        for t in range(len(x) - 1, -1, -1):
            g, th = gates[t], np.tanh(cs[t + 1])
            dh = dh + dout[t]
            dc = dc + dh * g[:, 2 * h:3 * h] * (1 - th * th)
            i, f, o, u = g[:, :h], g[:, h:2 * h], g[:, 2 * h:3 * h], g[:, 3 * h:]
            dg[t, :, :h] = dc * u * i * (1 - i)
            dg[t, :, h:2 * h] = dc * cs[t] * f * (1 - f)
            dg[t, :, 2 * h:3 * h] = dh * th * o * (1 - o)
            dg[t, :, 3 * h:] = dc * i * (1 - u * u)
            dh, dc = dg[t] @ p[f"wh{d}"].T, dc * f
        flat = dg.reshape(-1, 4 * h)
        grad[f"wx{d}"] = x.reshape(len(flat), -1).T @ flat
        grad[f"wh{d}"] = hs[:-1].reshape(len(flat), h).T @ flat
        grad[f"c{d}"] = flat.sum(0)
        return dg @ p[f"wx{d}"].T

    def _scores(self, rows):
        x = self.p["e"][rows.T]
        forward, backward = self._lstm(x, "f"), self._lstm(x[::-1], "b")
        both = np.concatenate([forward[0][1:], backward[0][1:][::-1]], axis=2)
        return x, forward, backward, both, both @ self.p["wo"] + self.p["bo"]

    def _rules(self):
        return np.where(BARRED, FORBIDDEN, self.p["a"]), np.where(BARRED_FIRST, FORBIDDEN, self.p["first"])

    def loss_and_gradient(self, rows: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood of the tags (rows, time), and its gradient."""
        x, forward, backward, both, s = self._scores(rows)
        a, first = self._rules()
        steps, n, k = s.shape
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[0] = first + s[0]
        for t in range(1, steps):
            alpha[t] = s[t] + _logsum(alpha[t - 1][:, :, None] + a[None], 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(a[None] + (s[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        own = tags.T
        at = np.arange(n)
        gold = first[own[0]] + sum(s[t, at, own[t]] for t in range(steps)) + sum(a[own[t - 1], own[t]] for t in range(1, steps))
        ds = np.exp(alpha + beta - z[None, :, None])
        grad = {"first": ds[0].sum(0) - np.bincount(own[0], minlength=k)}
        da = np.zeros((k, k))
        for t in range(1, steps):
            da += np.exp(alpha[t - 1][:, :, None] + a[None] + (s[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(da, (own[:-1].ravel(), own[1:].ravel()), 1)
        grad["a"] = np.where(BARRED, 0, da)
        grad["first"] = np.where(BARRED_FIRST, 0, grad["first"])
        ds[np.arange(steps)[:, None], at[None, :], own] -= 1
        grad["wo"], grad["bo"] = both.reshape(-1, both.shape[2]).T @ ds.reshape(-1, k), ds.sum((0, 1))
        dboth, h = ds @ self.p["wo"].T, self.hidden
        dx = self._back(x, "f", *forward, dboth[:, :, :h], grad)
        dx = dx + self._back(x[::-1], "b", *backward, dboth[::-1][:, :, h:], grad)[::-1]
        grad["e"] = np.zeros_like(self.p["e"])
        np.add.at(grad["e"], rows.T, dx)
        return float((z - gold).mean()), {name: g / n for name, g in grad.items()}

    def train(self, rows: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 48, rate: float = 0.01, seed: int = 6) -> Tagger:
        """Adam over random batches; deterministic for its data and seed."""
        r = np.random.default_rng(seed)
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        v2 = {n: np.zeros_like(v) for n, v in self.p.items()}
        for k in range(1, steps + 1):
            pick = r.integers(0, len(rows), min(batch, len(rows)))
            _, grad = self.loss_and_gradient(rows[pick], tags[pick])
            norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
            pace = rate * min(1.0, 2.0 * (1 - (k - 1) / steps))
            for n, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[n] = 0.9 * m[n] + 0.1 * g
                v2[n] = 0.999 * v2[n] + 0.001 * g * g
                self.p[n] = self.p[n] - pace * (m[n] / (1 - 0.9**k)) / (np.sqrt(v2[n] / (1 - 0.999**k)) + 1e-8)
        return self

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        """(rows, time, tags): the scores that the CRF decodes."""
        return np.ascontiguousarray(self._scores(rows)[-1].transpose(1, 0, 2))

    def best(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag sequence of each run of emissions (time, tags)."""
        order = sorted(range(len(runs)), key=lambda k: -len(runs[k]))
        a, first = self._rules()
        size = np.array([len(runs[k]) for k in order])
        steps, n = int(size[0]) if len(order) else 0, len(order)
        s = np.zeros((steps, n, len(TAGS)))
        for i, k in enumerate(order):
            s[:size[i], i] = runs[k]
        alive = np.searchsorted(-size, -np.arange(steps), "left")  # runs that go on at each time; the longest stand first
        score, back = first + s[0] if steps else first, np.zeros(s.shape, np.int8)
        for t in range(1, steps):
            m = alive[t]
            step = score[:m, :, None] + a[None]
            back[t, :m] = step.argmax(1)
            score[:m] = step.max(1) + s[t, :m]
        out: list = [None] * n
        at, tags = score.argmax(1) if steps else None, np.zeros((steps, n), np.int8)
        for t in range(steps - 1, -1, -1):
            m = alive[t]
            tags[t, :m] = at[:m]
            at[:m] = back[t][np.arange(m), at[:m]]
        for i, k in enumerate(order):
            out[k] = tags[:size[i], i]
        return out

    def stream(self, chunks):
        """The tags of one long run of emissions, in pieces, as soon as all surviving paths agree on them."""
        a, first = self._rules()
        score, back, every = None, [], np.arange(len(TAGS))
        for chunk in chunks:
            for row in chunk:
                if score is None:
                    score = first + row
                    back.append(every)
                    continue
                step = score[:, None] + a
                lead = step.argmax(0)
                score = step[lead, every] + row
                back.append(lead)
            paths = np.empty((len(back), len(TAGS)), np.int8)
            at = every
            for t in range(len(back) - 1, -1, -1):
                paths[t] = at
                at = back[t][at]
            agreed = np.flatnonzero((paths == paths[:, :1]).all(1))
            if len(agreed):  # from the last place on which all agree, there is one path back
                n = int(agreed[-1])
                yield paths[:n, 0]
                back = back[n:]
        if score is not None:
            yield paths[len(paths) - len(back):, int(score.argmax())]

    def tag(self, rows: np.ndarray) -> np.ndarray:
        """The best tag sequence of each row."""
        s = self._scores(rows)[-1]
        a, first = self._rules()
        best, back = first + s[0], np.zeros(s.shape, np.int8)
        for t in range(1, len(s)):
            step = best[:, :, None] + a[None]
            back[t] = step.argmax(1)
            best = step.max(1) + s[t]
        out = np.empty(rows.shape, np.int8)
        out[:, -1] = best.argmax(1)
        at = np.arange(len(rows))
        for t in range(len(s) - 1, 0, -1):
            out[:, t - 1] = back[t][at, out[:, t]]
        return out
