"""A bidirectional gated recurrent network over bytes, trained in numpy.

Both directions run as one batched matrix product per step.  Training is plain
backpropagation through time with Adam on a cross-entropy at every position.
"""

from __future__ import annotations

import numpy as np

PAD = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


class BiGRU:
    """Embedding of bytes, two directions of a GRU, a dense layer per position."""

    NAMES = ("emb", "wx", "bx", "wh", "bn", "wo", "bo")

    def __init__(self, classes: int, hidden: int = 32, embed: int = 24, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        f = np.float32
        self.h, self.k = hidden, classes
        self.emb = rng.normal(0, 0.3, (PAD + 1, embed)).astype(f)
        self.wx = rng.normal(0, 1 / np.sqrt(embed), (2, embed, 3 * hidden)).astype(f)
        self.bx = np.zeros((2, 1, 3 * hidden), f)
        self.wh = np.stack([np.concatenate([np.linalg.qr(rng.normal(size=(hidden, hidden)))[0] for _ in range(3)], axis=1) for _ in range(2)]).astype(f)
        self.bn = np.zeros((2, 1, hidden), f)
        self.wo = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, classes)).astype(f)
        self.bo = np.zeros(classes, f)
        self.adam = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in self.NAMES}
        self.steps = 0

    def _states(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
        """x: (T, B) byte codes.  States (T, 2, B, H), the second direction reversed in time.

        Padding leaves no trace: states are zero there, so results do not depend on what
        a text is batched with.  With ``keep`` also the gates z, r, the recurrent part q
        and the candidate n.
        """
        t, b = x.shape
        h = self.h
        # the input's share of the gates depends on the byte alone: a table of 257 rows
        gates = np.matmul(self.emb[None], self.wx) + self.bx
        both = np.stack([x, x[::-1]], axis=1)  # (T, 2, B)
        out = np.zeros((t, 2, b, h), self.wh.dtype)
        kept = tuple(np.empty_like(out) for _ in range(4)) if keep else ()
        s = np.zeros((2, b, h), self.wh.dtype)
        gx = np.empty((2, b, 3 * h), self.wh.dtype)
        live = (both != PAD)[..., None]
        padded = ~live.all(axis=(1, 2, 3))
        for i in range(t):
            np.take(gates[0], both[i, 0], axis=0, out=gx[0])
            np.take(gates[1], both[i, 1], axis=0, out=gx[1])
            gh = np.matmul(s, self.wh)
            zr = _sigmoid(gx[..., : 2 * h] + gh[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            q = gh[..., 2 * h :] + self.bn
            n = np.tanh(gx[..., 2 * h :] + r * q)
            if keep:
                for array, value in zip(kept, (z, r, q, n)):
                    array[i] = value
            s = n + z * (s - n)
            if padded[i]:
                s *= live[i]
            out[i] = s
        return out, kept

    def _run(self, x: np.ndarray) -> np.ndarray:
        """The states of ``_states`` without what only training needs, in reused buffers.

        Signs of both gates are turned beforehand, so a sigmoid is exp, + 1 and reciprocal.
        """
        t, b = x.shape
        h = self.h
        gates = np.matmul(self.emb[None], self.wx) + self.bx
        to_zr, to_n = -gates[..., : 2 * h].reshape(-1, 2 * h), np.ascontiguousarray(gates[..., 2 * h :]).reshape(-1, h)
        w_zr, w_n = np.ascontiguousarray(-self.wh[..., : 2 * h]), np.ascontiguousarray(self.wh[..., 2 * h :])
        both = np.stack([x, x[::-1] + (PAD + 1)], axis=1).astype(np.intp)  # rows of the two tables
        live = x != PAD
        holes = ~live.all(axis=1)
        holes = holes | holes[::-1]
        live = np.stack([live, live[::-1]], axis=1)[..., None]
        out = np.zeros((t + 1, 2, b, h), self.wh.dtype)
        zr, g = (np.empty((2, b, 2 * h), self.wh.dtype) for _ in range(2))
        n, q = (np.empty((2, b, h), self.wh.dtype) for _ in range(2))
        with np.errstate(over="ignore"):
            for i in range(t):
                s, new = out[i], out[i + 1]
                np.matmul(s, w_zr, out=zr)
                zr += to_zr.take(both[i], axis=0, out=g, mode="clip")
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                np.matmul(s, w_n, out=q)
                q += self.bn
                q *= zr[..., h:]
                q += to_n.take(both[i], axis=0, out=n, mode="clip")
                np.tanh(q, out=n)
                np.subtract(s, n, out=new)
                new *= zr[..., :h]
                new += n
                if holes[i]:
                    new *= live[i]
        return out[1:]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(T, B) byte codes to (T, B, classes)."""
        s = self._run(x)
        return s[:, 0] @ self.wo[: self.h] + s[::-1, 1] @ self.wo[self.h :] + self.bo

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One Adam step; positions with y < 0 do not count.  Returns the mean loss."""
        t, b = x.shape
        h = self.h
        s, saved = self._states(x, True)
        full = np.concatenate([s[:, 0], s[::-1, 1]], axis=-1)
        lg = full @ self.wo + self.bo
        lg -= lg.max(axis=-1, keepdims=True)
        p = np.exp(lg)
        p /= p.sum(axis=-1, keepdims=True)
        on = y >= 0
        n_on = max(1, int(on.sum()))
        yy = np.where(on, y, 0)
        ti, bi = np.indices(y.shape)
        loss = float(-(np.log(p[ti, bi, yy] + 1e-9) * on).sum() / n_on)
        p[ti, bi, yy] -= 1
        d = (p * (on[..., None] / n_on)).astype(full.dtype)
        g = {"wo": full.reshape(-1, 2 * h).T @ d.reshape(-1, self.k), "bo": d.sum(axis=(0, 1))}
        df = d @ self.wo.T
        ds = np.stack([df[..., :h], df[::-1, :, h:]], axis=1)  # (T, 2, B, H) in run order
        z, r, q, n = saved
        live = (np.stack([x, x[::-1]], axis=1) != PAD)[..., None]
        padded = ~live.all(axis=(1, 2, 3))
        before = np.concatenate([np.zeros_like(s[:1]), s[:-1]])
        # factors of the chain rule that do not depend on later steps, all steps at once
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), q * r * (1 - r)
        d_rec = np.empty((t, 2, b, 3 * h), s.dtype)  # gradients at the recurrent gates
        dn = np.empty_like(s)
        carry = np.zeros((2, b, h), s.dtype)
        back = np.ascontiguousarray(self.wh.transpose(0, 2, 1))
        for i in range(t - 1, -1, -1):
            dh = ds[i] + carry
            if padded[i]:
                dh *= live[i]
            d = d_rec[i]
            np.multiply(dh, to_n[i], out=dn[i])
            np.multiply(dh, to_z[i], out=d[..., :h])
            np.multiply(dn[i], to_r[i], out=d[..., h : 2 * h])
            np.multiply(dn[i], r[i], out=d[..., 2 * h :])
            carry = dh * z[i] + np.matmul(d, back)
        flat = lambda v: v.transpose(1, 0, 2, 3).reshape(2, t * b, -1)
        g["wh"] = np.matmul(flat(before).transpose(0, 2, 1), flat(d_rec))
        g["bn"] = d_rec[..., 2 * h :].sum(axis=(0, 2))[:, None, :]
        d_in = d_rec  # at the input gates only the candidate's part differs
        d_in[..., 2 * h :] = dn
        g["bx"] = d_in.sum(axis=(0, 2))[:, None, :]
        # gradients of the byte table: sums of the gate gradients by byte
        table = np.zeros((2, PAD + 1, 3 * h), s.dtype)
        for k, codes in enumerate((x, x[::-1])):
            code, gk = codes.reshape(-1), d_in[:, k].reshape(-1, 3 * h)
            order = np.argsort(code, kind="stable")
            at = np.flatnonzero(np.diff(code[order], prepend=-1))
            table[k, code[order][at]] = np.add.reduceat(gk[order], at, axis=0)
        g["wx"] = np.matmul(self.emb.T[None], table)
        g["emb"] = (table @ self.wx.transpose(0, 2, 1)).sum(axis=0)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        self.steps += 1
        for name, grad in g.items():
            m, v = self.adam[name]
            grad = grad * scale
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            w = getattr(self, name)
            w -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-7)
        return loss

    def frozen(self) -> dict:
        """What inference needs, for sending to executors."""
        return {n: getattr(self, n) for n in self.NAMES} | {"h": self.h, "k": self.k}

    @classmethod
    def thaw(cls, data: dict) -> BiGRU:
        new = cls.__new__(cls)
        new.__dict__.update(data)
        return new
