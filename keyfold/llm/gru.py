"""A gated recurrent language model in numpy.

Word ids are ordered by class, so that class c is the id range bounds[c]:bounds[c + 1]; the
output is P(class | state) * P(word | class, state).  Training backpropagates within windows
and carries the state on; scoring carries the state through the whole document.
"""

from __future__ import annotations

import heapq

import numpy as np

Params = dict[str, np.ndarray]


def classes(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): ids by falling count, cut into about n classes of equal summed square-root count."""
    order = np.argsort(-counts, kind="stable")
    share = np.cumsum(np.sqrt(counts[order] + 1.0))
    cut = np.searchsorted(share, share[-1] * np.arange(1, n) / n)
    return order, np.unique(np.concatenate([[0], cut, [len(counts)]]))


def start(counts: np.ndarray, bounds: np.ndarray, width: int, hidden: int, seed: int = 3) -> Params:
    """Small random weights; output biases at the logs of the counts, so the model begins as a unigram."""
    g = np.random.default_rng(seed)
    k, c = len(counts), len(bounds) - 1
    unit = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    mass = np.add.reduceat(counts + 1.0, bounds[:-1])
    return {
        "E": (0.3 * g.standard_normal((k, width))).astype(np.float32), "Wx": unit(width, 3 * hidden), "Wh": unit(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
        "Wc": 0.1 * unit(hidden, c), "bc": np.log(mass / mass.sum()).astype(np.float32),
        "Wo": 0.1 * unit(hidden, k), "bo": np.log(counts + 1.0).astype(np.float32),
    }


class Room(dict):
    """Arrays by name that one window after another writes over, so that their memory is asked for once."""

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        if name not in self or self[name].size < n:
            self[name] = np.empty(n, np.float32)
        return self[name][:n].reshape(shape)


def _below(a: np.ndarray, row) -> np.ndarray:
    """a with a last row, such as the biases below the weights."""
    return np.concatenate([a, np.broadcast_to(row, (1, a.shape[1]))])


def _inputs(p: Params, table: np.ndarray, x: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the words with a 1 for the biases, steps x rows x ...; the input part of the gates, steps x 3 hidden x rows."""
    xe = table[x.ravel()].reshape(*x.shape, -1)
    gx = room("input", x.shape[0], len(p["b"]), x.shape[1])
    return xe, np.matmul(_below(p["Wx"], p["b"]).T, xe.transpose(0, 2, 1), out=gx)


def _with_ones(a: np.ndarray) -> np.ndarray:
    return np.concatenate([a, np.ones((len(a), 1), a.dtype)], axis=1)


def _states(p: Params, gx: np.ndarray, h: np.ndarray) -> np.ndarray:
    """States after each step of a window; gx: input part of the gates, steps x rows x 3 hidden."""
    return _Tape(p, gx.transpose(0, 2, 1), h, np.zeros(gx.shape[:2], bool), Room()).after.transpose(0, 2, 1)


class _Tape:
    """A window's forward pass with what its backward pass needs, in arrays of steps x ... x rows: what a step works on lies together."""

    def __init__(self, p: Params, gx: np.ndarray, h: np.ndarray, fresh: np.ndarray, room: Room):
        """fresh: where a document begins, steps x rows; its state before that is 0."""
        (steps, _, rows), n = gx.shape, h.shape[1]
        self.p, self.room, self.keep = p, room, (~fresh).astype(np.float32)
        self.before, self.u, self.after = (room(k, steps, n, rows) for k in ("before", "u", "after"))
        self.gate = room("gate", steps, 3 * n, rows)  # update, reset, state's part of the new state
        weights, spare = p["Wh"].T.copy(), np.empty((n, rows), np.float32)
        weights[: 2 * n] *= -1
        h = h.T
        for t in range(steps):
            g, u, before = self.gate[t], self.u[t], self.before[t]
            np.multiply(h, self.keep[t], out=before)
            np.matmul(weights, before, out=g)
            zr = g[: 2 * n]
            zr -= gx[t, : 2 * n]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(g[n : 2 * n], g[2 * n :], out=u)
            u += gx[t, 2 * n :]
            np.tanh(u, out=u)
            np.subtract(before, u, out=spare)
            spare *= g[:n]
            h = np.add(u, spare, out=self.after[t])

    def back(self, ds: np.ndarray) -> np.ndarray:
        """Gradients by the gates' sums, given those by the states from the output: of (times reset) new state, update, reset, new state."""
        steps, n, rows = ds.shape
        z, r, part = (self.gate[:, k * n : k * n + n] for k in range(3))
        to = self.room("to", steps, 4 * n, rows)
        times_r, of_z, of_r, of_u = (to[:, k * n : k * n + n] for k in range(4))
        spare = np.subtract(1, z, out=self.room("spare", steps, n, rows))
        np.multiply(self.u, self.u, out=of_u)
        np.subtract(1, of_u, out=of_u)
        of_u *= spare
        spare *= z
        np.subtract(self.before, self.u, out=of_z)
        of_z *= spare
        np.multiply(of_u, r, out=times_r)
        np.subtract(1, r, out=spare)
        spare *= part
        np.multiply(times_r, spare, out=of_r)
        weights = np.concatenate([self.p["Wh"][:, 2 * n :], self.p["Wh"][:, : 2 * n]], axis=1)
        dh, spare = np.zeros((n, rows), np.float32), np.empty((n, rows), np.float32)
        for t in range(steps - 1, -1, -1):
            dh += ds[t]
            four = to[t].reshape(4, n, rows)
            four *= dh
            np.matmul(weights, to[t, : 3 * n], out=spare)
            dh *= z[t]
            dh += spare
            dh *= self.keep[t]
        return to


def _classes(p: Params, one: np.ndarray, c: np.ndarray, safe: bool, room: Room, grads: Params | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of each class after its state (one: the states and a 1); with grads, the loss's gradient by state too."""
    weights = _below(p["Wc"], p["bc"])
    x = np.matmul(weights.T, one.T, out=room("classes", weights.shape[1], len(one)))
    if not safe:
        np.minimum(x, 80, out=x)  # far beyond any trained logit; keeps exp() finite without a maximum
    at = c, np.arange(len(c))
    lp = x[at]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    lp -= np.log(total)
    if grads is None:
        return lp, None
    x *= 1 / total
    x[at] -= 1
    both = one.T @ x.T
    grads["Wc"] += both[:-1]
    grads["bc"] += both[-1]
    return lp, np.matmul(x.T, weights[:-1].T, out=room("by class", len(one), len(weights) - 1))


def _words(p: Params, bounds: np.ndarray, one: np.ndarray, c: np.ndarray, y: np.ndarray, safe: bool, room: Room, grads: Params | None) -> tuple[np.ndarray, np.ndarray | None]:
    """As _classes, for each word within its class; c rises.  All classes' logits stand in one array, so that only products go class by class."""
    weights, size = _below(p["Wo"], p["bo"]), np.diff(bounds)[c]
    first = np.cumsum(size) - size
    x = room("words", int(size.sum()))
    cuts = np.searchsorted(c, np.arange(len(bounds)))
    parts = [(slice(i, j), slice(a, b), x[first[i] : first[i] + (j - i) * (b - a)].reshape(j - i, b - a)) for i, j, a, b in zip(cuts[:-1], cuts[1:], bounds[:-1], bounds[1:]) if i < j]
    for rows, ids, logits in parts:
        np.matmul(one[rows], weights[:, ids], out=logits)
    if not safe:
        np.minimum(x, 80, out=x)
    at = first + y - bounds[c]
    lp = x[at]
    np.exp(x, out=x)
    total = np.add.reduceat(x, first)
    lp -= np.log(total)
    if grads is None:
        return lp, None
    x *= np.repeat(1 / total, size)
    x[at] -= 1
    both, ds = np.zeros(weights.shape, np.float32), room("by word", len(one), len(weights) - 1)
    for rows, ids, d in parts:
        np.matmul(one[rows].T, d, out=both[:, ids])
        np.matmul(d, weights[:-1, ids].T, out=ds[rows])
    grads["Wo"] += both[:-1]
    grads["bo"] += both[-1]
    return lp, ds


def _output(p: Params, bounds: np.ndarray, s: np.ndarray, y: np.ndarray, grads: Params | None = None, room: Room | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each target id after each state, ... x hidden; with grads, the loss's gradient by state too."""
    room = Room() if room is None else room
    # states are within -1..1, which bounds the logits
    safe_c, safe_o = (float((np.abs(p[w]).sum(axis=0) + p[b]).max()) < 80 for w, b in (("Wc", "bc"), ("Wo", "bo")))
    c = np.repeat(np.arange(len(bounds) - 1, dtype=np.int16), np.diff(bounds))[y]
    n = s.shape[-1]
    one = room("states", *s.shape[:-1], n + 1)
    one[..., :n] = s
    one[..., n] = 1
    order = np.argsort(c, kind="stable")
    one, c, y = one.reshape(-1, n + 1)[order], c[order], y[order]
    lp, ds = _classes(p, one, c, safe_c, room, grads)
    more, by_word = _words(p, bounds, one, c, y, safe_o, room, grads)
    out = np.empty_like(lp)
    out[order] = lp + more
    if grads is None:
        return out, None
    ds += by_word
    by_word[order] = ds
    return out, by_word


def _lanes(lengths: list[int], rows: int) -> list[list[int]]:
    """Documents dealt to at most so many lanes of like length, the longest lane first."""
    lanes = [(0, k, []) for k in range(min(rows, len(lengths)))]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n, k, lane = lanes[0]
        lane.append(i)
        heapq.heapreplace(lanes, (n + lengths[i], k, lane))
    return [lane for _, _, lane in sorted(lanes, key=lambda x: (-x[0], x[1]))]


def _ahead(docs: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, fresh) of documents one behind the other; fresh: where one begins."""
    y = np.concatenate(docs)
    each = np.array([len(d) for d in docs])
    fresh = np.zeros(len(y), bool)
    fresh[(np.cumsum(each) - each)[each > 0]] = True
    return np.where(fresh, end, np.append(end, y[:-1])), y, fresh


def _windows(docs: list[np.ndarray], rows: int, size: int, end: int):
    """(inputs, targets, fresh, document, valid), steps x active lanes, over whole documents one behind the other; the number active only falls."""
    longest, total = max(map(len, docs)), sum(map(len, docs))
    if not total:
        return
    lanes = _lanes([len(d) for d in docs], max(1, min(rows, total // longest)))
    size = max(size, size * rows // len(lanes))  # few lanes go further at a time
    who = [i for lane in lanes for i in lane]
    x, y, fresh = _ahead([docs[i] for i in who], end)
    of = np.repeat(who, [len(docs[i]) for i in who])
    lengths = np.array([sum(len(docs[i]) for i in lane) for lane in lanes])
    first = np.cumsum(lengths) - lengths
    for t in range(0, int(lengths[0]), size):
        active = int((lengths > t).sum())
        step = np.arange(t, min(t + size, int(lengths[0])))[:, None]
        ok = step < lengths[:active]
        at = np.where(ok, first[:active] + step, first[:active])
        yield x[at], y[at], fresh[at], of[at], ok


def log_likelihoods(p: Params, bounds: np.ndarray, docs: list[np.ndarray], end: int, rows: int = 512, size: int = 32) -> np.ndarray:
    """Natural log-likelihood of each document of ids, its end included."""
    out = np.zeros(len(docs))
    room, table = Room(), _with_ones(p["E"])
    h = np.zeros((rows, p["Wh"].shape[0]), np.float32)
    for x, y, fresh, of, ok in _windows(docs, rows, size, end) if docs else ():
        tape = _Tape(p, _inputs(p, table, x, room)[1], h[: x.shape[1]], fresh, room)
        h = tape.after[-1].T.copy()
        ll = _output(p, bounds, tape.after.transpose(0, 2, 1), y.ravel(), room=room)[0]
        out += np.bincount(of[ok], ll[ok.ravel()], len(docs))
    return out


def _views(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def gradients(p: Params, bounds: np.ndarray, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, g: Params, room: Room | None = None) -> np.ndarray:
    """Adds to g the gradient of a window's summed loss by each parameter; returns the states after it."""
    room = Room() if room is None else room
    n, width = h.shape[1], p["E"].shape[1]
    xe, gx = _inputs(p, _with_ones(p["E"]), x, room)
    tape = _Tape(p, gx, h, fresh, room)
    ds = _output(p, bounds, tape.after.transpose(0, 2, 1), y.ravel(), g, room)[1]
    by_step = room("by step", x.shape[0], n, x.shape[1])
    by_step[...] = ds.reshape(*x.shape, n).transpose(0, 2, 1)
    to = tape.back(by_step)
    by_state = np.matmul(to[:, : 3 * n], tape.before.transpose(0, 2, 1)).sum(axis=0).T
    g["Wh"][:, 2 * n :] += by_state[:, :n]
    g["Wh"][:, : 2 * n] += by_state[:, n:]
    d = to[:, n:]
    by_input = np.matmul(d, xe).sum(axis=0).T
    g["Wx"] += by_input[:width]
    g["b"] += by_input[width]
    dx = np.matmul(d.transpose(0, 2, 1), p["Wx"].T).reshape(-1, width)
    x = x.ravel().astype(np.uint16) if len(p["E"]) <= 1 << 16 else x.ravel()  # short numbers are sorted by digits
    order = np.argsort(x, kind="stable")
    used, begin = np.unique(x[order], return_index=True)
    g["E"][used] += np.add.reduceat(dx[order], begin, axis=0)
    return tape.after[-1].T.copy()


def _streams(docs: list[np.ndarray], rows: int, size: int, end: int):
    """(inputs, targets, fresh) of windows, steps x streams, over all tokens once.

    The documents stand one behind the other and are cut into streams of one length, so every
    window is full; the last one of all may be narrower and shorter.
    """
    x, y, fresh = _ahead(docs, end)
    rows = max(1, min(rows, len(y) // size))
    steps = len(y) // rows
    whole = [np.ascontiguousarray(a[: rows * steps].reshape(rows, steps).T) for a in (x, y, fresh)]
    for t in range(0, steps, size):
        yield t, *(a[t : t + size] for a in whole)
    if rows * steps < len(y):
        yield 0, *(a[rows * steps :, None] for a in (x, y, fresh))


def train(p: Params, bounds: np.ndarray, docs: list[np.ndarray], end: int, rows: int = 32, size: int = 32, rate: float = 3e-3, moments: list | None = None) -> list:
    """One pass of truncated backpropagation with Adam; changes p, returns the optimiser's moments."""
    hidden = p["Wh"].shape[0]
    flat = np.concatenate([p[k].ravel() for k in sorted(p)])
    now, grad = _views(flat, p), np.empty_like(flat)
    g, spare = _views(grad, p), np.empty_like(flat)
    moments = moments or [np.zeros_like(flat), np.zeros_like(flat), 0]
    mean, square = moments[:2]
    room = Room()
    docs = [docs[i] for i in np.random.default_rng(len(docs)).permutation(len(docs)) if len(docs[i])]
    h = np.zeros((0, hidden), np.float32)
    for t, x, y, fresh in _streams(docs, rows, size, end) if docs else ():
        h = np.zeros((x.shape[1], hidden), np.float32) if t == 0 else h
        grad[:] = 0
        h = gradients(now, bounds, x, y, fresh, h, g, room)
        grad *= 1 / y.size
        np.clip(grad, -1, 1, out=grad)
        moments[2] += 1
        fix = np.sqrt(1 - 0.999 ** moments[2]) / (1 - 0.9 ** moments[2])
        mean *= 0.9
        mean += np.multiply(grad, 0.1, out=spare)
        grad *= grad
        square *= 0.999
        square += np.multiply(grad, 0.001, out=spare)
        np.sqrt(square, out=spare)
        spare += 1e-8
        np.divide(mean, spare, out=spare)
        spare *= rate * fix
        flat -= spare
    for k, v in now.items():
        p[k][...] = v
    return moments


def pack(p: Params) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def unpack(raw: bytes, like: Params) -> Params:
    out, at = {}, 0
    flat = np.frombuffer(raw, "<f4")
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out
