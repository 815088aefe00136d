"""A small causal self-attention model over word classes, in numpy.

Class ids are written as three digits to base ``BASE``; each digit is
predicted from the hidden state and the digits before it, so a token costs 3 x 20 scores
instead of 8,000. Digit biases come from counts over the whole training corpus; context
starts from a bounded sample and is then learned from every block of it. Sequences are
cut into blocks of ``BLOCK`` positions, and each block attends to itself (causally) and to the whole block before: windows overlap,
every token is scored once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BASE, IDS, END = 20, 8000, 7999
BLOCK, DIM = 16, 16


def init(counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters; ``counts`` has the corpus frequency of every id."""
    rng = np.random.default_rng(seed)
    full = np.zeros(BASE**3)
    full[:IDS] = counts + 0.5
    cube = full.reshape(BASE, BASE, BASE)
    with np.errstate(divide="ignore"):
        bias = [np.log(cube.sum((1, 2))), np.log(cube.sum(2)), np.log(cube.reshape(-1, BASE))]
    # Log shares, so that scores stay near zero and need no shift before exp; no share is -1e4.
    bias = [np.maximum(b - np.log(np.maximum(np.exp(b).sum(-1, keepdims=True), 1e-9)), -1e4).astype(np.float32) for b in bias]
    normal = lambda *shape, scale=0.1: rng.normal(0, scale, shape).astype(np.float32)
    p = {"E": normal(IDS, DIM, scale=0.3), "R": np.zeros(2 * BLOCK, np.float32)}
    p |= {k: normal(DIM, DIM, scale=0.25) for k in ("Wq", "Wk", "Wv", "Wo")}
    p |= {f"U{i}": normal(DIM, BASE, scale=0.02) for i in range(3)}
    p |= {"D0": normal(BASE, DIM, scale=0.02), "D1": normal(BASE, DIM, scale=0.02)}
    return p | {f"b{i}": b for i, b in enumerate(bias)}


def blocks(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, follows, owner) of whole sequences; targets -1 are padding."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    rows = -(-sizes // BLOCK)
    x = np.full((int(rows.sum()), BLOCK), END, np.int64)
    y = np.full(x.shape, -1, np.int64)
    first = np.cumsum(rows) - rows
    at = np.repeat(first * BLOCK - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    flat = np.concatenate(sequences) if len(sequences) else np.zeros(0, np.int64)
    y.ravel()[at] = flat
    x.ravel()[1:] = np.where(y.ravel()[:-1] >= 0, y.ravel()[:-1], END)
    x[first[rows > 0], 0] = END
    owner = np.repeat(np.arange(len(sequences)), rows)
    follows = np.concatenate([[False], owner[1:] == owner[:-1]]) if len(owner) else np.zeros(0, bool)
    return x, y, follows, owner


_I, _J = np.arange(BLOCK)[:, None], np.arange(2 * BLOCK)[None, :]
_CAUSAL = _J <= _I + BLOCK
_AGO = np.clip(_I + BLOCK - _J, 0, 2 * BLOCK - 1)


def _shift(a: np.ndarray) -> np.ndarray:
    return np.concatenate([np.concatenate([np.zeros_like(a[:1]), a[:-1]]), a], axis=1)


def _times(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """a @ w as one product of matrices, not one for each block."""
    return (a.reshape(-1, DIM) @ w).reshape(a.shape)


def _attend(p, x, follows):
    e = p["E"].take(x, 0)
    q, k, v = _times(e, p["Wq"] * np.float32(DIM**-0.5)), _shift(_times(e, p["Wk"])), _shift(_times(e, p["Wv"]))
    a = q @ k.transpose(0, 2, 1)
    a += p["R"][_AGO]
    np.exp(a, out=a)
    a *= _CAUSAL
    a[~follows, :, :BLOCK] = 0
    a /= a.sum(axis=2, keepdims=True)
    o = a @ v
    return e, q, k, v, a, o, e + _times(o, p["Wo"])


def _digits(p, h, y):
    """Log probabilities and, per digit, (hidden state, logits' softmax, digit)."""
    d = (y // (BASE * BASE), y // BASE % BASE, y % BASE)
    states = [h, h + p["D0"].take(d[0], 0)]
    states.append(states[1] + p["D1"].take(d[1], 0))
    biases = (p["b0"], p["b1"].take(d[0], 0), p["b2"].take(d[0] * BASE + d[1], 0))
    total, parts, row = np.zeros(len(y)), [], np.arange(len(y))
    for i in range(3):
        s = states[i] @ p[f"U{i}"]
        s += biases[i]
        total += s[row, d[i]]
        np.exp(s, out=s)
        norm = s @ np.ones(BASE, s.dtype)
        total -= np.log(norm)
        parts.append((states[i], s, norm, d[i]))
    return total, parts


def log_probabilities(p: dict, x: np.ndarray, y: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Natural log probability of every target; 0 for padding."""
    h = _attend(p, x, follows)[-1]
    real = y >= 0
    out = np.zeros(y.shape)
    out[real] = _digits(p, h[real], y[real])[0]
    return out


def _by_id(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, and the sum of the rows of each."""
    found = np.flatnonzero(np.bincount(ids, minlength=IDS))
    sums = np.zeros(IDS * DIM, rows.dtype)
    np.add.at(sums, (ids[:, None] * DIM + np.arange(DIM)).ravel(), rows.ravel())
    return found, sums.reshape(IDS, DIM)[found]


def loss_and_gradients(p: dict, x: np.ndarray, y: np.ndarray, follows: np.ndarray) -> tuple[float, dict]:
    """Mean loss and the gradient of every parameter."""
    loss, g, ids, rows = _gradients(p, x, y, follows)
    g["E"] = np.zeros_like(p["E"])
    g["E"][ids] = rows
    return loss, g


def _gradients(p: dict, x: np.ndarray, y: np.ndarray, follows: np.ndarray) -> tuple[float, dict, np.ndarray, np.ndarray]:
    """Mean loss, gradients but for the embedding, the ids read and the gradients of their embedding rows."""
    e, q, k, v, a, o, h = _attend(p, x, follows)
    real = y >= 0
    total, parts = _digits(p, h[real], y[real])
    n = max(1, len(total))
    g = {}
    back = np.zeros((int(real.sum()), DIM), np.float32)
    for i in (2, 1, 0):
        state, s, norm, digit = parts[i]
        dz, row = s, np.arange(len(digit))
        dz /= (norm * n)[:, None]
        dz[row, digit] -= 1 / n
        g[f"U{i}"] = state.T @ dz
        back = back + dz @ p[f"U{i}"].T
        if i:
            marks = np.zeros((len(row), BASE), back.dtype)
            marks[row, parts[i - 1][3]] = 1
            g[f"D{i - 1}"] = marks.T @ back
    dh = np.zeros_like(h)
    dh[real] = back
    flat = lambda t: t.reshape(-1, DIM)
    g["Wo"] = flat(o).T @ flat(dh)
    do = _times(dh, p["Wo"].T)
    da = do @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(axis=2, keepdims=True))
    g["R"] = np.bincount(_AGO.ravel(), weights=ds.sum(axis=0).ravel(), minlength=2 * BLOCK).astype(np.float32)
    dq = ds @ k * np.float32(DIM**-0.5)

    def unshift(t):
        own = t[:, BLOCK:].copy()
        own[:-1] += t[1:, :BLOCK]
        return own

    dk, dv = unshift(ds.transpose(0, 2, 1) @ q), unshift(a.transpose(0, 2, 1) @ do)
    de = dh.copy()
    for name, d in (("Wq", dq), ("Wk", dk), ("Wv", dv)):
        g[name] = flat(e).T @ flat(d)
        de += _times(d, p[name].T)
    # Padding passes nothing back: it is no target, and no target attends to it.
    return -float(total.sum()) / n, g, *_by_id(x[real], de[real])


def train(p: dict, sequences: list[np.ndarray], steps: int = 300, batch: int = 192, rate: float = 0.01, seed: int = 11) -> dict:
    """Adam over random runs of blocks of the sample."""
    x, y, follows, _ = blocks(sequences)
    if not len(x):
        return p
    rng = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k[0] != "b"}
    for step in range(1, steps + 1):
        low = int(rng.integers(0, max(1, len(x) - batch)))
        part = slice(low, low + batch)
        begun = follows[part].copy()
        begun[0] = False
        _, g = loss_and_gradients(p, x[part], y[part], begun)
        speed = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, (m, v) in moment.items():
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] * g[k] - v)
            p[k] = p[k] - speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _stretches(sequences: Iterable[np.ndarray], least: int) -> Iterator[list[np.ndarray]]:
    """Sequences together, of ``least`` blocks or more but for the last ones."""
    pending, size = [], 0
    for s in sequences:
        pending.append(s)
        size += -(-len(s) // BLOCK)
        if size >= least:
            yield pending
            pending, size = [], 0
    if pending:
        yield pending


def train_pass(p: dict, sequences: Iterable[np.ndarray], batch: int = 192, rate: float = 0.003) -> tuple[dict, np.ndarray, int]:
    """Adam over every block of the sequences, once; they are not held together.

    Returns new parameters, how often each id was an input, and the number of targets.
    Moments of an embedding row move only when its id occurs.
    """
    p = {k: v.copy() for k, v in p.items()}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k[0] != "b"}
    uses, targets, step = np.zeros(IDS, np.int64), 0, 0
    for together in _stretches(sequences, 16 * batch):
        x, y, follows, _ = blocks(together)
        for part in np.array_split(np.arange(len(x)), max(1, round(len(x) / batch))) if len(x) else ():
            low, high = int(part[0]), int(part[-1]) + 1
            begun = follows[low:high].copy()
            begun[0] = False
            real = y[low:high] >= 0
            _, g, ids, rows = _gradients(p, x[low:high], y[low:high], begun)
            g["E"] = rows
            step += 1
            speed = rate * min(1.0, step / 20)
            uses += np.bincount(x[low:high][real], minlength=IDS)
            targets += int(real.sum())
            for k, (m, v) in moment.items():
                at, d = ids if k == "E" else slice(None), g[k]
                m[at] = mean = m[at] + 0.1 * (d - m[at])
                v[at] = square = v[at] + 0.01 * (d * d - v[at])
                p[k][at] -= speed * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
    return p, uses, targets
