"""A small causal self-attention model over subword ids, in numpy.

Inputs of a place are the embeddings of its id and of the id before, and the place in the window. Layers of masked
attention and a feed-forward step follow. The last state gives weights over COMPONENTS distributions of the next id
(the columns of a table over the whole vocabulary), so the probability of an id is a weighted mean of as many
numbers, and the probabilities of all ids add up to 1 without a sum over the vocabulary for each token. The weights are
learned by gradients, the table by expectation maximisation, smoothed by the corpus-wide counts of the ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

WINDOW, OVERLAP = 32, 8
DIM, HEADS, HIDDEN, LAYERS, COMPONENTS = 32, 1, 32, 1, 128
#: Added to the corpus-wide count of each id; and how many counts the corpus-wide distribution weighs in each component.
UNSEEN, SMOOTH = 0.02, 2.0
#: Total of the component table that the model starts from, in counts.
START_MASS = 1000.0
F4 = np.float32

#: power() takes arguments on this scale: POWER_SCALE * x + POWER_SHIFT stands for exp(x).
POWER_SCALE, POWER_SHIFT = F4((1 << 23) / np.log(2)), F4(127 << 23)
POWER_TOP = POWER_SHIFT + 40 * POWER_SCALE
_MASK = np.where(np.tri(WINDOW, dtype=bool), POWER_SHIFT, F4(-3e38))


def windows(ids: np.ndarray, length: np.ndarray, end: int, chunk: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first scored place, inputs, targets, scored from that place on, owner) for chunks of windows over texts.

    ids are those of all texts in a row, each text's ``length`` of them with the end as its last, so that a text's first
    input is the end before it. The first window of a text scores all its places; a later one starts OVERLAP ids before
    the end of the one before and scores only what follows those. So each id is scored once. What stands behind a text's end in
    a window is not scored, and nothing before it sees it.
    """
    row = np.concatenate([[end], ids, np.full(WINDOW, end)]).astype(np.int32)
    stop = np.cumsum(length)
    step = WINDOW - OVERLAP
    more = np.maximum(0, -(-(length - WINDOW) // step))
    reach = np.arange(WINDOW + 1)
    later = np.repeat(np.arange(len(length)), more)
    k = 1 + np.arange(len(later)) - np.repeat(np.cumsum(more) - more, more)
    some = np.flatnonzero(length)
    for low, owner, begin in ((0, some, (stop - length)[some]), (OVERLAP, later, (stop - length)[later] + k * step)):
        for c in range(0, len(owner), chunk):
            own, at = owner[c : c + chunk], begin[c : c + chunk]
            both = row[at[:, None] + reach]
            yield low, both[:, :-1], both[:, 1:], (at[:, None] + np.arange(low, WINDOW)) < stop[own][:, None], own


def power(x: np.ndarray) -> np.ndarray:
    """exp(), up to 6 %, of numbers on POWER_SCALE: between powers of two it is linear, so the bits of a rounded number are
    the result. Positive and growing, it serves as well as exp() to make weights, at a fifth of the time. Numbers must lie
    between 0 and POWER_TOP."""
    return x.astype(np.int32).view(F4)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = 1 / np.sqrt(np.einsum("...i,...i->...", x, x)[..., None] / F4(x.shape[-1]) + F4(1e-5))
    return x * s, s


def _unit_back(dy: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    return s * (dy - y * (np.einsum("...i,...i->...", dy, y)[..., None] / F4(y.shape[-1])))


def _by_row(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows (below n), in no order, and the sums of their values."""
    at, slot, width = np.arange(len(rows)), np.empty(n, np.int64), values.shape[1]
    slot[rows] = at
    own = rows[slot[rows] == at]
    slot[own] = np.arange(len(own))
    sums = np.zeros(len(own) * width, values.dtype)
    # numpy has a fast way for one-dimensional arrays alone.
    np.add.at(sums, (slot[rows][:, None] * width + np.arange(width)).ravel(), values.ravel())
    return own, sums.reshape(-1, width)


@dataclass
class Model:
    """params by name; ``seen`` [entry, component] are expected counts, ``corpus`` the smoothed corpus-wide distribution.

    Entries are the ids that the corpus has (``index`` gives an id's) and, last, one for all ``n_others`` ids that it
    lacks, which share its probability evenly. So the model is as large as what the corpus uses of the vocabulary.
    """

    params: dict[str, np.ndarray]
    corpus: np.ndarray
    seen: np.ndarray
    index: np.ndarray
    n_others: int
    table: np.ndarray = field(init=False)
    #: No component's logit is larger by amount, as states have a length of sqrt(DIM).
    largest: float = field(init=False)

    def __post_init__(self):
        self.settle()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "largest")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.settle()

    @property
    def end(self) -> int:
        return int(self.index[-1])

    def copy(self) -> Model:
        return Model({n: x.copy() for n, x in self.params.items()}, self.corpus, self.seen, self.index, self.n_others)

    def settle(self) -> None:
        """Recomputes the table from the expected counts, and the bound of the logits from the parameters."""
        self.bound()
        self.table = ((self.seen + SMOOTH * self.corpus[:, None]) / (self.seen.sum(axis=0, dtype=np.float64) + SMOOTH)).astype(F4)

    def bound(self) -> None:
        self.largest = DIM**0.5 * float(np.linalg.norm(self.params["out"], axis=0).max()) + float(np.abs(self.params["bias"]).max())

    def states(self, inputs: np.ndarray, low: int, keep: list | None = None) -> np.ndarray:
        """Weights of the components (not yet divided by their sum) for the places from ``low`` on, as rows."""
        p, (b, t) = self.params, inputs.shape
        d = DIM // HEADS
        before = np.concatenate([inputs[:, :1], inputs[:, :-1]], axis=1)
        x = p["embed"].take(inputs, axis=0)
        x += p["before"].take(before, axis=0)
        x += p["place"][:t]

        def heads(y: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(y.reshape(b, -1, HEADS, d).transpose(0, 2, 1, 3))

        for n in range(LAYERS):
            lo = low if n == LAYERS - 1 else 0
            y, s = _unit(x)
            k, v = heads(y.reshape(-1, DIM) @ p[f"k{n}"]), heads(y.reshape(-1, DIM) @ p[f"v{n}"])
            q = heads(y[:, lo:].reshape(-1, DIM) @ p[f"q{n}"])
            q *= POWER_SCALE * F4(d**-0.5)
            a = q @ k.transpose(0, 1, 3, 2)
            a += _MASK[lo:t, :t]
            np.clip(a, 0, POWER_TOP, out=a)
            a = power(a)
            total = 1 / (a @ np.ones((t, 1), F4))
            if keep is None:
                c = (a @ v) * total
            else:
                a *= total
                c = a @ v
            c = np.ascontiguousarray(c.transpose(0, 2, 1, 3)).reshape(-1, DIM)
            mid = x[:, lo:].reshape(-1, DIM) + c @ p[f"mix{n}"]
            h = mid @ p[f"up{n}"]
            h += p[f"add{n}"]
            np.maximum(h, 0, out=h)
            x = (mid + h @ p[f"down{n}"]).reshape(b, t - lo, DIM)
            if keep is not None:
                keep.append((y, s, q, k, v, a, c, mid, h))
        y, s = _unit(x)
        z = y.reshape(-1, DIM) @ (p["out"] * POWER_SCALE)
        z += p["bias"] * POWER_SCALE + POWER_SHIFT
        if self.largest > 40:
            np.clip(z, 0, POWER_TOP, out=z)
        z = power(z)
        if keep is not None:
            keep.append((before, y, s))
        return z

    def log_probs(self, inputs: np.ndarray, targets: np.ndarray, low: int = 0) -> np.ndarray:
        """Natural logarithms of the probabilities of targets, as [window, place from low on]."""
        z, y = self.states(inputs, low), targets[:, low:].ravel()
        value = np.log(np.einsum("ij,ij->i", z, self.table.take(y, axis=0)) / (z @ np.ones(COMPONENTS, F4)))
        value[y == len(self.corpus) - 1] -= F4(np.log(max(1, self.n_others)))
        return value.reshape(len(inputs), -1)

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, on: np.ndarray, low: int = 0) -> tuple[float, dict[str, np.ndarray], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Mean loss, gradients of the dense parameters, and (rows, values) for embed and before and of expected counts. Targets
        are learned from the place ``low`` on, to which ``on`` belongs; those before are context, as in log_probs."""
        p, (b, t) = self.params, inputs.shape
        d = DIM // HEADS
        keep: list = []
        z = self.states(inputs, low, keep)
        before, y, s = keep.pop()
        targets = targets[:, low:].ravel()
        w = on.ravel().astype(F4)
        total = max(1.0, float(w.sum()))
        # Neither the weights' sum nor the number of places is divided out of the large arrays by itself.
        ones = np.ones(COMPONENTS, F4)
        sums = z @ ones
        share = self.table.take(targets, axis=0)
        share *= z
        met = share @ ones
        loss = -float((np.log(met / sums) * w).sum()) / total
        share *= (w / met)[:, None]
        z *= (w / sums)[:, None]
        dz = np.subtract(z, share, out=z)
        part = F4(1 / total)
        g = {"out": (y.reshape(-1, DIM).T @ dz) * part, "bias": (np.ones(len(dz), F4) @ dz) * part}
        dx = _unit_back((dz @ (p["out"].T * part)).reshape(b, -1, DIM), y, s)
        for n in range(LAYERS - 1, -1, -1):
            y, s, q, k, v, a, c, mid, h = keep[n]
            lo = t - dx.shape[1]
            f = dx.reshape(-1, DIM)
            g[f"down{n}"] = h.T @ f
            dh = (f @ p[f"down{n}"].T) * (h > 0)
            g[f"up{n}"], g[f"add{n}"] = mid.T @ dh, dh.sum(axis=0)
            f = f + dh @ p[f"up{n}"].T
            g[f"mix{n}"] = c.T @ f
            dc = np.ascontiguousarray((f @ p[f"mix{n}"].T).reshape(b, t - lo, HEADS, d).transpose(0, 2, 1, 3))
            da, dv = dc @ v.transpose(0, 1, 3, 2), a.transpose(0, 1, 3, 2) @ dc
            # The sum of a * da over the places seen is dc times what was mixed.
            da -= np.einsum("bhid,bhid->bhi", dc, c.reshape(b, t - lo, HEADS, d).transpose(0, 2, 1, 3))[..., None]
            ds = np.multiply(a, da, out=da)
            dq, dk = (ds @ k) * F4(d**-0.5), (ds.transpose(0, 1, 3, 2) @ q) / POWER_SCALE
            dq, dk, dv = (m.transpose(0, 2, 1, 3).reshape(-1, DIM) for m in (dq, dk, dv))
            rows = y.reshape(-1, DIM)
            g[f"q{n}"], g[f"k{n}"], g[f"v{n}"] = y[:, lo:].reshape(-1, DIM).T @ dq, rows.T @ dk, rows.T @ dv
            dy = (dk @ p[f"k{n}"].T + dv @ p[f"v{n}"].T).reshape(b, t, DIM)
            dy[:, lo:] += (dq @ p[f"q{n}"].T).reshape(b, t - lo, DIM)
            dx = _unit_back(dy, y, s)
            dx[:, lo:] += f.reshape(b, t - lo, DIM)
        g["place"] = np.zeros_like(p["place"])
        g["place"][:t] = dx.sum(axis=0)
        dx = dx.reshape(-1, DIM)
        n = len(self.corpus)
        return loss, g, _by_row(inputs.ravel(), dx, n), _by_row(before.ravel(), dx, n), _by_row(targets, share, n)


def start(id_counts: np.ndarray, seed: int = 5) -> Model:
    """An untrained model from the counts of all ids, of which the last is the end: frequent ids have a component of their own, the others one by chance."""
    used = id_counts > 0
    used[-1] = True
    n_others = int((~used).sum())
    index = np.where(used, np.cumsum(used) - 1, used.sum()).astype(np.int64)
    counts, unseen = np.append(id_counts[used], 0.0), np.append(np.full(int(used.sum()), UNSEEN), UNSEEN * n_others + 1e-9)
    rng, n = np.random.default_rng(seed), len(counts)
    shape = {"embed": (n, DIM, 0.3), "before": (n, DIM, 0.3), "place": (WINDOW, DIM, 0.1), "out": (DIM, COMPONENTS, 0.1), "bias": (1, COMPONENTS, 0.0)}
    for k in range(LAYERS):
        shape |= {f"q{k}": (DIM, DIM, DIM**-0.5), f"k{k}": (DIM, DIM, DIM**-0.5), f"v{k}": (DIM, DIM, DIM**-0.5), f"mix{k}": (DIM, DIM, 0.5 * DIM**-0.5), f"up{k}": (DIM, HIDDEN, DIM**-0.5), f"add{k}": (1, HIDDEN, 0.0), f"down{k}": (HIDDEN, DIM, 0.5 * HIDDEN**-0.5)}
    params = {name: (rng.normal(size=(a, b)) * scale).astype(F4) for name, (a, b, scale) in shape.items()}
    corpus = (counts + unseen) / (counts + unseen).sum()
    own = rng.integers(0, COMPONENTS, n)
    own[np.argsort(-counts, kind="stable")[:COMPONENTS]] = np.arange(min(n, COMPONENTS))
    seen = (0.2 * START_MASS / COMPONENTS * corpus)[:, None] * rng.uniform(0.5, 1.5, (1, COMPONENTS))
    seen[np.arange(n), own] += START_MASS * corpus
    return Model(params, corpus, seen.astype(F4), index, n_others)


class Trainer:
    """Adam for dense parameters, row-wise scaling for the embeddings, expected counts for the table."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        # The dense parameters become views of one array, which a step changes as a whole.
        self.dense = [n for n in model.params if n not in ("embed", "before")]
        self.flat = np.concatenate([model.params[n].ravel() for n in self.dense])
        for n, x in zip(self.dense, np.split(self.flat, np.cumsum([model.params[n].size for n in self.dense])[:-1]), strict=True):
            model.params[n] = x.reshape(model.params[n].shape)
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.rows = {n: np.zeros_like(model.params[n]) for n in ("embed", "before")}
        self.gathered = np.zeros_like(model.seen)

    def step(self, inputs: np.ndarray, targets: np.ndarray, on: np.ndarray, progress: float, low: int = 0) -> float:
        self.t += 1
        p = self.model.params
        self.model.bound()
        rate = self.rate * min(1.0, self.t / 20) * (1 - 0.9 * progress)
        loss, g, embed, before, share = self.model.gradients(inputs, targets, on, low)
        x = np.concatenate([g[n].ravel() for n in self.dense])
        self.m = 0.9 * self.m + 0.1 * x
        self.v = 0.98 * self.v + 0.02 * x**2
        self.flat -= (rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.98**self.t)) + 1e-8)).astype(F4)
        for n, (rows, x) in (("embed", embed), ("before", before)):
            self.rows[n][rows] += x**2
            p[n][rows] -= (3 * rate * x / (np.sqrt(self.rows[n][rows]) + 1e-8)).astype(F4)
        self.gathered[share[0]] += share[1]
        return loss

    def absorb(self, keep: float) -> None:
        """The gathered expected counts join ``keep`` of those before."""
        self.model.seen = self.gathered + self.model.seen * F4(keep)
        self.gathered = np.zeros_like(self.gathered)
        self.model.settle()


def fit(model: Model, inputs: np.ndarray, targets: np.ndarray, on: np.ndarray, steps: int = 1500, batch: int = 64, rate: float = 0.03) -> list[float]:
    """Trains the model in place on windows drawn by chance; gives the losses. Fewer steps where there are few windows."""
    if not len(inputs):
        return []
    steps = min(steps, 100 + len(inputs) // 4)
    rng, trainer, losses = np.random.default_rng(1), Trainer(model, rate), []
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(inputs), batch)
        losses.append(trainer.step(inputs[pick], targets[pick], on[pick], t / steps))
        if t % 20 == 0 or t == steps:
            trainer.absorb(0.7 if 2 * t < steps else 0.9)
    return losses
