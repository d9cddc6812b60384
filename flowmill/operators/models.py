"""Per-key classifiers in numpy: flat parameters, summed gradients, Adam.

A model gives predictions and the sums over rows of loss and gradient, so gradients of parts of a batch add up to those of the batch.
"""

from __future__ import annotations

import numpy as np

CODES = {0: "dense", 1: "recurrent", 2: "autoencoder", 3: "svm", 4: "logistic", 5: "lstm"}
#: Registered names whose training always fails, as the library they need isn't there.
ABSENT = {6: "random forest", 7: "gradient boosting"}


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def entropy(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-7, 1 - 1e-7)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


class Flat:
    """Parameters of named shapes in one vector; weights start by Glorot's uniform rule from seed 1, biases at 0."""

    def __init__(self, shapes: list[tuple[int, ...]]) -> None:
        self.shapes = shapes
        self.ends = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])

    @property
    def length(self) -> int:
        return int(self.ends[-1])

    def split(self, w: np.ndarray) -> list[np.ndarray]:
        return [w[a:b].reshape(s) for a, b, s in zip(self.ends[:-1], self.ends[1:], self.shapes, strict=True)]

    def start(self) -> np.ndarray:
        rng = np.random.default_rng(1)
        limit = lambda s: np.sqrt(6 / (s[0] + s[-1]))
        return np.concatenate([rng.uniform(-limit(s), limit(s), s).ravel() if len(s) > 1 else np.zeros(s) for s in self.shapes])


class Linear(Flat):
    """One unit: logistic with cross entropy, or a hinge on labels 0 and 1 whose prediction is the unit's value.  It starts at 0."""

    def __init__(self, size: int, hinge: bool) -> None:
        super().__init__([(size,), (1,)])
        self.hinge = hinge

    def predict(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = x @ w[:-1] + w[-1]
        return z if self.hinge else sigmoid(z)

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        p = self.predict(w, x)
        if self.hinge:
            loss, g = float(np.maximum(0, 1 - y * p).sum()), np.where(y * p < 1, -y, 0.0)
        else:
            loss, g = entropy(p, y), p - y
        return loss, np.append(x.T @ g, g.sum())


class Dense(Flat):
    """Layers with rectifiers and a logistic output; ``squares`` takes the mean squared error of all outputs to the label."""

    def __init__(self, widths: tuple[int, ...], squares: bool = False) -> None:
        super().__init__([s for a, b in zip(widths, widths[1:], strict=False) for s in ((a, b), (b,))])
        self.squares = squares

    def layers(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = self.split(w)
        return list(zip(parts[::2], parts[1::2], strict=True))

    def forward(self, w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        out, layers = [x], self.layers(w)
        for i, (a, b) in enumerate(layers):
            z = out[-1] @ a + b
            out.append(np.maximum(z, 0) if i < len(layers) - 1 else sigmoid(z))
        return out

    def predict(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.forward(w, x)[-1][:, 0]

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        out, layers, found = self.forward(w, x), self.layers(w), []
        p, target = out[-1], y[:, None]
        if self.squares:
            loss, g = float(((p - target) ** 2).mean(axis=1).sum()), 2 * (p - target) / p.shape[1] * p * (1 - p)
        else:
            loss, g = entropy(p, target), p - target
        for i in range(len(layers) - 1, -1, -1):
            found = [(out[i].T @ g).ravel(), g.sum(axis=0), *found]
            g = g @ layers[i][0].T * (out[i] > 0) if i else g
        return loss, np.concatenate(found)


class Recurrent(Flat):
    """Two recurrent layers over a row's features as a sequence of single values, and a logistic unit on the last state.

    Cells have a rectifier, or with ``gates`` are those of a long short-term memory.  Gradients go back through all steps.
    """

    def __init__(self, units: tuple[int, int], gates: bool) -> None:
        self.units, self.gates = units, gates
        shapes, below = [], 1
        for n in units:
            wide = 4 * n if gates else n
            shapes += [(below, wide), (n, wide), (wide,)]
            below = n
        super().__init__([*shapes, (below, 1), (1,)])

    def layer(self, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
        """States of all steps (rows, steps, units) and what the way back needs."""
        rows, steps, n = len(x), x.shape[1], wh.shape[0]
        h, c, kept, out = np.zeros((rows, n)), np.zeros((rows, n)), [], np.empty((rows, steps, n))
        for t in range(steps):
            z = x[:, t] @ wx + h @ wh + b
            if self.gates:
                i, f, o = (sigmoid(z[:, k * n : (k + 1) * n]) for k in (0, 1, 3))
                g = np.tanh(z[:, 2 * n : 3 * n])
                new = f * c + i * g
                kept.append((h, c, i, f, g, o, new))
                c, h = new, o * np.tanh(new)
            else:
                kept.append((h, z))
                h = np.maximum(z, 0)
            out[:, t] = h
        return out, kept

    def back(self, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list, given: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Gradients of the layer's input and weights from those of its states."""
        n = wh.shape[0]
        dx, dwx, dwh, db = np.zeros_like(x), np.zeros_like(wx), np.zeros_like(wh), np.zeros(wx.shape[1])
        dh, dc = np.zeros((len(x), n)), np.zeros((len(x), n))
        for t in range(x.shape[1] - 1, -1, -1):
            dh = dh + given[:, t]
            if self.gates:
                h, c, i, f, g, o, new = kept[t]
                tanh = np.tanh(new)
                dc = dc + dh * o * (1 - tanh**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - g**2), dh * tanh * o * (1 - o)], axis=1)
                dc = dc * f
            else:
                h, z = kept[t]
                dz = dh * (z > 0)
            dwx += x[:, t].T @ dz
            dwh += h.T @ dz
            db += dz.sum(axis=0)
            dx[:, t], dh = dz @ wx.T, dz @ wh.T
        return dx, [dwx, dwh, db]

    def forward(self, w: np.ndarray, x: np.ndarray):
        parts = self.split(w)
        first, kept1 = self.layer(x[:, :, None], *parts[:3])
        second, kept2 = self.layer(first, *parts[3:6])
        return parts, first, kept1, second, kept2, sigmoid(second[:, -1] @ parts[6] + parts[7])[:, 0]

    def predict(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.forward(w, x)[-1]

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        parts, first, kept1, second, kept2, p = self.forward(w, x)
        g = (p - y)[:, None]
        given = np.zeros_like(second)
        given[:, -1] = g @ parts[6].T
        dx, own2 = self.back(first, parts[3], parts[4], kept2, given)
        _, own1 = self.back(x[:, :, None], parts[0], parts[1], kept1, dx)
        return entropy(p, y), np.concatenate([a.ravel() for a in (*own1, *own2, second[:, -1].T @ g, g.sum(axis=0))])


class Adam:
    """Weights with the moments of their gradients."""

    def __init__(self, weights: np.ndarray, first: np.ndarray | None = None, second: np.ndarray | None = None, steps: int = 0) -> None:
        self.weights, self.steps = weights, steps
        self.first = np.zeros_like(weights) if first is None else first
        self.second = np.zeros_like(weights) if second is None else second

    def step(self, gradient: np.ndarray, rate: float) -> None:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        scale = rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        self.weights = self.weights - scale * self.first / (np.sqrt(self.second) + 1e-7)


def create(code: int, size: int):
    if code in ABSENT:
        raise ValueError(f"{ABSENT[code]} needs a library that isn't installed")
    if code not in CODES:
        raise ValueError(f"model {code} isn't available: {CODES}")
    return {"dense": lambda: Dense((size, 100, 50, 25, 1)), "recurrent": lambda: Recurrent((50, 25), False), "autoencoder": lambda: Dense((size, 64, 32, 64, size), True), "svm": lambda: Linear(size, True), "logistic": lambda: Linear(size, False), "lstm": lambda: Recurrent((50, 25), True)}[CODES[code]]()
