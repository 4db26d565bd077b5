"""Dense, convolutional and recurrent classifiers in numpy: logits, gradients by weights and by inputs, training.

A network is a list of layers; each layer knows its forward step and how to pull a gradient back through it, with or
without the gradients by its own weights. Training covers all rows on the executors, whose tasks add up the gradients of
every batch; with ``max_rows`` it takes a bounded, random sample to the driver instead. Scoring and perturbing are
Arrow-batched over all rows. Weights are plain arrays: they travel with the worker function and are stored as one npz
file.
"""

from __future__ import annotations

import hmac
import io
import math
import os
import secrets
import socket
import tempfile
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidegate.functions.numeric import sigmoid
from tidegate.operators.sample import ranked

Weights = dict[str, np.ndarray]


class Dense:
    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, shape: tuple[int, ...], rng: np.random.Generator) -> tuple[Weights, tuple[int, ...]]:
        return {"w": rng.normal(0, np.sqrt(2 / shape[-1]), (shape[-1], self.size)), "b": np.zeros(self.size)}, (*shape[:-1], self.size)

    def forward(self, p: Weights, x: np.ndarray, _: object) -> tuple[np.ndarray, object]:
        return x @ p["w"] + p["b"], x

    def back(self, p: Weights, x: np.ndarray, d: np.ndarray, own: bool = True) -> tuple[np.ndarray, Weights]:
        return d @ p["w"].T, {"w": x.T @ d, "b": d.sum(axis=0)} if own else {}


class Relu:
    def init(self, shape, rng):
        return {}, shape

    def forward(self, p, x, _):
        return np.maximum(x, 0), x > 0

    def back(self, p, on, d, own=True):
        return d * on, {}


class Dropout:
    """Active only in training, where a mask of the values that stay is given."""

    def __init__(self, share: float) -> None:
        self.share = share

    def init(self, shape, rng):
        return {}, shape

    def mask(self, shape, rng):
        return (rng.random(shape) >= self.share) / (1 - self.share)

    def forward(self, p, x, mask):
        return x if mask is None else x * mask, mask

    def back(self, p, mask, d, own=True):
        return d if mask is None else d * mask, {}


class Sequence1:
    """A row of n values as n steps of one value."""

    def init(self, shape, rng):
        return {}, (shape[0], 1)

    def forward(self, p, x, _):
        return x[:, :, None], None

    def back(self, p, _, d, own=True):
        return d[:, :, 0], {}


class Conv:
    """Convolution along the steps, of equal length."""

    def __init__(self, filters: int, width: int = 3) -> None:
        self.filters, self.width = filters, width

    def init(self, shape, rng):
        scale = np.sqrt(2 / (self.width * shape[1]))
        return {"w": rng.normal(0, scale, (self.width, shape[1], self.filters)), "b": np.zeros(self.filters)}, (shape[0], self.filters)

    def forward(self, p, x, _):
        left, n = self.width // 2, x.shape[1]
        padded = np.pad(x, ((0, 0), (left, self.width - 1 - left), (0, 0)))
        seen = np.concatenate([padded[:, k : k + n] for k in range(self.width)], axis=2).reshape(-1, self.width * x.shape[2])  # what each step sees
        out = seen @ p["w"].reshape(-1, self.filters)
        out += p["b"]
        return out.reshape(len(x), n, self.filters), (padded.shape, seen)

    def back(self, p, cache, d, own=True):
        shape, seen = cache
        n, channels, left = d.shape[1], shape[2], self.width // 2
        flat, w, dx = d.reshape(-1, self.filters), p["w"].reshape(-1, self.filters), np.zeros(shape, d.dtype)
        dseen = (flat @ w.T).reshape(len(d), n, -1)
        for k in range(self.width):
            dx[:, k : k + n] += dseen[:, :, k * channels : (k + 1) * channels]
        return dx[:, left : left + n], {"w": (seen.T @ flat).reshape(p["w"].shape), "b": flat.sum(axis=0)} if own else {}


class HalfMax:
    """Maximum of every two steps; a last odd step is left out."""

    def init(self, shape, rng):
        return {}, (shape[0] // 2, shape[1])

    def forward(self, p, x, _):
        half = x.shape[1] // 2 * 2
        first, second = x[:, 0:half:2], x[:, 1:half:2]
        return np.maximum(first, second), (x.shape, first >= second)

    def back(self, p, cache, d, own=True):
        shape, on_first = cache
        dx, half = np.zeros(shape, d.dtype), shape[1] // 2 * 2
        np.multiply(d, on_first, out=dx[:, 0:half:2])
        np.multiply(d, ~on_first, out=dx[:, 1:half:2])
        return dx, {}


class GlobalMax:
    def init(self, shape, rng):
        return {}, (shape[1],)

    def forward(self, p, x, _):
        out, at = x[:, 0].copy(), np.zeros((len(x), x.shape[2]), np.int32)
        for t in range(1, x.shape[1]):
            np.copyto(at, t, where=x[:, t] > out)
            np.maximum(out, x[:, t], out=out)
        return out, (x.shape, at)

    def back(self, p, cache, d, own=True):
        shape, at = cache
        dx = np.empty(shape, d.dtype)
        for t in range(shape[1]):
            np.multiply(d, at == t, out=dx[:, t])
        return dx, {}


def _gates(z: np.ndarray) -> np.ndarray:
    """Logistic function of every value, in place."""
    np.negative(z, out=z)
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


class Lstm:
    """Last state of a recurrence; gates in the order input, forget, candidate, output.

    Rows are taken in blocks that stay in the processor's cache, with one row per column, so that every gate is one
    stretch of memory. tanh(v) is taken as 2 / (1 + exp(-2 v)) - 1."""

    BLOCK = 128

    def __init__(self, units: int) -> None:
        self.units = units

    def init(self, shape, rng):
        u = self.units
        bias = np.zeros(4 * u)
        bias[u : 2 * u] = 1.0  # remember at first
        return {"x": rng.normal(0, 1 / np.sqrt(u), (shape[1], 4 * u)), "h": rng.normal(0, 1 / np.sqrt(u), (u, 4 * u)), "b": bias}, (u,)

    def forward(self, p, x, _):
        u, out, blocks = self.units, np.empty((len(x), self.units), x.dtype), []
        px, ph, b = np.ascontiguousarray(p["x"].T), np.ascontiguousarray(p["h"].T), p["b"][:, None]
        for at in range(0, len(x), self.BLOCK):
            part = np.ascontiguousarray(x[at : at + self.BLOCK].transpose(1, 2, 0))
            steps, n = part.shape[0], part.shape[2]
            h, c = np.zeros((steps + 1, u, n), x.dtype), np.zeros((steps + 1, u, n), x.dtype)
            gates, squashed = np.empty((steps, 4 * u, n), x.dtype), np.empty((steps, u, n), x.dtype)
            for t in range(steps):
                z, s = gates[t], squashed[t]
                np.matmul(ph, h[t], out=z)
                z += px * part[t] if len(part[t]) == 1 else px @ part[t]
                z += b
                i, f, g, o = z[:u], z[u : 2 * u], z[2 * u : 3 * u], z[3 * u :]
                g *= 2
                _gates(z)
                g *= 2
                g -= 1
                np.multiply(f, c[t], out=c[t + 1])
                np.multiply(i, g, out=s)
                c[t + 1] += s
                np.multiply(c[t + 1], 2, out=s)
                _gates(s)
                s *= 2
                s -= 1
                np.multiply(o, s, out=h[t + 1])
            out[at : at + n] = h[steps].T
            blocks.append((part, h, c, gates, squashed))
        return out, (x.shape, blocks)

    def back(self, p, cache, d, own=True):
        u, (shape, blocks) = self.units, cache
        dx, grads = np.empty(shape, d.dtype), {k: np.zeros_like(v) for k, v in p.items()} if own else {}
        px, ph, at = p["x"], p["h"], 0
        for part, h, c, gates, squashed in blocks:
            steps, n = part.shape[0], part.shape[2]
            dh, dc, dz, by = np.ascontiguousarray(d[at : at + n].T), np.zeros((u, n), d.dtype), np.empty((4 * u, n), d.dtype), np.empty((4 * u, n), d.dtype)
            for t in reversed(range(steps)):
                z, s = gates[t], squashed[t]
                i, f, g, o = z[:u], z[u : 2 * u], z[2 * u : 3 * u], z[3 * u :]
                np.subtract(1, z, out=by)  # the gates' own slopes: v (1 - v), the candidate's 1 - v^2
                by[: 2 * u] *= z[: 2 * u]
                by[2 * u : 3 * u] *= 1 + g
                by[3 * u :] *= o
                dc += dh * o * (1 - s * s)
                np.multiply(dc, g, out=dz[:u])
                np.multiply(dc, c[t], out=dz[u : 2 * u])
                np.multiply(dc, i, out=dz[2 * u : 3 * u])
                np.multiply(dh, s, out=dz[3 * u :])
                dz *= by
                if own:
                    grads["x"] += part[t] @ dz.T
                    grads["h"] += h[t] @ dz.T
                    grads["b"] += dz.sum(axis=1)
                dx[at : at + n, t] = (px @ dz).T
                dh = ph @ dz
                dc *= f
            at += n
        return dx, grads


# Sizes of the three networks.
ARCHITECTURES = {
    "mlp": lambda dropout: [Dense(128), Relu(), Dropout(dropout), Dense(64), Relu(), Dropout(dropout), Dense(32), Relu(), Dropout(dropout), Dense(2)],
    "cnn": lambda dropout: [Sequence1(), Conv(64, 3), Relu(), HalfMax(), Conv(128, 3), Relu(), GlobalMax(), Dense(64), Relu(), Dropout(dropout), Dense(2)],
    "lstm": lambda dropout: [Sequence1(), Lstm(64), Dense(32), Relu(), Dropout(dropout), Dense(2)],
}


def blocks(n: int, size: int = 256) -> list[slice]:
    """Stretches of rows whose layers fit the processor's cache; at least one, also of no rows."""
    return [slice(at, at + size) for at in range(0, max(1, n), size)]


@dataclass
class Network:
    """A classifier of two classes over vectors of ``n_features`` values; detects where p(attack) >= threshold."""

    kind: str
    n_features: int
    weights: list[Weights]
    threshold: float = 0.5
    layers: list = field(default_factory=list)
    shapes: list = field(default_factory=list)  # of one row before each layer

    @classmethod
    def build(cls, kind: str, n_features: int, layers: list | None = None, dropout: float = 0.2, seed: int = 0) -> Network:
        """With random weights; an unknown kind without layers of its own raises."""
        if layers is None:
            if kind not in ARCHITECTURES:
                raise ValueError(f"unknown network {kind!r}; known: {sorted(ARCHITECTURES)}")
            layers = ARCHITECTURES[kind](dropout)
        rng, shape, weights, shapes = np.random.default_rng(seed), (n_features,), [], []
        for layer in layers:
            shapes.append(shape)
            made, shape = layer.init(shape, rng)
            weights.append(made)
        return cls(kind, n_features, weights, layers=layers, shapes=shapes)

    def masks(self, n: int, rng: np.random.Generator) -> list[np.ndarray | None]:
        """For ``n`` rows the random masks of the layers that drop values."""
        return [layer.mask((n, *shape), rng) if isinstance(layer, Dropout) else None for layer, shape in zip(self.layers, self.shapes)]

    def run(self, x: np.ndarray, masks: Sequence[np.ndarray | None] | None = None) -> tuple[np.ndarray, list]:
        """(logits, what the way back needs); a matrix of another width raises."""
        if x.shape[1] != self.n_features:
            raise ValueError(f"{x.shape[1]} features given, {self.n_features} expected")
        caches = []
        for layer, p, mask in zip(self.layers, self.weights, masks or [None] * len(self.layers)):
            x, cache = layer.forward(p, x, mask)
            caches.append(cache)
        return x, caches

    def pull(self, caches: list, d: np.ndarray, own: bool = True) -> tuple[np.ndarray, list[Weights]]:
        """Gradients by the inputs and, where they are wanted (``own``), by the weights from the one by the logits."""
        grads = []
        for layer, p, cache in zip(reversed(self.layers), reversed(self.weights), reversed(caches)):
            d, g = layer.back(p, cache, d, own)
            grads.append(g)
        return d, grads[::-1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.run(x[rows])[0] for rows in blocks(len(x))])

    def tau(self) -> float:
        t = min(max(self.threshold, 1e-12), 1 - 1e-12)
        return float(np.log(t / (1 - t)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Attack logit minus benign one, above the threshold's; at least 0 = detected."""
        z = self.logits(x)
        return z[:, 1] - z[:, 0] - self.tau()

    def slope(self, x: np.ndarray) -> np.ndarray:
        """Gradient of the margin by the inputs."""
        return self.margin_and_slope(x)[1]

    def margin_and_slope(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both from one way through the layers."""
        margin, slope = np.empty(len(x), x.dtype), np.empty_like(x)
        for rows in blocks(len(x)):
            z, caches = self.run(x[rows])
            margin[rows] = z[:, 1] - z[:, 0] - self.tau()
            slope[rows] = self.pull(caches, np.tile([-1.0, 1.0], (len(z), 1)), own=False)[0]
        return margin, slope

    def save(self, path: str) -> None:
        """One npz file below a folder that the driver can write to."""
        buffer = io.BytesIO()
        arrays = {f"{i}.{k}": v for i, p in enumerate(self.weights) for k, v in p.items()}
        np.savez_compressed(buffer, kind=self.kind, n_features=self.n_features, threshold=self.threshold, **arrays)
        with open(path, "wb") as f:
            f.write(buffer.getvalue())

    @classmethod
    def load(cls, path: str) -> Network:
        with np.load(path) as stored:
            out = cls.build(str(stored["kind"]), int(stored["n_features"]))
            out.threshold = float(stored["threshold"])
            for i, p in enumerate(out.weights):
                for k in p:
                    if p[k].shape != stored[f"{i}.{k}"].shape:
                        raise ValueError(f"{path}: weights of another architecture")
                    p[k] = stored[f"{i}.{k}"]
        return out


def parameters(network: Network) -> int:
    return sum(v.size for p in network.weights for v in p.values())


def loss_and_gradients(network: Network, x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator | None = None, each: Callable = map) -> tuple[float, list[Weights]]:
    """Weighted cross-entropy and its gradients by the weights.

    ``each`` may be the map of a pool of threads: the rows are taken in blocks, whose sums are added in their order, so
    the result does not depend on the threads. Masks are drawn for all rows before."""
    share, masks = w / w.sum(), network.masks(len(x), rng) if rng else [None] * len(network.layers)

    def part(rows: slice) -> tuple[float, list[Weights]]:
        z, caches = network.run(x[rows], [m if m is None else m[rows] for m in masks])
        q = softmax(z)
        loss = _cross_entropy(q, y[rows], share[rows])
        q[np.arange(len(q)), y[rows]] -= 1
        return loss, network.pull(caches, q * share[rows, None])[1]

    (loss, grads), *more = each(part, blocks(len(x)))
    for other, others in more:
        loss += other
        grads = [{k: v + o[k] for k, v in g.items()} for g, o in zip(grads, others)]
    return loss, grads


def loss_of(network: Network, x: np.ndarray, y: np.ndarray, w: np.ndarray, each: Callable = map, chosen: np.ndarray | None = None) -> float:
    """Weighted cross-entropy alone; of the rows ``chosen`` where given, whose weights are ``w``."""
    share, at = w / w.sum(), (lambda rows: rows) if chosen is None else chosen.__getitem__
    return sum(each(lambda rows: _cross_entropy(softmax(network.run(x[at(rows)])[0]), y[at(rows)], share[rows]), blocks(len(w))))


def _cross_entropy(q: np.ndarray, y: np.ndarray, share: np.ndarray) -> float:
    return float(-(share * np.log(np.maximum(q[np.arange(len(y)), y], 1e-15))).sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def drawn(rows: DataFrame, id_col: str, x_col: str, y_col: str, max_rows: int, seed: int = 42) -> DataFrame:
    """At most ``max_rows`` rows with a vector and a label, at random by row id: however often a vector repeats, the
    bound holds. What the vectors hold does not decide, so they may be made after the draw."""
    known = rows.where(F.col(x_col).isNotNull() & F.col(y_col).isNotNull())
    return ranked(known, [], id_col, F.least("n_stratum", F.lit(max_rows)), seed)


def matrices(chosen: DataFrame, id_col: str, x_col: str, y_col: str, weight_col: str | None = None) -> tuple[np.ndarray, ...]:
    """(x, y, weight) of a bounded table, in the order of its ids."""
    weight = F.col(weight_col) if weight_col else F.lit(1.0)
    pdf = chosen.select(F.col(id_col).alias("i"), F.col(x_col).alias("x"), F.col(y_col).cast("int").alias("y"), weight.cast("double").alias("w")).toPandas()
    if not len(pdf):
        raise ValueError("no labelled row to train on")
    pdf = pdf.sort_values("i", kind="stable")
    return np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(), pdf["w"].to_numpy()


def training_sample(rows: DataFrame, id_col: str, x_col: str, y_col: str, max_rows: int, weight_col: str | None = None, seed: int = 42) -> tuple[np.ndarray, ...]:
    """(x, y, weight) of the rows ``drawn``."""
    return matrices(drawn(rows, id_col, x_col, y_col, max_rows, seed), id_col, x_col, y_col, weight_col)


class Team:
    """The tasks of one barrier stage, which add up vectors: each sends its own to the first over a connection that stays
    open, and gets back the sum, added in the order of the tasks."""

    def __init__(self) -> None:
        task = BarrierTaskContext.get()
        hosts = [t.address.rpartition(":")[0].strip("[]") for t in task.getTaskInfos()]
        self.size, self.member, self.links = len(hosts), task.partitionId(), []
        if self.size == 1:
            return
        server = socket.create_server(("", 0), backlog=self.size) if not self.member else None
        said = task.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if server else "")[0]
        port, word = said.split()
        if server is None:
            link = socket.create_connection((hosts[0] or "localhost", int(port)), timeout=60)
            link.sendall(word.encode() + self.member.to_bytes(4, "big"))
            self.links = [link]
        else:
            server.settimeout(60)
            found: dict[int, socket.socket] = {}
            while len(found) < self.size - 1:
                link, _ = server.accept()
                link.settimeout(60)
                hello = self._read(link, len(word) + 4)
                if hmac.compare_digest(hello[: len(word)], word.encode()):
                    found[int.from_bytes(hello[len(word) :], "big")] = link
                else:  # not one of the tasks
                    link.close()
            server.close()
            self.links = [found[i] for i in sorted(found)]
        for link in self.links:
            link.settimeout(None)  # a task that fails closes its connections, and the stage begins again
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _read(link: socket.socket, n: int) -> bytes:
        out = bytearray(n)
        view, at = memoryview(out), 0
        while at < n:
            if not (got := link.recv_into(view[at:])):
                raise ConnectionError("another task of the stage has ended")
            at += got
        return bytes(out)

    def total(self, own: np.ndarray) -> np.ndarray:
        """Sum of the tasks' vectors, the same bits for all of them."""
        if self.size == 1:
            return own
        if self.member:
            self.links[0].sendall(own.tobytes())
            return np.frombuffer(self._read(self.links[0], own.nbytes))
        out = own.copy()
        for link in self.links:
            out += np.frombuffer(self._read(link, own.nbytes))
        for link in self.links:
            link.sendall(out.tobytes())
        return out

    def close(self) -> None:
        for link in self.links:
            link.close()


def _gradients(network: Network, x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, each: Callable, team: Team | None) -> list[Weights]:
    """Gradients by the weights over the rows given here and those of the rest of the team, which may be none here."""
    if team is None or team.size == 1:
        return loss_and_gradients(network, x, y, w, rng, each)[1]
    own = np.zeros(parameters(network) + 1)
    if len(x):
        grads = loss_and_gradients(network, x, y, w, rng, each)[1]
        own[-1] = w.sum()
        own[:-1] = np.concatenate([g[k].ravel() for p, g in zip(network.weights, grads) for k in p]) * own[-1]
    whole, at, out = team.total(own), 0, []
    for p in network.weights:
        out.append({})
        for k, v in p.items():
            out[-1][k] = whole[at : at + v.size].reshape(v.shape) / whole[-1]
            at += v.size
    return out


def train(network: Network, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, epochs: int = 30, batch: int = 1024, rate: float = 1e-3,
          patience: int = 4, plateau: int = 2, seed: int = 0, team: Team | None = None) -> list[float]:
    """Adam with early stopping on a tenth held out and the learning rate halved on a plateau; the weights of the best
    epoch stay. Returns the held-out loss of every epoch.

    ``team``: each of its tasks gives rows of its own. A batch holds as much of every task's rows as there is of them,
    and gradients and losses are those of all, so that each task ends with the same weights. ``x`` may lie in a file:
    rows are taken from it as they are needed."""
    alone = team is None or team.size == 1
    total = (lambda *v: v) if alone else (lambda *v: tuple(team.total(np.array(v, float))))
    rng = np.random.default_rng(seed if alone else [seed, team.member])
    order, w = rng.permutation(len(x)), np.ones(len(x)) if w is None else w
    held = min(len(x), max(1, len(x) // 10))
    own = len(x) - held
    everyone, all_held = (int(v) for v in total(own, held))
    moments = [{k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()} for p in network.weights]
    best, kept, since, history, step = np.inf, network.weights, 0, [], 0
    with ThreadPoolExecutor(1 if team else min(4, os.cpu_count() or 1)) as pool:
        for _ in range(epochs):
            shuffled = order[held + rng.permutation(own)]
            for s in range(math.ceil(everyone / batch)):
                rows = shuffled[s * batch * own // everyone : (s + 1) * batch * own // everyone]
                step += 1
                grads = _gradients(network, x[rows], y[rows], w[rows], rng, pool.map, team)
                network.weights = [
                    {k: _adam(p[k], g[k], m, k, step, rate) for k in p} for p, g, m in zip(network.weights, grads, moments)
                ]
            loss = loss_of(network, x, y, np.ones(held), pool.map, order[:held]) if held else 0.0
            if not alone:
                loss = total(loss * held)[0] / all_held
            history.append(loss)
            if loss < best - 1e-6:
                best, kept, since = loss, network.weights, 0
                continue
            since += 1
            rate *= 0.5 if since == plateau else 1.0
            if since >= patience:
                break
    network.weights = kept
    return history


def _adam(value: np.ndarray, gradient: np.ndarray, moments: dict, key: str, step: int, rate: float) -> np.ndarray:
    first, second = moments[key]
    moments[key] = first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
    return value - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)


def fitted(kind: str, rows: DataFrame, id_col: str, x_col: str, y_col: str, max_rows: int | None = None, seed: int = 0, **settings: float) -> Network:
    """A network of the given kind trained on ``rows``, or on a bounded sample of them."""
    return fitted_each([kind], rows, id_col, x_col, y_col, max_rows, seed, **settings)[kind]


def fitted_each(kinds: Sequence[str], rows: DataFrame, id_col: str, x_col: str, y_col: str, max_rows: int | None = None, seed: int = 0, **settings: float) -> dict[str, Network]:
    """``fitted`` for several kinds: without ``max_rows`` on all rows, on the executors; with it on one sample, drawn
    once, with the networks trained side by side on the driver."""
    if max_rows is None:
        return trained_on_all(kinds, rows, id_col, x_col, y_col, seed=seed, **settings)
    return trained_each(kinds, *training_sample(rows, id_col, x_col, y_col, max_rows, seed=42), seed=seed, **settings)


# Rows for each task at least, and tasks beyond which a batch has few rows for each.
TASK_ROWS, MAX_TASKS = 1_000, 16


def tasks_for(spark: SparkSession, n_rows: int) -> int:
    """Tasks that train together: all run at the same time, so no more than there are slots."""
    sc = spark.sparkContext._jsc.sc()
    slots = sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())
    return max(1, min(MAX_TASKS, slots, n_rows // TASK_ROWS))


def _stored(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors x, as a matrix in a file of the task, and labels y of all batches; vectors of different length raise."""
    file, labels, widths = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None), [np.zeros(0, np.int8)], set()
    for b in batches:
        widths |= set(b.column("x").value_lengths().to_pylist())
        if len(widths) > 1:
            raise ValueError(f"vectors of different lengths: {sorted(widths)}")
        file.write(b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).tobytes())
        labels.append(b.column("y").to_numpy().astype(np.int8))
    y = np.concatenate(labels)
    file.flush()
    return np.memmap(file, float, "r", shape=(len(y), widths.pop())) if len(y) else np.zeros((0, 0)), y


def trained_on_all(kinds: Sequence[str], rows: DataFrame, id_col: str, x_col: str, y_col: str, n_tasks: int | None = None, seed: int = 0, **settings: float) -> dict[str, Network]:
    """Networks with random weights trained on every row with a vector and a label, in a barrier stage of ``n_tasks``
    tasks (else as many as ``tasks_for`` the rows) that hold a share of the rows each, in a file.

    One task trains as ``trained_each`` does. More take the rows in another order and drop other values; for a given
    number of tasks the result is the same again."""
    spark = rows.sparkSession
    known = rows.where(F.col(x_col).isNotNull() & F.col(y_col).isNotNull())
    known = known.select(F.col(id_col).alias("i"), F.xxhash64(x_col, y_col).alias("mark"), F.col(x_col).cast("array<double>").alias("x"), F.col(y_col).cast("int").alias("y"))
    n_tasks = n_tasks or tasks_for(spark, known.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = _stored(batches)
        team = Team()
        try:
            widths = team.total(np.array([x.shape[1], x.shape[1] ** 2, len(x) > 0], float))
            if not widths[2]:
                return
            n = round(widths[0] / widths[2])
            if widths[1] != n * n * widths[2]:
                raise ValueError("vectors of different lengths")
            x = x if len(x) else np.zeros((0, n))
            for kind in kinds:
                network = Network.build(kind, n, seed=seed)
                train(network, x, y, seed=seed, team=team, **settings)
                if not team.member:
                    flat = np.concatenate([p[k].ravel() for p in network.weights for k in p])
                    yield pa.RecordBatch.from_pydict({"kind": [kind], "n_features": [n], "weights": [flat.tobytes()]})
        finally:
            team.close()

    placed = known.repartition(n_tasks, "i", "mark").sortWithinPartitions("i", "mark").select("x", "y")
    out = {}
    for r in placed.mapInArrow(run, "kind string, n_features long, weights binary", barrier=True).collect():
        out[r.kind], flat, at = Network.build(r.kind, r.n_features, seed=seed), np.frombuffer(r.weights), 0
        for p in out[r.kind].weights:
            for k, v in p.items():
                p[k] = flat[at : at + v.size].reshape(v.shape).copy()
                at += v.size
    if not out:
        raise ValueError("no labelled row to train on")
    return {kind: out[kind] for kind in kinds}


def trained_each(kinds: Sequence[str], x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int = 0, **settings: float) -> dict[str, Network]:
    """Networks with random weights trained on the same matrix, a thread for each: numpy works outside the interpreter's lock."""
    made = {kind: Network.build(kind, x.shape[1], seed=seed) for kind in kinds}
    with ThreadPoolExecutor(max(1, len(made))) as pool:
        for done in [pool.submit(train, network, x, y, w, seed=seed, **settings) for network in made.values()]:
            done.result()
    return made


def on_rows(x: Column, f) -> Column:
    """A double per row from ``f`` of the matrix of rows with a vector; null for the others."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        rows = x.notna().to_numpy()
        if rows.any():
            out[rows] = f(np.stack(x[rows].to_numpy()).astype(float))
        return pd.Series(out)

    return F.nanvl(run(x), F.lit(None).cast("double"))


def scored(df: DataFrame, x_col: str, network: Network) -> DataFrame:
    """Add ``logit`` (attack minus benign) and ``prob``; a vector of another length raises, a null one gives null."""
    shift = network.tau()
    return df.withColumn("logit", on_rows(F.col(x_col), lambda x: network.margin(x) + shift)).withColumn("prob", sigmoid(F.col("logit")))


# -- perturbations over networks ----------------------------------------------------------------------------------


def start_of(ids: Sequence[int], n: int, seed: int) -> np.ndarray:
    """A point of [-1, 1]^n per row that depends on the seed and the row's id only."""
    return np.stack([np.random.default_rng([seed, abs(int(i))]).uniform(-1, 1, n) for i in ids]) if len(ids) else np.zeros((0, n))


def perturbed(network: Network, attack: str, x: np.ndarray, y: np.ndarray, ids: Sequence[int], eps: float = 0.1, steps: int = 10,
              step: float = 0.02, overshoot: float = 0.02, restarts: int = 1, seed: int = 0, known: tuple | None = None, starts: Callable = start_of) -> np.ndarray:
    """fgsm, bim, pgd or deepfool on a matrix of scaled rows. The result stays in [0, 1] and, but for deepfool, within
    eps of each value. ``restarts``: random starts of pgd, of which the one with the best margin counts.

    ``known``: margin and slope at ``x`` where the caller has them. A row that a step leaves as it is stays so in all
    later steps, and one that deepfool has moved to the other side is not moved again: those are not asked again."""
    sign = np.where(y == 1, -1.0, 1.0)

    def walk(out: np.ndarray, size: float, steps: int, slope: np.ndarray | None = None) -> np.ndarray:
        """``steps`` steps by the sign of the slope, away from the label, within eps of x."""
        going = np.arange(len(x))
        for _ in range(steps):
            now, base = out[going], x[going]
            away = np.sign(network.slope(now) if slope is None else slope) * sign[going, None]
            new = np.clip(np.clip(now + size * away, base - eps, base + eps), 0, 1)
            out[going], slope = new, None
            going = going[(new != now).any(axis=1)]
            if not len(going):
                break
        return out

    if attack == "fgsm":
        return walk(x.copy(), eps, 1, known and known[1])
    if attack == "bim":
        return walk(x.copy(), step, steps, known and known[1])
    if attack == "pgd":
        best, score = x, np.full(len(x), -np.inf)
        for k in range(restarts):
            out = walk(np.clip(x + eps * starts(ids, x.shape[1], seed + k), 0, 1), step, steps)
            if restarts == 1:
                return out
            reached = network.margin(out) * sign
            best = np.where((reached > score)[:, None], out, best)
            score = np.maximum(score, reached)
        return best
    if attack == "deepfool":
        out, going = x.copy(), np.arange(len(x))
        for k in range(steps):
            margin, g = known if known and not k else network.margin_and_slope(out[going])
            todo = (margin >= 0) == (y[going] == 1)
            going, margin, g = going[todo], margin[todo], g[todo]
            if not len(going):
                break
            size = margin / np.maximum((g * g).sum(axis=1), 1e-12)
            out[going] = np.clip(out[going] - (1 + overshoot) * size[:, None] * g, 0, 1)
        return out
    raise ValueError(f"unknown attack {attack!r}; known: bim, deepfool, fgsm, pgd")


def _each(networks: dict[str, Network], attacks: dict[str, dict], x: np.ndarray, y: np.ndarray, ids: Sequence[int]):
    """(model, attack, margin at x, perturbed rows) of every pair: margin and slope at x are taken once a network, the
    random starts once for all."""
    starts = cache(lambda n, seed: start_of(ids, n, seed))
    for model, network in networks.items():
        known = network.margin_and_slope(x)
        for attack, settings in attacks.items():
            yield model, attack, known[0], perturbed(network, attack, x, y, ids, known=known, starts=lambda _, n, seed: starts(n, seed), **settings)


def _parts(batches, id_col: str, x_col: str, y_col: str):
    """(rows, x, y, ids) of at most 1,024 rows at a time."""
    for pdf in batches:
        for at in range(0, len(pdf), 1024):
            part = pdf.iloc[at : at + 1024]
            yield part, np.stack(part[x_col].to_numpy()).astype(float), part[y_col].to_numpy().astype(int), part[id_col].tolist()


def perturbed_rows(df: DataFrame, network: Network, attacks: dict[str, dict], id_col: str, x_col: str, y_col: str) -> DataFrame:
    """(id, attack, x_adv): every row with a vector and a label, perturbed by each of the attacks."""

    def run(batches):
        for part, x, y, ids in _parts(batches, id_col, x_col, y_col):
            for _, attack, _, adv in _each({"": network}, attacks, x, y, ids):
                yield pd.DataFrame({id_col: part[id_col], "attack": attack, "x_adv": list(adv)})

    known = df.where(F.col(x_col).isNotNull() & F.col(y_col).isNotNull())
    return known.select(id_col, x_col, y_col).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, attack string, x_adv array<double>")


def perturbed_by(df: DataFrame, networks: dict[str, Network], attacks: dict[str, dict], id_col: str, x_col: str, y_col: str) -> DataFrame:
    """``df`` with each vector replaced by what the row's own ``attack`` on the network of its ``model`` makes of it;
    rows without an attack stay as they are."""

    def run(batches):
        for part, x, y, ids in _parts(batches, id_col, x_col, y_col):
            out = x.copy()
            for (attack, model), at in part.groupby(["attack", "model"]).indices.items():
                out[at] = perturbed(networks[model], attack, x[at], y[at], [ids[i] for i in at], **attacks[attack])
            yield part.assign(**{x_col: list(out)})

    return df.mapInPandas(run, df.schema)


CELL = "attack string, model string, y int, pred_clean int, pred_adv int, linf double, l2 double, n_changed int"


def perturbation_cells(df: DataFrame, networks: dict[str, Network], attacks: dict[str, dict], id_col: str, x_col: str, y_col: str) -> DataFrame:
    """One row per row, attack and network with predictions before and after and norms: one pass over ``df``."""

    def run(batches):
        for _, x, y, ids in _parts(batches, id_col, x_col, y_col):
            for model, attack, clean, adv in _each(networks, attacks, x, y, ids):
                d = adv - x
                yield pd.DataFrame({
                    "attack": attack, "model": model, "y": y, "pred_clean": (clean >= 0).astype(int), "pred_adv": (networks[model].margin(adv) >= 0).astype(int),
                    "linf": np.abs(d).max(axis=1), "l2": np.sqrt((d * d).sum(axis=1)), "n_changed": (d != 0).sum(axis=1),
                })

    known = df.where(F.col(x_col).isNotNull() & F.col(y_col).isNotNull())
    return known.select(id_col, x_col, y_col).mapInPandas(run, CELL)
