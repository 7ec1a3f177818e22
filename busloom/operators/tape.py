"""Gradients of array expressions: each result remembers how its gradient reaches what it was made of."""

from __future__ import annotations

import numpy as np


class T:
    """An array with its gradient, set by backward()."""

    __slots__ = ("back", "data", "grad", "of")

    def __init__(self, data, of: tuple = (), back=None):
        self.data, self.of, self.back, self.grad = np.asarray(data, dtype=np.float64), of, back, None

    def __add__(self, other):
        other = other if isinstance(other, T) else T(other)
        return T(self.data + other.data, (self, other), lambda g: (_shaped(g, self), _shaped(g, other)))

    def __mul__(self, other):
        other = other if isinstance(other, T) else T(other)
        return T(self.data * other.data, (self, other), lambda g: (_shaped(g * other.data, self), _shaped(g * self.data, other)))

    def __sub__(self, other):
        return self + other * -1.0

    def __matmul__(self, other):
        a, b = self.data, other.data
        return T(a @ b, (self, other), lambda g: (_shaped(g @ np.swapaxes(b, -1, -2), self), _shaped(np.swapaxes(a, -1, -2) @ g, other)))

    def __getitem__(self, where):
        def back(g):
            out = np.zeros_like(self.data)
            out[where] = g
            return (out,)

        return T(self.data[where], (self,), back)

    def mean(self, axes, keep: bool = True):
        count = np.prod([self.data.shape[a] for a in np.atleast_1d(axes)])
        spread = lambda g: g if keep else np.expand_dims(g, axes)
        return T(self.data.mean(axis=axes, keepdims=keep), (self,), lambda g: (np.broadcast_to(spread(g), self.data.shape) / count,))

    def reshape(self, *shape):
        return T(self.data.reshape(shape), (self,), lambda g: (g.reshape(self.data.shape),))

    def transpose(self, *axes):
        return T(self.data.transpose(axes), (self,), lambda g: (g.transpose(np.argsort(axes)),))

    def backward(self) -> None:
        """Gradients of this number with regard to all that it was made of."""
        order, seen, todo = [], set(), [(self, False)]
        while todo:
            node, ready = todo.pop()
            if ready:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                todo.append((node, True))
                todo += [(n, False) for n in node.of]
        self.grad = np.ones_like(self.data)
        for node in reversed(order):
            if node.back is not None and node.grad is not None:
                for source, g in zip(node.of, node.back(node.grad), strict=True):
                    source.grad = g if source.grad is None else source.grad + g


def _shaped(g: np.ndarray, like: T) -> np.ndarray:
    """g summed over the axes along which `like` was repeated."""
    g = g.sum(axis=tuple(range(g.ndim - like.data.ndim)))
    return g.sum(axis=tuple(i for i, n in enumerate(like.data.shape) if n == 1 and g.shape[i] > 1), keepdims=True)


def relu(x: T) -> T:
    return T(np.maximum(x.data, 0), (x,), lambda g: (g * (x.data > 0),))


def tanh(x: T) -> T:
    y = np.tanh(x.data)
    return T(y, (x,), lambda g: (g * (1 - y * y),))


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def sigmoid(x: T) -> T:
    y = logistic(x.data)
    return T(y, (x,), lambda g: (g * y * (1 - y),))


def softmax(x: T) -> T:
    """Along the last axis."""
    e = np.exp(x.data - x.data.max(axis=-1, keepdims=True))
    y = e / e.sum(axis=-1, keepdims=True)
    return T(y, (x,), lambda g: (y * (g - (g * y).sum(axis=-1, keepdims=True)),))


def inverse_root(x: T) -> T:
    y = x.data**-0.5
    return T(y, (x,), lambda g: (-0.5 * g * y**3,))


def joined(parts: list[T], axis: int) -> T:
    edges = np.cumsum([p.data.shape[axis] for p in parts])[:-1]
    return T(np.concatenate([p.data for p in parts], axis=axis), tuple(parts), lambda g: tuple(np.split(g, edges, axis=axis)))


def normalized(x: T, axes, scale: T, shift: T, eps: float = 1e-5) -> tuple[T, np.ndarray, np.ndarray]:
    """x less its mean over axes, by its deviation, scaled and shifted; and that mean and (population) variance."""
    mean = x.mean(axes)
    off = x - mean
    variance = (off * off).mean(axes)
    return off * inverse_root(variance + eps) * scale + shift, mean.data, variance.data


def log_loss(margin: T, y: np.ndarray, positive_weight: float) -> T:
    """The sum over rows of the logistic loss, positives weighted."""
    m = margin.data
    loss = positive_weight * y * np.logaddexp(0, -m) + (1 - y) * np.logaddexp(0, m)
    return T(loss.sum(), (margin,), lambda g: (g * (logistic(m) * (positive_weight * y + 1 - y) - positive_weight * y),))
