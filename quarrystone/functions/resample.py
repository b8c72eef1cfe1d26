"""General resizing along any number of axes: outputs look at a field of view of the input around where their centre falls, weighted by a kernel.

An axis is a matrix of weights, or, where its factor is a small fraction, a bank of filters: with a factor of p / q every p-th output has the same
weights q inputs further on, so p filters serve all outputs. Both give the same values.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from fractions import Fraction

import numpy as np

EPS = float(np.finfo(np.float32).eps)


def _cubic(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    return np.where(a <= 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a <= 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0.0))


def _lanczos(lobes: int) -> Callable[[np.ndarray], np.ndarray]:
    # EPS above and below makes the centre 1
    return lambda x: np.where(np.abs(x) < lobes, (np.sin(math.pi * x) * np.sin(math.pi * x / lobes) + EPS) / (math.pi**2 * x**2 / lobes + EPS), 0.0)


#: Kernels, and the width of what they cover.
KERNELS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {
    "cubic": (_cubic, 4.0),
    "lanczos2": (_lanczos(2), 4.0),
    "lanczos3": (_lanczos(3), 6.0),
    "linear": (lambda x: np.maximum(1 - np.abs(x), 0.0), 2.0),
    "box": (lambda x: (np.abs(x) <= 1).astype(float), 1.0),
}


def sizes_and_factors(shape: Sequence[int], factors: float | Sequence[float] | None = None, out: Sequence[int] | None = None) -> tuple[list[int], list[float]]:
    """Sizes and factors of all axes; one factor is that of the first two. Given sizes decide, and given factors beside them say where centres fall."""
    if factors is None and out is None:
        raise ValueError("give factors or sizes")
    n = len(shape)
    if factors is None:
        factors = [b / a for a, b in zip(shape, out, strict=False)]
    elif not isinstance(factors, Sequence):
        factors = [factors, factors]
    factors = [float(f) for f in factors] + [1.0] * (n - len(factors))
    sizes = [*(out or [math.ceil(f * a) for f, a in zip(factors, shape, strict=True)])]
    return sizes + list(shape[len(sizes) :]), factors


def field_of_view(n_in: int, n_out: int, factor: float, kernel: str = "cubic", antialias: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, weights), each (n_out, taps): which inputs, also outside 0..n_in-1, an output looks at. Weights sum to 1, or are all 0."""
    f, width = KERNELS[kernel]
    stretch = min(factor, 1.0) if antialias else 1.0
    centre = np.arange(n_out) / factor + (n_in - 1) / 2 - (n_out - 1) / (2 * factor)
    support = width / stretch
    inputs = np.ceil(centre - support / 2 - EPS).astype(int)[:, None] + np.arange(math.ceil(support - EPS))
    weights = stretch * f(stretch * (centre[:, None] - inputs))
    total = weights.sum(1, keepdims=True)
    return inputs, weights / np.where(total == 0, 1, total)


def folded(at: np.ndarray, n: int, pad: str) -> tuple[np.ndarray, np.ndarray]:
    """(inputs inside, whether they count) of inputs that may be outside: `constant` (0), `edge`, `reflect` (ends once), `symmetric` (ends twice)."""
    if pad == "constant":
        return np.clip(at, 0, n - 1), (at >= 0) & (at < n)
    if pad == "edge":
        return np.clip(at, 0, n - 1), np.ones(at.shape, bool)
    if pad not in ("reflect", "symmetric"):
        raise ValueError(f"no way of padding named {pad}")
    period = max(2 * (n - 1), 1) if pad == "reflect" else 2 * n
    inside = at % period
    return np.minimum(inside, period - inside if pad == "reflect" else period - 1 - inside) if n > 1 else np.zeros_like(at), np.ones(at.shape, bool)


@functools.lru_cache(maxsize=256)
def axis_matrix(n_in: int, n_out: int, factor: float, kernel: str = "cubic", antialias: bool = True, pad: str = "constant") -> np.ndarray:
    """(n_out, n_in)."""
    inputs, weights = field_of_view(n_in, n_out, factor, kernel, antialias)
    at, counts = folded(inputs, n_in, pad)
    out = np.zeros((n_out, n_in))
    np.add.at(out, (np.arange(n_out)[:, None], at), weights * counts)
    return out


def small_fraction(factor: float, most: int = 10, tolerance: float = EPS) -> Fraction | None:
    """The factor as p / q with p at most `most`, if it is one."""
    turned = Fraction(1 / factor).limit_denominator(most)
    found = Fraction(turned.denominator, turned.numerator) if turned else None
    return found if found is not None and abs(found - factor) < tolerance else None


def filter_bank(x: np.ndarray, n_out: int, factor: Fraction, kernel: str = "cubic", antialias: bool = True, pad: str = "constant") -> np.ndarray:
    """The last axis by p filters with a stride of q; each output is a window of the padded axis times its filter."""
    n_in, p, q = x.shape[-1], factor.numerator, factor.denominator
    centre_out = field_of_view(n_in, n_out, float(factor), kernel, antialias)
    out = np.empty((*x.shape[:-1], n_out))
    for phase in range(min(p, n_out)):
        first, weights = centre_out[0][phase, 0], centre_out[1][phase]
        many = -(-(n_out - phase) // p)
        at, counts = folded(first + np.arange((many - 1) * q + len(weights)), n_in, pad)
        line = np.where(counts, x[..., at], 0.0)
        windows = np.lib.stride_tricks.sliding_window_view(line, len(weights), axis=-1)[..., ::q, :]
        out[..., phase::p] = windows @ weights
    return out


def resize(x: np.ndarray, factors: float | Sequence[float] | None = None, out: Sequence[int] | None = None, kernel: str = "cubic", antialias: bool = True, by_filters: bool | Sequence[bool] = False, most: int = 10, pad: str = "constant") -> np.ndarray:
    """x along all axes whose factor isn't 1, those that shrink most first."""
    sizes, found = sizes_and_factors(x.shape, factors, out)
    filters = list(by_filters) + [False] * (x.ndim - len(by_filters)) if isinstance(by_filters, Sequence) else [by_filters] * x.ndim
    for axis in sorted(range(x.ndim), key=lambda k: found[k]):
        if found[axis] == 1:
            continue
        moved = np.moveaxis(x, axis, -1)
        fraction = small_fraction(found[axis], most) if filters[axis] else None
        if fraction is not None:
            moved = filter_bank(moved, sizes[axis], fraction, kernel, antialias, pad)
        else:
            moved = moved @ axis_matrix(moved.shape[-1], sizes[axis], found[axis], kernel, antialias, pad).T
        x = np.moveaxis(moved, -1, axis)
    return x
