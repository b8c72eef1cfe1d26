"""General resizing: by loops, both ways alike, axes, sizes and padding."""

import math
from fractions import Fraction

import numpy as np
import pytest

from quarrystone.functions import resample as r


def plain(line, n_out, factor, kernel, antialias, pad):
    f, width = r.KERNELS[kernel]
    s = factor if antialias and factor < 1 else 1.0
    padded = np.pad(line, 40, mode=pad)
    out = []
    for o in range(n_out):
        centre = o / factor + (len(line) - 1) / 2 - (n_out - 1) / (2 * factor)
        left = math.ceil(centre - width / s / 2 - r.EPS)
        taps = range(left, left + math.ceil(width / s - r.EPS))
        w = [s * float(f(np.array(s * (centre - t)))) for t in taps]
        out.append(sum(a * padded[t + 40] for a, t in zip(w, taps, strict=True)) / (sum(w) or 1))
    return np.array(out)


@pytest.mark.parametrize("kernel", sorted(r.KERNELS))
@pytest.mark.parametrize("pad", ["constant", "edge", "reflect", "symmetric"])
def test_both_ways_against_loops(kernel, pad):
    line = np.random.default_rng(1).random(23)
    for factor, antialias in ((Fraction(3, 4), True), (Fraction(1, 3), True), (Fraction(5, 2), True), (Fraction(2, 5), False), (Fraction(7, 3), True)):
        n_out = math.ceil(factor * 23)
        want = plain(line, n_out, float(factor), kernel, antialias, pad)
        assert np.allclose(r.axis_matrix(23, n_out, float(factor), kernel, antialias, pad) @ line, want, atol=1e-9)
        assert np.allclose(r.filter_bank(line, n_out, factor, kernel, antialias, pad), want, atol=1e-9)


def test_axes_and_sizes():
    x = np.random.default_rng(2).random((12, 9, 5))
    for by in (False, True, [True, False]):
        got = r.resize(x, [0.5, 4 / 3], by_filters=by, pad="reflect")
        rows, columns = r.axis_matrix(12, 6, 0.5, pad="reflect"), r.axis_matrix(9, 12, 4 / 3, pad="reflect")
        assert got.shape == (6, 12, 5) and np.allclose(got, np.einsum("ah,hwc,bw->abc", rows, x, columns))
    assert r.resize(x, 2).shape == (24, 18, 5) and r.resize(x, out=(7, 7)).shape == (7, 7, 5)
    assert r.resize(x, [1, 1, 0.4]).shape == (12, 9, 2)
    assert np.array_equal(r.resize(x, 1), x)
    with pytest.raises(ValueError):
        r.resize(x)
    with pytest.raises(ValueError):
        r.resize(x, 2, pad="wrap")


def test_fractions():
    assert r.small_fraction(0.75) == Fraction(3, 4) and r.small_fraction(4 / 3) == Fraction(4, 3)
    assert r.small_fraction(math.pi) is None and r.small_fraction(11 / 12) is None


def test_what_is_kept():
    line = np.arange(20.0)
    assert np.allclose(r.axis_matrix(20, 40, 2.0, pad="edge") @ np.ones(20), 1)
    assert np.allclose((r.axis_matrix(20, 40, 2.0) @ line)[6:-6], np.arange(6, 34) / 2 - 0.25)
    inputs, weights = r.field_of_view(10, 5, 0.5, "linear")
    assert inputs.shape == weights.shape == (5, 4) and np.allclose(weights.sum(1), 1)
