"""Texture features of series drawn as small square images.

An image is a flat array of size x size pixels on the row of its series: pixel
(y, x) sits at y * size + x.  The size is a fixed parameter, so the cost per
series is constant and nothing is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame

from outlane.operators.prep import array_udf

EPS = 1e-6


def _resized(x: np.ndarray, size: int) -> np.ndarray:
    """Rows resampled to ``size`` points; rows of that size stay as they are."""
    if x.shape[1] == size:
        return x
    low, high, share = _between(x.shape[1], size)
    return x[:, low] + (x[:, high] - x[:, low]) * share


def _pairs(x: np.ndarray, pixel) -> np.ndarray:
    """Every pair (value at y, value at x) of each row, as flat pixels."""
    return pixel(x[:, :, None], x[:, None, :]).reshape(len(x), -1)


def _image(values, work) -> Column | np.ndarray:
    """A column of images of a column of arrays; of a matrix of rows the matrix."""
    return np.asarray(work(values)) if isinstance(values, np.ndarray) else array_udf(work, values)


def _angles(x: np.ndarray, size: int) -> np.ndarray:
    x = _resized(x, size)
    low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    return np.arccos(np.clip(2.0 * (x - low) / (high - low + EPS) - 1.0, -1.0, 1.0))


def gasf(values, size: int) -> Column:
    """cos(phi_y + phi_x) of the series rescaled to [-1, 1]."""
    return _image(values, lambda x: _pairs(_angles(x, size), lambda a, b: np.cos(a + b)))


def gadf(values, size: int) -> Column:
    """sin(phi_y - phi_x)."""
    return _image(values, lambda x: _pairs(_angles(x, size), lambda a, b: np.sin(a - b)))


def transition_field(values, size: int, bins: int = 8) -> Column:
    """Transition probability between the quantile bins of two points."""
    def work(x: np.ndarray) -> np.ndarray:
        x, n = _resized(x, size), len(x)
        edges = np.quantile(x, np.arange(1, bins) / bins, axis=1).T
        state = (edges[:, None, :] <= x[:, :, None]).sum(axis=2)
        moves = state[:, :-1] * bins + state[:, 1:] + bins * bins * np.arange(n)[:, None]
        count = np.bincount(moves.ravel(), minlength=n * bins * bins).reshape(n, bins, bins) + 1e-3
        share = count / count.sum(axis=2, keepdims=True)
        return share[np.arange(n)[:, None, None], state[:, :, None], state[:, None, :]].reshape(n, -1)
    return _image(values, work)


def recurrence(values, size: int, quantiles=(0.75,)) -> Column:
    """exp(-|x_y - x_x| / scale), averaged over distance percentiles."""
    def work(x: np.ndarray) -> np.ndarray:
        far = _pairs(_resized(x, size), lambda a, b: np.abs(a - b))
        return sum(np.exp(-far / (np.quantile(far, q, axis=1)[:, None] + EPS)) for q in quantiles) / len(quantiles)
    return _image(values, work)


def multiscale_recurrence(values, size: int) -> Column:
    return recurrence(values, size, (0.5, 0.75, 0.9))


def _picture(rows: np.ndarray, size: int) -> np.ndarray:
    """Flat pixels on [0, 1], darkest to brightest of each series."""
    flat = rows.reshape(-1, size * size)
    flat = flat - flat.min(axis=1, keepdims=True)
    return flat / (flat.max(axis=1, keepdims=True) + EPS)


def _between(have: int, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linear resampling of ``have`` points: lower point, upper point, share of
    the upper one."""
    place = np.linspace(0, have - 1, want)
    low = np.minimum(place.astype(int), max(have - 2, 0))
    return low, np.minimum(low + 1, have - 1), place - low


def _in_pieces(x: np.ndarray, work, rows: int = 256) -> list:
    return [row for i in range(0, len(x), rows) for row in work(x[i:i + rows])]


def spectrogram(values, size: int) -> Column:
    """Short-time spectrum as an image.

    Frames of 2 * size points (8 at least), half overlapping, under a Hann
    window; one product with the Fourier matrix of the wanted frequencies gives
    all frames of a batch, and time is resampled to the image's width.
    """
    def work(x: np.ndarray) -> list:
        n = x.shape[1]
        frame = max(8, min(n, 2 * size))
        begin = np.arange(0, max(1, n - frame + 1), frame // 2)
        points = np.minimum(begin[:, None] + np.arange(frame), n - 1)  # the last point stands in past the end
        wanted = np.round(np.linspace(0, frame // 2, size))
        turn = 2 * np.pi * np.outer(np.arange(frame), wanted) / frame
        fourier = np.hanning(frame)[:, None] * np.exp(-1j * turn)
        low, high, share = _between(len(begin), size)

        def piece(part):
            heard = np.log1p(np.abs(part[:, points] @ fourier))  # series, frame, frequency
            image = heard[:, low] * (1 - share)[:, None] + heard[:, high] * share[:, None]
            return _picture(image.transpose(0, 2, 1), size)
        return _in_pieces(x, piece)
    return _image(values, work)


def wavelet_bank(length: int, size: int) -> np.ndarray:
    """[scale, place, point]: cosine wavelets under a Gaussian, of no mean and
    unit energy, on ``size`` geometric scales from 2 to size / 2 and around every
    place of a series."""
    scale = np.geomspace(2.0, max(4.0, size / 2), size)[:, None, None]
    reach = np.clip(np.ceil(6 * scale), 4, length // 2)

    def shape(offset):
        inside = np.abs(offset) <= reach
        return np.where(inside, np.exp(-(offset / scale) ** 2 / 2) * np.cos(5 * offset / scale), 0), inside

    support = np.arange(-(length // 2), length // 2 + 1)[None, None, :]
    wave, inside = shape(support)
    mean = wave.sum(axis=2, keepdims=True) / inside.sum(axis=2, keepdims=True)
    energy = np.sqrt((np.where(inside, wave - mean, 0) ** 2).sum(axis=2, keepdims=True)) + EPS
    at = np.arange(length)
    wave, inside = shape((at[:, None] - at[None, :])[None])
    return np.where(inside, wave - mean, 0) / energy


def scalogram(values, size: int) -> Column:
    """Wavelet response as an image: one product with a fixed bank of wavelets,
    at the places that the image's columns lie between."""
    def work(x: np.ndarray) -> list:
        length = max(size * 2, 96)
        low, high, share = _between(x.shape[1], length)
        left, right, weight = _between(length, size)
        bank = wavelet_bank(length, size)
        bank = np.concatenate([bank[:, left], bank[:, right]], axis=1).reshape(-1, length).T

        def piece(part):
            even = part[:, low] * (1 - share) + part[:, high] * share
            heard = np.abs((even - even.mean(axis=1, keepdims=True)) @ bank).reshape(len(part), size, 2, size)
            return _picture(np.log1p(heard[:, :, 0] * (1 - weight) + heard[:, :, 1] * weight), size)
        return _in_pieces(x, piece)
    return _image(values, work)


KINDS = {"gasf": gasf, "gadf": gadf, "mtf": transition_field, "rp": recurrence, "multi_rp": multiscale_recurrence,
         "spectrogram": spectrogram, "scalogram": scalogram}


# ---- texture ----------------------------------------------------------------

def _histogram(slot: np.ndarray, width: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Of each row the number (or weight) of each slot."""
    n = len(slot)
    at = (slot + width * np.arange(n).reshape(n, *[1] * (slot.ndim - 1))).ravel()
    return np.bincount(at, None if weight is None else weight.ravel(), minlength=n * width).reshape(n, width)


def hog(image, size: int, orientations: int = 8, cells: int = 4) -> Column:
    """Gradient orientation histogram per cell, L2-normalised."""
    cell_of = np.searchsorted([int(i * size / cells) for i in range(1, cells)], np.arange(size), side="right")

    def work(px: np.ndarray) -> np.ndarray:
        px = px.reshape(-1, size, size)
        gx, gy = np.zeros_like(px), np.zeros_like(px)
        gx[:, :, 1:], gy[:, 1:] = px[:, :, 1:] - px[:, :, :-1], px[:, 1:] - px[:, :-1]
        turn = np.arctan2(gy, gx)
        angle = turn - np.floor(turn / math.pi) * math.pi
        slot = np.clip(np.floor(angle / math.pi * orientations), 0, orientations - 1).astype(np.int64)
        cell = cell_of[:, None] * cells + cell_of[None, :]
        found = _histogram(cell * orientations + slot, cells * cells * orientations, np.sqrt(gx * gx + gy * gy))
        return found / (np.sqrt((found * found).sum(axis=1, keepdims=True)) + EPS)
    return _image(image, work)


# (dy, dx) of the eight neighbours, clockwise from the upper left.
NEIGHBOURS = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))


def lbp(image, size: int) -> Column:
    """Share of each 8-neighbour comparison code among the inner pixels."""
    def work(px: np.ndarray) -> np.ndarray:
        px = px.reshape(-1, size, size)
        inner = px[:, 1:-1, 1:-1]
        code = sum((px[:, 1 + dy:size - 1 + dy, 1 + dx:size - 1 + dx] >= inner).astype(np.int64) << b for b, (dy, dx) in enumerate(NEIGHBOURS))
        return _histogram(code, 256) / ((size - 2) ** 2 + EPS)
    return _image(image, work)


# (dy, dx) of the co-occurrence offsets.
OFFSETS = ((0, 1), (1, 0), (1, 1), (1, -1))


def glcm(image, size: int, levels: int = 8) -> Column:
    """Co-occurrence statistics per offset: contrast, dissimilarity,
    homogeneity, second moment, energy, entropy, correlation."""
    y, x = np.indices((levels, levels))
    gap = np.abs(y - x)

    def work(px: np.ndarray) -> np.ndarray:
        low, high = px.min(axis=1, keepdims=True), px.max(axis=1, keepdims=True)
        q = np.clip(np.floor((px - low) / (high - low + EPS) * levels), 0, levels - 1).astype(np.int64).reshape(-1, size, size)
        out = []
        for dy, dx in OFFSETS:
            one, other = q[:, :size - dy, max(0, -dx):size - max(0, dx)], q[:, dy:, max(0, dx):size - max(0, -dx)]
            both = _histogram(one * levels + other, levels * levels).reshape(-1, levels, levels).astype(float)
            both = both + both.transpose(0, 2, 1)
            p = both / (both.sum(axis=(1, 2), keepdims=True) + EPS)
            total = lambda f: (f * p).sum(axis=(1, 2))  # noqa: B023, E731
            my, mx = total(y)[:, None, None], total(x)[:, None, None]
            sy, sx = np.sqrt(total((y - my) ** 2)) + EPS, np.sqrt(total((x - mx) ** 2)) + EPS
            second = total(p)
            out += [total(gap * gap), total(gap), total(1 / (1.0 + gap)), second, np.sqrt(second), -total(np.log(p + EPS)), total((y - my) * (x - mx)) / (sy * sx)]
        return np.stack(out, axis=1)
    return _image(image, work)


TEXTURES = {"raw": lambda image, size: image, "hog": hog, "lbp": lbp, "glcm": glcm}


def image_features(rows: DataFrame, kinds: list[str], size: int, texture: str = "raw") -> DataFrame:
    """Texture vectors of several image kinds, concatenated.

    Images live in the worker only, for the rows of one slice.
    """
    def work(x: np.ndarray) -> np.ndarray:
        return np.concatenate([TEXTURES[texture](KINDS[kind](x, size), size) for kind in kinds], axis=1)

    return rows.withColumn("vec", array_udf(work, "values"))
