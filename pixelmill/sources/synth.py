"""Synthetic images whose shapes are known: signed distances sampled eight by eight a pixel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Shape = Callable[[np.ndarray, np.ndarray], np.ndarray]


def mulberry32(seed: int) -> Callable[[], float]:
    """The 32-bit generator of that name, as numbers from 0 to 1."""
    state = seed & 0xFFFFFFFF

    def following() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ state >> 15) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    return following


def disc(cx: float, cy: float, r: float) -> Shape:
    return lambda x, y: np.hypot(x - cx, y - cy) - r


def box(x0: float, y0: float, x1: float, y1: float) -> Shape:
    return lambda x, y: np.maximum(np.maximum(x0 - x, x - x1), np.maximum(y0 - y, y - y1))


def capsule(x0: float, y0: float, x1: float, y1: float, r: float) -> Shape:
    def distance(x, y):
        dx, dy = x1 - x0, y1 - y0
        t = np.clip(((x - x0) * dx + (y - y0) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
        return np.hypot(x - x0 - t * dx, y - y0 - t * dy) - r

    return distance


def coverage(shape: Shape, w: int, h: int, samples: int = 8) -> np.ndarray:
    at = (np.arange(w * samples) + 0.5) / samples, (np.arange(h * samples) + 0.5) / samples
    inside = shape(*np.meshgrid(*at)) <= 0
    return inside.reshape(h, samples, w, samples).mean((1, 3))


def paint(w: int, h: int, ground, *layers) -> np.ndarray:
    """Opaque image of (shape, colour) over a ground."""
    out = np.ones((h, w, 3)) * ground
    for shape, colour in layers:
        c = coverage(shape, w, h)[..., None]
        out = out * (1 - c) + np.array(colour) * c
    return np.dstack([np.floor(out + 0.5), np.full((h, w), 255.0)])


def circle(size: int = 64, r: float = 20) -> np.ndarray:
    return paint(size, size, 255, (disc(size / 2, size / 2, r), (0, 0, 0)))


def diagonal(size: int = 64, width: float = 1.5) -> np.ndarray:
    return paint(size, size, 255, (capsule(8, size * 0.7, size - 8, size * 0.3, width / 2), (0, 0, 0)))


def glyph(size: int = 48) -> np.ndarray:
    s = size / 48
    ring = lambda x, y: np.maximum(disc(22 * s, 24 * s, 14 * s)(x, y), -disc(22 * s, 24 * s, 9 * s)(x, y))
    both = lambda x, y: np.minimum(ring(x, y), box(33 * s, 8 * s, 38 * s, 40 * s)(x, y))
    return paint(size, size, 255, (both, (0, 0, 0)))


def three_shapes(size: int = 96) -> np.ndarray:
    s = size / 96
    return paint(size, size, (0xF2, 0xE8, 0xD5), (disc(34 * s, 36 * s, 22 * s), (0x2A, 0x6F, 0x97)), (box(46 * s, 50 * s, 84 * s, 84 * s), (0xE0, 0x7A, 0x5F)))


def sprite(size: int = 32, seed: int = 1) -> np.ndarray:
    nxt, out = mulberry32(seed), np.zeros((size, size, 4))
    colours = [[int(nxt() * 256) for _ in range(3)] for _ in range(6)]
    for _ in range(25):
        w, h = 2 + int(nxt() * 5), 2 + int(nxt() * 5)
        x, y = int(nxt() * (size - w)), int(nxt() * (size - h))
        out[y: y + h, x: x + w] = [*colours[int(nxt() * 6)], 255]
    return out


def replicate(img: np.ndarray, k: int) -> np.ndarray:
    return img.repeat(k, 0).repeat(k, 1)


def square(size: int = 64, side: int = 16) -> np.ndarray:
    a = (size - side) // 2
    out = np.full((size, size, 4), 255.0)
    out[a: a + side, a: a + side, :3] = 0
    return out


def chessboard(cells: int = 8, cell: int = 12) -> np.ndarray:
    y, x = np.mgrid[: cells * cell, : cells * cell] // cell
    v = np.where((x + y) % 2, 255.0, 204.0)
    return np.dstack([v, v, v, np.full(v.shape, 255.0)])


def linear_panel(size: int = 128) -> np.ndarray:
    """A rectangle with a ramp from left to right on white."""
    out = np.full((size, size, 4), 255.0)
    a, b = size // 8, size - size // 8
    t = (np.arange(a, b) + 0.5 - a) / (b - a)
    out[a:b, a:b, :3] = np.stack([40 + 180 * t, 90 + 0 * t, 220 - 160 * t], -1)
    out[..., :3] = np.floor(out[..., :3] + 0.5)
    return out


def radial_disc(size: int = 128) -> np.ndarray:
    y, x = np.mgrid[:size, :size] + 0.5
    t = np.clip(np.hypot(x - 60 * size / 128, y - 66 * size / 128) / (48 * size / 128), 0, 1)[..., None]
    inside = coverage(disc(60 * size / 128, 66 * size / 128, 48 * size / 128), size, size)[..., None]
    colour = np.array([250, 220, 60]) * (1 - t) + np.array([180, 30, 60]) * t
    return np.dstack([np.floor(255 * (1 - inside) + colour * inside + 0.5), np.full((size, size), 255.0)])


def noisy(img: np.ndarray, amount: int = 3, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = img.copy()
    out[..., :3] = np.clip(out[..., :3] + rng.integers(-amount, amount + 1, out[..., :3].shape), 0, 255)
    return out


FIXTURES: dict[str, Callable[..., np.ndarray]] = {f.__name__: f for f in (circle, diagonal, glyph, three_shapes, sprite, square, chessboard, linear_panel, radial_disc)}


def build(name: str) -> np.ndarray:
    """Image of a fixture, given by name or name:argument."""
    kind, _, argument = name.partition(":")
    return FIXTURES[kind](int(argument)) if argument else FIXTURES[kind]()
