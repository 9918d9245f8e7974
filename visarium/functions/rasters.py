"""Raster work on whole frames (numpy arrays height x width x channels): encoding, resizing, blur, drawing, motion.

Resizing and blur are linear maps along each side, given by weight matrices; visarium.functions.images applies the same
matrices to tiles as expressions.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: 3 x 5 glyphs, a row in three bits from the top, for what is written on frames.
GLYPHS = {
    "0": 0b111101101101111, "1": 0b010110010010111, "2": 0b111001111100111, "3": 0b111001111001111, "4": 0b101101111001001,
    "5": 0b111100111001111, "6": 0b111100111101111, "7": 0b111001010010010, "8": 0b111101111101111, "9": 0b111101111001111,
    "a": 0b010101111101101, "b": 0b110101110101110, "c": 0b011100100100011, "d": 0b110101101101110, "e": 0b111100110100111,
    "f": 0b111100110100100, "g": 0b011100101101011, "h": 0b101101111101101, "i": 0b111010010010111, "j": 0b001001001101010,
    "k": 0b101101110101101, "l": 0b100100100100111, "m": 0b101111111101101, "n": 0b110101101101101, "o": 0b010101101101010,
    "p": 0b110101110100100, "q": 0b010101101110011, "r": 0b110101110101101, "s": 0b011100010001110, "t": 0b111010010010010,
    "u": 0b101101101101111, "v": 0b101101101101010, "w": 0b101101111111101, "x": 0b101101010101101, "y": 0b101101010010010,
    "z": 0b111001010100111, "_": 0b000000000000111, ":": 0b000010000010000, "-": 0b000000111000000,
}


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of grey or of blue, green, red pixels."""
    grey = pixels.ndim == 2 or pixels.shape[2] == 1
    x = np.ascontiguousarray(pixels.reshape(*pixels.shape[:2], -1) if grey else pixels[..., 2::-1], dtype=np.uint8)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((len(x), 1), np.uint8), x.reshape(len(x), -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0 if grey else 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def resize_weights(size: int, to: int) -> np.ndarray:
    """to x size: shares of the source that each place covers where it shrinks, the two nearest centres where it grows."""
    out = np.zeros((to, size))
    if to < size:
        step = size / to
        for k in range(to):
            edges = np.clip(np.arange(size + 1), k * step, (k + 1) * step)
            out[k] = np.diff(edges) / step
        return out
    for k in range(to):
        at = min(max((k + 0.5) * size / to - 0.5, 0), size - 1)
        low = int(at)
        out[k, low] += 1 - (at - low)
        out[k, min(low + 1, size - 1)] += at - low
    return out


def blur_weights(size: int, kernel: int, sigma: float = 0) -> np.ndarray:
    """size x size: a normalised bell of odd length; edges mirror without repeating. Sigma 0 follows from the length."""
    sigma = sigma or 0.3 * ((kernel - 1) * 0.5 - 1) + 0.8
    reach = np.arange(kernel) - kernel // 2
    bell = np.exp(-(reach**2) / (2 * sigma * sigma))
    out, period = np.zeros((size, size)), max(2 * (size - 1), 1)
    for k in range(size):
        at = np.abs(k + reach) % period
        np.add.at(out[k], np.where(at >= size, period - at, at), bell / bell.sum())
    return out


def applied(pixels: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """rows x pixels x cols' of every channel, in doubles."""
    return np.einsum("yi,ij...,xj->yx...", rows, pixels.astype(float), cols, optimize=True)


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    return _bytes(applied(pixels, resize_weights(pixels.shape[0], height), resize_weights(pixels.shape[1], width)))


def blurred(pixels: np.ndarray, kernel: int, sigma: float = 0) -> np.ndarray:
    return _bytes(applied(pixels, blur_weights(pixels.shape[0], kernel, sigma), blur_weights(pixels.shape[1], kernel, sigma)))


def draw_box(pixels: np.ndarray, box: tuple[int, int, int, int], color: tuple[int, ...] = (0, 255, 0), thickness: int = 2) -> None:
    """A frame around left, top, right, bottom (both ends drawn), half of it outside; what is off the frame is left out."""
    y, x = np.arange(pixels.shape[0])[:, None], np.arange(pixels.shape[1])[None]
    left, top, right, bottom = box
    out, into = thickness // 2, thickness - thickness // 2
    outer = (x >= left - out) & (x <= right + out) & (y >= top - out) & (y <= bottom + out)
    inner = (x >= left + into) & (x <= right - into) & (y >= top + into) & (y <= bottom - into)
    pixels[outer & ~inner] = color


def draw_dot(pixels: np.ndarray, x: int, y: int, radius: int = 5, color: tuple[int, ...] = (0, 0, 255)) -> None:
    yy, xx = np.arange(pixels.shape[0])[:, None], np.arange(pixels.shape[1])[None]
    pixels[(xx - x) ** 2 + (yy - y) ** 2 <= radius * radius] = color


def draw_text(pixels: np.ndarray, text: str, left: int, bottom: int, color: tuple[int, ...] = (0, 255, 0), scale: int = 2) -> None:
    """Small letters and digits with their feet at a height; other signs leave a gap."""
    for k, sign in enumerate(text.lower()):
        bits = GLYPHS.get(sign, 0)
        for j in np.flatnonzero([bits >> (14 - i) & 1 for i in range(15)]).tolist():
            y, x = bottom - 5 * scale + j // 3 * scale, left + (4 * k + j % 3) * scale
            pixels[max(0, y) : max(0, y + scale), max(0, x) : max(0, x + scale)] = color


def quality(pixels: np.ndarray, file_bytes: int) -> float:
    """visarium.functions.images.face_quality of a crop of any size (blue, green, red)."""
    grey = np.floor(pixels.astype(float) @ [0.114, 0.587, 0.299] + 0.5) if pixels.ndim == 3 and pixels.shape[2] >= 3 else pixels.reshape(pixels.shape[:2]).astype(float)
    h, w = grey.shape
    rows, cols = np.abs(np.arange(-1, h + 1)), np.abs(np.arange(-1, w + 1))
    rows[-1], cols[-1] = max(h - 2, 0), max(w - 2, 0)
    p = grey[np.minimum(rows, h - 1)][:, np.minimum(cols, w - 1)]
    sharp = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey
    return float(0.3 * min(1, w * h / 10000) + 0.3 * min(1, sharp.var() / 1000) + 0.2 * grey.std() / 127.5 + 0.1 * (1 - abs(grey.mean() - 127.5) / 127.5) + 0.1 * min(1, file_bytes / 50000))


def _convolved(x: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with taps along an axis; edges repeat."""
    reach = len(taps) // 2
    pad = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in range(2)], mode="edge")
    n = x.shape[axis]
    return sum(w * pad.take(range(k, k + n), axis) for k, w in enumerate(taps))


def _polynomial(f: np.ndarray, reach: int = 5, sigma: float = 1.2) -> tuple[np.ndarray, ...]:
    """xx, xy, yy, x, y of the local quadratic fit of every pixel, weighed by a bell."""
    x = np.arange(-reach, reach + 1)
    g = np.exp(-(x**2) / (2 * sigma * sigma))
    g /= g.sum()
    s2, s4 = (g * x**2).sum(), (g * x**4).sum()
    down = [_convolved(f, g * x**k, 0) for k in range(3)]
    m = {(i, j): _convolved(down[j], g * x**i, 1) for i in range(3) for j in range(3) if i + j <= 2}
    inv = np.linalg.inv(np.array([[1, s2, s2], [s2, s4, s2 * s2], [s2, s2 * s2, s4]]))
    xx, yy = (inv[k, 0] * m[0, 0] + inv[k, 1] * m[2, 0] + inv[k, 2] * m[0, 2] for k in (1, 2))
    return xx, m[1, 1] / (s2 * s2), yy, m[1, 0] / s2, m[0, 1] / s2


def flow(before: np.ndarray, after: np.ndarray, levels: int = 3, window: int = 15, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Shift in x and in y of every pixel from one grey frame to the next: quadratic fits on a pyramid (Farnebäck, 2003)."""
    before, after = before.astype(float), after.astype(float)
    u = v = None
    for level in range(levels - 1, -1, -1):
        h, w = (max(1, round(n / 2**level)) for n in before.shape)
        if level and min(h, w) < 16:
            continue
        maps = [resize_weights(n, m) for n, m in zip(before.shape, (h, w), strict=True)]
        one, two = (_polynomial(applied(f, *maps)) for f in (before, after))
        if u is None:
            u, v = np.zeros((h, w)), np.zeros((h, w))
        else:
            grow = [resize_weights(n, m) for n, m in zip(u.shape, (h, w), strict=True)]
            u, v = applied(u, *grow) * (w / u.shape[1]), applied(v, *grow) * (h / v.shape[0])
        yy, xx = np.mgrid[:h, :w]
        box = np.full(window, 1 / window)
        for _ in range(rounds):
            x, y = np.clip(np.rint(xx + u), 0, w - 1).astype(int), np.clip(np.rint(yy + v), 0, h - 1).astype(int)
            du, dv = x - xx, y - yy
            a, b, c = ((p + q[y, x]) / 2 for p, q in zip(one[:3], two[:3], strict=True))
            b = b / 2
            bx, by = (0.5 * (p - q[y, x]) + s for p, q, s in zip(one[3:], two[3:], (a * du + b * dv, b * du + c * dv), strict=True))
            mean = lambda z: _convolved(_convolved(z, box, 0), box, 1)
            g11, g12, g22, h1, h2 = mean(a * a + b * b), mean(a * b + b * c), mean(b * b + c * c), mean(a * bx + b * by), mean(b * bx + c * by)
            det = g11 * g22 - g12 * g12 + 1e-6
            u, v = (g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det
    return u, v


def motion_center(before: np.ndarray, after: np.ndarray, least: float = 0.5) -> int | None:
    """Mean column of the pixels that move by more than this; None if none does."""
    u, v = flow(before, after)
    moving = np.nonzero(np.hypot(u, v) > least)[1]
    return int(moving.mean()) if len(moving) else None
