"""Numpy kernels on decoded images. Gray images are float64 in 0..255 unless said otherwise."""

from __future__ import annotations

import numpy as np

#: The standard luminance quantisation table of JPEG.
LUMA = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
])
_k = np.arange(8)
_DCT = np.sqrt(2 / 8) * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)
_DCT[0] = np.sqrt(1 / 8)


def decode(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """(H, W, 3) uint8 RGB from the bytes of Spark's image source, which are BGR rows."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(a, 3, axis=2)
    return a[:, :, 2::-1]


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114]))


def normalise(x: np.ndarray) -> np.ndarray:
    lo, hi = float(x.min()), float(x.max())
    return np.zeros_like(x, dtype=np.float64) if hi - lo < 1e-8 else (x - lo) / (hi - lo)


def _shift(x: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """x moved, with the border mirrored without repeating it."""
    p = np.pad(x, 1, mode="reflect") if min(x.shape) > 1 else np.pad(x, 1, mode="edge")
    return p[1 + dy : 1 + dy + x.shape[0], 1 + dx : 1 + dx + x.shape[1]]


def laplacian(g: np.ndarray) -> np.ndarray:
    return _shift(g, 0, 1) + _shift(g, 0, -1) + _shift(g, 1, 0) + _shift(g, -1, 0) - 4 * g


def sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = lambda d: _shift(g, -1, d) + 2 * _shift(g, 0, d) + _shift(g, 1, d)
    col = lambda d: _shift(g, d, -1) + 2 * _shift(g, d, 0) + _shift(g, d, 1)
    return row(1) - row(-1), col(1) - col(-1)


def gaussian(g: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma + 0.5))
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    w /= w.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        p = np.pad(g, pad, mode="reflect" if g.shape[axis] > r else "edge")
        n = g.shape[axis]
        g = sum(w[k] * np.take(p, range(k, k + n), axis=axis) for k in range(2 * r + 1))
    return g


def tiles(g: np.ndarray, size: int) -> np.ndarray:
    """(rows, columns, size, size); the remainder is cropped. Raises if there is no whole tile."""
    r, c = g.shape[0] // size, g.shape[1] // size
    if r == 0 or c == 0:
        raise ValueError("image smaller than a tile")
    return g[: r * size, : c * size].reshape(r, size, c, size).swapaxes(1, 2)


def brightness(g: np.ndarray) -> dict:
    return {"brightness_mean": float(g.mean()), "brightness_std": float(g.std()), "sharpness": float(laplacian(g).var())}


def blur_tiles(g: np.ndarray, size: int = 64) -> dict:
    t = tiles(g, size)
    v = np.array([[laplacian(t[i, j]).var() for j in range(t.shape[1])] for i in range(t.shape[0])])
    return {"blur_mean": float(v.mean()), "blur_std": float(v.std()), "blur_min": float(v.min()), "blur_max": float(v.max())}


def entropy(g: np.ndarray) -> float:
    p = np.bincount(g.astype(np.uint8).ravel(), minlength=256) / g.size
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def edges(g: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edge mask: gradient maxima above high, grown along those above low."""
    gx, gy = sobel(g)
    m = np.abs(gx) + np.abs(gy)
    horizontal = np.abs(gx) >= np.abs(gy)
    ahead = np.where(horizontal, _shift(m, 0, 1), _shift(m, 1, 0))
    behind = np.where(horizontal, _shift(m, 0, -1), _shift(m, -1, 0))
    peak = (m > behind) & (m >= ahead)
    strong, weak = peak & (m > high), peak & (m > low)
    while True:
        grown = strong.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                grown |= _shift(strong.astype(np.uint8), dy, dx).astype(bool)
        grown &= weak
        if (grown == strong).all():
            return strong
        strong = grown


def text_ink(g: np.ndarray, block: int = 35, offset: float = 15) -> float:
    """Share of pixels darker than their surroundings, after opening."""
    dark = (g < gaussian(g, 0.3 * ((block - 1) * 0.5 - 1) + 0.8) - offset).astype(np.uint8)
    three = lambda x, f: f.reduce([_shift(x, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return float(three(three(dark, np.minimum), np.maximum).mean())


def skew(g: np.ndarray, votes: int = 130, cap: int = 200) -> dict:
    """Angle of the strongest straight lines, folded to +-45 degrees, and confidence."""
    ys, xs = np.nonzero(edges(g, 60, 140))
    lines: list[float] = []
    if len(ys):
        theta = np.deg2rad(np.arange(180))
        span = int(np.hypot(*g.shape)) + 1
        rho = np.rint(xs[:, None] * np.cos(theta) + ys[:, None] * np.sin(theta)).astype(int) + span
        acc = np.stack([np.bincount(rho[:, t], minlength=2 * span + 1) for t in range(180)], axis=1)
        r, t = np.nonzero(acc >= votes)
        for k in np.argsort(-acc[r, t], kind="stable")[:cap]:
            a = float(t[k]) - 90
            lines.append(a - 90 if a > 45 else a + 90 if a < -45 else a)
    if len(lines) < 5:
        return {"skew_angle": 0.0, "skew_confidence": 0.0}
    med = float(np.median(lines))
    return {"skew_angle": med, "skew_confidence": float(np.clip(1 - np.median(np.abs(np.array(lines) - med)) / 10, 0, 1))}


def jpeg_roundtrip(channel: np.ndarray, quality: int) -> np.ndarray:
    """A channel after block transform, quantisation at the quality, and back. Stands in for a codec."""
    q = np.clip((LUMA * (5000 / quality if quality < 50 else 200 - 2 * quality) + 50) // 100, 1, 255)
    h, w = channel.shape
    p = np.pad(channel, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2)
    c = np.rint(_DCT @ b @ _DCT.T / q) * q
    return np.clip(np.rint((_DCT.T @ c @ _DCT).swapaxes(1, 2).reshape(p.shape) + 128), 0, 255)[:h, :w]


def box_mean(x: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    s = np.pad(np.pad(x, ((r, size - 1 - r), (r, size - 1 - r)), mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / (size * size)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 8-connected regions, 0 outside, by spreading the smallest label."""
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 2
    while True:
        low = np.where(mask, lab, big)
        low = np.minimum.reduce([np.pad(low, 1, constant_values=big)[1 + a : 1 + a + mask.shape[0], 1 + b : 1 + b + mask.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)])
        new = np.where(mask, low, 0)
        flat = new.ravel()
        new = np.where(mask, flat[np.maximum(new - 1, 0)], 0)  # jump to the label's own label
        if (new == lab).all():
            return lab
        lab = new


#: Fixed values below: qualities, limits, scales and the percentile of the error levels.
def mela(rgb: np.ndarray, percentile: float = 99.3, min_area: int = 120, top: int = 6) -> dict:
    """Error levels over several qualities, their local variance, and the suspicious regions."""
    x = rgb.astype(np.float64)
    worst, used = np.zeros(x.shape[:2]), []
    for q in range(95, 65, -5):
        worst = np.maximum(worst, np.mean([np.abs(x[..., c] - jpeg_roundtrip(x[..., c], q)) for c in range(3)], axis=0))
        used.append(q)
        if (normalise(worst) > 0.65).mean() > 0.12:
            break
    n = normalise(worst)
    var = np.max([np.maximum(box_mean(n * n, s) - box_mean(n, s) ** 2, 0) for s in (8, 16, 32)], axis=0)
    gx, gy = sobel(gray(rgb))
    var = var * (1 - 0.55 * normalise(np.hypot(gx, gy)))
    threshold = float(np.percentile(var, percentile))
    mask = var >= threshold
    lab = components(mask)
    rois = []
    for k in np.unique(lab[lab > 0]):
        ys, xs = np.nonzero(lab == k)
        if len(ys) >= min_area:
            y0, y1, x0, x1 = int(ys.min()), int(ys.max()) + 1, int(xs.min()), int(xs.max()) + 1
            rois.append({"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0, "score": float(var[y0:y1, x0:x1].mean())})
    rois.sort(key=lambda r: -r["score"])
    return {"suspicious_ratio": float(mask.mean()), "mela_peak": float(var.max()), "used_qualities": used, "rois": rois[:top]}


def noise(g: np.ndarray, size: int = 64, sigma: float = 1.2) -> np.ndarray:
    """Mean absolute residual of each tile."""
    return tiles(np.abs(g - gaussian(g, sigma)), size).mean(axis=(2, 3))


def noise_summary(g: np.ndarray) -> dict:
    m = noise(g)
    z = (m - m.mean()) / (m.std() + 1e-6)
    return {"max_tile_z": float(z.max()), "mean_abs_resid": float(m.mean()), "std_tile": float(m.std())}


def upsample(tile_values: np.ndarray, size: int, shape: tuple[int, int]) -> np.ndarray:
    """Tile values spread over the pixels, zero beyond the tiles, negative ones at zero, scaled to 1."""
    big = np.zeros(shape)
    up = np.kron(np.maximum(tile_values, 0), np.ones((size, size)))[: shape[0], : shape[1]]
    big[: up.shape[0], : up.shape[1]] = up
    return big / big.max() if big.max() > 0 else big


def overlay(rgb: np.ndarray, heat: np.ndarray, strength: float = 0.5) -> np.ndarray:
    """The image with a red veil where the map (0..1) is high."""
    w = (np.clip(heat, 0, 1) * strength)[..., None]
    return np.rint(rgb * (1 - w) + np.array([255.0, 0, 0]) * w).astype(np.uint8)


def crop(rgb: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return rgb[max(y, 0) : y + h, max(x, 0) : x + w]


def draw_boxes(rgb: np.ndarray, boxes: list[tuple[int, int, int, int]], colour: tuple[int, int, int] = (255, 0, 0)) -> np.ndarray:
    out = rgb.copy()
    for x, y, w, h in boxes:
        out[y, x : x + w] = out[min(y + h, out.shape[0]) - 1, x : x + w] = colour
        out[y : y + h, x] = out[y : y + h, min(x + w, out.shape[1]) - 1] = colour
    return out


def keypoints(g: np.ndarray, limit: int = 3500, threshold: float = 12, bits: int = 256, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of corner-like points and packed binary descriptors of the patch around each."""
    gx, gy = sobel(gaussian(g, 1.0))
    a, b, c = (box_mean(v, 5) for v in (gx * gx, gy * gy, gx * gy))
    score = np.minimum(a, b) - np.abs(c)
    peak = (score > threshold**2) & (score >= np.maximum.reduce([_shift(score, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    peak[:16], peak[-16:], peak[:, :16], peak[:, -16:] = False, False, False, False
    ys, xs = np.nonzero(peak)
    best = np.argsort(-score[ys, xs], kind="stable")[:limit]
    ys, xs = ys[best], xs[best]
    d = np.random.default_rng(seed).integers(-15, 16, (bits, 4))
    s = gaussian(g, 2.0)
    desc = s[ys[:, None] + d[:, 0], xs[:, None] + d[:, 1]] < s[ys[:, None] + d[:, 2], xs[:, None] + d[:, 3]] if len(ys) else np.empty((0, bits), bool)
    return np.stack([xs, ys], axis=1), np.packbits(desc, axis=1)


def self_matches(points: np.ndarray, desc: np.ndarray, ratio: float = 0.75, block: int = 512) -> np.ndarray:
    """(x, y, tx, ty) of points whose nearest other descriptor is clearly nearer than the next; in blocks of rows."""
    out = []
    count = np.array([bin(i).count("1") for i in range(256)], np.uint16)
    for lo in range(0, len(desc), block):
        dist = count[desc[lo : lo + block, None, :] ^ desc[None, :, :]].sum(axis=2)
        dist[np.arange(dist.shape[0]), lo + np.arange(dist.shape[0])] = np.iinfo(np.uint16).max
        if dist.shape[1] < 3:
            break
        near = np.argpartition(dist, 2, axis=1)[:, :2]
        d = np.take_along_axis(dist, near, axis=1)
        order = np.argsort(d, axis=1)
        d, near = np.take_along_axis(d, order, axis=1), np.take_along_axis(near, order, axis=1)
        ok = d[:, 0] < ratio * d[:, 1]
        out.append(np.concatenate([points[lo : lo + block][ok], points[near[ok, 0]]], axis=1))
    return np.concatenate(out) if out else np.empty((0, 4), int)
