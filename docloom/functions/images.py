"""Page images as arrays: what comes before OCR, in numpy, for use behind the boundary (``sources.boundary``).

Images are uint8 arrays (rows, columns) or (rows, columns, 3). Nothing here decodes files: an OCR engine's own library does.
"""

from __future__ import annotations

import numpy as np

# Window and offset of the threshold; least area of a component that counts as a token.
WINDOW, OFFSET, LEAST_AREA = 31, 15, 20


def gray(image: np.ndarray) -> np.ndarray:
    if image is None or image.size == 0:
        raise ValueError("an image is needed")
    return image if image.ndim == 2 else np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def box_mean(image: np.ndarray, size: int) -> np.ndarray:
    """Mean of the size * size neighbourhood, edges repeated, by summed areas."""
    half = size // 2
    padded = np.pad(image.astype(np.float64), half + 1, mode="edge")[:-1, :-1]
    sums = padded.cumsum(axis=0).cumsum(axis=1)
    h, w = image.shape
    return (sums[size : size + h, size : size + w] - sums[:h, size : size + w] - sums[size : size + h, :w] + sums[:h, :w]) / size**2


def threshold(image: np.ndarray, window: int = WINDOW, offset: int = OFFSET) -> np.ndarray:
    """255 where a pixel isn't darker than its neighbourhood's mean by more than offset, else 0."""
    return np.where(image > box_mean(image, window) - offset, 255, 0).astype(np.uint8)


def median(image: np.ndarray) -> np.ndarray:
    """Median of the 3 * 3 neighbourhood."""
    padded = np.pad(image, 1, mode="edge")
    h, w = image.shape
    return np.median(np.stack([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def equalized(image: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited equalisation by tiles, each tile with the map of its own clipped histogram."""
    out = np.empty_like(image)
    for rows in np.array_split(np.arange(image.shape[0]), tiles):
        for columns in np.array_split(np.arange(image.shape[1]), tiles):
            if len(rows) and len(columns):
                part = image[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
                counts = np.bincount(part.ravel(), minlength=256).astype(np.float64)
                most = max(1.0, clip * part.size / 256)
                spare = np.maximum(counts - most, 0).sum()
                curve = (np.minimum(counts, most) + spare / 256).cumsum() * 255 / part.size
                out[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] = np.rint(np.clip(curve, 0, 255)).astype(np.uint8)[part]
    return out


def turned(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """The image turned about its middle, counter-clockwise for positive angles, by the nearest pixel."""
    h, w = image.shape[:2]
    a = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w].astype(np.float64)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.rint(np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx).astype(int)
    sy = np.rint(np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(image, fill)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def skew(image: np.ndarray, most: float = 20.0, step: float = 0.5) -> float:
    """The angle by which the dark rows of a page are turned, where turning back makes their sums most uneven."""
    ink = np.argwhere(image < 128).astype(np.float64)
    if len(ink) < 2:
        return 0.0
    y, x = ink[:, 0] - image.shape[0] / 2, ink[:, 1] - image.shape[1] / 2

    def unevenness(degrees: float) -> float:
        a = np.deg2rad(degrees)
        rows = np.rint(y * np.cos(a) + x * np.sin(a)).astype(int)
        return float(np.square(np.bincount(rows - rows.min())).sum())

    return float(max(np.arange(-most, most + step, step), key=unevenness))


def deskewed(image: np.ndarray) -> tuple[np.ndarray, float]:
    angle = skew(image)
    return (turned(image, -angle) if angle else image), angle


def prepared(image: np.ndarray) -> np.ndarray:
    """Gray, smoothed, thresholded and straightened: a page as OCR likes it."""
    return deskewed(threshold(np.rint(box_mean(gray(image), 3)).astype(np.uint8)))[0]


def components(image: np.ndarray, least: int = LEAST_AREA) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1) of connected dark regions of at least `least` pixels, from top to bottom: runs of rows joined by union-find."""
    dark = image < 128
    root: list[int] = []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    runs, above = [], []
    for y, row in enumerate(dark):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for x0, x1 in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            k = len(root)
            root.append(k)
            for a0, a1, other in above:
                if a0 <= x1 and x0 <= a1:  # corners touch too
                    root[find(k)] = find(other)
            here.append((x0, x1, k))
            runs.append((y, x0, x1, k))
        above = here
    found: dict[int, list[int]] = {}
    for y, x0, x1, k in runs:
        box = found.setdefault(find(k), [x0, y, x1, y + 1, 0])
        box[:] = [min(box[0], x0), min(box[1], y), max(box[2], x1), max(box[3], y + 1), box[4] + x1 - x0]
    return sorted((tuple(b[:4]) for b in found.values() if b[4] >= least), key=lambda b: (b[1], b[0]))


def fallback_tokens(image: np.ndarray) -> list[dict]:
    """A token of confidence 0 for each dark region, where OCR itself failed."""
    return [{"token": "fallback", "x0": x0, "y0": y0, "x1": x1, "y1": y1, "conf_pct": 0.0, "block_num": 0, "paragraph_num": 0, "line_num": 0, "word_num": k} for k, (x0, y0, x1, y1) in enumerate(components(gray(image)))]
