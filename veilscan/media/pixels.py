"""Statistics of pixels that tell embedded bits from natural ones: regular and singular groups, sample pairs, bit planes, differences, palettes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A channel of fewer values, or of less spread, has no texture to tell from.
LEAST_VALUES, LEAST_SPREAD = 24, 4.0
_MASK = np.array([0, 1, 1, 0], bool)


def textured(values: np.ndarray) -> bool:
    return values.size >= 4096 and len(np.unique(values)) >= LEAST_VALUES and float(values.std()) >= LEAST_SPREAD


def _roughness(groups: np.ndarray) -> np.ndarray:
    return np.abs(np.diff(groups, axis=1)).sum(1)


def _regular_less_singular(groups: np.ndarray, shifted: bool) -> float:
    """Share of groups that a flip of the masked samples makes rougher, less the share it makes smoother."""
    part = groups[:, _MASK]
    flipped = groups.copy()
    flipped[:, _MASK] = ((part + 1) ^ 1) - 1 if shifted else part ^ 1
    before, after = _roughness(groups), _roughness(flipped)
    return float((after > before).mean() - (after < before).mean())


def message_share(channel: np.ndarray) -> float:
    """Estimated share of lowest bits that carry a message (regular and singular groups of four neighbours), 0 to 1."""
    width = channel.shape[1] // 4 * 4
    groups = channel[:, :width].reshape(-1, 4).astype(np.int32)
    other = groups ^ 1
    d0, m0 = _regular_less_singular(groups, False), _regular_less_singular(groups, True)
    d1, m1 = _regular_less_singular(other, False), _regular_less_singular(other, True)
    a, b, c = 2 * (d1 + d0), m0 - m1 - d1 - 3 * d0, d0 - m0
    if abs(a) < 1e-9:
        roots = [-c / b] if abs(b) > 1e-9 else []
    else:
        inside = b * b - 4 * a * c
        roots = [(-b + s * np.sqrt(max(inside, 0.0))) / (2 * a) for s in (1, -1)]  # no crossing: where the curves come closest
    if not roots:
        return 1.0 if abs(c) > 1e-3 else 0.0  # the curves are parallel
    x = min(roots, key=abs)
    return float(np.clip(x / (x - 0.5), 0, 1)) if abs(x - 0.5) > 1e-9 else 1.0


def pair_bias(channel: np.ndarray) -> float:
    """How far neighbours in one pair of values outweigh, or fall short of, neighbours in adjacent pairs: 0 (level) to 1."""
    flat = channel.ravel().astype(np.int32) // 2
    u, v = flat[0 : len(flat) // 2 * 2 : 2], flat[1 : len(flat) // 2 * 2 : 2]
    same, near = int((u == v).sum()), int((np.abs(u - v) == 1).sum())
    return abs(2 * same / (same + near) - 1) if same + near else 0.0


def plane_agreement(channel: np.ndarray) -> float:
    """Share of neighbours, beside and below, with the same lowest bit."""
    low = channel & 1
    return float(((low[:, 1:] == low[:, :-1]).mean() + (low[1:] == low[:-1]).mean()) / 2)


def difference_steps(grey: np.ndarray) -> float:
    """Mean size of the steps of the difference histogram at powers of two, from a half on."""
    h = np.bincount(np.abs(np.diff(grey.astype(np.int32), axis=1)).ravel(), minlength=256).astype(float)
    steps = [abs(h[b - 1] - h[b]) / max(h[b - 1], h[b], 1) for b in (8, 16, 32, 64, 128)]
    return sum(s for s in steps if s > 0.5) / len(steps)


def twin_colours(palette: bytes) -> int:
    """Pairs of palette entries, at most four places apart, that differ by one to three in all."""
    rgb = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
    return int(sum(((d := np.abs(rgb[k:] - rgb[:-k]).sum(1)) > 0).astype(int) @ (d <= 3) for k in range(1, min(5, len(rgb)))))


def statistics(pixels: np.ndarray) -> Iterator[tuple[str, int, float, str]]:
    """(detector, severity, confidence, evidence) of the pixels (height, width, channels) of one image."""
    colours = pixels if pixels.shape[2] in (1, 3) else pixels[:, :, :-1]
    for ch in range(colours.shape[2]):
        channel = colours[:, :, ch]
        if textured(channel):
            share = message_share(channel)
            if share > 0.05:
                severity, confidence = (4, 0.92) if share > 0.3 else (3, 0.8) if share > 0.15 else (2, 0.65)
                yield "lsb_groups", severity, confidence, f"channel {ch}: {share:.3f} of the lowest bits"
            bias = pair_bias(channel)
            if bias > 0.1:
                yield "lsb_sample_pairs", 3 if bias > 0.25 else 2, round(min(0.85, 0.5 + bias), 4), f"channel {ch}: {bias:.3f}"
        if min(channel.shape) >= 10:
            same = plane_agreement(channel)
            if same < 0.54:
                yield "bit_plane", 3 if same < 0.52 else 2, 0.8 if same < 0.52 else 0.6, f"channel {ch}: neighbours agree in {same:.3f}"
    grey = colours.mean(2).round().astype(np.uint8)
    if min(grey.shape) >= 10:
        steps = difference_steps(grey)
        if steps > 0.2:
            yield "difference_steps", 3 if steps > 0.4 else 2, round(min(0.75, 0.4 + steps), 4), f"{steps:.3f}"
