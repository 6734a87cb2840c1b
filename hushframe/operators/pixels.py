"""Masking of pictures held as arrays. Whatever goes wrong, the area is blacked out."""

from __future__ import annotations

import numpy as np


def mask(picture: np.ndarray, boxes: list[dict], block: int = 12) -> np.ndarray:
    """A copy with each box blacked out, or averaged in blocks where its mode is blur."""
    out = picture.copy()
    high, wide = out.shape[:2]
    for box in boxes:
        x0, y0 = max(0, int(box["x"])), max(0, int(box["y"]))
        x1, y1 = min(wide, int(box["x"]) + int(box["w"])), min(high, int(box["y"]) + int(box["h"]))
        if x1 <= x0 or y1 <= y0:
            continue
        part = out[y0:y1, x0:x1]
        if box.get("mode") != "blur" or not np.isfinite(part).all():
            part[:] = 0
            continue
        for y in range(0, part.shape[0], block):
            for x in range(0, part.shape[1], block):
                cell = part[y : y + block, x : x + block]
                cell[:] = cell.mean(axis=(0, 1))
    return out


def frame_tensor(picture: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Nearest-neighbour resize to [1, 3, high, wide] in 0 to 1."""
    ys = (np.arange(high) * picture.shape[0] // high).clip(0, picture.shape[0] - 1)
    xs = (np.arange(wide) * picture.shape[1] // wide).clip(0, picture.shape[1] - 1)
    return picture[ys][:, xs].transpose(2, 0, 1)[None].astype(np.float32) / 255
