"""Overlays: components drawn on their image, binary previews, images side by side; and their PNG files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lettering import letters
from ..sources.store import png
from .routing import KINDS

#: Blue, green, red of each kind.
COLOURS = {"text": (60, 160, 60), "diacritic": (200, 120, 0), "rule": (0, 140, 255), "blob": (40, 40, 220), "noise": (160, 160, 160)}


def colour(image: np.ndarray) -> np.ndarray:
    return np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., :3].copy()


def draw(image: np.ndarray, boxes: list[tuple[int, int, int, int, str]], kinds: tuple[str, ...] = KINDS) -> np.ndarray:
    """Outlines of the boxes (x, y, w, h, kind) whose kind is wanted, clipped to the image."""
    out = colour(image)
    h, w = out.shape[:2]
    for x, y, bw, bh, kind in boxes:
        if kind in kinds:
            x1, y1 = min(x + bw, w), min(y + bh, h)
            x0, y0 = max(x, 0), max(y, 0)
            if x0 < x1 and y0 < y1:
                for part in (np.s_[y0, x0:x1], np.s_[y1 - 1, x0:x1], np.s_[y0:y1, x0], np.s_[y0:y1, x1 - 1]):
                    out[part] = COLOURS[kind]
    return out


def write(image: np.ndarray, x: int, y: int, text: str, ink: tuple[int, int, int], size: int = 2) -> None:
    """Write into an image of three channels; what leaves it is cut."""
    dots = letters(text, size)
    y, x = max(y, 0), max(x, 0)
    part = image[y : y + dots.shape[0], x : x + dots.shape[1]]
    part[dots[: part.shape[0], : part.shape[1]]] = ink


def legend(image: np.ndarray, boxes: list[tuple[int, int, int, int, str]], more: tuple[str, ...] = ()) -> np.ndarray:
    """A light panel in the corner with the count of each kind, of all, and further lines."""
    kinds = [b[4] for b in boxes]
    lines = [(f"{k}: {kinds.count(k)}", COLOURS[k]) for k in KINDS] + [(t, (30, 30, 30)) for t in (f"total: {len(boxes)}", *more)]
    out, pitch = colour(image), 14
    panel = out[: 8 + pitch * len(lines), :150]
    panel[:] = np.rint(0.22 * panel + 0.78 * 255).astype(np.uint8)
    for k, (text, ink) in enumerate(lines):
        write(out, 5, 5 + pitch * k, text, ink)
    return out


def reasons(image: np.ndarray, boxes: list[tuple[int, int, int, int, str, str]]) -> np.ndarray:
    """Why each box was routed, above it."""
    out = colour(image)
    for x, y, _, _, kind, reason in boxes:
        write(out, x, max(0, y - 6), reason or "", COLOURS[kind], 1)
    return out


def binary_preview(binary: np.ndarray) -> np.ndarray:
    """Ink black on white."""
    return 255 - binary


def side_by_side(*images: np.ndarray, gap: int = 8) -> np.ndarray:
    """Images in a row on white, each at its own size."""
    parts = [colour(i) for i in images]
    out = np.full((max(p.shape[0] for p in parts), sum(p.shape[1] for p in parts) + gap * (len(parts) - 1), 3), 255, np.uint8)
    x = 0
    for p in parts:
        out[: p.shape[0], x : x + p.shape[1]] = p
        x += p.shape[1] + gap
    return out


def overlays(images: DataFrame, components: DataFrame, kinds: tuple[str, ...] = KINDS, with_legend: bool = False, with_reasons: bool = False) -> DataFrame:
    """sample_id, png of every image (sample_id, height, width, n_channels, data) with its components (sample_id, x, y, w, h, kind, with_reasons: reason).

    The legend counts all kinds, also those that aren't drawn.
    """
    reason = F.col("reason") if with_reasons else F.lit("")
    boxes = components.groupBy("sample_id").agg(F.collect_list(F.struct("x", "y", "w", "h", "kind", reason.alias("reason"))).alias("boxes")).withColumnRenamed("sample_id", "_id")
    joined = images.join(boxes, F.col("sample_id") == F.col("_id"), "left").select("sample_id", "height", "width", "n_channels", "data", "boxes")

    def run(batches):
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n_channels"])
                found = [tuple(b.values()) for b in r["boxes"] or []]
                out = draw(a[..., 0] if r["n_channels"] == 1 else a, [b[:5] for b in found], kinds)
                if with_reasons:
                    out = reasons(out, [b for b in found if b[4] in kinds])
                if with_legend:
                    out = legend(out, [b[:5] for b in found])
                made.append(png(out.tobytes(), *out.shape))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["sample_id", "png"])

    return joined.mapInArrow(run, "sample_id string, png binary")


def drawn(components: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    return components.where(F.col("kind").isin(*kinds))


def sampled(samples: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n samples spread over all by a hash of their id, in order; the same for the same seed."""
    draw = F.md5(F.concat(F.col("sample_id").cast("string"), F.lit(f":{seed}")).cast("binary"))
    return samples.orderBy(draw, "sample_id").limit(n).orderBy("sample_id")
