"""Measures of page images: contrast, blur, resolution and skew.

Pixels come as grey bytes with a width and a height, from whatever reads the pages (a plug-in; for plain
grey PGM files there is one here). Each image is a row of its own and measured in numpy, in Arrow batches;
angles are put together by file with the built-in median.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.numbers import rounded

MEASURES = "contrast double, blur_score double, skew_angle double, image_error string"
#: Near-horizontal lines only: degrees on either side.
MOST_SKEW = 45.0
_LINE_VOTES, _EDGE = 100, 150.0


def pgm(content: bytes) -> tuple[int, int, bytes]:
    """Width, height and pixels of a binary grey PGM file of 8 bits."""
    parts, at = [], 0
    while len(parts) < 4:
        end = at
        while content[end : end + 1].strip():
            end += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at) + 1
        elif end == at:
            if at >= len(content):
                raise ValueError("a PGM file without a whole head")
            at += 1
        else:
            parts.append(content[at:end])
            at = end
    if parts[0] != b"P5" or int(parts[3]) > 255:
        raise ValueError("not a binary grey PGM file of 8 bits")
    width, height = int(parts[1]), int(parts[2])
    pixels = content[at + 1 : at + 1 + width * height]
    if len(pixels) < width * height:
        raise ValueError("a PGM file with too few pixels")
    return width, height, pixels


def laplacian(grey: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours less four times the pixel; beyond the border the image is mirrored."""
    p = np.pad(grey.astype(np.float64), 1, mode="reflect" if min(grey.shape) > 1 else "edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def line_angles(grey: np.ndarray) -> np.ndarray:
    """Angles in degrees of the near-horizontal lines that edges vote for (a Hough transform in steps of half a degree)."""
    g = np.pad(grey.astype(np.float64), 1, mode="edge")
    dy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    dx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    size = np.hypot(dx, dy)
    # The edge is where the gradient is largest across the line, up and down for lines near the horizontal.
    q = np.pad(size, ((1, 1), (0, 0)))
    y, x = np.nonzero((size >= _EDGE) & (size >= q[:-2]) & (size > q[2:]) & (np.abs(dy) >= np.abs(dx)))
    if not len(x):
        return np.zeros(0)
    degrees = np.arange(-2 * MOST_SKEW + 1, 2 * MOST_SKEW) / 2
    reach = int(math.hypot(*grey.shape)) + 1
    votes = np.empty((len(degrees), 2 * reach), np.int64)
    for i, a in enumerate(np.radians(degrees)):
        votes[i] = np.bincount((np.rint(y * math.cos(a) - x * math.sin(a)) + reach).astype(np.int64), minlength=2 * reach)
    # A line's own angle holds more of its votes than the angles beside it.
    best = votes.max(axis=0)
    lines = np.flatnonzero((best >= _LINE_VOTES) & (best >= np.append(best[1:], 0)) & (best > np.append(0, best[:-1])))
    return degrees[votes[:, lines].argmax(axis=0)]


def measure(width: int, height: int, pixels: bytes) -> tuple[float, float, float | None]:
    """Contrast (deviation of the greys over 255), blur (variance of the Laplacian; lower is blurrier), skew in degrees or None."""
    grey = np.frombuffer(pixels, np.uint8, width * height).reshape(height, width)
    if not grey.size:
        return 0.0, 0.0, None
    angles = line_angles(grey)
    return round(float(grey.std()) / 255, 4), round(float(laplacian(grey).var()), 2), round(float(np.median(angles)), 2) if len(angles) else None


def image_quality(images: DataFrame, decode: Callable[[bytes], tuple[int, int, bytes]] | None = None) -> DataFrame:
    """Adds contrast, blur_score, skew_angle and image_error to rows (width, height, pixels), or (content) with `decode`.

    A row whose image can't be read has null measures and the error.
    """
    columns = ["content"] if decode else ["width", "height", "pixels"]

    @F.pandas_udf(f"struct<{MEASURES.replace(' ', ':').replace(',:', ',')}>")
    def measured(*given: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(*given, strict=True):
            try:
                out.append((*measure(*(decode(row[0]) if decode else row)), None))
            except Exception as e:  # noqa: BLE001 - the error is the result
                out.append((None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["contrast", "blur_score", "skew_angle", "image_error"])

    return images.withColumn("measured__", measured(*columns)).select(*images.columns, "measured__.*")


def mean_dpi(resolutions: str):
    """Mean of the positive resolutions of an array column; null without one."""
    there = F.filter(F.col(resolutions), lambda x: x > 0)
    return F.when(F.size(there) > 0, rounded(F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there), 2))


def skew_of_lines(lines: DataFrame, key: list[str]) -> DataFrame:
    """Rows key + (skew_angle, n_lines): median angle of line segments (x1, y1, x2, y2), upright and steep ones left out."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    angle = F.degrees(F.atan2(dy.cast("double"), dx.cast("double")))
    near = lines.where(dx != 0).withColumn("angle__", angle).where(F.abs("angle__") < MOST_SKEW)
    return near.groupBy(*key).agg(rounded(F.median("angle__"), 2).alias("skew_angle"), F.count("*").alias("n_lines"))
