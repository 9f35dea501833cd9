"""Intervention images and saliency, on binary columns; needs Pillow, which is optional."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.answers import stable_seed


def _image_library():
    try:
        from PIL import Image, ImageFilter
    except ImportError as e:
        raise RuntimeError("image operators need Pillow") from e
    return Image, ImageFilter


#: The tone of a gray image.
GRAY = (128, 128, 128)


def decode(content: Column) -> Column:
    """struct(width, height, rgb): an image's pixels, three bytes each, row by row; null stays null."""

    @F.pandas_udf("struct<width: int, height: int, rgb: binary>")
    def pixels(raw: pd.Series) -> pd.DataFrame:
        image, _ = _image_library()

        def one(b: bytes | None) -> tuple:
            if b is None:
                return None, None, None
            im = image.open(io.BytesIO(b)).convert("RGB")
            return *im.size, im.tobytes()

        return pd.DataFrame([one(b) for b in raw], columns=["width", "height", "rgb"])

    return pixels(content)


def from_pool(pool: list[str], *parts: Column) -> Column:
    """The path of an irrelevant image for a sample: of a sorted pool, by a hash of the parts (seed, sample, intervention)."""
    if not pool:
        raise ValueError("the pool of irrelevant images is empty")
    return F.element_at(F.array(*[F.lit(p) for p in sorted(pool)]), (stable_seed(*parts) % len(pool) + 1).cast("int"))


def intervene(content: Column, kind: str, radius: float = 8.0, other: Column | None = None) -> Column:
    """PNG bytes of an image made gray (one tone), grayscale, black or blurred, or put in the place of another (``counterfactual``, ``irrelevant``:
    the bytes of ``other`` at the size of ``content``); null stays null, and where there is no other image there is no intervention."""
    if kind not in ("gray", "grayscale", "black", "blur", "counterfactual", "irrelevant"):
        raise ValueError(f"unknown intervention {kind!r}")
    if kind in ("counterfactual", "irrelevant"):
        if other is None:
            raise ValueError(f"{kind} needs another image")

        @F.pandas_udf("binary")
        def swap(raw: pd.Series, by: pd.Series) -> pd.Series:
            image, _ = _image_library()

            def one(b: bytes | None, o: bytes | None) -> bytes | None:
                if b is None or o is None:
                    return None
                sink = io.BytesIO()
                image.open(io.BytesIO(o)).convert("RGB").resize(image.open(io.BytesIO(b)).size).save(sink, "PNG")
                return sink.getvalue()

            return pd.Series([one(b, o) for b, o in zip(raw, by, strict=True)], dtype=object)

        return swap(content, other)

    @F.pandas_udf("binary")
    def change(raw: pd.Series) -> pd.Series:
        image, filters = _image_library()

        def one(b: bytes | None) -> bytes | None:
            if b is None:
                return None
            im = image.open(io.BytesIO(b)).convert("RGB")
            out = {
                "gray": lambda: image.new("RGB", im.size, GRAY),
                "black": lambda: image.new("RGB", im.size, (0, 0, 0)),
                "grayscale": lambda: im.convert("L").convert("RGB"),
                "blur": lambda: im.filter(filters.GaussianBlur(radius)),
            }[kind]()
            sink = io.BytesIO()
            out.save(sink, "PNG")
            return sink.getvalue()

        return raw.map(one)

    return change(content)


def saliency(content: Column, cells: int) -> Column:
    """Array of a grid's mean gradient sizes, row by row, between 0 and 1; resampled along its length if ``cells`` isn't square."""

    @F.pandas_udf("array<double>")
    def score(raw: pd.Series) -> pd.Series:
        image, _ = _image_library()
        side = max(1, round(cells**0.5))

        def one(b: bytes | None) -> list[float] | None:
            if b is None:
                return None
            g = np.asarray(image.open(io.BytesIO(b)).convert("L"), float) / 255
            dy, dx = np.gradient(g) if min(g.shape) > 1 else (np.zeros_like(g), np.zeros_like(g))
            size = np.hypot(dx, dy)
            grid = np.array([[p.mean() if p.size else 0.0 for p in np.array_split(row, side, 1)] for row in np.array_split(size, side, 0)]).ravel()
            if len(grid) != cells:
                grid = np.interp(np.linspace(0, 1, cells), np.linspace(0, 1, len(grid)), grid)
            top = grid.max()
            return (grid / top if top > 0 else grid).tolist()

        return raw.map(one)

    return score(content)
