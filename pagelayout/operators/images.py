"""Pixels: what stays in NumPy, behind Arrow (B5, B10). Images are columns pixels (bytes, gray or RGB), h, w."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelayout.functions.workers import ship

COMPONENTS = "array<struct<comp_id:int,x:int,y:int,w:int,h:int,area:int>>"


def background(pixels: DataFrame) -> DataFrame:
    """(page_id, channel, value): median of each channel of pixel rows (page_id, channel, value), truncated."""
    return pixels.groupBy("page_id", "channel").agg(F.median("value").cast("int").alias("value"))


def otsu(gray: np.ndarray) -> int:
    """The threshold of greatest variance between classes; the first on ties."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    total, weighted = n.sum(), (n * np.arange(256)).sum()
    below = np.cumsum(n)
    mean = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (weighted * below - total * mean) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(spread), spread, -1.0)))

def cell_labels(on: np.ndarray, diagonal: bool) -> np.ndarray:
    """Each cell of `on` with the least flat index of its component (4- or 8-connected); other cells have `on.size`."""
    none = on.size
    label = np.where(on, np.arange(none).reshape(on.shape), none)
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or not (i and j)]
    while True:
        near = np.pad(label, 1, constant_values=none)
        least = np.minimum.reduce([near[1 + i : 1 + i + on.shape[0], 1 + j : 1 + j + on.shape[1]] for i, j in steps])
        new = np.where(on, least, none).ravel()
        # follow labels to labels, so that long components take few rounds
        new = np.append(new, none)
        new = new[new][:none].reshape(on.shape)
        if (new == label).all():
            return label
        label = new


def ink_components(gray: np.ndarray) -> list[dict]:
    """8-connected components of what is at or below the Otsu threshold, in the order of their first pixel."""
    ink = gray <= otsu(gray)
    label = cell_labels(ink, True)
    out = []
    for n, k in enumerate(np.unique(label[ink]).tolist(), 1):
        r, c = np.nonzero(label == k)
        out.append({"comp_id": n, "x": int(c.min()), "y": int(r.min()), "w": int(c.max() - c.min() + 1), "h": int(r.max() - r.min() + 1), "area": len(r)})
    return out


def with_components(crops: DataFrame, name: str = "components") -> DataFrame:
    """Gray crops with the array of their ink components."""
    ship(crops.sparkSession)
    at = [crops.columns.index(c) for c in ("pixels", "h", "w")]

    def run(batches):
        for batch in batches:
            found = []
            for p, h, w in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                found.append(ink_components(np.frombuffer(p, dtype=np.uint8).reshape(h, w)) if p else [])
            kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("comp_id", "x", "y", "w", "h", "area")]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, name])

    return crops.mapInArrow(run, T.StructType([*crops.schema.fields, *T.StructType.fromDDL(f"{name} {COMPONENTS}").fields]))
