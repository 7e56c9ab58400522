"""Binary rasters as cells: windows of flat (and gzipped) grids, read as whole files by Spark and decoded in Arrow batches.

A file is one row of Spark's binaryFile source, so any store works that Spark reads; what a task gives is one window's cells of one
file after another. Files beyond a worker's memory do not belong here: a grid of 16-bit numbers of a continent's kilometres has 46 MB.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CELLS = "path string, row int, col int, value double"


def flat_grids(
    spark: SparkSession, path: str, shape: tuple[int, int], window: tuple[int, int, int, int] | None = None, kind: str = ">i2", missing: float | None = -9999, scale: float = 1.0, glob: str = "*"
) -> DataFrame:
    """path, row, col, value: the cells of window (first row, end row, first column, end column) of each flat grid of rows x columns.

    Numbers are of numpy's kind; those equal to `missing` are left out, the others multiplied by scale. Files that begin as gzip
    does are unpacked. A file of another size than the shape's ends the query with its name.
    """
    ny, nx = shape
    r0, r1, c0, c1 = window or (0, ny, 0, nx)
    if not (0 <= r0 <= r1 <= ny and 0 <= c0 <= c1 <= nx):
        raise ValueError(f"window {window} is not inside {ny} x {nx}")
    number = np.dtype(kind)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                if len(data) != ny * nx * number.itemsize:
                    raise ValueError(f"{name}: {len(data)} bytes are no {ny} x {nx} numbers of {number.itemsize}")
                whole = np.frombuffer(data, number).reshape(ny, nx)[r0:r1, c0:c1]
                for a in range(0, r1 - r0, 256):  # a batch is some rows of a window
                    part = whole[a : a + 256]
                    row, col = np.nonzero(np.ones(part.shape, bool) if missing is None else part != missing)
                    values = part[row, col].astype(float) * scale
                    yield pa.RecordBatch.from_pydict({"path": pa.array([name] * len(row), pa.string()), "row": (row + a + r0).astype(np.int32), "col": (col + c0).astype(np.int32), "value": values})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").repartition(F.col("path"))
    return files.mapInArrow(decode, _CELLS)


def header_of(text: str) -> dict[str, str]:
    """The fields "name: value" (or "name value") of a grid's text header."""
    out = {}
    for line in text.splitlines():
        name, _, value = line.replace("=", ":", 1).partition(":")
        if value.strip():
            out[name.strip().lower()] = value.strip()
        elif len(line.split()) == 2:
            out[line.split()[0].lower()] = line.split()[1]
    return out
