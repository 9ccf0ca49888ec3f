"""Reads stretches of slices from binary files, many files and stretches at a time.

A slab is a row that says where some consecutive slices lie: in a file, or in bytes that travel with the
row. Slabs are ordinary rows, so Spark distributes them, and a filter on z0/z1 prunes them before any byte is
read. Columns: volume_id, path, content, gzip, offset, kind, nx, ny, z0, slices, slope, intercept; ``kind`` is
a numpy type string or ``rgb``.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import GRAY_WEIGHTS
from ..model import VOXELS
from ..scale import spread_out

# Fixed value: target size of a slab.
SLAB_BYTES = 50 * 1024 * 1024
BATCH_VOXELS = 1 << 18
SLAB_COLUMNS = ["volume_id", "path", "content", "gzip", "offset", "kind", "nx", "ny", "z0", "slices", "slope", "intercept"]
ARROW_TYPES = {
    "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(),
    "double": pa.float64(), "array<double>": pa.list_(pa.float64()),
}
_ARROW = pa.schema([("volume_id", pa.string()), ("z", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), ("v", pa.float64())])


def open_path(path: str):
    """Seekable stream of a file on any file system that pyarrow knows; plain paths are local."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    from pyarrow import fs
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def open_source(path: str | None, content: bytes | None, gzipped: bool):
    raw = io.BytesIO(content) if content is not None else open_path(path)
    return gzip.GzipFile(fileobj=raw) if gzipped else raw


def _read_exactly(source, n: int, what: str) -> bytes:
    data = source.read(n)
    if len(data) < n:
        raise ValueError(f"{what}: file is shorter than its metadata says ({len(data)} of {n} bytes)")
    return data


def _values(data: bytes, kind: str) -> np.ndarray:
    if kind == "rgb":
        rgb = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.float64)
        return rgb[:, 0] * GRAY_WEIGHTS[0] + rgb[:, 1] * GRAY_WEIGHTS[1] + rgb[:, 2] * GRAY_WEIGHTS[2]
    return np.frombuffer(data, np.dtype(kind)).astype(np.float64)


def _slab_batches(slab: dict) -> Iterator[pa.RecordBatch]:
    nx, ny = slab["nx"], slab["ny"]
    width = 3 if slab["kind"] == "rgb" else np.dtype(slab["kind"]).itemsize
    rows = max(1, BATCH_VOXELS // nx)  # rows of x per batch, so that memory does not depend on the slice size
    x = np.arange(nx, dtype=np.int32)
    with open_source(slab["path"], slab["content"], slab["gzip"]) as source:
        source.seek(slab["offset"])
        done, total = 0, ny * slab["slices"]
        while done < total:
            n = min(rows, total - done)
            v = _values(_read_exactly(source, n * nx * width, slab["path"] or slab["volume_id"]), slab["kind"])
            line = np.arange(done, done + n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(slab["volume_id"]), n * nx),
                pa.array(np.repeat((slab["z0"] + line // ny).astype(np.int32), nx)),
                pa.array(np.repeat((line % ny).astype(np.int32), nx)),
                pa.array(np.tile(x, n)),
                pa.array(v * slab["slope"] + slab["intercept"]),
            ], schema=_ARROW)
            done += n


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for slab in batch.to_pylist():
            yield from _slab_batches(slab)


def read_slabs(slabs: DataFrame) -> DataFrame:
    """Voxels of slabs. A slab is read in bounded batches by one task; a short file fails the job."""
    return slabs.select(*SLAB_COLUMNS).mapInArrow(_read, VOXELS)


def plan_slabs(files: DataFrame, z_from: int | None = None, z_to: int | None = None,
               slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """Cuts uncompressed grids (SLAB_COLUMNS with nz and bytes per voxel) into slabs of about 50 MB.

    With ``z_from``/``z_to`` only the slices in that inclusive range are planned.
    """
    size = F.col("nx").cast("bigint") * F.col("ny") * F.col("bpv")
    step = F.greatest(F.lit(1), F.floor(F.lit(slab_bytes) / size)).cast("int")
    first = F.lit(max(0, z_from or 0))
    last = F.col("nz") - 1 if z_to is None else F.least(F.col("nz") - 1, F.lit(z_to))
    starts = F.when(first <= last, F.sequence(first, last, step))
    cut = files.withColumns({"_step": step, "_last": last}).withColumn("z0", F.explode(starts))
    cut = cut.withColumns({
        "slices": F.least(F.col("_step"), F.col("_last") - F.col("z0") + 1),
        "offset": F.col("offset") + F.col("z0").cast("bigint") * size,
    })
    return spread_out(cut.select(*SLAB_COLUMNS), "path", "z0")
