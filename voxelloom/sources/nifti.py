"""NIfTI-1 volumes, plain or gzipped.

A header stands for the first 3D volume of its file; ``time_points`` makes a volume of every one.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import slabs

HEADER_BYTES = 348
# Data type codes with their numpy type; 128 is RGB with three bytes.
DATA_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 128: "rgb", 256: "i1", 512: "u2", 768: "u4"}
HEADER_SCHEMA = ("volume_id string, path string, content binary, gzip boolean, offset bigint, kind string, nx int, ny int, "
                 "nz int, nt int, sx double, sy double, sz double, slope double, intercept double, bpv int, description string, "
                 "reject_reason string")


def decode_header(head: bytes) -> dict:
    """Fields of a header, or a reject reason."""
    if len(head) < HEADER_BYTES:
        return {"reject_reason": "invalid NIfTI header"}
    order = next((o for o in "<>" if struct.unpack_from(o + "i", head)[0] == HEADER_BYTES), None)
    if order is None:
        return {"reject_reason": "invalid NIfTI header"}
    dim = struct.unpack_from(order + "8h", head, 40)
    if dim[0] < 3 or min(dim[1:4]) <= 0:
        return {"reject_reason": "invalid NIfTI dimensions"}
    (code,) = struct.unpack_from(order + "h", head, 70)
    if code not in DATA_TYPES:
        return {"reject_reason": f"unsupported NIfTI datatype: {code}"}
    pixdim = struct.unpack_from(order + "8f", head, 76)
    start, slope, intercept = struct.unpack_from(order + "3f", head, 108)
    name = DATA_TYPES[code]
    kind = name if name == "rgb" else order + name
    return {
        "kind": kind, "bpv": 3 if name == "rgb" else np.dtype(kind).itemsize,
        "nx": dim[1], "ny": dim[2], "nz": dim[3], "nt": math.prod(max(1, n) for n in dim[4:dim[0] + 1]),
        **{s: p if p > 0 else 1.0 for s, p in zip(("sx", "sy", "sz"), pixdim[1:4])},
        "offset": max(0, math.floor(start)) if math.isfinite(start) else 0,
        "slope": 1.0 if slope == 0 or not math.isfinite(slope) else slope,
        "intercept": intercept if math.isfinite(intercept) else 0.0,
        "description": "NIfTI (first volume)" if dim[4] > 1 else "NIfTI", "reject_reason": None,
    }


def decode_headers(files: DataFrame) -> DataFrame:
    """Headers of files (path and, for bytes at hand, content); only 348 bytes of each file are read."""
    with_bytes = "content" in files.columns
    fields = [c.split() for c in HEADER_SCHEMA.split(", ")]
    schema = pa.schema([(name, slabs.ARROW_TYPES[kind]) for name, kind in fields])

    def work(batches):
        for batch in batches:
            for rec in batch.to_pylist():
                content, zipped = rec.get("content"), rec["path"].lower().endswith(".gz")
                with slabs.open_source(rec["path"], content, zipped) as source:
                    got = decode_header(source.read(HEADER_BYTES))
                row = {"volume_id": rec["path"], "path": rec["path"], "content": content, "gzip": zipped, **got}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return files.select("path", *(["content"] if with_bytes else [])).mapInArrow(work, HEADER_SCHEMA)


def time_points(headers: DataFrame) -> DataFrame:
    """One header per 3D volume of a file with several: ``volume_id`` ends in ``#`` and its number, from 0.

    Higher dimensions count on, in file order. Headers of single volumes and refused ones stay as they are.
    """
    many, count = F.col("nt") > 1, F.coalesce("nt", F.lit(1))
    size = F.col("nx").cast("bigint") * F.col("ny") * F.col("nz") * F.col("bpv")
    return headers.withColumn("_t", F.explode(F.sequence(F.lit(0), count - 1))).withColumns({
        "volume_id": F.when(many, F.concat("volume_id", F.lit("#"), F.col("_t").cast("string"))).otherwise(F.col("volume_id")),
        "offset": F.col("offset") + F.col("_t") * size,
        "description": F.when(many, F.format_string("NIfTI (volume %d of %d)", F.col("_t") + 1, "nt")).otherwise(F.col("description")),
        "nt": F.when(F.col("nt").isNotNull(), 1),
    }).drop("_t").select(*headers.columns)


def read_nifti(headers: DataFrame, z_from: int | None = None, z_to: int | None = None) -> DataFrame:
    """Voxels of admitted headers. Plain files are cut into slabs; a gzipped one is streamed by one task."""
    good = headers.where(F.col("reject_reason").isNull())
    plain = slabs.plan_slabs(good.where(~F.col("gzip")), z_from, z_to)
    zipped = good.where(F.col("gzip")).withColumns({"z0": F.lit(0), "slices": F.col("nz")}).select(*slabs.SLAB_COLUMNS)
    voxels = slabs.read_slabs(plain.unionByName(zipped))
    if z_from is not None:
        voxels = voxels.where(F.col("z") >= z_from)
    if z_to is not None:
        voxels = voxels.where(F.col("z") <= z_to)
    return voxels


def volumes_of(headers: DataFrame) -> DataFrame:
    return headers.where(F.col("reject_reason").isNull()).select(
        "volume_id", "nx", "ny", "nz", F.lit("float32").alias("data_type"), "sx", "sy", "sz", "description")
