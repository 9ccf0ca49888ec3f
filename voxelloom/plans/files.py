"""File contents made from grids, so that the readers can be run over whole tables: one file per slice."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FILES = "path string, volume_id string, z int, content binary"


def _element(tag: tuple[int, int], vr: bytes, value: bytes, explicit: bool) -> bytes:
    value += b"\0" * (len(value) % 2)
    head = struct.pack("<HH", *tag)
    if not explicit:
        return head + struct.pack("<I", len(value)) + value
    if vr in (b"OW", b"OB"):
        return head + vr + b"\0\0" + struct.pack("<I", len(value)) + value
    return head + vr + struct.pack("<H", len(value)) + value


def dicom_bytes(pixels: np.ndarray, position: float, instance: int, variant: int = 0, frames: int = 1,
                slope: float = 2.0, intercept: float = -1024.0, **changed) -> bytes:
    """A small file; variants: explicit with preamble, implicit with preamble, explicit without preamble."""
    explicit = variant != 1
    rows, cols = pixels.shape[-2:]
    short = lambda n: struct.pack("<H", n)
    text = lambda s: str(s).encode()
    body = [
        ((0x0020, 0x0013), b"IS", text(instance)),
        ((0x0020, 0x0032), b"DS", text(f"0\\0\\{position}")),
        ((0x0020, 0x0037), b"DS", b"1\\0\\0\\0\\1\\0"),
        ((0x0028, 0x0002), b"US", short(changed.get("samples", 1))),
        ((0x0028, 0x0008), b"IS", text(frames)),
        ((0x0028, 0x0010), b"US", short(rows)),
        ((0x0028, 0x0011), b"US", short(cols)),
        ((0x0028, 0x0030), b"DS", b"0.5\\0.25"),
        ((0x0028, 0x0100), b"US", short(changed.get("bits", 16))),
        ((0x0028, 0x0103), b"US", short(changed.get("signed", 0))),
        ((0x0028, 0x1052), b"DS", text(intercept)),
        ((0x0028, 0x1053), b"DS", text(slope)),
        ((0x7FE0, 0x0010), b"OW", pixels.astype(changed.get("dtype", "<u2")).tobytes()),
    ]
    data = b"".join(_element(t, vr, v, explicit) for t, vr, v in body)
    if variant == 2:
        return data
    syntax = changed.get("syntax", "1.2.840.10008.1.2.1" if explicit else "1.2.840.10008.1.2")
    return b"\0" * 128 + b"DICM" + _element((0x0002, 0x0010), b"UI", syntax.encode(), True) + data


def nifti_bytes(grid: np.ndarray, code: int, order: str = "<", slope: float = 0.0, intercept: float = 0.0,
                dim4: int = 1, pixdim=(0.0, 0.5, 0.5, 2.0)) -> bytes:
    nz, ny, nx = grid.shape[:3]
    head = bytearray(352)
    struct.pack_into(order + "i", head, 0, 348)
    struct.pack_into(order + "5h", head, 40, 4 if dim4 > 1 else 3, nx, ny, nz, dim4)
    struct.pack_into(order + "h", head, 70, code)
    struct.pack_into(order + "4f", head, 76, *pixdim)
    struct.pack_into(order + "3f", head, 108, 352.0, slope, intercept)
    return bytes(head) + grid.tobytes()


def _slice(part: pd.DataFrame) -> np.ndarray:
    part = part.sort_values(["y", "x"])
    return part["v"].to_numpy().reshape(part["y"].max() + 1, part["x"].max() + 1)


def _per_slice(voxels: DataFrame, encode) -> DataFrame:
    def work(part: pd.DataFrame) -> pd.DataFrame:
        volume, z = part["volume_id"].iloc[0], int(part["z"].iloc[0])
        name, content = encode(volume, z, _slice(part))
        return pd.DataFrame({"path": [name], "volume_id": [volume], "z": [z], "content": [content]})
    return voxels.groupBy("volume_id", "z").applyInPandas(work, FILES)


def dicom_slices(voxels: DataFrame) -> DataFrame:
    """One file per slice, positions falling with z, so that the order has to be found."""
    return _per_slice(voxels, lambda volume, z, grid: (
        f"{volume}/{z:06d}.dcm", dicom_bytes(grid % 65536, -2.0 * z, z + 1, z % 3)))


def dicom_frames(voxels: DataFrame, frames: int = 3) -> DataFrame:
    """Files of up to ``frames`` slices as frames, positions falling from file to file."""
    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["z", "y", "x"])
        volume, z, n = part["volume_id"].iloc[0], int(part["z"].iloc[0]), part["z"].nunique()
        grid = part["v"].to_numpy().astype("i8").reshape(n, part["y"].max() + 1, part["x"].max() + 1)
        data = dicom_bytes(grid % 65536, -2.0 * z, z + 1, frames=n)
        return pd.DataFrame({"path": [f"{volume}/{z:06d}.dcm"], "volume_id": [volume], "z": [z], "content": [data]})
    keyed = voxels.selectExpr("*", f"z div {frames} as _file")
    return keyed.groupBy("volume_id", "_file").applyInPandas(work, FILES)


def nifti_slices(voxels: DataFrame) -> DataFrame:
    """One file per slice: plain little-endian, gzipped, and big-endian in turn."""
    def encode(volume: str, z: int, grid: np.ndarray):
        order = ">" if z % 3 == 2 else "<"
        data = nifti_bytes(grid[None].astype(order + "i4"), 8, order, slope=0.5, intercept=3.0)
        return (f"{volume}/{z:06d}.nii.gz", gzip.compress(data)) if z % 3 == 1 else (f"{volume}/{z:06d}.nii", data)
    return _per_slice(voxels, encode)


def nifti_times(voxels: DataFrame, points: int = 4) -> DataFrame:
    """Plain files that hold up to ``points`` slices each as volumes of one slice."""
    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["z", "y", "x"])
        volume, z, n = part["volume_id"].iloc[0], int(part["z"].iloc[0]) // points, part["z"].nunique()
        grid = part["v"].to_numpy().astype("<i4").reshape(n, 1, part["y"].max() + 1, part["x"].max() + 1)
        data = nifti_bytes(grid[0], 8, "<", slope=0.5, intercept=3.0, dim4=n) + grid[1:].tobytes()
        return pd.DataFrame({"path": [f"{volume}/{z:06d}.nii"], "volume_id": [volume], "z": [z], "content": [data]})
    keyed = voxels.selectExpr("*", f"z div {points} as _file")
    return keyed.groupBy("volume_id", "_file").applyInPandas(work, FILES)


def raw_slices(voxels: DataFrame) -> DataFrame:
    """Bare float32 values of each slice, big-endian on odd slices."""
    return _per_slice(voxels, lambda volume, z, grid: (
        f"{volume}/{z:06d}.raw", grid.astype((">" if z % 2 else "<") + "f4").tobytes()))
