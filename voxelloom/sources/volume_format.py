"""Volumes as a Spark data source: ``spark.read.format("voxels").load(folder).where("z between 10 and 20")``.

A folder holds RAW files of consecutive slices and, in ``_volumes``, catalogue files that say which slices of which volume
lie where. Reading plans one partition per run of slices of about ``slabBytes``; filters on ``z`` and ``volume_id`` are
pushed into the planning, so that slices that are not wanted are neither planned nor read. Writing appends files of
consecutive slices; the catalogue of a write appears when all its tasks are done, so a lost or repeated task leaves
no trace but unused files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage)
from pyspark.sql.types import StructType

from ..model import VOXELS
from ..scale import attach
from .raw import kind_of
from .slabs import SLAB_BYTES, _slab_batches

NAME = "voxels"
CATALOGUE = "_volumes"


@dataclass
class Slabs(InputPartition):
    """Runs of slices that one task reads."""
    slabs: tuple[dict, ...]

    def __init__(self, slabs: tuple[dict, ...]) -> None:
        self.slabs = slabs


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(path)


def catalogue(path: str) -> list[dict]:
    """All files of a folder: volume_id, path, nx, ny, z0, slices, offset, kind, slope, intercept."""
    system, inner = file_system(f"{path}/{CATALOGUE}")
    listed = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    out = []
    for info in sorted((i for i in listed if i.base_name.endswith(".json")), key=lambda i: i.path):
        with system.open_input_stream(info.path) as source:
            out += [json.loads(line) for line in source.read().decode().splitlines()]
    return sorted(out, key=lambda e: (e["volume_id"], e["z0"]))


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.slab_bytes = int(options.get("slabBytes", SLAB_BYTES))
        self.first, self.last = 0, (1 << 31) - 1
        self.slices: set[int] | None = None
        self.volumes: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what limits z and volume_id, exactly; the rest is left to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "z" and self._limit_z(f) or column == "volume_id" and self._limit_volumes(f):
                continue
            yield f

    def _limit_z(self, f: Filter) -> bool:
        value = getattr(f, "value", None)
        match f:
            case EqualTo():
                self.first, self.last = max(self.first, value), min(self.last, value)
            case GreaterThan():
                self.first = max(self.first, value + 1)
            case GreaterThanOrEqual():
                self.first = max(self.first, value)
            case LessThan():
                self.last = min(self.last, value - 1)
            case LessThanOrEqual():
                self.last = min(self.last, value)
            case In():
                self.slices = set(value) if self.slices is None else self.slices & set(value)
            case IsNotNull():
                pass
            case _:
                return False
        return True

    def _limit_volumes(self, f: Filter) -> bool:
        match f:
            case EqualTo():
                wanted = {f.value}
            case In():
                wanted = set(f.value)
            case IsNotNull():
                return True
            case _:
                return False
        self.volumes = wanted if self.volumes is None else self.volumes & wanted
        return True

    def _runs(self, entry: dict) -> Iterator[tuple[int, int]]:
        """Wanted stretches (first slice, end) of a file."""
        first, end = max(entry["z0"], self.first), min(entry["z0"] + entry["slices"], self.last + 1)
        if self.slices is None:
            if first < end:
                yield first, end
            return
        some = sorted(z for z in self.slices if z is not None and first <= z < end)
        for i, z in enumerate(some):
            if not i or some[i - 1] != z - 1:
                start = z
            if i + 1 == len(some) or some[i + 1] != z + 1:
                yield start, z + 1

    def partitions(self) -> list[Slabs]:
        out, open_, room = [], [], 0
        for entry in catalogue(self.path):
            if self.volumes is not None and entry["volume_id"] not in self.volumes:
                continue
            size = entry["nx"] * entry["ny"] * np.dtype(entry["kind"]).itemsize
            step = max(1, self.slab_bytes // size)
            for first, end in self._runs(entry):
                for z in range(first, end, step):
                    n = min(step, end - z)
                    if open_ and room < n * size:  # small runs share a task
                        out.append(Slabs(tuple(open_)))
                        open_ = []
                    room = (room if open_ else self.slab_bytes) - n * size
                    open_.append({**entry, "path": f"{self.path}/{entry['path']}", "z0": z, "slices": n, "content": None, "gzip": False,
                                  "offset": entry["offset"] + (z - entry["z0"]) * size})
        if open_:
            out.append(Slabs(tuple(open_)))
        return out or [Slabs(())]

    def read(self, partition: Slabs) -> Iterator[pa.RecordBatch]:
        for slab in partition.slabs:
            yield from _slab_batches(slab)


class VolumeWriter(DataSourceArrowWriter):
    """Takes whole slices (volume_id, z, nx, ny, kind, vals), in order of volume and z within a task."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: list[dict] = []
        out = None
        for batch in iterator:
            for i in range(batch.num_rows):
                at = {c: batch.column(batch.schema.get_field_index(c))[i] for c in ("volume_id", "z", "nx", "ny", "kind", "vals")}
                vals = at.pop("vals").values.to_numpy(zero_copy_only=False)
                row = {c: v.as_py() for c, v in at.items()}
                if len(vals) != row["nx"] * row["ny"]:
                    raise ValueError(f"{row['volume_id']}: slice {row['z']} has {len(vals)} of {row['nx'] * row['ny']} values")
                last = files[-1] if files else None
                if not last or any(last[c] != row[c] for c in ("volume_id", "nx", "ny", "kind")) or last["z0"] + last["slices"] != row["z"]:
                    if out:
                        out.close()
                    name = f"{uuid.uuid4().hex}.raw"
                    system, inner = file_system(f"{self.path}/{name}")
                    system.create_dir(inner.rpartition("/")[0])
                    out = system.open_output_stream(inner)
                    last = {"volume_id": row["volume_id"], "path": name, "nx": row["nx"], "ny": row["ny"], "z0": row["z"], "slices": 0,
                            "offset": 0, "kind": row["kind"], "slope": 1.0, "intercept": 0.0}
                    files.append(last)
                out.write(vals.astype(np.dtype(row["kind"])).tobytes())
                last["slices"] += 1
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = file_system(f"{self.path}/{CATALOGUE}")
        system.create_dir(inner)
        before = system.get_file_info(fs.FileSelector(inner)) if self.overwrite else []
        with system.open_output_stream(f"{inner}/{uuid.uuid4().hex}.json") as out:
            for m in messages:
                out.write("".join(json.dumps(f) + "\n" for f in (m.files if m else ())).encode())
        for info in before:
            system.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for f in m.files if m else ():
                system, inner = file_system(f"{self.path}/{f['path']}")
                system.delete_file(inner)


class VolumeFormat(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return VOXELS

    def reader(self, schema: StructType) -> VolumeReader:
        return VolumeReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeFormat)


def write_volumes(voxels: DataFrame, volumes: DataFrame, path: str, mode: str = "append") -> None:
    """Writes whole grids in their declared type and byte order; a task holds one slice at a time."""
    register(voxels.sparkSession)
    known = volumes.select("volume_id", "nx", "ny", kind_of().alias("kind"))
    at = attach(voxels, known, ["volume_id"], ["z", "y", "x"])
    place = (F.col("y").cast("bigint") * F.col("nx") + F.col("x")).alias("p")
    slices = at.groupBy("volume_id", "z", "nx", "ny", "kind").agg(
        F.array_sort(F.collect_list(F.struct(place, F.col("v").cast("double").alias("v")))).alias("_c"))
    slices.select("volume_id", "z", "nx", "ny", "kind", F.col("_c.v").alias("vals")).repartitionByRange(
        "volume_id", "z").sortWithinPartitions("volume_id", "z").write.format(NAME).mode(mode).save(path)


def read_volumes(spark: SparkSession, path: str, where: str | None = None, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """Voxels of a folder that meet a condition.

    Spark keeps one read plan for each ``load()``, with the filters that reach it first: a frame of one load must not be
    filtered in two ways. Call this once for every condition.
    """
    register(spark)
    found = spark.read.format(NAME).option("slabBytes", slab_bytes).load(path)
    return found if where is None else found.where(where)
