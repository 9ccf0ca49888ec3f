"""DICOM series: header decoding per file, then ordering, spacing and rescaling as DataFrame steps."""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import ORDER_BLOCK, attach, scan, spread_out, stage, with_order
from . import slabs

# Value representations with a 32-bit length, transfer syntaxes and the valid representations.
LONG_VR = {b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN"}
IMPLICIT_LE = "1.2.840.10008.1.2"
EXPLICIT_LE = "1.2.840.10008.1.2.1"
EXPLICIT_BE = "1.2.840.10008.1.2.2"
VALID_VR = set("AE AS AT CS DA DS DT FD FL IS LO LT OB OD OF OL OW PN SH SL SQ SS ST TM UC UI UL UN UR US UT".split())
# The tags read, with the field they fill and how their value is stored.
TAGS = {
    (0x0008, 0x103E): ("description", "text"),
    (0x0018, 0x0050): ("slice_thickness", "number"),
    (0x0018, 0x0088): ("spacing_between", "number"),
    (0x0020, 0x000E): ("series_uid", "text"),
    (0x0020, 0x0013): ("instance_no", "integer"),
    (0x0020, 0x0032): ("position", "list3"),
    (0x0020, 0x0037): ("orientation", "list6"),
    (0x0028, 0x0002): ("samples_per_pixel", "short"),
    (0x0028, 0x0008): ("frames", "integer"),
    (0x0028, 0x0010): ("rows", "short"),
    (0x0028, 0x0011): ("cols", "short"),
    (0x0028, 0x0030): ("pixel_spacing", "list2"),
    (0x0028, 0x0100): ("bits_allocated", "short"),
    (0x0028, 0x0103): ("pixel_representation", "short"),
    (0x0028, 0x1052): ("intercept", "number"),
    (0x0028, 0x1053): ("slope", "number"),
}
PIXEL_DATA = (0x7FE0, 0x0010)
ITEM, ITEM_END, SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
UNDEFINED = 0xFFFFFFFF

_FIELDS = (
    [(c, "string") for c in ("path", "series_uid", "description")]
    + [(c, "int") for c in ("rows", "cols", "bits_allocated", "pixel_representation", "samples_per_pixel", "frames", "instance_no")]
    + [(c, "array<double>") for c in ("position", "orientation", "pixel_spacing")]
    + [(c, "double") for c in ("slice_thickness", "spacing_between", "slope", "intercept")]
    + [(c, "bigint") for c in ("pixel_offset", "pixel_length", "file_length")] + [("skip_reason", "string")])
HEADER_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in _FIELDS)
_ARROW = pa.schema([(name, slabs.ARROW_TYPES[kind]) for name, kind in _FIELDS])
_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_INTEGER = re.compile(r"\s*([+-]?\d+)")


def _number(text: str):
    m = _NUMBER.match(text)
    return float(m.group(1)) if m else None


def _decode_value(data: bytes, form: str):
    if form == "short":
        return struct.unpack_from("<H", data)[0] if len(data) >= 2 else None
    text = data.split(b"\0", 1)[0].decode("latin-1").strip()
    if form == "text":
        return text
    if form == "number":
        return _number(text)
    if form == "integer":
        m = _INTEGER.match(text)
        return int(m.group(1)) if m else None
    numbers = [n for n in map(_number, text.split("\\")) if n is not None]
    return numbers[:int(form[4:])] or None


def _element(data: bytes, at: int, explicit: bool):
    """(tag, length, value position) of the element at a position, or None at the end of the data."""
    if at + 8 > len(data):
        return None
    tag = struct.unpack_from("<HH", data, at)
    if not explicit:
        return tag, struct.unpack_from("<I", data, at + 4)[0], at + 8
    if data[at + 4:at + 6] in LONG_VR:
        if at + 12 > len(data):
            return None
        return tag, struct.unpack_from("<I", data, at + 8)[0], at + 12
    return tag, struct.unpack_from("<H", data, at + 6)[0], at + 8


def _after_undefined(data: bytes, at: int, explicit: bool) -> int:
    """Position behind a sequence or item of undefined length; nesting is kept on a stack of end marks."""
    ends = [SEQUENCE_END]
    while ends and at + 8 <= len(data):
        tag = struct.unpack_from("<HH", data, at)
        if tag[0] == 0xFFFE:
            length = struct.unpack_from("<I", data, at + 4)[0]
            at += 8
            if tag == ends[-1]:
                ends.pop()
            elif tag == ITEM and length == UNDEFINED:
                ends.append(ITEM_END)
            elif length != UNDEFINED:
                at += length
            continue
        found = _element(data, at, explicit)
        if found is None:
            return len(data)
        _, length, at = found
        if length == UNDEFINED:
            ends.append(SEQUENCE_END)
        else:
            at += length
    return at


WINDOW = 64 << 10  # bytes of a file that are read first


class NeedsMore(Exception):
    """The beginning of a file at hand does not decide how to go on."""


def decode_header(data: bytes, size: int | None = None) -> dict:
    """Header fields of one file and where its pixels lie, or the reason to skip it.

    ``data`` may be the beginning of a file of ``size`` bytes; ``NeedsMore`` asks for a longer one.
    """
    size = len(data) if size is None else size
    partial = len(data) < size
    out = {"pixel_representation": 0, "samples_per_pixel": 1, "frames": 1, "slope": 1.0, "intercept": 0.0,
           "file_length": size, "skip_reason": None}
    at = 0
    if len(data) >= 132 and data[128:132] == b"DICM":
        at, syntax = 132, EXPLICIT_LE
        while at + 8 < len(data) and struct.unpack_from("<H", data, at)[0] == 0x0002:
            found = _element(data, at, True)
            if found is None:
                break
            tag, length, start = found
            if tag == (0x0002, 0x0010):
                syntax = _decode_value(data[start:start + length], "text") or EXPLICIT_LE
            at = start + length
        if partial and at + 8 >= len(data):
            raise NeedsMore
        if syntax == EXPLICIT_BE:
            return {**out, "skip_reason": "big-endian transfer syntax"}
        if syntax not in (IMPLICIT_LE, EXPLICIT_LE):
            return {**out, "skip_reason": f"unsupported transfer syntax {syntax}"}
        explicit = syntax == EXPLICIT_LE
    else:
        explicit = len(data) < 8 or data[4:6].decode("latin-1") in VALID_VR
    while at < len(data):
        found = _element(data, at, explicit)
        if found is None:
            break
        tag, length, start = found
        if tag == PIXEL_DATA:
            if length == UNDEFINED:
                return {**out, "skip_reason": "encapsulated pixel data"}
            out.update(pixel_offset=start, pixel_length=length)
            break
        if length == UNDEFINED:
            at = _after_undefined(data, start, explicit)
            continue
        if tag in TAGS:
            field, form = TAGS[tag]
            value = _decode_value(data[start:start + length], form)
            default = {"frames": value or 1, "slope": 1.0 if value is None else value,
                       "intercept": 0.0 if value is None else value}
            out[field] = default.get(field, value)
        at = start + length
    if partial and "pixel_offset" not in out:
        raise NeedsMore
    return out


def read_header(path: str) -> dict:
    """Header of a file, of which no more is read than a window that grows until the pixels are found."""
    with slabs.open_path(path) as source:
        size, window = source.seek(0, 2), WINDOW
        while True:
            source.seek(0)
            try:
                return decode_header(source.read(window), size)
            except NeedsMore:
                window *= 4


def decode_headers(files: DataFrame) -> DataFrame:
    """Headers of files (path and, for bytes at hand, content); pixel bytes stay behind.

    Without ``content`` files are opened by path, and their pixels are never read.
    """
    with_bytes = "content" in files.columns

    def work(batches):
        for batch in batches:
            for f in batch.to_pylist():
                head = decode_header(f["content"]) if with_bytes else read_header(f["path"])
                yield pa.RecordBatch.from_pylist([{"path": f["path"], **head}], schema=_ARROW)

    return files.select("path", *(["content"] if with_bytes else [])).mapInArrow(work, HEADER_SCHEMA)


def admit(headers: DataFrame) -> DataFrame:
    """Fills ``skip_reason`` for files that are no readable monochrome images."""
    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)) == 0

    reason = (
        F.when(F.col("skip_reason").isNotNull(), F.col("skip_reason"))
        .when(zero("rows") | zero("cols") | zero("bits_allocated"), "not an image")
        .when(F.coalesce("samples_per_pixel", F.lit(0)) != 1, "not monochrome")
        .when(F.col("pixel_offset").isNull(), "pixel data not found")
        .when(F.col("pixel_offset") + F.col("pixel_length") > F.col("file_length"), "pixel data extends beyond file")
        .when(~F.col("bits_allocated").isin(8, 16), "unsupported bits allocated"))
    return headers.withColumn("skip_reason", reason)


def consistency(headers: DataFrame) -> DataFrame:
    """Series whose slices differ in size."""
    shapes = headers.groupBy("series_id", "rows", "cols").agg(F.count(F.lit(1)).alias("_n"))
    return shapes.groupBy("series_id").agg(F.count(F.lit(1)).alias("shapes")).where(F.col("shapes") > 1)


def _dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _normal(o: Column) -> Column:
    return F.array(o[1] * o[5] - o[2] * o[4], o[2] * o[3] - o[0] * o[5], o[0] * o[4] - o[1] * o[3])


def series_order(headers: DataFrame) -> DataFrame:
    """Adds the slice number z within each series (series_id, file_no, position, orientation, instance_no).

    Slices follow their position along the normal of the first file's orientation, else the third position
    coordinate, else the instance number, else the input order; ties keep the input order. The order is a
    global sort with block-wise counting, so a series of any length is spread over all tasks.
    """
    if "skip_reason" in headers.columns:  # what is not read takes no slice number and decides no order
        headers = headers.where("skip_reason is null")
    headers = stage(headers)  # decoded once
    placed = F.coalesce(F.size("position") == 3, F.lit(False))
    facts = headers.groupBy("series_id").agg(
        F.bool_and(placed).alias("_all_placed"), F.bool_and(F.col("instance_no").isNotNull()).alias("_all_numbered"),
        F.min_by(F.struct("orientation"), "file_no")["orientation"].alias("_first"))
    facts = facts.select("series_id", "_all_placed", "_all_numbered", F.when(F.size("_first") == 6, _normal(F.col("_first"))).alias("_n"))
    at = attach(headers, facts, ["series_id"], ["file_no"])
    key = (
        F.when(F.col("_all_placed") & F.col("_n").isNotNull(), _dot(F.col("position"), F.col("_n")))
        .when(F.col("_all_placed"), F.col("position")[2])
        .when(F.col("_all_numbered"), F.col("instance_no").cast("double")))  # else file_no alone
    ordered = with_order(at.withColumn("_key", key).drop("_all_placed", "_all_numbered", "_n"), ["series_id", "_key", "file_no"])
    numbered = scan(ordered, ["series_id"], "_pos", {"_z": F.lit(1)}, block=ORDER_BLOCK)
    return numbered.withColumn("z", (F.col("_z") - 1).cast("int")).drop("_z", "_key")


def series_spacing(ordered: DataFrame) -> DataFrame:
    """Voxel spacing per series of ``series_order``: (series_id, sx, sy, sz).

    sz is the mean distance of consecutive slices, else the declared gap, else the thickness; 0 counts as 1.
    """
    first = ordered.groupBy("series_id").agg(F.min_by(F.struct(
        "orientation", "pixel_spacing", "spacing_between", "slice_thickness"), "file_no").alias("ref"))
    first = first.withColumn("_n", F.when(F.size("ref.orientation") == 6, _normal(F.col("ref.orientation"))))
    placed = ordered.where(F.size("position") == 3)
    steps = scan(placed, ["series_id"], "_pos", lags={"_prev": F.col("position")}, block=ORDER_BLOCK).where(
        F.col("_prev").isNotNull())
    steps = attach(steps.select("series_id", "position", "_prev", "file_no"), first.select("series_id", "_n"), ["series_id"], ["file_no"])
    p, q = F.col("position"), F.col("_prev")
    along = F.abs(_dot(p, F.col("_n")) - _dot(q, F.col("_n")))
    straight = F.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)
    gap = steps.groupBy("series_id").agg(F.avg(F.when(F.col("_n").isNotNull(), along).otherwise(straight)).alias("_gap"))

    def or_one(c: Column) -> Column:
        return F.coalesce(F.when((c != 0) & ~F.isnan(c), c), F.lit(1.0))

    def given(c: Column) -> Column:
        return F.when(c != 0, c)

    pair = F.col("ref.pixel_spacing")
    return first.join(gap, "series_id", "left").select(
        "series_id", or_one(F.try_element_at(pair, F.lit(2))).alias("sx"), or_one(F.try_element_at(pair, F.lit(1))).alias("sy"),
        or_one(F.coalesce("_gap", given(F.col("ref.spacing_between")), given(F.col("ref.slice_thickness")))).alias("sz"))


def pixel_slabs(ordered: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Slabs of admitted files of ``with_frames``; frames of a multi-frame file follow each other as slices.

    Without ``contents`` (path, content) the files are opened by path when the slabs are read, and a file with many
    frames is cut into slabs of about 50 MB.
    """
    kind = F.when(F.col("bits_allocated") == 8, "<u1").when(F.col("pixel_representation") == 1, "<i2").otherwise("<u2")
    frame = F.col("rows").cast("bigint") * F.col("cols") * F.expr("bits_allocated div 8")
    at = ordered.where(F.col("skip_reason").isNull())
    if contents is not None:
        at = at.join(contents.select("path", "content"), "path").withColumn("_from", F.lit(0))
        step = F.col("_slices")
    else:
        step = F.greatest(F.lit(1), F.floor(F.lit(slabs.SLAB_BYTES) / frame)).cast("int")
        at = at.withColumns({"content": F.lit(None).cast("binary"),
                             "_from": F.explode(F.sequence(F.lit(0), F.col("_slices") - 1, step))})
    return at.select(
        F.col("series_id").alias("volume_id"), "path", "content", F.lit(False).alias("gzip"),
        (F.col("pixel_offset") + F.col("_from") * frame).alias("offset"), kind.alias("kind"), F.col("cols").alias("nx"), F.col("rows").alias("ny"),
        (F.col("z") + F.col("_from")).alias("z0"), F.least(step, F.col("_slices") - F.col("_from")).alias("slices"),
        F.when(F.coalesce("slope", F.lit(0.0)) == 0, 1.0).otherwise(F.col("slope")).alias("slope"),
        F.coalesce("intercept", F.lit(0.0)).alias("intercept"))


def with_frames(ordered: DataFrame) -> DataFrame:
    """Frames of multi-frame files follow each other as slices, file by file in the order of ``series_order``.

    Fills ``skip_reason`` for files with too few pixels and for all files of a series whose slices differ in size.
    """
    shapes = ordered.groupBy("series_id").agg(
        ((F.min("rows") == F.max("rows")) & (F.min("cols") == F.max("cols"))).alias("_alike"))
    at = attach(ordered, shapes, ["series_id"], ["file_no"])
    many = F.col("frames") > 1
    need = F.col("rows").cast("bigint") * F.col("cols") * F.col("frames") * F.expr("bits_allocated div 8")
    at = at.withColumn("skip_reason", F.coalesce(
        "skip_reason", F.when(~F.col("_alike"), F.lit("slices of the series differ in size")),
        F.when(many & (F.col("pixel_length") < need), F.lit("multi-frame pixel data too short")))).drop("_alike")
    frames = F.when(F.col("skip_reason").isNotNull(), 0).when(many, F.col("frames")).otherwise(1).cast("int")
    counted = scan(at.withColumn("_slices", frames), ["series_id"], "_pos", {"_through": F.col("_slices")}, block=ORDER_BLOCK)
    return counted.withColumn("z", (F.col("_through") - F.col("_slices")).cast("int")).drop("_through")


def read_dicom(ordered: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Rescaled voxels (volume_id = series_id) of ordered headers."""
    framed = stage(with_frames(ordered))
    if contents is not None:  # the bytes travel with the rows, whose size tells how to deal them
        return slabs.read_slabs(pixel_slabs(framed, contents))
    return slabs.read_slabs(spread_out(pixel_slabs(framed), "path", "z0"))
