"""Side files that describe RAW volumes: JSON, volumeinfo and DAT, parsed with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import dbl
from ..model import VOXEL_TYPES
from .files import extension, file_name

# Format names of DAT files.
DAT_FORMATS = {
    "UCHAR": "uint8", "UINT8": "uint8", "BYTE": "uint8",
    "USHORT": "uint16", "UINT16": "uint16",
    "FLOAT": "float32", "FLOAT32": "float32",
}
JSON_SCHEMA = ("dimensions array<double>, dataType string, spacing array<double>, byteOrder string, isRGB boolean, "
               "min double, max double, description string")
COLUMNS = ["nx", "ny", "nz", "data_type", "sx", "sy", "sz", "byte_order", "is_rgb", "vmin", "vmax", "description"]


def read_side_files(spark: SparkSession, folder: str) -> DataFrame:
    """Whole side files (path, text) below a folder; they are small by nature."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.{[jJ][sS][oO][nN],[vV][oO][lL][uU][mM][eE][iI][nN][fF][oO],[dD][aA][tT]}").load(folder)
    return found.select("path", F.col("content").cast("string").alias("text"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def leading_int(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def leading_float(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def _or_one(c: Column) -> Column:
    return F.coalesce(F.when((c != 0) & ~F.isnan(c), c), F.lit(1.0))


def _pairs(lines: Column, sep: str, lower: bool) -> Column:
    """Key/value structs of lines, split at the first separator."""
    def pair(line: Column) -> Column:
        at = F.instr(line, sep)
        key = _strip(F.substring(line, F.lit(1), at - 1))
        return F.struct((F.lower(key) if lower else key).alias("k"), _strip(F.substring(line, at + 1, F.length(line))).alias("v"))
    return F.transform(F.filter(lines, lambda s: F.instr(s, sep) > 0), pair)


def _value(pairs: str, key: str) -> Column:
    """Value of the last line with this key."""
    return F.try_element_at(F.filter(F.col(pairs), lambda p: p["k"] == key), F.lit(-1))["v"]


def _is_float(name: Column) -> Column:
    return F.when(F.lower(name) == "float", F.lit("float32")).otherwise(name)


def load_meta_json(files: DataFrame) -> DataFrame:
    """Metadata of JSON side files (path, text)."""
    m = files.withColumn("_j", F.from_json("text", JSON_SCHEMA))
    dims, spacing = F.col("_j.dimensions"), F.col("_j.spacing")
    sized = F.when(F.size(dims) == 3, dims)
    return m.select("path", *[F.try_element_at(sized, F.lit(i + 1)).cast("int").alias(n) for i, n in enumerate(("nx", "ny", "nz"))],
                    _is_float(F.col("_j.dataType")).alias("data_type"),
                    *[F.coalesce(F.try_element_at(spacing, F.lit(i + 1)), F.when(spacing.isNull(), 1.0)).alias(n)
                      for i, n in enumerate(("sx", "sy", "sz"))],
                    F.col("_j.byteOrder").alias("byte_order"), F.col("_j.isRGB").alias("is_rgb"),
                    F.col("_j.min").alias("vmin"), F.col("_j.max").alias("vmax"), F.col("_j.description").alias("description"),
                    F.when(F.col("_j").isNull(), "invalid JSON").alias("error"))


def load_meta_volumeinfo(files: DataFrame) -> DataFrame:
    """Metadata of volumeinfo side files: the ``[Volume]`` section only."""
    m = files.withColumn("_l", F.transform(F.split("text", "\n"), _strip))
    m = m.withColumn("_at", F.array_position("_l", F.lit("[Volume]")))
    m = m.withColumn("_l", F.when(F.col("_at") > 0, F.slice("_l", F.col("_at").cast("int") + 1, F.size("_l"))).otherwise(
        F.array().cast("array<string>")))
    stop = F.array_position(F.transform("_l", lambda s: s.startswith("[") & s.endswith("]") & (s != "[Volume]")), F.lit(True))
    m = m.withColumn("_l", F.when(stop > 0, F.slice("_l", F.lit(1), stop.cast("int") - 1)).otherwise(F.col("_l")))
    m = m.withColumn("_p", _pairs(F.col("_l"), "=", False))
    dims = {n: leading_int(_value("_p", k)).cast("int") for n, k in (("nx", "SizeX"), ("ny", "SizeY"), ("nz", "SizeZ"))}
    kind = _value("_p", "Datatype")
    m = m.withColumns(dims)
    missing = F.col("nx").isNull() | F.col("ny").isNull() | F.col("nz").isNull()
    return m.select(
        "path", "nx", "ny", "nz", _is_float(F.coalesce(F.when(kind != "", kind), F.lit("uint16"))).alias("data_type"),
        *[_or_one(leading_float(_value("_p", f"VoxelSize{c.upper()}"))).alias(f"s{c}") for c in "xyz"],
        F.lit("little-endian").alias("byte_order"), F.lit(None).cast("boolean").alias("is_rgb"),
        leading_float(_value("_p", "Min")).alias("vmin"), leading_float(_value("_p", "Max")).alias("vmax"),
        _value("_p", "Description").alias("description"),
        F.when(missing, "missing or invalid SizeX/SizeY/SizeZ").alias("error"))


def load_meta_dat(files: DataFrame) -> DataFrame:
    """Metadata of DAT side files: ``key: value`` lines, ``#`` starts a comment."""
    lines = F.filter(F.transform(F.split("text", "\n"), _strip), lambda s: ~s.startswith("#"))
    m = files.withColumn("_p", _pairs(lines, ":", True))

    def numbers(text: Column, parse) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), parse), lambda x: x.isNotNull())

    thick = _value("_p", "slicethickness")
    m = m.withColumns({
        "_r": numbers(_value("_p", "resolution"), leading_int),
        "_s": numbers(F.coalesce(F.when(thick != "", thick), _value("_p", "spacing")), leading_float),
        "_f": F.upper(_strip(F.coalesce(_value("_p", "format"), F.lit("")))),
    })
    formats = F.create_map(*[F.lit(x) for kv in DAT_FORMATS.items() for x in kv])
    whole = F.size("_r") == 3
    sized = F.when(whole, F.col("_r"))
    return m.select(
        "path", *[F.try_element_at(sized, F.lit(i + 1)).cast("int").alias(n) for i, n in enumerate(("nx", "ny", "nz"))],
        formats[F.col("_f")].alias("data_type"),
        *[_or_one(F.try_element_at(F.col("_s"), F.lit(i + 1))).alias(n) for i, n in enumerate(("sx", "sy", "sz"))],
        F.lit(None).cast("string").alias("byte_order"), F.lit(None).cast("boolean").alias("is_rgb"),
        F.lit(None).cast("double").alias("vmin"), F.lit(None).cast("double").alias("vmax"),
        F.lit(None).cast("string").alias("description"),
        F.when(~whole, "missing or invalid Resolution").when(formats[F.col("_f")].isNull(), F.concat(
            F.lit("unsupported format: "), F.when(F.col("_f") != "", F.col("_f")).otherwise("unknown"))).alias("error"))


def load_meta(files: DataFrame) -> DataFrame:
    """Metadata of all side files, whatever their kind, in one job; check with ``validate_meta``."""
    known = files.withColumn("_ext", extension(file_name(F.col("path"))))
    parts = [
        load(known.where(F.col("_ext") == ext))
        for ext, load in (("json", load_meta_json), ("volumeinfo", load_meta_volumeinfo), ("dat", load_meta_dat))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def validate_meta(meta: DataFrame) -> DataFrame:
    """Adds ``reject_reason``, null for metadata that describes a volume."""
    dims = [F.col(n) for n in ("nx", "ny", "nz")]
    short = dims[0].isNull() | dims[1].isNull() | dims[2].isNull()
    flat = (dims[0] <= 0) | (dims[1] <= 0) | (dims[2] <= 0)
    kind = F.col("data_type")
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(short, "dimensions must have 3 elements").when(flat, "dimensions must be positive")
        .when(kind.isNull() | (kind == ""), "data type is missing")
        .when(~kind.isin(*VOXEL_TYPES), F.concat(F.lit("invalid data type "), kind)))
    return meta.withColumn("reject_reason", reason)


def split_meta(meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate_meta(meta)
    good = checked.where(F.col("reject_reason").isNull()).select("path", *COLUMNS)
    bad = checked.where(F.col("reject_reason").isNotNull()).select("path", "reject_reason")
    return good, bad


def range_of(meta: DataFrame) -> DataFrame:
    """Declared ranges, kept only where both ends are given."""
    both = F.col("vmin").isNotNull() & F.col("vmax").isNotNull()
    return meta.select("path", F.when(both, dbl("vmin")).alias("vmin"), F.when(both, dbl("vmax")).alias("vmax"))
