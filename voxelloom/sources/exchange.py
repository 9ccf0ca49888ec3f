"""Exchange of masks as JSON: single regions and whole segmentations.

Exports are text fragments in order, so that a document of any size is written by many tasks: joining the
files of a document's folder in name order gives the JSON. Imports take such fragments, of documents of any length, or
whole documents of one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.color import normalize_hex
from ..model import MAX_CLASS
from ..operators import mask as masking, rle, roi
from ..operators.mask import Written
from ..scale import attach, scan, stage

ROI_FORMAT = "viewer-roi-mask-v1"
PACKAGE_FORMAT = "viewer-segmentation-package-v1"
RUNS_PER_PART = 8192
MAX_DOCUMENT = 1 << 28
LAST_PART = 1 << 62

ROI_SCHEMA = (
    "format string, name string, colorHex string, classId double, dimensions array<double>, spacing array<double>, "
    "voxelCount double, mask struct<encoding:string, totalVoxels:double, oneCount:double, startsWith:double, runs:array<double>>")
TILE_SCHEMA = (
    "struct<coord:array<int>, size:array<int>, data:struct<encoding:string, totalVoxels:bigint, "
    "nonZeroVoxels:bigint, values:array<double>, lengths:array<double>>>")
PACKAGE_SCHEMA = (
    "format string, dimensions array<double>, spacing array<double>, classDataType string, chunkSize double, "
    f"tiles array<{TILE_SCHEMA}>, "
    "rois array<struct<id:string, classId:double, name:string, colorHex:string, visible:boolean, locked:boolean>>")


def _grid(masks: DataFrame, volumes: DataFrame) -> DataFrame:
    return masks.join(volumes.select("volume_id", "nx", "ny", "nz", "sx", "sy", "sz"), "volume_id")


def _open(fields: Column) -> Column:
    """JSON of a struct without its closing brace."""
    text = F.to_json(fields)
    return F.substring(text, F.lit(1), F.length(text) - 1)


def _shape() -> list[Column]:
    return [F.array("nx", "ny", "nz").alias("dimensions"), F.array("sx", "sy", "sz").alias("spacing")]


def export_roi_json(mask: DataFrame, masks: DataFrame, volumes: DataFrame, rois: DataFrame,
                    runs_per_part: int = RUNS_PER_PART) -> DataFrame:
    """Fragments (mask_id, roi_id, part_no, text) of one document per region with its binary run lengths."""
    key = ["mask_id", "class_id"]
    runs = stage(rle.rle_binary(mask, masks, volumes, rois.select(*key)))
    head = rois.join(rle.rle_header(runs), key).join(_grid(masks, volumes), "mask_id")
    opening = F.concat(
        _open(F.struct(
            F.lit(ROI_FORMAT).alias("format"), "name", F.col("color_hex").alias("colorHex"), F.col("class_id").alias("classId"),
            *_shape(), F.col("one_count").alias("voxelCount"))),
        F.lit(',"mask":'),
        _open(F.struct(F.lit(rle.BINARY_ENCODING).alias("encoding"), F.col("total_voxels").alias("totalVoxels"),
                       F.col("one_count").alias("oneCount"), F.col("starts_with").alias("startsWith"))),
        F.lit(',"runs":['))
    part = F.expr(f"(run_no - 1) div {int(runs_per_part)} + 1")
    body = runs.groupBy(*key, part.alias("part_no")).agg(
        F.array_sort(F.collect_list(F.struct("run_no", "len"))).alias("_r"))  # at most runs_per_part runs
    body = body.withColumn("text", F.concat(
        F.when(F.col("part_no") > 1, ",").otherwise(""), F.concat_ws(",", F.transform("_r.len", lambda n: n.cast("string")))))
    ids = rois.select(*key, "roi_id")
    body = attach(body.select(*key, "part_no", "text"), ids, key, ["part_no"]).select("mask_id", "roi_id", "part_no", "text")
    ends = head.select("mask_id", "roi_id", F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("part_no"), opening.alias("text")),
        F.struct(F.lit(1 << 62).cast("bigint").alias("part_no"), F.lit("]}}").alias("text")))).alias("e"))
    return body.unionByName(ends.select("mask_id", "roi_id", "e.part_no", "e.text"))


def export_package(mask: DataFrame, masks: DataFrame, volumes: DataFrame, rois: DataFrame, chunk: int = rle.TILE) -> DataFrame:
    """Fragments (mask_id, part_no, text) of one document per mask: its tiles and its regions."""
    cs = max(rle.MIN_TILE, int(chunk))
    grid = _grid(masks, volumes)
    dense = rle.dense_rows(mask, masks, volumes)
    tiles = stage(rle.pack_tiles(rle.tile_runs(dense, masks, volumes, cs)))
    at = attach(tiles, grid.select("mask_id", "nx", "ny"), ["mask_id"], ["cz", "cy", "cx"])
    across, down = F.expr(f"cast((nx + {cs - 1}) div {cs} as bigint)"), F.expr(f"cast((ny + {cs - 1}) div {cs} as bigint)")
    at = at.withColumn("part_no", F.col("cx") + F.col("cy") * across + F.col("cz") * across * down + 1)
    first = at.groupBy("mask_id").agg(F.min("part_no").alias("_first"))
    at = attach(at, first, ["mask_id"], ["part_no"])
    tile = F.to_json(F.struct(
        F.array("cx", "cy", "cz").alias("coord"), F.array("size_x", "size_y", "size_z").alias("size"),
        F.struct(F.lit(rle.LABEL_ENCODING).alias("encoding"), F.col("total_voxels").alias("totalVoxels"),
                 F.col("nonzero_voxels").alias("nonZeroVoxels"), "values", "lengths").alias("data")))
    body = at.select("mask_id", "part_no", F.concat(F.when(F.col("part_no") > F.col("_first"), ",").otherwise(""), tile).alias("text"))
    # At most one region per class id.
    listed = rois.groupBy("mask_id").agg(F.array_sort(F.collect_list(F.struct(
        "ordinal", F.struct(F.col("roi_id").alias("id"), F.col("class_id").alias("classId"), "name",
                            F.col("color_hex").alias("colorHex"), "visible", "locked").alias("r")))).alias("_r"))
    ends = grid.join(listed, "mask_id", "left").select("mask_id", F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("part_no"), F.concat(
            _open(F.struct(F.lit(PACKAGE_FORMAT).alias("format"), *_shape(), F.col("class_data_type").alias("classDataType"),
                           F.lit(cs).alias("chunkSize"))), F.lit(',"tiles":[')).alias("text")),
        F.struct(F.lit(1 << 62).cast("bigint").alias("part_no"), F.concat(
            F.lit('],"rois":'), F.coalesce(F.to_json("_r.r"), F.lit("[]")), F.lit("}")).alias("text")))).alias("e"))
    return body.unionByName(ends.select("mask_id", "e.part_no", "e.text"))


def write_fragments(fragments: DataFrame, key: list[str], path: str) -> None:
    """Writes documents as folders of text files whose names follow the fragment order.

    Fragments end between two tokens, so the line breaks between them are white space to a JSON parser.
    """
    ordered = fragments.repartitionByRange(*key, "part_no").sortWithinPartitions(*key, "part_no")
    ordered.select(*key, "text").write.partitionBy(*key).mode("overwrite").text(path)


def documents(fragments: DataFrame, key: list[str], limit: int = MAX_DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """Whole documents (key, text) and those too long for one row, which only ``write_fragments`` can deliver.

    Lengths are added up first, so no group above the limit is ever gathered.
    """
    sized = stage(fragments.groupBy(*key).agg(F.sum(F.length("text")).alias("length")))
    small = sized.where(F.col("length") <= limit).select(*key)
    kept = attach(fragments, small, key, ["part_no"], "left_semi")
    whole = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part_no", "text"))).alias("_f"))
    return whole.select(*key, F.concat_ws("", "_f.text").alias("text")), sized.where(F.col("length") > limit)


def _same_grid(dims: Column) -> Column:
    return (dims[0] == F.col("nx")) & (dims[1] == F.col("ny")) & (dims[2] == F.col("nz"))


def _ends(fragments: DataFrame, key: list[str]) -> DataFrame:
    """(key, head, tail): first and last fragment of every document, null where there is none."""
    return fragments.groupBy(*key).agg(
        F.max(F.when(F.col("part_no") == 0, F.col("text"))).alias("head"),
        F.max(F.when(F.col("part_no") == LAST_PART, F.col("text"))).alias("tail"))


def _body(fragments: DataFrame) -> DataFrame:
    """What stands between the ends, without the comma that joins it to the fragment before."""
    return fragments.where((F.col("part_no") > 0) & (F.col("part_no") < LAST_PART)).withColumn(
        "text", F.regexp_replace("text", r"^\s*,", ""))


def import_roi_fragments(fragments: DataFrame, mask: DataFrame, masks: DataFrame, volumes: DataFrame, rois: DataFrame,
                         max_class: int | None = None) -> tuple[Written, DataFrame, DataFrame]:
    """``import_roi_json`` of documents of any length, as fragments (mask_id, doc_no, part_no, text) of ``export_roi_json``."""
    key = ["mask_id", "doc_no"]
    body = stage(_body(fragments).select(*key, "part_no", F.transform(
        F.split("text", ","), lambda n: F.trim(n).try_cast("double")).alias("_runs")))
    bad = body.where(F.exists("_runs", lambda n: n.isNull())).select(*key).distinct().withColumn("_bad", F.lit(True))
    head = F.when((F.regexp_replace("tail", r"\s", "") == "]}}") & F.col("_bad").isNull(), F.concat("head", F.lit("]}}")))
    d = _ends(fragments, key).join(bad, key, "left").select(*key, F.from_json(head, ROI_SCHEMA).alias("j"))
    sized = scan(body.select(*key, "part_no", F.size("_runs").alias("_size")), key, "part_no", {"_end": F.col("_size")})
    runs = body.join(sized.select(*key, "part_no", (F.col("_end") - F.col("_size")).alias("_before")), [*key, "part_no"]).select(
        *key, "_before", F.posexplode("_runs").alias("_i", "length")).select(
        *key, (F.col("_before") + F.col("_i") + 1).alias("run_no"), "length")
    return _import_rois(d, runs, mask, masks, volumes, rois, max_class)


def import_roi_json(docs: DataFrame, mask: DataFrame, masks: DataFrame, volumes: DataFrame, rois: DataFrame,
                    max_class: int | None = None) -> tuple[Written, DataFrame, DataFrame]:
    """Adds region documents (mask_id, doc_no, text) to masks: the written mask, the new registry, the refused.

    Documents are taken in the order ``doc_no``; each gets the next free class id, and later ones overwrite.
    """
    d = docs.withColumn("j", F.from_json("text", ROI_SCHEMA)).drop("text")
    return _import_rois(d, None, mask, masks, volumes, rois, max_class)


def _import_rois(d: DataFrame, runs: DataFrame | None, mask: DataFrame, masks: DataFrame, volumes: DataFrame, rois: DataFrame,
                 max_class: int | None) -> tuple[Written, DataFrame, DataFrame]:
    """Imports parsed documents (mask_id, doc_no, j) with their runs (mask_id, doc_no, run_no, length), which else are in ``j``."""
    key = ["mask_id", "doc_no"]
    d = d.join(_grid(masks, volumes).select("mask_id", "nx", "ny", "nz"), "mask_id")
    m = F.col("j.mask")
    shaped = (
        (F.col("j.format") == ROI_FORMAT) & F.col("j.name").isNotNull() & (F.size("j.dimensions") == 3) & (F.size("j.spacing") == 3)
        & (m["encoding"] == rle.BINARY_ENCODING) & m["totalVoxels"].isNotNull() & m["oneCount"].isNotNull()
        & m["startsWith"].isin(0, 1) & m["runs"].isNotNull())
    reason = F.when(F.col("j").isNull() | ~F.coalesce(shaped, F.lit(False)), "unsupported ROI file format").when(
        ~_same_grid(F.col("j.dimensions")), "dimensions do not match").when(
        m["totalVoxels"] != F.col("nx").cast("double") * F.col("ny") * F.col("nz"), "mask length mismatch")
    d = stage(d.withColumn("reject_reason", reason))
    good = d.where(F.col("reject_reason").isNull())
    if runs is None:
        runs = good.select(*key, F.posexplode("j.mask.runs").alias("run_no", "length")).withColumn("run_no", F.col("run_no") + 1)
    else:
        runs = attach(runs, good.select(*key), key, ["run_no"], "left_semi")
    heads = good.select(*key, F.col("j.mask.totalVoxels").cast("bigint").alias("total_voxels"),
                        F.col("j.mask.startsWith").cast("int").alias("starts_with"))
    positions, broken = rle.rle_binary_decode(runs, heads, key)
    fine = good.join(broken.select(*key), key, "left_anti")
    # More documents per mask than there are class ids cannot be admitted, so the rank limit reaches the shuffle.
    nth = F.row_number().over(W.partitionBy("mask_id").orderBy("doc_no"))
    wanted = stage(fine.withColumn("nth", nth).where(F.col("nth") <= (max_class or MAX_CLASS["uint16"])).select(
        *key, "nth", F.when(F.trim("j.name") != "", F.trim("j.name")).alias("name"), normalize_hex(F.col("j.colorHex")).alias("color_hex")))
    new = stage(roi.add_rois(masks, rois, wanted.drop("doc_no"), max_class))
    asked = wanted.groupBy("mask_id").agg(F.max("nth").alias("n"))
    free = roi.free_class_ids(masks, rois, max_class, asked).withColumnRenamed("rank", "nth")
    classes = stage(wanted.select(*key, "nth").join(free, ["mask_id", "nth"]))
    cells = attach(rle.positions_to_voxels(positions, masks, volumes), classes, key, ["z", "y", "x"])
    written = masking.set_voxels(mask, masks, volumes, cells.select("mask_id", "z", "y", "x", F.col("nth").alias("seq"), "class_id"))
    full = fine.select(*key).join(classes.select(*key), key, "left_anti").select(*key, F.lit(roi.NO_FREE_CLASS).alias("reject_reason"))
    refused = d.where(F.col("reject_reason").isNotNull()).select(*key, "reject_reason").unionByName(
        broken.select(*key, F.lit("runs do not add up").alias("reject_reason"))).unionByName(full)
    return written, rois.unionByName(new.select(*rois.columns)), refused


def import_package_fragments(fragments: DataFrame, masks: DataFrame, volumes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``import_package`` of documents of any length, as fragments (mask_id, part_no, text) of ``export_package``."""
    listed = F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), f"array<{TILE_SCHEMA}>")
    body = stage(_body(fragments).select("mask_id", F.explode_outer(listed).alias("t")))
    data = F.col("t.data")
    broken = F.col("t.coord").isNull() | F.col("t.size").isNull() | data["totalVoxels"].isNull() | data["values"].isNull() | data["lengths"].isNull()
    bad = body.where(broken).select("mask_id").distinct().withColumn("_bad", F.lit(True))
    head = F.from_json(F.when(F.col("_bad").isNull(), F.concat("head", F.lit('],"rois":[]}'))), PACKAGE_SCHEMA)
    tail = F.from_json(F.concat(F.lit('{"tiles":['), F.col("tail")), PACKAGE_SCHEMA)
    d = _ends(fragments, ["mask_id"]).join(bad, "mask_id", "left").select("mask_id", head.alias("j"), tail.alias("_t"))
    j = F.when(F.col("j").isNotNull(), F.col("j").withField("rois", F.col("_t.rois")))
    return _import_package(d.select("mask_id", j.alias("j")), body, masks, volumes)


def import_package(docs: DataFrame, masks: DataFrame, volumes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Restores segmentation documents (mask_id, text), one per mask: mask rows, registry, refused documents.

    The mask is cleared first. Regions come in class order; a document without usable ones gets one region
    per class in use.
    """
    return _import_package(docs.withColumn("j", F.from_json("text", PACKAGE_SCHEMA)).drop("text"), None, masks, volumes)


def _import_package(d: DataFrame, tiles: DataFrame | None, masks: DataFrame,
                    volumes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Restores parsed documents (mask_id, j) with their tiles (mask_id, t), which else are in ``j``."""
    d = d.join(_grid(masks, volumes).select("mask_id", "nx", "ny", "nz"), "mask_id")
    shaped = (
        (F.col("j.format") == PACKAGE_FORMAT) & (F.size("j.dimensions") == 3) & (F.size("j.spacing") == 3)
        & F.col("j.classDataType").isin("uint8", "uint16") & F.col("j.chunkSize").isNotNull()
        & F.col("j.tiles").isNotNull() & F.col("j.rois").isNotNull())
    reason = F.when(F.col("j").isNull() | ~F.coalesce(shaped, F.lit(False)), "unsupported package format").when(
        ~_same_grid(F.col("j.dimensions")), "dimensions do not match")
    d = stage(d.withColumn("reject_reason", reason))
    good = d.where(F.col("reject_reason").isNull())
    chunk = F.greatest(F.lit(rle.MIN_TILE), F.floor(F.when(F.col("j.chunkSize") != 0, F.col("j.chunkSize")).otherwise(rle.TILE))).cast("int")
    if tiles is None:
        tiles = good.select("mask_id", chunk.alias("chunk"), F.explode("j.tiles").alias("t"))
    else:
        tiles = attach(tiles, good.select("mask_id", chunk.alias("chunk")), ["mask_id"], ["t"])
    tiles = tiles.select(
        "mask_id", "chunk", *[F.col("t.coord")[i].alias(f"c{c}") for i, c in enumerate("xyz")],
        *[F.col("t.size")[i].alias(f"size_{c}") for i, c in enumerate("xyz")],
        F.col("t.data.totalVoxels").alias("total_voxels"), F.col("t.data.values").alias("values"), F.col("t.data.lengths").alias("lengths"))
    rows, broken = rle.tiles_restore(stage(tiles), masks, volumes)
    bad_ids = stage(broken.select("mask_id").distinct())
    rows = stage(attach(rows, bad_ids, ["mask_id"], ["z", "y", "x"], "left_anti"))
    fine = good.join(bad_ids, "mask_id", "left_anti")
    listed = fine.select("mask_id", F.posexplode("j.rois").alias("pos", "r")).where(
        F.col("r.id").isNotNull() & (F.col("r.classId") > 0) & ~F.isnan("r.classId") & (F.col("r.classId") < F.lit(float("inf"))))
    order = F.struct(F.col("r.classId").alias("a"), F.col("pos").alias("b"))
    candidates = listed.select("mask_id", order.alias("nth"), F.floor("r.classId").alias("class_id"), F.col("r.id").alias("roi_id"),
                               "r.name", normalize_hex(F.col("r.colorHex")).alias("color_hex"), "r.visible", "r.locked")
    none = F.lit(None)
    used = masking.used_class_ids(rows, masks).join(fine.select("mask_id"), "mask_id").join(
        candidates.select("mask_id").distinct(), "mask_id", "left_anti")
    spare = used.select("mask_id", F.struct(F.col("class_id").cast("double").alias("a"), F.lit(0).alias("b")).alias("nth"),
                        F.col("class_id").cast("bigint").alias("class_id"), none.cast("string").alias("roi_id"), none.cast("string").alias("name"),
                        none.cast("string").alias("color_hex"), none.cast("boolean").alias("visible"), none.cast("boolean").alias("locked"))
    registry = roi.add_rois_with_class(candidates.unionByName(spare))
    refused = d.where(F.col("reject_reason").isNotNull()).select("mask_id", "reject_reason").unionByName(
        good.join(bad_ids, "mask_id", "left_semi").select("mask_id", F.lit("tiles do not add up").alias("reject_reason")))
    return rows, registry, refused
