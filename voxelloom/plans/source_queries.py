"""Registered queries for sources, sinks and streams, on files and events made from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import rgb_to_gray as to_gray
from ..operators import catalog, measure, resample, slicing
from ..scale import shared_folder, stage
from ..sources import bricks, dicom, exchange, files as grouping, images, meta, nifti, slabs
from ..streaming import edits as edit_stream, slabs as slab_stream
from . import files
from .grids import EVENT_CLASS, Grids
from .queries import query, r6


def _folder(g: Grids, name: str) -> str:
    return f"{shared_folder(g.spark)}/voxelloom-{name}/{uuid.uuid4().hex}"


# ---- files and metadata ----------------------------------------------------------------------

EXTENSIONS = [".raw", ".RAW", ".json", ".raw.volumeinfo", ".dat", ".nii", ".nii.gz", ".dcm", ".tif", ".PNG", ".txt"]


def _listing(g: Grids) -> DataFrame:
    """File names made from documents: a few base names per folder, in mixed kinds."""
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 11 + 1).cast("int"))
    return g.table("documents").select(
        F.concat(F.lit("dir"), (F.col("doc_id") % 7).cast("string")).alias("selection"), F.col("doc_id").alias("file_no"),
        F.concat(F.lit("dir"), (F.col("doc_id") % 7).cast("string"), F.lit("/scan"),
                 F.expr("cast((doc_id div 5) % 23 as string)"), ext).alias("path"))


@query
def group_files(g):
    return grouping.group_files(_listing(g))[0]


@query
def unpaired_files(g):
    return grouping.group_files(_listing(g))[1]


def _meta_json(g):
    text = F.expr("""concat('{"dimensions": [', p_size, ', ', p_size + 1, if(p_partkey % 9 = 0, '', concat(', ', p_partkey % 11)), '], "dataType": "',
        element_at(array('uint8', 'uint16', 'float', 'int16'), cast(p_partkey % 4 + 1 as int)), '"',
        if(p_partkey % 2 = 0, concat(', "spacing": [0.5, 0.25, ', p_size / 10.0D, ']'), ''),
        if(p_partkey % 3 = 0, ', "min": -5, "max": 70.5', ''), ', "isRGB": ', p_size = 3, ', "description": "', p_name, '"}')""")
    return g.table("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"), text.alias("text"))


def _meta_volumeinfo(g):
    text = F.expr("""concat_ws('\\n', '; comment', '[Header]', 'SizeX=9999', '[Volume]', concat('SizeX = ', p_size), concat('SizeY=', p_size + 1),
        if(p_partkey % 9 = 0, 'SizeZ=none', concat('SizeZ=', p_partkey % 11)), if(p_partkey % 4 = 3, '', concat('Datatype=', if(p_partkey % 4 = 0, 'Float', 'uint8'))),
        concat('VoxelSizeX=', p_partkey % 3), 'VoxelSizeY=0.25 mm', concat('Min=', p_size), 'Description=a=b', '[Other]', 'SizeX=1', 'Max=7')""")
    return g.table("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".raw.volumeinfo")).alias("path"), text.alias("text"))


def _meta_dat(g):
    text = F.expr("""concat_ws('\\n', '# Resolution: 9 9 9', concat('RESOLUTION:  ', p_size, '  ', p_size + 1, if(p_partkey % 9 = 0, '', concat(' ', p_partkey % 11))), '',
        if(p_partkey % 2 = 0, 'SliceThickness: 0.5 0.25 2', 'Spacing: 0.125'),
        concat('Format: ', element_at(array('uchar', 'USHORT', ' Float ', 'int'), cast(p_partkey % 4 + 1 as int))))""")
    return g.table("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".dat")).alias("path"), text.alias("text"))


@query
def meta_json(g):
    return meta.load_meta_json(_meta_json(g))


@query
def meta_volumeinfo(g):
    return meta.load_meta_volumeinfo(_meta_volumeinfo(g))


@query
def meta_dat(g):
    return meta.load_meta_dat(_meta_dat(g))


@query
def validate_meta(g):
    every = _meta_json(g).unionByName(_meta_volumeinfo(g)).unionByName(_meta_dat(g))
    return meta.validate_meta(meta.load_meta(every)).select("path", "nx", "ny", "nz", "data_type", "reject_reason")


@query
def meta_range(g):
    return meta.range_of(meta.load_meta_json(_meta_json(g)))


# ---- binary volumes --------------------------------------------------------------------------

@query
def raw_slabs(g):
    """Slabs whose bytes travel with the row, read as float32 in either byte order."""
    data = files.raw_slices(g.voxels).join(g.volumes.select("volume_id", "nx", "ny"), "volume_id")
    order = F.when(F.col("z") % 2 == 1, ">f4").otherwise("<f4")
    plan = data.select(
        "volume_id", "path", "content", F.lit(False).alias("gzip"), F.lit(0).cast("bigint").alias("offset"), order.alias("kind"),
        "nx", "ny", F.col("z").alias("z0"), F.lit(1).alias("slices"), F.lit(1.0).alias("slope"), F.lit(0.0).alias("intercept"))
    return slabs.read_slabs(plan)


@query
def raw_slab_plan(g):
    """Slab boundaries of both grids at 8 kB per slab, for slices from 3 on."""
    at = g.volumes.select(
        "volume_id", "nx", "ny", "nz", F.concat("volume_id", F.lit(".raw")).alias("path"), F.lit(None).cast("binary").alias("content"),
        F.lit(False).alias("gzip"), F.lit(0).cast("bigint").alias("offset"), F.lit("<u2").alias("kind"), F.lit(1.0).alias("slope"),
        F.lit(0.0).alias("intercept"), F.lit(2).alias("bpv"))
    return slabs.plan_slabs(at, z_from=3, slab_bytes=8192).select("volume_id", "offset", "z0", "slices")


def _dicom(g, data=None):
    data = files.dicom_slices(g.voxels) if data is None else data
    headers = dicom.admit(dicom.decode_headers(data))
    headers = headers.withColumn("series_id", F.regexp_extract("path", "^([^/]*)/", 1)).withColumn("file_no", F.col("path"))
    return data, headers


@query
def dicom_headers(g):
    _, headers = _dicom(g)
    return headers.select("path", "rows", "cols", "bits_allocated", "instance_no", F.col("position")[2].alias("position_z"),
                          "slope", "intercept", "pixel_length", "skip_reason")


@query
def dicom_frames(g):
    """Voxels of files with up to three frames each."""
    data, headers = _dicom(g, files.dicom_frames(g.voxels))
    return dicom.read_dicom(dicom.series_order(headers), data)


@query
def dicom_voxels(g):
    data, headers = _dicom(g)
    return dicom.read_dicom(dicom.series_order(headers), data)


@query
def dicom_volume_spacing(g):
    return dicom.series_spacing(dicom.series_order(_dicom(g)[1]))


def _headers(g):
    """Slice headers made from orders: a customer's orders form a series."""
    return g.table("orders").selectExpr(
        "o_custkey as series_id", "o_orderkey as file_no",
        "if(o_custkey % 4 = 3 and o_orderkey % 2 = 1, null, array(0.0D, 1.0D, o_totalprice)) as position",
        "if(o_custkey % 4 = 0, array(1.0D, 0.0D, 0.0D, 0.0D, -1.0D, 0.0D), cast(null as array<double>)) as orientation",
        "if(o_custkey % 8 = 7 and o_orderkey % 3 = 0, null, cast(o_orderkey % 97 as int)) as instance_no",
        "if(o_custkey % 3 = 0, array(0.5D, 0.75D), cast(null as array<double>)) as pixel_spacing",
        "if(o_custkey % 5 = 0, 1.5D, cast(null as double)) as spacing_between", "cast(o_custkey % 2 as double) * 2 as slice_thickness")


@query
def series_order(g):
    return dicom.series_order(_headers(g)).select("series_id", "file_no", "z")


@query
def series_spacing(g):
    out = dicom.series_spacing(dicom.series_order(_headers(g)))
    return out.select("series_id", "sx", "sy", r6("sz").alias("sz"))


@query
def dicom_consistency(g):
    return dicom.consistency(g.table("orders").selectExpr(
        "o_custkey as series_id", "512 as rows", "if(o_custkey % 3 = 0 and o_orderkey % 5 = 0, 256, 512) as cols"))


@query
def dicom_admit(g):
    heads = g.table("orders").selectExpr(
        "o_orderkey as file_no", "if(o_orderkey % 7 = 0, 'encapsulated pixel data', cast(null as string)) as skip_reason",
        "cast(o_orderkey % 5 * 64 as int) as rows", "64 as cols", "cast(o_orderkey % 3 * 8 + 8 as int) as bits_allocated",
        "cast(if(o_orderkey % 11 = 0, 3, 1) as int) as samples_per_pixel", "if(o_orderkey % 13 = 0, null, 500L) as pixel_offset",
        "o_orderkey % 1000 as pixel_length", "1400L as file_length")
    return dicom.admit(heads).select("file_no", "skip_reason")


@query
def nifti_voxels(g):
    return nifti.read_nifti(nifti.decode_headers(files.nifti_slices(g.voxels)))


@query
def nifti_headers(g):
    heads = nifti.decode_headers(files.nifti_slices(g.voxels))
    return heads.select("path", "gzip", "kind", "nx", "ny", "nz", "sx", "sy", "sz", "offset", "slope", "intercept", "description")


@query
def nifti_time(g):
    """Files of several time points, each a volume of its own."""
    return nifti.read_nifti(nifti.time_points(nifti.decode_headers(files.nifti_times(g.voxels))))


# ---- images ----------------------------------------------------------------------------------

def _pixels(g):
    """Every xy slice of events as an image; odd ones are coloured."""
    return g.voxels.where("volume_id = 'events'").selectExpr(
        "concat('img', z) as path", "y", "x", "v % 256 as r", "if(z % 2 = 0, v % 256, v div 256) as g",
        "if(z % 2 = 0, v % 256, (v * 7) % 256) as b")


@query
def is_grayscale(g):
    return images.is_grayscale(_pixels(g))


@query
def image_to_voxels(g):
    pixels = _pixels(g)
    return images.image_to_voxels(pixels, images.is_grayscale(pixels))


@query
def channel_labels(g):
    volumes = images.image_volumes(images.is_grayscale(_pixels(g)))
    at = volumes.withColumn("z", F.explode(F.expr("sequence(0, nz - 1)")))
    return at.select("volume_id", "z", catalog.channel_label(F.col("z")).alias("label"), (F.col("nz") == 1).alias("single_slice"))


@query
def rgb_to_gray(g):
    return _pixels(g).select("path", "y", "x", r6(to_gray(F.col("r"), F.col("g"), F.col("b"))).alias("gray"))


@query
def natural_sort_stack(g):
    names = g.table("part").selectExpr(
        "concat('stack', p_size) as stack_id",
        "concat(if(p_partkey % 2 = 0, 'Slice', 'slice'), (p_partkey * 7919) % 100003, if(p_partkey % 3 = 0, '.TIF', '.tiff')) as name")
    return images.natural_sort_stack(names)


def _pages(g):
    return g.table("orders").selectExpr(
        "o_custkey as stack_id", "o_orderkey as page_no", "if(o_custkey % 6 = 0 and o_orderkey % 4 = 0, 99, 100) as width", "80 as height",
        "cast(if(o_custkey % 2 = 0, 16, 8) as int) as bits", "cast(if(o_custkey % 5 = 0, 3, 1) as int) as samples", "1 as photometric")


@query
def stack_pages(g):
    return images.stack_pages(_pages(g))[0].select("stack_id", "page_no", "z", "data_type", "nz")


@query
def stack_refused(g):
    return images.stack_pages(_pages(g))[1]


@query
def stack_problems(g):
    return images.stack_problems(images._numbered(_pages(g), ["stack_id", "page_no"]))


@query
def page_voxels(g):
    """Slices of events as pages of one 16-bit and one 8-bit stack."""
    pixels = g.voxels.where("volume_id = 'events'").selectExpr(
        "z % 2 as stack_id", "z as page_no", "y", "x", "v % 256 as r", "v as gray16")
    pages = pixels.groupBy("stack_id", "page_no").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")).withColumns({
        "bits": F.when(F.col("stack_id") == 0, 16).otherwise(8), "samples": F.lit(1), "photometric": F.lit(1)})
    return images.page_voxels(pixels, images.stack_pages(pages)[0])


# ---- exchange --------------------------------------------------------------------------------

@query
def export_roi_json(g):
    return exchange.export_roi_json(g.mask, g.masks, g.volumes, g.rois, runs_per_part=512)


def _roi_documents(g):
    return stage(exchange.export_roi_json(g.mask, g.masks, g.volumes, g.rois))


def _imported(g):
    """Every region comes back twice, once with a wrong total; all masks hold class 1 beforehand."""
    docs = _roi_documents(g).withColumn("doc_no", F.regexp_extract("roi_id", r"(\d+)", 1).cast("int")).drop("roi_id")
    broken = docs.withColumns({"doc_no": F.col("doc_no") + 100, "text": F.regexp_replace("text", '"startsWith":(.)', '"startsWith":7')})
    return exchange.import_roi_fragments(
        docs.unionByName(broken), g.mask.where("class_id = 1"), g.masks, g.volumes, g.rois.where("class_id = 1"))


@query
def import_roi_mask(g):
    return _imported(g)[0].mask


@query
def import_roi_registry(g):
    return _imported(g)[1]


@query
def import_roi_refused(g):
    return _imported(g)[2]


@query
def export_package(g):
    return exchange.export_package(g.mask, g.masks, g.volumes, g.rois, chunk=16)


def _package(g):
    docs = exchange.export_package(g.mask, g.masks, g.volumes, g.rois, chunk=16)
    # One of the masks comes without regions.
    return stage(docs.withColumn("text", F.when(
        F.col("mask_id") == "m_prio", F.regexp_replace("text", r'"rois":\[.*\]\}$', '"rois":[]}')).otherwise(F.col("text"))))


@query
def import_package_mask(g):
    return exchange.import_package_fragments(_package(g), g.masks, g.volumes)[0]


@query
def import_package_registry(g):
    return exchange.import_package_fragments(_package(g), g.masks, g.volumes)[1]


@query
def bricks_roundtrip(g):
    """Written as bricks, read back for a coordinate range on two axes."""
    path = _folder(g, "bricks")
    bricks.write_bricks(g.voxels, g.volumes, path, 16)
    found = bricks.read_bricks(g.spark, path, size=16, y=(5, 20), x=(0, 9))
    return bricks.voxels_of(found, 16, y=(5, 20), x=(0, 9))


# ---- streams ---------------------------------------------------------------------------------

def _stream(g, table: str):
    schema = g.table(table).schema
    return g.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(g.sf_dir)


def _edit_stream(g):
    return _stream(g, "events").selectExpr(
        "'m_edit' as mask_id", "event_id as seq", "0 as z", "cast(((event_id * 7919) % 500) div 20 as int) as y",
        "cast((event_id * 7919) % 20 as int) as x", f"{EVENT_CLASS} as after_class")


def _spread_edits(g):
    """Every event edits its own slice of the grid of events; up to three edits meet in a voxel."""
    place = "event_id * 7919 % 500 div 3"
    return _stream(g, "events").selectExpr(
        "'m_edit' as mask_id", "event_id as seq", "cast(event_id div 500 as int) as z", f"cast(({place}) div 20 as int) as y",
        f"cast(({place}) % 20 as int) as x", f"{EVENT_CLASS} as after_class")


def _net_moves(log: DataFrame) -> DataFrame:
    """Per voxel that a log of change rows leaves changed: its class before (n = -1) and after (n = 1)."""
    moves = log.select("mask_id", "z", "y", "x", F.explode(F.array(
        F.struct(F.col("before_class").alias("c"), F.lit(-1).alias("n")), F.struct(F.col("after_class").alias("c"), F.lit(1).alias("n")))).alias("m"))
    return moves.groupBy("mask_id", "z", "y", "x", F.col("m.c").alias("class_id")).agg(F.sum("m.n").alias("n")).where("n <> 0")


@query
def stream_edits(g):
    """Final mask from the change rows of a stream."""
    path = _folder(g, "edits")
    edit_stream.follow(_edit_stream(g), path + "/log", path + "/checkpoint").awaitTermination()
    return _net_moves(edit_stream.change_log(g.spark, path + "/log")).where("n = 1 and class_id <> 0").drop("n")


@query
def stream_edits_on_mask(g):
    """What a stream changes in a mask that is there already; every tenth edit lies outside its grid."""
    path = _folder(g, "edits")
    edits = _edit_stream(g).withColumns({"mask_id": F.lit("m_type"), "x": F.expr("if(seq % 10 = 0, x + 20, x)")})
    edit_stream.follow(edits, path + "/log", path + "/checkpoint", mask=g.mask, masks=g.masks, volumes=g.volumes).awaitTermination()
    return _net_moves(edit_stream.change_log(g.spark, path + "/log"))


@query
def stream_stats(g):
    """Running statistics per class over all slices of events."""
    path = _folder(g, "stats")
    voxels = g.voxels.where("volume_id = 'events'").withColumn("volume_id", F.lit("edit"))
    edit_stream.follow_stats(_spread_edits(g), g.edit_masks, stage(voxels), path + "/moments", path + "/checkpoint").awaitTermination()
    moments = edit_stream.current_moments(g.spark, path + "/moments").where("class_id > 0")
    out = measure.stats_of(moments, g.edit_volumes)
    return out.select("mask_id", "class_id", "voxels", r6("volume").alias("volume"), r6("mean").alias("mean"), F.round("std", 3).alias("std"))


def _arrivals(g):
    """Slabs of the grid of each event type; the users of a type stand for its slabs."""
    return _stream(g, "events").selectExpr("event_type as volume_id", "user_id as slab_no")


@query
def stream_slabs(g):
    path = _folder(g, "slabs")
    expected = g.table("events").groupBy(F.col("event_type").alias("volume_id")).agg((F.max("user_id") + 1).alias("slabs"))
    slab_stream.follow(_arrivals(g), path + "/seen", path + "/checkpoint").awaitTermination()
    return slab_stream.progress(g.spark, path + "/seen", expected)


@query
def best_available(g):
    """Centre slices: full for the grid whose slabs are all there, low resolution for the other."""
    state = g.volumes.select("volume_id", (F.col("volume_id") == "events").alias("complete"))
    wanted = catalog.slice_range(g.volumes, "xy")
    full = slicing.slices(g.voxels, "xy", wanted).withColumn("value", F.col("value").cast("double"))
    low = resample.downsample(g.voxels, g.volumes, 4)
    rough = slicing.lowres_slice(g.volumes, low, resample.downsampled_volumes(g.volumes, 4), "xy", wanted)
    return slab_stream.best_available(full, rough, state).withColumn("value", r6("value"))
