"""Registered queries: every operator applied to whole grids derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import color, numeric
from ..model import linear_index
from ..operators import (
    appearance, catalog, components, edits, histogram, mask as masking, measure, projection, resample, rle, roi,
    select, slicing,
)
from ..scale import attach, stage
from .grids import Grids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SLICE = ["volume_id", "axis", "idx"]


def query(fn: Callable[[Grids], DataFrame]) -> Callable[[Grids], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Grids(spark, sf_dir))
    return fn


def r6(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def centers(g: Grids, axis: str) -> DataFrame:
    return catalog.slice_range(g.volumes, axis)


def lowres(g: Grids) -> tuple[DataFrame, DataFrame]:
    return resample.downsample(g.voxels, g.volumes, 4), resample.downsampled_volumes(g.volumes, 4)


# ---- catalogue -------------------------------------------------------------------------------

@query
def volume_info(g):
    return catalog.volume_info(g.volumes)


@query
def min_max(g):
    return catalog.min_max(g.voxels)


@query
def with_range(g):
    """One catalogue row declares its range, the other half of one."""
    declared = g.volumes.withColumns({
        "vmin": F.when(F.col("volume_id") == "events", 5.0), "vmax": F.lit(7000.0)})
    return catalog.with_range(declared, g.voxels).select("volume_id", "vmin", "vmax")


@query
def slice_bounds(g):
    return catalog.slice_bounds(g.volumes)


@query
def slice_range(g):
    parts = [catalog.slice_range(g.volumes, axis, radius=3) for axis in ("xy", "xz", "yz")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def value_at(g):
    return catalog.value_at(g.points.drop("mask_id"), g.voxels, g.volumes)


@query
def value_at_lowres(g):
    low, low_volumes = lowres(g)
    at = catalog.value_at_lowres(g.points.drop("mask_id"), low, g.volumes, low_volumes)
    return at.withColumn("v", r6("v"))


@query
def probe_points(g):
    return catalog.probe(g.points.drop("volume_id"), g.voxels, g.volumes, g.mask, g.masks)


@query
def pyramid_plan(g):
    return catalog.pyramid_plan(g.volumes)


@query
def brick_minmax(g):
    return catalog.brick_minmax(g.voxels)


@query
def bricks_hit(g):
    return catalog.bricks_hit(catalog.brick_minmax(g.voxels), 48_000)


# ---- slices and appearance -------------------------------------------------------------------

@query
def slice_xy(g):
    return slicing.slices(g.voxels, "xy", centers(g, "xy"))


@query
def slice_xz(g):
    return slicing.slices(g.voxels, "xz", centers(g, "xz"))


@query
def slice_yz(g):
    return slicing.slices(g.voxels, "yz", centers(g, "yz"))


@query
def lowres_slice(g):
    low, low_volumes = lowres(g)
    out = slicing.lowres_slice(g.volumes, low, low_volumes, "xz", centers(g, "xz"))
    return out.withColumn("value", r6("value"))


@query
def window_level(g):
    at = attach(g.voxels, g.volumes.select("volume_id", "vmin", "vmax"), ["volume_id"], ["z", "y", "x"])
    t = numeric.window_level(numeric.dbl("v"), F.col("vmin"), F.col("vmax") * 0.5)
    return at.select("volume_id", "z", "y", "x", r6(t).alias("level"), r6(numeric.gamma(t, 2.2)).alias("corrected"))


@query
def bilinear_sample(g):
    out = slicing.bilinear_sample(g.samples, slicing.slices(g.voxels, "xy"), g.volumes, "xy")
    return out.withColumn("value", r6("value"))


@query
def rotate_slice(g):
    cells = slicing.with_extent(slicing.slices(g.voxels, "xy"), g.volumes, "xy")
    return slicing.rotate(cells, 1).select("volume_id", "idx", "v", "u", "w", "h", "value")


@query
def slice_to_voxel(g):
    picks = g.samples.select("sample_id", "volume_id", "idx", "px", "py")
    return slicing.slice_to_voxel(picks, g.volumes, "xz").select("sample_id", "volume_id", "z", "y", "x")


@query
def tf_lookup(g):
    lut = appearance.tf_lut(g.spark, "Hot Metal")
    out = appearance.tf_lookup(g.voxels, lut, 0.0, 50_000.0)
    return out.select("volume_id", "z", "y", "x", *[r6(c).alias(c) for c in "rgba"])


@query
def gradient(g):
    return appearance.gradient(g.voxels, 8)


@query
def mask_palette(g):
    return appearance.mask_palette(g.masks, g.rois, (0.2, 0.4, 0.6)).select(
        "mask_id", "class_id", *[r6(c).alias(c) for c in "rgba"])


@query
def mask_palette_active(g):
    active = g.masks.select("mask_id", F.lit("roi-1").alias("roi_id"))
    return appearance.mask_palette(g.masks, g.rois, (1.0, 0.0, 0.0), active).select(
        "mask_id", "class_id", *[r6(c).alias(c) for c in "rgba"])


@query
def overlay_blend(g):
    palette = appearance.mask_palette(g.masks, g.rois, (1.0, 0.0, 0.0))
    marked = g.mask.select(
        "mask_id", F.col("z").alias("idx"), F.col("y").alias("v"), F.col("x").alias("u"), "class_id")
    out = appearance.overlay_blend(slicing.slices(g.voxels, "xy"), g.masks, marked, palette, 0.0, 50_000.0, 0.4)
    return out.select("mask_id", "volume_id", "idx", "v", "u", *[r6(c).alias(c) for c in "rgb"])


@query
def hex_colors(g):
    """Colour codes cut from a digest of each document; some carry no valid code."""
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, " ").otherwise("#"), F.substring(F.md5("text"), 1, 6),
                    F.when(F.col("doc_id") % 5 == 0, "Z").otherwise(""))
    rgb = color.hex_to_rgb(text)
    return g.table("documents").select(
        "doc_id", color.normalize_hex(text).alias("code"), r6(rgb["r"]).alias("r"), r6(rgb["g"]).alias("g"),
        r6(rgb["b"]).alias("b"), color.roi_color(F.col("doc_id")).alias("palette"))


@query
def encoder_features(g):
    cells = slicing.slices(g.voxels, "xy")
    windows = stage(histogram.pseudo_rgb_windows(cells, SLICE))
    out = appearance.encoder_features(cells, windows)
    return out.select(*SLICE, "v", "u", *[r6(f"c{k}").alias(f"c{k}") for k in range(3)])


# ---- projections -----------------------------------------------------------------------------

def _projected(df):
    return df.select("volume_id", "row", "col", "vmax", "vmin", r6("vavg").alias("vavg"))


@query
def project_z(g):
    return _projected(projection.project(g.voxels, "xy"))


@query
def project_y(g):
    return _projected(projection.project(g.voxels, "xz"))


@query
def project_x(g):
    return _projected(projection.project(g.voxels, "yz"))


@query
def project_visible(g):
    return _projected(projection.project_visible(g.voxels, "xy", 48_000))


def _lit(g):
    lit = appearance.tf_lookup(g.voxels, appearance.tf_lut(g.spark, "Grayscale"), 0.0, 50_000.0)
    return projection.composite(lit.withColumnRenamed("a", "alpha"), "xy", ["r", "g", "b"])


@query
def composite_z(g):
    return _lit(g).select("volume_id", "row", "col", *[r6(c).alias(c) for c in ("r", "g", "b", "alpha")])


@query
def composite_mask(g):
    palette = appearance.mask_palette(g.masks, g.rois, (1.0, 0.0, 0.0))
    marked = attach(g.mask, palette, ["mask_id", "class_id"], ["z", "y", "x"]).withColumn("alpha", F.col("a") * 0.25)
    over = projection.composite(marked, "xy", ["r", "g", "b"])
    out = projection.blend(_lit(g), g.masks, over, ["r", "g", "b"])
    return out.select("mask_id", "volume_id", "row", "col", *[r6(c).alias(c) for c in "rgb"])


# ---- histograms and thresholds ---------------------------------------------------------------

@query
def histogram256(g):
    return histogram.histogram256(g.voxels, g.volumes)


@query
def histogram_display(g):
    out = histogram.histogram_display(histogram.histogram256(g.voxels, g.volumes), g.volumes, 10_000, 20_000_000)
    return out.withColumn("height", r6("height"))


@query
def sample_systematic(g):
    at = attach(g.voxels, g.volumes.select("volume_id", "nx", "ny", "nz"), ["volume_id"], ["z", "y", "x"])
    cells = at.select("volume_id", linear_index().alias("linear"), catalog.voxel_count().alias("n"), "v")
    return histogram.sample_systematic(cells, F.col("n"), 777).select("volume_id", "linear", "v")


@query
def otsu_binary(g):
    out = histogram.otsu_binary(histogram.binned(slicing.slices(g.voxels, "xy"), SLICE), SLICE)
    return out.select(*SLICE, "bin", r6("threshold").alias("threshold"))


def _split(df):
    return df.select(*SLICE, "t1", "t2", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query
def otsu_multi3(g):
    return _split(histogram.otsu_multi3(histogram.binned(slicing.slices(g.voxels, "xy"), SLICE), SLICE))


@query
def otsu_multi3_strict(g):
    return _split(histogram.otsu_multi3_strict(histogram.binned(slicing.slices(g.voxels, "xz"), SLICE), SLICE))


@query
def percentiles(g):
    out = histogram.exact_quantiles(g.voxels, ["volume_id"], "v", histogram.WINDOW_QUANTILES)
    return out.withColumn("value", r6("value"))


@query
def pseudo_rgb_windows(g):
    out = histogram.pseudo_rgb_windows(slicing.slices(g.voxels, "xy"), SLICE)
    return out.select(*SLICE, "from_thresholds", *[r6(f"{p}_{k}").alias(f"{p}_{k}") for k in range(3) for p in ("lo", "hi")])


@query
def rect_range(g):
    return measure.rect_range(g.rects, g.voxels, g.volumes, "xy")


@query
def auto_tolerance(g):
    per_slice = g.voxels.groupBy("volume_id", "z").agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    return per_slice.select("volume_id", "z", r6(numeric.auto_tolerance(
        numeric.dbl("vmin"), numeric.dbl("vmax"))).alias("tolerance"))


# ---- statistics ------------------------------------------------------------------------------

def _stats(df):
    return df.select(*[c for c in ("mask_id", "roi_id") if c in df.columns], "class_id", "voxels",
                     r6("volume").alias("volume"), r6("mean").alias("mean"), F.round("std", 3).alias("std"))


@query
def roi_stats(g):
    return _stats(measure.roi_stats(g.mask, g.masks, g.voxels, g.volumes, g.rois))


@query
def roi_stats_delta(g):
    """Statistics after all brush strokes, from the prior ones and the changed voxels."""
    log = select.brush_stamp(g.strokes, g.masks, g.volumes)
    changes = edits.apply_edits(log, g.mask, g.masks, g.volumes).changes
    after = measure.apply_delta(measure.class_moments(g.mask, g.masks, g.voxels),
                                measure.moments_delta(changes, g.masks, g.voxels))
    return _stats(measure.stats_of(after.where("class_id > 0"), g.volumes))


@query
def class_counts(g):
    return measure.class_counts(g.mask, g.masks, g.volumes)


@query
def nonzero_count(g):
    return measure.nonzero_count(measure.class_counts(g.mask, g.masks, g.volumes))


# ---- resampling ------------------------------------------------------------------------------

@query
def z_decimate(g):
    return resample.z_decimate(g.voxels)


def _v6(df):
    return df.withColumn("v", r6("v"))


@query
def downsample2(g):
    return _v6(resample.downsample(g.voxels, g.volumes, 2))


@query
def downsample4(g):
    return _v6(resample.downsample(g.voxels, g.volumes, 4))


@query
def downsample_box(g):
    return _v6(resample.downsample_box(g.voxels, 4))


@query
def pyramid(g):
    return _v6(resample.pyramid(g.voxels, g.volumes))


def _coarse(g):
    return g.volumes.selectExpr("volume_id", "cast(ceil(nx / 3.0D) as int) as tx", "cast(ceil(ny / 4.0D) as int) as ty",
                                "cast(ceil(nz / 2.0D) as int) as tz")


@query
def label_downsample(g):
    return resample.label_downsample(g.mask, g.masks, g.volumes, _coarse(g))


@query
def label_scatter(g):
    return resample.label_scatter(g.mask, g.masks, g.volumes, _coarse(g))


@query
def label_upsample(g):
    fine = g.volumes.selectExpr("volume_id", "nx * 2 as tx", "ny + 7 as ty", "nz as tz")
    return resample.label_upsample(g.mask, g.masks, g.volumes, fine)


@query
def resize_nearest(g):
    cells = slicing.with_extent(slicing.slices(g.voxels, "xy"), g.volumes, "xy")
    return resample.resize_nearest(cells, 24, 33).select("volume_id", "idx", "v", "u", "value")


# ---- selection -------------------------------------------------------------------------------

@query
def threshold_slice(g):
    return select.threshold_slice(slicing.slices(g.voxels, "xy"), 20_000_000, 2_500)


@query
def threshold_apply(g):
    return select.threshold_apply(g.voxels, g.volumes, 2_500, 20_000_000, 1)


def _seeds(g, axis):
    """The centre of every slice."""
    n, nu, nv = {"xy": ("nz", "nx", "ny"), "xz": ("ny", "nx", "nz"), "yz": ("nx", "ny", "nz")}[axis]
    return g.volumes.select(
        "volume_id", F.lit(axis).alias("axis"), F.explode(F.expr(f"sequence(0, {n} - 1)")).alias("idx"),
        F.expr(f"cast({nv} div 2 as int)").alias("sv"), F.expr(f"cast({nu} div 2 as int)").alias("su"),
        (0.15 * F.col("vmax")).alias("tolerance"))


@query
def region_grow(g):
    return select.region_grow(slicing.slices(g.voxels, "xy"), _seeds(g, "xy"), F.col("tolerance"))


@query
def region_grow_slices(g):
    picks = g.volumes.selectExpr("volume_id", "cast(ny div 2 as int) as idx", "nx / 2.0D as px", "nz / 2.0D as py", "vmax")
    return select.region_grow_slices(g.voxels, g.volumes, "xz", picks, 3, F.col("vmax") * 0.2)


@query
def connected_components(g):
    chosen = select.threshold_slice(slicing.slices(g.voxels, "xy"), 3_000, 15_000_000)
    out = components.components(chosen, SLICE, 8)
    # The label as linear index of the component's first cell.
    at = attach(out, g.volumes.select("volume_id", "nx"), ["volume_id"], ["v", "u"])
    first = F.expr("shiftright(label, 31) * nx + (label & 2147483647)")
    return at.select(*SLICE, "v", "u", first.cast("bigint").alias("label"))


@query
def drop_small_islands(g):
    chosen = select.threshold_slice(slicing.slices(g.voxels, "xy"), 2_000, 20_000_000)
    areas = g.volumes.select("volume_id", F.lit("xy").alias("axis"), F.explode(F.expr("sequence(0, nz - 1)")).alias("idx"),
                             (F.col("nx") * F.col("ny")).alias("area"))
    return select.drop_small_islands(chosen, areas)


@query
def brush_stamp(g):
    return select.brush_stamp(g.strokes, g.masks, g.volumes)


@query
def decode_mask_logits(g):
    """Eight vectors of 64 values form the candidate rasters of one slice."""
    logits = g.table("embeddings").selectExpr(
        "vec_id div 8 as slice_id", "cast(vec_id % 8 as int) as mask_no", "cast(label as double) as score",
        "posexplode(embedding) as (p, logit)",
    ).selectExpr("slice_id", "mask_no", "score", "cast(p div 8 as int) as v", "cast(p % 8 as int) as u", "logit")
    sizes = logits.groupBy("slice_id").agg(F.max("u").alias("mu"), F.max("v").alias("mv")).selectExpr(
        "slice_id", "mu + 1 as mw", "mv + 1 as mh", "20 as w", "25 as h")
    return select.decode_mask_logits(logits, sizes)


# ---- masks -----------------------------------------------------------------------------------

@query
def mask_at(g):
    return masking.mask_at(g.points.drop("volume_id"), g.mask, g.masks, g.volumes)


def _updates(g):
    """A class for the voxel under every probe; several probes may hit one voxel."""
    return g.points.selectExpr("mask_id", "z", "y", "x", "point_id as seq", "point_id % 7 - 1 as class_id")


@query
def set_voxels(g):
    return masking.set_voxels(g.mask, g.masks, g.volumes, _updates(g)).mask


@query
def set_voxels_changes(g):
    return masking.set_voxels(g.mask, g.masks, g.volumes, _updates(g)).changes


@query
def mask_slice(g):
    return masking.mask_slice(g.mask, g.masks, g.volumes, "yz", 7)


@query
def voxels_of_class(g):
    return masking.voxels_of_class(g.mask, g.masks, g.volumes, 2)


@query
def remap_class(g):
    return masking.remap_class(g.mask, g.masks, g.volumes, 2, 4).mask


@query
def remap_fill(g):
    """Moves the background to class 9: the rest of the grid stays implicit."""
    out = masking.remap_class(g.mask, g.masks, g.volumes, 0, 9)
    return measure.class_counts(out.mask, out.masks, g.volumes)


@query
def remap_counts(g):
    pairs = g.masks.select("mask_id", F.explode(F.expr("map(0, 5, 1, 2, 4, 0, 7, 1)")).alias("source", "target"))
    return masking.remap(g.mask, g.masks, g.volumes, pairs).changed


@query
def used_class_ids(g):
    return masking.used_class_ids(g.mask, g.masks)


@query
def fill_mask(g):
    rows, masks = masking.fill(g.mask, g.masks, 6)
    return measure.class_counts(rows, masks, g.volumes)


@query
def write_selection(g):
    chosen = select.threshold_slice(slicing.slices(g.voxels, "xz"), 2_500, 20_000_000)
    changes = masking.write_selection(g.mask, g.masks, g.volumes, "xz", chosen, 5).changes
    return masking.with_linear(changes, g.masks, g.volumes)


@query
def restore_selection(g):
    chosen = select.threshold_slice(slicing.slices(g.voxels, "xz"), 2_500, 20_000_000)
    written = masking.write_selection(g.mask, g.masks, g.volumes, "xz", chosen, 5)
    undo = masking.with_linear(written.changes, g.masks, g.volumes)
    return masking.restore(written.mask, g.masks, g.volumes, undo).mask


@query
def apply_bits(g):
    bits = g.table("events").selectExpr("'m_type' as mask_id", "event_id as linear", "cast(user_id % 3 as int) as bit")
    return masking.apply_bits(g.mask, g.masks, g.volumes, bits, 3).mask


@query
def only_class(g):
    return masking.only_class(g.mask, g.masks.select("mask_id", F.lit(1).alias("class_id")))


@query
def ensure_mask(g):
    """The mask on orders was made for another grid, so it starts empty."""
    grids = g.masks.join(g.volumes.select("volume_id", "nx", "ny", "nz"), "volume_id").selectExpr(
        "mask_id", "volume_id", "fill_value", "nx as gx", "if(mask_id = 'm_prio', ny + 1, ny) as gy", "nz as gz")
    rows, masks = masking.ensure_mask(g.mask, grids, g.volumes)
    n = rows.groupBy("mask_id").agg(F.count(F.lit(1)).alias("rows"))
    return masks.join(n, "mask_id", "left").select(
        "mask_id", "fill_value", "gx", "gy", "gz", "kept", F.coalesce("rows", F.lit(0)).alias("rows"))


def _bright(g):
    at = attach(g.voxels.where("v > 5000"), g.masks.select("mask_id", "volume_id"), ["volume_id"], ["z", "y", "x"])
    return at.select("mask_id", "z", "y", "x")


@query
def mask_union(g):
    return masking.union_classes(g.mask.where("class_id = 1"), _bright(g), ["mask_id", "z", "y", "x"])


@query
def mask_difference(g):
    return masking.difference_classes(g.mask.where("class_id = 1"), _bright(g), ["mask_id", "z", "y", "x"])


@query
def mask_intersection(g):
    return masking.intersect_classes(g.mask.where("class_id = 1"), _bright(g), ["mask_id", "z", "y", "x"])


# ---- regions of interest ---------------------------------------------------------------------

@query
def next_class_id(g):
    return roi.next_class_id(g.masks, g.rois.where("class_id <> 3"))


@query
def add_roi(g):
    wanted = g.masks.select("mask_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("nth"))
    return roi.add_rois(g.masks, g.rois.where("class_id <> 2"), wanted)


@query
def add_roi_with_class(g):
    """One candidate per part; only the first for a class and an id is admitted."""
    candidates = g.table("part").selectExpr(
        "'m_type' as mask_id", "p_partkey as nth", "p_size + 0.5D as class_id",
        "concat('roi-', cast(p_partkey % 60 as string)) as roi_id", "p_name as name",
        "cast(null as string) as color_hex", "p_size > 10 as visible", "cast(null as boolean) as locked")
    return roi.add_rois_with_class(candidates)


@query
def find_roi(g):
    return roi.find_roi(g.rois, class_id=3)


@query
def delete_roi(g):
    doomed = g.masks.select("mask_id", F.lit("roi-1").alias("roi_id"))
    done, _, active = roi.delete_rois(g.mask, g.masks, g.volumes, g.rois, doomed)
    counts = measure.class_counts(done.mask, done.masks, g.volumes)
    return counts.join(active, "mask_id", "left")


@query
def duplicate_roi(g):
    sources = g.masks.select("mask_id", F.lit("roi-2").alias("roi_id"))
    written, rois = roi.duplicate_roi(g.mask, g.masks, g.volumes, g.rois, sources)
    n = measure.class_counts(written.mask, g.masks, g.volumes)
    return rois.join(n, ["mask_id", "class_id"], "left").select(
        "mask_id", "roi_id", "class_id", "name", "color_hex", F.coalesce("n", F.lit(0)).alias("n"))


# ---- run-length encodings --------------------------------------------------------------------

def _classes(g):
    """Every class in use, the background, and one without voxels."""
    return g.masks.select("mask_id", F.explode(F.expr("array(0, 1, 2, 3, 4, 9)")).alias("class_id"))


@query
def rle_binary_runs(g):
    return rle.rle_binary(g.mask, g.masks, g.volumes, _classes(g), block=4096)


@query
def rle_binary_header(g):
    return rle.rle_header(rle.rle_binary(g.mask, g.masks, g.volumes, _classes(g), block=4096))


@query
def rle_binary_roundtrip(g):
    runs = rle.rle_binary(g.mask, g.masks, g.volumes, g.rois.select("mask_id", "class_id"))
    headers = rle.rle_header(runs)
    lists = runs.select("mask_id", "class_id", "run_no", F.col("len").alias("length"))
    positions, _ = rle.rle_binary_decode(lists, headers, ["mask_id", "class_id"])
    return rle.positions_to_voxels(positions, g.masks, g.volumes).select("mask_id", "z", "y", "x", "class_id")


@query
def rle_decode_refused(g):
    """Declared totals that the runs of odd classes do not reach."""
    runs = rle.rle_binary(g.mask, g.masks, g.volumes, g.rois.select("mask_id", "class_id"))
    headers = rle.rle_header(runs).withColumn("total_voxels", F.col("total_voxels") + F.col("class_id") % 2)
    lists = runs.select("mask_id", "class_id", "run_no", F.col("len").alias("length"))
    return rle.rle_binary_decode(lists, headers, ["mask_id", "class_id"])[1]


@query
def rle_label_runs(g):
    rows = g.table("events").selectExpr("'m_type' as mask_id", "event_id as linear", "event_type")
    label = F.expr("case event_type when 'click' then 1 when 'error' then 1 when 'purchase' then 3 else 0 end")
    return rle.rle_label(rows.select("mask_id", "linear", label.alias("value")), ["mask_id"], "linear", "value", block=4096)


@query
def rle_label_tiles(g):
    return rle.tile_runs(g.mask, g.masks, g.volumes, 16)


@query
def tiles_roundtrip(g):
    packed = rle.pack_tiles(rle.tile_runs(g.mask, g.masks, g.volumes, 8))
    return rle.tiles_restore(packed, g.masks, g.volumes, 8)[0]


@query
def tiles_refused(g):
    """Tiles in odd columns declare one voxel too many."""
    packed = rle.pack_tiles(rle.tile_runs(g.mask, g.masks, g.volumes, 8))
    broken = packed.withColumn("total_voxels", F.col("total_voxels") + F.col("cx") % 2)
    return rle.tiles_restore(broken, g.masks, g.volumes, 8)[1]


# ---- edit history ----------------------------------------------------------------------------

@query
def effective_edits(g):
    return edits.effective_edits(g.edit_log, g.no_mask, g.edit_masks, block=2048).select(
        "mask_id", "seq", "z", "y", "x", "before_class", "after_class")


@query
def apply_edits(g):
    return edits.apply_edits(g.edit_log, g.no_mask, g.edit_masks, g.edit_volumes).mask


def _strokes(g):
    return stage(edits.merge_strokes(edits.effective_edits(g.edit_log, g.no_mask, g.edit_masks), block=2048))


@query
def merge_strokes(g):
    return edits.merge_strokes(edits.effective_edits(g.edit_log, g.no_mask, g.edit_masks), block=2048)


@query
def undo_strokes(g):
    now = edits.apply_edits(g.edit_log, g.no_mask, g.edit_masks, g.edit_volumes).mask
    return edits.undo(_strokes(g), now, g.edit_masks, g.edit_volumes, 50).mask


@query
def redo_strokes(g):
    now = edits.apply_edits(g.edit_log, g.no_mask, g.edit_masks, g.edit_volumes).mask
    return edits.redo(_strokes(g), now, g.edit_masks, g.edit_volumes, 50, 20).mask


@query
def dirty_slices(g):
    log = select.brush_stamp(g.strokes, g.masks, g.volumes)
    return edits.dirty_slices(edits.apply_edits(log, g.mask, g.masks, g.volumes).changes)
