"""Transfer functions, palettes, overlays, gradients and encoder features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.color import TRANSFER_STOPS, hex_to_rgb
from ..functions.numeric import dbl, encoder_channel, round_half_up, window_level
from ..model import VOXEL_KEY
from ..scale import attach, spread_out

CHANNELS = ("r", "g", "b", "a")
GRADIENT_ROWS = 1 << 17  # voxels and halo rows of a task, about


def tf_lut(spark: SparkSession, preset: str) -> DataFrame:
    """256 entries (i, r, g, b, a) interpolated between the stops of a preset."""
    stops = TRANSFER_STOPS[preset]
    segments = F.array(*[
        F.struct(
            F.lit(n).alias("n"), F.lit(lo[0]).alias("p0"), F.lit(hi[0]).alias("p1"),
            F.array(*[F.lit(float(x)) for x in lo[1:]]).alias("c0"),
            F.array(*[F.lit(float(x)) for x in hi[1:]]).alias("c1"))
        for n, (lo, hi) in enumerate(zip(stops, stops[1:]))
    ])
    t = F.col("i").cast("double") / F.lit(255.0)
    lut = spark.range(256).select(F.col("id").cast("int").alias("i")).withColumn("_t", t).withColumn(
        "_s", F.element_at(F.filter(segments, lambda s: (F.col("_t") >= s["p0"]) & (F.col("_t") <= s["p1"])), 1))
    f = (F.col("_t") - F.col("_s.p0")) / (F.col("_s.p1") - F.col("_s.p0"))
    return lut.select("i", *[
        round_half_up(F.col("_s.c0")[k] + (F.col("_s.c1")[k] - F.col("_s.c0")[k]) * f).cast("int").alias(c)
        for k, c in enumerate(CHANNELS)
    ])


def tf_lookup(samples: DataFrame, lut: DataFrame, lo, hi, value: str = "v") -> DataFrame:
    """Colour 0..1 of each sample by linear filtering between two of the 256 entries.

    The table is one row holding 256 entries, so its broadcast has a fixed size.
    """
    packed = lut.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", *CHANNELS))).alias("_lut"))
    # Texel centres lie at (i + 0.5) / 256.
    spot = window_level(dbl(value), lo, hi) * F.lit(256.0) - F.lit(0.5)
    at = samples.join(F.broadcast(packed)).withColumn("_t", spot)
    at = at.withColumns({
        "_i0": F.greatest(F.lit(0), F.floor("_t")).cast("int"),
        "_i1": F.least(F.lit(255), F.floor("_t") + 1).cast("int"),
        "_f": F.col("_t") - F.floor("_t"),
    })
    e0, e1 = F.element_at("_lut", F.col("_i0") + 1), F.element_at("_lut", F.col("_i1") + 1)
    return at.select(*samples.columns, *[
        ((e0[c] * (F.lit(1.0) - F.col("_f")) + e1[c] * F.col("_f")) / F.lit(255.0)).alias(c) for c in CHANNELS
    ])


def mask_palette(masks: DataFrame, rois: DataFrame, fallback: tuple[float, float, float],
                 active: DataFrame | None = None) -> DataFrame:
    """256 colours per mask: class 0 is transparent, hidden regions have alpha 0.

    ``active`` (mask_id, roi_id) keeps only that region visible where a mask has one.
    """
    slots = masks.select("mask_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("class_id"))
    known = rois.where(F.col("class_id").between(1, 255)).select(
        "mask_id", "roi_id", "class_id", "visible", hex_to_rgb(F.col("color_hex")).alias("c"))
    if active is None:
        known = known.withColumn("_active", F.lit(None).cast("string"))
    else:
        known = known.join(active.select("mask_id", F.col("roi_id").alias("_active")), "mask_id", "left")
    fr, fg, fb = fallback
    on = F.col("visible") & (F.col("_active").isNull() | (F.col("_active") == F.col("roi_id")))
    return slots.join(known, ["mask_id", "class_id"], "left").select(
        "mask_id", "class_id",
        F.coalesce("c.r", F.lit(float(fr))).alias("r"),
        F.coalesce("c.g", F.lit(float(fg))).alias("g"),
        F.coalesce("c.b", F.lit(float(fb))).alias("b"),
        F.when(F.col("class_id") == 0, 0.0).when(F.col("roi_id").isNull(), 1.0)
        .when(on, 1.0).otherwise(0.0).alias("a"))


def overlay_blend(cells: DataFrame, masks: DataFrame, mask_cells: DataFrame, palette: DataFrame, lo, hi, opacity: float) -> DataFrame:
    """Grey slice cells with the class colours of ``mask_cells`` (mask_id, idx, v, u, class_id) on top.

    A picture for every mask of ``masks`` (mask_id, volume_id): volumes with several masks have several.
    """
    per_volume = masks.groupBy("volume_id").agg(F.collect_set("mask_id").alias("_masks"))
    grey = attach(cells.withColumn("_g", window_level(dbl("value"), lo, hi)), per_volume, ["volume_id"], ["idx", "v", "u"])
    grey = grey.withColumn("mask_id", F.explode("_masks")).drop("_masks")
    marked = attach(mask_cells.where(F.col("class_id") > 0).select("mask_id", "idx", "v", "u", "class_id"), palette,
                    ["mask_id", "class_id"], ["idx", "v", "u"])
    both = grey.join(marked, ["mask_id", "idx", "v", "u"], "left")
    a = F.coalesce(F.lit(float(min(1.0, max(0.0, opacity)))) * F.col("a"), F.lit(0.0))
    return both.select("mask_id", "volume_id", "idx", "v", "u", *[
        (F.col("_g") * (F.lit(1.0) - a) + F.coalesce(F.col(c), F.lit(0.0)) * a).alias(c) for c in ("r", "g", "b")
    ])


def gradient(voxels: DataFrame, size: int = 32) -> DataFrame:
    """Central differences on three axes; the border repeats the edge value.

    Every brick gets a one-voxel halo from its neighbours, so a single shuffle by brick serves the windows
    of all three axes. Tasks are as many as the rows ask for, so that what a task sorts does not grow.
    """
    def home(c: str) -> Column:
        return F.expr(f"cast({c} div {size} as int)")

    def halo(c: str) -> Column:
        """Offsets of the one neighbouring brick, if any, that needs this voxel on axis ``c``."""
        first, last = F.expr(f"{c} % {size} = 0 and {c} > 0"), F.expr(f"{c} % {size} = {size - 1}")
        step = F.when(first, F.lit(-1)).when(last, F.lit(1))
        offset = F.struct(*[(step if k == c else F.lit(0)).alias(f"d{k}") for k in "zyx"])
        return F.when(step.isNotNull(), F.array(offset)).otherwise(F.slice(F.array(own), 1, 0))

    brick = ["volume_id", "bz", "by", "bx"]
    own = F.struct(*[F.lit(0).alias(f"d{c}") for c in "zyx"])
    spread = voxels.select(*VOXEL_KEY, "v", F.explode(F.concat(F.array(own), *[halo(c) for c in "zyx"])).alias("d"))
    spread = spread_out(spread.select(
        *VOXEL_KEY, "v", *[(home(c) + F.col(f"d.d{c}")).alias(f"b{c}") for c in "zyx"],
        ((F.col("d.dz") == 0) & (F.col("d.dy") == 0) & (F.col("d.dx") == 0)).alias("_own"),
    ), *brick, per_task=GRADIENT_ROWS)
    for c in "zyx":
        others = [k for k in "zyx" if k != c]
        line = W.partitionBy(*brick, *others).orderBy(c)
        ahead, behind = F.lead("v").over(line), F.lag("v").over(line)
        # Halo rows of the other axes lie on lines of their own, which hold no row of this brick.
        spread = spread.withColumn(f"g{c}", (
            F.coalesce(ahead, F.col("v")) - F.coalesce(behind, F.col("v"))).cast("double") * F.lit(0.5))
    return spread.where("_own").select(*VOXEL_KEY, "gx", "gy", "gz")


def encoder_features(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """Three standardised channels per slice cell from the slice's windows (lo_k, hi_k)."""
    at = attach(cells, windows, ["volume_id", "axis", "idx"], ["v", "u"])
    return at.select("volume_id", "axis", "idx", "v", "u", *[
        encoder_channel(dbl("value"), F.col(f"lo_{k}"), F.col(f"hi_{k}"), k).alias(f"c{k}") for k in range(3)
    ])
